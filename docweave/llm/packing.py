"""Best-fit decreasing packing of tokenised documents into fixed windows.

A document's ids are its tokens and an end id.  Full windows are cut off its
front, each a sequence of its own; the rest is placed by best fit, longest
first: a segment tree over remaining capacities finds the tightest open window
that still takes the piece, in O(log window) whatever is open.

Pieces are dealt evenly over tasks of about ``GROUP`` pieces and each task packs
its own, so no task sees all.  With thousands of pieces in a task the padding is
that of the last windows of each task.

The tokenizer drops white space and never merges across it, so the ids of a text
are those of its white-space separated chunks end to end.  Chunks are looked up
in a bounded cache and encoded in batches; the result doesn't depend on it.  The
strings of special tokens, where a text holds them, are cut out first and give
those tokens' ids, as in a plain call of the tokenizer.

Edge cases: null and empty texts are one piece, the end id.  Rows are
independent: repeated rows and null doc_ids are packed as they come.  Other
columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import text as tx
from .scratch import Scratch

WINDOW = 4096
END_ID = 2
GROUP = 40_000
CACHE_ENTRIES = 600_000
_LONG_CHUNK = 64
RUN_BYTES = 1 << 21


class ChunkIds:
    """Ids (little-endian unsigned 32-bit) of texts, through a cache of chunks.

    A chunk is a white-space separated part in lower case, a full stop or comma
    after a Latin letter being one of its own: the tokenizer folds case, and cuts
    there too.  New chunks are encoded as one text with ``MARK`` between them.
    """

    MARK = b"\x01"
    _STOP = re.compile(rb"[.,](?=[ \n])(?:(?<=[a-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))")

    def __init__(self, tokenizer_json: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json.decode())
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        # special tokens are found in the raw text, before case is folded: ``encode`` sees to them
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = {t.content.encode(): i.to_bytes(4, "little") for i, t in added.items()}
        self.simple = not any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values()) and all(t.special for t in added.values())
        longest_first = sorted(self.special, key=len, reverse=True)
        self.find = re.compile(b"(" + b"|".join(map(re.escape, longest_first)) + b")") if added else None
        self.tokenizer.encode_special_tokens = True
        self.mark = self._ids(self.MARK)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _ids(self, text: bytes) -> list[int]:
        return self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids  # without offsets

    def _encode(self, chunks: list[bytes]) -> list[bytes]:
        if len(self.mark) == 1 and not any(self.MARK in c for c in chunks):
            between = b" " + self.MARK + b" "
            ids = np.array(self._ids(between.join(chunks)), "<u4")
            cuts = np.flatnonzero(ids == self.mark[0])
            if len(cuts) == len(chunks) - 1:
                raw = ids.tobytes()
                return [raw[4 * a : 4 * b] for a, b in zip([0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)])]
        return [np.array(self._ids(c), "<u4").tobytes() for c in chunks]

    def encode(self, raws: list[bytes]) -> list[bytes]:
        """Ids of each text, as of ``encode(text, add_special_tokens=False)``."""
        if self.find is None or not any(map(self.find.search, raws)):
            return self._plain(raws)
        if not self.simple:
            return [self._whole(raw) for raw in raws]
        parts = [self.find.split(raw) for raw in raws]  # text, token, text, ...
        ids = iter(self._plain([x for p in parts for x in p[::2]]))
        return [b"".join(self.special[x] if i & 1 else next(ids) for i, x in enumerate(p)) for p in parts]

    def _whole(self, raw: bytes) -> bytes:
        self.tokenizer.encode_special_tokens = False
        try:
            return np.array(self._ids(raw), "<u4").tobytes()
        finally:
            self.tokenizer.encode_special_tokens = True

    def _plain(self, raws: list[bytes]) -> list[bytes]:
        chunks = [self._STOP.sub(rb" \g<0>", raw.lower()).split() for raw in raws]
        known, older = self.known, self.older
        # the chunks of a few documents first: a small dict, which stays in the processor's cache
        here = set().union(*chunks)
        local = dict(zip(here, map(known.get, here)))
        new = []
        for c in [c for c, ids in local.items() if ids is None]:
            ids = older.get(c)
            if ids is None:
                new.append(c)
            else:
                known[c] = local[c] = ids
        for lo in range(0, len(new), 256):
            part = new[lo : lo + 256]
            ids = self._encode(part)
            local.update(zip(part, ids))
            known.update(x for x in zip(part, ids) if len(x[0]) <= _LONG_CHUNK)
        out = [b"".join(map(local.__getitem__, x)) for x in chunks]
        if len(known) > CACHE_ENTRIES:  # what is in use comes back from the older half
            self.older, self.known = known, {}
        return out


def _pieces(tokenizer, window: int, end_id: int, with_ids: bool):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
    types = [pa.int64()] * 5 + [pa.binary()]
    end = end_id.to_bytes(4, "little")

    def run_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = tokenizer.value
        encoder = tx.worker_slot(("packing", hash(raw)), lambda: ChunkIds(raw))
        for b in batches:
            doc_ids = b.column(0).to_pylist()
            for run in tx.runs(b.column(1), RUN_BYTES):
                rows = []
                for i, ids in enumerate(encoder.encode([run.bytes_of(i).tobytes() for i in range(len(run))]), run.first):
                    ids += end
                    n = len(ids) >> 2
                    for s in range(0, n, window):
                        e = min(n, s + window)
                        part = ids[4 * s : 4 * e]
                        rows.append((doc_ids[i], s, e - s, zlib.crc32(part), n, part if with_ids else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run_over


class BestFit:
    """Open windows by remaining capacity, in a segment tree of counts."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.leaves = 1 << window.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]
        self.used: list[int] = []

    def _add(self, capacity: int, by: int) -> None:
        i = capacity + self.leaves
        while i:
            self.tree[i] += by
            i >>= 1

    def _tightest(self, size: int) -> int:
        """The least capacity of at least ``size`` among the open windows, or -1."""
        tree, i = self.tree, size + self.leaves
        if tree[i]:
            return size
        while i > 1:
            if not i & 1 and tree[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if tree[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1

    def place(self, size: int) -> tuple[int, int]:
        """(window, offset) for a piece."""
        capacity = self._tightest(size)
        if capacity < 0:
            capacity, which = self.window, len(self.used)
            self.used.append(0)
        else:
            which = self.open[capacity].pop()
            self._add(capacity, -1)
        offset = self.used[which]
        self.used[which] += size
        if capacity > size:
            self.open[capacity - size].append(which)
            self._add(capacity - size, 1)
        return which, offset


def best_fit_decreasing(sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of each piece."""
    fit = BestFit(window)
    which, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        which[i], offset[i] = fit.place(int(sizes[i]))
    return which, offset


def _pack(window: int):
    def run_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        sizes = np.concatenate([b.column(2).to_numpy() for b in held])
        which, offset = best_fit_decreasing(sizes, window)
        which += TaskContext.get().partitionId() << 32
        lo = 0
        for b in held:
            hi = lo + b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(which[lo:hi]), pa.array(offset[lo:hi])], names=[*b.schema.names, "sequence_id", "offset"])
            lo = hi

    return run_over


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, ids, sequence_id, offset.

    start: the document's ids before the piece; ids: the piece's ids as unsigned
    32-bit little-endian (null unless ``with_ids``); offset: where it stands in
    its sequence.
    """
    scratch = Scratch(spark, "packing")
    with open(tokenizer_path, "rb") as f:
        tokenizer = spark.sparkContext.broadcast(f.read())
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
    pieces = scratch.stage(docs.mapInArrow(_pieces(tokenizer, window, end_id, with_ids), schema), "pieces")
    groups = max(1, round(pieces.count() / GROUP))
    # dealt evenly whatever the keys: a piece's place doesn't matter
    return pieces.repartition(groups).mapInArrow(_pack(window), f"{schema}, sequence_id long, offset long")
