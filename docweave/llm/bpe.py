"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Merging a pre-token always takes the pair of least rank, leftmost among equals.
Pairs wait in one bucket a rank, holding positions of a doubly linked list of
parts.  A two-level bitmap (256 ranks a word, one word over the words) has a bit for
each bucket in use; find-first-set from the top gives the least rank in two steps whatever the
queue holds, so a pre-token of n bytes takes O(n log n) and not O(n^2).  Entries
whose pair has changed since are skipped when they surface.

Texts are cut by the vocabulary's pattern, each match is encoded on its own, and
a match that is itself a token is taken whole.  A bounded cache keeps the ids of
short pre-tokens; it holds no state that results depend on.

The vocabulary file is read on the driver and broadcast (about 1 MB, fixed).

Edge cases: null and empty texts have no ids and decode to nothing.  Rows are
independent: ties, repeated rows and null doc_ids come out as they went in.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import text as tx

CACHE_ENTRIES = 500_000
CACHE_CHARS = 48
_SLICE = 64


#: Letters, numbers and white space of Unicode below U+0250.
_LATIN = {"\\p{L}": "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "\\p{N}": "0-9\xb2\xb3\xb9\xbc-\xbe", "\\s": "\t-\r \x85\xa0"}
_WIDE = re.compile("[^\x00-\u024f]").search


def latin_pattern(pattern: str) -> str | None:
    """The same pattern for texts below U+0250, in explicit classes that the plain ``re`` engine takes; else None."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        for name, chars in _LATIN.items():
            if pattern.startswith(name, i):
                out.append(chars if inside else f"[{chars}]")
                i += len(name)
                break
        else:
            if pattern.startswith("\\S", i) and not inside:
                out.append(f"[^{_LATIN['\\s']}]")
                i += 2
                continue
            c = pattern[i]
            if c == "\\" or c == "." or (c in "+*?}" and pattern[i + 1 : i + 2] == "+") or (c == "(" and pattern[i + 1 : i + 3] not in ("?!", "?=", "?:")):
                return None
            inside = c == "[" or (inside and c != "]")
            out.append(c)
            i += 1
    return "".join(out)


class RankQueue:
    """The bitmap levels and the buckets of the ranks in use.

    ``Encoder.merge`` works on them in place: a method call for each of its steps
    would cost more than the step.
    """

    __slots__ = ("low", "buckets")

    def __init__(self, ranks: int) -> None:
        self.low = [0] * ((ranks >> 8) + 1)
        self.buckets: dict[int, int | list[int]] = {}


class Encoder(dict):
    """A dict from pre-token to its ids (little-endian unsigned 32-bit), filled on demand."""

    def __init__(self, vocabulary: bytes, pattern: str) -> None:
        super().__init__()
        self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in vocabulary.splitlines() if line)}
        tokens = {r: t for t, r in self.ranks.items()}
        self.tokens = [tokens.get(r) for r in range(max(tokens) + 1)]
        self.packed = {t: r.to_bytes(4, "little") for t, r in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.queue = RankQueue(len(self.tokens))
        self.find = regex.compile(pattern).findall
        narrow = latin_pattern(pattern)
        self.narrow = re.compile(narrow).findall if narrow else None
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            raw = piece.encode()
            ids = self.packed.get(raw) or self.merge(raw)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:  # what is in use comes back from the older half
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def merge(self, raw: bytes) -> bytes:
        n = len(raw)
        get, longest, queue = self.ranks.get, self.longest, self.queue
        low, buckets, top = queue.low, queue.buckets, 0
        after = list(range(1, n + 1))  # start of the next part, which is this part's end
        before = list(range(-1, n - 1))
        wait = [get(raw[i : i + 2], -1) for i in range(n)]  # rank of the pair that starts here
        wait[-1] = -1
        fresh = range(n)  # where a pair has appeared
        while True:
            for i in fresh:
                if (r := wait[i]) < 0:
                    continue
                if (bucket := buckets.get(r)) is None:
                    buckets[r] = i  # most hold one position, and need no list
                    a = r >> 8
                    top |= 1 << a
                    low[a] |= 1 << (r & 255)
                elif bucket.__class__ is int:
                    buckets[r] = [bucket, i] if bucket < i else [i, bucket]
                else:
                    heappush(bucket, i)
            while top:
                # find-first-set, level by level
                a = (top & -top).bit_length() - 1
                word = low[a]
                rank = a << 8 | (word & -word).bit_length() - 1
                i = buckets[rank]
                if i.__class__ is list and len(i) > 1:
                    i = heappop(i)
                else:
                    if i.__class__ is list:
                        i = i[0]
                    del buckets[rank]
                    low[a] = word = word & (word - 1)
                    if not word:
                        top &= top - 1
                if wait[i] == rank:
                    break  # else stale
            else:
                break
            j = after[i]
            k = after[i] = after[j]
            wait[j] = r = -1
            if k < n:
                before[k] = i
                if (end := after[k]) - i <= longest:
                    r = get(raw[i:end], -1)
            wait[i] = r
            h = before[i]
            if h >= 0:
                r = get(raw[h:k], -1) if k - h <= longest else -1
                fresh = (i, h) if r != wait[h] else (i,)
                wait[h] = r
            else:
                fresh = (i,)
        out, i, packed = [], 0, self.packed
        while i < n:
            out.append(packed[raw[i : after[i]]])
            i = after[i]
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        find = self.find if self.narrow is None or _WIDE(text) else self.narrow
        return b"".join(map(self.__getitem__, find(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _round_trip(vocabulary, pattern: str, digest: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def run_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a worker process serves many tasks; what it has learned of one vocabulary stays
        raw = vocabulary.value
        encoder = tx.worker_slot(("bpe", hash((raw, pattern))), lambda: Encoder(raw, pattern))
        for b in batches:
            for lo in range(0, b.num_rows, _SLICE):
                part = b.slice(lo, _SLICE)
                ids = [encoder.encode(t) if t else b"" for t in part.column(1).to_pylist()]
                decoded = [encoder.decode(x) for x in ids]
                sizes = [len(x) >> 2 for x in ids]
                if digest:
                    ids, decoded = ([hashlib.sha256(x).digest() for x in y] for y in (ids, decoded))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], schema=schema)

    return run_over


def bpe_round_trip(spark: SparkSession, docs: DataFrame, vocabulary_path: str, pattern: str, digest: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded), a row for each row of ``docs``.

    ids: unsigned 32-bit little-endian token ids; decoded: the bytes they decode
    to.  ``digest``: the SHA-256 of each in its place.
    """
    with open(vocabulary_path, "rb") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_round_trip(vocabulary, pattern, digest), "doc_id long, n_tokens long, ids binary, decoded binary")
