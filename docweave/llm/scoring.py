"""Language-model scores by online logistic context mixing.

A token is a word (A-Z folded) or the end of its document.  The model is

    P(token) = (c - d) / N  [for c > 0]  +  d V / N * P_bits(token)
    P_e(token) = (c_e - d_e) / N_e  [for c_e > 0]  +  d_e V_e / N_e * P(token)

with the training count c, N tokens, V distinct ones and the discount d; P_bits
spells the token's bytes and a closing space, bit by bit (the end is one newline
byte), so every byte string has a probability and they sum to one.  There is one
expert e for each of the ``experts`` most frequent languages of the training
documents and one for the rest.  One more expert mixes whole documents: it spells the
tokens with single spaces between them bit by bit, every one where it stands, with contexts that cross words.
A document's probability is the Bayes mixture of
all experts and P, so their weights adapt as the document goes on; its own
language column is not looked at.

P_bits mixes hashed-context bit predictors: the last 1, 2, 3 and 4 bytes of the
word and its whole prefix.  The mixer of documents has its own: the last 1 to 4 bytes of the document, and
the word before with the prefix of this one, over all training texts.
Each is a table of bit counts, sized by the training vocabulary (for documents by
training bytes over ``BYTES_PER_SLOT``):
2**17 slots for one byte, up to the next power of two over the number of distinct words for the
longest contexts (2**19 to 2**``max_table_bits`` slots, the bound of what is broadcast).  Their
logits are combined by weights that two gates select (the bits of the byte so
far; the longest context seen, and the place in the word), summed in the logistic
domain.  The weights learn online, over a stream of the training words dealt by
hash, each word predicted from counts without itself (documents: each bit), in pieces of ``PIECE_BYTES`` with the words before as context.  An adaptive probability
map, indexed by gate and quantised logit, refines what the mixer says.

What depends only on the last bytes, the place and the byte itself is worked out once for all such bytes of a run;
the longest context is looked up for each.

Distribution.  Word counts are reduced by Spark.  All the bit counts of all
training words go into the tables, summed over tasks; mixers learn in one stream
a task and are averaged.  Tables and mixers are broadcast, compressed, as they lie on every executor's disk.
Each distinct word is priced once, whatever its count; prices travel to
the chunk of documents that asked for them, a task of its own, and are added up there by the
places of the documents' words in the chunk's list, so texts are read and cut into words once
and neither vocabulary nor documents are ever in one place.

Edge cases: null and empty texts are the end token alone.  A null doc_id is not
held out.  Repeated rows each count and each come out.  Without training
documents all counts are 0 and P_bits is uniform over bits.  Other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import text as tx
from .scratch import Scratch

ORDERS = (1, 2, 3, 4, 0)  # 0: the whole prefix
#: Tables of the shorter contexts need no more slots than this, in bits, and take part of the longest ones'.
ORDER_BITS = {1: 17, 2: 19, 3: 21}
LEAST_BITS, MAX_TABLE_BITS = 19, 24
CHUNK_BYTES = 48 << 20
MAX_TASKS, GROUP_TASKS = 50_000, 64
LOCAL_WORDS = 20_000
SLICE_TOKENS = 1 << 17
END = b"\n"
BATCH = 1 << 14
#: Bytes of documents in a piece, and so many training bytes for a slot of the longest contexts of documents.
PIECE_BYTES, BYTES_PER_SLOT = 40_000, 128
#: Bytes that are spelled at a time, whose equal contexts are found together, and those whose bits are mixed at a time.
RUN_BYTES, STEP_BYTES = 1 << 18, 1 << 12
#: Bytes that a task counts bits of at least, so that there are few rows of every block to add up.
COUNT_BYTES = 256 << 20

U64 = np.uint64
_K = len(ORDERS)
_BLOCK = 1 << 15
_SQL = {"int64": "long", "binary": "binary"}


def table_bits(words: int, most: int = MAX_TABLE_BITS) -> tuple[int, ...]:
    """Bits of the number of slots of each predictor's table, for so many distinct training words."""
    longest = min(most, max(LEAST_BITS, max(1, words - 1).bit_length()))
    return tuple(min(ORDER_BITS.get(order, longest), longest) for order in ORDERS)


def _tokens(text: bytes) -> list[bytes]:
    words = text.lower().split()  # the six ASCII separators
    words.append(END)
    return words


class _Places(dict):
    """Word to its place in the chunk's list; words are added as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Near(dict):
    """The places of some documents' words: a small table, which stays in the processor's cache."""

    def __init__(self, places: _Places) -> None:
        super().__init__()
        self.places = places

    def __missing__(self, word: bytes) -> int:
        self[word] = n = self.places[word]
        return n


#: A place is a long: 24 bits of scan task, 14 of its chunk, one that tells documents from words, 24 of the word in the chunk.
_AT, _CHUNK = 24, 14
#: What stands before a document's word places: whether held out, whether it has an id, the id, its bytes, its log10 probability by the mixer of documents.
_HEADER = "<??qqd"
_HEADER_SIZE = struct.calcsize(_HEADER)


def _packed(ids: np.ndarray, compress) -> bytes:
    """Three bytes each (a chunk has under 2**24 words), all low ones first: the high ones are mostly 0.  Then compressed."""
    return compress(ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    x = np.frombuffer(raw, np.uint8).reshape(3, -1).astype(np.int32)
    return x[0] | x[1] << 8 | x[2] << 16


def _pieces(text: bytes) -> Iterator[tuple[bytes, int]]:
    """A document's tokens as the mixer spells them, some words at a time, and how many bytes at the front only give context."""
    whole = b" ".join(_tokens(text))
    lo = 0
    while lo < len(whole):
        hi = whole.find(b" ", lo + PIECE_BYTES) + 1 or len(whole)
        # the word before, and more words until the longest context of bytes is there
        first = lo
        while first and (first == lo or lo - first <= max(ORDERS)):
            first = whole.rfind(b" ", 0, first - 1) + 1
        yield whole[first:hi], lo - first
        lo = hi


def _piece_runs(texts: Iterator[bytes]) -> Iterator[tuple[list[int], list[bytes], list[int]]]:
    """(owners, pieces, context bytes) of documents, about ``RUN_BYTES`` at a time."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for piece, context in _pieces(text):
            held.append((i, piece, context))
            size += len(piece)
            if size > RUN_BYTES:
                yield tuple(map(list, zip(*held)))
                held, size = [], 0
    if held:
        yield tuple(map(list, zip(*held)))


def _spelled(batches: Iterator[pa.RecordBatch], documents: bool) -> Iterator[tuple[list[bytes], list[int] | None]]:
    """(words, none) of a column of words, or (pieces, context bytes) of one of texts."""
    if not documents:
        yield from ((words, None) for words, _ in _word_runs(batches))
        return
    for b in batches:
        for run in tx.runs(b.column(0)):
            yield from (found[1:] for found in _piece_runs(run.bytes_of(i).tobytes() for i in range(len(run))))


def _price_documents(mixer: Mixer, tables: Tables, texts: list[bytes]) -> np.ndarray:
    """log10 probability of each document, bit by bit over all of it."""
    out = np.zeros(len(texts))
    for owner, pieces, context in _piece_runs(iter(texts)):
        np.add.at(out, owner, mixer.log10(tables, pieces, context))
    return out


def _scan(experts, tables_of, mixer_of):
    """Documents as places in their chunk's list of words, and every chunk's words with their training counts by expert."""
    n_experts = len(experts) + 1
    names = ["place", "doc", "word", *(f"n{e}" for e in range(n_experts))]
    types = [pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * n_experts]
    schema = pa.schema(list(zip(names, types)))

    def run_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        tx.worker_slot("scoring", lambda: None)
        compress = zstandard.ZstdCompressor(level=5, write_checksum=False).compress
        chunk, size = TaskContext.get().partitionId() << _CHUNK, 0
        places = _Places()
        near = _Near(places)
        counts = np.zeros((n_experts, 1 << 16), np.int64)

        def words() -> Iterator[pa.RecordBatch]:
            keys = list(places)
            if len(keys) > 1 << _AT:
                raise ValueError(f"{len(keys)} distinct words in one chunk")
            for lo in range(0, len(keys), 20_000):
                part = keys[lo : lo + 20_000]
                m = len(part)
                own = [pa.array(c[lo : lo + m]) for c in counts]
                yield pa.RecordBatch.from_arrays([pa.array((chunk << _AT + 1) + np.arange(lo, lo + m)), pa.nulls(m, types[1]), pa.array(part, pa.binary()), *own], schema=schema)

        for b in batches:
            doc_ids, held, langs = b.column(0).to_pylist(), b.column(1).to_pylist(), [experts.get(x, n_experts - 1) for x in b.column(3).to_pylist()]
            for run in tx.runs(b.column(2)):
                n, ids = len(run), []
                if len(near) > LOCAL_WORDS:
                    near = _Near(places)
                for i in range(n):
                    tokens = _tokens(run.bytes_of(i).tobytes())
                    ids.append(np.fromiter(map(near.__getitem__, tokens), np.int32, len(tokens)))
                if len(places) > counts.shape[1]:
                    counts = np.concatenate([counts, np.zeros((n_experts, max(len(places), counts.shape[1])), np.int64)], 1)
                own: dict[int, list[np.ndarray]] = {}
                for i, x in enumerate(ids, run.first):
                    if not held[i]:
                        own.setdefault(langs[i], []).append(x)
                for e, x in own.items():
                    seen, times = np.unique(np.concatenate(x), return_counts=True)
                    counts[e][seen] += times
                sizes = np.diff(run.offsets).tolist()
                mixed = _price_documents(mixer_of.value, tables_of.value, [run.bytes_of(i).tobytes() for i in range(n)]).tolist()
                docs = [struct.pack(_HEADER, held[i], doc_ids[i] is not None, doc_ids[i] or 0, k, m) + _packed(x, compress) for i, (x, k, m) in enumerate(zip(ids, sizes, mixed), run.first)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, (chunk << 1 | 1) << _AT)), pa.array(docs, pa.binary()), *(pa.nulls(n, t) for t in types[2:])], schema=schema)
                size += len(run.data)
                if size > CHUNK_BYTES:
                    yield from words()
                    places, size, chunk = _Places(), 0, chunk + 1
                    near, counts = _Near(places), np.zeros((n_experts, 1 << 16), np.int64)
        yield from words()

    return run_over, ", ".join(f"{n} {_SQL[str(t)]}" for n, t in zip(names, types))


_BYTE = np.arange(256)[:, None]
_SHIFT = np.arange(7, -1, -1)[None, :]
#: Of each byte, by bit: the bit, the node that it is decided at (the bits before it), what the node adds to a context.
BIT = (_BYTE >> _SHIFT) & 1
NODE = (_BYTE | 256) >> (_SHIFT + 1)
_STEP = NODE.astype(U64) * U64(0x9E3779B97F4A7C15)
_BIT = BIT.astype(np.float32)
_SIGN = 2 * _BIT - 1
_PLACE_BITS = 22


def _rows(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows (of a flat table, values) by places that all lie inside: without the check, in half the time."""
    return table.take(at, 0, mode="clip")


class Bits:
    """The bit decisions of some words or pieces of documents, eight a byte, in tables of 2**bits slots.

    The first ``skip`` bytes of each only give context.  Contexts of the last bytes are few: what
    depends on them alone is worked out once for all bytes that are the ``same``.
    """

    def __init__(self, words: list[bytes], bits: tuple[int, ...], skip: list[int] | None = None) -> None:
        # pieces of documents bring their spaces along
        spelled = [w if skip is not None or w == END else w + b" " for w in words]
        sizes = np.array([len(s) for s in spelled])
        data = np.frombuffer(b"".join(spelled), np.uint8)
        n = len(data)
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.arange(n)
        place = at - first
        last = np.zeros(n, U64)
        for k in range(1, max(ORDERS) + 1):
            last[k:] |= np.where(place[k:] >= k, data[:-k], 0).astype(U64) << U64(8 * (k - 1))
        # the previous word and what there is of this one; in the first word of all, this one alone
        fresh = np.zeros(n, np.int64)
        after = np.flatnonzero((data[:-1] == 32) & (place[1:] > 0)) + 1
        fresh[after] = after
        word_first = np.maximum(np.maximum.accumulate(fresh), first)
        two_first = np.maximum(np.where(word_first > 0, word_first[np.maximum(word_first - 1, 0)], 0), first)
        whole = tx.span_hashes(tx.prefix_hashes(data, tx.BYTE), two_first, at)
        self.bits, self.byte, self.last, self.whole = bits, data, last, whole
        self.places = np.minimum(at - word_first, 3)
        self.word = np.repeat(np.arange(len(words)), sizes)
        if skip is not None and any(skip):
            own = place >= np.repeat(np.array(skip), sizes)
            self.byte, self.last, self.whole, self.places, self.word = (x[own] for x in (self.byte, self.last, self.whole, self.places, self.word))

    def __len__(self) -> int:
        return 8 * len(self.byte)

    def slots_of(self, k: int, at: slice | np.ndarray = slice(None)) -> np.ndarray:
        """The slots of some bytes in table k, eight in a row."""
        order = ORDERS[k]
        context = tx.mix((self.last[at] & U64((1 << 8 * order) - 1)) * U64(8) + U64(k)) if order else self.whole[at]
        slots = _rows(_STEP, self.byte[at])
        slots ^= context[:, None]
        slots *= U64(0xD6E8FEB86659FD93)
        slots >>= U64(64 - self.bits[k])
        return slots.view(np.int64)

    def entries_of(self, k: int, at: slice | np.ndarray = slice(None)) -> np.ndarray:
        """Where the bits that came are counted: a slot has an entry for 0 and one for 1."""
        entries = self.slots_of(k, at)
        entries *= 2
        entries += _rows(BIT, self.byte[at])
        return entries

    def same(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes with equal last bytes before them and equal places: the first of each kind, each byte's kind, how many of each."""
        n = len(self.byte)
        key = self.last << U64(10) | (self.places << 8 | self.byte).astype(U64)
        if n >> _PLACE_BITS:
            _, first, kind, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            return first, kind, times
        key = np.sort(key << U64(_PLACE_BITS) | np.arange(n, dtype=U64))  # faster than sorting indices
        at = (key & U64((1 << _PLACE_BITS) - 1)).view(np.int64)
        key >>= U64(_PLACE_BITS)
        new = np.ones(n, bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        kind = np.empty(n, np.int64)
        kind[at] = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        return at[starts], kind, np.diff(starts, append=n)

    @property
    def bit(self) -> np.ndarray:
        return BIT[self.byte].ravel()

    @property
    def node(self) -> np.ndarray:
        return NODE[self.byte].ravel()

    @property
    def place(self) -> np.ndarray:
        return np.repeat(self.places, 8)

    @property
    def slots(self) -> list[np.ndarray]:
        return [self.slots_of(k).ravel() for k in range(_K)]


def _word_runs(batches: Iterator[pa.RecordBatch], column: int = 0, most: int = 30_000) -> Iterator[tuple[list[bytes], pa.RecordBatch]]:
    for b in batches:
        lo, size, lengths = 0, 0, [len(w) for w in b.column(column).to_pylist()]
        for hi in range(b.num_rows + 1):
            if hi == b.num_rows or hi - lo >= most or size + lengths[hi] > RUN_BYTES and hi > lo:
                if hi > lo:
                    part = b.slice(lo, hi - lo)
                    yield part.column(column).to_pylist(), part
                lo, size = hi, 0
            if hi < b.num_rows:
                size += lengths[hi]


def _count_bits(bits: tuple[int, ...], documents: bool = False):
    """(block, counts): the slots that were met in each block of each table, as sorted places and their counts.

    A table's slots alternate: times 0, times 1.  Blocks are numbered over all tables.
    """
    first = np.cumsum([0, *((2 << n) // _BLOCK for n in bits)])

    def run_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros(2 << n, np.uint32) for n in bits]
        some = False
        for words, skip in _spelled(batches, documents):
            rows = Bits(words, bits, skip)
            some = True
            kinds, _, times = rows.same()
            times = np.repeat(times, 8).astype(np.uint32)
            for k in range(_K - 1):
                np.add.at(tables[k], rows.entries_of(k, kinds).ravel(), times)
            for lo in range(0, len(rows.byte), STEP_BYTES):
                np.add.at(tables[-1], rows.entries_of(_K - 1, slice(lo, lo + STEP_BYTES)).ravel(), np.uint32(1))
        if not some:
            return
        for k, table in enumerate(tables):
            for i, block in enumerate(table.reshape(-1, _BLOCK)):
                at = np.flatnonzero(block)
                if len(at):
                    counts = _sparse(at, block[at])
                    yield pa.RecordBatch.from_arrays([pa.array([int(first[k]) + i], pa.int32()), pa.array([counts], pa.binary())], names=["block", "counts"])

    return run_over


def _sparse(at: np.ndarray, counts: np.ndarray) -> bytes:
    """Places and counts of a block, the counts in as few bytes as the greatest needs; the first byte tells how many."""
    width = next(w for w in (1, 2, 4, 8) if counts.max(initial=0) < 1 << 8 * w)
    return bytes([width]) + np.diff(at, prepend=0).astype("<u2").tobytes() + counts.astype(f"<u{width}").tobytes()


def _spread(raw: bytes) -> np.ndarray:
    width, out = raw[0], np.zeros(_BLOCK, np.float64)
    n = (len(raw) - 1) // (2 + width)
    out[np.cumsum(np.frombuffer(raw, "<u2", n, 1).astype(np.int64))] = np.frombuffer(raw, f"<u{width}", n, 1 + 2 * n)
    return out


def _add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One block's counts over all tasks."""
    total = np.zeros(_BLOCK, np.float64)
    for x in table.column("counts"):
        total += _spread(x.as_py())
    at = np.flatnonzero(total)
    return pa.table({"block": pa.array([key[-1].as_py()], pa.int32()), "counts": pa.array([_sparse(at, total[at])], pa.binary())})


_GATES = (256, (_K + 1) * 4)
_BUCKETS = 33
#: One more predictor that knows something moves the second gate so far.
_DEEPER = 4
_NODE_GATE = NODE * _GATES[1]


def _squash(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) + np.float32(0.5) * np.tanh(np.float32(0.5) * x)


_SEEN = np.float32(1e-6)


def _logits(one: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """Clipped log odds; exactly 0 only where nothing was seen."""
    out = np.clip(np.log((one + np.float32(0.08)) / (zero + np.float32(0.08))), -8, 8)
    out[(out == 0) & (one + zero > 0)] = _SEEN
    return out


class Tables:
    """The bit counts, and what pricing or learning needs of them: made once a worker.

    What comes by broadcast stays compressed, and a worker holds one of the two at a time.
    """

    def __init__(self, bits: tuple[int, ...], counts: list[np.ndarray]) -> None:
        self.bits, self._counts, self._packed = bits, counts, None
        self._made: tuple[bool, list[np.ndarray]] | None = None

    def __getstate__(self) -> tuple:
        """Compressed, the bytes of a count apart: a broadcast lies on the disk of the driver and of every executor."""
        import zstandard

        compress = zstandard.ZstdCompressor(level=1).compress
        return self.bits, self._packed or [compress(np.ascontiguousarray(c.astype("<f4").view(np.uint8).reshape(-1, 4).T)) for c in self._counts]

    def __setstate__(self, state: tuple) -> None:
        self.__init__(state[0], None)
        self._packed = state[1]

    def _table(self, k: int) -> np.ndarray:
        if self._counts is not None:
            return self._counts[k]
        import zstandard

        raw = zstandard.ZstdDecompressor().decompress(self._packed[k])
        return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<f4").ravel()

    @property
    def counts(self) -> list[np.ndarray]:
        return [self._table(k) for k in range(_K)]

    def _logits(self, k: int, learn: bool) -> np.ndarray:
        """Of predictor k by slot; for learning by slot and bit, without the bit itself: its own count one less."""
        c = self._table(k)
        zero, one = c[::2], c[1::2]
        if not learn:
            return _logits(one, zero)
        by_bit = np.empty_like(c)
        by_bit[::2] = _logits(one, np.maximum(zero - 1, 0))
        by_bit[1::2] = _logits(np.maximum(one - 1, 0), zero)
        return by_bit

    def logits(self, learn: bool) -> list[np.ndarray]:
        if self._made is None or self._made[0] != learn:
            self._made = None
            self._made = learn, [self._logits(k, learn) for k in range(_K)]
            tx.release()
        return self._made[1]

    def inputs(self, bits: Bits, k: int, at: slice | np.ndarray = slice(None), learn: bool = False) -> np.ndarray:
        """The logits of predictor k for some bytes, eight in a row; where bits are learned, without the bit itself."""
        return _rows(self.logits(learn)[k], bits.entries_of(k, at) if learn else bits.slots_of(k, at))

    def short_inputs(self, bits: Bits, first: np.ndarray, learn: bool = False) -> tuple[list[np.ndarray], np.ndarray]:
        """Of a byte of each kind the logits of all predictors but the longest, and its gate as if that one knew nothing."""
        x = [self.inputs(bits, k, first, learn) for k in range(_K - 1)]
        return x, sum((c != 0).astype(np.int64) for c in x) * _DEEPER + bits.places[first][:, None]

    def price_inputs(self, bits: Bits) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The logits of each predictor and the gates, bit by bit."""
        x = [self.inputs(bits, k).ravel() for k in range(_K)]
        return x, [bits.node, sum((c != 0).astype(np.int64) for c in x) * _DEEPER + bits.place]


class Mixer:
    """Gated weights over the predictors' logits, and the map that refines the outcome."""

    def __init__(self) -> None:
        self.weights = [np.full((_K, g), 0.3 / len(_GATES), np.float32) for g in _GATES]
        self.hits = np.zeros(_GATES[1] * _BUCKETS)
        self.ones = np.zeros(_GATES[1] * _BUCKETS)
        self.seen = 0

    def _joint(self) -> np.ndarray:
        """The weights of each predictor by both gates."""
        return (self.weights[0][:, :, None] + self.weights[1][:, None, :]).reshape(_K, -1)

    @staticmethod
    def _cell(logit: np.ndarray, gate: np.ndarray) -> np.ndarray:
        bucket = np.rint(logit * np.float32(2))
        bucket += np.float32(_BUCKETS // 2)
        np.clip(bucket, 0, _BUCKETS - 1, out=bucket)
        return gate * _BUCKETS + bucket.astype(np.int64)

    def learn(self, tables: Tables, bits: Bits) -> None:
        first, kind, _ = bits.same()
        short, gates = tables.short_inputs(bits, first, learn=True)
        for lo in range(0, len(bits.byte), BATCH // 8):
            s = slice(lo, lo + BATCH // 8)
            byte, own = bits.byte[s], kind[s]
            x = [*(_rows(c, own) for c in short), tables.inputs(bits, _K - 1, s, learn=True)]
            gate = _rows(gates, own)
            gate += (x[-1] != 0) * _DEEPER
            joint = _rows(_NODE_GATE, byte)
            joint += gate
            logit = np.zeros(gate.shape, np.float32)
            for w, c in zip(self._joint(), x):
                part = _rows(w, joint)
                part *= c
                logit += part
            bit = _rows(BIT, byte)
            cell = self._cell(logit, gate)
            cell *= 2
            cell += bit
            met = np.bincount(cell.ravel(), minlength=2 * len(self.hits))
            self.hits += met[::2]
            self.hits += met[1::2]
            self.ones += met[1::2]
            error = _rows(_BIT, byte)
            error -= _squash(logit)
            joint = joint.ravel()
            # by both gates at once: either gate's sums are those over the other; the last row is how many
            sums = np.empty((_K + 1, _GATES[0] * _GATES[1]))
            for k, c in enumerate(x):
                c *= error
                sums[k] = np.bincount(joint, weights=c.ravel(), minlength=sums.shape[1])
            sums[_K] = np.bincount(joint, minlength=sums.shape[1])
            sums = sums.reshape(_K + 1, *_GATES)
            rate = 0.15 * 1.0 / (1 + self.seen / 2e6) ** 0.3
            for w, own in zip(self.weights, (sums @ np.ones(_GATES[1]), np.ones(_GATES[0]) @ sums)):
                w += rate * own[:_K] / (own[_K] + 30.0)
            self.seen += 8 * len(byte)

    def log10(self, tables: Tables, words: list[bytes], skip: list[int] | None = None) -> np.ndarray:
        """log10 probability of each of some words, or of pieces of documents without their context."""
        bits = Bits(words, tables.bits, skip)
        first, kind, _ = bits.same()
        short, gates = tables.short_inputs(bits, first)
        weights, joint = self._joint(), _NODE_GATE[bits.byte[first]] + gates
        # what the shorter contexts say where the longest one is unknown, and where it is not, then with its weight
        known = joint + _DEEPER
        unknown, shorter = (sum(_rows(w, at) * c for w, c in zip(weights, short)) for at in (joint, known))
        weight = _rows(weights[-1], known)
        # (p + (ones + 50 p) / (hits + 50)) / 2, of the bit that came: slope p + rest
        slope = (0.5 + 25 / (self.hits + 50)).astype(np.float32)
        one = self.ones / (self.hits + 50) / 2
        rest = np.column_stack([0.5 - 25 / (self.hits + 50) - one, one]).astype(np.float32).ravel()
        out = np.zeros(len(bits.byte))
        for lo in range(0, len(out), STEP_BYTES):
            s = slice(lo, lo + STEP_BYTES)
            byte, own = bits.byte[s], kind[s]
            x = tables.inputs(bits, _K - 1, s)
            has = x != 0
            x *= _rows(weight, own)
            x += _rows(shorter, own)
            logit, gate = _rows(unknown, own), _rows(gates, own)
            np.copyto(logit, x, where=has)
            gate += has * _DEEPER
            cell = self._cell(logit, gate)
            logit *= _rows(_SIGN, byte)
            p = _squash(logit)
            p *= _rows(slope, cell)
            cell *= 2
            cell += _rows(BIT, byte)
            p += _rows(rest, cell)
            np.clip(p, 1e-5, 1 - 1e-5, out=p)
            whole = p[:, 0].astype(np.float64)
            for j in range(1, 8):
                whole *= p[:, j]
            out[s] = np.log10(whole)
        return np.bincount(bits.word, weights=out, minlength=len(words))


def _train(tables_of, documents: bool = False):
    def run_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        mixer, tables = Mixer(), tables_of.value
        for words, skip in _spelled(batches, documents):
            mixer.learn(tables, Bits(words, tables.bits, skip))
        if mixer.seen:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((mixer.weights, mixer.hits, mixer.ones, mixer.seen, False))], pa.binary())], names=["mixer"])

    return run_over


def _summed(found) -> tuple:
    """Mixers added up, the weights by the bits that each has seen."""
    import pickle

    total = None
    for raw in found:
        weights, hits, ones, seen, added = pickle.loads(raw)
        weights = weights if added else [w.astype(np.float64) * seen for w in weights]
        total = (weights, hits, ones, seen) if total is None else ([a + b for a, b in zip(total[0], weights)], total[1] + hits, total[2] + ones, total[3] + seen)
    return (*total, True)


def _add_mixers(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    import pickle

    return pa.table({"mixer": pa.array([pickle.dumps(_summed(x.as_py() for x in table.column("mixer")))], pa.binary())})


def _average(found: list[bytes]) -> Mixer:
    out = Mixer()
    if found:
        weights, out.hits, out.ones, out.seen, _ = _summed(found)
        out.weights = [(w / out.seen).astype(np.float32) for w in weights]
    return out


class Level:
    """Counts of one expert, or of all training tokens: N, V and the discount."""

    def __init__(self, tokens: int, distinct: int, once: int, twice: int) -> None:
        self.tokens, self.distinct = int(tokens or 0), int(distinct or 0)
        self.discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
        self.escape = self.discount * self.distinct / self.tokens if self.tokens else 1.0

    def log10(self, c: np.ndarray, log_lower: np.ndarray) -> np.ndarray:
        """log10((c - d) / N + escape * lower), also where the lower term is far below the least double."""
        spelled = np.log10(self.escape) + log_lower
        if not self.tokens:
            return spelled
        own = np.maximum(c - self.discount, 0) / self.tokens
        with np.errstate(divide="ignore"):
            log_own = np.log10(own)
        top = np.maximum(spelled, log_own)
        return top + np.log10(np.power(10.0, spelled - top) + np.power(10.0, log_own - top))


_HEAD = np.dtype([("low", "<u4"), ("high", "<u2"), ("shared", "<f4")])  # a count has 48 bits
_OWN = np.dtype([("expert", "u1"), ("price", "<f4")])


def pack_prices(c: np.ndarray, shared: np.ndarray, own: np.ndarray, has: np.ndarray) -> list[bytes]:
    """The count, the shared price, and the prices of the experts that have counts; the others' follow from the shared one."""
    head = np.zeros(len(c), _HEAD)
    head["low"], head["high"], head["shared"] = c & 0xFFFFFFFF, c >> 32, shared
    row, expert = np.nonzero(has)
    tail = np.zeros(len(row), _OWN)
    tail["expert"], tail["price"] = expert, own[row, expert]
    h, t = head.tobytes(), tail.tobytes()
    ends = np.cumsum(has.sum(1)).tolist()
    size = _HEAD.itemsize
    return [h[size * i : size * i + size] + t[5 * a : 5 * b] for i, (a, b) in enumerate(zip([0, *ends], ends))]


def unpack_prices(packed: list[bytes], log_escapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(count, prices by expert and last the shared one)."""
    size = _HEAD.itemsize
    head = np.frombuffer(b"".join([x[:size] for x in packed]), _HEAD)
    tail = np.frombuffer(b"".join([x[size:] for x in packed]), _OWN)
    owner = np.repeat(np.arange(len(packed)), [(len(x) - size) // 5 for x in packed])
    price = head["shared"][:, None] + np.append(log_escapes, 0).astype(np.float32)[None, :]
    price[owner, tail["expert"]] = tail["price"]
    return head["low"].astype(np.int64) | head["high"].astype(np.int64) << 32, price


def _price(tables_of, mixer_of, everything: Level, levels: list[Level]):
    def run_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, part in _word_runs(batches):
            own = np.column_stack([part.column(1 + e).to_numpy().astype(np.float64) for e in range(len(levels))])
            c = own.sum(1)
            shared = everything.log10(c, mixer_of.value.log10(tables_of.value, words))
            prices = np.column_stack([level.log10(x, shared) for level, x in zip(levels, own.T)])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pack_prices(c.astype(np.int64), shared, prices, own > 0), pa.binary())], names=["word", "prices"])

    return run_over


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())])


def _sum_up(everything: Level, levels: list[Level], log_priors: np.ndarray):
    """Over rows (place, value) in order: a chunk's words with their prices, then its documents."""
    n_all = everything.tokens
    base_of = n_all + 0.1 * (everything.distinct + 1)
    log_escapes = np.log10([level.escape for level in levels])

    def scores(docs: list[bytes], count: np.ndarray, price: np.ndarray, log_base: np.ndarray, decompress) -> pa.RecordBatch:
        held, has_id, doc_id, n_bytes, mixed = zip(*(struct.unpack_from(_HEADER, x) for x in docs))
        ids = [_unpacked(decompress(x[_HEADER_SIZE:])) for x in docs]
        n = np.array([len(x) for x in ids])
        at = np.concatenate(ids)  # every document has its end at least
        first = np.cumsum(n) - n
        each = log_priors + np.column_stack([np.add.reduceat(price[at], first, 0, np.float64), mixed])
        top = each.max(1)
        score = top + np.log10(np.power(10.0, each - top[:, None]).sum(1))
        known, base = np.add.reduceat((count[at] > 0).astype(np.int64), first), np.add.reduceat(log_base[at], first)
        columns = [pa.array([i if has else None for i, has in zip(doc_id, has_id)], pa.int64()), pa.array(held), pa.array(n.astype(np.int64)), pa.array(known), pa.array(np.full(len(n), n_all, np.int64)), pa.array(base), pa.array(score), pa.array(n_bytes, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, schema=_OUT)

    def run_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        decompress = zstandard.ZstdDecompressor().decompress
        chunk, packed, count, price, log_base = None, [], None, None, None
        for b in batches:
            parts = b.column(0).to_numpy() >> _AT
            cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                values = b.column(1).slice(lo, hi - lo).to_pylist()
                if parts[lo] >> 1 != chunk:
                    chunk, packed, count = parts[lo] >> 1, [], None
                if not parts[lo] & 1:
                    packed += values  # a word each, in the order of their places
                    continue
                if count is None:
                    count, price = unpack_prices(packed, log_escapes)
                    log_base, packed = np.log10((count + 0.1) / base_of), []
                sizes = np.cumsum([zstandard.frame_content_size(x[_HEADER_SIZE : _HEADER_SIZE + 32]) // 3 for x in values])
                at = 0
                while at < len(values):  # some documents at a time
                    end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_TOKENS, "right")))
                    yield scores(values[at:end], count, price, log_base, decompress)
                    at = end

    return run_over


def _learned(spark: SparkSession, rows: DataFrame, bits: tuple[int, ...], size: int, documents: bool):
    """Broadcast tables and mixer of a column of words, or of texts, of about ``size`` bytes."""
    sc = spark.sparkContext
    tasks = max(sc.defaultParallelism, -(-size // COUNT_BYTES))
    met = rows.coalesce(tasks).mapInArrow(_count_bits(bits, documents), "block int, counts binary")
    if tasks > GROUP_TASKS:  # two levels, so that no group has a row of every task
        met = met.withColumn("some", F.spark_partition_id() % GROUP_TASKS).groupBy("some", "block").applyInArrow(_add, "block int, counts binary")
    met = met.groupBy("block").applyInArrow(_add, "block int, counts binary")
    tables = np.zeros(sum(2 << n for n in bits), np.float32)
    for r in met.toLocalIterator():  # bounded by the tables
        tables[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = _spread(bytes(r["counts"]))
    tables_of = sc.broadcast(Tables(bits, np.split(tables, np.cumsum([2 << n for n in bits])[:-1])))
    mixers = rows.mapInArrow(_train(tables_of, documents), "mixer binary").withColumn("some", F.spark_partition_id() % GROUP_TASKS).groupBy("some").applyInArrow(_add_mixers, "mixer binary")
    return tables_of, sc.broadcast(_average([bytes(r["mixer"]) for r in mixers.collect()]))  # at most GROUP_TASKS small rows


def mixing_scores(spark: SparkSession, docs: DataFrame, folds: int = 10, experts: int = 8, max_table_bits: int = MAX_TABLE_BITS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte), a row for each row of ``docs``."""
    scratch = Scratch(spark, "scoring")
    sc = spark.sparkContext
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).select("doc_id", held_out.alias("held_out"), "text", "lang")
    by_lang = docs.where(~F.col("held_out")).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(experts).collect()
    known = {r["lang"]: e for e, r in enumerate(by_lang)}
    train = docs.where(~F.col("held_out")).select("text")
    size = train.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    of_documents = _learned(spark, train, table_bits(size // BYTES_PER_SLOT, max_table_bits), size, True)
    scan, schema = _scan(known, *of_documents)
    scanned = scratch.stage(docs.mapInArrow(scan, schema), "scan")
    for x in of_documents:  # their copies on disk
        x.destroy()
    own = [f"n{e}" for e in range(len(known) + 1)]
    wanted = scanned.where("word is not null")
    vocabulary = scratch.stage(wanted.groupBy("word").agg(*(F.sum(c).alias(c) for c in own)), "vocabulary")
    total = sum((F.col(c) for c in own[1:]), F.col(own[0]))
    facts = [f(c) for c in (total, *(F.col(x) for x in own)) for f in (F.sum, lambda c: F.count(F.when(c > 0, 1)), lambda c: F.count(F.when(c == 1, 1)), lambda c: F.count(F.when(c == 2, 1)))]
    word_bytes, *row = vocabulary.agg(F.sum(F.octet_length("word")), *(f.alias(f"f{i}") for i, f in enumerate(facts))).head()
    everything, *levels = (Level(*row[i : i + 4]) for i in range(0, len(row), 4))
    # half a document's worth of trust in each expert, the shared model among them; less in the mixer of documents, which
    # costs a text three digits and leaves short ones at what their counts say
    shares = np.append(np.array([r["n"] for r in by_lang] + [0.0, 0.0]) + 0.5, 0.001)
    log_priors = np.log10(shares / shares.sum())

    words = vocabulary.where(total > 0).select("word")
    # the vocabulary was dealt by hash when its counts were added up: its files are streams of words in no order of their own
    tables_of, mixer_of = _learned(spark, words, table_bits(everything.distinct, max_table_bits), word_bytes or 0, False)
    priced = vocabulary.mapInArrow(_price(tables_of, mixer_of, everything, levels), "word binary, prices binary")

    asked = wanted.select("place", "word").hint("shuffle_merge").join(priced, "word").select("place", F.col("prices").alias("value"))
    texts = scanned.where("doc is not null").select("place", F.col("doc").alias("value"))
    # a chunk is a task of its own: chunk k of scan task p goes to task k * tasks + p
    chunk = F.shiftright("place", _AT + 1)
    scan_task, of_task = F.shiftright(chunk, _CHUNK), chunk.bitwiseAND((1 << _CHUNK) - 1)
    r = scanned.agg(F.max(scan_task), F.max(of_task)).head()
    scans, most = (r[0] or 0) + 1, (r[1] or 0) + 1
    n_tasks = min(scans * most, MAX_TASKS)
    both = asked.unionByName(texts).repartitionById(n_tasks, ((of_task * scans + scan_task) % n_tasks).cast("int")).sortWithinPartitions("place")
    out = both.mapInArrow(_sum_up(everything, levels, log_priors), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long")
    per_byte = F.when(F.col("n_bytes") > 0, -F.col("score") / F.lit(float(np.log10(2))) / F.col("n_bytes"))
    return out.withColumn("bits_per_byte", per_byte).drop("n_bytes")
