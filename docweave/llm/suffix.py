"""Exact substring dedup: sampled prefix doubling over byte positions.

A byte goes if it is covered by a string of ``length`` bytes (100) that also
starts earlier: in a smaller doc_id, or earlier in the same document.  All
strings are judged on the input.

Method.  Prefix doubling ranks positions by short prefixes, then sorts (rank,
rank at an offset) pairs at growing offsets, and drops a position once its rank
is unique or its prefix has reached the threshold.  Sorting every byte position
costs many times the corpus, so the positions are sampled by content:

  Round 0, offset 36.  Of the 36-byte prefixes inside a 100-byte string, the one
    with the least hash is its *anchor*.  Equal strings have equal anchors at
    equal places, so only anchors (about 3 % of positions) need ranks.  The
    strings that share an anchor position are one run of starts.
  Round 1, up to 136 bytes.  Spark sorts the runs by the pair (rank of the anchor,
    rank of the whole run's bytes).  A run with an earlier equal goes as a whole.
    A run whose anchor is unique is done.  First runs of a shared anchor go on.
  Round 2, at the threshold.  Each start of those runs is ranked by the pair
    (rank of 50 bytes, rank of the 50 that follow), within its anchor; all but the
    earliest start of a rank go.

Ranks are 64-bit fingerprints: equality is all that counts.  Anchors that many
runs share are told from their count inside a task and are dealt by (anchor,
run); a marker row keeps their meaning.  Round 2 splits anchors of many runs by
the start's rank.

Edge cases: null text is empty: 0 bytes, nothing removed.  Documents under
``length`` bytes stay whole.  Where doc_ids repeat or are null, rows count as
separate documents in the order (doc_id, text), nulls last, each with its own
result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import text as tx
from .scratch import Scratch

LENGTH = 100
ANCHOR = 36
HOT_IN_RUN = 8
SPLIT_AT = 4096
#: No more hot anchors than this are broadcast; beyond it, they are joined.
BROADCAST_ANCHORS = 50_000

U64 = np.uint64
_LOW = U64((1 << 24) - 1)
_PIECE = 1 << 22
_PLAIN, _HOT, _GONE, _MARK = 0, 1, 2, 3


def anchored_runs(run: tx.Run, length: int = LENGTH, k: int = ANCHOR):
    """(document, start, count, anchor hash, rank of the bytes) of each run of starts; starts count from the document."""
    w = length - k + 1
    parts = []
    data, n = run.data, len(run.data)
    if n < length:
        return None
    sums = tx.prefix_hashes(data, tx.BYTE)
    for lo in range(0, n - length + 1, _PIECE):
        hi = min(n, lo + _PIECE + length - 1)
        at = np.arange(lo, hi - k + 1)
        h = tx.span_hashes(sums, at, at + k)
        key = (h & ~_LOW) | np.arange(len(at), dtype=U64)
        m = len(key) - w + 1
        block = np.concatenate([key, np.full(-len(key) % w, ~U64(0))]).reshape(-1, w)
        ahead = np.minimum.accumulate(block, axis=1).ravel()
        back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = (np.minimum(back[:m], ahead[w - 1 : w - 1 + m]) & _LOW).astype(np.int64)
        valid = np.ones(m, bool)
        past = (run.offsets[1:, None] - np.arange(1, length)[None, :]).ravel() - lo
        valid[past[(past >= 0) & (past < m)]] = False
        start = np.flatnonzero(valid)
        if not len(start):
            continue
        anchor = anchor[start]
        new = np.ones(len(start), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(start)))
        anchor, start = anchor[first], start[first]
        parts.append((start + lo, count, h[anchor]))
    if not parts:
        return None
    start, count, anchor = (np.concatenate(x) for x in zip(*parts))
    doc = np.searchsorted(run.offsets, start, "right") - 1
    rank = tx.span_hashes(sums, start, start + count + length - 1)
    return doc, start - run.offsets[doc], count, anchor, rank


_RUN = pa.schema([("anchor", pa.int64()), ("rank", pa.int64()), ("doc", pa.int64()), ("at", pa.int64())])


def _sample(length: int, k: int):
    """Rows (anchor, rank, doc, at), at = start << 9 | state << 7 | count."""

    def run_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tx.worker_slot("suffix", lambda: None)
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for run in tx.runs(b.column(1)):
                found = anchored_runs(run, length, k)
                if found is None:
                    continue
                doc, start, count, anchor, rank = found
                doc = ids[run.first + doc]
                order = np.lexsort((start, doc, rank, anchor))
                doc, start, count, anchor, rank = (x[order] for x in (doc, start, count, anchor, rank))
                new_anchor = np.ones(len(doc), bool)
                new_anchor[1:] = anchor[1:] != anchor[:-1]
                first = new_anchor.copy()
                first[1:] |= rank[1:] != rank[:-1]
                which = np.cumsum(new_anchor) - 1
                ranks = np.bincount(which, weights=first)
                hot = ranks > HOT_IN_RUN
                state = np.where(first, np.where(hot[which], _HOT, _PLAIN), _GONE)
                at = (start << 9) | (state << 7) | count
                marks = anchor[new_anchor][hot]
                least = np.full(len(marks), np.iinfo(np.int64).min)
                yield pa.RecordBatch.from_arrays([
                    pa.array(tx.signed(np.concatenate([anchor, marks]))), pa.array(np.concatenate([tx.signed(rank), least])),
                    pa.array(np.concatenate([doc, least])), pa.array(np.concatenate([at, np.full(len(marks), _MARK << 7)]))], schema=_RUN)

    return run_over


_LIST = pa.schema([("doc", pa.int64()), ("at", pa.int64())])


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (anchor, rank, doc, at): (doc, start << 8 | open << 7 | count) of runs that go, or are open."""
    held = None  # the first row of the last rank, and whether its anchor has shown another rank
    shown = False

    def rows(doc, at, is_open):
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(((at >> 9) << 8) | (is_open.astype(np.int64) << 7) | (at & 127))], schema=_LIST)

    for b in batches:
        if not b.num_rows:
            continue
        x = [b.column(i).to_numpy() for i in range(4)]
        if held is not None:
            x = [np.concatenate([h, y]) for h, y in zip(held, x)]
        anchor, rank, doc, at = x
        state = (at >> 7) & 3
        gone = state == _GONE
        if held is not None:
            gone[0] = False
        yield rows(doc[gone], at[gone], np.zeros(gone.sum(), bool))
        keep = ~gone
        anchor, rank, doc, at, state = (y[keep] for y in (anchor, rank, doc, at, state))
        if not len(anchor):
            held = None
            continue
        new_anchor = np.ones(len(doc), bool)
        new_anchor[1:] = anchor[1:] != anchor[:-1]
        first = new_anchor.copy()
        first[1:] |= rank[1:] != rank[:-1]
        which = np.cumsum(new_anchor) - 1
        several = (np.bincount(which, weights=first) > 1) | (np.bincount(which, weights=state == _HOT) > 0)
        if held is not None and shown:
            several[0] = True
        late = ~first & (state != _MARK)
        yield rows(doc[late], at[late], np.zeros(late.sum(), bool))
        last = int(np.flatnonzero(first)[-1])
        done = first & several[which] & (state != _MARK)
        done[last] = False
        yield rows(doc[done], at[done], np.ones(done.sum(), bool))
        held, shown = [y[last : last + 1] for y in (anchor, rank, doc, at)], bool(several[which[last]])
    if held is not None and shown and (held[3][0] >> 7) & 3 != _MARK:
        yield rows(held[2], held[3], np.ones(1, bool))


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of [start, end), touching ones joined."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    first = np.flatnonzero(new)
    return start[first], end[np.append(first[1:], len(start)) - 1]


_PART_SQL = "kind int, row long, doc long, at long, anchor long, bytes binary, spans array<long>"
_PART = pa.schema([("kind", pa.int32()), ("row", pa.int64()), ("doc", pa.int64()), ("at", pa.int64()), ("anchor", pa.int64()), ("bytes", pa.binary()), ("spans", pa.list_(pa.int64()))])
_DONE, _OPEN, _CONTEXT = 0, 1, 2


def _finish(raw: np.ndarray, start: np.ndarray, end: np.ndarray, output: str) -> tuple[bytes, list[int]]:
    start, end = merge_spans(start, end)
    keep = np.ones(len(raw), bool)
    for a, b in zip(start.tolist(), end.tolist()):
        keep[a:b] = False
    kept = raw[keep].tobytes()
    if output == "text":
        kept = kept.decode(errors="ignore").encode()
    return (hashlib.sha256(kept).digest() if output == "sha256" else kept), np.column_stack([start, end]).ravel().tolist()


def _open_runs(length: int, k: int, output: str):
    """(doc, text, ats) -> finished documents, open documents, and the contexts of open runs."""

    def run_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ats = b.column(0).to_pylist(), b.column(2)
            for run in tx.runs(b.column(1)):
                rows, todo = [], []
                for i in range(len(run)):
                    r = run.first + i
                    raw, at = run.bytes_of(i), np.array(ats[r].as_py() or (), np.int64)
                    is_open = (at >> 7) & 1 == 1
                    gone = at[~is_open]
                    start, end = gone >> 8, (gone >> 8) + (gone & 127) + length - 1
                    if is_open.any():
                        todo.append((i, np.sort(at[is_open] >> 8)))
                        spans = np.column_stack(merge_spans(start, end)).ravel().tolist()
                        rows.append((_OPEN, len(raw), ids[r], None, None, raw.tobytes(), spans))
                    else:
                        kept, spans = _finish(raw, start, end, output)
                        rows.append((_DONE, len(raw), ids[r], None, None, kept, spans))
                if todo:
                    doc, start, count, anchor, _ = anchored_runs(run, length, k)
                    bounds = np.searchsorted(doc, [[i, i + 1] for i, _ in todo])
                    for (i, wanted), (lo, hi) in zip(todo, bounds.tolist()):
                        at = lo + np.searchsorted(start[lo:hi], wanted)
                        raw, own = run.bytes_of(i), ids[run.first + i]
                        for s, c, a in zip(start[at].tolist(), count[at].tolist(), tx.signed(anchor[at]).tolist()):
                            rows.append((_CONTEXT, None, own, s << 7 | c, a, raw[s : s + c + length - 1].tobytes(), None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PART)], schema=_PART)

    return run_over


def _starts(length: int):
    """Over contexts sorted by (anchor, part): the starts that have an earlier equal, as (doc, start << 7 | count)."""
    half = length // 2

    def settle(b: pa.RecordBatch) -> pa.RecordBatch:
        anchor, doc, at, part, parts = (b.column(i).to_numpy() for i in (0, 1, 2, 4, 5))
        run = next(tx.runs(b.column(3), 1 << 62, b.num_rows))
        start, count = at >> 7, at & 127
        sums = tx.prefix_hashes(run.data, tx.BYTE)
        owner = np.repeat(np.arange(len(doc)), count)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        x = run.offsets[owner] + step
        left, right = tx.span_hashes(sums, x, x + half), tx.span_hashes(sums, x + half, x + length)
        mine = (left % parts[owner].astype(U64)).astype(np.int64) == part[owner]
        owner, step, left, right = owner[mine], step[mine], left[mine], right[mine]
        a, d, s = anchor[owner], doc[owner], start[owner] + step
        order = np.lexsort((s, d, right, left, a))
        late = np.zeros(len(order), bool)
        o, p = order[1:], order[:-1]
        late[o] = (a[o] == a[p]) & (left[o] == left[p]) & (right[o] == right[p])
        d, s = d[late], s[late]
        order = np.lexsort((s, d))
        d, s = d[order], s[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1] + 1)
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(d)))
        return pa.RecordBatch.from_arrays([pa.array(d[first]), pa.array(s[first]), pa.array(n)], names=["doc", "start", "count"])

    def run_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            a, p = b.column(0).to_numpy(), b.column(4).to_numpy()
            cut = np.flatnonzero((a[1:] != a[:-1]) | (p[1:] != p[:-1])) + 1
            if held:
                last = held[-1]
                if last.column(0)[last.num_rows - 1].as_py() != a[0] or last.column(4)[last.num_rows - 1].as_py() != p[0]:
                    cut = np.append(0, cut)
            lo = 0
            for hi in cut.tolist():
                if size + hi - lo >= 4000:  # whole anchors, at least so many rows of them
                    held.append(b.slice(lo, hi - lo))
                    yield settle(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held, size, lo = [], 0, hi
            held.append(b.slice(lo))
            size += b.num_rows - lo
        held = [x for x in held if x.num_rows]
        if held:
            yield settle(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run_over


def _close(length: int, output: str):
    def run_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes, spans, more = (b.column(i).to_pylist() for i in (0, 1, 3, 4))
            rows = []
            for run in tx.runs(b.column(2)):
                for i in range(len(run)):
                    r = run.first + i
                    old = np.array(spans[r] or (), np.int64).reshape(-1, 2)
                    new = np.array([(m["start"], m["start"] + m["count"] + length - 1) for m in more[r] or ()], np.int64).reshape(-1, 2)
                    both = np.concatenate([old, new])
                    kept, out = _finish(run.bytes_of(i), both[:, 0], both[:, 1], output)
                    rows.append((ids[r], sizes[r], kept, out))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())))], names=["doc", "n_bytes", "kept", "spans"])

    return run_over


def _with_keys(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """(doc, text), doc a unique key in the documents' order; and (doc, doc_id, other columns) where there is more to know."""
    twice = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if twice.isEmpty():
        rest = docs.drop("text").withColumn("doc", F.col("doc_id")) if len(docs.columns) > 2 else None
        return docs.select(F.col("doc_id").alias("doc"), "text"), rest
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()]
    keyed = docs.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    keyed = scratch.stage(keyed.select(F.monotonically_increasing_id().alias("doc"), "*"), "keyed")
    return keyed.select("doc", "text"), keyed.drop("text")


def substring_dedup(spark: SparkSession, docs: DataFrame, length: int = LENGTH, output: str = "bytes", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, spans, kept), a row for each row of ``docs``.

    spans: array<struct<start, end>> of the maximal removed byte runs; kept: the
    remaining bytes, or by ``output`` their "sha256" (texts are then not kept) or "text",
    without characters of which a part has gone.  Columns named in ``carry`` come along as in_<name>.
    """
    if not 80 <= length <= 120:
        raise ValueError("length must be from 80 to 120 bytes")
    k = ANCHOR
    scratch = Scratch(spark, "suffix")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carried")] if carry else []))
    keyed, names = _with_keys(docs, scratch)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    runs = keyed.mapInArrow(_sample(length, k), "anchor long, rank long, doc long, at long")
    state = F.shiftrightunsigned("at", 7).bitwiseAND(3)
    home = F.when(state == _HOT, F.xxhash64("anchor", "rank")).when(state == _GONE, F.xxhash64("doc", "at")).otherwise(F.xxhash64("anchor"))
    judged = runs.repartition(parts, home).sortWithinPartitions("anchor", "rank", "doc", "at").mapInArrow(_judge, "doc long, at long")
    lists = judged.groupBy("doc").agg(F.collect_list("at").alias("ats"))
    split = keyed.join(lists, "doc", "left").select("doc", "text", "ats").mapInArrow(_open_runs(length, k, output), _PART_SQL)
    split = scratch.stage(split, "split")

    contexts = split.where(F.col("kind") == _CONTEXT).select("anchor", "doc", "at", "bytes")
    hot = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SPLIT_AT).select("anchor", F.ceil(F.col("n") / SPLIT_AT).alias("parts"))
    hot = scratch.stage(hot, "hot")
    n_hot = hot.count()
    if n_hot:
        contexts = contexts.join(F.broadcast(hot) if n_hot <= BROADCAST_ANCHORS else hot, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    else:
        contexts = contexts.withColumn("parts", F.lit(1).cast("long"))
    contexts = contexts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("anchor", "doc", "at", "bytes", "part", "parts")
    starts = contexts.repartition(parts, "anchor", "part").sortWithinPartitions("anchor", "part").mapInArrow(_starts(length), "doc long, start long, count long")
    more = starts.groupBy("doc").agg(F.collect_list(F.struct("start", "count")).alias("more"))
    schema = "doc long, n_bytes long, kept binary, spans array<long>"
    closed = split.where(F.col("kind") == _OPEN).select("doc", "row", "bytes", "spans").join(more, "doc", "left").select("doc", "row", "bytes", "spans", "more").mapInArrow(_close(length, output), schema)
    done = split.where(F.col("kind") == _DONE).select("doc", F.col("row").alias("n_bytes"), F.col("bytes").alias("kept"), "spans")
    out = done.unionByName(closed)
    pairs = F.transform(F.sequence(F.lit(0), (F.size("spans") / 2).cast("int") - 1), lambda i: F.struct(F.get("spans", 2 * i).alias("start"), F.get("spans", 2 * i + 1).alias("end")))
    out = out.withColumn("spans", F.when(F.size("spans") > 0, pairs).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>")))
    if names is None:
        return out.select(F.col("doc").alias("doc_id"), "n_bytes", "spans", "kept")
    return out.join(names, "doc").select("doc_id", "n_bytes", "spans", "kept", *(F.col("carried")[c].alias(f"in_{c}") for c in carry))
