"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Two documents link when their sets of distinct 5-word shingles have a Jaccard
similarity of at least ``percent`` / 100.  All links count; no candidate is
capped or sampled.

Method
  1. One scan gives every document's set size and set fingerprint, and a count
     sketch of the shingles (``SKETCH`` counters whatever the input, so it may be
     broadcast).  Copies share a fingerprint and are one *node* from here on.
  2. Shingles have one global order: sketched frequency class, then hash.  With
     similarity t, documents x and y that link share at least l shingles among
     the first |x| - ceil(t|x|) + l of x and the like of y, for any l.  Each
     document picks its l by cost: a longer prefix makes more index rows (the
     sum of its shingles' frequencies) but asks for more matches, which leaves
     fewer pairs to verify.  A pair must match min(l_x, l_y) times.
  3. The prefix rows (shingle, node) are grouped by shingle.  A shingle's nodes
     are all listed under its leader, the node with the smallest id, so nodes
     that share many shingles meet in few leader groups instead of in a pair row
     for each shingle.  Any linking pair shares a prefix shingle, hence a group.
  4. Large leader groups are cut into blocks (by nodes and by shingles), one
     task for each pair of blocks.  A pair that shares several groups belongs to the
     smallest common leader, among the groups that hold their share of matches.
     Multi-match counts come first; what passes is
     verified on whole sets.  Only a spanning forest and link counts are emitted.
  5. Components by star rounds over the forests; copies join by fingerprint.

Edge cases: a document without words (null, empty, separators) has size 0 and
is its own component.  Fewer than five words make one shingle.  Repeated rows
of one doc_id are copies of each other: each comes out.  A null doc_id comes
out with the smallest non-null id of its component, or null.  Columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import text as tx
from .graph import components, forest
from .scratch import Scratch

SKETCH_BITS = 18
_BLOCKS = 64
BLOCK_NODES = 256
BLOCK_SHINGLES = 400_000
#: Every document asks for at least one match more for each so many shingles.
MATCH_EVERY = 12

U64 = np.uint64
_STAT = "doc_id long, n_shingles long, node long, block int, counts binary"
_STAT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("block", pa.int32()), ("counts", pa.binary())])


def fingerprint(s: np.ndarray) -> int:
    x = tx.mix(s.sum(dtype=U64, keepdims=True) * U64(0x9FB21C651E98DF25) + np.bitwise_xor.reduce(s, keepdims=True) + U64(len(s)))
    return int(x.view(np.int64)[0])


def _slot(s: np.ndarray) -> np.ndarray:
    return (s >> U64(64 - SKETCH_BITS)).astype(np.int64)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tx.worker_slot("jaccard", lambda: None)
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    for b in batches:
        sizes, nodes = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
        for run in tx.runs(b.column(1)):
            held = []
            for i, s in enumerate(tx.shingle_sets(run), run.first):
                if len(s):
                    sizes[i], nodes[i] = len(s), fingerprint(s)
                    held.append(s)
            if held:
                counts += np.bincount(_slot(np.concatenate(held)), minlength=1 << SKETCH_BITS).astype(np.uint32)
        none = pa.nulls(b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(sizes), pa.array(nodes), none.cast(pa.int32()), none.cast(pa.binary())], schema=_STAT_ARROW)
    if counts.any():
        parts = counts.reshape(_BLOCKS, -1)
        none = pa.nulls(_BLOCKS, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array(np.arange(_BLOCKS, dtype=np.int32)), pa.array([x.tobytes() for x in parts], pa.binary())], schema=_STAT_ARROW)


def _add_blocks(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    total = np.zeros((1 << SKETCH_BITS) // _BLOCKS, np.uint64)
    kind = np.uint32 if len(key) > 1 else np.uint64  # of tasks, or of groups of them
    for x in table.column("counts").to_pylist():
        total += np.frombuffer(x, kind)
    return pa.table({"block": pa.array([key[-1].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def _needed(n, percent: int):
    """Smallest intersection that any link of a set of n asks for: ceil(percent * n / 100)."""
    return -(-(n * percent) // 100)


def _least_match(n: int) -> int:
    return 1 + n // MATCH_EVERY


class Order:
    """The global order of shingles and each document's prefix, from the sketch."""

    def __init__(self, sketch: np.ndarray, percent: int) -> None:
        self.percent = percent
        x = sketch.astype(np.float64)
        usual = np.median(x) if len(x) else 0.0
        self.extra = np.maximum(x - usual, 0.0)
        self.kind = np.floor(np.log2(1.0 + self.extra) / 2).astype(np.uint8)
        self.kind[self.extra <= 8 * np.sqrt(usual + 1)] = 0

    def arrange(self, s: np.ndarray) -> np.ndarray:
        """A sorted set in global order."""
        kind = self.kind[_slot(s)]
        return s if not kind.any() else s[np.argsort(kind, kind="stable")]

    def prefix(self, s: np.ndarray) -> tuple[int, int]:
        """(prefix length, matches asked for) of a set in global order."""
        n = len(s)
        need = _needed(n, self.percent)
        low = min(_least_match(n), need)
        steps = [l for l in (low, low + 1, low + 2, low + 4, low + 8, low + 16, low + 32) if l <= need]
        if len(steps) == 1:
            return n - need + low, low
        cost = np.cumsum(1.0 + self.extra[_slot(s[: n - need + steps[-1]])])
        # index rows read, plus the pairs that can match l times (Markov), each costing about a set to verify
        each = [cost[n - need + l - 1] * (1.0 + 0.25 * n / l / 16) for l in steps]
        # a longer prefix must pay for its own rows
        best = steps[int(np.argmin([c + 4.0 * (l - low) for c, l in zip(each, steps)]))]
        return n - need + best, best


def _prefix_rows(order_of):
    def run_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = order_of.value, set()
        for b in batches:
            for run in tx.runs(b.column(0)):
                tokens, nodes, sizes = [], [], []
                for s in tx.shingle_sets(run):
                    if not len(s) or (f := fingerprint(s)) in seen:
                        continue
                    if len(seen) < 1_000_000:  # only spares repeated rows
                        seen.add(f)
                    p, _ = order.prefix(s := order.arrange(s))
                    tokens.append(s[:p])
                    nodes.append(f)
                    sizes.append(p)
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(tx.signed(np.concatenate(tokens))), pa.array(np.repeat(np.array(nodes, np.int64), sizes))], names=["token", "node"])

    return run_over


_GROUP = pa.schema([("leader", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("side", pa.int32()), ("node", pa.int64()), ("copies", pa.int64()), ("leaders", pa.list_(pa.int64())), ("text", pa.binary())])
_GROUP_SQL = "leader long, i int, j int, side int, node long, copies long, leaders array<long>, text binary"


def _group_rows():
    """(text, node, copies, groups) -> a row for each block pair that the node takes part in.

    The text travels and not the set: it is shorter, and packs better.
    """

    def run_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, copies, groups = (b.column(k).to_pylist() for k in (1, 2, 3))
            for run in tx.runs(b.column(0)):
                rows, held = [], 0
                for i, s in enumerate(tx.shingle_sets(run), run.first):
                    if not len(s) or fingerprint(s) != node[i]:  # another row of a repeated doc_id
                        continue
                    raw = run.bytes_of(i - run.first).tobytes()
                    leaders = sorted({g["leader"] for g in groups[i]})
                    for g in groups[i]:
                        mine = (node[i] & 0x7FFFFFFF) % g["blocks"]
                        for other in range(g["blocks"]):
                            rows.append((g["leader"], min(mine, other), max(mine, other), mine, node[i], copies[i], leaders, raw))
                            held += len(raw)
                            if held > 8 << 20:
                                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _GROUP)], schema=_GROUP)
                                rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _GROUP)], schema=_GROUP)

    return run_over


def _shared(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Intersection sizes of all sets on the left with all on the right (None: the same list)."""
    a = len(left)
    every = left if right is None else left + right
    lens = np.array([len(s) for s in every])
    tokens = np.concatenate(every)
    owner = np.repeat(np.arange(len(every)), lens)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    new = np.ones(len(tokens), bool)
    new[1:] = tokens[1:] != tokens[:-1]
    index = np.cumsum(new) - 1
    often = np.bincount(index) > 1
    keep = often[index]
    owner, index = owner[keep], (np.cumsum(often) - 1)[index[keep]]
    out = np.zeros((a, len(every) - (0 if right is None else a)), np.float32)
    step = max(64, (1 << 22) // max(1, len(every)))
    for lo in range(0, int(often.sum()), step):
        x, y = np.searchsorted(index, [lo, lo + step])
        m = np.zeros((len(every), min(step, int(often.sum()) - lo)), np.float32)
        m[owner[x:y], index[x:y] - lo] = 1
        out += m[:a] @ (m.T if right is None else m[a:].T)
    return out


def _compare(rows: list[dict], percent: int) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """Forest edges and link counts of one block pair."""
    same = rows[0]["i"] == rows[0]["j"]
    left = [r for r in rows if r["side"] == r["i"]]
    right = left if same else [r for r in rows if r["side"] != r["i"]]
    if not left or not right or (same and len(left) < 2):
        return [], {}
    leader = rows[0]["leader"]

    def column(side, key):
        return np.array([r[key] for r in side])

    n, m = column(left, "n"), column(right, "n")
    possible = (n[:, None] * 100 >= percent * m[None, :]) & (m[None, :] * 100 >= percent * n[:, None])
    if same:
        possible &= np.tri(len(left), k=-1, dtype=bool)
    if not possible.any():
        return [], {}
    heads = _shared([r["set"][: r["prefix"]] for r in left], None if same else [r["set"][: r["prefix"]] for r in right])
    possible &= heads >= np.minimum(column(left, "matches")[:, None], column(right, "matches")[None, :])
    x, y = np.nonzero(possible)
    own = [k for k, (p, q) in enumerate(zip(x.tolist(), y.tolist())) if _first_common(left[p]["leaders"], right[q]["leaders"]) == leader]
    x, y = x[own], y[own]
    if not len(x):
        return [], {}
    if len(x) > 64:
        both = _shared([r["set"] for r in left], None if same else [r["set"] for r in right])[x, y]
    else:
        both = np.array([len(np.intersect1d(left[p]["set"], right[q]["set"], assume_unique=True)) for p, q in zip(x, y)], np.float64)
    union = n[x] + m[y] - both
    links = 100 * both >= percent * union
    edges, count = [], {}
    for p, q in zip(x[links].tolist(), y[links].tolist()):
        a, b = left[p], right[q]
        edges.append((a["node"], b["node"]))
        count[a["node"]] = count.get(a["node"], 0) + b["copies"]
        count[b["node"]] = count.get(b["node"], 0) + a["copies"]
    return edges, count


def _first_common(a: list[int], b: list[int]) -> int | None:
    """Smallest common element of two sorted lists."""
    if a[0] == b[0]:
        return a[0]
    other = set(b)
    return next((x for x in a if x in other), None)


def _verify(percent: int, order_of):

    def run_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, nodes = [], None, set()
        out: list[tuple] = []

        def close() -> None:
            if len(held) > 1:
                edges, count = _compare(held, percent)
                out.extend((u, v, None) for u, v in forest(edges))
                out.extend((u, None, c) for u, c in count.items())

        def batch() -> pa.RecordBatch:
            cols = zip(*out) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["u", "v", "links"])

        order = order_of.value
        for b in batches:
            rest = b.drop_columns(["text"]).to_pylist()
            for run in tx.runs(b.column(b.schema.get_field_index("text"))):
                for r, s in zip(rest[run.first : run.last], tx.shingle_sets(run)):
                    k = (r["leader"], r["i"], r["j"])
                    if k != key:
                        close()
                        held, key, nodes = [], k, set()
                    if r["node"] in nodes:  # rows repeated in the table
                        continue
                    nodes.add(r["node"])
                    r["set"] = order.arrange(s)
                    r["n"] = len(s)
                    r["prefix"], r["matches"] = order.prefix(r["set"])
                    held.append(r)
            if len(out) > 50_000:
                yield batch()
                out.clear()
        close()
        yield batch()

    return run_over


def jaccard_components(spark: SparkSession, docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links), a row for each row of ``docs``.

    n_links: other rows linked directly, copies included.
    """
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stat = scratch.stage(docs.mapInArrow(_scan, _STAT), "scan")
    # two levels, so that no group has a row of every scan task
    some = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(_BLOCKS))
    blocks = stat.where("block is not null").select(some.alias("some"), "block", "counts").groupBy("some", "block").applyInArrow(_add_blocks, "block int, counts binary")
    blocks = blocks.groupBy("block").applyInArrow(_add_blocks, "block int, counts binary").collect()
    sketch = np.zeros(1 << SKETCH_BITS, np.uint64)
    for r in blocks:
        sketch.reshape(_BLOCKS, -1)[r["block"]] = np.frombuffer(r["counts"], np.uint64)
    order = spark.sparkContext.broadcast(Order(sketch, percent))
    members = stat.where("block is null").select("doc_id", "n_shingles", "node")

    rows = docs.select("text").mapInArrow(_prefix_rows(order), "token long, node long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "token")
    lead = rows.groupBy("token").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last").select("token", "leader")
    pairs = rows.join(lead, "token").groupBy("node", "leader").agg(F.count(F.lit(1)).alias("tokens"))
    pairs = scratch.stage(pairs, "pairs")

    classes = members.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"))
    # a node whose shared prefix shingles are fewer than any partner would ask for has no links
    least = F.lit(1) + F.floor(F.ceil(F.col("n") * percent / 100) / MATCH_EVERY)
    least = F.least(least, F.ceil(F.col("n") * percent / 100))
    able = pairs.groupBy("node").agg(F.sum("tokens").alias("all_tokens"), F.count(F.lit(1)).alias("groups")).join(classes, "node").withColumn("least", least).where("all_tokens >= least")
    # the matches of a linking pair spread over at most so many groups: one of them holds its share on both sides
    grouped = pairs.join(able, "node").where("tokens * groups >= least").select("node", "leader", "first_id", "copies", "n")
    size = grouped.groupBy("leader").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("shingles")).where("nodes > 1")
    size = size.select("leader", F.greatest(F.ceil(F.col("nodes") / BLOCK_NODES), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    wanted = grouped.join(size, "leader").groupBy("node", "first_id", "copies").agg(F.collect_list(F.struct("leader", "blocks")).alias("groups"))
    wanted = scratch.stage(wanted.withColumnRenamed("first_id", "doc_id"), "wanted")

    # a repeated doc_id may carry another text; its node tells which row is meant
    # texts move by one shuffle at every size: the wanted ids grow with the input
    members_of = docs.hint("shuffle_merge").join(wanted, "doc_id").select("text", "node", "copies", "groups")
    members_of = members_of.mapInArrow(_group_rows(), _GROUP_SQL)
    found = members_of.repartition(parts, "leader", "i", "j").sortWithinPartitions("leader", "i", "j").mapInArrow(_verify(percent, order), "u long, v long, links long")
    found = scratch.stage(found, "links")
    labels = components(found.where("v is not null").select("u", "v"), scratch)
    links = found.where("links is not null").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))

    classes = classes.join(labels.withColumnRenamed("id", "node"), "node", "left").join(links, "node", "left")
    classes = classes.withColumn("component", F.coalesce("component", "node"))
    least_id = classes.groupBy("component").agg(F.min("first_id").alias("component_id"))
    classes = classes.join(least_id, "component").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return members.join(classes, (members["node"] == classes["node"]) & (members["n_shingles"] > 0), "left").select(
        members["doc_id"], members["n_shingles"], F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
