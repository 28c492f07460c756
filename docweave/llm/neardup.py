"""Embedding near-duplicates by sorted projection passes.

Vectors of one (non-null) label link when their cosine, in double precision, is at least
``threshold``.

  1. Vectors with equal components are one node, with its number of copies.
  2. Each of ``passes`` passes hashes the nodes and sorts those of all labels by (label,
     hashes) in one range-partitioned sort.  Even passes concatenate the signs of 48 random
     projections of the vector less its label's mean, which cut a label evenly
     however close its vectors lie to each other; odd passes concatenate 12 projections rounded to
     cells of twice the threshold's distance, which also cut each of several close clouds.
     Close vectors share long prefixes, so each node is compared with at least the
     ``window`` nodes that follow it; rows at the edges of sorted partitions are compared in
     a second, small step.  Verified pairs keep a spanning forest, and the
     passes' forests are united to components.
  3. Recall is measured: ``sample`` nodes (those of least hash) are compared with all, in
     blocks.  While less than ``recall`` of their links lie inside components, more passes
     follow with a window several times as wide.  The sample's own links are united too.  It
     only tells how long to sort; no link rests on it.
  4. An exact check follows: the nodes of a label are dealt into blocks of ``BLOCK_BYTES``, and every
     pair of blocks is compared, a task each.  Links between different components unite
     them, so none is lost; this work is quadratic in a label's distinct vectors.
  5. Inside a component every pair is compared, in blocks of nodes, one task for
     each pair of blocks; only counts leave a block.  So a node has all its links
     in its component, however many there are and wherever the sort put them: the
     window bounds the search for components, not the partners.

Edge cases: vectors that are null, empty, zero or hold a null or a non-finite
component, and those without a label, link with nothing.  Vectors of different
lengths never link.  Repeated rows are copies of each other.  A null vec_id comes
out with the component's smallest non-null id.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .graph import components, forest
from .scratch import Scratch

BITS, CELLS = 48, 12
BLOCK = 256
_CHUNK = 2048
#: Vectors in a block of the exact check.
BLOCK_BYTES = 8 << 20
#: Label means are broadcast up to so many numbers, and joined beyond.
BROADCAST_MEANS = 1 << 20

_SIGN_PLACES = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
_CELL_VALUES = 1 << BITS // CELLS
_CELL_PLACES = _CELL_VALUES ** np.arange(CELLS - 1, -1, -1, dtype=np.int64)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, node, vector): unit vectors as doubles; node is null where nothing may link."""
    for b in batches:
        labels, column = b.column(1).to_pylist(), b.column(2)
        nodes, vectors = [], []
        for i in range(b.num_rows):
            node = vector = None
            if labels[i] is not None and column[i].is_valid:
                values = column[i].values
                if len(values) and not values.null_count:
                    x = values.to_numpy(zero_copy_only=False).astype(np.float64)
                    norm = np.sqrt((x * x).sum()) if np.isfinite(x).all() else 0.0
                    if not np.isfinite(norm):  # squares overflow
                        x = x / np.abs(x).max()
                        norm = np.sqrt((x * x).sum())
                    if norm == 0.0 and np.isfinite(x).all() and x.any():  # squares underflow
                        x = x / np.abs(x).max()
                        norm = np.sqrt((x * x).sum())
                    if norm > 0.0:
                        vector = (x / norm).tobytes()
                        # -0.0 and 0.0 are equal components
                        raw = (x + 0.0).tobytes() + str(labels[i]).encode()
                        node = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)
            nodes.append(node)
            vectors.append(vector)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.string()), pa.array(nodes, pa.int64()), pa.array(vectors, pa.binary())], names=["vec_id", "label", "node", "vector"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, dim, n, sums) of the unit vectors of some rows."""
    held: dict[tuple, list] = {}

    def out() -> pa.RecordBatch:
        label, dim = zip(*held) if held else ((), ())
        n, sums = zip(*held.values()) if held else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(label, pa.string()), pa.array(dim, pa.int32()), pa.array(n, pa.int64()), pa.array([x.tolist() for x in sums], pa.list_(pa.float64()))], names=["label", "dim", "n", "sums"])

    for b in batches:
        for label, vector in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x = np.frombuffer(vector, np.float64)
            seen = held.setdefault((label, len(x)), [0, np.zeros(len(x))])
            seen[0] += 1
            seen[1] += x
            if len(held) >= 1000:
                yield out()
                held.clear()
    yield out()


def _hashes(x: np.ndarray, mean: np.ndarray, one_pass: int, width: float) -> np.ndarray:
    """The concatenated hashes of each row, as one number."""
    rng = np.random.default_rng([20240501, x.shape[1], one_pass])
    if one_pass % 2 == 0:
        return ((x - mean) @ rng.standard_normal((x.shape[1], BITS)) > 0) @ _SIGN_PLACES
    cell = np.floor((x @ rng.standard_normal((x.shape[1], CELLS)) + rng.uniform(0, width, CELLS)) / width)
    return np.clip(cell + _CELL_VALUES // 2, 0, _CELL_VALUES - 1).astype(np.int64) @ _CELL_PLACES


def _keys(first: int, passes: int, threshold: float):
    """Over (node, label, vector, mean): a row for each pass."""
    width = 2.0 * np.sqrt(max(2.0 - 2.0 * threshold, 1e-6))

    def run_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, _CHUNK):
                part = b.slice(lo, _CHUNK)
                vectors = part.column(2).to_pylist()
                sizes = np.array([len(v) for v in vectors])
                for size in np.unique(sizes):
                    own = np.flatnonzero(sizes == size)
                    x = np.frombuffer(b"".join(vectors[i] for i in own), np.float64).reshape(len(own), -1)
                    rows = part.take(pa.array(own))
                    mean = np.array(rows.column(3).flatten(), np.float64).reshape(x.shape)
                    for p in range(first, first + passes):
                        key = _hashes(x, mean, p, width)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), p, np.int32)), rows.column(1), pa.array(np.full(len(own), x.shape[1], np.int32)), pa.array(key), rows.column(0), rows.column(2)], names=["pass", "label", "dim", "key", "node", "vector"])

    return run_over


def _near(node: np.ndarray, x: np.ndarray, window: int, threshold: float) -> list[tuple[int, int]]:
    """A spanning forest of the links of each row with the rows after it, ``window`` of them or more."""
    out: list[tuple[int, int]] = []
    for lo in range(0, len(node) - 1, BLOCK):
        hi = min(lo + BLOCK, len(node))
        right = min(hi + window, len(node))
        hit = x[lo:hi] @ x[lo:right].T >= threshold
        hit &= ~np.tri(hi - lo, right - lo, dtype=bool)
        i, j = np.nonzero(hit)
        if len(i) <= 8 * BLOCK:
            out += zip(node[lo + i].tolist(), node[lo + j].tolist())
            continue
        # very many links: rows are joined to groups a row at a time
        group = np.arange(right - lo)
        for r in np.unique(i).tolist():
            mine = np.unique(np.append(group[np.flatnonzero(hit[r])], group[r]))
            if len(mine) > 1:
                group[np.isin(group, mine[1:])] = mine[0]
        moved = np.flatnonzero(group != np.arange(right - lo))
        out += zip(node[lo + moved].tolist(), node[lo + group[moved]].tolist())
    return forest(out)


_FOUND_SQL = "u long, v long, edge int, place int, pass int, label string, dim int, node long, vector binary"
_FOUND = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("edge", pa.int32()), ("place", pa.int32()), ("pass", pa.int32()), ("label", pa.string()), ("dim", pa.int32()), ("node", pa.int64()), ("vector", pa.binary())])


def _links(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*rows) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), *(pa.nulls(len(u), f.type) for f in list(_FOUND)[2:])], schema=_FOUND)


def _edge_rows(rows: list[dict], edge: int, first: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"edge": edge, "place": first + i, **{k: r[k] for k in ("pass", "label", "dim", "node", "vector")}} for i, r in enumerate(rows)], schema=_FOUND)


def _rows_near(rows: list[dict], window: int, threshold: float) -> list[tuple[int, int]]:
    """Links among rows in sorted order; runs of one (pass, label, dim) at a time."""
    out, lo = [], 0
    keys = [(r["pass"], r["label"], r["dim"]) for r in rows]
    for hi in range(1, len(rows) + 1):
        if hi == len(rows) or keys[hi] != keys[lo]:
            if hi - lo > 1:
                x = np.frombuffer(b"".join(r["vector"] for r in rows[lo:hi]), np.float64).reshape(hi - lo, -1)
                out += _near(np.array([r["node"] for r in rows[lo:hi]]), x, window, threshold)
            lo = hi
    return out


def _windows(window: int, threshold: float):
    """Over one sorted partition: forests of its links, and its first and last rows for the neighbours."""

    def run_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        tail: list[dict] = []
        rows: list[dict] = []
        first = True

        def near() -> Iterator[pa.RecordBatch]:
            nonlocal tail, rows, first
            if first:  # where the partition before ends
                yield _edge_rows(rows[:window], pid - 1, window)
                first = False
            yield _links(_rows_near(tail + rows, window, threshold))
            tail, rows = (tail + rows)[-window:], []

        for b in batches:
            for lo in range(0, b.num_rows, _CHUNK):
                rows += b.slice(lo, _CHUNK).to_pylist()
                if len(rows) >= window:  # so that the rows before are not compared over and over
                    yield from near()
        yield from near()
        yield _edge_rows(tail, pid, 0)

    return run_over


def _blocks(threshold: float):
    """Over rows sorted by (component, i, j): (node, links) of each pair of blocks."""

    def count(rows: list[dict]) -> list[tuple[int, int]]:
        same = rows[0]["i"] == rows[0]["j"]
        left = [r for r in rows if r["side"] == r["i"]]
        right = left if same else [r for r in rows if r["side"] != r["i"]]
        if not left or not right:
            return []
        x, y = (np.frombuffer(b"".join(r["vector"] for r in s), np.float64).reshape(len(s), -1) for s in (left, right))
        link = x @ y.T >= threshold
        if same:
            np.fill_diagonal(link, False)
        copies = [np.array([r["copies"] for r in s]) for s in (left, right)]
        out = list(zip((r["node"] for r in left), (link @ copies[1]).tolist()))
        if not same:
            out += zip((r["node"] for r in right), (link.T @ copies[0]).tolist())
        return [x for x in out if x[1]]

    def run_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, out = [], None, []
        for b in batches:
            for lo in range(0, b.num_rows, _CHUNK):
                for r in b.slice(lo, _CHUNK).to_pylist():
                    k = (r["component"], r["i"], r["j"])
                    if k != key:
                        out += count(held) if held else []
                        held, key = [], k
                    held.append(r)
        out += count(held) if held else []
        node, links = zip(*out) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(links, pa.int64())], names=["node", "links"])

    return run_over


def _between(threshold: float):
    """Over rows sorted by (label, dim, i, j): forests of the links of each pair of blocks that lie between components."""

    def links(rows: list[pa.RecordBatch]) -> list[tuple[int, int]]:
        t = pa.Table.from_batches(rows)
        node, component, side, i, j = (t.column(c).to_numpy() for c in ("node", "component", "side", "i", "j"))
        x = np.frombuffer(b"".join(t.column("vector").to_pylist()), np.float64).reshape(len(node), -1)
        left, right = np.flatnonzero(side == i[0]), np.flatnonzero(side == j[0])
        right_x, out = x[right], []
        for lo in range(0, len(left), BLOCK):
            own = left[lo : lo + BLOCK]
            hit = x[own] @ right_x.T >= threshold
            a, b = np.nonzero(hit)
            a, b = own[a], right[b]
            apart = component[a] != component[b]
            # one link of two components is as good as all of them
            out += set(zip(component[a[apart]].tolist(), component[b[apart]].tolist()))
        return forest(out)

    def run_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        found: list[tuple[int, int]] = []
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in ("label", "dim", "i", "j"))))
            lo = 0
            for hi in range(1, len(keys) + 1):
                if hi == len(keys) or keys[hi] != keys[lo]:
                    if keys[lo] != key:
                        found += links(held) if held else []
                        held, key = [], keys[lo]
                    held.append(b.slice(lo, hi - lo))
                    lo = hi
        found += links(held) if held else []
        u, v = zip(*found) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run_over


def _check(nodes: DataFrame, scratch: Scratch, parts: int, threshold: float) -> DataFrame:
    """(u, v): links between the components of (node, label, vector, component), from all pairs of a label."""
    n = nodes.withColumn("dim", (F.octet_length("vector") / 8).cast("int"))
    blocks = n.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) * F.col("dim") * 8 / BLOCK_BYTES).cast("int").alias("blocks"))
    split = n.join(blocks, ["label", "dim"]).withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("label", "dim", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "node", "component", "vector")
    keys = ["label", "dim", "i", "j"]
    return scratch.stage(split.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(_between(threshold), "u long, v long"), "between")


def _measure(sample, threshold: float):
    """Over (node, label, vector, component): links with the sampled nodes, how many lie inside components, and those that do not."""

    def run_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_group = sample.value
        links = inside = 0
        for b in batches:
            for lo in range(0, b.num_rows, _CHUNK):
                part = b.slice(lo, _CHUNK).to_pydict()
                groups: dict[tuple, list[int]] = {}
                for i, (label, vector) in enumerate(zip(part["label"], part["vector"])):
                    groups.setdefault((label, len(vector)), []).append(i)
                missed: list[tuple[int, int]] = []
                for key, rows in groups.items():
                    if key not in by_group:
                        continue
                    nodes, components_, y = by_group[key]
                    x = np.frombuffer(b"".join(part["vector"][i] for i in rows), np.float64).reshape(len(rows), -1)
                    own, component = np.array([part["node"][i] for i in rows]), np.array([part["component"][i] for i in rows])
                    hit = (x @ y.T >= threshold) & (own[:, None] != nodes[None, :])
                    same = component[:, None] == components_[None, :]
                    links += int(hit.sum())
                    inside += int((hit & same).sum())
                    i, j = np.nonzero(hit & ~same)
                    missed += zip(own[i].tolist(), nodes[j].tolist())
                u, v = zip(*e) if (e := forest(missed)) else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.nulls(len(u), pa.int64()), pa.nulls(len(u), pa.int64())], names=["u", "v", "links", "inside"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([links]), pa.array([inside])], names=["u", "v", "links", "inside"])

    return run_over


def _with_means(nodes: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """``nodes`` with its label's mean vector, and the size of the largest label."""
    sums = nodes.select("label", "vector").mapInArrow(_sums, "label string, dim int, n long, sums array<double>")
    each = sums.select("label", "dim", "n", F.posexplode("sums").alias("at", "x")).groupBy("label", "dim", "at").agg((F.sum("x") / F.sum("n")).alias("x"), F.sum("n").alias("n"))
    means = each.groupBy("label", "dim").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "x"))).alias("mean")).select("label", "dim", "n", F.col("mean.x").alias("mean"))
    means = scratch.stage(means, "means")
    size = means.agg(F.sum("dim"), F.max("n")).head()
    if (size[0] or 0) <= BROADCAST_MEANS:
        means = F.broadcast(means)
    wide = nodes.withColumn("dim", (F.octet_length("vector") / 8).cast("int")).join(means, ["label", "dim"])
    return wide.select("node", "label", "vector", "mean"), int(size[1] or 0)


def _search(spark: SparkSession, wide: DataFrame, scratch: Scratch, first: int, passes: int, window: int, threshold: float) -> DataFrame:
    """(u, v): spanning forests of what ``passes`` sorted passes find."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["pass", "label", "dim", "key", "node"]
    keyed = wide.mapInArrow(_keys(first, passes, threshold), "pass int, label string, dim int, key long, node long, vector binary")
    sorted_ = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = scratch.stage(sorted_.mapInArrow(_windows(window, threshold), _FOUND_SQL), "found")

    def seam(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        # at most 2 * window rows: the end of one sorted partition and the start of the next
        at = sorted(table.to_pylist(), key=lambda r: r["place"])
        u, v = zip(*e) if (e := forest(_rows_near(at, window, threshold))) else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    seams = found.where("edge is not null").groupBy("edge").applyInArrow(seam, "u long, v long")
    return scratch.stage(found.where("u is not null").select("u", "v").unionByName(seams), "pairs")


def _sampled(nodes: DataFrame, sample: int) -> dict[tuple, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(nodes, components, vectors) of the sampled nodes by label and length."""
    groups: dict[tuple, list] = {}
    for r in nodes.orderBy(F.xxhash64("node"), "node").limit(sample).collect():
        groups.setdefault((r["label"], len(r["vector"])), []).append(r)
    return {k: (np.array([r["node"] for r in rows]), np.array([r["component"] for r in rows]), np.frombuffer(b"".join(bytes(r["vector"]) for r in rows), np.float64).reshape(len(rows), -1)) for k, rows in groups.items()}


def embedding_components(
    spark: SparkSession, vectors: DataFrame, threshold: float = 0.98, passes: int = 16, window: int = 128, sample: int = 1000, recall: float = 0.995
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of ``vectors`` (vec_id, embedding, label)."""
    scratch = Scratch(spark, "neardup")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = scratch.stage(v.mapInArrow(_nodes, "vec_id long, label string, node long, vector binary"), "nodes")
    members = rows.select("vec_id", "node")
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    nodes = scratch.stage(nodes, "distinct")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    wide, largest = _with_means(nodes.select("node", "label", "vector"), scratch)
    done, edges = 0, None
    while True:
        found = _search(spark, wide, scratch, done, passes, window, threshold)
        done += passes
        labels = components(found if edges is None else edges.unionByName(found), scratch)
        labels = scratch.stage(labels, "components")
        edges = labels.where("id <> component").select(F.col("id").alias("u"), F.col("component").alias("v"))
        placed = nodes.join(labels, nodes["node"] == labels["id"], "left").select("node", "label", "vector", F.coalesce("component", "node").alias("component"))
        if window >= largest:
            break  # wider ones find nothing new
        measured = scratch.stage(placed.mapInArrow(_measure(spark.sparkContext.broadcast(_sampled(placed, sample)), threshold), "u long, v long, links long, inside long"), "measured")
        r = measured.agg(F.sum("links"), F.sum("inside")).head()
        share = (r[1] or 0) / r[0] if r[0] else 1.0
        edges = edges.unionByName(measured.where("u is not null").select("u", "v"))
        if share >= recall:
            break
        passes, window = 8, window * (4 if share >= 0.9 else 16)
    edges = scratch.stage(edges.unionByName(_check(placed, scratch, parts, threshold)), "edges")
    labels = components(edges, scratch)

    inside = scratch.stage(nodes.join(labels, nodes["node"] == labels["id"]).select("node", "first_id", "copies", "vector", "component"), "inside")
    size = inside.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.min("first_id").alias("component_id"))
    split = inside.join(size, "component").withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("component", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "node", "copies", "vector")
    counted = split.repartition(parts, "component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(_blocks(threshold), "node long, links long")
    links = counted.groupBy("node").agg(F.sum("links").alias("links"))

    ids = inside.join(size, "component").select("node", "component_id")
    known = nodes.select("node", "first_id", "copies").join(ids, "node", "left").join(links, "node", "left")
    known = known.select("node", F.coalesce("component_id", "first_id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = members.join(known, "node", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
