"""Connected components of an edge table, without collecting it.

Large-star and small-star rounds (Kiveris et al., 2014): every round is two
minimum-by-key aggregations and joins, and the edges shrink to stars around the
smallest id in O(log^2 n) rounds.  Each round is staged, so a lost executor
costs one round.  Each partition first keeps a spanning forest of its edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch

_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])
FOREST_EDGES = 1 << 20


def forest(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, smallest node of its group) for all nodes that are not the smallest."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    for a, b in edges:
        parent.setdefault(a, a)
        parent.setdefault(b, b)
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, r) for x in parent if (r := find(x)) != x]


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int]] = []

    def out() -> pa.RecordBatch:
        u, v = zip(*done) if (done := forest(held)) else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=_EDGE)

    for b in batches:
        held += zip(b.column(0).to_pylist(), b.column(1).to_pylist())
        if len(held) > FOREST_EDGES:
            yield out()
            held = []
    yield out()


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(id, component): for every node of ``edges`` (columns u, v) the smallest node it reaches."""
    e = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    e = scratch.stage(e.mapInArrow(_local_forest, "u long, v long"), "edges")

    def size(df: DataFrame) -> tuple:
        r = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        return r[0], r[1]

    before = size(e)
    for _ in range(max_rounds if before[0] else 0):
        # edges always run from the larger id u to the smaller v
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after_df = scratch.stage(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        scratch.drop(e)
        e, after = after_df, size(after_df)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
