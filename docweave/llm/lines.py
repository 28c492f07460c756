"""Cross-site boilerplate lines, by how many distinct sites a line appears on.

A line on at least ``min_sites`` sites is boilerplate and goes from every document,
the first one too; the other lines stay in order.  Lines compare after trimming
blanks at both ends; blank lines never go.

  1. HyperLogLog sketches of the sites merge by aggregation, first in each task and
     then by line, so a line on a billion pages costs one sketch a task.  The
     least and the greatest site hash go along: where they are equal the line has one site.
  2. Estimates within ``margin`` of the threshold are settled by exact distinct
     counts; outside it, the sketch's error (1.6 % at 2**12 registers) cannot reach
     the threshold, so the result is that of exact counts.

All in Spark's own functions.  Near and boilerplate hashes are joined, not collected; up to
``BROADCAST_LINES`` of them are broadcast, more are joined by line.

Edge cases: null text stays null, with no lines; an empty text is one blank
line.  A null site counts as one site named "".  Repeated rows come out row for
row.  Other columns pass through; their names may be anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .scratch import Scratch

MIN_SITES = 10
LG_REGISTERS = 12
MARGIN = 0.15
BROADCAST_LINES = 200_000
BLANKS = " \t\r\x0b\x0c"


def _line_hashes(text: Column) -> Column:
    """One hash a line; null for blank ones."""
    def one(line: Column) -> Column:
        core = F.btrim(line, F.lit(BLANKS))
        return F.when(core != "", F.xxhash64(core))

    return F.transform(F.split(text, "\n"), one)


def _small(df: DataFrame) -> DataFrame:
    """A staged table of line hashes, for a join: broadcast where its size allows it."""
    return F.broadcast(df) if df.count() <= BROADCAST_LINES else df


def boilerplate_hashes(spark: SparkSession, docs: DataFrame, site: str, min_sites: int, margin: float, scratch: Scratch) -> DataFrame:
    """(line): hashes of the lines on at least ``min_sites`` sites."""
    lines = docs.select(F.coalesce(F.col(f"`{site}`").cast("string"), F.lit("")).alias("site"), F.explode(_line_hashes(F.col("text"))).alias("line")).where("line is not null")
    site_hash = F.xxhash64("site")
    spread = lines.groupBy("line").agg(F.hll_sketch_agg(site_hash, LG_REGISTERS).alias("sketch"), F.min(site_hash).alias("a"), F.max(site_hash).alias("b")).where("a <> b")
    spread = spread.select("line", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites * (1 - margin))
    spread = scratch.stage(spread, "spread")
    sure = spread.where(F.col("sites") > min_sites * (1 + margin)).select("line")
    near = scratch.stage(spread.where(F.col("sites") <= min_sites * (1 + margin)).select("line"), "near")
    # distinct sites first: a near line may still have very many occurrences
    exact = lines.join(_small(near), "line", "left_semi").distinct().groupBy("line").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites).select("line")
    return scratch.stage(sure.unionByName(exact), "boilerplate")


def line_dedup(spark: SparkSession, docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, margin: float = MARGIN) -> DataFrame:
    """``docs`` with boilerplate lines out of ``text``, and n_lines and n_removed_lines (long) added, in place of columns of these names."""
    if min_sites < 2:
        raise ValueError("min_sites must be at least 2")
    scratch = Scratch(spark, "lines")
    goes = boilerplate_hashes(spark, docs, site, min_sites, margin, scratch)
    # the columns travel in one struct, so no name of theirs meets one used here
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row")).withColumn("of_text", F.xxhash64("text"))
    at = own.where("text is not null").select("id", "of_text", F.posexplode(_line_hashes(F.col("text"))).alias("at", "line")).where("line is not null")
    hits = at.join(_small(goes), "line").groupBy(F.col("id").alias("hit_id"), F.col("of_text").alias("hit_text")).agg(F.collect_set("at").alias("gone"))
    joined = own.hint("shuffle_merge").join(hits, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("of_text") == F.col("hit_text")), "left")
    parts = F.split("text", "\n")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter(parts, lambda _, i: ~F.array_contains("gone", i)), "\n"))
    counts = [F.coalesce(F.when(F.col("text").isNotNull(), F.size(parts)), F.lit(0)).cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed_lines")]
    added = {"n_lines", "n_removed_lines"}
    return joined.select(*[kept.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in added], *counts)
