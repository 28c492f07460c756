"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and
returns a DataFrame; ``run`` writes it as Parquet in the shared folder and
reads it back as the next one's ``docs``.  All but the last return the
columns of ``docs``.

  quality   rejected documents go
  lines     cross-site boilerplate lines go; no document does
  neardup   of each group of near copies the smallest doc_id stays
  substrings  bytes covered by a 100-byte string that starts earlier go, with
            what is left of a character cut in two
  packing   pieces of token sequences: the final result

Edge cases: rows without a doc_id are never dropped as copies; of repeated
identical rows one stays.  n_chars, where there, follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docweave.llm.jaccard import jaccard_components
from docweave.llm.lines import line_dedup
from docweave.llm.packing import pack_documents
from docweave.llm.quality import quality_rules
from docweave.llm.scratch import Scratch
from docweave.llm.suffix import substring_dedup


def _like(docs: DataFrame, out: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """``out`` in the columns of ``docs``, with its column ``text`` as the text; n_chars counts again."""
    own = {"text": F.col(text).cast("string"), "n_chars": F.char_length(F.col(text).cast("string"))}
    return out.select(*(own.get(c, F.col(f"`{prefix}{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = quality_rules(spark, docs, carry=tuple(docs.columns)).where("kept")
    return out.select(*(F.col(f"`in_{c}`").alias(c) for c in docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _like(docs, line_dedup(spark, docs), "text")


def neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard_components(spark, docs)
    stays = found.where("doc_id = component_id").select("doc_id").distinct()
    # the columns travel in one struct, so no name of theirs meets one used here
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    own = rows.hint("shuffle_merge").join(stays, "doc_id", "left_semi")
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        own = own.withColumn("of_text", F.xxhash64("row.text")).dropDuplicates(["doc_id", "of_text"]).drop("of_text")
    return own.unionByName(rows.where("doc_id is null")).select(*(F.col("row")[c].alias(c) for c in docs.columns))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the text goes through the operator itself
    out = substring_dedup(spark, docs, output="text", carry=tuple(c for c in docs.columns if c != "text"))
    return _like(docs, out, "kept", "in_")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark, docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")


STAGES = [("quality", quality), ("lines", lines), ("neardup", neardup), ("substrings", substrings), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
