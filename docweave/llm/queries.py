"""The registered queries of this subpackage, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe import bpe_round_trip
from .jaccard import jaccard_components
from .lines import line_dedup
from .neardup import embedding_components
from .packing import pack_documents
from .quality import quality_rules
from .scoring import mixing_scores
from .suffix import substring_dedup
from .toxicity import toxicity_scores
from .warc import warc_round_trip


_COMPONENTS = """
reach AS (SELECT x AS id, x AS r FROM links UNION SELECT reach.id, links.y FROM reach JOIN links ON links.x = reach.r),
least AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id),
degree AS (SELECT x AS id, count(*) AS n_links FROM links GROUP BY x)
"""

OP1_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles FROM w
), e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS g FROM s),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), {_COMPONENTS}
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(n_links, 0) AS n_links
FROM s LEFT JOIN least ON least.id = doc_id LEFT JOIN degree ON degree.id = doc_id
"""

OP3_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), {_COMPONENTS}
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN least ON least.id = vec_id LEFT JOIN degree ON degree.id = vec_id
"""

#: Bytes as pairs of hexadecimal digits; late: positions whose 100 bytes start earlier too.
OP5_SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, i, md5(substr(h, 2 * i - 1, 200)) AS g FROM (SELECT doc_id, h, unnest(range(1, len(h) // 2 - 98)) AS i FROM t)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM p) WHERE n > 1),
runs AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM late)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 99 AS z FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
kept AS (
  SELECT doc_id, sum(z - a + 1) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - 1 - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS rest
  FROM gaps JOIN t USING (doc_id) GROUP BY doc_id
)
SELECT t.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM t LEFT JOIN kept ON kept.doc_id = t.doc_id
"""

OP6_SQL = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS site, string_split(text, chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, site, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM d),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS core FROM l),
b AS (SELECT core FROM k WHERE core <> '' GROUP BY core HAVING count(DISTINCT site) >= 10),
f AS (SELECT doc_id, line, pos, core IN (SELECT core FROM b) AS goes FROM k),
g AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_removed_lines, md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT goes), '')) AS text_md5 FROM f GROUP BY doc_id
)
SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed_lines, 0) AS n_removed_lines, text_md5 FROM documents LEFT JOIN g ON g.doc_id = documents.doc_id
"""

OP9_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.first_id < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id < p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark, _table(spark, sf_dir, "documents"), percent=80)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark, _table(spark, sf_dir, "documents"))


def op3_sorted_projection_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(spark, _table(spark, sf_dir, "embeddings"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark, _table(spark, sf_dir, "documents"), output="sha256")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.lower(F.hex("kept")).alias("kept_sha256"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(spark, _table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "n_lines", "n_removed_lines", F.md5("text").alias("text_md5"))


def op7_byte_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = bpe_round_trip(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)
    return out.select("doc_id", "n_tokens", F.lower(F.hex("ids")).alias("ids_sha256"), F.lower(F.hex("decoded")).alias("decoded_sha256"))


def op8_context_mixing_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_scores(spark, _table(spark, sf_dir, "documents"))


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(spark, _table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_jaccard_join, op2_quality_rules, op3_sorted_projection_neardup, op4_best_fit_packing, op5_suffix_array_dedup, op6_line_dedup, op7_byte_bpe_round_trip, op8_context_mixing_scores, op9_warc_round_trip, op10_compression_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": OP1_SQL, "op3_sorted_projection_neardup": OP3_SQL, "op5_suffix_array_dedup": OP5_SQL, "op6_line_dedup": OP6_SQL, "op9_warc_round_trip": OP9_SQL}
