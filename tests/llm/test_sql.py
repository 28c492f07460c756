"""The SQL of this subpackage's queries: on the smallest tables, and on made ones that hold the cases."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from docweave.llm import queries as own

from .common import edge_rows, prose

FOLDER = "/root/testdata/sf0.001"


def compare(spark, folder, name):
    import duckdb

    c = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        if os.path.exists(f"{folder}/{table}.parquet"):
            c.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    df, want = own.queries()[name](spark, str(folder)), c.sql(own.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = sorted(repr([r[x] for x in columns]) for r in df.collect())
    assert got == sorted(repr(list(r)) for r in want.select(*columns).fetchall())
    return got


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_on_the_smallest_tables(spark, name):
    compare(spark, FOLDER, name)


def documents(rows):
    ids, texts, langs, sources, n = zip(*rows)
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(langs, pa.string()), "source": pa.array(sources, pa.string()), "n_chars": pa.array(n, pa.int64())})


@pytest.mark.parametrize("name", ["op1_ngram_jaccard_join", "op5_suffix_array_dedup", "op6_line_dedup"])
def test_on_made_documents(spark, tmp_path, name):
    shared = prose(70, 60)
    rows = [r for r in edge_rows() if r[0] not in (11, 12)] + [(100 + i, prose(100 + i, 40) + "\n" + shared + "\nAll rights reserved here.\n" + "ab" * (40 * i), "en", f"t{i}", 0) for i in range(12)]
    pq.write_table(documents(rows), tmp_path / "documents.parquet")
    compare(spark, tmp_path, name)


def test_on_made_vectors(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 12))
    vectors = [(centres[i % 6] + 0.06 * rng.standard_normal(12)).tolist() for i in range(150)]
    labels = [i % 4 if i % 11 else None for i in range(150)]
    vectors += [None, [0.0] * 12, [float("nan")] * 12, vectors[0], [2 * x for x in vectors[0]]]
    labels += [0, 0, 0, 0, 0]
    pq.write_table(pa.table({"vec_id": list(range(len(vectors))), "embedding": pa.array(vectors, pa.list_(pa.float64())), "label": pa.array(labels, pa.int64())}), tmp_path / "embeddings.parquet")
    out = compare(spark, tmp_path, "op3_sorted_projection_neardup")
    assert sum(", 0, " not in r for r in out) > 50  # there are links
