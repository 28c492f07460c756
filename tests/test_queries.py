"""Registered queries against their SQL, on the smallest tables."""

from __future__ import annotations

import math
import os

import pytest

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One of each kind; the driver holds all of them against their SQL.
SOME = (
    "j1_belongs_to", "j2_has_one", "j3_has_many_order_limit", "j4_many_to_many", "j5_three_levels", "a9_through_aggregate", "a7_ids_through", "empty_relation_shapes", "f9_in", "f14_raw", "f15_root_filters_tombstone", "f16_soft_delete_column", "p1_p5_columns_transforms_constants",
    "p7_p8_geo", "p9_map", "p15_composite_id", "q4_minimum_should_match", "q14_regexp", "n1_nested_any", "n4_nested_projection", "t2_phrase", "t7_query_string", "c4_function_score", "c8_bm25", "g1_geo_distance", "m4_map_sort_key", "x5_nested_filtered_sort", "x9_enum_order_sort", "x14_search_after", "x15_collapse", "u1_union", "r3_resolve_grandchild", "r7_resolve_through_junction", "k2_k10_r15_maintain_generations", "x19_highlight", "t9_combined_fields", "u3_msearch", "s9_catalog",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


def test_every_sql_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SOME)
def test_query(spark, duck, name):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, FOLDER)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 150
