"""Registered queries over the star schema, and the SQL that gives the same rows."""

from __future__ import annotations

import atexit
from collections.abc import Callable
from functools import lru_cache
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import geo
from .operators import clauses as q
from .operators.dsl import parse, parse_search
from .operators.search import Index, MultiSearch, NestedProjection, Search, msearch, msearch_all
from .operators.sorting import Sort, SortBuilder
from .operators.syntax import query_string, simple_query_string
from .plans.assemble import assemble, build_many, sample_document
from .schema import Schema, document_type, dump_schema, load_schema, parse_schema
from .sinks.store import Files, JsonSink, ParquetSink, rejected
from .sources.registry import Registry
from .streaming.maintain import Maintainer
from .streaming.resolve import affected, split_key_changes

KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": (), "events": "event_id"}

CUSTOMER = """
version: 1
table: customer
primary_key: c_custkey
fields:
  - long: id
    column: c_custkey
    required: true
  - text: name
    column: c_name
    required: true
  - keyword: segment
    column: c_mktsegment
    required: false
    transforms: [lowercase]
  - double: balance
    column: c_acctbal
    required: false
  - belongs_to: nation
    table: nation
    primary_key: n_nationkey
    column: c_nationkey
    fields:
      - keyword: name
        column: n_name
        required: true
      - belongs_to: region
        table: region
        primary_key: r_regionkey
        column: n_regionkey
        fields:
          - keyword: name
            column: r_name
            required: true
  - has_one: latest
    table: orders
    primary_key: o_orderkey
    foreign_key: o_custkey
    order_by: [{column: o_orderdate, direction: desc}, {column: o_orderkey, direction: desc}]
    fields:
      - long: key
        column: o_orderkey
        required: true
      - timestamp: date
        column: o_orderdate
        required: true
  - has_many: orders
    table: orders
    primary_key: o_orderkey
    foreign_key: o_custkey
    order_by: [{column: o_orderdate, direction: desc}, {column: o_orderkey}]
    fields:
      - long: key
        column: o_orderkey
        required: true
      - enum: priority
        column: o_orderpriority
        required: true
        variants: [1-URGENT, 2-HIGH, 3-MEDIUM, 4-NOT SPECIFIED, 5-LOW]
      - keyword: status
        column: o_orderstatus
        required: true
      - double: total
        column: o_totalprice
        required: true
      - has_many: items
        table: lineitem
        primary_key: l_linenumber
        foreign_key: l_orderkey
        fields:
          - long: part
            column: l_partkey
            required: true
          - double: quantity
            column: l_quantity
            required: true
          - keyword: flag
            column: l_returnflag
            required: true
      - count: itemCount
        table: lineitem
        foreign_key: l_orderkey
  - count: orderCount
    table: orders
    foreign_key: o_custkey
  - sum: lifetimeValue
    table: orders
    column: o_totalprice
    value_type: decimal
    foreign_key: o_custkey
  - avg: averageValue
    table: orders
    column: o_totalprice
    foreign_key: o_custkey
  - min: firstOrder
    table: orders
    column: o_orderdate
    value_type: timestamp
    foreign_key: o_custkey
  - max: largest
    table: orders
    column: o_totalprice
    value_type: double
    foreign_key: o_custkey
  - count: openOrders
    table: orders
    foreign_key: o_custkey
    filters: [{column: o_orderstatus, op: eq, value: O}]
  - ids: orderIds
    table: orders
    column: o_orderkey
    element_type: long
    foreign_key: o_custkey
"""

ORDER = """
version: 1
table: orders
primary_key: o_orderkey
fields:
  - long: key
    column: o_orderkey
    required: true
  - long: customer
    column: o_custkey
    required: true
  - keyword: status
    column: o_orderstatus
    required: true
  - double: total
    column: o_totalprice
    required: true
  - timestamp: date
    column: o_orderdate
    required: true
  - enum: priority
    column: o_orderpriority
    required: true
    variants: [5-LOW, 4-NOT SPECIFIED, 3-MEDIUM, 2-HIGH, 1-URGENT]
  - has_many: items
    table: lineitem
    primary_key: l_linenumber
    foreign_key: l_orderkey
    fields:
      - long: part
        column: l_partkey
        required: true
      - double: quantity
        column: l_quantity
        required: true
      - double: discount
        column: l_discount
        required: true
      - keyword: flag
        column: l_returnflag
        required: true
  - ids: parts
    table: lineitem
    column: l_partkey
    element_type: long
    foreign_key: l_orderkey
"""

PART = """
version: 1
table: part
primary_key: p_partkey
fields:
  - long: key
    column: p_partkey
    required: true
  - text: name
    column: p_name
    required: true
  - identifier: brand
    column: p_brand
    required: true
  - keyword: type
    column: p_type
    required: true
  - integer: size
    column: p_size
    required: true
  - many_to_many: suppliers
    table: supplier
    through: {table: lineitem, left_key: l_partkey, right_key: l_suppkey}
    primary_key: s_suppkey
    order_by: [{column: s_suppkey}]
    fields:
      - long: key
        column: s_suppkey
        required: true
      - double: balance
        column: s_acctbal
        required: true
  - ids: supplierIds
    table: supplier
    element_type: long
    through: {table: lineitem, left_key: l_partkey, right_key: l_suppkey}
  - max: bestBalance
    table: supplier
    column: s_acctbal
    value_type: double
    through: {table: lineitem, left_key: l_partkey, right_key: l_suppkey}
  - count: richSuppliers
    table: supplier
    through: {table: lineitem, left_key: l_partkey, right_key: l_suppkey}
    filters: [{column: s_acctbal, op: gt, value: 5000}]
"""

EVENT = """
version: 1
table: events
primary_key: event_id
fields:
  - long: id
    column: event_id
    required: true
  - keyword: kind
    column: event_type
    required: true
  - double: value
    column: value
    required: true
  - map: props
    column: props
    values: long
    required: true
  - timestamp: at
    column: ts
    required: true
"""

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    _queries[name] = run
    if sql is not None:
        _sql[name] = sql


def registry(spark: SparkSession, folder: str) -> Registry:
    return Registry.parquet(spark, folder, KEYS)


@lru_cache
def schema(text: str, index: str) -> Schema:
    return load_schema(text, index)


def _docs(text: str, index: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: assemble(schema(text, index), registry(spark, d))


def _index(spark: SparkSession, folder: str, text: str, name: str) -> Index:
    s = schema(text, name)
    return Index(name, assemble(s, registry(spark, folder)), document_type(s))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(CUSTOMER, "customers")(spark, folder)


def _one(table: str, key: str, *fields: dict, **rest) -> Schema:
    return parse_schema({"version": 1, "table": table, "primary_key": key, "fields": list(fields), **rest}, table)


def _shape(select: list[str], text: str = CUSTOMER, index: str = "customers"):
    return lambda spark, d: _docs(text, index)(spark, d).selectExpr(*select)


# relations, aggregates and their order
_add("j1_belongs_to", _shape(["id", "nation.name AS nation", "nation.region.name AS region"]), "SELECT c_custkey AS id, n_name AS nation, r_name AS region FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
_add("j2_has_one", _shape(["id", "latest.key AS latest_key", "latest.date AS latest_date"]), "SELECT c_custkey AS id, o_orderkey AS latest_key, o_orderdate AS latest_date FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey DESC) AS n FROM orders) o ON o_custkey = c_custkey AND n = 1")
_add("j3_has_many_order_limit", lambda s, d: assemble(_one("customer", "c_custkey", {"long": "id", "column": "c_custkey", "required": True}, {"has_many": "orders", "table": "orders", "primary_key": "o_orderkey", "foreign_key": "o_custkey", "limit": 3, "order_by": [{"column": "o_totalprice", "direction": "desc"}, {"column": "o_orderkey"}], "filters": [{"column": "o_orderstatus", "op": "neq", "value": "P"}], "fields": [{"long": "key", "column": "o_orderkey", "required": True}]}), registry(s, d)).select("id", F.posexplode("orders").alias("pos", "o")).select("id", F.col("pos").cast("long").alias("pos"), F.col("o.key").alias("order_key")),
     "SELECT o_custkey AS id, n - 1 AS pos, o_orderkey AS order_key FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey NULLS LAST) AS n FROM orders WHERE o_orderstatus <> 'P') JOIN customer ON c_custkey = o_custkey WHERE n <= 3")
_add("j4_many_to_many", _shape(["key", "CAST(size(suppliers) AS BIGINT) AS n", "suppliers[0].key AS first", "aggregate(suppliers, 0L, (a, x) -> a + x.key) AS total"], PART, "parts"), "SELECT p_partkey AS key, count(s_suppkey) AS n, min(s_suppkey) AS first, CAST(coalesce(sum(s_suppkey), 0) AS BIGINT) AS total FROM part LEFT JOIN (lineitem JOIN supplier ON s_suppkey = l_suppkey) ON l_partkey = p_partkey GROUP BY p_partkey")
_add("j5_three_levels", _shape(["id", "CAST(size(orders) AS BIGINT) AS n_orders", "CAST(aggregate(orders, 0, (a, o) -> a + size(o.items)) AS BIGINT) AS n_items", "aggregate(orders, 0D, (a, o) -> a + aggregate(o.items, 0D, (b, i) -> b + i.quantity)) AS quantity", "aggregate(orders, 0L, (a, o) -> a + o.itemCount) AS counted"]),
     "SELECT c_custkey AS id, count(DISTINCT o_orderkey) AS n_orders, count(l_orderkey) AS n_items, coalesce(sum(l_quantity), 0.0) AS quantity, count(l_orderkey) AS counted FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey")
_add("a1_count_a10_filtered", _shape(["id", "orderCount AS n", "openOrders AS n_open"]), "SELECT c_custkey AS id, count(o_orderkey) AS n, count(*) FILTER (o_orderstatus = 'O') AS n_open FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
_add("a2_sum", _shape(["id", "round(CAST(lifetimeValue AS DOUBLE), 2) AS value"]), "SELECT c_custkey AS id, round(CAST(sum(CAST(o_totalprice AS DECIMAL(28,10))) AS DOUBLE), 2) AS value FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
_add("a3_avg", _shape(["id", "round(averageValue, 7) AS average"]), "SELECT c_custkey AS id, round(avg(o_totalprice), 7) AS average FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
_add("a4_min_a5_max", _shape(["id", "firstOrder AS first", "largest"]), "SELECT c_custkey AS id, min(o_orderdate) AS first, max(o_totalprice) AS largest FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
_add("a6_ids_direct", lambda s, d: flagship(s, d).select("id", F.explode("orderIds").alias("order_key")), "SELECT o_custkey AS id, o_orderkey AS order_key FROM orders JOIN customer ON c_custkey = o_custkey")
_add("a7_ids_through", lambda s, d: _docs(PART, "parts")(s, d).select("key", F.explode("supplierIds").alias("supplier")), "SELECT l_partkey AS key, l_suppkey AS supplier FROM lineitem JOIN part ON p_partkey = l_partkey")
_add("a9_through_aggregate", _shape(["key", "bestBalance AS best", "richSuppliers AS rich"], PART, "parts"), "SELECT p_partkey AS key, max(s_acctbal) AS best, count(*) FILTER (s_acctbal > 5000) AS rich FROM part LEFT JOIN (lineitem JOIN supplier ON s_suppkey = l_suppkey) ON l_partkey = p_partkey GROUP BY p_partkey")
_add("a11_aggregate_inside_join", lambda s, d: flagship(s, d).select(F.explode("orders").alias("o")).selectExpr("o.key AS key", "o.itemCount AS n"), "SELECT o_orderkey AS key, count(l_orderkey) AS n FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
_add("o1_o2_multi_key_order", lambda s, d: flagship(s, d).select("id", F.posexplode("orders").alias("pos", "o")).selectExpr("id", "CAST(pos AS BIGINT) AS pos", "o.key AS order_key"), "SELECT o_custkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey) - 1 AS pos, o_orderkey AS order_key FROM orders JOIN customer ON c_custkey = o_custkey")
_add("o3_limit_per_parent", lambda s, d: assemble(_one("nation", "n_nationkey", {"integer": "id", "column": "n_nationkey", "required": True}, {"has_many": "top", "table": "customer", "primary_key": "c_custkey", "foreign_key": "c_nationkey", "limit": 2, "order_by": [{"column": "c_acctbal", "direction": "desc"}], "fields": [{"long": "key", "column": "c_custkey", "required": True}]}), registry(s, d)).select("id", F.posexplode("top").alias("pos", "c")).selectExpr("id", "CAST(pos AS BIGINT) AS pos", "c.key AS customer"), "SELECT c_nationkey AS id, n - 1 AS pos, c_custkey AS customer FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS FIRST, c_custkey) AS n FROM customer) WHERE n <= 2")
_add("empty_relation_shapes", lambda s, d: assemble(_one("customer", "c_custkey", {"long": "id", "column": "c_custkey", "required": True}, {"has_many": "none", "table": "orders", "primary_key": "o_orderkey", "foreign_key": "o_custkey", "filters": [{"column": "o_totalprice", "op": "lt", "value": 0}], "fields": [{"long": "key", "column": "o_orderkey", "required": True}]}, {"has_one": "one", "table": "orders", "primary_key": "o_orderkey", "foreign_key": "o_custkey", "filters": [{"column": "o_totalprice", "op": "lt", "value": 0}], "fields": [{"long": "key", "column": "o_orderkey", "required": True}]}, {"sum": "sum", "table": "orders", "column": "o_totalprice", "value_type": "double", "foreign_key": "o_custkey", "filters": [{"column": "o_totalprice", "op": "lt", "value": 0}]}, {"count": "count", "table": "orders", "foreign_key": "o_custkey", "filters": [{"column": "o_totalprice", "op": "lt", "value": 0}]}), registry(s, d)).selectExpr("id", "CAST(size(none) AS BIGINT) AS n", "one IS NULL AS absent", "sum", "count"), "SELECT c_custkey AS id, CAST(0 AS BIGINT) AS n, true AS absent, CAST(NULL AS DOUBLE) AS sum, CAST(0 AS BIGINT) AS count FROM customer")

# row filters, one query an operator
for _name, _filter, _where in (
    ("f1_eq", {"column": "o_orderstatus", "op": "eq", "value": "F"}, "o_orderstatus = 'F'"),
    ("f2_neq", {"column": "o_orderstatus", "op": "neq", "value": "F"}, "o_orderstatus <> 'F'"),
    ("f3_lt", {"column": "o_totalprice", "op": "lt", "value": 100000}, "o_totalprice < 100000"),
    ("f4_lte", {"column": "o_orderkey", "op": "lte", "value": 500}, "o_orderkey <= 500"),
    ("f5_gt", {"column": "o_orderdate", "op": "gt", "value": "1997-01-15"}, "o_orderdate > TIMESTAMP '1997-01-15'"),
    ("f6_gte", {"column": "o_orderdate", "op": "gte", "value": "1997-01-15"}, "o_orderdate >= TIMESTAMP '1997-01-15'"),
    ("f7_like", {"column": "o_orderpriority", "op": "like", "value": "%-M%"}, "o_orderpriority LIKE '%-M%'"),
    ("f8_ilike", {"column": "o_orderpriority", "op": "ilike", "value": "%spec%"}, "o_orderpriority ILIKE '%spec%'"),
    ("f9_in", {"column": "o_custkey", "op": "in", "value": [1, 7, 9, 99999999]}, "o_custkey IN (1, 7, 9, 99999999)"),
    ("f10_not_in", {"column": "o_orderstatus", "op": "not_in", "value": ["F", "P"]}, "o_orderstatus NOT IN ('F', 'P')"),
    ("f11_between", {"column": "o_totalprice", "op": "between", "value": [50000, 60000]}, "o_totalprice BETWEEN 50000 AND 60000"),
    ("f12_is_null", {"column": "o_orderdate", "op": "is_null"}, "o_orderdate IS NULL"),
    ("f13_is_not_null", {"column": "o_orderdate", "op": "is_not_null"}, "o_orderdate IS NOT NULL"),
    ("f14_raw", {"raw": "o_totalprice > 1000 * o_custkey AND o_orderstatus = 'O'"}, "o_totalprice > 1000 * o_custkey AND o_orderstatus = 'O'"),
):
    _add(_name, lambda s, d, f=_filter: assemble(_one("orders", "o_orderkey", {"long": "key", "column": "o_orderkey", "required": True}, filters=[f]), registry(s, d)).select("key"), f"SELECT o_orderkey AS key FROM orders WHERE {_where}")

_KEYED = {"long": "key", "column": "o_orderkey", "required": True}


def _all_keys(s: SparkSession, d: str, table: str = "orders", key: str = "o_orderkey") -> DataFrame:
    """Every key of a table, and as many that do not exist."""
    return s.read.parquet(f"{d}/{table}.parquet").select(F.explode(F.array(key, -1 - F.col(key))).alias(key))


_ASKED = "(SELECT unnest([o_orderkey, -1 - o_orderkey]) AS k FROM orders)"
_add("f15_root_filters_tombstone", lambda s, d: build_many(_one("orders", "o_orderkey", _KEYED, filters=[{"column": "o_orderstatus", "op": "eq", "value": "F"}, {"column": "o_totalprice", "op": "gt", "value": 50000}]), registry(s, d), _all_keys(s, d)).select("_id", "op"),
     f"SELECT CAST(k AS VARCHAR) AS _id, CASE WHEN o_orderkey IS NULL THEN 'delete' ELSE 'upsert' END AS op FROM {_ASKED} LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 50000) ON o_orderkey = k")
_add("f16_soft_delete_column", lambda s, d: assemble(_one("orders", "o_orderkey", _KEYED, soft_delete={"column": "o_orderdate", "when": [{"column": "o_orderstatus", "op": "eq", "value": "F"}]}), registry(s, d)).select("key"), "SELECT o_orderkey AS key FROM orders WHERE NOT coalesce(o_orderdate IS NOT NULL AND o_orderstatus = 'F', false)")
_add("f17_soft_delete_field", lambda s, d: assemble(_one("orders", "o_orderkey", _KEYED, {"object": "more", "fields": [{"keyword": "state", "column": "o_orderstatus", "required": True}]}, soft_delete={"field": "state", "when": [{"column": "o_totalprice", "op": "gt", "value": 100000}]}), registry(s, d)).select("key"), "SELECT o_orderkey AS key FROM orders WHERE NOT (o_orderstatus IS NOT NULL AND o_totalprice > 100000)")
_add("f18_s7_batch_by_keys", lambda s, d: assemble(schema(CUSTOMER, "customers"), registry(s, d), _all_keys(s, d, "customer", "c_custkey")).selectExpr("id", "orderCount AS n", "CAST(size(orders) AS BIGINT) AS m"), "SELECT c_custkey AS id, count(o_orderkey) AS n, count(o_orderkey) AS m FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
_add("s5_backfill", lambda s, d: flagship(s, d).select("_id", "id", "name", "balance"), "SELECT CAST(c_custkey AS VARCHAR) AS _id, c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer")
_add("s8_sample_document", lambda s, d: sample_document(schema(CUSTOMER, "customers"), registry(s, d)).selectExpr("_id", "id", "orderCount AS n"), "SELECT CAST(c_custkey AS VARCHAR) AS _id, c_custkey AS id, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_custkey = (SELECT min(c_custkey) FROM customer) GROUP BY c_custkey")
_add("s9_catalog", lambda s, d: s.createDataFrame([(t["table"], c["name"], c["suggested"]) for t in registry(s, d).catalog() for c in t["columns"]], "tbl string, col string, suggested string"),
     f"SELECT table_name AS tbl, column_name AS col, CASE data_type WHEN 'VARCHAR' THEN 'keyword' WHEN 'BIGINT' THEN 'long' WHEN 'INTEGER' THEN 'integer' WHEN 'SMALLINT' THEN 'short' WHEN 'TINYINT' THEN 'short' WHEN 'DOUBLE' THEN 'double' WHEN 'FLOAT' THEN 'float' WHEN 'DATE' THEN 'date' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'BLOB' THEN 'binary' ELSE CASE WHEN data_type LIKE 'TIMESTAMP%' THEN 'timestamp' WHEN data_type LIKE 'DECIMAL%' THEN 'decimal' ELSE 'json' END END AS suggested FROM information_schema.columns WHERE table_name IN ({', '.join(repr(t) for t in KEYS)})")

# projections
_add("p1_p5_columns_transforms_constants", lambda s, d: assemble(_one("customer", "c_custkey", {"long": "id", "column": "c_custkey", "required": True}, {"keyword": "seg", "column": "c_mktsegment", "required": False, "transforms": ["lowercase", "trim"], "default": "none"}, {"constant": "source", "value": "seed"}, {"constant": "version", "value": 3}, {"object": "account", "fields": [{"double": "balance", "column": "c_acctbal", "required": True}, {"object": "deep", "fields": [{"integer": "nation", "column": "c_nationkey", "required": True}]}]}), registry(s, d)).selectExpr("id", "seg", "source", "version", "account.balance AS balance", "account.deep.nation AS nation"), "SELECT c_custkey AS id, coalesce(trim(lower(c_mktsegment)), 'none') AS seg, 'seed' AS source, CAST(3 AS BIGINT) AS version, c_acctbal AS balance, c_nationkey AS nation FROM customer")


def _placed(s: SparkSession, d: str) -> Registry:
    r = registry(s, d)
    c = r.frame("customer").selectExpr("*", "CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 160 - 80D END AS lat", "(c_custkey * 13) % 340 - 170D AS lon", "concat(CAST(c_custkey % 160 - 80 AS STRING), ',', CAST((c_custkey * 13) % 340 - 170 AS STRING)) AS spot")
    return r.add("customer", c, "c_custkey")


_PLACE = _one("customer", "c_custkey", {"long": "id", "column": "c_custkey", "required": True}, {"geo": "place", "lat": "lat", "lon": "lon", "required": False}, {"geo": "spot", "column": "spot", "required": False})
_LAT, _LON = "CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey % 160 - 80 AS DOUBLE) END", "CAST((c_custkey * 13) % 340 - 170 AS DOUBLE)"
_add("p7_p8_geo", lambda s, d: assemble(_PLACE, _placed(s, d)).selectExpr("id", "place.lat AS lat", "place.lon AS lon", "spot.lat AS spot_lat", "spot.lon AS spot_lon"), f"SELECT c_custkey AS id, {_LAT} AS lat, CASE WHEN c_custkey % 7 <> 0 THEN {_LON} END AS lon, CAST(c_custkey % 160 - 80 AS DOUBLE) AS spot_lat, {_LON} AS spot_lon FROM customer")
_add("p9_map", _shape(["id", "props['k'] AS k", "props['none'] AS none"], EVENT, "events"), "SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(NULL AS BIGINT) AS none FROM events")
_add("p10_json", lambda s, d: assemble(_one("events", "event_id", {"long": "id", "column": "event_id", "required": True}, {"json": "props", "required": False}), registry(s, d)).selectExpr("id", "variant_get(props, '$.k', 'bigint') AS k"), "SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
_add("p13_coercion", lambda s, d: assemble(_one("orders", "o_orderkey", _KEYED, {"decimal": "total", "column": "o_totalprice", "required": True}, {"date": "day", "column": "o_orderdate", "required": True}, {"keyword": "customer", "column": "o_custkey", "required": True}), registry(s, d)).selectExpr("key", "CAST(total AS DOUBLE) AS total", "CAST(day AS STRING) AS day", "customer"), "SELECT o_orderkey AS key, o_totalprice AS total, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CAST(o_custkey AS VARCHAR) AS customer FROM orders")
_add("p15_composite_id", lambda s, d: assemble(parse_schema({"version": 1, "table": "lineitem", "primary_key": ["l_orderkey", "l_linenumber", "l_partkey"], "fields": [{"double": "quantity", "column": "l_quantity", "required": True}]}, "items"), registry(s, d)), "SELECT concat(l_orderkey, ':', l_linenumber, ':', l_partkey) AS _id, l_quantity AS quantity FROM lineitem")


# query predicates over order documents
def _find(name: str, make: Callable, where: str, text: str = ORDER, index: str = "orders", key: str = "o_orderkey", table: str = "orders") -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        ix = _index(s, d, text, index)
        out = make(ix.fields)
        return Search(ix).query(out).without_scores().matched().select(F.col("_id"))

    _add(name, run, f"SELECT CAST({key} AS VARCHAR) AS _id FROM {table} WHERE {where}")


for _name, _make, _where in (
    ("q1_and", lambda o: o.status.eq("F") & o.total.gt(100000), "o_orderstatus = 'F' AND o_totalprice > 100000"),
    ("q2_or", lambda o: o.status.eq("P") | o.total.lt(20000), "o_orderstatus = 'P' OR o_totalprice < 20000"),
    ("q3_not", lambda o: ~o.status.eq("F"), "o_orderstatus <> 'F'"),
    ("q4_minimum_should_match", lambda o: q.Bool(should=(o.status.eq("F"), o.total.gt(150000), o.priority.eq("1-URGENT")), minimum_should_match=2), "(o_orderstatus = 'F')::INT + (o_totalprice > 150000)::INT + (o_orderpriority = '1-URGENT')::INT >= 2"),
    ("q6_optional", lambda o: q.both("must", None, o.status.eq("O")), "o_orderstatus = 'O'"),
    ("q7_match_all", lambda o: q.MatchAll(), "true"),
    ("q8_exists", lambda o: o.priority.exists() & o.parts.exists(), "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"),
    ("q9_term_case_insensitive", lambda o: o.priority.eq("1-urgent", case_insensitive=True), "lower(o_orderpriority) = '1-urgent'"),
    ("q10_term_number", lambda o: o.customer.eq(7), "o_custkey = 7"),
    ("q11_terms", lambda o: o.customer.any_of([1, 2, 3]), "o_custkey IN (1, 2, 3)"),
    ("q12_prefix", lambda o: o.priority.prefix("4-NOT"), "starts_with(o_orderpriority, '4-NOT')"),
    ("q13_wildcard", lambda o: o.priority.wildcard("?-*I*"), "o_orderpriority LIKE '_-%I%'"),
    ("q14_regexp", lambda o: o.priority.regexp("[1-3]-(URGENT|HIGH)"), "regexp_full_match(o_orderpriority, '[1-3]-(URGENT|HIGH)')"),
    ("q15_fuzzy", lambda o: o.priority.fuzzy("2-HIHG", fuzziness=1), "o_orderpriority = '2-HIGH'"),
    ("q16_range_number", lambda o: o.total.between(50000, 90000), "o_totalprice BETWEEN 50000 AND 90000"),
    ("q17_range_date", lambda o: q.Range("date", gte="01.02.1997", lt="01.03.1997", format="dd.MM.yyyy"), "o_orderdate >= TIMESTAMP '1997-02-01' AND o_orderdate < TIMESTAMP '1997-03-01'"),
    ("q18_keyword_subfields", lambda o: o.priority.keyword_lowercase().eq("3-medium") | o.priority.text().matches("urgent"), "o_orderpriority IN ('3-MEDIUM', '1-URGENT')"),
    ("q24_ids", lambda o: q.Ids(("1", "5", "77777777")), "o_orderkey IN (1, 5, 77777777)"),
    ("multi_valued_term", lambda o: o.parts.eq(10), "o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey = 10)"),
    ("unmapped_field_matches_nothing", lambda o: ~q.Term("nowhere", "x"), "true"),
    ("n1_nested_any", lambda o: q.Nested("items", q.Term("items.flag", "R") & q.Range("items.quantity", gt=45)), "o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)"),
    ("n2_nested_all", lambda o: q.Nested("items", q.Range("items.quantity", gte=10), how="all"), "o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity < 10)"),
    ("n3_nested_exists", lambda o: q.Nested("items", how="exists"), "o_orderkey IN (SELECT l_orderkey FROM lineitem)"),
    ("t7_query_string", lambda o: query_string('(status:F OR status:P) AND total:[100000 TO *] -priority:"1-URGENT"', ("status",)), "o_orderstatus IN ('F', 'P') AND o_totalprice >= 100000 AND o_orderpriority <> '1-URGENT'"),
    ("e2_dsl_body", lambda o: parse({"bool": {"must": [{"term": {"status": "O"}}], "filter": [{"range": {"total": {"gte": 50000}}}], "must_not": [{"terms": {"customer": [1, 2]}}]}}), "o_orderstatus = 'O' AND o_totalprice >= 50000 AND o_custkey NOT IN (1, 2)"),
    ("e4_script", lambda o: q.Script("total > :x * customer", {"x": 2000}), "o_totalprice > 2000 * o_custkey"),
):
    _find(_name, _make, _where)

# full text over part names
_T = "string_split(p_name, ' ')"
for _name, _make, _where in (
    ("t1_match", lambda p: p.name.matches("Cold widget"), f"list_has_any({_T}, ['cold', 'widget'])"),
    ("t1_match_and", lambda p: p.name.matches("widget COLD", operator="and"), f"list_has_all({_T}, ['cold', 'widget'])"),
    ("t2_phrase", lambda p: p.name.phrase("cold widget"), "p_name = 'cold widget'"),
    ("t3_phrase_prefix", lambda p: p.name.phrase_prefix("cold wi"), "p_name LIKE 'cold wi%'"),
    ("t4_bool_prefix", lambda p: p.name.bool_prefix("cold gad"), f"list_contains({_T}, 'cold') OR p_name LIKE 'gad%' OR p_name LIKE '% gad%'"),
    ("t5_fuzzy_match", lambda p: p.name.matches_fuzzy("widgte"), f"list_contains({_T}, 'widget')"),
    ("t6_multi_match", lambda p: q.MultiMatch(("name^2", "brand"), "brand 13 cold"), f"list_contains({_T}, 'cold') OR p_brand = 'Brand#13' OR p_brand LIKE 'Brand%'"),
    ("t8_simple_query_string", lambda p: simple_query_string("cold + -widget", ("name",)), f"list_contains({_T}, 'cold') AND NOT list_contains({_T}, 'widget')"),
    ("t9_combined_fields", lambda p: q.MultiMatch(("name", "brand"), "cold 13", "combined", "and"), f"list_contains({_T}, 'cold') AND p_brand = 'Brand#13'"),
    ("q19_text_subfields", lambda p: p.name.keyword().eq("cold widget") | p.name.keyword_lowercase().eq("small widget"), "p_name IN ('cold widget', 'small widget')"),
):
    _find(_name, _make, _where, PART, "parts", "p_partkey", "part")

# maps
for _name, _make, _where in (
    ("m1_map_key", lambda e: e.props.key("k").gte(50), "CAST(json_extract(props, '$.k') AS BIGINT) >= 50"),
    ("m2_map_has_key", lambda e: e.props.has_key("k") & e.props.exists() & ~e.props.has_key("z"), "json_extract(props, '$.k') IS NOT NULL"),
    ("m3_map_search", lambda e: e.props.search("87", prefer=(("k", 2.0),)), "CAST(json_extract(props, '$.k') AS BIGINT) = 87"),
):
    _find(_name, _make, _where, EVENT, "events", "event_id", "events")


# geo
def _places(s: SparkSession, d: str) -> Index:
    return Index("places", assemble(_PLACE, _placed(s, d)), document_type(_PLACE))


_HAV = f"2 * {geo.EARTH} * asin(least(1.0, sqrt(pow(sin((radians(lat) - radians(45)) / 2), 2) + cos(radians(lat)) * cos(radians(45)) * pow(sin((radians(lon) - radians(9)) / 2), 2))))"
_PLACES = f"(SELECT c_custkey, {_LAT} AS lat, {_LON} AS lon FROM customer)"
for _name, _make, _where in (
    ("g1_geo_distance", lambda o: o.place.within(45, 9, "2000km"), f"{_HAV} <= 2000000"),
    ("g2_geo_box", lambda o: o.place.in_box(60, 170, -60, -120), "lat BETWEEN -60 AND 60 AND (lon >= 170 OR lon <= -120)"),
    ("g3_geo_polygon", lambda o: o.place.in_polygon([(-10.5, -20.5), (-10.5, 30.5), (40.5, 30.5), (40.5, -20.5)]), "lat > -10.5 AND lat < 40.5 AND lon > -20.5 AND lon < 30.5"),
    ("g4_geo_exists", lambda o: o.place.exists(), "lat IS NOT NULL"),
):
    _add(_name, lambda s, d, m=_make: (ix := _places(s, d)) and Search(ix).query(m(ix.fields)).without_scores().matched().select("_id"), f"SELECT CAST(c_custkey AS VARCHAR) AS _id FROM {_PLACES} WHERE {_where}")
_add("g5_geo_sort", lambda s, d: (ix := _places(s, d)) and Search(ix).query(ix.fields.place.exists()).sort(ix.fields.place.nearest(45, 9, unit="km")).page(0, 20).hits().select("_id", F.round(geo.haversine(F.col("place"), 45, 9) / 1000, 3).alias("km")), f"SELECT CAST(c_custkey AS VARCHAR) AS _id, round({_HAV} / 1000, 3) AS km FROM {_PLACES} WHERE lat IS NOT NULL ORDER BY {_HAV}, CAST(c_custkey AS VARCHAR) LIMIT 20")


# scores
def _scored(name: str, make: Callable, sql: str) -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        ix = _index(s, d, ORDER, "orders")
        return Search(ix).query(make(ix.fields)).matched().select("_id", F.round("_score", 6).alias("score"))

    _add(name, run, f"SELECT CAST(o_orderkey AS VARCHAR) AS _id, round(CAST({sql.partition(' IF ')[0]} AS DOUBLE), 6) AS score FROM orders WHERE {sql.partition(' IF ')[2]}")


_F, _U = "(o_orderstatus = 'F')", "(o_orderpriority = '1-URGENT')"
for _name, _make, _expr in (
    ("q5_boost", lambda o: o.status.eq("F").boosted(2.5) | o.priority.eq("1-URGENT"), f"2.5 * {_F}::INT + {_U}::INT IF {_F} OR {_U}"),
    ("c1_constant_score", lambda o: q.ConstantScore(o.status.eq("F"), boost=3.0), f"3.0 IF {_F}"),
    ("c2_dis_max", lambda o: q.DisMax((o.status.eq("F").boosted(2), o.priority.eq("1-URGENT")), 0.3), f"CASE WHEN {_F} THEN 2 + 0.3 * {_U}::INT ELSE 1 END IF {_F} OR {_U}"),
    ("c3_boosting", lambda o: q.Boosting(o.status.eq("F"), o.priority.eq("1-URGENT"), 0.2), f"CASE WHEN {_U} THEN 0.2 ELSE 1.0 END IF {_F}"),
    ("c4_function_score", lambda o: q.FunctionScore(o.status.eq("F"), ((o.priority.eq("1-URGENT"), 3.0), (o.total.gt(100000), 2.0)), "sum", "replace", max_boost=4.0), f"CASE WHEN {_U} OR o_totalprice > 100000 THEN least(4.0, 3.0 * {_U}::INT + 2.0 * (o_totalprice > 100000)::INT) ELSE 1.0 END IF {_F}"),
    ("c5_script_score", lambda o: q.ScriptScore(o.status.eq("F"), "total / :k", {"k": 1000}, min_score=100.0), f"o_totalprice / 1000 IF {_F} AND o_totalprice / 1000 >= 100"),
    ("c6_distance_feature", lambda o: q.DistanceFeature("date", "1998-01-01 00:00:00", "30d"), "2592000.0 / (2592000.0 + abs(epoch(o_orderdate) - epoch(TIMESTAMP '1998-01-01'))) IF true"),
    ("c7_rank_feature", lambda o: q.RankFeature("total", "saturation", pivot=50000), "o_totalprice / (o_totalprice + 50000) IF true"),
    ("e6_field_value_factor", lambda o: parse({"function_score": {"query": {"term": {"status": "F"}}, "field_value_factor": {"field": "total", "factor": 0.01, "modifier": "sqrt"}, "boost_mode": "replace"}}), f"sqrt(o_totalprice * 0.01) IF {_F}"),
    ("n1_nested_score_sum", lambda o: q.Nested("items", q.Range("items.quantity", gt=40), score_mode="sum"), "(SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40) IF o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)"),
):
    _scored(_name, _make, _expr)
_add("c8_bm25", lambda s, d: (ix := _index(s, d, PART, "parts")) and Search(ix).query(ix.fields.name.matches("cold widget")).matched().select("_id", F.round("_score", 6).alias("score")),
     """WITH t AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part), s AS (SELECT count(*) AS n, avg(len(w)) AS a, count(*) FILTER (list_contains(w, 'cold')) AS d1, count(*) FILTER (list_contains(w, 'widget')) AS d2 FROM t),
     f AS (SELECT p_partkey, len(w) AS l, len(list_filter(w, lambda x: x = 'cold')) AS f1, len(list_filter(w, lambda x: x = 'widget')) AS f2, s.* FROM t, s)
     SELECT CAST(p_partkey AS VARCHAR) AS _id, round(ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * l / a)) + ln(1 + (n - d2 + 0.5) / (d2 + 0.5)) * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * l / a)), 6) AS score FROM f WHERE f1 + f2 > 0""")
_add("t10_more_like_this", lambda s, d: (ix := _index(s, d, PART, "parts")) and Search(ix).query(q.MoreLikeThis(("name",), ("cold widget",), min_term_freq=1)).without_scores().matched().select("_id"), "SELECT CAST(p_partkey AS VARCHAR) AS _id FROM part WHERE list_has_any(string_split(p_name, ' '), ['cold', 'widget'])")


# sorting, paging and the rest of a search
def _page(name: str, make: Callable, sql: str) -> None:
    _add(name, lambda s, d: make(_index(s, d, ORDER, "orders")), sql)


_ID = "CAST(o_orderkey AS VARCHAR) AS _id"
_page("x1_x13_sort_page", lambda ix: Search(ix).query(ix.fields.status.eq("F")).sort(ix.fields.total.desc()).page(5, 10).hits().select("_id", "total"), f"SELECT {_ID}, o_totalprice AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, _id LIMIT 10 OFFSET 5")
_page("x3_multi_valued_mode", lambda ix: Search(ix).sort(Sort("parts", mode="sum", descending=True)).page(0, 15).ids(), f"SELECT {_ID} FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_partkey) AS p FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey ORDER BY p DESC NULLS LAST, _id LIMIT 15")
_page("x4_nested_sort", lambda ix: Search(ix).sort(Sort("items.quantity"), Sort("key")).page(0, 15).ids(), f"SELECT {_ID} FROM orders LEFT JOIN (SELECT l_orderkey, min(l_quantity) AS p FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey ORDER BY p NULLS LAST, o_orderkey LIMIT 15")
_page("x5_nested_filtered_sort", lambda ix: Search(ix).sort(Sort("items.quantity", descending=True, nested_filter=q.Term("items.flag", "R")), Sort("key")).page(0, 15).ids(), f"SELECT {_ID} FROM orders LEFT JOIN (SELECT l_orderkey, max(l_quantity) AS p FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) ON l_orderkey = o_orderkey ORDER BY p DESC NULLS LAST, o_orderkey LIMIT 15")
_page("x2_missing_first", lambda ix: Search(ix).sort(Sort("parts", missing="_first"), Sort("key")).page(0, 15).ids(), f"SELECT {_ID} FROM orders LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS p FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey ORDER BY p NULLS FIRST, o_orderkey LIMIT 15")
_page("x7_script_sort", lambda ix: Search(ix).sort(Sort("", script="total / (customer + 1)", descending=True)).page(0, 10).ids(), f"SELECT {_ID} FROM orders ORDER BY o_totalprice / (o_custkey + 1) DESC, _id LIMIT 10")
_page("x8_unmapped_type", lambda ix: Search(ix).sort(Sort("nowhere", unmapped_type="long"), Sort("key")).page(0, 7).ids(), f"SELECT {_ID} FROM orders ORDER BY o_orderkey LIMIT 7")
_page("x9_enum_order_sort", lambda ix: Search(ix).sort(*SortBuilder().by(ix.fields.priority.in_order(), None, ix.fields.key.asc()).build()).page(0, 25).hits().select("_id", "priority"), f"SELECT {_ID}, o_orderpriority AS priority FROM orders ORDER BY list_position(['5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH', '1-URGENT'], o_orderpriority), o_orderkey LIMIT 25")
_page("x14_search_after", lambda ix: Search(ix).sort(ix.fields.total.desc(), ix.fields.key.asc()).search_after(150000.0, 10).page(0, 10).ids(), f"SELECT {_ID} FROM orders WHERE o_totalprice < 150000 OR (o_totalprice = 150000 AND o_orderkey > 10) ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
_page("x15_collapse", lambda ix: Search(ix).collapse("priority").sort(ix.fields.total.desc(), ix.fields.key.asc()).hits().select("_id", "priority"), f"SELECT {_ID}, o_orderpriority AS priority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
_page("x16_x17_post_filter_min_score", lambda ix: Search(ix).should(ix.fields.status.eq("F")).should(ix.fields.priority.eq("1-URGENT")).min_score(2.0).post_filter(ix.fields.total.gt(90000)).matched().select("_id"), f"SELECT {_ID} FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_totalprice > 90000")
_page("x20_bool_should_beside_must", lambda ix: Search(ix).filter(ix.fields.status.eq("F")).should(ix.fields.priority.eq("1-URGENT")).must_not(ix.fields.total.lt(50000)).matched().select("_id", "_score"), f"SELECT {_ID}, CAST((o_orderpriority = '1-URGENT')::INT AS DOUBLE) AS _score FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 50000")
_page("x23_ids", lambda ix: Search(ix).query(ix.fields.customer.eq(7)).sort(ix.fields.date.desc()).page(0, 100).ids(), f"SELECT {_ID} FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate DESC, _id LIMIT 100")
_page("x25_get", lambda ix: ix.get("5").select("_id", "total"), f"SELECT {_ID}, o_totalprice AS total FROM orders WHERE o_orderkey = 5")
_page("n4_nested_projection", lambda ix: Search(ix).without_scores().unpaged().project(NestedProjection("items", q.Range("items.quantity", gte=20), (Sort("items.quantity", descending=True), Sort("items.part"), Sort("items.discount")), 0, 2)).hits().select("_id", F.posexplode("items").alias("pos", "i")).selectExpr("_id", "CAST(pos AS BIGINT) AS pos", "i.quantity AS quantity"), f"SELECT {_ID}, n - 1 AS pos, l_quantity AS quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey, l_discount) AS n FROM lineitem WHERE l_quantity >= 20) JOIN orders ON o_orderkey = l_orderkey WHERE n <= 2")
_page("x19_highlight", lambda ix: Search(ix).query(q.Match("priority.text", "urgent low")).unpaged().highlight("priority.text", require_field_match=True).hits().selectExpr("_id", "_highlight['priority.text'][0] AS marked"), f"SELECT {_ID}, CASE o_orderpriority WHEN '1-URGENT' THEN '1-<em>URGENT</em>' ELSE '5-<em>LOW</em>' END AS marked FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
_page("e2_search_body", lambda ix: parse_search(ix, {"query": {"term": {"status": "P"}}, "sort": [{"total": "desc"}, {"key": {"order": "asc"}}], "from": 2, "size": 5, "_source": ["total"]}).hits().select("_id", "total"), f"SELECT {_ID}, o_totalprice AS total FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 5 OFFSET 2")
def _slots(ix: Index, found) -> DataFrame:
    out = [df.select(F.lit(i).cast("long").alias("slot"), "_id") for i, df in enumerate(found)]
    return out[0].unionByName(out[1])


_SLOTS = f"SELECT CAST(0 AS BIGINT) AS slot, {_ID} FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 1, {_ID} FROM orders WHERE o_totalprice > 100000"
_page("u3_msearch", lambda ix: _slots(ix, msearch(Search(ix).query(ix.fields.status.eq("F")).unpaged(), Search(ix).query(ix.fields.total.gt(100000)).unpaged())), _SLOTS)
_page("u4_msearch_all", lambda ix: _slots(ix, msearch_all([Search(ix).query(c).unpaged() for c in (ix.fields.status.eq("F"), ix.fields.total.gt(100000))])), _SLOTS)
_add("m4_map_sort_key", lambda s, d: (ix := _index(s, d, EVENT, "events")) and Search(ix).sort(ix.fields.props.sort_key("none", "k", descending=True), Sort("id")).page(0, 12).ids(), "SELECT CAST(event_id AS VARCHAR) AS _id FROM events ORDER BY coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) DESC, event_id LIMIT 12")


def _union(s: SparkSession, d: str) -> MultiSearch:
    a, b = _index(s, d, ORDER, "orders"), _index(s, d, CUSTOMER, "customers")
    cheap = q.Range("total", lt=20000) | q.Range("balance", lt=0)
    return MultiSearch((Search(a).query(cheap).without_scores(), Search(b).query(cheap).without_scores()), (Sort("total", unmapped_type="double"),)).unpaged()


_add("u1_union", lambda s, d: _union(s, d).hits().select("_index", "_id"), "SELECT 'orders' AS _index, CAST(o_orderkey AS VARCHAR) AS _id FROM orders WHERE o_totalprice < 20000 UNION ALL SELECT 'customers', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal < 0")
_add("u2_union_count", lambda s, d: s.createDataFrame([(_union(s, d).count(),)], "n long"), "SELECT (SELECT count(*) FROM orders WHERE o_totalprice < 20000) + (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS n")
_add("x24_count", lambda s, d: s.createDataFrame([((ix := _index(s, d, ORDER, "orders")) and Search(ix).query(ix.fields.status.eq("F")).min_score(99).page(0, 1).count(),)], "n long"), "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")


# change resolution and maintenance
def _changes(s: SparkSession, d: str, table: str, key: str, before: str = "null") -> DataFrame:
    """A change of every row of a table."""
    return s.read.parquet(f"{d}/{table}.parquet").selectExpr(f"'{table}' AS table", "'upsert' AS op", f"map('{key}', CAST({key} AS STRING)) AS key", f"CAST({before} AS map<string,string>) AS before", "monotonically_increasing_id() AS seq")


_CUST = "SELECT DISTINCT o_custkey AS c_custkey FROM orders JOIN customer ON c_custkey = o_custkey"
for _name, _table, _key, _expr in (
    ("r1_resolve_root", "customer", "c_custkey", "SELECT c_custkey FROM customer"),
    ("r4_resolve_child", "orders", "o_orderkey", _CUST),
    ("r5_resolve_local", "nation", "n_nationkey", "SELECT c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey"),
    ("r3_resolve_two_hops", "region", "r_regionkey", "SELECT c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"),
    ("r3_resolve_grandchild", "lineitem", "l_orderkey", f"{_CUST} WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)"),
):
    _add(_name, lambda s, d, t=_table, k=_key: affected(schema(CUSTOMER, "customers"), registry(s, d), _changes(s, d, t, k)), _expr)
_add("r6_resolve_through_far", lambda s, d: affected(schema(PART, "parts"), registry(s, d), _changes(s, d, "supplier", "s_suppkey")), "SELECT DISTINCT l_partkey AS p_partkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey")
_add("r7_resolve_through_junction", lambda s, d: affected(schema(PART, "parts"), registry(s, d), _changes(s, d, "lineitem", "l_partkey")), "SELECT DISTINCT l_partkey AS p_partkey FROM lineitem")
_add("r11_rebuild_batch", lambda s, d: build_many(schema(CUSTOMER, "customers"), registry(s, d), affected(schema(CUSTOMER, "customers"), registry(s, d), _changes(s, d, "orders", "o_orderkey"))).selectExpr("_id", "op", "doc.orderCount AS n"), "SELECT CAST(c_custkey AS VARCHAR) AS _id, 'upsert' AS op, count(o_orderkey) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
_add("s3_r20_key_change", lambda s, d: split_key_changes(_changes(s, d, "orders", "o_orderkey", "map('o_orderkey', CAST(-1 - o_orderkey AS STRING))")).selectExpr("op", "key['o_orderkey'] AS k"), "SELECT unnest(['delete', 'upsert']) AS op, unnest([CAST(-1 - o_orderkey AS VARCHAR), CAST(o_orderkey AS VARCHAR)]) AS k FROM orders")


def sink_root(spark: SparkSession) -> str:
    """A folder in the shared one that the cluster names, which goes when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    root = f"{base.rstrip('/')}/docweave-sink-{uuid4().hex}"
    atexit.register(_drop, Files(spark, root), root)
    return root


def _drop(files: Files, root: str) -> None:
    try:
        files.delete(root)
    except Exception:  # the session has ended
        pass


_TOTALS = _one("orders", "o_orderkey", _KEYED, {"double": "total", "column": "o_totalprice", "required": True}, {"count": "n", "table": "lineitem", "foreign_key": "l_orderkey"})


def changed_tables(spark: SparkSession, d: str) -> tuple[Registry, DataFrame]:
    """The tables after orders with status P have gone, those with status F cost double and lines returned (R) have gone; and the changes."""
    r = registry(spark, d)
    orders, lines = r.frame("orders"), r.frame("lineitem")
    status = "o_orderstatus"
    gone = orders.where(f"{status} = 'P'").selectExpr("'orders' AS table", "'delete' AS op", "map('o_orderkey', CAST(o_orderkey AS STRING)) AS key")
    dearer = orders.where(f"{status} = 'F'").selectExpr("'orders' AS table", "'upsert' AS op", "map('o_orderkey', CAST(o_orderkey AS STRING)) AS key")
    returned = lines.where("l_returnflag = 'R'").selectExpr("'lineitem' AS table", "'delete' AS op", "map('l_orderkey', CAST(l_orderkey AS STRING)) AS key")
    changes = gone.unionByName(dearer).unionByName(returned).selectExpr("*", "CAST(null AS map<string,string>) AS before", "monotonically_increasing_id() AS seq")
    after = registry(spark, d)
    after.add("orders", orders.where(f"{status} <> 'P'").withColumn("o_totalprice", F.when(F.col(status) == "F", 2 * F.col("o_totalprice")).otherwise(F.col("o_totalprice"))), "o_orderkey")
    return after.add("lineitem", lines.where("l_returnflag <> 'R'")), changes


CHANGED_SQL = "SELECT CAST(o_orderkey AS VARCHAR) AS _id, CASE WHEN o_orderstatus = 'F' THEN 2 * o_totalprice ELSE o_totalprice END AS total, count(l_orderkey) AS n FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag <> 'R') ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' GROUP BY o_orderkey, o_orderstatus, o_totalprice"


def _maintained(spark: SparkSession, d: str) -> DataFrame:
    """Seeds one index, applies a batch after rows have changed, twice as if delivered again, and reads it back."""
    now = {"r": registry(spark, d)}
    sink = ParquetSink(spark, sink_root(spark), "t_")
    m = Maintainer(spark, [_TOTALS], lambda: now["r"], sink)
    m.ensure()
    m.seed()
    now["r"], batch = changed_tables(spark, d)
    m.apply(batch, 1)
    m.apply(batch, 1)
    return sink.read(_TOTALS).select("_id", "total", "n")


_add("k2_k10_r15_maintain_generations", _maintained, CHANGED_SQL)
_add("k5_item_rejection", lambda s, d: rejected(_one("orders", "o_orderkey", _KEYED, {"keyword": "status", "column": "o_orderstatus", "required": True}), registry(s, d).frame("orders").selectExpr("CAST(o_orderkey AS STRING) AS _id", "'upsert' AS op", "struct(o_orderkey AS key, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status) AS doc")), "SELECT CAST(o_orderkey AS VARCHAR) AS _id, '`status` is required' AS reason FROM orders WHERE o_orderstatus = 'P'")
_add("k8_k9_json_envelope", lambda s, d: JsonSink.lines(schema(ORDER, "orders"), build_many(schema(ORDER, "orders"), registry(s, d), _all_keys(s, d)), 1).selectExpr("get_json_object(value, '$.id') AS id", "get_json_object(value, '$.op') AS op", "CAST(get_json_object(value, '$.document.key') AS BIGINT) AS key"), "SELECT CAST(k AS VARCHAR) AS id, CASE WHEN o_orderkey IS NULL THEN 'delete' ELSE 'upsert' END AS op, o_orderkey AS key FROM " + _ASKED + " LEFT JOIN orders ON o_orderkey = k")
_add("v8_yaml_round_trip", lambda s, d: assemble(load_schema(dump_schema(schema(CUSTOMER, "customers")), "customers"), registry(s, d)).selectExpr("id", "orderCount AS n"), "SELECT c_custkey AS id, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


__all__ = ["flagship", "oracle_sql", "queries"]
