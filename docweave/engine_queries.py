"""More registered queries: sources, sinks, maintenance, the rest of a search, schemas and tools."""

from __future__ import annotations

import datetime
import decimal
import enum
import json
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .__main__ import compile_lock, load_lock
from .config import maintainer, parse_config
from .functions import analysis
from .operators import clauses as q
from .operators.dsl import parse
from .operators.handles import TypedMap
from .operators.search import Index, NestedProjection, Search
from .operators.sorting import SCORE, Sort, SortBuilder
from .plans.assemble import assemble, build_many, build_one, preview
from .queries import CHANGED_SQL, CUSTOMER, EVENT, KEYS, ORDER, PART, _TOTALS, _changes, _index, _one, changed_tables, registry, schema, sink_root
from .schema import SchemaError, document_type, parse_schema
from .schema.bindings import bindings, check_bindings
from .schema.mapping import example_document, index_body
from .schema.validate import validate
from .sinks.bulk import BulkSink, Client
from .sinks.store import FanOut, JsonSink, ParquetSink, Sink
from .sinks.trial import FileStore, TrialCluster
from .sources.registry import ForeignKey, is_junction
from .streaming.maintain import Maintainer, TransactionBuffer, lag, log_changes
from .streaming.resolve import affected, missing_tables, typed_keys
from .streaming.serve import metrics, serve

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}
_KEY = {"long": "key", "column": "o_orderkey", "required": True}
_ID = "CAST(o_orderkey AS VARCHAR) AS _id"


def _query(sql: str):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        _queries[f.__name__], _sql[f.__name__] = f, sql
        return f

    return keep


def _orders(s: SparkSession, d: str) -> Index:
    return _index(s, d, ORDER, "orders")


def _order_index(s: SparkSession, d: str, *fields: dict, frame: DataFrame | None = None) -> Index:
    """Orders with other fields than usual."""
    own = _one("orders", "o_orderkey", _KEY, *fields)
    r = registry(s, d)
    if frame is not None:
        r.add("orders", frame, "o_orderkey")
    return Index("orders", assemble(own, r), document_type(own))


def _found(ix: Index, clause: q.Clause) -> DataFrame:
    return Search(ix).query(clause).without_scores().matched().select("_id")


def _values(rows: list[tuple], columns: str) -> str:
    """The rows as SQL."""
    def text(v: object) -> str:
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"CAST({v} AS BIGINT)" if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) v({columns})"


def _raised(f: Callable[[], object]) -> str | None:
    try:
        f()
    except (SchemaError, q.QueryError, ValueError, TypeError, AttributeError) as e:
        return str(e)
    return None


# sources

@_query(CHANGED_SQL)
def s1_r12_r13_live_feed(s: SparkSession, d: str) -> DataFrame:
    """An index seeded, and kept current from a folder of change rows by the stream; a second start finds nothing new to do."""
    now = {"r": registry(s, d)}
    root = sink_root(s)
    m = Maintainer(s, [_TOTALS], lambda: now["r"], ParquetSink(s, f"{root}/sink"))
    m.ensure()
    m.seed()
    now["r"], changes = changed_tables(s, d)
    changes.repartition(3).write.json(f"{root}/feed")
    for _ in range(2):
        m.start(f"{root}/feed", f"{root}/checkpoint", files_per_batch=2).awaitTermination()
    assert m.status.captured == m.status.committed == changes.count()
    return m.sink.read(_TOTALS).select("_id", "total", "n")


@_query("SELECT o_orderkey AS key, o_custkey AS xid, CAST(1000000000 + o_custkey AS BIGINT) AS position FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal >= 0")
def s2_transaction_buffer(s: SparkSession, d: str) -> DataFrame:
    """Each customer's orders are one transaction.  Their commits come a batch later: of customers without debts, the others abort or stay open."""
    orders, customers = registry(s, d).frame("orders"), registry(s, d).frame("customer")
    empty = "CAST(null AS map<string,string>)"
    changes = orders.selectExpr("'change' AS kind", "o_custkey AS xid", "'orders' AS table", "'upsert' AS op", "map('o_orderkey', CAST(o_orderkey AS STRING)) AS key", f"{empty} AS before", "o_orderkey AS seq")
    begins = customers.selectExpr("'begin' AS kind", "c_custkey AS xid", "null AS table", "null AS op", f"{empty} AS key", f"{empty} AS before", "-1L AS seq")
    ends = customers.where("c_acctbal >= 0 OR c_nationkey < 12").selectExpr("CASE WHEN c_acctbal >= 0 THEN 'commit' ELSE 'abort' END AS kind", "c_custkey AS xid", "null AS table", "null AS op", f"{empty} AS key", f"{empty} AS before", "1000000000L + c_custkey AS seq")
    buffer = TransactionBuffer(s, f"{sink_root(s)}/open")
    early = buffer.admit(begins.unionByName(changes), 0)
    late = buffer.admit(ends, 1)
    late = buffer.admit(ends, 1)  # delivered again
    return early.unionByName(late).selectExpr("CAST(key['o_orderkey'] AS BIGINT) AS key", "xid", "seq AS position")


@_query("SELECT o_orderkey, 'bigint' AS kind, 'upsert' AS op FROM orders")
def s4_key_typing(s: SparkSession, d: str) -> DataFrame:
    return typed_keys(registry(s, d), "orders", _changes(s, d, "orders", "o_orderkey")).selectExpr("o_orderkey", "typeof(o_orderkey) AS kind", "op")


@_query("SELECT CAST(c_custkey AS VARCHAR) AS _id, count(o_orderkey) AS n, round(CAST(sum(o_totalprice) AS DOUBLE), 2) AS value FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_custkey = (SELECT max(c_custkey) FROM customer) GROUP BY c_custkey")
def s6_point_read(s: SparkSession, d: str) -> DataFrame:
    last = registry(s, d).frame("customer").agg(F.max("c_custkey")).head()[0]
    return build_one(schema(CUSTOMER, "customers"), registry(s, d), last).selectExpr("_id", "orderCount AS n", "round(CAST(lifetimeValue AS DOUBLE), 2) AS value")


@_query(f"SELECT table_name AS tbl, column_name AS col, (table_name, column_name) IN ({', '.join(repr((t, k)) for t, k in KEYS.items() if k)}) AS is_key FROM information_schema.columns WHERE table_name IN ({', '.join(map(repr, KEYS))})")
def s10_column_metadata(s: SparkSession, d: str) -> DataFrame:
    r = registry(s, d)
    return s.createDataFrame([(t, c, bool(r.key(t)) and c == r.single_key(t)) for t in r.tables for c in r.columns(t)], "tbl string, col string, is_key boolean")


@_query("SELECT max(o_orderkey) - max(o_orderkey) FILTER (o_orderstatus = 'F') AS behind, max(o_orderkey) FILTER (o_orderstatus = 'F') AS position FROM orders")
def s11_lag(s: SparkSession, d: str) -> DataFrame:
    """The feed has a change of every order, at its key; the finished ones are committed."""
    r = registry(s, d)
    feed = r.frame("orders").selectExpr("'orders' AS table", "'upsert' AS op", "map('o_orderkey', CAST(o_orderkey AS STRING)) AS key", "CAST(null AS map<string,string>) AS before", "o_orderkey AS seq", "o_orderstatus")
    m = Maintainer(s, [_one("orders", "o_orderkey", _KEY)], lambda: r, JsonSink(f"{sink_root(s)}/out"))
    assert lag(m.status, None) is None
    m.apply(feed.where("o_orderstatus = 'F'"), 0)
    newest = feed.agg(F.max("seq")).head()[0]
    return s.createDataFrame([(lag(m.status, newest), m.status.position)], "behind long, position long")


@_query(_values([("customers", "lineitem"), ("customers", "nation"), ("customers", "region"), ("parts", "lineitem"), ("parts", "part"), ("parts", "supplier")], "idx, tbl"))
def s12_coverage(s: SparkSession, d: str) -> DataFrame:
    missing = missing_tables([schema(CUSTOMER, "customers"), schema(PART, "parts"), schema(EVENT, "events")], {"customer", "orders", "events"})
    return s.createDataFrame([(i, t) for i, tables in missing.items() for t in tables], "idx string, tbl string")


_FILE = """
version = 1
schemas = ["events.yml"]
[source]
kind = "parquet"
folder = {folder}
keys = {{events = "event_id"}}
[sink]
path = {sink}
prefix = "p_"
[run]
on_reject = "skip"
"""


@_query("SELECT CAST(event_id AS VARCHAR) AS _id, event_type AS kind, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def s13_v11_deployed_config(s: SparkSession, d: str) -> DataFrame:
    """A deployment from its TOML file; the schema has gone through a lock file and back."""
    root = sink_root(s)
    config = parse_config(_FILE.format(folder=json.dumps(d), sink=json.dumps(root)), {"events.yml": EVENT}.__getitem__)
    assert load_lock(compile_lock(list(config.schemas))) == list(config.schemas)
    m = maintainer(s, config)
    m.ensure()
    m.seed()
    return m.sink.read(config.schemas[0]).selectExpr("_id", "kind", "props['k'] AS k")


# sinks

@_query(f"SELECT sink, {_ID}, o_totalprice AS total FROM orders, (VALUES ('parquet'), ('stdout')) v(sink)")
def k1_k7_fan_out(s: SparkSession, d: str) -> DataFrame:
    r, root = registry(s, d), sink_root(s)
    parquet = ParquetSink(s, f"{root}/a")
    m = Maintainer(s, [_TOTALS], lambda: r, FanOut(parquet, JsonSink(f"{root}/b")))
    m.ensure()
    m.seed()
    lines = s.read.text(f"{root}/b/orders/batch=0").selectExpr("'stdout' AS sink", "get_json_object(value, '$.id') AS _id", "CAST(get_json_object(value, '$.document.total') AS DOUBLE) AS total")
    return parquet.read(_TOTALS).selectExpr("'parquet' AS sink", "_id", "total").unionByName(lines)


@_query(f"SELECT {_ID}, o_totalprice AS total, true AS bounded, CAST(2 AS BIGINT) AS tried_again, CAST(2 AS BIGINT) AS generation FROM orders")
def k3_k4_k12_bulk_sink(s: SparkSession, d: str) -> DataFrame:
    """All orders through the bulk interface of a stand-in cluster that fails twice; a reindex that broke off has left generation 1."""
    r = registry(s, d)
    store = FileStore(s, sink_root(s))
    with TrialCluster(s.conf.get("spark.driver.host"), fail=2, keep=store) as cluster:
        sink = BulkSink(Client(cluster.url), "t_", batch_size=500, max_bytes=40_000)
        m = Maintainer(s, [_TOTALS], lambda: r, sink)
        m.ensure()
        m.seed()
        cluster.indexes[f"{sink.alias(_TOTALS)}_1"] = {}
        m.reindex()
        held = cluster.aliases[sink.alias(_TOTALS)]
        bounded = all(n <= 500 and size <= 40_000 for n, size in cluster.requests)
    total = F.get_json_object("doc", "$.total").cast("double").alias("total")
    facts = (F.lit(bounded).alias("bounded"), F.lit(cluster.failed).cast("long").alias("tried_again"), F.lit(int(held.rpartition("_")[2])).cast("long").alias("generation"))
    return store.read(held).select("_id", total, *facts)


@_query(f"SELECT {_ID}, CASE WHEN o_orderstatus = 'P' THEN 'quarantined' ELSE 'written' END AS went FROM orders")
def k6_failure_policy(s: SparkSession, d: str) -> DataFrame:
    own = _one("orders", "o_orderkey", _KEY, {"keyword": "status", "column": "o_orderstatus", "required": True})
    r, root = registry(s, d), sink_root(s)
    r.add("orders", r.frame("orders").withColumn("o_orderstatus", F.expr("nullif(o_orderstatus, 'P')")), "o_orderkey")
    stopped = Maintainer(s, [own], lambda: r, JsonSink(f"{root}/none"))
    assert "is rejected" in str(_error(stopped.seed))
    sink = ParquetSink(s, f"{root}/sink")
    m = Maintainer(s, [own], lambda: r, sink, on_reject="stop", on_reject_for={"orders": "skip"}, quarantine=f"{root}/bad")
    m.ensure()
    m.seed()
    return sink.read(own).selectExpr("_id", "'written' AS went").unionByName(s.read.parquet(f"{root}/bad/orders/batch=0").selectExpr("_id", "'quarantined' AS went"))


def _error(f: Callable[[], object]) -> Exception | None:
    try:
        f()
    except Exception as e:
        return e
    return None


@_query(f"""SELECT phase, count(*) AS n, round(sum(total), 2) AS total, generation, prefixed FROM (
  SELECT 'staged' AS phase, o_totalprice AS total, CAST(0 AS BIGINT) AS generation, true AS prefixed FROM orders
  UNION ALL SELECT 'swapped', total, 1, true FROM ({CHANGED_SQL})) GROUP BY ALL""")
def k11_k12_k14_generations(s: SparkSession, d: str) -> DataFrame:
    """Readers keep the old generation while a new one is written, until one state takes its place."""
    now = {"r": registry(s, d)}
    sink = ParquetSink(s, sink_root(s), "own_")
    m = Maintainer(s, [_TOTALS], lambda: now["r"], sink)
    m.ensure()
    m.seed()
    now["r"], _ = changed_tables(s, d)
    out = []

    def note(phase: str) -> None:
        r = sink.read(_TOTALS).agg(F.count(F.lit(1)), F.round(F.sum("total"), 2)).head()
        names = sink.files.folders(sink.root)
        out.append((phase, r[0], r[1], sink.state(_TOTALS)["active"], bool(names) and all(n.startswith("own_") for n in names)))

    sink.reindex(_TOTALS)
    docs = assemble(_TOTALS, now["r"])
    sink.write(_TOTALS, docs.select("_id", F.lit("upsert").alias("op"), F.struct(*(f.name for f in _TOTALS.fields)).alias("doc")), 0)
    note("staged")
    sink.mark_seeded(_TOTALS)
    note("swapped")
    return s.createDataFrame(out, "phase string, n long, total double, generation long, prefixed boolean")


@_query(_values([("customer", "long"), ("date", "date"), ("items", "nested"), ("items.discount", "double"), ("items.flag", "keyword"), ("items.part", "long"), ("items.quantity", "double"), ("key", "long"), ("parts", "long"), ("priority", "keyword"), ("status", "keyword"), ("total", "double")], "path, kind"))
def k13_v4_mapping(s: SparkSession, d: str) -> DataFrame:
    def walk(properties: dict, above: str = ""):
        for name, p in properties.items():
            yield f"{above}{name}", p["type"]
            yield from walk(p.get("properties", {}), f"{above}{name}.")

    return s.createDataFrame(list(walk(index_body(schema(ORDER, "orders"))["mappings"]["properties"])), "path string, kind string")


class _Noted(Sink):
    """Keeps whether each batch was written as the last one waiting, and how many documents it had."""

    def __init__(self) -> None:
        self.batches: list[tuple[int, bool, int]] = []

    def write(self, schema, batch: DataFrame, number: int, caught_up: bool = True) -> None:
        self.batches.append((number, caught_up, batch.count()))


@_query("SELECT CAST(i AS BIGINT) AS batch, i = 2 AS refreshed, CAST(CASE WHEN i < 2 THEN n // 3 + 1 ELSE n - 2 * (n // 3 + 1) END AS BIGINT) AS documents FROM (SELECT count(*) AS n FROM orders), (VALUES (0), (1), (2)) v(i)")
def k15_r9_r14_windows_and_refresh(s: SparkSession, d: str) -> DataFrame:
    """A change of every order, in batches of a third of them; what is written becomes visible at once only with the last."""
    r, noted = registry(s, d), _Noted()
    m = Maintainer(s, [_one("orders", "o_orderkey", _KEY)], lambda: r, noted)
    changes = _changes(s, d, "orders", "o_orderkey")
    m.apply_windows(changes, 0, changes.count() // 3 + 1)
    return s.createDataFrame([(n - 1, last, docs) for n, last, docs in noted.batches], "batch long, refreshed boolean, documents long")


# documents

@_query("SELECT o_orderkey AS key, o_orderstatus AS status, o_custkey AS customer, 60 * o_totalprice AS total, CAST(60 AS BIGINT) AS n_fields FROM orders")
def p6_p14_objects(s: SparkSession, d: str) -> DataFrame:
    """An object in an object, and one of sixty fields."""
    wide = {"object": "wide", "fields": [{"double": f"f{i}", "column": "o_totalprice", "required": True} for i in range(60)]}
    own = _one("orders", "o_orderkey", _KEY, {"object": "a", "fields": [{"keyword": "status", "column": "o_orderstatus", "required": True}, {"object": "b", "fields": [{"long": "customer", "column": "o_custkey", "required": True}]}]}, wide)
    docs = assemble(own, registry(s, d))
    return docs.select("key", "a.status", "a.b.customer", F.lit(60 * 1.0).alias("n") * F.col("wide.f59"), F.lit(len(docs.schema["wide"].dataType.names)).cast("long").alias("n_fields")).toDF("key", "status", "customer", "total", "n_fields")


@_query("SELECT o_orderkey AS key, coalesce(lpad(CAST(list_position(['5-LOW', '3-MEDIUM', '1-URGENT'], o_orderpriority) - 1 AS VARCHAR), 2, '0'), '999' || o_orderpriority) AS rank FROM orders")
def p11_enum_rank(s: SparkSession, d: str) -> DataFrame:
    ix = _order_index(s, d, {"enum": "priority", "column": "o_orderpriority", "required": True, "variants": ["5-LOW", "3-MEDIUM", "1-URGENT"]})
    return ix.frame.select("key", q.Scope(ix.type).values("priority.sort")[0].alias("rank"))


@_query("SELECT o_orderkey AS key, CAST(o_totalprice AS VARCHAR) AS total, 'keyword' AS kind FROM orders")
def p12_custom_type(s: SparkSession, d: str) -> DataFrame:
    own = _one("orders", "o_orderkey", _KEY, {"custom": "total", "column": "o_total", "required": True, "postgres": ["money"], "opensearch": "keyword"})
    r = registry(s, d)
    r.add("orders", r.frame("orders").withColumn("o_total", F.col("o_totalprice").cast("string")), "o_orderkey")
    kind = index_body(own)["mappings"]["properties"]["total"]["type"]
    return assemble(own, r).select("key", "total", F.lit(kind).alias("kind"))


@_query(_values([("a relation below a row of several key columns", True), ("a junction to a table of several key columns", True), ("a relation of one key column", False)], "relation, refused"))
def j6_j7_key_requirements(s: SparkSession, d: str) -> DataFrame:
    many = {"has_many": "items", "table": "lineitem", "primary_key": "l_linenumber", "foreign_key": "l_orderkey", "fields": [{"long": "part", "column": "l_partkey", "required": True}]}
    through = _one("part", "p_partkey", {"count": "n", "table": "supplier", "through": {"table": "lineitem", "left_key": "l_partkey", "right_key": "l_suppkey"}})
    bad = registry(s, d)
    bad.add("supplier", bad.frame("supplier"), ("s_suppkey", "s_nationkey"))
    cases = [("a relation below a row of several key columns", lambda: parse_schema({"version": 1, "table": "orders", "primary_key": ["o_orderkey", "o_custkey"], "fields": [many]}, "o")), ("a junction to a table of several key columns", lambda: assemble(through, bad)), ("a relation of one key column", lambda: assemble(_one("orders", "o_orderkey", many), registry(s, d)))]
    return s.createDataFrame([(name, _raised(f) is not None) for name, f in cases], "relation string, refused boolean")


@_query("SELECT c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey UNION SELECT o_custkey FROM orders JOIN customer ON c_custkey = o_custkey")
def j8_r2_r8_reverse_joins(s: SparkSession, d: str) -> DataFrame:
    """Changes of every row of every other table at once, and orders that have lost their customer: each root once, none null."""
    r = registry(s, d)
    orders = r.frame("orders")
    r.add("orders", orders.unionByName(orders.withColumn("o_custkey", F.lit(None).cast("long")).withColumn("o_orderkey", -1 - F.col("o_orderkey"))), "o_orderkey")
    changes = _changes(s, d, "orders", "o_orderkey").unionByName(r.frame("orders").where("o_custkey is null").selectExpr("'orders' AS table", "'upsert' AS op", "map('o_orderkey', CAST(o_orderkey AS STRING)) AS key", "CAST(null AS map<string,string>) AS before", "0L AS seq"))
    for table, key in (("lineitem", "l_orderkey"), ("nation", "n_nationkey"), ("region", "r_regionkey")):
        changes = changes.unionByName(_changes(s, d, table, key))
    return affected(schema(CUSTOMER, "customers"), r, changes)


@_query("SELECT c_custkey AS id, count(o_orderkey) AS n, min(o_totalprice) AS least FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice > 50000) ON o_custkey = c_custkey GROUP BY c_custkey")
def a8_direct_keyed_aggregate(s: SparkSession, d: str) -> DataFrame:
    filters = [{"column": "o_orderstatus", "op": "neq", "value": "F"}, {"column": "o_totalprice", "op": "gt", "value": 50000}]
    own = _one("customer", "c_custkey", {"long": "id", "column": "c_custkey", "required": True}, {"count": "n", "table": "orders", "foreign_key": "o_custkey", "filters": filters}, {"min": "least", "table": "orders", "column": "o_totalprice", "value_type": "double", "foreign_key": "o_custkey", "filters": filters})
    return assemble(own, registry(s, d)).select("id", "n", "least")


# maintenance

@_query(f"SELECT {_ID}, CAST(1 AS BIGINT) AS times FROM orders")
def r10_batch_dedup(s: SparkSession, d: str) -> DataFrame:
    """Each order changed itself, by each of its lines, and twice more: built once."""
    own = _one("orders", "o_orderkey", _KEY, {"count": "n", "table": "lineitem", "foreign_key": "l_orderkey"})
    r, root = registry(s, d), sink_root(s)
    m = Maintainer(s, [own], lambda: r, JsonSink(root))
    one = _changes(s, d, "orders", "o_orderkey")
    m.apply(one.unionByName(one).unionByName(one).unionByName(_changes(s, d, "lineitem", "l_orderkey")), 0)
    return s.read.text(f"{root}/orders/batch=1").selectExpr("get_json_object(value, '$.id') AS _id").groupBy("_id").agg(F.count(F.lit(1)).alias("times"))


@_query("SELECT what, n FROM (SELECT count(*) AS n FROM orders) o, (VALUES ('captured'), ('committed'), ('docweave_changes_captured_total'), ('docweave_changes_committed_total')) v(what) UNION ALL " + _values([("indexes_ensured", 1), ("docweave_documents_quarantined_total", 0), ("docweave_changes_in_flight", 0), ("docweave_live", 1), ('docweave_index_seeded{index="orders"}', 0)], "what, n"))
def r16_r17_r18_r19_events_and_metrics(s: SparkSession, d: str) -> DataFrame:
    """Indexes are ensured at the start, seeding is skipped, a change of every order is applied: what observers and metrics say."""
    r, seen = registry(s, d), []
    m = Maintainer(s, [_one("orders", "o_orderkey", _KEY)], lambda: r, JsonSink(sink_root(s)), observers=[lambda event, facts: seen.append((event, int(facts.get("changes", 1))))])
    m.ensure()
    m.seed(skip=True)
    m.apply(_changes(s, d, "orders", "o_orderkey"), 0)
    told = [line.rsplit(" ", 1) for line in metrics(m.status).splitlines() if not line.startswith("#")]
    return s.createDataFrame(seen + [(name, int(v)) for name, v in told], "what string, n long")


@_query("SELECT 'orders' AS tbl, 'upsert' AS op, CAST(o_orderkey AS VARCHAR) AS k FROM orders")
def r21_truncate_is_not_propagated(s: SparkSession, d: str) -> DataFrame:
    """A log with an insert of every order, and truncates of every table between them."""
    orders = registry(s, d).frame("orders")
    inserts = orders.select(F.to_json(F.struct(F.lit("insert").alias("kind"), F.lit("orders").alias("table"), F.array(F.lit("o_orderkey")).alias("columnnames"), F.array(F.col("o_orderkey").cast("string")).alias("columnvalues"), F.array(F.lit("o_orderkey")).alias("keynames"), F.col("o_orderkey").alias("lsn"))).alias("value"))
    truncates = s.createDataFrame([(json.dumps({"kind": "truncate", "table": t}),) for t in KEYS], "value string")
    return log_changes(inserts.unionByName(truncates)).selectExpr("table AS tbl", "op", "key['o_orderkey'] AS k")


@_query("SELECT _id, step, op FROM (SELECT CAST(o_orderkey AS VARCHAR) AS _id, CASE o_orderstatus WHEN 'F' THEN 'delete' WHEN 'P' THEN 'delete' ELSE 'upsert' END AS op, 'gone' AS step FROM orders UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'upsert', 'restored' FROM orders)")
def r22_soft_delete_and_filter_exit(s: SparkSession, d: str) -> DataFrame:
    """Orders with status F are deleted softly, those with P leave the filter: tombstones; then both come back."""
    own = _one("orders", "o_orderkey", _KEY, filters=[{"column": "o_kept", "op": "eq", "value": True}], soft_delete={"column": "o_deleted"})
    gone, back = registry(s, d), registry(s, d)
    orders = gone.frame("orders")
    gone.add("orders", orders.selectExpr("*", "o_orderstatus <> 'P' AS o_kept", "CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS o_deleted"), "o_orderkey")
    back.add("orders", orders.selectExpr("*", "true AS o_kept", "CAST(null AS timestamp) AS o_deleted"), "o_orderkey")
    keys = orders.select("o_orderkey")
    return build_many(own, gone, keys).select("_id", F.lit("gone").alias("step"), "op").unionByName(build_many(own, back, keys).select("_id", F.lit("restored").alias("step"), "op"))


# the query surface

@_query(f"SELECT {_ID} FROM orders WHERE o_orderdate >= TIMESTAMP '1997-02-01' AND o_orderdate < TIMESTAMP '1998-03-01'")
def q17_range_date_relation(s: SparkSession, d: str) -> DataFrame:
    return _found(_orders(s, d), parse({"range": {"date": {"gte": "01.02.1997", "lt": "01.03.1998", "format": "dd.MM.yyyy", "relation": "intersects"}}}))


@_query(_values([("brand.keyword", True), ("name.keyword", True), ("name.text", False), ("size.keyword", False), ("type.text", True), ("type.keyword", False)], "subfield, offered"))
def q20_subfield_gating(s: SparkSession, d: str) -> DataFrame:
    fields = _index(s, d, PART, "parts").fields
    cases = [("brand", "keyword"), ("name", "keyword"), ("name", "text"), ("size", "keyword"), ("type", "text"), ("type", "keyword")]
    return s.createDataFrame([(f"{f}.{sub}", _raised(lambda f=f, sub=sub: getattr(fields[f], sub)()) is None) for f, sub in cases], "subfield string, offered boolean")


@_query(f"SELECT {_ID} FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def q21_object_handle(s: SparkSession, d: str) -> DataFrame:
    ix = _order_index(s, d, {"object": "more", "fields": [{"keyword": "status", "column": "o_orderstatus", "required": True}, {"double": "total", "column": "o_totalprice", "required": True}]})
    more = ix.fields.more
    return _found(ix, more.exists() & more.status.eq("F") & more.total.gt(100000))


@_query(f"SELECT {_ID} FROM orders WHERE o_orderstatus <> 'F'")
def q22_binary_handle(s: SparkSession, d: str) -> DataFrame:
    frame = registry(s, d).frame("orders").withColumn("o_raw", F.expr("CASE WHEN o_orderstatus <> 'F' THEN CAST(o_orderpriority AS BINARY) END"))
    ix = _order_index(s, d, {"binary": "raw", "column": "o_raw", "required": False}, frame=frame)
    return _found(ix, ix.fields.raw.exists())


@_query("SELECT CAST(event_id AS VARCHAR) AS _id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 50 AND 80 AND CAST(json_extract(props, '$.k') AS BIGINT) <> 60")
def q23_e3_json_raw_clause(s: SparkSession, d: str) -> DataFrame:
    own = _one("events", "event_id", {"long": "id", "column": "event_id", "required": True}, {"json": "props", "required": False})
    ix = Index("events", assemble(own, registry(s, d)), document_type(own))
    props = ix.fields.props
    return _found(ix, props.exists() & props.raw({"bool": {"must": [{"range": {"props.k": {"gte": 50, "lte": 80}}}], "must_not": [{"term": {"props.k": 60}}]}}))


@_query("SELECT p_partkey AS key, array_to_string(string_split(lower(p_name), ' '), '|') AS name, concat('brand#', n, '|brand', n, '|brand|', n) AS brand, lower(p_name) AS whole FROM (SELECT *, split_part(p_brand, '#', 2) AS n FROM part)")
def t11_analyzers(s: SparkSession, d: str) -> DataFrame:
    part = registry(s, d).frame("part")
    return part.select(F.col("p_partkey").alias("key"), *(F.array_join(analysis.tokens(F.col(c), how), "|").alias(out) for c, how, out in (("p_name", "text", "name"), ("p_brand", "code", "brand"), ("p_name", "lowercase", "whole"))))


@_query("SELECT CAST(p_partkey AS VARCHAR) AS _id FROM part WHERE p_partkey % 2 = 0")
def t12_subfield_provisioning(s: SparkSession, d: str) -> DataFrame:
    """Names of odd parts are too long for the keyword subfields."""
    own = schema(PART, "parts")
    r = registry(s, d)
    r.add("part", r.frame("part").withColumn("p_name", F.expr("CASE WHEN p_partkey % 2 = 1 THEN repeat(p_name, 60) ELSE p_name END")), "p_partkey")
    assert set(index_body(own)["mappings"]["properties"]["name"]["fields"]) == {"keyword", "keyword_lowercase"}
    ix = Index("parts", assemble(own, r), document_type(own))
    return _found(ix, q.Exists("name.keyword") & q.Exists("name.keyword_lowercase") & q.Exists("brand"))


@_query(f"SELECT {_ID}, CAST((o_orderstatus = 'F')::INT + 2 * (o_orderpriority = '1-URGENT')::INT AS DOUBLE) AS score FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '1-URGENT' ORDER BY score DESC, _id LIMIT 50")
def x6_score_sort(s: SparkSession, d: str) -> DataFrame:
    ix = _orders(s, d)
    return Search(ix).query(ix.fields.status.eq("F") | ix.fields.priority.eq("1-URGENT").boosted(2)).sort(SCORE).page(0, 50).hits().select("_id", F.col("_score").alias("score"))


@_query("SELECT CAST(p_partkey AS VARCHAR) AS _id, p_name AS name FROM part ORDER BY lower(p_name) DESC, p_partkey LIMIT 40")
def x10_text_sort(s: SparkSession, d: str) -> DataFrame:
    ix = _index(s, d, PART, "parts")
    return Search(ix).sort(ix.fields.name.desc(), ix.fields.key.asc()).page(0, 40).hits().select("_id", "name")


@_query(f"SELECT {_ID} FROM orders ORDER BY o_orderstatus DESC, o_totalprice / (o_custkey + 1), o_orderdate, o_orderkey LIMIT 30")
def x11_x12_sort_builder(s: SparkSession, d: str) -> DataFrame:
    """The first key for a field wins, None is passed over, scripts always stay, the default only fills an empty list."""
    ix = _orders(s, d)
    o = ix.fields
    keys = SortBuilder().by(o.status.desc(), None, o.status.asc()).score(when=False).script("total / (customer + 1)").by(o.date.asc()).tiebreak(o.key.asc()).or_default(o.total.desc())
    assert SortBuilder().or_default(o.total.desc()).build() == (o.total.desc(),)
    return Search(ix).sort(*keys.build()).page(0, 30).ids()


@_query("SELECT count(*) AS total, least(100, count(*)) AS capped, CAST(0 AS BIGINT) AS untracked, CAST(10 AS BIGINT) AS page, false AS timed_out, max(o_totalprice) AS best FROM orders WHERE o_orderstatus = 'F'")
def x18_x22_x26_send(s: SparkSession, d: str) -> DataFrame:
    ix = _orders(s, d)
    found = Search(ix).query(q.ScriptScore(ix.fields.status.eq("F"), "total", {}))
    full, capped, without = found.send(), found.send(track_total=100, timeout=3600.0), found.send(track_total=False)
    return s.createDataFrame([(full["total"], capped["total"], without["total"] or 0, len(full["hits"]), capped["timed_out"], full["max_score"])], "total long, capped long, untracked long, page long, timed_out boolean, best double")


@_query(f"SELECT 'raw' AS body, {_ID} FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'bool', {_ID} FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'all', {_ID} FROM orders")
def x21_body_default(s: SparkSession, d: str) -> DataFrame:
    """A raw body comes before the clauses, and these before matching all."""
    ix = _orders(s, d)
    some = Search(ix).query(ix.fields.status.eq("F")).without_scores()
    each = {"raw": some.raw_query({"term": {"status": "P"}}), "bool": some, "all": Search(ix).without_scores()}
    raw, clauses, every = (x.matched().select(F.lit(name).alias("body"), "_id") for name, x in each.items())
    return raw.unionByName(clauses).unionByName(every)


@_query("SELECT CAST(o_orderkey AS VARCHAR) AS _id, n - 1 AS pos, l_quantity AS quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey, l_discount) AS n FROM lineitem WHERE l_quantity >= 20) JOIN orders ON o_orderkey = l_orderkey WHERE n <= 2")
def n4_projection_inside_an_object(s: SparkSession, d: str) -> DataFrame:
    items = next(f for f in schema_fields(ORDER) if f.get("has_many") == "items")
    ix = _order_index(s, d, {"object": "more", "fields": [items]})
    path = "more.items"
    p = NestedProjection(path, q.Range(f"{path}.quantity", gte=20), (Sort(f"{path}.quantity", descending=True), Sort(f"{path}.part"), Sort(f"{path}.discount")), 0, 2)
    return Search(ix).without_scores().unpaged().project(p).hits().select("_id", F.posexplode("more.items").alias("pos", "i")).selectExpr("_id", "CAST(pos AS BIGINT) AS pos", "i.quantity AS quantity")


def schema_fields(text: str) -> list[dict]:
    import yaml

    return yaml.safe_load(text)["fields"]


@_query(_values([("items.quantity inside items", None), ("total inside items", "`total` is not inside `items`"), ("status inside items", "`status` is not inside `items`"), ("props.k inside props", None), ("id inside props", "`id` is not inside `props`")], "clause, refused"))
def n5_scope_typing(s: SparkSession, d: str) -> DataFrame:
    items = _orders(s, d).fields["items"]
    own = _one("events", "event_id", {"long": "id", "column": "event_id", "required": True}, {"json": "props", "required": False})
    props = Index("events", assemble(own, registry(s, d)), document_type(own)).fields.props
    cases = [("items.quantity inside items", lambda: items.any(q.Range("items.quantity", gt=1))), ("total inside items", lambda: items.any(q.Range("items.quantity", gt=1) & q.Range("total", gt=1))), ("status inside items", lambda: items.all(~q.Term("status", "F"))), ("props.k inside props", lambda: props.raw(q.Term("props.k", 1))), ("id inside props", lambda: props.raw({"term": {"id": 1}}))]
    return s.createDataFrame([(name, _raised(f)) for name, f in cases], "clause string, refused string")


class _Status(enum.Enum):
    FINISHED = "F"


@_query(f"SELECT {_ID} FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 50000.5 AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'")
def e7_typed_values(s: SparkSession, d: str) -> DataFrame:
    ix = _orders(s, d)
    o = ix.fields
    assert TypedMap({"a": decimal.Decimal("1.5"), "b": uuid.UUID(int=0)}) == {"a": "1.5", "b": str(uuid.UUID(int=0))} and _raised(lambda: TypedMap({"a": 1, "b": "x"}))
    return _found(ix, o.status.eq(_Status.FINISHED) & o.total.gte(decimal.Decimal("50000.5")) & o.date.gte(datetime.datetime(1996, 1, 1)) & o.date.lt(datetime.date(1999, 1, 1)))


# schemas and tools

_BAD = (
    ({"keyword": "a"}, "required"), ({"keywrd": "a", "required": True}, "keyword"), ({"keyword": "a", "text": "b", "required": True}, "more than one"), ({"keyword": "a", "required": True, "colum": "x"}, "did you mean `column`"),
    ({"count": "a", "table": "t"}, "either"), ({"sum": "a", "table": "t", "foreign_key": "c"}, "column"), ({"ids": "a", "table": "t", "foreign_key": "c", "column": "x"}, "element_type"), ({"geo": "a", "required": True, "lat": "x"}, "either"), ({"map": "a", "values": "json", "required": True}, "map values"), ({"keyword": "a", "required": True, "transforms": ["upper"]}, "transform"),
)


@_query(_values([(i, True) for i in range(len(_BAD))], "i, told"))
def v1_v2_v3_schema_errors(s: SparkSession, d: str) -> DataFrame:
    """Each wrong field is refused with a message that names what is wrong, or the nearest key."""
    told = [(i, word in (_raised(lambda f=f: _one("t", "id", f)) or "")) for i, (f, word) in enumerate(_BAD)]
    return s.createDataFrame(told, "i long, told boolean")


@_query(_values([("error", "name"), ("error", "nope"), ("error", "a"), ("error", "c"), ("warning", "id")], "level, path"))
def v5_live_validation(s: SparkSession, d: str) -> DataFrame:
    bad = _one("customer", "c_custkey", {"long": "id", "column": "c_custkey", "required": True}, {"integer": "name", "column": "c_name", "required": False}, {"keyword": "nope", "required": False}, {"avg": "a", "table": "orders", "column": "o_orderstatus", "foreign_key": "o_custkey"}, {"count": "c", "table": "missing", "foreign_key": "x"})
    return s.createDataFrame([(x.level, x.path) for x in validate(bad, registry(s, d))], "level string, path string")


@_query(_values([("lineitem", False), ("orders", False), ("sold", True)], "tbl, junction"))
def v6_junction_detection(s: SparkSession, d: str) -> DataFrame:
    r = registry(s, d)
    links = (ForeignKey("l_partkey", "part", "p_partkey"), ForeignKey("l_suppkey", "supplier", "s_suppkey"))
    r.add("sold", r.frame("lineitem").select("l_partkey", "l_suppkey").distinct(), ("l_partkey", "l_suppkey"), links)
    r.add("lineitem", r.frame("lineitem"), ("l_orderkey", "l_linenumber"), links)
    return s.createDataFrame([(t, is_junction(r.tables[t])) for t in ("lineitem", "orders", "sold")], "tbl string, junction boolean")


@_query("SELECT CAST(o_orderkey AS VARCHAR) AS _id, o_orderkey AS key, o_orderstatus AS status, count(l_orderkey) AS n_items FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey IN ((SELECT min(o_orderkey) FROM orders), (SELECT max(o_orderkey) FROM orders)) GROUP BY o_orderkey, o_orderstatus")
def v7_preview(s: SparkSession, d: str) -> DataFrame:
    """The first order there is, and the last by its key, as JSON; the made-up one has the same fields."""
    own, r = schema(ORDER, "orders"), registry(s, d)
    last = r.frame("orders").agg(F.max("o_orderkey")).head()[0]
    assert list(example_document(own)) == [f.name for f in own.fields]
    both = preview(own, r).unionByName(preview(own, r, last))
    return both.selectExpr("_id", "CAST(get_json_object(document, '$.key') AS BIGINT) AS key", "get_json_object(document, '$.status') AS status", "CAST(coalesce(json_array_length(get_json_object(document, '$.items')), 0) AS BIGINT) AS n_items")


@_query(_values([("customer", "Value"), ("date", "Value"), ("items", "OrdersItemsFields"), ("key", "Value"), ("parts", "Keyword"), ("priority", "Keyword"), ("status", "Keyword"), ("total", "Value"), ("items.discount", "Value"), ("items.flag", "Keyword"), ("items.part", "Value"), ("items.quantity", "Value")], "field, handle"))
def v9_v10_typed_bindings(s: SparkSession, d: str) -> DataFrame:
    """The generated module's declarations; it fits the schema it was written from and no other."""
    source = bindings(schema(ORDER, "orders"))
    check_bindings(source, schema(ORDER, "orders"))
    assert _raised(lambda: check_bindings(source, schema(PART, "parts")))
    module: dict = {}
    exec(compile(source, "bindings", "exec"), module)
    told = [(above + name, kind) for c, above in (("OrdersFields", ""), ("OrdersItemsFields", "items.")) for name, kind in module[c].__annotations__.items()]
    return s.createDataFrame(told, "field string, handle string")


@_query("SELECT request, code, n FROM (SELECT count(*) AS m FROM orders) o, (VALUES ('GET healthz', 200, 0), ('GET readyz', 200, 0), ('GET status', 200, 1), ('GET metrics', 200, 1), ('GET indexes', 200, 0), ('POST indexes/orders/reindex', 202, 0), ('POST indexes/none/reindex', 404, 0), ('GET nowhere', 404, 0)) v(request, code, told), LATERAL (SELECT told * m AS n) x")
def v12_http_status(s: SparkSession, d: str) -> DataFrame:
    """A maintainer that has applied a change of every order, asked over HTTP; n: the captured changes it tells."""
    r = registry(s, d)
    m = Maintainer(s, [_one("orders", "o_orderkey", _KEY)], lambda: r, ParquetSink(s, sink_root(s)))
    m.ensure()
    m.seed()
    m.apply(_changes(s, d, "orders", "o_orderkey"), 0)
    server, out = serve(m), []
    try:
        for request in ("GET healthz", "GET readyz", "GET status", "GET metrics", "GET indexes", "POST indexes/orders/reindex", "POST indexes/none/reindex", "GET nowhere"):
            method, path = request.split()
            try:
                with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.server_port}/{path}", method=method)) as a:
                    code, body = a.status, a.read().decode()
            except urllib.error.HTTPError as e:
                code, body = e.code, ""
            n = json.loads(body)["captured"] if path == "status" else next(int(x.split()[1]) for x in body.splitlines() if x.startswith("docweave_changes_captured_total")) if path == "metrics" else 0
            out.append((request, code, n))
    finally:
        server.shutdown()
        server.server_close()
    return s.createDataFrame(out, "request string, code int, n long")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


__all__ = ["oracle_sql", "queries"]
