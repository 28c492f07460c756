from __future__ import annotations

import datetime as dt
import json
import random
from decimal import Decimal

import pytest
from hypothesis import given, settings, strategies as st

from docweave.functions import analysis, rows
from docweave.operators import clauses as q
from docweave.operators.dsl import parse, parse_search
from docweave.operators.handles import fields
from docweave.operators.search import Index, MultiSearch, NestedProjection, Search
from docweave.operators.sorting import Sort, SortBuilder
from docweave.operators.syntax import query_string, simple_query_string
from docweave.plans.assemble import assemble, build_many, sample_document
from docweave.schema import SchemaError, content_hash, document_type, dump_schema, index_body, load_schema, parse_schema
from docweave.schema.mapping import example_document
from docweave.schema.parse import parse_filter, schema_dict
from docweave.schema.validate import validate
from docweave.sinks.store import FanOut, JsonSink, ParquetSink, plan_chunks, rejected
from docweave.sources.registry import ForeignKey, Registry, is_junction
from docweave.streaming.maintain import Maintainer, RejectedError, log_changes
from docweave.streaming.resolve import CHANGE, affected, missing_tables, relation_paths, split_key_changes

T0 = dt.datetime(2021, 1, 1)


def tables(spark, drop_order=None, moved=None, extra=()):
    users = [(1, " Ada@X.io ", "ADA", "active", None, False, None, dt.date(2020, 1, 1), Decimal("10.50")), (2, "B", "bo", "banned", None, True, None, None, None), (3, "C", "cy", "active", "hi", True, None, None, None), (4, "D", "di", "active", "x", False, T0, None, None)]
    orders = [(10, 1, Decimal("19.99"), "fulfilled", dt.datetime(2021, 1, 1)), (11, 1, Decimal("5.00"), "pending", dt.datetime(2021, 2, 1)), (12, 1, Decimal("100.00"), "fulfilled", dt.datetime(2021, 3, 1)), (20, 2, Decimal("50.00"), "fulfilled", dt.datetime(2021, 1, 15)), *extra]
    orders = [(o[0], moved.get(o[0], o[1]) if moved else o[1], *o[2:]) for o in orders if o[0] != drop_order]
    r = Registry()
    r.add("users", spark.createDataFrame(users, "id int, email string, name string, status string, bio string, archived boolean, deleted_at timestamp, joined date, balance decimal(10,2)"), "id")
    r.add("profiles", spark.createDataFrame([(100, 1, "hello")], "id int, user_id int, headline string"), "id")
    r.add("orders", spark.createDataFrame(orders, "id int, user_id int, total decimal(10,2), status string, placed_at timestamp"), "id", [ForeignKey("user_id", "users", "id")])
    r.add("order_items", spark.createDataFrame([(1000, 12, "sku-b", 2, Decimal("1.00")), (1001, 12, "sku-a", 1, Decimal("2.00")), (1002, 11, "sku-c", 3, Decimal("3.00"))], "id int, order_id int, sku string, qty int, price decimal(10,2)"), "id")
    r.add("tags", spark.createDataFrame([(1, "red"), (2, "green"), (3, "blue")], "id int, label string"), "id")
    r.add("user_tags", spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1)], "user_id int, tag_id int"), ("user_id", "tag_id"), [ForeignKey("user_id", "users", "id"), ForeignKey("tag_id", "tags", "id")])
    return r


SCHEMA = """
version: 1
table: users
primary_key: id
fields:
  - integer: id
    required: true
  - keyword: email
    required: false
    transforms: [trim, lowercase]
  - text: bio
    required: false
    default: (no bio)
  - constant: source
    value: seed
  - has_one: profile
    table: profiles
    primary_key: id
    foreign_key: user_id
    fields: [{text: headline, required: false}]
  - has_many: orders
    table: orders
    primary_key: id
    foreign_key: user_id
    order_by: [{column: placed_at, direction: desc}]
    limit: 2
    fields:
      - integer: id
        required: true
      - has_many: items
        table: order_items
        primary_key: id
        foreign_key: order_id
        order_by: [{column: sku}]
        fields: [{keyword: sku, required: true}]
  - many_to_many: tags
    table: tags
    primary_key: id
    through: {table: user_tags, left_key: user_id, right_key: tag_id}
    order_by: [{column: label}]
    fields: [{keyword: label, required: true}]
  - count: orderCount
    table: orders
    foreign_key: user_id
  - sum: total
    table: orders
    column: total
    value_type: decimal
    foreign_key: user_id
  - avg: average
    table: orders
    column: total
    foreign_key: user_id
  - min: least
    table: orders
    column: total
    value_type: decimal
    foreign_key: user_id
  - max: most
    table: orders
    column: total
    value_type: decimal
    foreign_key: user_id
  - count: fulfilled
    table: orders
    foreign_key: user_id
    filters: [{column: status, op: eq, value: fulfilled}]
  - count: tagCount
    table: tags
    through: {table: user_tags, left_key: user_id, right_key: tag_id}
  - ids: tagIds
    table: tags
    element_type: integer
    through: {table: user_tags, left_key: user_id, right_key: tag_id}
"""
USERS = load_schema(SCHEMA, "users")


def test_assembly_values(spark):
    docs = {r["id"]: r for r in assemble(USERS, tables(spark)).collect()}
    one = docs[1]
    assert one["email"] == "ada@x.io" and one["bio"] == "(no bio)" and one["source"] == "seed" and one["_id"] == "1"
    assert [o["id"] for o in one["orders"]] == [12, 11] and [i["sku"] for i in one["orders"][0]["items"]] == ["sku-a", "sku-b"]
    assert [t["label"] for t in one["tags"]] == ["blue", "green", "red"] and one["tagIds"] == [1, 2, 3]
    assert (one["orderCount"], one["total"], one["least"], one["most"], one["fulfilled"], one["tagCount"]) == (3, Decimal("124.99"), Decimal("5.00"), Decimal("100.00"), 2, 3)
    assert abs(one["average"] - 124.99 / 3) < 1e-4 and one["profile"]["headline"] == "hello"
    three = docs[3]
    assert three["orders"] == [] and three["tags"] == [] and three["tagIds"] == [] and three["profile"] is None and three["orderCount"] == 0 and three["total"] is None


@pytest.mark.parametrize(("f", "n"), [
    ({"column": "status", "op": "eq", "value": "fulfilled"}, 2), ({"column": "status", "op": "neq", "value": "fulfilled"}, 1), ({"column": "status", "op": "lt", "value": "m"}, 2), ({"column": "status", "op": "gte", "value": "m"}, 1),
    ({"column": "status", "op": "like", "value": "ful%"}, 2), ({"column": "status", "op": "ilike", "value": "FUL%"}, 2), ({"column": "status", "op": "in", "value": ["pending", "fulfilled"]}, 3), ({"column": "status", "op": "not_in", "value": ["pending"]}, 2),
    ({"column": "status", "op": "between", "value": ["a", "g"]}, 2), ({"column": "status", "op": "is_null"}, 0), ({"column": "status", "op": "is_not_null"}, 3), ({"raw": "total > 50"}, 1), ({"column": "total", "op": "gt", "value": 9}, 2), ({"column": "total", "op": "between", "value": [10, 50]}, 1), ({"column": "placed_at", "op": "gt", "value": "2021-01-15"}, 2),
])
def test_relation_filters(spark, f, n):
    s = parse_schema({"version": 1, "table": "users", "primary_key": "id", "fields": [{"integer": "id", "required": True}, {"count": "n", "table": "orders", "foreign_key": "user_id", "filters": [f]}]}, "u")
    assert {r["id"]: r["n"] for r in assemble(s, tables(spark)).collect()}[1] == n


@pytest.mark.parametrize(("soft", "live"), [({"column": "archived", "when": [{"column": "status", "op": "eq", "value": "banned"}]}, {1, 3, 4}), ({"column": "deleted_at"}, {1, 2, 3}), ({"field": "gone"}, {1, 4}), ({"field": "nothing"}, {1, 2, 3, 4})])
def test_soft_delete(spark, soft, live):
    s = parse_schema({"version": 1, "table": "users", "primary_key": "id", "soft_delete": soft, "fields": [{"boolean": "gone", "column": "archived", "required": True}]}, "u")
    assert {int(r["_id"]) for r in assemble(s, tables(spark)).collect()} == live


def test_batches_and_tombstones(spark):
    s = parse_schema({"version": 1, "table": "users", "primary_key": "id", "filters": [{"column": "status", "op": "eq", "value": "active"}, {"column": "archived", "op": "eq", "value": False}], "fields": [{"integer": "id", "required": True}]}, "u")
    out = {r["_id"]: r["op"] for r in build_many(s, tables(spark), spark.createDataFrame([("1",), ("2",), ("3",), ("99",)], "id string")).collect()}
    assert out == {"1": "upsert", "2": "delete", "3": "delete", "99": "delete"}
    assert sample_document(s, tables(spark)).collect()[0]["id"] == 1


def change(spark, *rows):
    return spark.createDataFrame([(t, op, key, before, i) for i, (t, op, key, before) in enumerate(rows)], CHANGE)


@pytest.mark.parametrize(("row", "ids"), [
    (("users", "upsert", {"id": "1"}, None), {1}), (("orders", "upsert", {"id": "10"}, None), {1}), (("profiles", "upsert", {"id": "100"}, None), {1}), (("tags", "upsert", {"id": "1"}, None), {1, 2}),
    (("user_tags", "delete", {"user_id": "1", "tag_id": "9"}, None), {1}), (("order_items", "upsert", {"id": "1002"}, None), {1}), (("tags", "upsert", {"id": "999"}, None), set()), (("orders", "delete", {"id": "77"}, {"id": "77", "user_id": "3"}), {3}), (("elsewhere", "upsert", {"id": "1"}, None), set()),
])
def test_resolution(spark, row, ids):
    assert {r["id"] for r in affected(USERS, tables(spark), change(spark, row)).collect()} == ids


def test_key_change_splits(spark):
    out = split_key_changes(change(spark, ("users", "upsert", {"id": "2"}, {"id": "1"}), ("users", "upsert", {"id": "3"}, None))).collect()
    assert [(r["op"], r["key"]["id"]) for r in out] == [("delete", "1"), ("upsert", "2"), ("upsert", "3")]


def shown(df):
    return {r["_id"]: json.dumps(r.asDict(recursive=True), default=str, sort_keys=True) for r in df.collect()}


def test_incremental_equals_rebuild(spark, tmp_path):
    now = {"r": tables(spark)}
    sink = ParquetSink(spark, f"file://{tmp_path}/store", "p_")
    m = Maintainer(spark, [USERS], lambda: now["r"], sink)
    m.ensure()
    m.seed()
    assert sink.is_seeded(USERS) and shown(sink.read(USERS)) == shown(assemble(USERS, now["r"]))
    steps = [
        (tables(spark, drop_order=10), ("orders", "delete", {"id": "10"}, {"id": "10", "user_id": "1"})),
        (tables(spark, drop_order=10, moved={11: 3}), ("orders", "upsert", {"id": "11"}, {"id": "11", "user_id": "1"})),
        (tables(spark, drop_order=10, moved={11: 3}, extra=[(30, 4, Decimal("1.00"), "new", T0)]), ("orders", "upsert", {"id": "30"}, None)),
    ]
    for n, (registry, row) in enumerate(steps):
        now["r"] = registry
        m.apply(change(spark, row), n)
        m.apply(change(spark, row), n)  # delivered again
        assert shown(sink.read(USERS)) == shown(assemble(USERS, registry))
    before = shown(sink.read(USERS))
    sink.compact(USERS)
    assert shown(sink.read(USERS)) == before and sink.state(USERS)["active"] == 1
    m.reindex()
    assert shown(sink.read(USERS)) == before and sink._generations(USERS) == [2]
    assert m.status.phase == "live" and m.status.last_batch == 2


def test_stream_from_files(spark, tmp_path):
    s = parse_schema({"version": 1, "table": "users", "primary_key": "id", "fields": [{"integer": "id", "required": True}, {"count": "n", "table": "orders", "foreign_key": "user_id"}]}, "u")
    r, seen = tables(spark), []
    sink = ParquetSink(spark, f"file://{tmp_path}/store")
    m = Maintainer(spark, [s], lambda: r, sink, observers=[lambda e, facts: seen.append(e)])
    m.ensure()
    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.json").write_text('{"table":"users","op":"upsert","key":{"id":"1"},"seq":1}\n{"table":"orders","op":"upsert","key":{"id":"20"},"seq":2}\n{"table":"users","op":"upsert","key":{"id":"77"},"seq":3}\n')
    query = m.start(f"{tmp_path}/log", f"{tmp_path}/checkpoint")
    query.awaitTermination(120)
    assert {x["id"]: x["n"] for x in sink.read(s, writing=True).collect()} == {1: 3, 2: 1} and "committed" in seen


def test_failure_policies(spark, tmp_path):
    s = parse_schema({"version": 1, "table": "users", "primary_key": "id", "fields": [{"integer": "id", "required": True}, {"keyword": "bio", "required": True}]}, "u")
    r = tables(spark)
    with pytest.raises(RejectedError):
        Maintainer(spark, [s], lambda: r, JsonSink(emit=lambda x: None)).apply(change(spark, ("users", "upsert", {"id": "1"}, None)), 0)
    lines: list[str] = []
    m = Maintainer(spark, [s], lambda: r, FanOut(JsonSink(emit=lines.append)), on_reject="skip", quarantine=f"file://{tmp_path}/bad")
    m.apply(change(spark, ("users", "upsert", {"id": "1"}, None), ("users", "upsert", {"id": "3"}, None), ("users", "delete", {"id": "9"}, None)), 0)
    envelopes = [json.loads(x) for x in lines]
    assert {(e["id"], e["op"]) for e in envelopes} == {("3", "upsert"), ("9", "delete")} and m.status.quarantined == 1
    assert next(e for e in envelopes if e["id"] == "3")["document"] == {"id": 3, "bio": "hi"}
    assert spark.read.parquet(f"file://{tmp_path}/bad/u/batch=1").collect()[0]["reason"] == "`bio` is required"


def test_replication_log(spark):
    raw = [json.dumps({"kind": "update", "table": "users", "columnnames": ["id", "name"], "columnvalues": ["2", "x"], "keynames": ["id"], "oldkeys": {"keynames": ["id"], "keyvalues": ["1"]}, "lsn": 5}), json.dumps({"kind": "delete", "table": "users", "oldkeys": {"keynames": ["id"], "keyvalues": ["3"]}, "lsn": 6}), json.dumps({"kind": "truncate", "table": "users"}), "junk"]
    out = log_changes(spark.createDataFrame([(x,) for x in raw], "value string")).collect()
    assert [(r["op"], r["key"], r["before"]) for r in out] == [("upsert", {"id": "2"}, {"id": "1"}), ("delete", {"id": "3"}, {"id": "3"})]


@pytest.mark.parametrize(("field", "message"), [
    ({"keyword": "a"}, "required"), ({"keywrd": "a", "required": True}, "keyword"), ({"keyword": "a", "text": "b", "required": True}, "more than one"), ({"keyword": "a", "required": True, "colum": "x"}, "did you mean `column`"), ({"keyword": "9a", "required": True}, "document key"),
    ({"belongs_to": "a", "table": "t", "primary_key": "id", "column": "c", "limit": 1, "fields": []}, "neither"), ({"has_one": "a", "table": "t", "primary_key": "id", "foreign_key": "c", "limit": 1, "fields": []}, "no `limit`"), ({"has_many": "a", "table": "t", "primary_key": "id", "column": "c", "fields": []}, "does not take"), ({"has_many": "a", "table": "t", "primary_key": "id", "foreign_key": "c", "required": True, "fields": []}, "never null"),
    ({"count": "a", "table": "t"}, "either"), ({"sum": "a", "table": "t", "foreign_key": "c"}, "column"), ({"ids": "a", "table": "t", "foreign_key": "c", "column": "x"}, "element_type"), ({"geo": "a", "required": True, "lat": "x"}, "either"), ({"map": "a", "values": "json", "required": True}, "map values"), ({"keyword": "a", "required": True, "transforms": ["upper"]}, "transform"), ({"doc_id": "a"}, "doc_id"),
])
def test_schema_rejections(field, message):
    with pytest.raises(SchemaError, match=message):
        parse_schema({"version": 1, "table": "t", "primary_key": "id", "fields": [field]}, "x")


def test_filter_rejections():
    for bad in ({"column": "a", "op": "between", "value": [1]}, {"column": "a", "op": "in", "value": 1}, {"column": "a", "op": "eq"}, {"column": "a", "op": "is_null", "value": 1}, {"column": "a", "op": "nope", "value": 1}, {"raw": " "}):
        with pytest.raises(SchemaError):
            parse_filter("f", bad)


names = st.from_regex(r"[a-z][a-z0-9]{0,6}", fullmatch=True)
scalars = st.fixed_dictionaries({"tag": st.sampled_from(["text", "keyword", "long", "double", "date", "timestamp", "boolean", "decimal", "json"]), "required": st.booleans(), "column": names})
filters = st.lists(st.one_of(st.builds(lambda c, v: {"column": c, "op": "eq", "value": v}, names, names), st.builds(lambda c: {"column": c, "op": "is_null"}, names), st.builds(lambda c, a, b: {"column": c, "op": "between", "value": [a, b]}, names, names, names)), max_size=2)


@st.composite
def a_field(draw, depth=2):
    name = draw(names)
    kind = draw(st.sampled_from(["scalar", "object", "join", "count", "sum", "constant"] if depth else ["scalar", "constant"]))
    if kind == "scalar":
        s = draw(scalars)
        return {s["tag"]: name, "required": s["required"], "column": s["column"]}
    if kind == "constant":
        return {"constant": name, "value": draw(st.one_of(st.integers(-5, 5), st.booleans(), names))}
    if kind == "object":
        return {"object": name, "fields": draw(st.lists(a_field(depth - 1), min_size=1, max_size=2, unique_by=lambda f: next(iter(f.values()))))}
    if kind == "join":
        out = {"has_many": name, "table": draw(names), "primary_key": draw(names), "foreign_key": draw(names), "fields": draw(st.lists(a_field(depth - 1), min_size=1, max_size=2, unique_by=lambda f: next(iter(f.values())))), "filters": draw(filters)}
        return out | ({"limit": draw(st.integers(1, 9))} if draw(st.booleans()) else {})
    extra = {"column": draw(names), "value_type": "long"} if kind == "sum" else {}
    return {kind: name, "table": draw(names), "foreign_key": draw(names), "filters": draw(filters)} | extra


@settings(max_examples=120, deadline=None)
@given(st.lists(a_field(), min_size=1, max_size=4, unique_by=lambda f: next(iter(f.values()))))
def test_schema_round_trip(raw):
    s = parse_schema({"version": 1, "table": "t", "primary_key": "id", "fields": raw}, "x")
    again = load_schema(dump_schema(s), "x")
    assert schema_dict(again) == schema_dict(s) and content_hash(again) == content_hash(s)
    index_body(s), document_type(s), example_document(s), relation_paths(s)


def test_validation_and_catalog(spark):
    r = tables(spark)
    assert not [d for d in validate(USERS, r) if d.level == "error"]
    bad = parse_schema({"version": 1, "table": "users", "primary_key": "id", "fields": [{"integer": "name", "required": True}, {"keyword": "nope", "required": False}, {"avg": "a", "table": "orders", "column": "status", "foreign_key": "user_id"}, {"count": "c", "table": "missing", "foreign_key": "x"}]}, "u")
    assert [d.path for d in validate(bad, r) if d.level == "error"] == ["name", "nope", "a", "c"]
    assert is_junction(r.tables["user_tags"]) and not is_junction(r.tables["orders"])
    assert missing_tables([USERS], {"users", "orders"}) == {"users": ["order_items", "profiles", "tags", "user_tags"]}
    body = index_body(USERS)
    assert body["mappings"]["dynamic"] == "strict" and body["mappings"]["properties"]["orders"]["type"] == "nested"


def test_chunks():
    assert plan_chunks([5, 5, 50, 1, 1, 1], most=2, most_bytes=20) == [(0, 2), (2, 3), (3, 5), (5, 6)] and plan_chunks([]) == []


@pytest.fixture(scope="module")
def index(spark):
    data = [("1", "Café Müller's Bar-2000", "alpha", 5, [1, 2], [{"n": 1, "t": "x"}, {"n": 9, "t": "y"}], {"en": "quick fox", "it": "volpe"}, {"lat": 45.0, "lon": 9.0}), ("2", "the quick brown fox jumps", "Beta", None, [], [], {"en": "slow dog"}, None), ("3", "quick quick dog", None, 7, None, [{"n": 5, "t": None}], None, {"lat": -80.0, "lon": 179.0})]
    s = parse_schema({"version": 1, "table": "t", "primary_key": "id", "fields": [{"text": "body", "required": False}, {"enum": "kind", "required": False, "variants": ["Beta", "alpha"]}, {"integer": "n", "required": False}, {"map": "title", "values": "text", "required": False}, {"geo": "at", "column": "at", "required": False}]}, "t")
    df = spark.createDataFrame(data, "_id string, body string, kind string, n int, many array<int>, items array<struct<n:int,t:string>>, title map<string,string>, at struct<lat:double,lon:double>")
    kind = document_type(s)
    return Index("t", df, kind)


def ids(index, clause):
    return "".join(sorted(r["_id"] for r in Search(index).query(clause).matched().collect()))


@pytest.mark.parametrize(("clause", "want"), [
    (q.Match("body", "QUICK"), "23"), (q.Match("body", "cafe"), "1"), (q.Match("body", "quick dog", operator="and"), "3"), (q.Match("body", "quick fox", kind="match_phrase"), ""), (q.Match("body", "quick fox", kind="match_phrase", slop=1), "2"), (q.Match("body", "quick bro", kind="match_phrase_prefix"), "2"), (q.Match("body", "jumsp", fuzziness="AUTO"), "2"), (q.Match("body", "", zero_terms="all"), "123"),
    (~q.Term("kind", "alpha"), "23"), (q.Term("kind", "BETA", True), "2"), (q.Exists("kind"), "12"), (q.Exists("many"), "1"), (q.Term("many", 2), "1"), (q.Range("n", gte=5), "13"), (q.Range("n", lt=7) | q.Term("kind", "Beta"), "12"), (q.Pattern("kind", "wildcard", "?l*a"), "1"), (q.Pattern("kind", "regexp", "al@"), "1"), (q.Pattern("kind", "prefix", "be", True), "2"), (q.Fuzzy("kind", "apl ha".replace(" ", "")), "1"),
    (q.Nested("items", q.Term("items.n", 9) & q.Term("items.t", "x")), ""), (q.Nested("items", q.Term("items.n", 9) & q.Term("items.t", "y")), "1"), (q.Nested("items", q.Range("items.n", gte=2), how="all"), "23"), (q.Nested("items", how="exists"), "13"), (q.Nested("none", q.MatchAll(), ignore_unmapped=True), ""),
    (q.HasKey("title", "it"), "1"), (q.Match("title.en", "fox", analyzer="text"), "1"), (q.MapSearch("title", "dog"), "2"), (q.MapSearch("title", "volpe", prefer=(("en", 2.0),), only_preferred=True), ""), (q.Geo("at", "distance", (45.1, 9.0, "20km")), "1"), (q.Geo("at", "box", (0, 170, -90, -170)), "3"), (q.Geo("at", "polygon", ((40, 0), (40, 20), (50, 20), (50, 0))), "1"),
    (q.Ids(("2", "9")), "2"), (q.MatchNone(), ""), (q.Bool(should=(q.Term("n", 5), q.Term("kind", "alpha"), q.Exists("at")), minimum_should_match="67%"), "1"), (query_string('body:quick -dog', ("body",)), "2"), (query_string('"quick brown" OR kind:alpha', ("body",)), "12"), (query_string("n:>=6 OR _exists_:many", ("body",)), "13"), (simple_query_string('quick + (fox | dog) -brown', ("body",), "and"), "3"),
    (parse({"bool": {"must": [{"match": {"body": {"query": "quick", "boost": 2}}}], "must_not": {"exists": {"field": "n"}}}}), "2"), (parse({"multi_match": {"query": "dog", "fields": ["body", "kind"]}}), "3"), (parse({"geo_distance": {"distance": "5km", "at": [9.0, 45.0]}}), "1"), (q.Script("n > :x", {"x": 6}), "3"),
])
def test_clauses(index, clause, want):
    assert ids(index, clause) == want


def test_unsupported_bodies(index):
    for bad in ({"knn": {}}, {"span_term": {}}, {"term": {}, "match": {}}):
        with pytest.raises(q.QueryError):
            parse(bad)
    with pytest.raises(q.QueryError):
        parse_search(index, {"aggs": {}})
    with pytest.raises(q.QueryError):
        Search(index).sort(Sort("nowhere")).hits()


def test_scores_and_pages(index):
    hits = Search(index).query(q.Match("body", "quick")).hits().collect()
    assert [h["_id"] for h in hits] == ["3", "2"] and hits[0]["_score"] > hits[1]["_score"] > 0
    page = Search(index).sort(SortBuilder().by(index.fields.n.desc()).tiebreak().build()[0]).page(0, 2).send()
    assert page["total"] == 3 and [h["id"] for h in page["hits"]] == ["3", "1"]
    assert [r["_id"] for r in Search(index).sort(index.fields.kind.in_order()).hits().collect()] == ["2", "1", "3"]
    assert [r["_id"] for r in Search(index).sort(Sort("n", missing="_first")).hits().collect()] == ["2", "1", "3"]
    projected = {r["_id"]: r["items"] for r in Search(index).project(NestedProjection("items", q.Range("items.n", gte=5), (Sort("items.n", descending=True),), 0, 1)).hits().collect()}
    assert [x["n"] for x in projected["1"]] == [9] and projected["2"] == []
    marked = Search(index).query(q.Match("body", "fox")).highlight("body").hits().collect()[0]["_highlight"]
    assert "<em>fox</em>" in marked["body"][0]
    both = MultiSearch((Search(index).query(q.Exists("n")), Search(Index("u", index.frame.drop("n"))).query(q.Exists("n") | q.Term("kind", "Beta"))))
    assert sorted((r["_index"], r["_id"]) for r in both.hits().collect()) == [("t", "1"), ("t", "3"), ("u", "2")] and both.count() == 3
    assert index.get("9").collect() == [] and Search(index).min_score(99).count() == 3


def test_handles_know_the_types(index):
    assert isinstance(index.fields.body.matches("x"), q.Match)
    with pytest.raises(AttributeError):
        index.fields.body.between(1, 2)
    with pytest.raises(AttributeError):
        fields(index.type).nothing


def test_analysis_agrees_on_both_sides(spark):
    r = random.Random(0)
    texts = ["don't stop3.14 x_y Ünïcödé ß œuvre", "PowerShot-2000 wi-fi SD500", "", "a.b:c 1,234", *["".join(r.choice("aBé'.,-_ 12ß") for _ in range(30)) for _ in range(60)]]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for how in ("text", "code", "lowercase", "keyword"):
        got = df.select("t", analysis.tokens(df["t"], how).alias("x")).collect()
        assert {x["t"]: x["x"] for x in got} == {t: analysis.analyze(t, how) for t in texts}, how


def test_required_counts():
    assert [q.required_count(s, 4) for s in (2, "50%", "-1", "-25%", "3<90%", 9)] == [2, 2, 3, 3, 3, 4]


def test_geo_values(spark):
    df = spark.createDataFrame([('{"lat": 1, "lon": 2}',), ("[2, 1]",), ("1,2",), (None,), ("x",)], "g string")
    out = [r["v"] for r in df.select(rows.geo_value(df["g"], df.schema["g"].dataType).alias("v")).collect()]
    assert [tuple(v) if v else None for v in out] == [(1.0, 2.0)] * 3 + [None, None]
