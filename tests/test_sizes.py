"""What queries keep in the driver, and how often a plan reads or joins its tables."""

from __future__ import annotations

import json

from docweave.operators.search import Search
from docweave.plans.assemble import build_many
from docweave.queries import CUSTOMER, ORDER, _changes, _index, registry, schema
from docweave.sinks.trial import FileStore, TrialCluster
from docweave.streaming.resolve import affected

SF = "/root/testdata/sf0.001"


def _joins(df, how: str = "") -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count(f"Join {how}")


def test_trial_cluster_keeps_documents_in_files(spark, tmp_path):
    cluster = TrialCluster(keep=FileStore(spark, f"{tmp_path}/kept", most_bytes=300))  # no port before it is entered
    cluster.answer("PUT", "a", b"{}")
    index = lambda i, n: json.dumps({"index": {"_index": "a", "_id": str(i)}}) + "\n" + json.dumps({"n": n}) + "\n"
    for n in range(3):
        status, answer = cluster.answer("POST", "_bulk", "".join(index(i, n) for i in range(20)).encode())
        assert status == 200 and not answer["errors"] and len(answer["items"]) == 20
    cluster.answer("POST", "_bulk", (json.dumps({"delete": {"_index": "a", "_id": "7"}}) + "\n").encode())
    assert cluster.indexes["a"] == {} and sum(map(len, cluster.keep.waiting.values())) < 10 and len(cluster.requests) == 1 and cluster.requests[0][0] == 20
    assert {(r["_id"], r["doc"]) for r in cluster.keep.read("a").collect()} == {(str(i), '{"n": 2}') for i in range(20) if i != 7}
    assert cluster.answer("DELETE", "a", b"")[0] == 200 and cluster.keep.read("a").count() == 0


def test_paths_of_one_link_are_walked_once(spark):
    r = registry(spark, SF)
    one = affected(schema(CUSTOMER, "customers"), r, _changes(spark, SF, "orders", "o_orderkey"))
    assert _joins(one, "LeftSemi") == 1  # was one for each of nine fields


def test_changes_of_several_tables_go_up_together(spark):
    r = registry(spark, SF)
    changes = _changes(spark, SF, "orders", "o_orderkey")
    for table, key in (("lineitem", "l_orderkey"), ("nation", "n_nationkey"), ("region", "r_regionkey")):
        changes = changes.unionByName(_changes(spark, SF, table, key))
    found = affected(schema(CUSTOMER, "customers"), r, changes)
    assert _joins(found, "LeftSemi") <= 4 + 2  # orders, lines by their number, nations, regions
    assert {x[0] for x in found.collect()} == {x[0] for x in r.frame("customer").select("c_custkey").collect()}


def test_page_builds_only_its_documents(spark):
    ix = _index(spark, SF, ORDER, "orders")
    sent, lines = Search(ix).query(ix.fields.status.eq("F")).sort(ix.fields.total.desc()).page(3, 5), []
    own = Search._dressed
    try:
        Search._dressed = lambda self, df: lines.append(df._jdf.queryExecution().optimizedPlan().toString()) or own(self, df)
        got = sent.send()
    finally:
        Search._dressed = own
    want = [r.asDict(recursive=True) for r in sent.hits().collect()]
    assert [(h["id"], h["source"]["items"]) for h in got["hits"]] == [(r["_id"], r["items"]) for r in want]
    ids = [r["_id"] for r in want]
    # the lines are filtered by the page's ids before they are grouped; there was one plan over all documents
    assert len(lines) == 1 and all(any(i in f and "l_orderkey" in f for f in lines[0].splitlines() if "Filter" in f) for i in ids)


def test_large_batch_cuts_the_root_alone(spark):
    r, own = registry(spark, SF), schema(ORDER, "orders")
    keys = r.frame("orders").selectExpr("explode(array(o_orderkey, -1 - o_orderkey)) AS o_orderkey")
    made = build_many(own, r, keys)
    assert _joins(made, "LeftSemi") == 1  # each relation was cut too
    assert {(x["_id"], x["op"]) for x in made.select("_id", "op").collect()} == {(str(x[0]), "delete" if x[0] < 0 else "upsert") for x in keys.collect()}
