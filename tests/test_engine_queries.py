"""The registered queries of sources, sinks, maintenance, search and tools against their SQL, on the smallest tables."""

from __future__ import annotations

import json
import urllib.error
import urllib.request

import pytest

from docweave import engine_queries
from docweave.config import load_config
from docweave.operators import clauses as q
from docweave.operators.search import Index, Search
from docweave.plans.assemble import LITERAL_KEYS, assemble, build_many
from docweave.queries import CUSTOMER, EVENT, _TOTALS, registry, schema
from docweave.schema import SchemaError
from docweave.sinks.store import Files, JsonSink, ParquetSink
from docweave.streaming.maintain import Maintainer, TransactionBuffer, live
from docweave.streaming.resolve import CHANGE, affected, typed_keys
from docweave.streaming.serve import serve

from .test_queries import FOLDER, duck, pytestmark, rows  # noqa: F401


@pytest.mark.parametrize("name", sorted(engine_queries.queries()))
def test_query(spark, duck, name):  # noqa: F811
    df = engine_queries.queries()[name](spark, FOLDER)
    want = duck.sql(engine_queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def test_a_state_is_there_after_every_step_of_a_swap(spark, tmp_path):
    files = Files(spark, f"file://{tmp_path}")
    at = f"file://{tmp_path}/current.json"
    assert files.read(at) == {}
    for i in range(4):
        files.replace(at, {"active": i})
        assert files.read(at) == {"active": i}
    # a writer that died before its rename leaves a file that no reader takes
    (tmp_path / "current.json" / "000000000009.new").write_text("{")
    assert files.read(at) == {"active": 3}
    # and one that died before it deleted old states leaves them: the greatest counts
    (tmp_path / "current.json" / "000000000001.json").write_text('{"active": 1}')
    assert files.read(at) == {"active": 3}
    files.replace(at, {"active": 4})
    assert files.read(at) == {"active": 4}


def test_a_seed_that_breaks_off_is_not_read(spark, tmp_path):
    """Between writing a generation and marking it, readers have the old one; seeding again finishes it."""
    r = registry(spark, FOLDER)
    sink = ParquetSink(spark, f"file://{tmp_path}")
    m = Maintainer(spark, [_TOTALS], lambda: r, sink)
    m.ensure()
    m.seed()
    n = sink.read(_TOTALS).count()
    sink.reindex(_TOTALS)
    empty = assemble(_TOTALS, r, [])
    from pyspark.sql import functions as F

    sink.write(_TOTALS, empty.select("_id", F.lit("upsert").alias("op"), F.struct(*(f.name for f in _TOTALS.fields)).alias("doc")), 0)
    assert not sink.is_seeded(_TOTALS) and sink.read(_TOTALS).count() == n
    m.seed()
    assert sink.is_seeded(_TOTALS) and sink.read(_TOTALS).count() == n


def test_batches_are_compacted(spark, tmp_path):
    r = registry(spark, FOLDER)
    sink = ParquetSink(spark, f"file://{tmp_path}", compact_after=2)
    m = Maintainer(spark, [_TOTALS], lambda: r, sink)
    m.ensure()
    m.seed()
    for n in range(4):
        m.apply(spark.createDataFrame([("orders", "upsert", {"o_orderkey": str(n)}, None, n)], CHANGE), n)
    assert len(sink.files.folders(sink._writing(_TOTALS))) <= 3 and sink.state(_TOTALS)["active"] > 0
    assert sink.read(_TOTALS).count() == r.frame("orders").count()


def test_documents_are_built_once_a_batch(spark, tmp_path):
    """The check of required fields runs as the batch is written, not in a run of its own."""
    r = registry(spark, FOLDER)
    m = Maintainer(spark, [_TOTALS], lambda: r, JsonSink(f"file://{tmp_path}/out"))
    spark.sparkContext.setJobGroup("seed", "seed")
    m.seed()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    writes = [j for j in spark.sparkContext.statusTracker().getJobIdsForGroup("seed")]
    assert 1 <= len(writes) <= 4  # the shuffles of one plan, and its write


def test_few_keys_reach_the_scans(spark):
    r = registry(spark, FOLDER)
    plan = assemble(schema(CUSTOMER, "customers"), r, [3, 5])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(c_custkey, [3,5])" in plan.replace("IsNotNull(c_custkey), ", "") and "In(o_custkey, [3,5])" in plan
    with pytest.raises(ValueError):
        assemble(schema(CUSTOMER, "customers"), r, list(range(LITERAL_KEYS + 1)))
    for n in (1, LITERAL_KEYS, LITERAL_KEYS + 1):
        keys = spark.range(n).withColumnRenamed("id", "c_custkey")
        assert build_many(schema(CUSTOMER, "customers"), r, keys).where("op = 'upsert'").count() == min(n, r.frame("customer").count())


def test_keys_that_are_none_are_errors(spark):
    r = registry(spark, FOLDER)
    bad = spark.createDataFrame([("orders", "upsert", {"o_orderkey": "seven"}, None, 1)], CHANGE)
    for f in (lambda: typed_keys(r, "orders", bad).collect(), lambda: affected(schema(CUSTOMER, "customers"), r, bad).collect()):
        with pytest.raises(Exception, match="is no bigint"):
            f()
    with pytest.raises(ValueError, match="no key"):
        typed_keys(r, "lineitem", bad)


def test_transactions_that_break_off_and_come_again(spark, tmp_path):
    columns = TransactionBuffer.SCHEMA
    buffer = TransactionBuffer(spark, f"file://{tmp_path}/open")

    def log(*rows):
        return spark.createDataFrame([(kind, xid, "t" if kind == "change" else None, "upsert" if kind == "change" else None, {"id": str(seq)} if kind == "change" else None, None, seq) for kind, xid, seq in rows], columns)

    def out(df):
        return sorted((r["key"]["id"], r["seq"]) for r in df.collect())

    assert out(buffer.admit(log(("begin", 1, 1), ("change", 1, 2), ("change", 1, 3)), 0)) == []
    # the feed breaks off; the transaction begins again
    assert out(buffer.admit(log(("begin", 1, 10), ("change", 1, 11), ("begin", 2, 12), ("change", 2, 13)), 1)) == []
    second = log(("commit", 1, 14), ("begin", 1, 15), ("change", 1, 16), ("abort", 2, 17))
    for _ in range(2):
        assert out(buffer.admit(second, 2)) == [("11", 14)]
    assert out(buffer.admit(log(("commit", 1, 18)), 3)) == [("16", 18)]
    assert out(buffer.admit(log(), 4)) == []


def test_searches_are_given_up(spark):
    import time

    from pyspark.sql import functions as F, types as T

    @F.udf(T.LongType())
    def slow(x):
        time.sleep(30)
        return x

    ix = Index("slow", spark.range(3).select(F.col("id").cast("string").alias("_id"), slow("id").alias("n")))
    began = time.time()
    page = Search(ix).query(q.Range("n", gte=0)).send(timeout=1.0)
    assert page["timed_out"] and page["hits"] == [] and time.time() - began < 25


def test_streams_of_other_sources(spark):
    rate = live(spark, source="rate-micro-batch", rowsPerBatch=1)
    assert rate.isStreaming and rate.columns == ["table", "op", "key", "before", "seq"]


def test_configuration_errors(tmp_path):
    good = 'version = 1\nschemas = ["e.yml"]\n[source]\nfolder = "x"\n[sink]\npath = "y"\n'
    (tmp_path / "e.yml").write_text("version: 1\ntable: events\nprimary_key: event_id\nfields:\n  - {long: id, column: event_id, required: true}\n")
    for text, message in ((good.replace("folder", "foldr"), "did you mean `folder`"), (good.replace("[sink]", "[snk]"), "did you mean"), (good.replace("version = 1", "version = 2"), "1 is expected"), (good.replace('"e.yml"', ""), "at least one"), (good.replace("path", "url"), "a path"), (good + '[run]\non_reject = "x"\n', "stop or skip"), ("a = ", "Invalid")):
        (tmp_path / "c.toml").write_text(text)
        with pytest.raises(SchemaError, match=message):
            load_config(str(tmp_path / "c.toml"))
    (tmp_path / "c.toml").write_text(good)
    assert [s.index for s in load_config(str(tmp_path / "c.toml")).schemas] == ["e"]


def test_not_ready_before_seeding_and_after_an_error(spark):
    m = Maintainer(spark, [_TOTALS], lambda: registry(spark, FOLDER), JsonSink(emit=lambda line: None))
    server = serve(m)

    def ask(path):
        try:
            with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/{path}") as a:
                return a.status, a.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    try:
        assert ask("healthz")[0] == 200 and ask("readyz") == (503, "starting\n")
        m.status.phase = "live"
        assert ask("readyz")[0] == 200 and json.loads(ask("status")[1])["phase"] == "live"
        m.status.error = "lost"
        assert ask("readyz") == (503, "lost\n")
    finally:
        server.shutdown()
        server.server_close()


def test_commands_of_a_deployment(spark, tmp_path, capsys):
    from docweave.__main__ import main

    (tmp_path / "events.yml").write_text(EVENT)
    (tmp_path / "deploy.toml").write_text(f'version = 1\nschemas = ["events.yml"]\n[source]\nfolder = "{FOLDER}"\nkeys = {{events = "event_id"}}\n[sink]\npath = "file://{tmp_path}/out"\n')
    config = str(tmp_path / "deploy.toml")

    def told(*args):
        assert main(list(args)) == 0
        return capsys.readouterr().out.split()

    assert told("indexes", config)[::2] == ["events", "not"]
    assert told("run", config) == []
    assert told("indexes", config)[::2] == ["events", "seeded"]
    assert told("reindex", config, "events") == [] and main(["reindex", config, "none"]) == 1
    assert "class EventsFields(Group):" in " ".join(told("bindings", str(tmp_path / "events.yml")))
    assert main(["preview", str(tmp_path / "events.yml"), FOLDER, "events=event_id"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["id"] == 0  # after the diagnostics
    assert main(["run"]) == 2
