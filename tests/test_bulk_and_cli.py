from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from docweave.__main__ import compile_lock, load_lock, main
from docweave.schema import SchemaError, parse_schema
from docweave.sinks.bulk import BulkSink, Client, rejections

S = parse_schema({"version": 1, "table": "t", "primary_key": "id", "fields": [{"integer": "id", "required": True}, {"keyword": "k", "required": False}]}, "things")


class Cluster(BaseHTTPRequestHandler):
    """As much of a search cluster as the sink uses."""

    indexes: dict[str, dict] = {}
    aliases: dict[str, str] = {}
    fail_next = 0
    requests: list[int] = []

    def log_message(self, *a):
        pass

    def answer(self, status, body):
        raw = json.dumps(body).encode()
        self.send_response(status)
        self.end_headers()
        self.wfile.write(raw)

    def handle_one(self):
        body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
        path = self.path.split("?")[0].strip("/")
        if Cluster.fail_next:
            Cluster.fail_next -= 1
            return self.answer(503, {})
        if path == "_bulk":
            lines, items, i = body.decode().split("\n")[:-1], [], 0
            while i < len(lines):
                ((op, at),) = json.loads(lines[i]).items()
                docs = Cluster.indexes[at["_index"]]
                if op == "delete":
                    items.append({"delete": {"status": 200 if docs.pop(at["_id"], None) else 404}})
                    i += 1
                    continue
                doc = json.loads(lines[i + 1])
                bad = doc.get("k") == "bad"
                if not bad:
                    docs[at["_id"]] = doc
                items.append({"index": {"status": 400 if bad else 201, **({"error": {"reason": "no such keyword"}} if bad else {})}})
                i += 2
            Cluster.requests.append(len(items))
            return self.answer(200, {"errors": any(next(iter(x.values()))["status"] >= 400 for x in items), "items": items})
        if path == "_aliases":
            for a in json.loads(body)["actions"]:
                ((how, x),) = a.items()
                if how == "add":
                    Cluster.aliases[x["alias"]] = x["index"]
            return self.answer(200, {})
        if "/_doc/" in path:
            index, _, id_ = path.partition("/_doc/")
            docs = Cluster.indexes.setdefault(index, {})
            if self.command == "PUT":
                docs[id_] = json.loads(body)
                return self.answer(200, {})
            return self.answer(200, {"_source": docs[id_]}) if id_ in docs else self.answer(404, {})
        if self.command == "DELETE":
            Cluster.indexes.pop(path, None)
        elif self.command == "PUT":
            Cluster.indexes.setdefault(path, {})
        return self.answer(200, {})

    do_GET = do_PUT = do_POST = do_DELETE = handle_one


@pytest.fixture
def url():
    server = HTTPServer(("127.0.0.1", 0), Cluster)
    Cluster.indexes, Cluster.aliases, Cluster.fail_next, Cluster.requests = {}, {}, 0, []
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def batch(spark, *rows):
    return spark.createDataFrame([(i, op, (int(i), k) if op == "upsert" else None) for i, op, k in rows], "_id string, op string, doc struct<id:int,k:string>").coalesce(1)


def test_bulk_sink(spark, url):
    sink = BulkSink(Client(url), "x_", batch_size=2)
    sink.ensure(S)
    Cluster.fail_next = 2
    sink.write(S, batch(spark, ("1", "upsert", "a"), ("2", "upsert", None), ("3", "upsert", "c")), 0)
    assert Cluster.requests == [2, 1] and not sink.is_seeded(S)
    sink.mark_seeded(S)
    live = Cluster.aliases[sink.alias(S)]
    assert Cluster.indexes[live] == {"1": {"id": 1, "k": "a"}, "2": {"id": 2, "k": None}, "3": {"id": 3, "k": "c"}} and sink.is_seeded(S)
    sink.write(S, batch(spark, ("1", "delete", None), ("9", "delete", None), ("2", "upsert", "z")), 1)
    assert Cluster.indexes[live] == {"2": {"id": 2, "k": "z"}, "3": {"id": 3, "k": "c"}}
    with pytest.raises(RuntimeError, match="no such keyword"):
        sink.write(S, batch(spark, ("5", "upsert", "bad")), 2)
    skipping = BulkSink(Client(url), "x_", on_reject="skip")
    skipping.write(S, batch(spark, ("5", "upsert", "bad"), ("6", "upsert", "ok")), 3)
    assert [tuple(r) for r in skipping.rejected.collect()] == [("5", 400, "no such keyword")]
    sink.reindex(S)
    sink.write(S, batch(spark, ("7", "upsert", "n")), 4)
    sink.mark_seeded(S)
    assert Cluster.aliases[sink.alias(S)].endswith("_1") and live not in Cluster.indexes


def test_client_gives_up():
    with pytest.raises(ConnectionError):
        Client("http://127.0.0.1:9", retries=1).call("GET", "x")


def test_rejections_match_by_position():
    assert rejections(["a", "b"], {"items": [{"index": {"status": 200}}, {"index": {"status": 409, "error": "x"}}]}) == [("b", 409, "x")]


def test_lock_and_commands(tmp_path, capsys):
    assert load_lock(compile_lock([S])) == [S]
    with pytest.raises(SchemaError):
        load_lock(compile_lock([S]).replace('"integer"', '"long"'))
    f = tmp_path / "things.schema.yml"
    f.write_text("version: 1\ntable: t\nprimary_key: id\nfields:\n  - integer: id\n    required: true\n")
    assert main(["compile", str(tmp_path / "lock.json"), str(f)]) == 0 and main(["load", str(tmp_path / "lock.json")]) == 0
    assert main(["example", str(f)]) == 0 and '"id": 1' in capsys.readouterr().out
    f.write_text("version: 2\n")
    assert main(["example", str(f)]) == 1 and main([]) == 2
