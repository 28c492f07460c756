"""A search cluster as a sink, over its HTTP bulk interface.

Executors send their own partitions as NDJSON, in requests bounded by documents
and bytes; a request that fails as a whole is sent again with growing waits, an
item that the cluster rejects is not.  Physical indexes are named
``<prefix><index>_<hash>_<generation>``; readers use the alias
``<prefix><index>_<hash>``, repointed in one call when a generation is seeded.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..schema.mapping import content_hash, index_body
from ..schema.model import Schema
from .store import Sink, plan_chunks


@dataclass(frozen=True)
class Client:
    url: str
    timeout: float = 30.0
    retries: int = 3
    headers: dict[str, str] = field(default_factory=dict, hash=False)

    def call(self, method: str, path: str, body: bytes | dict | None = None, kind: str = "application/json") -> tuple[int, dict[str, Any]]:
        """(status, answer).  Failures to reach the cluster, and its own (429, 5xx), are tried again."""
        data = json.dumps(body).encode() if isinstance(body, dict) else body
        for attempt in range(1, self.retries + 2):
            request = urllib.request.Request(f"{self.url.rstrip('/')}/{path.lstrip('/')}", data, {"Content-Type": kind, **self.headers}, method=method)
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as r:
                    raw = r.read()
                    return r.status, json.loads(raw) if raw else {}
            except urllib.error.HTTPError as e:
                if e.code != 429 and e.code < 500:
                    raw = e.read()
                    try:
                        return e.code, json.loads(raw) if raw else {}
                    except ValueError:
                        return e.code, {"error": raw.decode(errors="replace")}
                fault: Exception = e
            except OSError as e:
                fault = e
            if attempt > self.retries:
                raise ConnectionError(f"{method} {path} failed {attempt} times: {fault}") from fault
            time.sleep(0.2 * 2 ** (attempt - 1))
        raise AssertionError


def bulk_line(index: str, op: str, id_: str, doc: str | None) -> bytes:
    head = json.dumps({"delete" if op == "delete" else "index": {"_index": index, "_id": id_}}).encode() + b"\n"
    return head if op == "delete" else head + (doc or "{}").encode() + b"\n"


def rejections(ids: list[str], answer: dict[str, Any]) -> list[tuple[str, int, str]]:
    """(id, status, reason) by position; deleting what is not there is no fault."""
    out = []
    for id_, item in zip(ids, answer.get("items", ()), strict=True):
        (kind, result), = item.items()
        if result.get("status", 200) >= 400 and not (kind == "delete" and result["status"] == 404):
            error = result.get("error")
            out.append((id_, int(result["status"]), error.get("reason", json.dumps(error)) if isinstance(error, dict) else str(error)))
    return out


def _send(client: Client, index: str, most: int, most_bytes: int):
    def run_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ops, docs = (c.to_pylist() for c in b.columns)
            lines = [bulk_line(index, *x) for x in zip(ops, ids, docs)]
            bad = []
            for lo, hi in plan_chunks(map(len, lines), most, most_bytes):
                status, answer = client.call("POST", "_bulk", b"".join(lines[lo:hi]), "application/x-ndjson")
                if status >= 400:
                    raise ConnectionError(f"bulk request: {status} {json.dumps(answer)[:500]}")
                if answer.get("errors"):
                    bad += rejections(ids[lo:hi], answer)
            id_, status_, reason = zip(*bad) if bad else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(id_, pa.string()), pa.array(status_, pa.int32()), pa.array(reason, pa.string())], names=["_id", "status", "reason"])

    return run_over


class BulkSink(Sink):
    """``rejected`` holds the last batch's rejected items as a DataFrame; ``on_reject`` stop raises on any."""

    name = "bulk"

    def __init__(self, client: Client, prefix: str = "", batch_size: int = 1000, max_bytes: int = 10 << 20, on_reject: str = "stop") -> None:
        self.client, self.prefix, self.batch_size, self.max_bytes, self.on_reject = client, prefix, batch_size, max_bytes, on_reject
        self.rejected: DataFrame | None = None

    def alias(self, schema: Schema) -> str:
        return f"{self.prefix}{schema.index}_{content_hash(schema)}"

    @property
    def _meta(self) -> str:
        return f"{self.prefix}docweave_meta"

    def state(self, schema: Schema) -> dict[str, Any]:
        status, answer = self.client.call("GET", f"{self._meta}/_doc/{self.alias(schema)}")
        return answer.get("_source", {}) if status == 200 else {}

    def _keep(self, schema: Schema, state: dict[str, Any]) -> None:
        self._done(self.client.call("PUT", f"{self._meta}/_doc/{self.alias(schema)}?refresh=true", state))

    @staticmethod
    def _done(answer: tuple[int, dict]) -> dict:
        if answer[0] >= 400:
            raise ConnectionError(f"{answer[0]}: {json.dumps(answer[1])[:500]}")
        return answer[1]

    def _physical(self, schema: Schema, generation: int) -> str:
        return f"{self.alias(schema)}_{generation}"

    def _create(self, schema: Schema, generation: int) -> None:
        status, answer = self.client.call("PUT", self._physical(schema, generation), index_body(schema))
        if status >= 400 and "exists" not in json.dumps(answer):
            self._done((status, answer))

    def ensure(self, schema: Schema) -> None:
        if not self.state(schema):
            self._create(schema, 0)
            self._keep(schema, {"active": 0, "writing": 0, "seeded": False})

    def write(self, schema: Schema, batch: DataFrame, number: int, caught_up: bool = True) -> None:
        index = self._physical(schema, self.state(schema)["writing"])
        rows = batch.select("_id", "op", F.to_json("doc", {"ignoreNullFields": "false"}).alias("doc"))
        out = rows.mapInArrow(_send(self.client, index, self.batch_size, self.max_bytes), "_id string, status int, reason string").persist()
        n = out.count()  # sends
        if self.rejected is not None:
            self.rejected.unpersist()
        self.rejected = out
        if n and self.on_reject == "stop":
            first = out.head(1)[0]
            raise RuntimeError(f"{schema.index}: {n} documents rejected, {first['_id']} for {first['reason']}")
        if caught_up:  # else the cluster's own interval makes it visible
            self.client.call("POST", f"{index}/_refresh")

    def is_seeded(self, schema: Schema) -> bool:
        s = self.state(schema)
        return bool(s) and s["seeded"] and s["active"] == s["writing"]

    def mark_seeded(self, schema: Schema) -> None:
        s = self.state(schema)
        new, old = self._physical(schema, s["writing"]), self._physical(schema, s["active"])
        actions = [{"add": {"index": new, "alias": self.alias(schema)}}]
        if new != old:
            actions.insert(0, {"remove": {"index": old, "alias": self.alias(schema), "must_exist": False}})
        self._done(self.client.call("POST", "_aliases", {"actions": actions}))
        if new != old:
            self.client.call("DELETE", old)
        self._keep(schema, {"active": s["writing"], "writing": s["writing"], "seeded": True})

    def _generations(self, schema: Schema) -> list[int]:
        status, answer = self.client.call("GET", f"{self.alias(schema)}_*")
        stem = len(self.alias(schema)) + 1
        return [int(name[stem:]) for name in answer if name[stem:].isdigit()] if status == 200 else []

    def reindex(self, schema: Schema) -> None:
        """Stages a generation past every one there is, also those of a run that broke off."""
        s = self.state(schema)
        following = max([s["writing"], s["active"], *self._generations(schema)]) + 1
        self._create(schema, following)
        self._keep(schema, s | {"writing": following})
