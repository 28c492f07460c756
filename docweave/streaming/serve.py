"""What operators ask a running maintainer over HTTP.

GET /healthz (200 while the process lives), /readyz (200 once seeding is done and no batch has
failed), /status (JSON), /metrics (Prometheus text), /indexes (JSON); POST /indexes/<name>/reindex
stages a new generation of one index.
"""

from __future__ import annotations

import dataclasses
import json
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .maintain import Maintainer, Status, lag

# fixed values: metric names and their kinds
_METRICS = (
    ("docweave_changes_captured_total", "counter", "captured"), ("docweave_changes_committed_total", "counter", "committed"), ("docweave_documents_quarantined_total", "counter", "quarantined"),
    ("docweave_changes_in_flight", "gauge", "in_flight"),
)


def metrics(status: Status, newest: int | None = None) -> str:
    out = []
    for name, kind, key in _METRICS:
        out += [f"# TYPE {name} {kind}", f"{name} {getattr(status, key)}"]
    behind = lag(status, newest)
    if behind is not None:
        out += ["# TYPE docweave_lag gauge", f"docweave_lag {behind}"]
    out += ["# TYPE docweave_live gauge", f"docweave_live {int(status.phase == 'live')}", "# TYPE docweave_index_seeded gauge"]
    for name, facts in sorted(status.indexes.items()):
        label = name.replace("\\", "\\\\").replace('"', '\\"')
        out.append(f'docweave_index_seeded{{index="{label}"}} {int(bool(facts.get("seeded")))}')
    return "\n".join(out) + "\n"


def ready(status: Status) -> bool:
    return status.phase == "live" and status.error is None


def answer(m: Maintainer, method: str, path: str, newest: Callable[[], int | None] = lambda: None) -> tuple[int, str, str]:
    """(status code, content type, body) of a request."""
    text, data = "text/plain; charset=utf-8", "application/json"
    parts = path.partition("?")[0].strip("/").split("/")
    if method == "GET":
        if parts == ["healthz"]:
            return 200, text, "ok\n"
        if parts == ["readyz"]:
            return (200, text, "ready\n") if ready(m.status) else (503, text, f"{m.status.error or m.status.phase}\n")
        if parts == ["status"]:
            return 200, data, json.dumps(dataclasses.asdict(m.status) | {"lag": lag(m.status, newest())}, default=str)
        if parts == ["metrics"]:
            return 200, "text/plain; version=0.0.4", metrics(m.status, newest())
        if parts == ["indexes"]:
            return 200, data, json.dumps({s.index: {"seeded": m.sink.is_seeded(s)} for s in m.schemas})
    if method == "POST" and len(parts) == 3 and parts[0] == "indexes" and parts[2] == "reindex":
        if not any(s.index == parts[1] for s in m.schemas):
            return 404, data, json.dumps({"error": f"no index `{parts[1]}`"})
        m.reindex(parts[1])
        return 202, data, json.dumps({"index": parts[1], "reindexed": True})
    return 404, data, json.dumps({"error": "not found"})


def serve(m: Maintainer, port: int = 0, host: str = "127.0.0.1", newest: Callable[[], int | None] = lambda: None) -> ThreadingHTTPServer:
    """A server on a thread of its own; ``shutdown`` ends it, ``server_port`` is where it listens."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self, method: str) -> None:
            try:
                code, kind, body = answer(m, method, self.path, newest)
            except Exception as e:  # the caller learns of it; the server goes on
                code, kind, body = 500, "application/json", json.dumps({"error": str(e)})
            raw = body.encode()
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:
            self._reply("GET")

        def do_POST(self) -> None:
            self._reply("POST")

        def log_message(self, *args: object) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
