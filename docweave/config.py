"""A deployment in one TOML file: schemas, where tables and changes come from, where documents go."""

from __future__ import annotations

import difflib
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from .schema import Schema, SchemaError, load_schema
from .sinks.bulk import BulkSink, Client
from .sinks.store import FanOut, JsonSink, ParquetSink, Sink
from .sources.registry import Registry
from .streaming.maintain import Maintainer


@dataclass(frozen=True)
class Source:
    kind: str = "parquet"
    folder: str | None = None
    url: str | None = None
    keys: dict[str, Any] = field(default_factory=dict)
    options: dict[str, str] = field(default_factory=dict)
    feed: str | None = None


@dataclass(frozen=True)
class SinkConfig:
    kind: str = "parquet"
    path: str | None = None
    url: str | None = None
    prefix: str = ""
    batch_size: int = 1000
    max_bytes: int = 10 << 20


@dataclass(frozen=True)
class Run:
    checkpoint: str | None = None
    interval: str | None = None
    max_changes: int | None = None
    on_reject: str = "stop"
    on_reject_for: dict[str, str] = field(default_factory=dict)
    quarantine: str | None = None
    skip_backfill: bool = False
    http_port: int | None = None


@dataclass(frozen=True)
class Config:
    schemas: tuple[Schema, ...]
    source: Source
    sinks: tuple[SinkConfig, ...]
    run: Run


def _read(kind: type, path: str, raw: Any) -> Any:
    if not isinstance(raw, dict):
        raise SchemaError(path, "a table is expected")
    known = {f.name for f in fields(kind)}
    for key in raw:
        if key not in known:
            near = difflib.get_close_matches(key, known, 1)
            raise SchemaError(f"{path}.{key}", "no such key" + (f"; did you mean `{near[0]}`?" if near else ""))
    return kind(**raw)


def load_config(path: str) -> Config:
    """Schema files are named relative to the file."""
    file = Path(path)
    return parse_config(file.read_text(), lambda name: (file.parent / name).read_text())


def parse_config(text: str, read: Callable[[str], str]) -> Config:
    """``read`` gives the text of a schema file by its name."""
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise SchemaError("", str(e)) from e
    if raw.get("version") != 1:
        raise SchemaError("version", "1 is expected")
    for key in raw:
        if key not in ("version", "schemas", "source", "sink", "sinks", "run"):
            near = difflib.get_close_matches(key, ("version", "schemas", "source", "sinks", "run"), 1)
            raise SchemaError(key, "no such key" + (f"; did you mean `{near[0]}`?" if near else ""))
    schemas = tuple(load_schema(read(x), Path(x).name.split(".")[0]) for x in raw.get("schemas", ()))
    if not schemas:
        raise SchemaError("schemas", "at least one is needed")
    source = _read(Source, "source", raw.get("source", {}))
    if source.kind not in ("parquet", "jdbc") or not (source.folder if source.kind == "parquet" else source.url):
        raise SchemaError("source", "a parquet source with a folder, or a jdbc source with a url")
    sinks = tuple(_read(SinkConfig, "sink", x) for x in (raw["sinks"] if "sinks" in raw else [raw.get("sink", {"kind": "stdout"})]))
    for s in sinks:
        if s.kind not in ("parquet", "bulk", "stdout") or s.kind == "parquet" and not s.path or s.kind == "bulk" and not s.url:
            raise SchemaError("sink", "a parquet sink with a path, a bulk sink with a url, or stdout")
    run = _read(Run, "run", raw.get("run", {}))
    for policy in (run.on_reject, *run.on_reject_for.values()):
        if policy not in ("stop", "skip"):
            raise SchemaError("run.on_reject", f"`{policy}`: stop or skip")
    return Config(schemas, source, sinks, run)


def tables(spark: SparkSession, source: Source) -> Registry:
    keys = {t: tuple(k) if isinstance(k, list) else k for t, k in source.keys.items()}
    return Registry.parquet(spark, source.folder, keys) if source.kind == "parquet" else Registry.jdbc(spark, source.url, keys, **source.options)


def sink(spark: SparkSession, configs: tuple[SinkConfig, ...]) -> Sink:
    made: list[Sink] = []
    for c in configs:
        if c.kind == "parquet":
            made.append(ParquetSink(spark, c.path, c.prefix))
        elif c.kind == "bulk":
            made.append(BulkSink(Client(c.url), c.prefix, c.batch_size, c.max_bytes))
        else:
            made.append(JsonSink(c.path))
    return made[0] if len(made) == 1 else FanOut(*made)


def maintainer(spark: SparkSession, config: Config) -> Maintainer:
    r = config.run
    return Maintainer(spark, list(config.schemas), lambda: tables(spark, config.source), sink(spark, config.sinks), r.on_reject, dict(r.on_reject_for), r.quarantine)
