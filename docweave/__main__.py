"""python -m docweave check|build|preview|example|bindings|compile|load|run|reindex|indexes ...

  check    SCHEMA TABLES KEYS      diagnostics of a schema against Parquet tables
  build    SCHEMA TABLES KEYS OUT  all documents into a Parquet sink
  preview  SCHEMA TABLES KEYS      the first document there is, as JSON
  example  SCHEMA                  a made-up document
  bindings SCHEMA                  typed Python bindings of a schema
  compile  LOCK SCHEMA...          parsed schemas into one JSON lock file
  load     LOCK                    the indexes of a lock file, with their hashes
  run      CONFIG                  seeds what is not seeded, then follows the feed of a TOML file
  reindex  CONFIG [INDEX]          a new generation of one index, or of all
  indexes  CONFIG                  the indexes with their state

KEYS: table=column,table=column+column,...
"""

from __future__ import annotations

import json
import sys
from pathlib import Path

from .schema import Schema, SchemaError, content_hash, load_schema, parse_schema
from .schema.bindings import bindings
from .schema.mapping import example_document
from .schema.parse import schema_dict


def read_schema(path: str) -> Schema:
    return load_schema(Path(path).read_text(), Path(path).name.split(".")[0])


def compile_lock(schemas: list[Schema]) -> str:
    return json.dumps({"version": 1, "indexes": {s.index: {"hash": content_hash(s), "schema": schema_dict(s)} for s in schemas}}, indent=1, default=str)


def load_lock(text: str) -> list[Schema]:
    raw = json.loads(text)
    if raw.get("version") != 1:
        raise SchemaError("version", "not a lock file of version 1")
    out = []
    for name, entry in raw["indexes"].items():
        s = parse_schema(entry["schema"], name)
        if content_hash(s) != entry["hash"]:
            raise SchemaError(name, "the lock file was edited: its hash differs")
        out.append(s)
    return out


def _keys(text: str) -> dict[str, tuple[str, ...]]:
    pairs = (x.partition("=") for x in text.split(",") if x)
    return {t: tuple(c for c in k.split("+") if c) for t, _, k in pairs}


def deployed(command: str, rest: list[str]) -> int:
    from pyspark.sql import SparkSession

    from .config import load_config, maintainer
    from .streaming.maintain import newest_position
    from .streaming.serve import serve

    config = load_config(rest[0])
    spark = SparkSession.builder.getOrCreate()
    m = maintainer(spark, config)
    m.ensure()
    if command == "indexes":
        for s in config.schemas:
            print(s.index, content_hash(s), "seeded" if m.sink.is_seeded(s) else "not seeded")
        return 0
    if command == "reindex":
        if len(rest) > 1 and rest[1] not in {s.index for s in config.schemas}:
            raise SchemaError(rest[1], "no such index")
        m.reindex(rest[1] if len(rest) > 1 else None)
        return 0
    feed, run = config.source.feed, config.run
    server = serve(m, run.http_port, newest=lambda: newest_position(spark, feed) if feed else None) if run.http_port is not None else None
    try:
        m.seed(skip=run.skip_backfill)
        if feed:
            if not run.checkpoint:
                raise SchemaError("run.checkpoint", "a feed needs one")
            m.start(feed, run.checkpoint, interval=run.interval, max_changes=run.max_changes).awaitTermination()
    finally:
        if server is not None:
            server.shutdown()
    return 0


COMMANDS = ("check", "build", "preview", "example", "bindings", "compile", "load", "run", "reindex", "indexes")


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in COMMANDS:
        print(__doc__)
        return 2
    command, rest = args[0], args[1:]
    try:
        if command == "example":
            print(json.dumps(example_document(read_schema(rest[0])), indent=1, default=str))
        elif command == "bindings":
            print(bindings(read_schema(rest[0])), end="")
        elif command in ("run", "reindex", "indexes"):
            return deployed(command, rest)
        elif command == "compile":
            Path(rest[0]).write_text(compile_lock([read_schema(p) for p in rest[1:]]))
        elif command == "load":
            for s in load_lock(Path(rest[0]).read_text()):
                print(s.index, content_hash(s))
        else:
            from pyspark.sql import SparkSession

            from .plans.assemble import preview
            from .schema.validate import validate
            from .sinks.store import ParquetSink
            from .sources.registry import Registry
            from .streaming.maintain import Maintainer

            spark = SparkSession.builder.getOrCreate()
            schema, tables = read_schema(rest[0]), Registry.parquet(spark, rest[1], _keys(rest[2]))
            found = validate(schema, tables)
            for d in found:
                print(f"{d.level}: {d.path}: {d.message}")
            if any(d.level == "error" for d in found):
                return 1
            if command == "preview":
                for line in preview(schema, tables).toLocalIterator():
                    print(line["document"])
            if command == "build":
                m = Maintainer(spark, [schema], lambda: tables, ParquetSink(spark, rest[3]))
                m.ensure()
                m.seed()
    except SchemaError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
