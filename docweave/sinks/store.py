"""Where documents go: versioned Parquet generations, JSON lines, several at once.

``ParquetSink`` keeps each index under ``<prefix><index>_<hash>/gen=<n>/``.  A batch is a
folder of its own, named by its number and overwritten when it comes again, so
delivery at least once leaves one copy.  Readers take each document's latest batch;
``compact`` folds the batches into one, by itself once there are ``compact_after``.  ``current.json`` says which generation
is read.  It is a folder of numbered states, the greatest of which counts: a new one
appears by one rename to a name that is not there yet, so at no moment, and
after no crash, is there none.
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..schema.mapping import content_hash, document_type, index_body, nullable
from ..schema.model import Schema


class Sink(ABC):
    """Batches are (_id, op, doc), op upsert or delete."""

    name = "sink"

    def ensure(self, schema: Schema) -> None: ...

    @abstractmethod
    def write(self, schema: Schema, batch: DataFrame, number: int, caught_up: bool = True) -> None:
        """``caught_up``: nothing more is waiting, so what was written may be made visible at once."""

    def is_seeded(self, schema: Schema) -> bool:
        return False

    def mark_seeded(self, schema: Schema) -> None: ...

    def reindex(self, schema: Schema) -> None: ...


class Files:
    """The Hadoop file system: local or shared, as the path says."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def exists(self, p: str) -> bool:
        return self.fs.exists(self._path(p))

    def folders(self, p: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(p)) if s.isDirectory()) if self.exists(p) else []

    def delete(self, p: str) -> None:
        self.fs.delete(self._path(p), True)

    def _states(self, p: str) -> list[str]:
        names = [x.getPath().getName() for x in self.fs.listStatus(self._path(p))] if self.exists(p) else []
        return sorted(n for n in names if n.endswith(".json"))

    def read(self, p: str) -> dict[str, Any]:
        states = self._states(p)
        if not states:
            return {}
        stream = self.fs.open(self._path(f"{p}/{states[-1]}"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def replace(self, p: str, value: dict[str, Any]) -> None:
        states = self._states(p)
        number = int(states[-1][:-5]) + 1 if states else 0
        new, name = self._path(f"{p}/{number:012d}.new"), self._path(f"{p}/{number:012d}.json")
        stream = self.fs.create(new, True)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        if not self.fs.rename(new, name):
            raise RuntimeError(f"{p}: state {number} was written by another")
        for old in states[:-1]:  # the one before stays for readers that have just listed it
            self.fs.delete(self._path(f"{p}/{old}"), False)


class ParquetSink(Sink):
    name = "parquet"

    def __init__(self, spark: SparkSession, root: str, prefix: str = "", records_per_file: int = 1_000_000, compact_after: int = 64) -> None:
        self.spark, self.root, self.prefix, self.records, self.compact_after = spark, root.rstrip("/"), prefix, records_per_file, compact_after
        self.files = Files(spark, self.root)

    def home(self, schema: Schema) -> str:
        return f"{self.root}/{self.prefix}{schema.index}_{content_hash(schema)}"

    def state(self, schema: Schema) -> dict[str, Any]:
        return self.files.read(f"{self.home(schema)}/current.json")

    def _generations(self, schema: Schema) -> list[int]:
        return [int(x[4:]) for x in self.files.folders(self.home(schema)) if x.startswith("gen=")]

    def ensure(self, schema: Schema) -> None:
        if not self.state(schema):
            self.files.replace(f"{self.home(schema)}/mapping.json", index_body(schema))
            self.files.replace(f"{self.home(schema)}/current.json", {"active": 0, "writing": 0, "seeded": False})

    def _writing(self, schema: Schema) -> str:
        return f"{self.home(schema)}/gen={self.state(schema)['writing']}"

    def write(self, schema: Schema, batch: DataFrame, number: int, caught_up: bool = True) -> None:
        batch.write.mode("overwrite").option("maxRecordsPerFile", self.records).parquet(f"{self._writing(schema)}/batch={number}")
        if caught_up and self.is_seeded(schema) and len(self.files.folders(self._writing(schema))) > self.compact_after:
            self.compact(schema)

    def is_seeded(self, schema: Schema) -> bool:
        s = self.state(schema)
        return bool(s) and s["seeded"] and s["writing"] == s["active"]

    def mark_seeded(self, schema: Schema) -> None:
        s = self.state(schema)
        old = s["active"]
        self.files.replace(f"{self.home(schema)}/current.json", {"active": s["writing"], "writing": s["writing"], "seeded": True})
        for g in self._generations(schema):  # only now: readers have moved on
            if g != s["writing"] and g <= old:
                self.files.delete(f"{self.home(schema)}/gen={g}")

    def reindex(self, schema: Schema) -> None:
        s = self.state(schema)
        following = max([s["writing"], s["active"], *self._generations(schema)]) + 1
        self.files.replace(f"{self.home(schema)}/current.json", s | {"writing": following})

    def read(self, schema: Schema, writing: bool = False) -> DataFrame:
        """Live documents: _id and the fields."""
        s = self.state(schema)
        df = self.spark.read.option("basePath", f"{self.home(schema)}/gen={s['writing' if writing else 'active']}").parquet(f"{self.home(schema)}/gen={s['writing' if writing else 'active']}/batch=*")
        # later batches are small beside the first: only they are grouped, and the first is cut by their ids
        later = df.where("batch > 0").groupBy("_id").agg(F.max_by(F.struct("op", "doc"), "batch").alias("last")).select("_id", "last.op", "last.doc")
        first = df.where("batch = 0").join(later.select("_id"), "_id", "left_anti").select("_id", "op", "doc")
        return first.unionByName(later).where("op = 'upsert'").select("_id", "doc.*")

    def compact(self, schema: Schema) -> None:
        """The same documents as one batch of a new generation."""
        docs = self.read(schema)
        self.reindex(schema)
        packed = docs.select("_id", F.lit("upsert").alias("op"), F.struct(*(f"`{c}`" for c in docs.columns if c != "_id")).alias("doc"))
        self.write(schema, packed, 0)
        self.mark_seeded(schema)


class JsonSink(Sink):
    """One JSON envelope a line, to a folder or, with ``emit``, to a function of each line (small outputs)."""

    name = "stdout"

    def __init__(self, path: str | None = None, emit: Callable[[str], None] | None = print) -> None:
        self.path, self.emit, self.seeded = path, emit, set()

    @staticmethod
    def lines(schema: Schema, batch: DataFrame, number: int) -> DataFrame:
        kind = batch.schema["doc"].dataType
        doc = F.to_json("doc", {"ignoreNullFields": "false"})
        meta = F.struct(F.lit(len(kind.names) if isinstance(kind, T.StructType) else 0).alias("fields"), F.coalesce(F.octet_length(doc), F.lit(0)).alias("bytes"))
        head = F.to_json(F.struct(F.lit("stdout").alias("sink"), F.lit(1).alias("version"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSX").alias("ts"), F.lit(number).alias("seq"), F.lit(schema.index).alias("index"), F.col("op"), F.col("_id").alias("id"), meta.alias("meta")))
        return batch.select(head.alias("head"), doc.alias("doc")).select(F.concat(F.expr("substring(head, 1, length(head) - 1)"), F.lit(',"document":'), F.coalesce("doc", F.lit("null")), F.lit("}")).alias("value"))

    def write(self, schema: Schema, batch: DataFrame, number: int, caught_up: bool = True) -> None:
        out = self.lines(schema, batch, number)
        if self.path:
            out.write.mode("overwrite").text(f"{self.path}/{schema.index}/batch={number}")
        else:
            for r in out.toLocalIterator():
                self.emit(r["value"])

    def is_seeded(self, schema: Schema) -> bool:
        return content_hash(schema) in self.seeded

    def mark_seeded(self, schema: Schema) -> None:
        self.seeded.add(content_hash(schema))


class FanOut(Sink):
    """Every operation to every sink, reindexing too; seeding is kept for each."""

    name = "fan_out"

    def __init__(self, *sinks: Sink) -> None:
        self.sinks = sinks

    def ensure(self, schema: Schema) -> None:
        for s in self.sinks:
            s.ensure(schema)

    def write(self, schema: Schema, batch: DataFrame, number: int, caught_up: bool = True) -> None:
        batch.persist()
        try:
            for s in self.sinks:
                s.write(schema, batch, number, caught_up)
        finally:
            batch.unpersist()

    def is_seeded(self, schema: Schema) -> bool:
        return all(s.is_seeded(schema) for s in self.sinks)

    def unseeded(self, schema: Schema) -> list[Sink]:
        return [s for s in self.sinks if not s.is_seeded(schema)]

    def mark_seeded(self, schema: Schema) -> None:
        for s in self.sinks:
            s.mark_seeded(schema)

    def reindex(self, schema: Schema) -> None:
        for s in self.sinks:
            s.reindex(schema)


def reject_reason(schema: Schema) -> Column | None:
    """Why the mapping does not admit an upsert (a required field is null), or null."""
    faults = [F.when(F.col(f"doc.`{f.name}`").isNull(), F.lit(f"`{f.name}` is required")) for f in schema.fields if not nullable(f, schema.primary_key)]
    return F.when(F.col("op") == "upsert", F.coalesce(*faults)) if faults else None


def rejected(schema: Schema, batch: DataFrame) -> DataFrame:
    """(_id, reason) of upserts that the mapping does not admit."""
    reason = reject_reason(schema)
    return batch.select("_id", (F.lit(None).cast("string") if reason is None else reason).alias("reason")).where("reason is not null")


def plan_chunks(sizes: Iterable[int], most: int = 1000, most_bytes: int = 10 << 20) -> list[tuple[int, int]]:
    """Ranges of documents for bulk requests, under both bounds; one too large goes alone."""
    out, first, count, held = [], 0, 0, 0
    for i, n in enumerate(sizes):
        if count and (count >= most or held + n > most_bytes):
            out.append((first, i))
            first, count, held = i, 0, 0
        count, held = count + 1, held + n
    if count:
        out.append((first, first + count))
    return out


def stored_type(schema: Schema) -> T.StructType:
    return T.StructType([T.StructField("_id", T.StringType()), *document_type(schema)])
