"""Keeping documents current: seeding, change batches, the stream, status.

A batch resolves its changes to distinct root keys, rebuilds those documents
from the tables as they are now and writes upserts and tombstones.  Structured
Streaming commits its offsets after the batch function returns, so a batch that
failed comes again; rebuilding from current rows makes that harmless.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..plans.assemble import assemble, build_many
from ..schema.model import Schema
from ..sinks.store import Files, FanOut, Sink, reject_reason
from ..sources.registry import Registry
from .resolve import CHANGE, affected, split_key_changes

#: Changes in a batch at most, and seconds it waits for more.
MAX_CHANGES, MAX_DELAY = 256, 0.05
_REJECTED = "rejected document: "


class RejectedError(RuntimeError):
    pass


@dataclass
class Status:
    phase: str = "starting"
    indexes: dict[str, dict[str, Any]] = field(default_factory=dict)
    captured: int = 0
    committed: int = 0
    quarantined: int = 0
    in_flight: int = 0
    position: int | None = None  # greatest position in the log that is committed
    last_batch: int | None = None
    error: str | None = None


@dataclass
class Maintainer:
    """``registry`` is called for each batch, so tables are read as they are then."""

    spark: SparkSession
    schemas: list[Schema]
    registry: Callable[[], Registry]
    sink: Sink
    on_reject: str = "stop"
    on_reject_for: dict[str, str] = field(default_factory=dict)
    quarantine: str | None = None
    observers: list[Callable[[str, dict[str, Any]], None]] = field(default_factory=list)
    status: Status = field(default_factory=Status)

    def _tell(self, event: str, **facts: Any) -> None:
        for o in self.observers:
            o(event, facts)

    def ensure(self) -> None:
        for s in self.schemas:
            self.sink.ensure(s)
            self.status.indexes[s.index] = {"seeded": self.sink.is_seeded(s)}
        self._tell("indexes_ensured", indexes=[s.index for s in self.schemas])

    def seed(self, skip: bool = False) -> None:
        """Builds every index that a sink does not hold yet, as one plan each."""
        self.status.phase = "seeding"
        for s in self.schemas:
            sinks = self.sink.unseeded(s) if isinstance(self.sink, FanOut) else [] if self.sink.is_seeded(s) else [self.sink]
            if skip or not sinks:
                continue
            self._tell("seeding", index=s.index)
            docs = assemble(s, self.registry())
            batch = docs.select("_id", F.lit("upsert").alias("op"), F.struct(*(f"`{f.name}`" for f in s.fields)).alias("doc"))
            for sink in sinks:
                self._write(sink, s, batch, 0)
                sink.mark_seeded(s)
            self.status.indexes.setdefault(s.index, {})["seeded"] = True
            self._tell("seeded", index=s.index)
        self.status.phase = "live"

    def reindex(self, index: str | None = None) -> None:
        """A new generation of one index, or of all; readers keep the old one until it is seeded."""
        for s in self.schemas:
            if index in (None, s.index):
                self.sink.reindex(s)
        self.seed()

    def _write(self, sink: Sink, s: Schema, batch: DataFrame, number: int, caught_up: bool = True) -> None:
        reason = reject_reason(s)
        policy = self.on_reject_for.get(s.index, self.on_reject)
        if reason is None:
            return sink.write(s, batch, number, caught_up)
        if policy != "skip":
            # the check runs as the documents are written: they are built once
            fault = F.raise_error(F.concat(F.lit(f"{_REJECTED}{s.index}: document "), F.col("_id"), F.lit(" is rejected: "), reason))
            try:
                return sink.write(s, batch.withColumn("op", F.when(reason.isNotNull(), fault.cast("string")).otherwise(F.col("op"))), number, caught_up)
            except Exception as e:
                if _REJECTED in str(e):
                    raise RejectedError(str(e).split(_REJECTED, 1)[1].splitlines()[0]) from e
                raise
        batch = batch.withColumn("reason", reason).persist()
        try:
            bad = batch.where("reason is not null").select("_id", "reason")
            if n := bad.count():
                if self.quarantine:
                    bad.withColumn("index", F.lit(s.index)).write.mode("overwrite").parquet(f"{self.quarantine}/{s.index}/batch={number}")
                self.status.quarantined += n
                self._tell("quarantined", index=s.index, count=n)
            sink.write(s, batch.where("reason is null").drop("reason"), number, caught_up)
        finally:
            batch.unpersist()

    def apply(self, changes: DataFrame, number: int, caught_up: bool = True) -> None:
        """One batch of change rows.  Numbers grow; a batch that comes again has the same one."""
        began = time.time()
        changes = split_key_changes(changes.select("table", "op", "key", "before", "seq")).persist()
        try:
            r = changes.agg(F.count(F.lit(1)), F.max("seq"), F.collect_set("table")).head()  # as many tables as are followed
            n, position, touched = r[0], r[1], set(r[2])
            self.status.captured += n
            if not n:
                return
            self.status.in_flight = n
            self._tell("captured", batch=number, changes=n)
            registry = self.registry()
            for s in self.schemas:
                if touched & set(s.tables()):
                    keys = affected(s, registry, changes, touched).persist()
                    try:
                        self._write(self.sink, s, build_many(s, registry, keys), number + 1, caught_up)  # 0 is the seed
                    finally:
                        keys.unpersist()
            self.status.committed += n
            self.status.last_batch = number
            if position is not None:
                self.status.position = max(position, self.status.position or position)
            self._tell("committed", batch=number, changes=n, seconds=time.time() - began)
        except Exception as e:
            self.status.error = str(e)
            self._tell("error", batch=number, error=str(e))
            raise
        finally:
            self.status.in_flight = 0
            changes.unpersist()

    def apply_windows(self, changes: DataFrame, first: int, max_changes: int = MAX_CHANGES) -> int:
        """Changes in the order of ``seq`` as batches of at most ``max_changes``, numbered from ``first``; only the last is caught up.  Gives how many."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        placed = changes.select("table", "op", "key", "before", "seq").repartitionByRange(parts, "seq").withColumn("part", F.spark_partition_id()).persist()
        try:
            # ranks inside range partitions, and how many rows the partitions before hold: no task sees all
            sizes = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}  # a number a partition
            before, held = [], 0
            for p in range(parts):
                before.append(held)
                held += sizes.get(p, 0)
            rank = F.row_number().over(Window.partitionBy("part").orderBy("seq", "table")) - 1 + F.get(F.array(*map(F.lit, before)), F.col("part"))
            windows = placed.withColumn("window", F.floor(rank / max_changes)).drop("part")
            n = -(-held // max_changes)
            for i in range(n):
                self.apply(windows.where(F.col("window") == i), first + i, caught_up=i == n - 1)
            return n
        finally:
            placed.unpersist()

    def start(self, feed: str | DataFrame, checkpoint: str, files_per_batch: int = 64, interval: str | None = None, max_changes: int | None = None):
        """Follows a folder of change rows (JSON lines) or another stream of them.

        ``interval`` None: what is there now, then ends; ``f"{MAX_DELAY} seconds"`` is the usual
        wait.  ``files_per_batch`` bounds what waits; ``max_changes`` cuts batches.
        """
        stream = live(self.spark, feed, maxFilesPerTrigger=files_per_batch) if isinstance(feed, str) else feed

        def one(df: DataFrame, n: int) -> None:
            if max_changes is None:
                self.apply(df, n)
            else:
                self.apply_windows(df, n << 24, max_changes)

        writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def live(spark: SparkSession, path: str | None = None, source: str = "json", **options: Any) -> DataFrame:
    """A stream of change rows: JSON lines in a folder, or the values of a streaming source such as kafka."""
    reader = spark.readStream.options(**options)
    if source == "json":
        return reader.schema(CHANGE).json(path)
    raw = reader.format(source).load(path) if path else reader.format(source).load()
    return raw.select(F.from_json(F.col("value").cast("string"), CHANGE).alias("c")).select("c.*")


def newest_position(spark: SparkSession, path: str) -> int | None:
    """The greatest position in a folder of change rows."""
    return spark.read.schema(CHANGE).json(path).agg(F.max("seq")).head()[0]


def lag(status: Status, newest: int | None) -> int | None:
    """Log positions between what is committed and the newest; never below 0, None before anything is known."""
    if newest is None:
        return None
    return max(0, newest - (status.position if status.position is not None else 0))


class TransactionBuffer:
    """Holds decoded row changes until their transaction commits.

    A log row is (kind, xid, table, op, key, before, seq); kind is begin, change, commit or
    abort.  ``admit`` takes a batch of them and gives the changes of transactions that have
    committed by then, with the commit's position as ``seq`` and in its order; the others wait in
    a table under ``path``, one folder a batch.  A batch that comes again reads what the one
    before it left, so it gives the same rows.  A begin drops what an earlier, broken-off
    transaction of its xid has left.
    """

    SCHEMA = "kind string, xid long, table string, op string, key map<string,string>, before map<string,string>, seq long"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.files = Files(spark, self.path)

    def _waiting(self, number: int) -> DataFrame:
        earlier = [int(f.removeprefix("batch=")) for f in self.files.folders(self.path)]
        last = max((n for n in earlier if n < number), default=None)
        return self.spark.createDataFrame([], self.SCHEMA) if last is None else self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/batch={last}")

    def admit(self, log: DataFrame, number: int) -> DataFrame:
        columns = ["kind", "xid", "table", "op", "key", "before", "seq"]
        rows = self._waiting(number).unionByName(log.select(*columns))
        # what comes next for a change's transaction decides: its commit, its abort, or a begin after it broke off
        marks = rows.where("kind <> 'change'").groupBy("xid").agg(F.collect_list(F.struct("seq", "kind")).alias("marks"))
        state = rows.where("kind = 'change'").join(marks, "xid", "left")
        state = state.withColumn("next", F.array_min(F.filter("marks", lambda m: m["seq"] > F.col("seq"))))
        state.where("next is null").select(*columns).write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        for f in self.files.folders(self.path):  # the one before is read again if this batch comes again
            if int(f.removeprefix("batch=")) < number - 1:
                self.files.delete(f"{self.path}/{f}")
        return state.where("next.kind = 'commit'").select("table", "op", "key", "before", F.col("next.seq").alias("seq"), F.col("seq").alias("place"), "xid")


def log_changes(stream: DataFrame, raw: str = "value", transactions: bool = False) -> DataFrame:
    """Decodes replication-style JSON: kind, table, columnnames, columnvalues, oldkeys (keynames, keyvalues).

    ``transactions``: with the begin, commit and abort rows, for a ``TransactionBuffer``.  TRUNCATE is left out.
    """
    schema = "kind string, xid long, table string, columnnames array<string>, columnvalues array<string>, keynames array<string>, oldkeys struct<keynames array<string>, keyvalues array<string>>, lsn long"
    m = F.from_json(raw, schema)
    row = F.map_from_arrays(m["columnnames"], m["columnvalues"])
    old = F.map_from_arrays(m["oldkeys"]["keynames"], m["oldkeys"]["keyvalues"])
    key = F.when(m["kind"] == "delete", old).otherwise(F.when(m["keynames"].isNotNull(), F.map_filter(row, lambda k, v: F.array_contains(m["keynames"], k))).otherwise(row))
    kind = F.when(m["kind"].isin("insert", "update", "delete"), "change").otherwise(m["kind"])
    rows = stream.select(kind.alias("kind"), m["xid"].alias("xid"), m["table"].alias("table"), F.when(m["kind"] == "delete", "delete").when(kind == "change", "upsert").alias("op"), key.alias("key"), old.alias("before"), m["lsn"].alias("seq"))
    is_change = (F.col("kind") == "change") & F.col("table").isNotNull()
    if transactions:
        return rows.where(is_change | F.col("kind").isin("begin", "commit", "abort"))
    return rows.where(is_change).select("table", "op", "key", "before", "seq")
