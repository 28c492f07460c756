"""The tables that schemas read: DataFrames with their keys."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, types as T


@dataclass(frozen=True)
class ForeignKey:
    column: str
    table: str
    target: str


@dataclass
class Table:
    frame: DataFrame
    key: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()


@dataclass
class Registry:
    tables: dict[str, Table] = field(default_factory=dict)
    _columns: dict[str, dict[str, tuple[T.DataType, bool]]] = field(default_factory=dict, repr=False)

    def add(self, name: str, frame: DataFrame, key: str | Iterable[str] = (), foreign_keys: Iterable[ForeignKey] = ()) -> Registry:
        self._columns.pop(name, None)
        self.tables[name] = Table(frame, (key,) if isinstance(key, str) else tuple(key), tuple(foreign_keys))
        return self

    @classmethod
    def parquet(cls, spark: SparkSession, folder: str, keys: dict[str, str | tuple[str, ...]]) -> Registry:
        out = cls()
        for name, key in keys.items():
            out.add(name, spark.read.parquet(f"{folder}/{name}.parquet"), key)
        return out

    @classmethod
    def jdbc(cls, spark: SparkSession, url: str, keys: dict[str, str | tuple[str, ...]], partitions: dict[str, tuple[str, int, int, int]] | None = None, **options: str) -> Registry:
        """Tables over JDBC; ``partitions`` gives (column, lower, upper, number) for a parallel scan."""
        out = cls()
        for name, key in keys.items():
            reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
            if partitions and name in partitions:
                column, low, high, n = partitions[name]
                reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=n)
            out.add(name, reader.load(), key)
        return out

    def __contains__(self, name: str) -> bool:
        return name in self.tables

    def frame(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"no table `{name}` is registered; there are {', '.join(sorted(self.tables))}")
        return self.tables[name].frame

    def key(self, name: str) -> tuple[str, ...]:
        return self.tables[name].key

    def columns(self, name: str) -> dict[str, tuple[T.DataType, bool]]:
        """Type and whether it may be null, by column; read once a table."""
        if name not in self._columns:
            self._columns[name] = {f.name: (f.dataType, f.nullable) for f in self.frame(name).schema}
        return self._columns[name]

    def type_of(self, name: str, column: str) -> T.DataType:
        found = self.columns(name).get(column)
        if found is None:
            raise KeyError(f"`{name}` has no column `{column}`")
        return found[0]

    def single_key(self, name: str) -> str:
        """The one column of a table's key; a relation can't use another kind."""
        key = self.key(name)
        if len(key) != 1:
            raise ValueError(f"`{name}` has a key of {len(key)} columns: one is needed")
        return key[0]

    def catalog(self) -> list[dict]:
        """Tables, columns, keys and the declared type that suits each column."""
        return [
            {"table": name, "key": list(t.key), "foreign_keys": [vars(k) for k in t.foreign_keys], "junction": is_junction(t),
             "columns": [{"name": c.name, "type": c.dataType.simpleString(), "nullable": c.nullable, "suggested": suggested_type(c.dataType)} for c in t.frame.schema]}
            for name, t in sorted(self.tables.items())
        ]


def is_junction(t: Table) -> bool:
    """A table whose key is exactly its two foreign keys."""
    return len(t.foreign_keys) == 2 and {k.column for k in t.foreign_keys} == set(t.key)


def suggested_type(t: T.DataType) -> str:
    names = {"string": "keyword", "boolean": "boolean", "smallint": "short", "tinyint": "short", "int": "integer", "bigint": "long", "float": "float", "double": "double", "date": "date", "binary": "binary"}
    kind = t.simpleString()
    if kind.startswith("decimal"):
        return "decimal"
    if kind.startswith(("timestamp", "time")):
        return "timestamp"
    return names.get(kind, "json")
