"""From changed rows to the documents they touch.

A change row is (table, op, key map<string,string>, before map<string,string> or
null).  Every relation path whose table or junction is the changed table is
walked from the changed row up to the root, one join a hop on distinct keys;
tables that no path names cost nothing.

A child that is deleted, or moved to another parent, is traced to its old
parent by ``before`` where the change carries it.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..schema.model import Field, Schema
from ..sources.registry import Registry

CHANGE = "table string, op string, key map<string,string>, before map<string,string>, seq long"


def relation_paths(schema: Schema) -> list[tuple[Field, ...]]:
    """Every relation with the relations around it, outermost first."""
    return [(*(a for a in above if a.kind == "join"), f) for above, f in schema.walk() if f.kind in ("join", "aggregate")]


def typed_key(c: Column, kind, name: str) -> Column:
    """A key's text in its column's type; text that is none is an error, never a null that drops the change."""
    value = c.try_cast(kind)
    wrong = F.raise_error(F.concat(F.lit(f"key `{name}`: `"), c, F.lit(f"` is no {kind.simpleString()}"))).cast(kind)
    return F.when(c.isNotNull() & value.isNull(), wrong).otherwise(value)


def typed_keys(registry: Registry, table: str, changes: DataFrame) -> DataFrame:
    """The changed rows' keys of one table in its key columns' types.  A table without a key is an error."""
    keys = registry.key(table)
    if not keys:
        raise ValueError(f"`{table}` has no key: its changes cannot be told apart")
    return changes.where(F.col("table") == table).select(*(typed_key(F.col("key")[k], registry.type_of(table, k), k).alias(k) for k in keys), "op")


def _parent(schema: Schema, path: tuple[Field, ...]) -> tuple[str, str]:
    """(table, key column) of what holds the last relation of a path."""
    return (path[-2].table, path[-2].primary_key) if len(path) > 1 else (schema.table, schema.primary_key[0])


def _up(schema: Schema, registry: Registry, path: tuple[Field, ...], keys: DataFrame, column: str) -> DataFrame:
    """Parent keys (k) of changed rows of the last relation's table, whose ``column`` is in keys (k)."""
    f = path[-1]
    table, key = _parent(schema, path)
    if f.type == "belongs_to":
        target = registry.frame(f.table)
        if column != f.primary_key:
            keys = target.join(keys, F.col(f"`{column}`") == F.col("k"), "left_semi").select(F.col(f"`{f.primary_key}`").alias("k"))
        return registry.frame(table).join(keys.distinct(), F.col(f"`{f.column}`") == F.col("k"), "left_semi").select(F.col(f"`{key}`").alias("k"))
    if f.through:
        far = f.primary_key or registry.key(f.table)[0]
        if column != far:
            keys = registry.frame(f.table).join(keys, F.col(f"`{column}`") == F.col("k"), "left_semi").select(F.col(f"`{far}`").alias("k"))
        return registry.frame(f.through.table).join(keys.distinct(), F.col(f"`{f.through.right_key}`") == F.col("k"), "left_semi").select(F.col(f"`{f.through.left_key}`").alias("k"))
    return registry.frame(f.table).join(keys.distinct(), F.col(f"`{column}`") == F.col("k"), "left_semi").select(F.col(f"`{f.foreign_key}`").alias("k"))


def _straight(changes: DataFrame, column: str, kind) -> DataFrame:
    """A column that the key or the row before carries itself."""
    both = F.explode(F.array(F.col("key")[column], F.coalesce(F.col("before"), F.create_map().cast("map<string,string>"))[column])).alias("v")
    return changes.select(both).select(typed_key(F.col("v"), kind, column).alias("k")).where("k is not null")


def _link(f: Field) -> tuple:
    """What a hop over a relation depends on: fields of one link have it in common."""
    own = f.type == "belongs_to"
    return own, f.table, f.foreign_key, f.column if own else None, f.primary_key if own or f.through else None, f.through


def _node(path: tuple[Field, ...]) -> tuple:
    return tuple((_link(f), f.primary_key) for f in path)


def affected(schema: Schema, registry: Registry, changes: DataFrame, touched: set[str] | None = None) -> DataFrame:
    """Distinct root keys (in the root's own types) whose documents may have changed.

    Paths of the same links are walked once, and keys that meet in one table go on together.
    ``touched``: the changed tables, where they are known.
    """
    types = registry.frame(schema.table).schema
    root = changes.where(F.col("table") == schema.table)
    own = root.select(*(typed_key(F.col("key")[k], types[k].dataType, k).alias(k) for k in schema.primary_key))
    found = [own]
    paths = relation_paths(schema)
    above: dict[tuple, list[DataFrame]] = defaultdict(list)  # keys (k) of a node's rows, by its path
    for length in range(max(map(len, paths), default=0), 0, -1):
        hops: dict[tuple, tuple[tuple[Field, ...], str, list[DataFrame]]] = {}
        seen = set()

        def hop(path: tuple[Field, ...], column: str, keys: DataFrame) -> None:
            kind = keys.schema["k"].dataType.simpleString()  # others would be coerced
            hops.setdefault((_node(path[:-1]), _link(path[-1]), column, kind), (path, column, []))[2].append(keys)

        for path in (p for p in paths if len(p) == length):
            f, to = path[-1], _node(path[:-1])
            for deeper in above.pop(_node(path), ()) if f.kind == "join" else ():
                hop(path, f.primary_key, deeper)
            tables = {f.table} | ({f.through.table} if f.through else set())
            for table in sorted(tables if touched is None else tables & touched):
                keys = registry.key(table)
                column = keys[0] if len(keys) == 1 else f.primary_key or f.foreign_key
                if (what := (to, _link(f), table, column)) in seen:
                    continue
                seen.add(what)
                rows = changes.where(F.col("table") == table)
                kind = registry.type_of(*_parent(schema, path))
                if f.through and table == f.through.table:
                    above[to].append(_straight(rows, f.through.left_key, kind))
                    if len(keys) == 1 and keys[0] != f.through.left_key:
                        own_keys = _straight(rows, keys[0], registry.type_of(table, keys[0]))
                        above[to].append(registry.frame(table).join(own_keys.distinct(), F.col(f"`{keys[0]}`") == F.col("k"), "left_semi").select(F.col(f"`{f.through.left_key}`").alias("k")))
                    continue
                if column != f.foreign_key:  # else the hop finds nothing but its own keys
                    hop(path, column, _straight(rows, column, registry.type_of(table, column)))
                if f.foreign_key:  # known without reading the child, so also when it has gone
                    above[to].append(_straight(rows, f.foreign_key, kind))
        for (to, *_), (path, column, keys) in hops.items():
            above[to].append(_up(schema, registry, path, reduce(DataFrame.unionByName, keys).where("k is not null"), column))
    if len(schema.primary_key) == 1:
        key = schema.primary_key[0]
        found += [up.select(F.col("k").cast(types[key].dataType).alias(key)) for up in above[()]]
    return reduce(DataFrame.unionByName, found).dropna().distinct()


def split_key_changes(changes: DataFrame) -> DataFrame:
    """An update that changes a row's key becomes a delete of the old key and an upsert of the new."""
    moved = (F.col("op") == "upsert") & F.col("before").isNotNull() & F.exists(F.map_keys("key"), lambda k: F.col("before")[k].isNotNull() & (F.col("before")[k] != F.col("key")[k]))
    old = F.struct(F.lit("delete").alias("op"), F.map_filter("before", lambda k, v: F.map_contains_key("key", k)).alias("key"))
    new = F.struct("op", "key")
    return changes.withColumn("e", F.explode(F.when(moved, F.array(old, new)).otherwise(F.array(new)))).select("table", "e.op", "e.key", "before", "seq")


def missing_tables(schemas: list[Schema], feed: set[str]) -> dict[str, list[str]]:
    """For each index the tables it reads that the change feed does not carry."""
    return {s.index: sorted(set(s.tables()) - feed) for s in schemas}
