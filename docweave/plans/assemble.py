"""A schema to one DataFrame plan that builds whole documents, bottom up.

Each relation is built once for all parents: filtered, its own relations folded
in, grouped by the key that links it, joined to the parents on that key.  All
relations of a node but ``belongs_to`` link by the node's own key, so they are joined one
after the other on one partitioning.  Aggregates over the same table and link
share one ``groupBy``.  With ``only``, every level is first cut to the keys that
the level above asks for, so a small batch does not aggregate whole tables (a batch of
many keys cuts the root alone); up to
``LITERAL_KEYS`` keys are literals, which the scans of the root and its relations push down.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import rows
from ..schema.mapping import SPARK
from ..schema.model import Field, Schema, SchemaError
from ..sources.registry import Registry


#: Fixed value: keys in one literal list at most.
LITERAL_KEYS = 512
#: Fixed value: relations are cut to a batch of keys under this share of the root's rows (one in so many).
CUT_BELOW = 8


class _Names:
    def __init__(self) -> None:
        self.n = 0

    def __call__(self) -> str:
        self.n += 1
        return f"__v{self.n}"


def _flat(fields: tuple[Field, ...]):
    """Fields of the node's own row and relations, objects opened."""
    for f in fields:
        if f.kind == "object":
            yield from _flat(f.fields)
        else:
            yield f


def _all(fields: tuple[Field, ...]):
    for f in fields:
        yield f
        yield from _all(f.fields)


def _columns_of(f: Field) -> list[str]:
    return [c for c in (f.column, f.lat, f.lon) if c] if f.kind in ("scalar", "map", "geo") else []


class Assembler:
    def __init__(self, registry: Registry) -> None:
        self.registry, self.name = registry, _Names()

    def _read(self, table: str, filters, needed: set[str]) -> DataFrame:
        df = rows.where(self.registry.frame(table), filters)
        if missing := needed - set(df.columns):
            raise SchemaError(table, f"no column `{sorted(missing)[0]}`")
        return df.select(*(f"`{c}`" for c in df.columns if c in needed))

    def _needs(self, fields: tuple[Field, ...]) -> set[str]:
        out: set[str] = set()
        for f in _flat(fields):
            out.update(_columns_of(f))
            if f.type == "belongs_to":
                out.add(f.column)
        return out

    def node(self, df: DataFrame, key: str | None, fields: tuple[Field, ...], cut: bool, known: list | None = None) -> tuple[DataFrame, list[Column]]:
        """``df`` with all relations joined, and the node's values in order.  ``known``: the node's keys, where they are few."""
        own = [f for f in _flat(fields) if f.kind in ("join", "aggregate")]
        if key is None and any(f.type != "belongs_to" for f in own):
            raise SchemaError(own[0].name, "a relation needs a parent key of one column")
        made: dict[int, Column] = {}
        for f in (f for f in own if f.type == "belongs_to"):
            df, made[id(f)] = self._belongs_to(df, f, cut)
        parents = known if known is not None else df.select(F.col(f"`{key}`").alias("__k")).distinct() if cut and own else None
        groups: dict[tuple, list[Field]] = defaultdict(list)
        for f in own:
            if f.kind == "aggregate":
                groups[f.table, f.foreign_key, f.through].append(f)
        for fused in groups.values():
            child, values = self._aggregates(fused, parents)
            link = self.name()
            df = df.join(child.withColumnRenamed("__k", link), F.col(f"`{key}`") == F.col(link), "left").drop(link)
            made |= values
        for f in own:
            if f.kind == "join" and f.type != "belongs_to":
                child, out = self._children(f, parents, cut), self.name()
                link = self.name()
                child = child.select(F.col("__k").alias(link), F.col("__value").alias(out))
                df = df.join(child, F.col(f"`{key}`") == F.col(link), "left").drop(link)
                c = F.col(out)
                made[id(f)] = F.coalesce(c, F.array().cast(df.schema[out].dataType)) if f.to_many else c

        def values_of(fs: tuple[Field, ...]) -> list[Column]:
            return [(F.struct(*values_of(f.fields)) if f.kind == "object" else made[id(f)] if id(f) in made else rows.value(df, f)).alias(f.name) for f in fs]

        return df, values_of(fields)

    def _cut(self, df: DataFrame, column: str, parents: DataFrame | list | None) -> DataFrame:
        if isinstance(parents, list):
            return df.where(F.col(f"`{column}`").isin(*(F.lit(k).cast(df.schema[column].dataType) for k in parents)) if parents else F.lit(False))
        return df if parents is None else df.join(parents, F.col(f"`{column}`") == F.col("__k"), "left_semi")

    def _belongs_to(self, df: DataFrame, f: Field, cut: bool) -> tuple[DataFrame, Column]:
        child = self._read(f.table, f.filters, self._needs(f.fields) | {f.primary_key})
        if cut:
            child = self._cut(child, f.primary_key, df.select(F.col(f"`{f.column}`").alias("__k")).distinct())
        if self.registry.key(f.table) != (f.primary_key,):  # at most one row
            w = Window.partitionBy(f.primary_key).orderBy(*(F.col(f"`{c}`").asc_nulls_last() for c in child.columns))
            child = child.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
        child, values = self.node(child, f.primary_key, f.fields, cut)
        link, out = self.name(), self.name()
        child = child.select(F.col(f"`{f.primary_key}`").alias(link), F.struct(*values).alias(out))
        return df.join(child, F.col(f"`{f.column}`") == F.col(link), "left").drop(link), F.col(out)

    def _linked(self, f: Field, needed: set[str], parents: DataFrame | list | None) -> DataFrame:
        """Related rows with the parent's key as __k."""
        if f.through is None:
            child = self._cut(self._read(f.table, f.filters, needed | {f.foreign_key}), f.foreign_key, parents)
            return child.withColumn("__k", F.col(f"`{f.foreign_key}`")).where("__k is not null")
        junction = self._read(f.through.table, (), {f.through.left_key, f.through.right_key})
        junction = self._cut(junction, f.through.left_key, parents).select(F.col(f"`{f.through.left_key}`").alias("__k"), F.col(f"`{f.through.right_key}`").alias("__far")).where("__k is not null")
        key = f.primary_key or self._far_key(f)
        far = self._read(f.table, f.filters, needed | {key})
        return junction.join(far, F.col("__far") == F.col(f"`{key}`")).drop("__far")

    def _far_key(self, f: Field) -> str:
        key = self.registry.key(f.table)
        if len(key) != 1:
            raise SchemaError(f.name, f"`{f.table}` needs a key of one column")
        return key[0]

    def _children(self, f: Field, parents: DataFrame | list | None, cut: bool) -> DataFrame:
        needed = self._needs(f.fields) | {f.primary_key} | {o.column for o in f.order_by}
        child = self._linked(f, needed, parents)
        order = rows.ordering(f.order_by)
        ties = [c for c in dict.fromkeys([f.primary_key, *(c for x in _flat(f.fields) for c in _columns_of(x))]) if not isinstance(child.schema[c].dataType, (T.MapType, T.VariantType))]
        most = 1 if f.type == "has_one" else f.limit
        sortable = rows.sort_keys(child, f.order_by, ties) if most is None and not any(x.kind == "map" or x.type == "json" for x in _all(f.fields)) else None
        if sortable:  # sorted as they are collected
            child = child.withColumn("__n", F.struct(*sortable))
        else:
            w = Window.partitionBy("__k").orderBy(*order, *(F.col(f"`{c}`").asc_nulls_last() for c in ties))
            child = child.withColumn("__n", F.row_number().over(w))
        if most is not None:  # top rows of each parent, before anything is joined to them
            child = child.where(F.col("__n") <= most)
        child, values = self.node(child, f.primary_key, f.fields, cut)
        child = child.select("__k", "__n", F.struct(*values).alias("__value"))
        if f.type == "has_one":
            return child.drop("__n")
        every = F.collect_list(F.struct("__n", "__value"))
        if sortable:
            grouped = child.groupBy("__k").agg(F.sort_array(every).alias("__all"))
        else:
            grouped = child.groupBy("__k").agg(every.alias("__all")).withColumn("__all", F.array_sort("__all", lambda a, b: F.when(a["__n"] < b["__n"], -1).when(a["__n"] > b["__n"], 1).otherwise(0)))
        return grouped.select("__k", F.transform("__all", lambda x: x["__value"]).alias("__value"))

    def _aggregates(self, fused: list[Field], parents: DataFrame | list | None) -> tuple[DataFrame, dict[int, Column]]:
        first = fused[0]
        if first.through and all(f.type == "ids" for f in fused):
            # ids through a junction never read the far table
            j = self._read(first.through.table, (), {first.through.left_key, first.through.right_key})
            child = self._cut(j, first.through.left_key, parents).select(F.col(f"`{first.through.left_key}`").alias("__k"), F.col(f"`{first.through.right_key}`").alias("__far")).where("__k is not null")
            conditions = {id(f): None for f in fused}
        else:
            if first.through and any(f.type == "ids" for f in fused):
                ids = [f for f in fused if f.type == "ids"]
                rest = [f for f in fused if f.type != "ids"]
                a, x = self._aggregates(ids, parents)
                b, y = self._aggregates(rest, parents)
                return a.join(b.withColumnRenamed("__k", "__k2"), F.col("__k") == F.col("__k2"), "full").withColumn("__k", F.coalesce("__k", "__k2")).drop("__k2"), x | y
            same = len({f.filters for f in fused}) == 1
            table = self.registry.frame(first.table)
            needed = {f.column for f in fused if f.column}
            if not same:  # conditions are computed on the table's own columns
                needed |= set(table.columns)
            link = Field(kind="aggregate", type=first.type, name=first.name, table=first.table, foreign_key=first.foreign_key, through=first.through, filters=first.filters if same else ())
            child = self._linked(link, needed, parents)
            conditions = {id(f): None if same or not f.filters else rows.all_of(child, f.filters) for f in fused}
        aggs, values = [], {}
        for f in fused:
            out, when = self.name(), conditions[id(f)]

            def pick(c: Column) -> Column:
                return c if when is None else F.when(when, c)

            if f.type == "count":
                aggs.append(F.count(pick(F.lit(1))).alias(out))
                values[id(f)] = F.coalesce(F.col(out), F.lit(0).cast("long"))
                continue
            if f.type == "ids":
                c = F.col("__far" if first.through else f"`{f.column}`").cast(SPARK[f.value_type])
                s = F.struct(c.alias("id"))
                aggs.append(F.sort_array(F.collect_list(pick(s))).alias(out))
                values[id(f)] = F.coalesce(F.transform(out, lambda x: x["id"]), F.array().cast(T.ArrayType(SPARK[f.value_type])))
                continue
            c = F.col(f"`{f.column}`")
            want = SPARK[f.value_type] if f.value_type else T.DoubleType()
            if f.type == "avg":
                c = F.avg(pick(c.cast("double")))
            elif f.type == "sum":
                decimal = f.value_type == "decimal" and not isinstance(child.schema[f.column].dataType, T.DecimalType)
                c = F.sum(pick(c.cast(T.DecimalType(28, 10)) if decimal else c))
            else:
                c = (F.min if f.type == "min" else F.max)(pick(c))
            aggs.append((c if f.value_type == "decimal" else c.cast(want)).alias(out))
            values[id(f)] = F.col(out)
        return child.groupBy("__k").agg(*aggs), values


def root_rows(schema: Schema, registry: Registry) -> DataFrame:
    """Root rows that are documents: filtered, and not soft-deleted."""
    df = registry.frame(schema.table)
    return rows.live(rows.where(df, schema.filters), schema.soft_delete, schema.soft_delete_column)


def _documents(schema: Schema, registry: Registry, only: DataFrame | list[tuple] | None, cut: bool) -> tuple[DataFrame, Column, list[Column]]:
    """Rows with all relations joined, their ``_id`` and the fields' values.  ``cut``: relations are cut to the keys of ``only`` too."""
    df = root_rows(schema, registry)
    build = Assembler(registry)
    needed = build._needs(schema.fields) | set(schema.primary_key)
    if missing := needed - set(df.columns):
        raise SchemaError(schema.table, f"no column `{sorted(missing)[0]}`")
    known = None
    if isinstance(only, list):  # before columns are chosen, so that it reaches the scan with the filters
        if len(only) > LITERAL_KEYS:
            raise ValueError(f"{len(only)} keys: more than {LITERAL_KEYS} go in a DataFrame")
        only = [k if isinstance(k, tuple) else (k,) for k in only]
        if len(schema.primary_key) == 1:
            known = [k for k, in only]
            df = build._cut(df, schema.primary_key[0], known)
        else:
            each = (reduce(lambda a, b: a & b, (F.col(f"`{c}`") == F.lit(v).cast(df.schema[c].dataType) for c, v in zip(schema.primary_key, key, strict=True))) for key in only)
            df = df.where(reduce(lambda a, b: a | b, each, F.lit(False)))
    df = df.select(*(f"`{c}`" for c in df.columns if c in needed))
    df = df.where(reduce(lambda a, b: a & b, (F.col(f"`{k}`").isNotNull() for k in schema.primary_key)))
    if isinstance(only, DataFrame):
        keys = only.select(*(F.col(f"`{k}`").cast(df.schema[k].dataType).alias(f"__only_{k}") for k in schema.primary_key))
        df = df.join(keys, reduce(lambda a, b: a & b, (F.col(f"`{k}`") == F.col(f"__only_{k}") for k in schema.primary_key)), "left_semi")
    key = schema.primary_key[0] if len(schema.primary_key) == 1 else None
    identity = rows.document_id(df, schema.primary_key)
    df, values = build.node(df, key, schema.fields, cut and only is not None, known)
    return df, identity, values


def assemble(schema: Schema, registry: Registry, only: DataFrame | list[tuple] | None = None) -> DataFrame:
    """All documents: ``_id`` and a column for each field.

    ``only``: the root's keys to build, in a DataFrame with the key columns, or a few as a list.
    """
    df, identity, values = _documents(schema, registry, only, True)
    return df.select(identity.alias("_id"), *values)


def build_one(schema: Schema, registry: Registry, *key: Any) -> DataFrame:
    """The document of one key, or no row."""
    return assemble(schema, registry, [key])


def build_many(schema: Schema, registry: Registry, keys: DataFrame) -> DataFrame:
    """(_id, op, doc): an upsert for each key that is a document, a delete for each that is not."""
    keys = keys.select(*(f"`{k}`" for k in schema.primary_key)).distinct()
    types = registry.frame(schema.table).schema
    typed = keys.select(*(F.col(f"`{k}`").cast(types[k].dataType).alias(k) for k in schema.primary_key))
    n = typed.count()
    one = len(schema.primary_key) == 1
    only = [tuple(r) for r in typed.collect()] if one and n <= LITERAL_KEYS else keys
    # a cut to most of the keys there are costs a sort of every table and leaves little out
    cut = isinstance(only, list) or n * CUT_BELOW < registry.frame(schema.table).count()
    df, _, values = _documents(schema, registry, only, cut)
    docs = df.select(*(F.col(f"`{k}`").alias(f"__doc_{k}") for k in schema.primary_key), F.struct(*values).alias("doc"))
    asked = typed.select("*", rows.document_id(typed, schema.primary_key).alias("_id"))
    # by key: documents lie by it already, and are not dealt out again
    same = reduce(lambda a, b: a & b, (F.col(f"`{k}`") == F.col(f"`__doc_{k}`") for k in schema.primary_key))
    return asked.join(docs, same, "left").select("_id", F.when(F.col("doc").isNull(), "delete").otherwise("upsert").alias("op"), "doc")


def sample_document(schema: Schema, registry: Registry) -> DataFrame:
    """The first document by key."""
    first = root_rows(schema, registry).select(*schema.primary_key).dropna().orderBy(*schema.primary_key).head(1)
    return assemble(schema, registry, [tuple(r) for r in first])


def preview(schema: Schema, registry: Registry, key: Any = None) -> DataFrame:
    """(_id, document): one real document as JSON, that of ``key`` or the first."""
    docs = sample_document(schema, registry) if key is None else build_one(schema, registry, *(key if isinstance(key, tuple) else (key,)))
    return docs.select("_id", F.to_json(F.struct(*(f"`{f.name}`" for f in schema.fields)), {"ignoreNullFields": "false"}).alias("document"))
