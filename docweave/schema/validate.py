"""A schema against the tables there are: errors and warnings, never a failure."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from ..sources.registry import Registry
from .model import Field, Filter, Schema

_TEXT = (T.StringType,)
_JSON = (T.VariantType, T.StructType, T.MapType, T.ArrayType, T.StringType)
# fixed values: the column types that a declared type accepts
ACCEPTS = {
    "text": _TEXT, "identifier": _TEXT, "keyword": _TEXT, "enum": _TEXT, "uuid": _TEXT, "boolean": (T.BooleanType,),
    "short": (T.ShortType, T.ByteType), "integer": (T.IntegerType, T.ShortType, T.ByteType), "long": (T.LongType, T.IntegerType, T.ShortType), "float": (T.FloatType,), "double": (T.DoubleType, T.FloatType), "decimal": (T.DecimalType, T.DoubleType, T.LongType, T.IntegerType),
    "date": (T.DateType,), "timestamp": (T.TimestampType, T.TimestampNTZType, T.DateType), "binary": (T.BinaryType,), "json": _JSON, "map": (T.MapType, T.StringType, T.VariantType), "geo": (T.StructType, T.ArrayType, T.StringType),
}


@dataclass(frozen=True)
class Diagnostic:
    level: str
    path: str
    message: str


def validate(schema: Schema, registry: Registry) -> list[Diagnostic]:
    out: list[Diagnostic] = []

    def error(path: str, message: str) -> None:
        out.append(Diagnostic("error", path, message))

    def column(path: str, table: str, name: str | None) -> T.DataType | None:
        if name is None or table not in registry:
            return None
        df = registry.frame(table)
        if name not in df.columns:
            error(path, f"`{table}` has no column `{name}`")
            return None
        return df.schema[name].dataType

    def typed(path: str, table: str, name: str | None, declared: str) -> None:
        have = column(path, table, name)
        inner = have.elementType if isinstance(have, T.ArrayType) and declared not in ("json", "geo") else have
        if have is not None and declared in ACCEPTS and not isinstance(inner, ACCEPTS[declared]):
            error(path, f"`{declared}` cannot be read from `{table}.{name}`, a {have.simpleString()}")

    def filters(path: str, table: str, fs: tuple[Filter, ...]) -> None:
        for f in fs:
            if f.column:
                column(path, table, f.column)

    def visit(fields: tuple[Field, ...], table: str, above: str) -> None:
        for f in fields:
            path = f"{above}.{f.name}" if above else f.name
            if f.kind == "scalar":
                typed(path, table, f.column, f.type)
                if f.required and f.default is None and table in registry and f.column in registry.frame(table).columns and registry.frame(table).schema[f.column].nullable:
                    out.append(Diagnostic("warning", path, f"required, but `{table}.{f.column}` may be null"))
            elif f.kind == "map":
                typed(path, table, f.column, "map")
            elif f.kind == "geo":
                typed(path, table, f.column, "geo")
                for c in (f.lat, f.lon):
                    column(path, table, c)
            elif f.kind == "object":
                visit(f.fields, table, path)
            elif f.kind in ("join", "aggregate"):
                if f.table not in registry:
                    error(path, f"there is no table `{f.table}`")
                    continue
                filters(path, f.table, f.filters)
                for o in f.order_by:
                    column(path, f.table, o.column)
                if f.through:
                    if f.through.table not in registry:
                        error(path, f"there is no table `{f.through.table}`")
                    column(path, f.through.table, f.through.left_key)
                    column(path, f.through.table, f.through.right_key)
                elif f.type == "belongs_to":
                    column(path, table, f.column)
                else:
                    column(path, f.table, f.foreign_key)
                if f.kind == "aggregate":
                    have = column(path, f.table, f.column)
                    if f.type in ("sum", "avg") and have is not None and not isinstance(have, T.NumericType):
                        error(path, f"`{f.type}` of `{f.table}.{f.column}`, a {have.simpleString()}")
                    if f.type == "ids" and f.through and f.filters:
                        out.append(Diagnostic("warning", path, "ids through a junction do not read the far table: its filters have no effect"))
                else:
                    column(path, f.table, f.primary_key)
                    visit(f.fields, f.table, path)

    if schema.table not in registry:
        error("table", f"there is no table `{schema.table}`")
        return out
    for k in schema.primary_key:
        column("primary_key", schema.table, k)
    filters("filters", schema.table, schema.filters)
    if schema.soft_delete:
        if schema.soft_delete_column is None:
            out.append(Diagnostic("warning", "soft_delete", f"no field `{schema.soft_delete.field}` of the root row: nothing is soft-deleted"))
        column("soft_delete", schema.table, schema.soft_delete_column)
        filters("soft_delete", schema.table, schema.soft_delete.when)
    visit(schema.fields, schema.table, "")
    return out
