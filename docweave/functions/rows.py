"""Column expressions over source rows: filters, transforms, typed values, keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..schema.mapping import GEO, SPARK
from ..schema.model import Field, Filter, SchemaError, SoftDelete


def predicate(df: DataFrame, f: Filter) -> Column:
    """Three-valued, as in SQL.  Operands take the column's type, so scans can use them."""
    if f.op == "raw":
        return F.expr(f.values[0])
    if f.column not in df.columns:
        raise SchemaError(f.column or "", "no such column")
    kind, c = df.schema[f.column].dataType, F.col(f"`{f.column}`")
    if f.op in ("like", "ilike"):
        return getattr(c.cast("string"), f.op)(f.values[0])
    v = [F.lit(x).cast(kind) for x in f.values]
    match f.op:
        case "eq":
            return c == v[0]
        case "neq":
            return c != v[0]
        case "lt":
            return c < v[0]
        case "lte":
            return c <= v[0]
        case "gt":
            return c > v[0]
        case "gte":
            return c >= v[0]
        case "in":
            return c.isin(*v) if v else F.lit(False)
        case "not_in":
            return ~c.isin(*v) if v else F.lit(True)
        case "between":
            return c.between(v[0], v[1])
        case "is_null":
            return c.isNull()
        case "is_not_null":
            return c.isNotNull()
    raise SchemaError(f.column or "", f"unknown filter op `{f.op}`")


def all_of(df: DataFrame, filters: tuple[Filter, ...]) -> Column:
    return reduce(lambda a, b: a & b, (predicate(df, f) for f in filters), F.lit(True))


def where(df: DataFrame, filters: tuple[Filter, ...]) -> DataFrame:
    for f in filters:
        df = df.where(predicate(df, f))
    return df


def live(df: DataFrame, soft_delete: SoftDelete | None, column: str | None) -> DataFrame:
    """Rows that are not soft-deleted.  A boolean marker counts by its value, any other by being there."""
    if soft_delete is None or column is None or column not in df.columns:
        return df
    c = F.col(f"`{column}`")
    gone = c if isinstance(df.schema[column].dataType, T.BooleanType) else c.isNotNull()
    gone = gone & all_of(df, soft_delete.when)
    return df.where(~F.coalesce(gone, F.lit(False)))


def typed(c: Column, have: T.DataType, declared: str) -> Column:
    want = SPARK.get(declared)
    if want is None or declared == "custom":
        return c
    if declared == "json":
        return c if isinstance(have, T.VariantType) else F.parse_json(c.cast("string"))
    if declared == "uuid":
        return F.lower(c.cast("string"))
    if declared == "decimal":
        return c if isinstance(have, T.DecimalType) else c.cast(want)
    if declared == "timestamp" and isinstance(have, (T.TimestampType, T.DateType)):
        return c
    return c if have == want else c.cast(want)


def scalar(df: DataFrame, f: Field) -> Column:
    if f.column not in df.columns:
        raise SchemaError(f.name, f"no column `{f.column}`")
    have, c = df.schema[f.column].dataType, F.col(f"`{f.column}`")
    for t in f.transforms:
        c = F.lower(c) if t == "lowercase" else F.trim(c)
    c = typed(c, have, f.type)
    if f.default is not None:
        c = F.coalesce(c, F.lit(str(f.default) if not isinstance(f.default, bool) else f.default).cast(SPARK.get(f.type, T.StringType()) if f.type != "json" else "string"))
    return c


def geo_pair(lat: Column, lon: Column) -> Column:
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon")))


def geo_value(c: Column, have: T.DataType) -> Column:
    """{lat, lon}, [lon, lat] or "lat,lon" to a struct; null where it is none of these."""
    if isinstance(have, T.StructType):
        return geo_pair(c["lat"], c["lon"])
    if isinstance(have, T.ArrayType):
        return geo_pair(F.get(c, 1), F.get(c, 0))
    s = F.trim(c.cast("string"))
    as_object, as_list, parts = F.from_json(s, GEO), F.from_json(s, "array<double>"), F.split(s, ",")
    from_text = geo_pair(F.get(parts, 0).try_cast("double"), F.get(parts, 1).try_cast("double"))
    return F.when(s.startswith("{"), geo_pair(as_object["lat"], as_object["lon"])).when(s.startswith("["), geo_pair(F.get(as_list, 1), F.get(as_list, 0))).otherwise(from_text)


def value(df: DataFrame, f: Field) -> Column:
    """A field of the row itself (not a relation)."""
    if f.kind == "constant":
        return F.lit(None if isinstance(f.value, (list, dict)) else f.value)
    if f.kind == "geo":
        if f.column:
            return geo_value(F.col(f"`{f.column}`"), df.schema[f.column].dataType)
        return geo_pair(F.col(f"`{f.lat}`"), F.col(f"`{f.lon}`"))
    if f.kind == "map":
        have, c = df.schema[f.column].dataType, F.col(f"`{f.column}`")
        return c if isinstance(have, T.MapType) else F.from_json(c.cast("string"), T.MapType(T.StringType(), SPARK[f.value_type]))
    return scalar(df, f)


def key_text(c: Column, t: T.DataType) -> Column:
    if isinstance(t, T.BinaryType):
        return F.concat(F.lit("\\x"), F.lower(F.hex(c)))
    return c.cast("string")


def document_id(df: DataFrame, keys: tuple[str, ...]) -> Column:
    return F.concat_ws(":", *(F.coalesce(key_text(F.col(f"`{k}`"), df.schema[k].dataType), F.lit("null")) for k in keys))


def ordering(columns) -> list[Column]:
    """Ascending puts nulls last, descending first."""
    return [F.col(f"`{o.column}`").desc_nulls_first() if o.descending else F.col(f"`{o.column}`").asc_nulls_last() for o in columns]


def _reversed(c: Column, kind: T.DataType) -> list[Column] | None:
    """Columns that ascend as ``c`` descends, or None where there are none."""
    if isinstance(kind, T.IntegralType):
        return [F.bitwise_not(c)]
    if isinstance(kind, T.DecimalType):
        return [-c]
    if isinstance(kind, T.FractionalType):
        return [~F.isnan(c), -c]
    if isinstance(kind, T.DateType):
        return [F.bitwise_not(F.unix_date(c))]
    if isinstance(kind, T.TimestampType):
        return [F.bitwise_not(F.unix_micros(c))]
    return [~c] if isinstance(kind, T.BooleanType) else None


def sort_keys(df: DataFrame, order_by, ties: list[str]) -> list[Column] | None:
    """The same order as that of ``ordering`` and then ``ties``, as columns to sort ascending by; None where that can't be."""
    out: list[Column] = []
    for column, descending in (*((o.column, o.descending) for o in order_by), *((c, False) for c in ties)):
        c, kind = F.col(f"`{column}`"), df.schema[column].dataType
        if isinstance(kind, (T.MapType, T.VariantType)):
            return None
        own = _reversed(c, kind) if descending else [c]
        if own is None:
            return None
        out += [c.isNotNull() if descending else c.isNull(), *own]
    return [c.alias(f"k{i}") for i, c in enumerate(out)]
