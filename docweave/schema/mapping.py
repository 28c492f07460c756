"""What a schema gives: a Spark type, an index mapping, a content hash, an example."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import types as T

from .model import Field, Schema
from .parse import schema_dict

# fixed values: declared type -> Spark type, index type
SPARK = {
    "text": T.StringType(), "identifier": T.StringType(), "keyword": T.StringType(), "enum": T.StringType(), "uuid": T.StringType(), "boolean": T.BooleanType(),
    "short": T.ShortType(), "integer": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "decimal": T.DecimalType(38, 10),
    "date": T.DateType(), "timestamp": T.TimestampType(), "binary": T.BinaryType(), "json": T.VariantType(),
}
INDEX = {"identifier": "text", "enum": "keyword", "uuid": "keyword", "decimal": "double", "timestamp": "date", "json": "object"}
GEO = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])


def _leaf(f: Field) -> T.DataType:
    if f.kind == "geo":
        return GEO
    if f.kind == "map":
        return T.MapType(T.StringType(), SPARK[f.value_type])
    if f.kind == "constant":
        kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}
        return kinds.get(type(f.value), T.StringType())
    if f.kind == "aggregate":
        if f.type == "count":
            return T.LongType()
        if f.type == "avg":
            return T.DoubleType()
        return T.ArrayType(SPARK[f.value_type], True) if f.type == "ids" else SPARK[f.value_type]
    return SPARK.get(f.type, T.StringType())


def nullable(f: Field, keys: tuple[str, ...] = ()) -> bool:
    if f.kind == "scalar":
        return not (f.required or f.default is not None or f.column in keys)
    if f.kind == "join":
        return not (f.to_many or f.required)
    if f.kind == "aggregate":
        return f.type not in ("count", "ids")
    if f.kind == "constant":
        return f.value is None or isinstance(f.value, (list, dict))
    return f.kind != "object" and not f.required


def _type(f: Field) -> T.DataType:
    if f.kind not in ("object", "join"):
        return _leaf(f)
    inner = T.StructType([T.StructField(x.name, _type(x), nullable(x, (f.primary_key,) if f.primary_key else ()), _meta(x)) for x in f.fields])
    return T.ArrayType(inner, False) if f.to_many else inner


def _meta(f: Field) -> dict[str, Any]:
    out: dict[str, Any] = {"type": f.type}
    if f.variants:
        out["variants"] = list(f.variants)
    if f.options:
        out["options"] = json.loads(json.dumps(f.options, default=str))
    return out


def document_type(s: Schema) -> T.StructType:
    """Declared types; a decimal takes its source column's precision when assembled."""
    return T.StructType([T.StructField(f.name, _type(f), nullable(f, s.primary_key), _meta(f)) for f in s.fields])


def content_hash(s: Schema) -> str:
    """FNV-1a (32 bits) of the canonical JSON of the parsed schema."""
    h = 0x811C9DC5
    for b in json.dumps(schema_dict(s), sort_keys=True, default=str).encode():
        h = ((h ^ b) * 0x01000193) & 0xFFFFFFFF
    return f"{h:08x}"


ANALYSIS = {
    "analyzer": {
        "text": {"type": "custom", "tokenizer": "standard", "filter": ["lowercase", "asciifolding"]},
        "code": {"type": "custom", "tokenizer": "whitespace", "filter": ["code_words", "flatten_graph", "lowercase", "asciifolding"]},
    },
    "filter": {"code_words": {"type": "word_delimiter_graph", "catenate_all": True, "preserve_original": True}},
    "normalizer": {"lowercase": {"type": "custom", "filter": ["lowercase", "asciifolding"]}},
}


def _property(f: Field, subfields: bool) -> dict[str, Any]:
    if f.kind in ("object", "join"):
        body: dict[str, Any] = {"properties": {x.name: _property(x, subfields) for x in f.fields}}
        return ({"type": "nested"} if f.to_many else {"type": "object"}) | body | f.options
    if f.kind == "map":
        return {"type": "object", "dynamic": True} | f.options
    if f.kind == "geo":
        return {"type": "geo_point"} | f.options
    kind = f.index_type or f.type
    if f.kind == "aggregate":
        kind = {"count": "long", "avg": "double"}.get(f.type) or f.value_type
    elif f.kind == "constant":
        kind = {bool: "boolean", int: "long", float: "double"}.get(type(f.value), "keyword")
    out: dict[str, Any] = {"type": INDEX.get(kind, kind)}
    lower = {"type": "keyword", "normalizer": "lowercase", "ignore_above": 256}
    if out["type"] == "text":
        out["analyzer"] = "code" if kind == "identifier" else "text"
        if subfields:
            out["fields"] = {"keyword": {"type": "keyword", "ignore_above": 256}, "keyword_lowercase": lower}
    elif out["type"] == "keyword" and subfields and f.kind == "scalar":
        out["fields"] = {"text": {"type": "text", "analyzer": "code"}, "keyword_lowercase": lower}
        if f.variants:
            out["fields"]["sort"] = {"type": "keyword"}
    return out | f.options


def index_body(s: Schema, auto_subfields: bool = True, shards: int = 1, replicas: int = 1) -> dict[str, Any]:
    """Settings and strict mapping for a search index of these documents."""
    return {
        "settings": {"number_of_shards": shards, "number_of_replicas": replicas, "refresh_interval": "10s", "analysis": ANALYSIS},
        "mappings": {"dynamic": "strict", "_meta": {"hash": content_hash(s)}, "properties": {f.name: _property(f, auto_subfields) for f in s.fields}},
    }


_EXAMPLES = {"boolean": True, "short": 1, "integer": 1, "long": 1, "float": 1.5, "double": 1.5, "decimal": 9.99, "date": "2024-01-31", "timestamp": "2024-01-31T12:00:00Z", "uuid": "00000000-0000-0000-0000-000000000000", "binary": "AA==", "json": {}}


def example_document(s: Schema) -> dict[str, Any]:
    """A made-up document of the schema's shape."""

    def one(f: Field) -> Any:
        if f.kind in ("object", "join"):
            inner = {x.name: one(x) for x in f.fields}
            return [inner] if f.to_many else inner
        if f.kind == "constant":
            return f.value
        if f.kind == "geo":
            return {"lat": 45.0, "lon": 9.0}
        if f.kind == "map":
            return {"key": _EXAMPLES.get(f.value_type, f.name)}
        if f.kind == "aggregate":
            return {"count": 1, "avg": 1.5, "ids": [_EXAMPLES.get(f.value_type, "id")]}.get(f.type, _EXAMPLES.get(f.value_type, "x"))
        return f.variants[0] if f.variants else _EXAMPLES.get(f.type, f.name)

    return {f.name: one(f) for f in s.fields}
