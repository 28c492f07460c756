"""Typed Python bindings of a schema, for a type checker: field names and operations that don't exist are found before anything runs.

``bindings`` writes a module: a ``TypedDict`` for each object of the document, a class
of handles for each, with the variants of enums as ``Literal``s, and the content hash of the schema
that it was made from.  ``check_bindings`` tells whether a module still fits.
"""

from __future__ import annotations

import keyword
import re

from .mapping import content_hash, nullable
from .model import Field, Schema, SchemaError

# fixed values: declared type -> Python type, handle class
_PYTHON = {"boolean": "bool", "short": "int", "integer": "int", "long": "int", "float": "float", "double": "float", "decimal": "decimal.Decimal", "date": "datetime.date", "timestamp": "datetime.datetime", "binary": "bytes", "json": "Any"}
_HANDLE = {"text": "Text", "identifier": "Text", "keyword": "Keyword", "enum": "Keyword", "uuid": "Keyword", "binary": "Handle", "json": "JsonField"}


def _class_name(path: tuple[str, ...]) -> str:
    return "".join(w[:1].upper() + w[1:] for p in path for w in re.split(r"[^0-9A-Za-z]+", p) if w) or "Document"


def _kind(f: Field) -> str:
    if f.kind == "aggregate":
        return {"count": "long", "avg": "double"}.get(f.type) or f.value_type or "keyword"
    if f.kind == "constant":
        return {bool: "boolean", int: "long", float: "double"}.get(type(f.value), "keyword")
    return f.type


def _value(f: Field, name: str, keys: tuple[str, ...]) -> str:
    if f.kind in ("object", "join"):
        out = f"list[{name}]" if f.to_many else name
    elif f.kind == "geo":
        out = "dict[str, float]"
    elif f.kind == "map":
        out = f"dict[str, {_PYTHON.get(f.value_type or '', 'str')}]"
    elif f.variants:
        out = f"Literal[{', '.join(map(repr, f.variants))}]"
    else:
        out = _PYTHON.get(_kind(f), "str")
        out = f"list[{out}]" if f.kind == "aggregate" and f.type == "ids" else out
    return f"{out} | None" if nullable(f, keys) else out


def _handle(f: Field, name: str) -> str:
    if f.kind in ("object", "join"):
        return f"{name}Fields"
    if f.kind == "geo":
        return "GeoPoint"
    if f.kind == "map":
        return "MapField"
    return "Keyword" if f.type == "ids" else _HANDLE.get(_kind(f), "Value")


def bindings(schema: Schema) -> str:
    """The module's source."""
    blocks: list[str] = []

    def visit(fields: tuple[Field, ...], path: tuple[str, ...], keys: tuple[str, ...], nested: bool) -> None:
        values, handles = [], []
        for f in fields:
            if f.kind in ("object", "join"):
                visit(f.fields, (*path, f.name), (f.primary_key,) if f.primary_key else (), f.to_many)
            inner = _class_name((*path, f.name))
            values.append(f"    {f.name!r}: {_value(f, inner, keys)},")
            if f.name.isidentifier() and not keyword.iskeyword(f.name):
                handles.append(f"    {f.name}: {_handle(f, inner)}")
        name = _class_name(path)
        blocks.append(f"{name} = TypedDict({name!r}, {{\n" + "\n".join(values) + "\n})\n")
        blocks.append(f"class {name}Fields({'NestedField' if nested else 'Group'}):\n" + ("\n".join(handles) or "    pass") + "\n")

    visit(schema.fields, (schema.index,), schema.primary_key, False)
    head = f'"""Fields of the documents of `{schema.index}`.  Written from its schema: do not edit."""\n\nfrom __future__ import annotations\n\nimport datetime\nimport decimal\nfrom typing import Any, Literal, TypedDict, cast\n\nfrom docweave.operators.handles import GeoPoint, Group, Handle, JsonField, Keyword, MapField, NestedField, Text, Value\nfrom docweave.operators.search import Index\n\nSCHEMA_HASH = "{content_hash(schema)}"\n\n\n'
    root = _class_name((schema.index,))
    tail = f"\n\ndef fields_of(index: Index) -> {root}Fields:\n    return cast({root}Fields, index.fields)\n"
    return head + "\n\n".join(blocks) + tail


def check_bindings(source: str, schema: Schema) -> None:
    """Raises where the module was written from another schema."""
    found = re.search(r'^SCHEMA_HASH = "([0-9a-f]+)"$', source, re.M)
    if found is None or found[1] != content_hash(schema):
        raise SchemaError(schema.index, "the bindings were written from another schema; write them again")
