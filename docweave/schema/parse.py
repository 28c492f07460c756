"""YAML (or a plain dict) to ``Schema``, and back.

A field is a mapping with exactly one type tag, whose value is the document key.
Every rejection names the field's path and, for a misspelt key, the nearest one.
"""

from __future__ import annotations

import difflib
import re
from typing import Any

import yaml

from .model import Field, Filter, Order, Schema, SchemaError, SoftDelete, Through

# fixed values of the schema language
SCALARS = ("text", "identifier", "keyword", "enum", "uuid", "boolean", "short", "integer", "long", "float", "double", "decimal", "date", "timestamp", "binary", "json", "custom")
JOINS = ("belongs_to", "has_one", "has_many", "many_to_many")
AGGREGATES = ("count", "sum", "avg", "min", "max", "ids")
TAGS = (*SCALARS, "geo", "map", "object", *JOINS, *AGGREGATES, "constant")
TRANSFORMS = ("lowercase", "trim")
COMPARISONS = ("eq", "neq", "lt", "lte", "gt", "gte", "like", "ilike")
NOT_MAP_VALUES = ("boolean", "binary", "json", "map", "geo", "custom", "enum")
NUMBERS = ("short", "integer", "long", "float", "double", "decimal")

_KEY = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*\Z")
_COLUMN = re.compile(r"[a-z_][a-z0-9_]{0,62}\Z")

_COMMON = {"options"}
_ALLOWED = {
    **{t: {"column", "required", "transforms", "default"} for t in SCALARS},
    "enum": {"column", "required", "transforms", "default", "variants"},
    "custom": {"column", "required", "default", "postgres", "opensearch"},
    "geo": {"column", "required", "lat", "lon"},
    "map": {"column", "required", "values"},
    "object": {"fields"},
    **{t: {"table", "primary_key", "required", "column", "foreign_key", "through", "filters", "order_by", "limit", "fields"} for t in JOINS},
    **{t: {"table", "column", "value_type", "element_type", "foreign_key", "through", "filters"} for t in AGGREGATES},
    "constant": {"value"},
}
_LINK = {"belongs_to": "column", "has_one": "foreign_key", "has_many": "foreign_key", "many_to_many": "through"}


def _unknown(path: str, given: set[str], allowed: set[str]) -> None:
    for key in sorted(given - allowed):
        near = difflib.get_close_matches(key, allowed, 1)
        raise SchemaError(path, f"unknown key `{key}`" + (f", did you mean `{near[0]}`?" if near else f"; expected one of {', '.join(sorted(allowed))}"))


def _column(path: str, value: Any) -> str:
    name = str(value).strip().lower()
    if not _COLUMN.match(name):
        raise SchemaError(path, f"`{value}` is not a column or table name")
    return name


def _maybe(path: str, body: dict, key: str) -> str | None:
    return _column(path, body[key]) if body.get(key) is not None else None


def _text(v: Any) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    return "null" if v is None else str(v)


def parse_filter(path: str, raw: Any) -> Filter:
    if not isinstance(raw, dict):
        raise SchemaError(path, "a filter is a mapping")
    if "raw" in raw:
        _unknown(path, set(raw), {"raw"})
        if not str(raw["raw"]).strip():
            raise SchemaError(path, "a raw filter is empty")
        return Filter("raw", values=(str(raw["raw"]),))
    _unknown(path, set(raw), {"column", "op", "value"})
    if "column" not in raw or "op" not in raw:
        raise SchemaError(path, "a filter needs `column` and `op`")
    column, op, value = _column(path, raw["column"]), raw["op"], raw.get("value")
    if op in ("is_null", "is_not_null"):
        if "value" in raw:
            raise SchemaError(path, f"`{op}` takes no value")
        return Filter(op, column)
    if op not in (*COMPARISONS, "in", "not_in", "between"):
        raise SchemaError(path, f"unknown filter op `{op}`")
    if "value" not in raw:
        raise SchemaError(path, f"`{op}` needs a value")
    if op in ("in", "not_in", "between"):
        if not isinstance(value, list):
            raise SchemaError(path, f"`{op}` needs a list")
        if op == "between" and len(value) != 2:
            raise SchemaError(path, f"`between` needs two values, not {len(value)}")
        return Filter(op, column, tuple(map(_text, value)))
    return Filter(op, column, (_text(value),))


def _filters(path: str, raw: Any) -> tuple[Filter, ...]:
    return tuple(parse_filter(f"{path}.filters[{i}]", x) for i, x in enumerate(raw or ()))


def _through(path: str, raw: Any) -> Through | None:
    if raw is None:
        return None
    _unknown(path, set(raw), {"table", "left_key", "right_key"})
    if missing := {"table", "left_key", "right_key"} - set(raw):
        raise SchemaError(path, f"`through` needs {', '.join(sorted(missing))}")
    return Through(*(_column(path, raw[k]) for k in ("table", "left_key", "right_key")))


def _orders(path: str, raw: Any) -> tuple[Order, ...]:
    out = []
    for x in raw or ():
        _unknown(path, set(x), {"column", "direction"})
        if x.get("direction", "asc") not in ("asc", "desc"):
            raise SchemaError(path, f"`direction` is asc or desc, not `{x['direction']}`")
        out.append(Order(_column(path, x["column"]), x.get("direction") == "desc"))
    return tuple(out)


def _require(path: str, body: dict, *keys: str) -> None:
    for k in keys:
        if body.get(k) is None:
            raise SchemaError(path, f"`{k}` is missing")


def parse_field(raw: Any, above: str = "") -> Field:
    if not isinstance(raw, dict):
        raise SchemaError(above, "a field is a mapping")
    tags = [k for k in raw if k in TAGS]
    if "doc_id" in raw:
        raise SchemaError(above, "`doc_id` cannot be set: documents are named by their key")
    if not tags:
        near = [m for k in raw for m in difflib.get_close_matches(str(k), TAGS, 1)]
        raise SchemaError(above, f"a field (keys: {', '.join(map(str, raw))}) has no type tag" + (f", did you mean `{near[0]}`?" if near else ""))
    if len(tags) > 1:
        raise SchemaError(above, f"a field has more than one type tag: {', '.join(tags)}")
    tag, name = tags[0], raw[tags[0]]
    path = f"{above}.{name}" if above else str(name)
    if not isinstance(name, str) or not _KEY.match(name):
        raise SchemaError(path, f"`{name}` is not a document key")
    body = {k: v for k, v in raw.items() if k != tag}
    _unknown(path, set(body), _ALLOWED[tag] | _COMMON)
    base = {"name": name, "type": tag, "options": body.get("options") or {}}
    if tag in SCALARS:
        _require(path, body, "required")
        transforms = tuple(body.get("transforms") or ())
        if bad := [t for t in transforms if t not in TRANSFORMS]:
            raise SchemaError(path, f"unknown transform `{bad[0]}`")
        if isinstance(body.get("default"), (list, dict)):
            raise SchemaError(path, "a default is a scalar")
        extra: dict[str, Any] = {}
        if tag == "custom":
            _require(path, body, "postgres", "opensearch")
            extra = {"source_types": tuple(body["postgres"]), "index_type": body["opensearch"]}
        return Field("scalar", column=_maybe(path, body, "column") or _column(path, name), required=bool(body["required"]), transforms=transforms, default=body.get("default"), variants=tuple(map(str, body.get("variants") or ())), **base, **extra)
    if tag == "geo":
        _require(path, body, "required")
        pair, single = body.get("lat") is not None and body.get("lon") is not None, body.get("column") is not None
        if pair == single or (body.get("lat") is None) != (body.get("lon") is None):
            raise SchemaError(path, "a geo field takes either `lat` and `lon`, or `column`")
        return Field("geo", column=_maybe(path, body, "column"), lat=_maybe(path, body, "lat"), lon=_maybe(path, body, "lon"), required=bool(body["required"]), **base)
    if tag == "map":
        _require(path, body, "required", "values")
        if body["values"] in NOT_MAP_VALUES or body["values"] not in SCALARS:
            raise SchemaError(path, f"map values cannot be `{body['values']}`")
        return Field("map", column=_maybe(path, body, "column") or _column(path, name), required=bool(body["required"]), value_type=body["values"], **base)
    if tag == "constant":
        if "value" not in body:
            raise SchemaError(path, "`value` is missing")
        return Field("constant", value=body["value"], required=True, **base)
    if tag == "object":
        _require(path, body, "fields")
        return Field("object", fields=_fields(body["fields"], path), required=True, **base)
    _require(path, body, "table")
    linked = {"foreign_key": _maybe(path, body, "foreign_key"), "through": _through(path, body.get("through")), "filters": _filters(path, body.get("filters"))}
    if tag in JOINS:
        _require(path, body, "primary_key", "fields")
        for key in ("column", "foreign_key", "through"):
            if (body.get(key) is None) == (key == _LINK[tag]):
                raise SchemaError(path, f"`{tag}` needs `{_LINK[tag]}`" if key == _LINK[tag] else f"`{tag}` does not take `{key}`")
        if tag == "belongs_to" and (body.get("order_by") or body.get("limit") is not None):
            raise SchemaError(path, "`belongs_to` takes neither `order_by` nor `limit`")
        if tag == "has_one" and body.get("limit") is not None:
            raise SchemaError(path, "`has_one` takes no `limit`")
        if tag in ("has_many", "many_to_many") and body.get("required") is not None:
            raise SchemaError(path, f"`required` means nothing for `{tag}`: it is never null")
        limit = body.get("limit")
        if limit is not None and (not isinstance(limit, int) or limit < 0):
            raise SchemaError(path, "`limit` is a number of rows")
        return Field("join", column=_maybe(path, body, "column"), table=_column(path, body["table"]), primary_key=_column(path, body["primary_key"]), order_by=_orders(path, body.get("order_by")), limit=limit, fields=_fields(body["fields"], path), required=bool(body.get("required")) or tag in ("has_many", "many_to_many"), **linked, **base)
    if (linked["foreign_key"] is None) == (linked["through"] is None):
        raise SchemaError(path, f"`{tag}` needs either `foreign_key` or `through`")
    if tag in ("sum", "avg", "min", "max"):
        _require(path, body, "column")
    if tag in ("sum", "min", "max"):
        _require(path, body, "value_type")
        if body["value_type"] not in (NUMBERS if tag == "sum" else (*NUMBERS, "date", "timestamp", "keyword", "text", "uuid")):
            raise SchemaError(path, f"`{tag}` cannot have the type `{body['value_type']}`")
    elif body.get("value_type") is not None:
        raise SchemaError(path, f"`{tag}` takes no `value_type`")
    if tag == "ids":
        _require(path, body, "element_type")
        if body["element_type"] not in ("short", "integer", "long", "keyword", "uuid", "text"):
            raise SchemaError(path, f"ids cannot be `{body['element_type']}`")
        if linked["foreign_key"] and body.get("column") is None:
            _require(path, body, "column")
    elif body.get("element_type") is not None:
        raise SchemaError(path, f"`{tag}` takes no `element_type`")
    return Field("aggregate", column=_maybe(path, body, "column"), table=_column(path, body["table"]), value_type=body.get("value_type") or body.get("element_type"), required=tag in ("count", "ids"), **linked, **base)


def _fields(raw: Any, path: str) -> tuple[Field, ...]:
    out = tuple(parse_field(x, path) for x in raw or ())
    seen: set[str] = set()
    for f in out:
        if f.name in seen:
            raise SchemaError(path, f"`{f.name}` is defined twice")
        seen.add(f.name)
    return out


def parse_schema(raw: dict[str, Any], index: str) -> Schema:
    _unknown("", set(raw), {"version", "table", "primary_key", "db_schema", "soft_delete", "filters", "fields"})
    if raw.get("version") != 1:
        raise SchemaError("version", f"only version 1 is known, not {raw.get('version')!r}")
    _require("", raw, "table", "primary_key", "fields")
    keys = raw["primary_key"] if isinstance(raw["primary_key"], list) else [raw["primary_key"]]
    soft = None
    if sd := raw.get("soft_delete"):
        _unknown("soft_delete", set(sd), {"column", "field", "when"})
        if ("column" in sd) == ("field" in sd):
            raise SchemaError("soft_delete", "needs either `column` or `field`")
        soft = SoftDelete(_maybe("soft_delete", sd, "column"), sd.get("field"), _filters("soft_delete", sd.get("when")))
    fields = _fields(raw["fields"], "")
    if not fields:
        raise SchemaError("fields", "a document needs a field")
    if len(keys) > 1 and any(f.kind in ("join", "aggregate") and f.type != "belongs_to" for f in fields):
        raise SchemaError("primary_key", "relations need a root key of one column")
    return Schema(index, _column("table", raw["table"]), tuple(_column("primary_key", k) for k in keys), fields, soft, _filters("", raw.get("filters")), _maybe("db_schema", raw, "db_schema"))


def load_schema(text: str, index: str) -> Schema:
    try:
        raw = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise SchemaError("", f"not YAML: {e}") from e
    if not isinstance(raw, dict):
        raise SchemaError("", "a schema is a mapping")
    return parse_schema(raw, index)


def _filter_out(f: Filter) -> dict[str, Any]:
    if f.op == "raw":
        return {"raw": f.values[0]}
    out: dict[str, Any] = {"column": f.column, "op": f.op}
    if f.op in ("in", "not_in", "between"):
        out["value"] = list(f.values)
    elif f.values:
        out["value"] = f.values[0]
    return out


def field_dict(f: Field) -> dict[str, Any]:
    out: dict[str, Any] = {f.type: f.name}
    pairs = {"table": f.table, "primary_key": f.primary_key, "foreign_key": f.foreign_key, "lat": f.lat, "lon": f.lon, "limit": f.limit, "default": f.default}
    if f.column and not (f.kind in ("scalar", "map") and f.column == f.name.lower()):
        pairs["column"] = f.column
    out |= {k: v for k, v in pairs.items() if v is not None}
    if f.kind in ("scalar", "geo", "map") or (f.kind == "join" and f.required and not f.to_many):
        out["required"] = f.required
    if f.type == "custom":
        out |= {"postgres": list(f.source_types), "opensearch": f.index_type}
    if f.kind == "map":
        out["values"] = f.value_type
    elif f.kind == "aggregate" and f.value_type:
        out["element_type" if f.type == "ids" else "value_type"] = f.value_type
    if f.kind == "constant":
        out["value"] = f.value
    if f.through:
        out["through"] = {"table": f.through.table, "left_key": f.through.left_key, "right_key": f.through.right_key}
    for key, items in (("transforms", list(f.transforms)), ("variants", list(f.variants)), ("filters", [_filter_out(x) for x in f.filters]), ("order_by", [{"column": o.column, "direction": "desc" if o.descending else "asc"} for o in f.order_by]), ("options", f.options)):
        if items:
            out[key] = items
    if f.kind in ("object", "join"):
        out["fields"] = [field_dict(x) for x in f.fields]
    return out


def schema_dict(s: Schema) -> dict[str, Any]:
    out: dict[str, Any] = {"version": 1, "table": s.table, "primary_key": s.primary_key[0] if len(s.primary_key) == 1 else list(s.primary_key)}
    if s.db_schema:
        out["db_schema"] = s.db_schema
    if s.soft_delete:
        sd = s.soft_delete
        out["soft_delete"] = ({"column": sd.column} if sd.column else {"field": sd.field}) | ({"when": [_filter_out(x) for x in sd.when]} if sd.when else {})
    if s.filters:
        out["filters"] = [_filter_out(x) for x in s.filters]
    return out | {"fields": [field_dict(f) for f in s.fields]}


def dump_schema(s: Schema) -> str:
    return yaml.safe_dump(schema_dict(s), sort_keys=False, allow_unicode=True)
