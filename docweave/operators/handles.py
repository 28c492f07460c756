"""Typed handles: a document type's fields as attributes with the operations that suit them."""

from __future__ import annotations

import datetime
import decimal
import enum
import uuid
from typing import Any

from pyspark.sql import types as T

from . import clauses as q
from .sorting import Sort


def plain(v: Any) -> Any:
    """Enums to their values, exact and temporal values to text."""
    if isinstance(v, enum.Enum):
        return plain(v.value)
    if isinstance(v, (decimal.Decimal, uuid.UUID)):
        return str(v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat(sep=" ") if isinstance(v, datetime.datetime) else v.isoformat()
    return v


class TypedMap(dict):
    """A map value whose values all have one plain type."""

    def __init__(self, values: dict[str, Any]) -> None:
        super().__init__((str(k), plain(v)) for k, v in values.items())
        kinds = {type(v) for v in self.values() if v is not None}
        if len(kinds) > 1:
            raise TypeError(f"one map holds {' and '.join(sorted(k.__name__ for k in kinds))}")


class Handle:
    def __init__(self, path: str, kind: T.DataType, meta: dict | None = None) -> None:
        self.path, self.kind, self.meta = path, kind, meta or {}
        self._path, self._kind = path, kind

    def exists(self) -> q.Clause:
        return q.Exists(self.path)

    def asc(self, **options: Any) -> Sort:
        return Sort(self.path, **options)

    def desc(self, **options: Any) -> Sort:
        return Sort(self.path, descending=True, **options)


class Value(Handle):
    """Numbers, booleans, dates, binaries, and what every exact value has."""

    def eq(self, v: Any) -> q.Clause:
        return q.Term(self.path, plain(v))

    def any_of(self, vs: Any) -> q.Clause:
        return q.Terms(self.path, tuple(map(plain, vs)))

    def lt(self, v: Any, **o: Any) -> q.Clause:
        return q.Range(self.path, lt=plain(v), **o)

    def lte(self, v: Any, **o: Any) -> q.Clause:
        return q.Range(self.path, lte=plain(v), **o)

    def gt(self, v: Any, **o: Any) -> q.Clause:
        return q.Range(self.path, gt=plain(v), **o)

    def gte(self, v: Any, **o: Any) -> q.Clause:
        return q.Range(self.path, gte=plain(v), **o)

    def between(self, a: Any, b: Any, **o: Any) -> q.Clause:
        return q.Range(self.path, gte=plain(a), lte=plain(b), **o)


class Keyword(Value):
    def eq(self, v: Any, case_insensitive: bool = False) -> q.Clause:
        return q.Term(self.path, plain(v), case_insensitive)

    def prefix(self, v: str, case_insensitive: bool = False) -> q.Clause:
        return q.Pattern(self.path, "prefix", v, case_insensitive)

    def wildcard(self, v: str, case_insensitive: bool = False) -> q.Clause:
        return q.Pattern(self.path, "wildcard", v, case_insensitive)

    def regexp(self, v: str, case_insensitive: bool = False) -> q.Clause:
        return q.Pattern(self.path, "regexp", v, case_insensitive)

    def fuzzy(self, v: str, **o: Any) -> q.Clause:
        return q.Fuzzy(self.path, v, **o)

    def text(self) -> Text:
        return Text(f"{self.path}.text", self.kind)

    def keyword_lowercase(self) -> Keyword:
        return Keyword(f"{self.path}.keyword_lowercase", self.kind)

    def in_order(self, descending: bool = False, **o: Any) -> Sort:
        """By the declared order of the variants."""
        if not self.meta.get("variants"):
            raise q.QueryError(f"`{self.path}` declares no order")
        return Sort(f"{self.path}.sort", descending=descending, **o)


class Text(Handle):
    def matches(self, text: str, **o: Any) -> q.Clause:
        return q.Match(self.path, text, **o)

    def phrase(self, text: str, slop: int = 0) -> q.Clause:
        return q.Match(self.path, text, kind="match_phrase", slop=slop)

    def phrase_prefix(self, text: str) -> q.Clause:
        return q.Match(self.path, text, kind="match_phrase_prefix")

    def bool_prefix(self, text: str) -> q.Clause:
        return q.Match(self.path, text, kind="match_bool_prefix")

    def matches_fuzzy(self, text: str) -> q.Clause:
        return q.Match(self.path, text, fuzziness="AUTO")

    def keyword(self) -> Keyword:
        return Keyword(f"{self.path}.keyword", self.kind)

    def keyword_lowercase(self) -> Keyword:
        return Keyword(f"{self.path}.keyword_lowercase", self.kind)

    def any_of(self, vs: Any) -> q.Clause:
        return self.keyword().any_of(vs)

    def asc(self, **o: Any) -> Sort:
        return Sort(f"{self.path}.keyword_lowercase", **o)

    def desc(self, **o: Any) -> Sort:
        return Sort(f"{self.path}.keyword_lowercase", descending=True, **o)


class GeoPoint(Handle):
    def within(self, lat: float, lon: float, distance: str | float, plane: bool = False) -> q.Clause:
        from ..functions.geo import check, metres

        check(lat, lon)
        metres(distance)
        return q.Geo(self.path, "distance", (lat, lon, distance), plane)

    def in_box(self, top: float, left: float, bottom: float, right: float) -> q.Clause:
        return q.Geo(self.path, "box", (top, left, bottom, right))

    def in_polygon(self, points: list[tuple[float, float]]) -> q.Clause:
        return q.Geo(self.path, "polygon", tuple(points))

    def nearest(self, lat: float, lon: float, descending: bool = False, unit: str = "m") -> Sort:
        return Sort(self.path, descending=descending, near=(lat, lon), unit=unit)


class MapField(Handle):
    def key(self, k: str) -> Handle:
        return handle(f"{self.path}.{k}", self.kind.valueType, {"type": self.meta.get("type")})

    def has_key(self, k: str) -> q.Clause:
        return q.HasKey(self.path, k)

    def search(self, text: str, **o: Any) -> q.Clause:
        return q.MapSearch(self.path, text, **o)

    def sort_key(self, *keys: str, descending: bool = False, **o: Any) -> Sort:
        """By the first of ``keys`` that a document has."""
        return Sort(self.path, descending=descending, map_keys=keys, **o)


class Group(Handle):
    """An object: its fields are attributes, before anything else of that name, and items."""

    def __getattribute__(self, name: str) -> Any:
        if not name.startswith("_"):
            kind = object.__getattribute__(self, "__dict__").get("_kind")
            kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
            if kind is not None and name in kind.names:
                return self[name]
        return object.__getattribute__(self, name)

    def __getattr__(self, name: str) -> Any:
        raise AttributeError(f"`{self._path or 'the document'}` has no field `{name}`")

    def __getitem__(self, name: str) -> Handle:
        kind = self._kind.elementType if isinstance(self._kind, T.ArrayType) else self._kind
        f = kind[name]
        return handle(f"{self._path}.{name}" if self._path else name, f.dataType, f.metadata)


class JsonField(Handle):
    """What a json field holds is not declared: only a raw clause looks inside."""

    def raw(self, clause: q.Clause | dict) -> q.Clause:
        """A clause, or its JSON body, whose paths start at the field."""
        if isinstance(clause, dict):
            from .dsl import parse

            clause = parse(clause)
        return _inside(self.path, clause)


def _inside(path: str, query: q.Clause | None) -> q.Clause | None:
    """``query``, if every field it names lies inside ``path``."""
    for p in sorted(q.paths_of(query)):
        if not p.startswith(f"{path}."):
            raise q.QueryError(f"`{p}` is not inside `{path}`")
    return query


class NestedField(Group):
    def any(self, query: q.Clause, **o: Any) -> q.Clause:
        return q.Nested(self._path, _inside(self._path, query), **o)

    def all(self, query: q.Clause) -> q.Clause:
        return q.Nested(self._path, _inside(self._path, query), how="all")

    def exists(self) -> q.Clause:
        return q.Nested(self._path, how="exists")

    def matching(self, query: q.Clause | None = None, sort: tuple[Sort, ...] = (), start: int = 0, size: int = 3) -> Any:
        """Projection: only these elements come back, without changing which documents match."""
        from .search import NestedProjection

        return NestedProjection(self._path, _inside(self._path, query), tuple(sort), start, size)


def handle(path: str, kind: T.DataType, meta: dict | None = None) -> Handle:
    meta = meta or {}
    if isinstance(kind, T.ArrayType):
        return NestedField(path, kind, meta) if isinstance(kind.elementType, T.StructType) else Keyword(path, kind, meta)
    if isinstance(kind, T.StructType):
        return GeoPoint(path, kind, meta) if meta.get("type") == "geo" or set(kind.names) == {"lat", "lon"} else Group(path, kind, meta)
    if isinstance(kind, T.MapType):
        return MapField(path, kind, meta)
    if isinstance(kind, T.VariantType):
        return JsonField(path, kind, meta)
    if isinstance(kind, T.BinaryType):
        return Handle(path, kind, meta)
    if isinstance(kind, T.StringType):
        return Text(path, kind, meta) if meta.get("type") in ("text", "identifier", "map") else Keyword(path, kind, meta)
    return Value(path, kind, meta)


def fields(document: T.StructType) -> Group:
    return Group("", document)
