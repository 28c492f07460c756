"""Sort keys: fields, nested minima, map keys, distances, scores and scripts."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, functions as F, types as T

from ..functions import analysis, geo
from .clauses import Clause, QueryError, Scope, bind


@dataclass(frozen=True)
class Sort:
    """``missing``: last (as by default, in both directions), first, or a value in its place."""

    path: str
    descending: bool = False
    missing: Any = "_last"
    mode: str | None = None
    nested_filter: Clause | None = None
    unmapped_type: str | None = None
    numeric_type: str | None = None
    near: tuple[float, float] | None = None
    unit: str = "m"
    map_keys: tuple[str, ...] = ()
    script: str | None = None
    params: dict[str, Any] = field(default_factory=dict, hash=False)

    def value(self, s: Scope) -> Column:
        if self.script:
            return F.expr(bind(self.script, self.params))
        if self.path == "_score":
            return F.col("_score")
        if self.path == "_id":
            return F.col("_id")
        if self.map_keys:
            return self._map_key(s)
        found = self._values(s)
        if found is None:
            if self.unmapped_type:
                return F.lit(None).cast({"keyword": "string", "date": "timestamp", "integer": "int", "long": "bigint"}.get(self.unmapped_type, self.unmapped_type))
            raise QueryError(f"cannot sort by `{self.path}`: it is not mapped")
        c, kind, several = found
        if self.near:
            c = F.transform(c, lambda p: geo.haversine(p, *self.near)) if several else geo.haversine(c, *self.near)
            c = F.transform(c, lambda x: x / geo.METRES[self.unit]) if several else c / geo.METRES[self.unit]
        if several:
            c = F.filter(c, lambda x: x.isNotNull())
            c = F.when(F.size(c) > 0, reduce_values(c, self.mode or ("max" if self.descending else "min")))
        if self.numeric_type:
            c = c.cast({"long": "bigint", "date": "timestamp"}.get(self.numeric_type, self.numeric_type))
        if self.missing not in ("_last", "_first"):
            c = F.coalesce(c, F.lit(self.missing).cast(kind) if not self.near else F.lit(self.missing))
        return c

    def _values(self, s: Scope):
        if self.nested_filter is None:
            return s.values(self.path)
        parts = self.path.split(".")
        for i in range(len(parts) - 1, 0, -1):
            outer = ".".join(parts[:i])
            found = s.look(outer)
            if found and isinstance(found[1], T.ArrayType):
                kind = found[1].elementType
                kept = F.filter(found[0], lambda e: self.nested_filter.match(Scope(kind, e, outer)))
                inner = Scope(kind, F.lit(None)).values(".".join(parts[i:]))
                if inner is None:
                    return None
                return F.transform(kept, lambda e: Scope(kind, e, outer).values(".".join(parts[i:]))[0]), inner[1], True
        raise QueryError(f"`{self.path}` is not inside a nested field")

    def _map_key(self, s: Scope) -> Column:
        found = s.look(self.path)
        if found is None or not isinstance(found[1], T.MapType):
            raise QueryError(f"`{self.path}` is not a map")
        c = F.coalesce(*(found[0][k] for k in self.map_keys))
        text = isinstance(found[1].valueType, T.StringType)
        if text:
            c = analysis.fold_lower(c)
        if self.missing in ("_last", "_first"):
            return c if self.missing == "_first" else F.coalesce(c, F.lit("" if text else 0).cast(found[1].valueType))
        return F.coalesce(c, F.lit(self.missing).cast(found[1].valueType))

    def column(self, s: Scope) -> Column:
        c = self.value(s)
        first = self.missing == "_first"
        if self.descending:
            return c.desc_nulls_first() if first else c.desc_nulls_last()
        return c.asc_nulls_first() if first else c.asc_nulls_last()

    def after(self, s: Scope, v: Any) -> tuple[Column, Column]:
        """(strictly after, equal) to a value of a page's last row."""
        c = self.value(s)
        if v is None:
            return (c.isNotNull() if self.missing == "_first" else F.lit(False)), c.isNull()
        x = F.lit(v)
        later = (c < x) if self.descending else (c > x)
        later = F.coalesce(later, F.lit(self.missing != "_first"))
        return later, F.coalesce(c == x, F.lit(False))


def reduce_values(c: Column, mode: str) -> Column:
    added = F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double")) if mode in ("sum", "avg") else None
    if mode == "median":
        o, n = F.sort_array(c), F.size(c)
        return (F.get(o, F.floor((n - 1) / 2).cast("int")) + F.get(o, F.floor(n / 2).cast("int"))) / 2
    out = {"min": F.array_min(c), "max": F.array_max(c), "sum": added, "avg": added / F.size(c) if added is not None else None}
    if mode not in out:
        raise QueryError(f"unknown sort mode `{mode}`")
    return out[mode]


SCORE = Sort("_score", descending=True)


class SortBuilder:
    """Collects keys; the first for a path wins, None is skipped, scripts always stay."""

    def __init__(self) -> None:
        self.keys: list[Sort] = []

    def by(self, *sorts: Sort | None) -> SortBuilder:
        for s in sorts:
            if s is not None and (s.script or s.path not in {k.path for k in self.keys}):
                self.keys.append(s)
        return self

    def score(self, when: bool = True) -> SortBuilder:
        return self.by(SCORE if when else None)

    def near(self, handle: Any, lat: float, lon: float) -> SortBuilder:
        return self.by(handle.nearest(lat, lon))

    def script(self, source: str, descending: bool = False, **params: Any) -> SortBuilder:
        return self.by(Sort("", descending=descending, script=source, params=params))

    def tiebreak(self, *sorts: Sort) -> SortBuilder:
        return self.by(*(sorts or (Sort("_id"),)))

    def or_default(self, *sorts: Sort) -> SortBuilder:
        return self if self.keys else self.by(*sorts)

    def build(self) -> tuple[Sort, ...]:
        return tuple(self.keys)


def after_tuple(sorts: Iterable[Sort], values: list[Any], s: Scope) -> Column:
    """Rows strictly after a tuple of sort values."""
    out, equal = F.lit(False), F.lit(True)
    for sort, v in zip(sorts, values, strict=True):
        later, same = sort.after(s, v)
        out = out | (equal & later)
        equal = equal & same
    return reduce(lambda a, b: a | b, [out])
