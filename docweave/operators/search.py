"""Searches over assembled documents: filtering, scoring, sorting, paging, several indexes."""

from __future__ import annotations

import math
import threading
import uuid
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions import analysis as an
from .clauses import Bool, Clause, Match, MatchAll, MultiMatch, QueryError, Scope, two_valued
from .handles import Group, fields
from .sorting import SCORE, Sort, after_tuple

#: Fixed value: ids of a page that are literals at most; larger pages are one plan.
PAGE_LITERALS = 1000


@dataclass(frozen=True)
class NestedProjection:
    path: str
    query: Clause | None = None
    sort: tuple[Sort, ...] = ()
    start: int = 0
    size: int = 3

    def apply(self, df: DataFrame, s: Scope) -> DataFrame:
        found = s.look(self.path)
        if found is None or not isinstance(found[1], T.ArrayType):
            raise QueryError(f"`{self.path}` is not nested")
        top, _, rest = self.path.partition(".")
        c, kind = found[0], found[1].elementType
        if self.query is not None:
            c = F.filter(c, lambda e: self.query.match(Scope(kind, e, self.path)))
        if self.sort:
            def compare(a, b):
                out = F.lit(0)
                for k in reversed(self.sort):
                    x, y = k.value(Scope(kind, a, self.path)), k.value(Scope(kind, b, self.path))
                    less = F.when(x < y, 1 if k.descending else -1).when(x > y, -1 if k.descending else 1)
                    nulls = -1 if k.missing == "_first" else 1
                    out = F.when(x.isNull() & y.isNotNull(), nulls).when(x.isNotNull() & y.isNull(), -nulls).otherwise(F.coalesce(less, out))
                return out

            c = F.array_sort(c, compare)
        c = F.slice(c, self.start + 1, self.size)
        if not rest:
            return df.withColumn(top, c)
        holder = s.look(self.path.rpartition(".")[0])
        if holder is None or not isinstance(holder[1], T.StructType):
            raise QueryError(f"`{self.path}` lies in another nested field: project that")
        return df.withColumn(top, F.when(F.col(f"`{top}`").isNotNull(), F.col(f"`{top}`").withField(rest, c)))


@dataclass
class Index:
    """Documents under a name.  ``frame`` has ``_id`` and the fields; ``schema``'s types carry the metadata."""

    name: str
    frame: DataFrame
    type: T.StructType = None

    def __post_init__(self) -> None:
        have = T.StructType([f for f in self.frame.schema if f.name != "_id"])
        self.type = merged(have, self.type) if self.type is not None else have

    @property
    def fields(self) -> Group:
        return fields(self.type)

    def get(self, id_: str) -> DataFrame:
        return self.frame.where(F.col("_id") == id_).limit(1)

    def search(self) -> Search:
        return Search(self)


def merged(have: T.DataType, declared: T.DataType) -> T.DataType:
    """The frame's own types with the declared metadata."""
    if isinstance(have, T.StructType) and isinstance(declared, T.StructType):
        return T.StructType([T.StructField(f.name, merged(f.dataType, declared[f.name].dataType), f.nullable, declared[f.name].metadata) if f.name in declared.names else f for f in have])
    if isinstance(have, T.ArrayType) and isinstance(declared, T.ArrayType):
        return T.ArrayType(merged(have.elementType, declared.elementType), have.containsNull)
    return have


def statistics(df: DataFrame, scope: Scope, wanted: set[tuple[str, str, str]]) -> dict:
    """BM25 statistics of the query's terms over all documents: one aggregation."""
    if not wanted:
        return {}
    paths = sorted({(p, how) for p, how, _ in wanted})
    columns, aggs = [], [F.count(F.lit(1)).alias("n")]
    for i, (p, how) in enumerate(paths):
        columns.append(scope.text(p, how)[0].alias(f"t{i}"))
        has = F.col(f"t{i}").isNotNull() & (F.size(f"t{i}") > 0)
        aggs += [F.avg(F.when(has, F.size(f"t{i}"))).alias(f"a{i}"), F.count(F.when(has, 1)).alias(f"c{i}")]
    terms = sorted(wanted)
    for j, (p, how, t) in enumerate(terms):
        aggs.append(F.count(F.when(F.array_contains(f"t{paths.index((p, how))}", t), 1)).alias(f"d{j}"))
    row = df.select(*columns).agg(*aggs).head()
    out = {}
    for j, (p, how, t) in enumerate(terms):
        i = paths.index((p, how))
        n, d = row[f"c{i}"], row[f"d{j}"]
        out[p, how, t] = (math.log(1 + (n - d + 0.5) / (d + 0.5)), float(row[f"a{i}"] or 1.0))
    return out


@dataclass(frozen=True)
class Search:
    index: Index
    bool_: Bool = Bool()
    raw: Clause | None = None
    sorts: tuple[Sort, ...] = ()
    start: int = 0
    limit: int | None = None
    search_after_values: tuple | None = None
    collapse_field: str | None = None
    post: Clause | None = None
    least_score: float | None = None
    projections: tuple[NestedProjection, ...] = ()
    highlights: dict[str, Any] | None = field(default=None, hash=False)
    source: tuple[str, ...] | None = None
    scored: bool = True
    every: bool = False

    def _bool(self, how: str, q: Clause | None) -> Search:
        return self if q is None else replace(self, bool_=replace(self.bool_, **{how: (*getattr(self.bool_, how), q)}))

    def query(self, q: Clause | None) -> Search:
        return self._bool("must", q)

    def filter(self, q: Clause | None) -> Search:
        return self._bool("filter", q)

    def should(self, q: Clause | None) -> Search:
        return self._bool("should", q)

    def must_not(self, q: Clause | None) -> Search:
        return self._bool("must_not", q)

    def min_should_match(self, spec: int | str) -> Search:
        return replace(self, bool_=replace(self.bool_, minimum_should_match=spec))

    def raw_query(self, q: Clause | dict) -> Search:
        from .dsl import parse

        return replace(self, raw=parse(q) if isinstance(q, dict) else q)

    def sort(self, *sorts: Sort | None) -> Search:
        return replace(self, sorts=(*self.sorts, *(s for s in sorts if s is not None)))

    def page(self, start: int = 0, size: int | None = None) -> Search:
        return replace(self, start=start, limit=size)

    def unpaged(self) -> Search:
        """Every match, in no order: for exports, not for pages."""
        return replace(self, every=True)

    def search_after(self, *values: Any) -> Search:
        return replace(self, search_after_values=values)

    def collapse(self, path: str) -> Search:
        return replace(self, collapse_field=path)

    def post_filter(self, q: Clause) -> Search:
        return replace(self, post=q)

    def min_score(self, x: float) -> Search:
        return replace(self, least_score=x)

    def project(self, *ps: NestedProjection) -> Search:
        return replace(self, projections=(*self.projections, *ps))

    def highlight(self, *paths: str, pre: str = "<em>", post: str = "</em>", fragment_size: int = 100, fragments: int = 5, require_field_match: bool = True) -> Search:
        return replace(self, highlights={"paths": paths, "pre": pre, "post": post, "size": fragment_size, "number": fragments, "own": require_field_match})

    def fields(self, *names: str) -> Search:
        return replace(self, source=names)

    def without_scores(self) -> Search:
        return replace(self, scored=False)

    def clause(self) -> Clause:
        if self.raw is not None:
            return self.raw
        return MatchAll() if self.bool_ == Bool() else self.bool_

    def matched(self) -> DataFrame:
        """All matching documents with _score, before sorting and paging."""
        q, df = self.clause(), self.index.frame
        scope = Scope(self.index.type)
        needs_score = self.scored
        if needs_score and (wanted := q.terms(scope)):
            scope = replace(scope, stats=statistics(df, scope, wanted))
        df = df.where(q.match(scope))
        df = df.withColumn("_score", q.score(scope).cast("double") if needs_score else F.lit(None).cast("double"))
        if self.least_score is not None:
            df = df.where(F.col("_score") >= self.least_score)
        if self.post is not None:
            df = df.where(self.post.match(scope))
        return df

    def _order(self) -> tuple[Sort, ...]:
        keys = self.sorts or (SCORE,)
        return keys if any(k.path == "_id" for k in keys) else (*keys, Sort("_id"))

    def hits(self) -> DataFrame:
        """The page: _id, _score and the document's fields, in order."""
        return self._dressed(self._paged(self.matched()))

    def _paged(self, df: DataFrame) -> DataFrame:
        """Of the matches the page, in order."""
        scope, order = Scope(self.index.type), self._order()
        if self.collapse_field:
            c = scope.values(self.collapse_field)
            if c is None:
                raise QueryError(f"`{self.collapse_field}` is not mapped")
            # documents without a value stay, each for itself, and need no window
            w = Window.partitionBy(c[0]).orderBy(*(k.column(scope) for k in order))
            first = df.where(c[0].isNotNull()).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
            df = first.unionByName(df.where(c[0].isNull()))
        if self.search_after_values is not None:
            df = df.where(after_tuple(order[: len(self.search_after_values)], list(self.search_after_values), scope))
        if not self.every:
            df = df.orderBy(*(k.column(scope) for k in order))
            if self.start:
                df = df.offset(self.start)
            df = df.limit(10 if self.limit is None else self.limit)
        return df

    def _dressed(self, df: DataFrame) -> DataFrame:
        """A page's documents as they are shown."""
        scope = Scope(self.index.type)
        for p in self.projections:
            df = p.apply(df, scope)
        if self.highlights:
            df = self._highlight(df, scope)
        if self.source is not None:
            df = df.select("_id", "_score", *self.source, *(["_highlight"] if self.highlights else []))
        return df

    def _highlight(self, df: DataFrame, scope: Scope) -> DataFrame:
        h = self.highlights
        words = _words(self.clause())
        columns = []
        for p in h["paths"]:
            found = scope.look(scope.analyzer(p)[0])  # of a subfield, the field itself
            terms = sorted({t for path, text in words if not h["own"] or path == p for t in an.analyze(text, scope.analyzer(p)[1])})
            if found is None or not terms:
                continue
            pattern = r"(?iu)(?<![\p{L}\p{N}_])(" + "|".join(_loose(t) for t in terms) + r")(?![\p{L}\p{N}_])"
            marked = F.regexp_replace(found[0].cast("string"), F.lit(pattern), F.lit(f"{h['pre']}$1{h['post']}"))
            pieces = F.regexp_extract_all(found[0].cast("string"), F.lit(rf"(?s)\S.{{0,{max(0, h['size'] - 1)}}}(?=\s|$)|\S+"), 0)
            pieces = F.slice(F.filter(pieces, lambda x: x.rlike(pattern)), 1, h["number"])
            out = F.transform(pieces, lambda x: F.regexp_replace(x, F.lit(pattern), F.lit(f"{h['pre']}$1{h['post']}"))) if h["number"] else F.array(marked)
            columns += [F.lit(p), F.when(found[0].cast("string").rlike(pattern), out)]
        kind = "map<string,array<string>>"
        made = F.map_filter(F.create_map(*columns), lambda k, v: v.isNotNull()) if columns else F.lit(None)
        return df.withColumn("_highlight", made.cast(kind))

    def ids(self) -> DataFrame:
        return self.hits().select("_id")

    def count(self) -> int:
        """Matches of the query alone: paging, sorting, min_score and post_filter don't count."""
        return self.index.frame.where(self.clause().match(Scope(self.index.type))).count()

    def _page_rows(self) -> list[dict[str, Any]]:
        """The page's rows.  Its ids come first, from what matching and sorting read; then only its documents are built."""
        if self.every:
            return [r.asDict(recursive=True) for r in self.hits().collect()]
        df = self.matched()
        ids = [r["_id"] for r in self._paged(df).select("_id").collect()]
        if not ids:
            return []
        if None in ids or len(set(ids)) < len(ids) or len(ids) > PAGE_LITERALS:  # no documents of an index, or too many to name
            return [r.asDict(recursive=True) for r in self.hits().collect()]
        found = [r.asDict(recursive=True) for r in self._dressed(df.where(F.col("_id").isin(ids))).collect()]
        if len(found) != len(ids):  # an id is not unique
            return [r.asDict(recursive=True) for r in self.hits().collect()]
        place = {id_: i for i, id_ in enumerate(ids)}
        return sorted(found, key=lambda r: place[r["_id"]])

    def send(self, track_total: bool | int = True, timeout: float | None = None) -> dict[str, Any]:
        """One page with its totals.  Over ``timeout`` seconds the search is given up: ``timed_out``, with what there is by then."""
        out: dict[str, Any] = {"total": None, "max_score": None, "timed_out": False, "hits": []}
        sc = self.index.frame.sparkSession.sparkContext
        group, fired = f"search-{uuid.uuid4().hex}", threading.Event()

        def give_up() -> None:
            fired.set()
            sc.cancelJobGroup(group)

        timer = None
        if timeout is not None:
            sc.setJobGroup(group, "search", True)
            timer = threading.Timer(timeout, give_up)
            timer.start()
        try:
            hits = self._page_rows()
            scores = [h["_score"] for h in hits if h["_score"] is not None]
            out |= {"max_score": max(scores, default=None), "hits": [{"id": h.pop("_id"), "score": h.pop("_score"), "source": h} for h in hits]}
            if track_total is True:
                out["total"] = self.matched().count()
            elif track_total:
                out["total"] = self.matched().limit(int(track_total)).count()
        except Exception:
            if not fired.is_set():
                raise
        finally:
            if timer is not None:
                timer.cancel()
                sc.setLocalProperty("spark.jobGroup.id", None)
        return out | {"timed_out": fired.is_set()}


def _loose(term: str) -> str:
    import re

    return re.escape(term)


def _words(q: Any) -> list[tuple[str, str]]:
    """(path, text) of the full-text parts of a query."""
    if isinstance(q, Match):
        return [(q.path, q.text)]
    if isinstance(q, MultiMatch):
        return [(m.path, m.text) for m in q.parts()]
    if isinstance(q, Bool):
        return [x for part in (*q.must, *q.filter, *q.should) for x in _words(part)]
    out = []
    for v in vars(q).values() if isinstance(q, Clause) else ():
        for x in v if isinstance(v, tuple) else (v,):
            if isinstance(x, Clause):
                out += _words(x)
    return out


@dataclass(frozen=True)
class MultiSearch:
    """One ranked list over several indexes; a field that one lacks doesn't match there."""

    searches: tuple[Search, ...]
    sorts: tuple[Sort, ...] = ()
    start: int = 0
    limit: int | None = None

    every: bool = False

    def unpaged(self) -> MultiSearch:
        return replace(self, every=True)

    def matched(self) -> DataFrame:
        """All matches: _index, _id, _score, the sort values and each index's document as a struct of its own."""
        out = None
        for n, s in enumerate(self.searches):
            df = s.matched()
            scope = Scope(s.index.type)
            for i, k in enumerate(self.sorts):
                if k.path not in ("_score", "_id"):
                    df = df.withColumn(f"__s{i}", k.value(scope))
            doc = F.struct(*(f"`{f.name}`" for f in s.index.type if not isinstance(f.dataType, T.VariantType)))
            df = df.select(F.lit(s.index.name).alias("_index"), "_id", "_score", *(c for c in df.columns if c.startswith("__s")), doc.alias(f"__d{n}"))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        if out is None:
            raise QueryError("no index to search")
        return out

    def hits(self) -> DataFrame:
        df, order = self.matched(), []
        for i, k in enumerate(self.sorts or (SCORE,)):
            c = F.col(k.path if k.path in ("_score", "_id") else f"__s{i}")
            first = k.missing == "_first"
            order.append((c.desc_nulls_first() if first else c.desc_nulls_last()) if k.descending else (c.asc_nulls_first() if first else c.asc_nulls_last()))
        if not self.every:
            df = df.orderBy(*order, "_index", "_id").offset(self.start).limit(10 if self.limit is None else self.limit)
        # only the page is written as JSON
        source = F.coalesce(*(F.to_json(f"__d{n}", {"ignoreNullFields": "false"}) for n in range(len(self.searches))))
        return df.select("_index", "_id", "_score", source.alias("source"))

    def count(self) -> int:
        return sum(s.count() for s in self.searches)


def msearch(*searches: Search) -> tuple[DataFrame, ...]:
    """Independent searches; one that is wrong fails the call."""
    return tuple(s.hits() for s in searches)


def msearch_all(searches: list[Search]) -> list[DataFrame]:
    return list(msearch(*searches))


__all__ = ["Index", "MultiSearch", "NestedProjection", "Search", "msearch", "msearch_all", "statistics", "two_valued"]
