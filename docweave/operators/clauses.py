"""Query clauses: each gives a two-valued match and a score as columns.

A clause looks fields up through a ``Scope``: the document, or one element of a
nested array.  A field that is missing doesn't match, so ``must_not`` keeps the
document.  A field with several values matches if any of them does.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, functions as F, types as T

from ..functions import analysis as an, geo


class QueryError(ValueError):
    pass


@dataclass(frozen=True)
class Scope:
    """Where paths lead: ``base`` is the document (None: its columns) or an element."""

    type: T.StructType
    base: Column | None = None
    prefix: str = ""
    stats: dict[tuple[str, str, str], tuple[float, float]] | None = None  # (path, analyzer, term) -> (idf, average length)

    def look(self, path: str) -> tuple[Column, T.DataType, dict] | None:
        """Column, type and metadata of a path; map keys and objects by dots.  None where it is not mapped."""
        if self.prefix and path.startswith(self.prefix + "."):
            path = path[len(self.prefix) + 1 :]
        kind: T.DataType = self.type
        c, meta = self.base, {}
        for part in path.split("."):
            if isinstance(kind, T.MapType):
                c, kind, meta = c[part], kind.valueType, {}
                continue
            if isinstance(kind, T.VariantType):  # a json field: what is inside is known document by document
                c, meta = F.try_variant_get(c, f"$['{part}']", "variant"), {}
                continue
            if not isinstance(kind, T.StructType) or part not in kind.names:
                return None
            f = kind[part]
            c = F.col(f"`{part}`") if c is None else c[part]
            kind, meta = f.dataType, f.metadata or {}
        return c, kind, meta

    def analyzer(self, path: str) -> tuple[str, str]:
        """(field path, analyzer) of a path that may end in a subfield."""
        stem, _, last = path.rpartition(".")
        if last in ("keyword", "keyword_lowercase", "text", "sort") and self.look(path) is None and self.look(stem) is not None:
            return stem, {"keyword": "keyword", "keyword_lowercase": "lowercase", "text": "code", "sort": "sort"}[last]
        found = self.look(path)
        declared = (found[2].get("type") if found else None) or "keyword"
        return path, {"text": "text", "identifier": "code"}.get(declared, "keyword")

    def values(self, path: str) -> tuple[Column, T.DataType, bool] | None:
        """(value or array, value type, whether an array) with subfields and nested paths opened."""
        stem, how = self.analyzer(path)
        found = self.look(stem)
        if found is None:
            return self._flattened(path)
        c, kind, meta = found
        several = isinstance(kind, T.ArrayType)
        kind = kind.elementType if several else kind
        if how == "lowercase" and stem != path:
            def change(x: Column) -> Column:
                return F.when(F.char_length(x) <= 256, an.fold_lower(x))
            return (F.transform(c, change) if several else change(c)), kind, several
        if how == "keyword" and stem != path:
            return F.when(F.char_length(c) <= 256, c), kind, several
        if how == "sort":
            return rank(c, meta.get("variants") or []), T.StringType(), False
        return c, kind, several

    def _flattened(self, path: str) -> tuple[Column, T.DataType, bool] | None:
        """A path through an array of objects: the values of all elements."""
        parts = path.split(".")
        for i in range(len(parts) - 1, 0, -1):
            found = self.look(".".join(parts[:i]))
            if found and isinstance(found[1], T.ArrayType) and isinstance(found[1].elementType, T.StructType):
                rest = ".".join(parts[i:])
                inner = Scope(found[1].elementType, F.lit(None)).values(rest)
                if inner is None:
                    return None
                values = F.transform(found[0], lambda e: Scope(found[1].elementType, e).values(rest)[0])
                return (F.flatten(values) if inner[2] else values), inner[1], True
        return None

    def text(self, path: str, analyzer: str | None = None) -> tuple[Column, str] | None:
        """(tokens, analyzer) of a path."""
        stem, how = self.analyzer(path)
        found = self.values(stem)
        if found is None:
            return None
        c, kind, several = found
        how = analyzer or how
        if several:
            return F.flatten(F.transform(c, lambda x: an.tokens(x.cast("string"), how))), how
        return an.tokens(c.cast("string"), how), how


def rank(c: Column, variants: list[str]) -> Column:
    """Declared order as zero-padded ranks; what is not declared comes after, by value."""
    width = max(2, len(str(len(variants))))
    at = F.array_position(F.array(*map(F.lit, variants)), c) if variants else F.lit(0)
    return F.when(c.isNull(), None).when(at > 0, F.lpad((at - 1).cast("string"), width, "0")).otherwise(F.concat(F.lit("9" * (width + 1)), c))


def two_valued(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def any_value(found: tuple[Column, T.DataType, bool] | None, test: Callable[[Column, T.DataType], Column]) -> Column:
    if found is None:
        return F.lit(False)
    c, kind, several = found
    return two_valued(F.exists(c, lambda x: two_valued(test(x, kind))) if several else test(c, kind))


def opened(c: Column, kind: T.DataType, *values: Any) -> tuple[Column, T.DataType]:
    """A value inside a json field, as the type of what it is compared with."""
    if not isinstance(kind, T.VariantType):
        return c, kind
    v = next((x for x in values if x is not None), "")
    kind = T.BooleanType() if isinstance(v, bool) else T.DoubleType() if isinstance(v, (int, float)) else T.StringType()
    return F.try_variant_get(c, "$", kind.simpleString()), kind


@dataclass(frozen=True)
class Clause:
    boost: float = field(default=1.0, kw_only=True)
    name: str | None = field(default=None, kw_only=True)

    def match(self, s: Scope) -> Column:
        raise NotImplementedError

    def score(self, s: Scope) -> Column:
        return F.when(self.match(s), F.lit(float(self.boost))).otherwise(0.0)

    def terms(self, s: Scope) -> set[tuple[str, str, str]]:
        """(path, analyzer, term) whose statistics the score needs."""
        return set()

    def __and__(self, other: Clause | None) -> Clause:
        return both("must", self, other)

    def __or__(self, other: Clause | None) -> Clause:
        return both("should", self, other)

    def __invert__(self) -> Clause:
        return Bool(must_not=(self,))

    def boosted(self, by: float) -> Clause:
        return replace(self, boost=self.boost * by)

    def named(self, name: str) -> Clause:
        return replace(self, name=name)


def both(how: str, a: Clause | None, b: Clause | None) -> Clause:
    """AND or OR where None contributes nothing; plain bools of one kind flatten."""
    parts: list[Clause] = []
    for q in (a, b):
        if q is None:
            continue
        if isinstance(q, Bool) and q == Bool(**{how: getattr(q, how)}):
            parts += getattr(q, how)
        else:
            parts.append(q)
    if not parts:
        return MatchAll()
    return parts[0] if len(parts) == 1 else Bool(**{how: tuple(parts)})


def required_count(spec: int | str, n: int) -> int:
    """minimum_should_match: a count, a percentage, negative for what may be missing, or ``3<90%``."""
    text = str(spec).strip()
    if "<" in text:
        out = n
        for part in text.split():
            limit, _, rule = part.partition("<")
            if n > int(limit):
                out = required_count(rule, n)
        return out
    if text.endswith("%"):
        p = float(text[:-1])
        return n - math.floor(n * -p / 100) if p < 0 else math.floor(n * p / 100)
    k = int(text)
    return max(0, n + k) if k < 0 else min(k, n)


def paths_of(q: Any) -> set[str]:
    """Every field path that a clause names."""
    if isinstance(q, (tuple, list)):
        return set().union(*map(paths_of, q))
    if not isinstance(q, Clause):
        return set()
    own = {q.path} if isinstance(getattr(q, "path", None), str) else set()
    if isinstance(getattr(q, "fields", None), tuple):
        own |= {f.partition("^")[0] for f in q.fields if isinstance(f, str)}
    return own.union(*(paths_of(v) for v in vars(q).values()))


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0.0))


@dataclass(frozen=True)
class MatchAll(Clause):
    def match(self, s: Scope) -> Column:
        return F.lit(True)


@dataclass(frozen=True)
class MatchNone(Clause):
    def match(self, s: Scope) -> Column:
        return F.lit(False)


@dataclass(frozen=True)
class Bool(Clause):
    must: tuple[Clause, ...] = ()
    filter: tuple[Clause, ...] = ()
    should: tuple[Clause, ...] = ()
    must_not: tuple[Clause, ...] = ()
    minimum_should_match: int | str | None = None

    def match(self, s: Scope) -> Column:
        out = F.lit(True)
        for q in (*self.must, *self.filter):
            out = out & q.match(s)
        for q in self.must_not:
            out = out & ~q.match(s)
        if self.should:
            spec = self.minimum_should_match
            n = required_count(spec, len(self.should)) if spec is not None else 0
            if not self.must and not self.filter:  # nothing else holds the document
                n = max(n, 1)
            if n == 1:
                out = out & reduce(lambda a, b: a | b, (q.match(s) for q in self.should))
            elif n > 1:
                out = out & (reduce(lambda a, b: a + b, (q.match(s).cast("int") for q in self.should)) >= n)
        return out

    def score(self, s: Scope) -> Column:
        return F.when(self.match(s), total([q.score(s) for q in (*self.must, *self.should)]) * float(self.boost)).otherwise(0.0)

    def terms(self, s: Scope) -> set:
        return set().union(*(q.terms(s) for q in (*self.must, *self.should)))


@dataclass(frozen=True)
class Exists(Clause):
    path: str

    def match(self, s: Scope) -> Column:
        found = s.values(self.path)
        if found is None:
            return F.lit(False)
        c, kind, several = found
        if several:
            return two_valued(F.exists(c, lambda x: x.isNotNull()))
        if isinstance(kind, T.MapType):
            return two_valued(F.exists(F.map_values(c), lambda x: x.isNotNull()))
        return c.isNotNull()


@dataclass(frozen=True)
class Term(Clause):
    path: str
    value: Any
    case_insensitive: bool = False

    def match(self, s: Scope) -> Column:
        def test(c: Column, kind: T.DataType) -> Column:
            c, kind = opened(c, kind, self.value)
            if self.case_insensitive:
                return F.lower(c) == F.lower(F.lit(str(self.value)))
            return c == literal(self.value, kind)

        if s.analyzer(self.path)[1] in ("text", "code"):  # an exact token of an analysed field
            found = s.text(self.path)
            return F.lit(False) if found is None else two_valued(F.array_contains(found[0], str(self.value)))
        return any_value(s.values(self.path), test)


def literal(value: Any, kind: T.DataType) -> Column:
    return F.lit(value) if isinstance(kind, T.StringType) and isinstance(value, str) else F.lit(str(value) if isinstance(kind, (T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType)) else value).try_cast(kind)


@dataclass(frozen=True)
class Terms(Clause):
    path: str
    values: tuple[Any, ...]

    def match(self, s: Scope) -> Column:
        if not self.values:
            return F.lit(False)
        def test(c: Column, kind: T.DataType) -> Column:
            c, kind = opened(c, kind, *self.values)
            return c.isin(*(literal(v, kind) for v in self.values))

        return any_value(s.values(self.path), test)


@dataclass(frozen=True)
class Pattern(Clause):
    """prefix, wildcard or regexp on whole values."""

    path: str
    kind: str
    value: str
    case_insensitive: bool = False

    def match(self, s: Scope) -> Column:
        def test(c: Column, kind: T.DataType) -> Column:
            c = opened(c, kind)[0].cast("string")
            if self.kind == "prefix":
                return F.lower(c).startswith(self.value.lower()) if self.case_insensitive else c.startswith(self.value)
            pattern = an.wildcard_pattern(self.value) if self.kind == "wildcard" else an.lucene_pattern(self.value)
            return c.rlike(("(?iu)" if self.case_insensitive else "") + pattern)

        return any_value(s.values(self.path), test)


@dataclass(frozen=True)
class Fuzzy(Clause):
    path: str
    value: str
    fuzziness: str | int = "AUTO"
    prefix_length: int = 0
    transpositions: bool = True

    def match(self, s: Scope) -> Column:
        d = an.edits(self.fuzziness, self.value)
        return any_value(s.values(self.path), lambda c, _: an.near(c, self.value, d, self.prefix_length, self.transpositions))


@dataclass(frozen=True)
class Range(Clause):
    path: str
    lt: Any = None
    lte: Any = None
    gt: Any = None
    gte: Any = None
    format: str | None = None
    time_zone: str | None = None
    relation: str | None = None  # of ranges that documents hold; a single value is in the range or not, whichever is asked

    def __post_init__(self) -> None:
        if self.relation is not None and self.relation.lower() not in ("intersects", "contains", "within"):
            raise QueryError(f"unknown relation `{self.relation}`")

    def match(self, s: Scope) -> Column:
        def bound(v: Any, kind: T.DataType) -> Column:
            if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) and isinstance(v, str) and (self.format or self.time_zone):
                t = F.to_timestamp(F.lit(v), self.format) if self.format else F.lit(v).cast("timestamp")
                return (F.to_utc_timestamp(t, self.time_zone) if self.time_zone else t).cast(kind)
            return literal(v, kind)

        def test(c: Column, kind: T.DataType) -> Column:
            c, kind = opened(c, kind, self.lt, self.lte, self.gt, self.gte)
            out = F.lit(True)
            if self.lt is not None:
                out = out & (c < bound(self.lt, kind))
            if self.lte is not None:
                out = out & (c <= bound(self.lte, kind))
            if self.gt is not None:
                out = out & (c > bound(self.gt, kind))
            if self.gte is not None:
                out = out & (c >= bound(self.gte, kind))
            return out & c.isNotNull()

        return any_value(s.values(self.path), test)


@dataclass(frozen=True)
class Ids(Clause):
    values: tuple[str, ...]

    def match(self, s: Scope) -> Column:
        return F.col("_id").isin(*map(str, self.values)) if self.values else F.lit(False)


K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Match(Clause):
    """match, match_phrase, match_phrase_prefix and match_bool_prefix on one analysed field."""

    path: str
    text: str
    kind: str = "match"
    operator: str = "or"
    fuzziness: str | int | None = None
    minimum_should_match: int | str | None = None
    prefix_length: int = 0
    analyzer: str | None = None
    slop: int = 0
    zero_terms: str = "none"

    def _terms(self, s: Scope) -> list[str]:
        return an.analyze(self.text, self.analyzer or s.analyzer(self.path)[1])

    def _hit(self, tokens: Column, term: str, last: bool) -> Column:
        if last and self.kind.endswith("prefix"):
            return F.exists(tokens, lambda t: t.startswith(term))
        d = an.edits(self.fuzziness, term)
        return F.exists(tokens, lambda t: an.near(t, term, d, self.prefix_length)) if d else F.array_contains(tokens, term)

    def match(self, s: Scope) -> Column:
        found, terms = s.text(self.path, self.analyzer), self._terms(s)
        if found is None:
            return F.lit(False)
        tokens = found[0]
        if not terms:
            return F.lit(self.zero_terms == "all")
        if self.kind.startswith("match_phrase"):
            return two_valued(self._phrase(tokens, terms))
        hits = [two_valued(self._hit(tokens, t, i == len(terms) - 1)) for i, t in enumerate(terms)]
        if self.operator.lower() == "and":
            return reduce(lambda a, b: a & b, hits)
        n = required_count(self.minimum_should_match, len(hits)) if self.minimum_should_match is not None else 1
        if n <= 1:
            return reduce(lambda a, b: a | b, hits)
        return reduce(lambda a, b: a + b, (h.cast("int") for h in hits)) >= n

    def _phrase(self, tokens: Column, terms: list[str]) -> Column:
        prefix, n = self.kind == "match_phrase_prefix", len(terms)

        def fits(t: Column, i: int) -> Column:
            return t.startswith(terms[i]) if prefix and i == n - 1 else t == terms[i]

        starts = F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0)))
        if not self.slop:
            return F.exists(starts, lambda p: reduce(lambda a, b: a & b, (two_valued(fits(F.get(tokens, p + i), i)) for i in range(n))))
        # in order, with at most ``slop`` other tokens among them
        return F.exists(starts, lambda p: two_valued(fits(F.get(tokens, p), 0)) & (self._after(tokens, p, fits, n) <= self.slop + n))

    def _after(self, tokens: Column, p: Column, fits: Callable, n: int) -> Column:
        """Length of the shortest run from ``p`` that holds the terms in order."""
        window = F.slice(tokens, p + 1, n + self.slop)
        start = F.struct(F.lit(0).alias("term"), F.lit(0).alias("at"), F.lit(10**6).alias("end"))

        def step(acc: Column, t: Column) -> Column:
            want = [F.when(acc["term"] == i, two_valued(fits(t, i))) for i in range(n)]
            ok = F.coalesce(*want, F.lit(False))
            term = acc["term"] + ok.cast("int")
            return F.struct(term.alias("term"), (acc["at"] + 1).alias("at"), F.when(ok & (term == n), F.least(acc["end"], acc["at"] + 1)).otherwise(acc["end"]).alias("end"))

        return F.aggregate(window, start, step, lambda acc: acc["end"])

    def terms(self, s: Scope) -> set:
        if s.text(self.path, self.analyzer) is None:
            return set()
        how = self.analyzer or s.analyzer(self.path)[1]
        return {(self.path, how, t) for t in self._terms(s)}

    def score(self, s: Scope) -> Column:
        found = s.text(self.path, self.analyzer)
        if found is None or not s.stats:
            return super().score(s)
        tokens, how = found
        length = F.size(tokens)
        each = []
        for i, t in enumerate(self._terms(s)):
            idf, average = s.stats.get((self.path, how, t), (0.0, 1.0))
            d = an.edits(self.fuzziness, t)
            prefix = i == len(self._terms(s)) - 1 and self.kind.endswith("prefix")
            tf = F.size(F.filter(tokens, lambda x: x.startswith(t) if prefix else an.near(x, t, d) if d else x == t)).cast("double")
            each.append(F.coalesce(F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(average, 1e-9))), F.lit(0.0)))
        return F.when(self.match(s), total(each) * float(self.boost)).otherwise(0.0)


@dataclass(frozen=True)
class MultiMatch(Clause):
    """One text over several fields (``name^weight``)."""

    fields: tuple[str, ...]
    text: str
    kind: str = "best_fields"
    operator: str = "or"
    fuzziness: str | int | None = None
    tie_breaker: float | None = None
    minimum_should_match: int | str | None = None

    def parts(self) -> list[Match]:
        how = {"phrase": "match_phrase", "phrase_prefix": "match_phrase_prefix", "bool_prefix": "match_bool_prefix"}.get(self.kind, "match")
        out = []
        for f in self.fields:
            path, _, weight = f.partition("^")
            out.append(Match(path, self.text, kind=how, operator=self.operator, fuzziness=self.fuzziness, minimum_should_match=self.minimum_should_match, boost=float(weight or 1)))
        return out

    def _by_term(self, s: Scope) -> list[list[Match]]:
        """Term-centric: for each term its fields."""
        terms = dict.fromkeys(t for m in self.parts() for t in m._terms(s))
        return [[replace(m, text=t, operator="or", minimum_should_match=None) for m in self.parts()] for t in terms]

    def match(self, s: Scope) -> Column:
        if self.kind in ("cross_fields", "combined"):
            hits = [reduce(lambda a, b: a | b, (m.match(s) for m in ms)) for ms in self._by_term(s)]
            if not hits:
                return F.lit(False)
            n = len(hits) if self.operator.lower() == "and" else required_count(self.minimum_should_match or 1, len(hits))
            return reduce(lambda a, b: a + b, (h.cast("int") for h in hits)) >= n
        return reduce(lambda a, b: a | b, (m.match(s) for m in self.parts()), F.lit(False))

    def score(self, s: Scope) -> Column:
        if self.kind in ("cross_fields", "combined"):
            value = total([best([m.score(s) for m in ms], 0.0) for ms in self._by_term(s)])
        else:
            each = [m.score(s) for m in self.parts()]
            summed = self.kind in ("most_fields", "bool_prefix")
            value = total(each) if summed else best(each, self.tie_breaker or 0.0)
        return F.when(self.match(s), value * float(self.boost)).otherwise(0.0)

    def terms(self, s: Scope) -> set:
        return set().union(*(m.terms(s) for m in self.parts()))


def best(each: list[Column], tie_breaker: float) -> Column:
    top = F.greatest(*each) if len(each) > 1 else each[0]
    return top + (total(each) - top) * float(tie_breaker) if tie_breaker else top


@dataclass(frozen=True)
class MoreLikeThis(Clause):
    """The ``like`` texts' most telling terms, as an OR with a minimum."""

    fields: tuple[str, ...]
    like: tuple[str, ...]
    min_term_freq: int = 2
    max_query_terms: int = 25
    minimum_should_match: int | str = "30%"

    def _query(self, s: Scope) -> Clause:
        picked = []
        for f in self.fields:
            counts: dict[str, int] = {}
            for text in self.like:
                for t in an.analyze(text, s.analyzer(f)[1]):
                    counts[t] = counts.get(t, 0) + 1
            for t, n in counts.items():
                if n >= self.min_term_freq:
                    idf = (s.stats or {}).get((f, s.analyzer(f)[1], t), (1.0, 1.0))[0]
                    picked.append((n * idf, f, t))
        picked.sort(key=lambda x: (-x[0], x[1], x[2]))
        should = tuple(Match(f, t) for _, f, t in picked[: self.max_query_terms])
        return Bool(should=should, minimum_should_match=self.minimum_should_match) if should else MatchNone()

    def match(self, s: Scope) -> Column:
        return self._query(s).match(s)

    def score(self, s: Scope) -> Column:
        return self._query(s).score(s) * float(self.boost)

    def terms(self, s: Scope) -> set:
        return {(f, s.analyzer(f)[1], t) for f in self.fields for text in self.like for t in an.analyze(text, s.analyzer(f)[1])}


@dataclass(frozen=True)
class Wrapped(Clause):
    """A clause around others; subclasses combine them."""

    def inner(self) -> tuple[Clause, ...]:
        return ()

    def terms(self, s: Scope) -> set:
        return set().union(*(q.terms(s) for q in self.inner()))


@dataclass(frozen=True)
class ConstantScore(Clause):
    query: Clause

    def match(self, s: Scope) -> Column:
        return self.query.match(s)


@dataclass(frozen=True)
class DisMax(Wrapped):
    queries: tuple[Clause, ...]
    tie_breaker: float = 0.0

    def inner(self) -> tuple[Clause, ...]:
        return self.queries

    def match(self, s: Scope) -> Column:
        return reduce(lambda a, b: a | b, (q.match(s) for q in self.queries), F.lit(False))

    def score(self, s: Scope) -> Column:
        return best([q.score(s) for q in self.queries], self.tie_breaker) * float(self.boost) if self.queries else F.lit(0.0)


@dataclass(frozen=True)
class Boosting(Wrapped):
    positive: Clause
    negative: Clause
    negative_boost: float

    def inner(self) -> tuple[Clause, ...]:
        return (self.positive,)

    def match(self, s: Scope) -> Column:
        return self.positive.match(s)

    def score(self, s: Scope) -> Column:
        return self.positive.score(s) * F.when(self.negative.match(s), float(self.negative_boost)).otherwise(1.0) * float(self.boost)


@dataclass(frozen=True)
class FunctionScore(Wrapped):
    """functions: (filter or None, weight number or a function of the scope)."""

    query: Clause
    functions: tuple[tuple[Clause | None, Any], ...]
    score_mode: str = "multiply"
    boost_mode: str = "multiply"
    max_boost: float | None = None
    min_score: float | None = None

    def inner(self) -> tuple[Clause, ...]:
        return (self.query,)

    def _value(self, s: Scope) -> Column:
        pairs = [((F.lit(True) if q is None else q.match(s)), (v(s) if callable(v) else F.lit(float(v))).cast("double")) for q, v in self.functions]
        applied = reduce(lambda a, b: a | b, (p for p, _ in pairs), F.lit(False))
        if not pairs:
            return F.lit(1.0)
        match self.score_mode:
            case "multiply":
                out = reduce(lambda a, b: a * b, (F.when(p, v).otherwise(1.0) for p, v in pairs))
            case "first":
                out = F.coalesce(*(F.when(p, v) for p, v in pairs))
            case "max" | "min":
                each = [F.when(p, v) for p, v in pairs]
                out = (F.greatest if self.score_mode == "max" else F.least)(*each) if len(each) > 1 else each[0]
            case "sum" | "avg":
                out = total([F.when(p, v).otherwise(0.0) for p, v in pairs])
                if self.score_mode == "avg":
                    count = total([F.when(p, 1.0).otherwise(0.0) for p, _ in pairs])
                    out = out / F.when(count > 0, count)
            case other:
                raise QueryError(f"unknown score_mode `{other}`")
        out = F.when(applied, out).otherwise(1.0)
        return F.least(out, F.lit(float(self.max_boost))) if self.max_boost is not None else out

    def _raw(self, s: Scope) -> Column:
        q, f = self.query.score(s), self._value(s)
        combined = {"multiply": q * f, "replace": f, "sum": q + f, "avg": (q + f) / 2, "max": F.greatest(q, f), "min": F.least(q, f)}
        if self.boost_mode not in combined:
            raise QueryError(f"unknown boost_mode `{self.boost_mode}`")
        return combined[self.boost_mode] * float(self.boost)

    def match(self, s: Scope) -> Column:
        m = self.query.match(s)
        return m & (self._raw(s) >= self.min_score) if self.min_score is not None else m

    def score(self, s: Scope) -> Column:
        return F.when(self.match(s), self._raw(s)).otherwise(0.0)


@dataclass(frozen=True)
class Script(Clause):
    """A Spark SQL condition over the document's fields, with :named parameters."""

    source: str
    params: dict[str, Any] = field(default_factory=dict, hash=False)

    def column(self) -> Column:
        return F.expr(bind(self.source, self.params))

    def match(self, s: Scope) -> Column:
        return two_valued(self.column())


def bind(source: str, params: dict[str, Any]) -> str:
    import re

    def value(m: re.Match) -> str:
        if m[1] not in params:
            return m[0]
        v = params[m[1]]
        if isinstance(v, bool) or v is None:
            return str(v).lower() if v is not None else "NULL"
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else repr(v)

    return re.sub(r"(?<!:):([A-Za-z_]\w*)", value, source)


@dataclass(frozen=True)
class ScriptScore(Wrapped):
    query: Clause
    source: str
    params: dict[str, Any] = field(default_factory=dict, hash=False)
    min_score: float | None = None

    def inner(self) -> tuple[Clause, ...]:
        return (self.query,)

    def _raw(self) -> Column:
        return F.expr(bind(self.source, self.params)).cast("double") * float(self.boost)

    def match(self, s: Scope) -> Column:
        m = self.query.match(s)
        return m & two_valued(self._raw() >= self.min_score) if self.min_score is not None else m

    def score(self, s: Scope) -> Column:
        return F.when(self.match(s), F.coalesce(self._raw(), F.lit(0.0))).otherwise(0.0)


@dataclass(frozen=True)
class DistanceFeature(Clause):
    """boost * pivot / (pivot + distance): ``origin`` a (lat, lon) with a distance pivot, or a time with one in seconds."""

    path: str
    origin: Any
    pivot: Any

    def match(self, s: Scope) -> Column:
        return Exists(self.path).match(s)

    def score(self, s: Scope) -> Column:
        found = s.values(self.path)
        if found is None:
            return F.lit(0.0)
        if isinstance(self.origin, (tuple, list)):
            pivot, away = geo.metres(self.pivot), geo.haversine(found[0], *self.origin)
        else:
            pivot = seconds(self.pivot)
            away = F.abs(F.unix_micros(found[0].cast("timestamp")) - F.unix_micros(F.lit(str(self.origin)).cast("timestamp"))) / 1e6
        return F.coalesce(F.lit(float(self.boost) * pivot) / (F.lit(pivot) + away), F.lit(0.0))


def seconds(x: Any) -> float:
    if isinstance(x, (int, float)):
        return float(x)
    units = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
    number = x.rstrip("abcdefghijklmnopqrstuvwxyz")
    return float(number) * units[x[len(number) :] or "s"]


@dataclass(frozen=True)
class RankFeature(Clause):
    path: str
    function: str = "saturation"
    pivot: float = 1.0
    exponent: float = 1.0
    scaling_factor: float = 1.0

    def match(self, s: Scope) -> Column:
        return Exists(self.path).match(s)

    def score(self, s: Scope) -> Column:
        found = s.values(self.path)
        if found is None:
            return F.lit(0.0)
        v = found[0].cast("double")
        out = {"saturation": v / (v + self.pivot), "log": F.ln(self.scaling_factor + v), "sigmoid": F.pow(v, F.lit(self.exponent)) / (F.pow(v, F.lit(self.exponent)) + self.pivot**self.exponent), "linear": v}
        if self.function not in out:
            raise QueryError(f"unknown rank function `{self.function}`")
        return F.coalesce(out[self.function] * float(self.boost), F.lit(0.0))


@dataclass(frozen=True)
class Geo(Clause):
    """distance: (lat, lon, distance); box: (top, left, bottom, right); polygon: points."""

    path: str
    kind: str
    args: tuple
    plane: bool = False

    def match(self, s: Scope) -> Column:
        def test(c: Column, _: T.DataType) -> Column:
            if self.kind == "distance":
                return geo.haversine(c, self.args[0], self.args[1], self.plane) <= geo.metres(self.args[2])
            return geo.in_box(c, *self.args) if self.kind == "box" else geo.in_polygon(c, list(self.args))

        return any_value(s.values(self.path), test)


@dataclass(frozen=True)
class Nested(Clause):
    """any: an element that matches all of the query; all: none that fails it; exists: an element."""

    path: str
    query: Clause | None = None
    how: str = "any"
    score_mode: str = "avg"
    ignore_unmapped: bool = False

    def _elements(self, s: Scope) -> tuple[Column, T.StructType] | None:
        found = s.look(self.path)
        if found is None:
            if self.ignore_unmapped:
                return None
            raise QueryError(f"`{self.path}` is not mapped")
        if not isinstance(found[1], T.ArrayType) or not isinstance(found[1].elementType, T.StructType):
            raise QueryError(f"`{self.path}` is not nested")
        return found[0], found[1].elementType

    def _inside(self, s: Scope, kind: T.StructType, e: Column) -> Scope:
        return Scope(kind, e, self.path, s.stats)

    def match(self, s: Scope) -> Column:
        found = self._elements(s)
        if found is None:
            return F.lit(False)
        c, kind = found
        if self.how == "exists" or self.query is None:
            return two_valued(F.size(c) > 0)
        if self.how == "all":
            return F.forall(F.coalesce(c, F.array().cast(T.ArrayType(kind))), lambda e: self.query.match(self._inside(s, kind, e)))
        return two_valued(F.exists(c, lambda e: self.query.match(self._inside(s, kind, e))))

    def score(self, s: Scope) -> Column:
        found = self._elements(s)
        if found is None or self.query is None or self.how != "any" or self.score_mode == "none":
            return F.when(self.match(s), 0.0 if self.score_mode == "none" else float(self.boost)).otherwise(0.0)
        c, kind = found
        hits = F.filter(c, lambda e: self.query.match(self._inside(s, kind, e)))
        scores = F.transform(hits, lambda e: self.query.score(self._inside(s, kind, e)))
        added = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
        value = {"sum": added, "avg": added / F.size(scores), "max": F.array_max(scores), "min": F.array_min(scores)}[self.score_mode]
        return F.when(self.match(s), value * float(self.boost)).otherwise(0.0)


@dataclass(frozen=True)
class MapSearch(Clause):
    """Full text over a map's values; preferred keys weigh more."""

    path: str
    text: str
    prefer: tuple[tuple[str, float], ...] = ()
    only_preferred: bool = False
    operator: str = "or"
    fuzziness: str | int | None = None
    minimum_should_match: int | str | None = None

    def _parts(self) -> list[Match]:
        return [Match(f"{self.path}.{k}", self.text, operator=self.operator, fuzziness=self.fuzziness, minimum_should_match=self.minimum_should_match, analyzer="text", boost=w) for k, w in self.prefer]

    def _any(self, s: Scope) -> Column:
        found = s.look(self.path)
        if found is None or not isinstance(found[1], T.MapType):
            raise QueryError(f"`{self.path}` is not a map")
        inner = T.StructType([T.StructField("v", T.StringType(), True, {"type": "text"})])
        q = Match("v", self.text, operator=self.operator, fuzziness=self.fuzziness, minimum_should_match=self.minimum_should_match)
        return two_valued(F.exists(F.map_values(found[0]), lambda v: q.match(Scope(inner, F.struct(v.cast("string").alias("v"))))))

    def match(self, s: Scope) -> Column:
        out = reduce(lambda a, b: a | b, (p.match(s) for p in self._parts()), F.lit(False))
        return out if self.only_preferred else out | self._any(s)

    def score(self, s: Scope) -> Column:
        each = [p.score(replace(s, stats=None)) for p in self._parts()]
        if not self.only_preferred:
            each.append(F.when(self._any(s), 1.0).otherwise(0.0))
        return best(each, 0.0) * float(self.boost) if each else F.lit(0.0)


@dataclass(frozen=True)
class HasKey(Clause):
    path: str
    key: str

    def match(self, s: Scope) -> Column:
        found = s.look(self.path)
        return F.lit(False) if found is None else two_valued(F.map_contains_key(found[0], self.key) & found[0][self.key].isNotNull())
