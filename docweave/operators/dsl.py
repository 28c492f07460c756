"""JSON query bodies: read into clauses and searches, and written from them."""

from __future__ import annotations

import dataclasses
from typing import Any

from pyspark.sql import functions as F

from . import clauses as q
from .search import Index, NestedProjection, Search
from .sorting import Sort
from .syntax import query_string, simple_query_string


def _many(x: Any) -> tuple[q.Clause, ...]:
    return tuple(parse(v) for v in (x if isinstance(x, list) else [x]))


def _field(body: dict, key: str) -> tuple[str, dict]:
    """{path: value} or {path: {key: value, ...}}."""
    (path, v), *more = body.items()
    if more:
        raise q.QueryError(f"one field is expected, not {', '.join(body)}")
    return path, v if isinstance(v, dict) else {key: v}


def _point(p: Any) -> tuple[float, float]:
    if isinstance(p, dict):
        return float(p["lat"]), float(p["lon"])
    if isinstance(p, str):
        lat, lon = p.split(",")
        return float(lat), float(lon)
    return float(p[1]), float(p[0])


def parse(dsl: dict[str, Any]) -> q.Clause:
    if len(dsl) != 1:
        raise q.QueryError(f"a query has one kind, not {', '.join(dsl) or 'none'}")
    (kind, body), = dsl.items()
    reader = _READERS.get(kind)
    if reader is None:
        raise q.QueryError(f"the query `{kind}` is not supported")
    out = reader(dict(body))
    return dataclasses.replace(out, boost=float(body.get("boost", out.boost)), name=body.get("_name")) if isinstance(body, dict) and ({"boost", "_name"} & set(body)) else out


def _leaf(cls, key: str, **rename: str):
    def read(body: dict) -> q.Clause:
        boost = body.pop("boost", None) if len(body) > 1 else None
        name = body.pop("_name", None) if len(body) > 1 else None
        path, o = _field(body, key)
        o = dict(o)
        boost, name = o.pop("boost", boost), o.pop("_name", name)
        out = cls(path, o)
        return dataclasses.replace(out, boost=float(boost or 1), name=name)

    return read


def _match(kind: str):
    def make(path: str, o: dict) -> q.Clause:
        return q.Match(path, str(o["query"]), kind=kind, operator=o.get("operator", "or"), fuzziness=o.get("fuzziness"), minimum_should_match=o.get("minimum_should_match"), prefix_length=o.get("prefix_length", 0), analyzer=o.get("analyzer"), slop=o.get("slop", 0), zero_terms=o.get("zero_terms_query", "none"))

    return _leaf(make, "query")


def _terms(body: dict) -> q.Clause:
    body = {k: v for k, v in body.items() if k not in ("boost", "_name")}
    (path, values), = body.items()
    return q.Terms(path, tuple(values))


def _geo_distance(body: dict) -> q.Clause:
    (path, p), = ((k, v) for k, v in body.items() if k not in ("distance", "distance_type", "boost", "_name", "validation_method", "ignore_unmapped"))
    return q.Geo(path, "distance", (*_point(p), body["distance"]), body.get("distance_type") == "plane")


def _geo_box(body: dict) -> q.Clause:
    (path, b), = ((k, v) for k, v in body.items() if isinstance(v, dict))
    (top, left), (bottom, right) = _point(b["top_left"]), _point(b["bottom_right"])
    return q.Geo(path, "box", (top, left, bottom, right))


def _geo_polygon(body: dict) -> q.Clause:
    (path, b), = ((k, v) for k, v in body.items() if isinstance(v, dict))
    return q.Geo(path, "polygon", tuple(map(_point, b["points"])))


def _function(f: dict):
    where = parse(f["filter"]) if "filter" in f else None
    weight = float(f.get("weight", 1.0))
    if spec := f.get("field_value_factor"):
        def factor(s: q.Scope):
            v = s.values(spec["field"])[0].cast("double")
            if spec.get("missing") is not None:
                v = F.coalesce(v, F.lit(float(spec["missing"])))
            v = v * float(spec.get("factor", 1))
            change = {"none": lambda x: x, "log": lambda x: F.log10(x), "log1p": lambda x: F.log10(x + 1), "log2p": lambda x: F.log10(x + 2), "ln": F.ln, "ln1p": lambda x: F.ln(x + 1), "ln2p": lambda x: F.ln(x + 2), "square": lambda x: x * x, "sqrt": F.sqrt, "reciprocal": lambda x: 1 / x}
            return change[spec.get("modifier", "none")](v) * weight

        return where, factor
    for shape in ("gauss", "exp", "linear"):
        if shape in f:
            return where, _decay(shape, f[shape], weight)
    if "weight" in f:
        return where, weight
    raise q.QueryError(f"the scoring function {', '.join(f)} is not supported")


def _decay(shape: str, body: dict, weight: float):
    (path, o), = ((k, v) for k, v in body.items() if isinstance(v, dict))
    decay = float(o.get("decay", 0.5))

    def value(s: q.Scope):
        import math

        c, kind, _ = s.values(path)
        from pyspark.sql import types as T

        if isinstance(kind, T.StructType):
            from ..functions import geo

            away, scale, offset = geo.haversine(c, *_point(o["origin"])), geo.metres(o["scale"]), geo.metres(o.get("offset", 0))
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            away, scale, offset = F.abs(F.unix_micros(c.cast("timestamp")) - F.unix_micros(F.lit(o["origin"]).cast("timestamp"))) / 1e6, q.seconds(o["scale"]), q.seconds(o.get("offset", 0))
        else:
            away, scale, offset = F.abs(c.cast("double") - float(o["origin"])), float(o["scale"]), float(o.get("offset", 0))
        d = F.greatest(away - offset, F.lit(0.0))
        if shape == "gauss":
            out = F.exp(d * d * (math.log(decay) / scale**2))
        elif shape == "exp":
            out = F.exp(d * (math.log(decay) / scale))
        else:
            reach = scale / (1 - decay)
            out = F.greatest((reach - d) / reach, F.lit(0.0))
        return F.coalesce(out, F.lit(1.0)) * weight

    return value


def _function_score(b: dict) -> q.Clause:
    functions = b.get("functions") or ([{k: v for k, v in b.items() if k in ("weight", "field_value_factor", "gauss", "exp", "linear")}] if {"weight", "field_value_factor", "gauss", "exp", "linear"} & set(b) else [])
    return q.FunctionScore(parse(b["query"]) if "query" in b else q.MatchAll(), tuple(map(_function, functions)), b.get("score_mode", "multiply"), b.get("boost_mode", "multiply"), b.get("max_boost"), b.get("min_score"))


def _rank_feature(b: dict) -> q.Clause:
    for kind in ("saturation", "log", "sigmoid", "linear"):
        if kind in b:
            o = b[kind]
            return q.RankFeature(b["field"], kind, float(o.get("pivot", 1)), float(o.get("exponent", 1)), float(o.get("scaling_factor", 1)))
    return q.RankFeature(b["field"])


def _script(b: dict) -> tuple[str, dict]:
    s = b["script"]
    return (s, {}) if isinstance(s, str) else (s["source"], s.get("params", {}))


_READERS = {
    "match_all": lambda b: q.MatchAll(),
    "match_none": lambda b: q.MatchNone(),
    "bool": lambda b: q.Bool(**{k: _many(b[k]) for k in ("must", "filter", "should", "must_not") if k in b}, minimum_should_match=b.get("minimum_should_match")),
    "exists": lambda b: q.Exists(b["field"]),
    "term": _leaf(lambda p, o: q.Term(p, o["value"], o.get("case_insensitive", False)), "value"),
    "terms": _terms,
    "ids": lambda b: q.Ids(tuple(b["values"])),
    "prefix": _leaf(lambda p, o: q.Pattern(p, "prefix", o["value"], o.get("case_insensitive", False)), "value"),
    "wildcard": _leaf(lambda p, o: q.Pattern(p, "wildcard", o.get("value", o.get("wildcard")), o.get("case_insensitive", False)), "value"),
    "regexp": _leaf(lambda p, o: q.Pattern(p, "regexp", o["value"], o.get("case_insensitive", False)), "value"),
    "fuzzy": _leaf(lambda p, o: q.Fuzzy(p, str(o["value"]), o.get("fuzziness", "AUTO"), o.get("prefix_length", 0), o.get("transpositions", True)), "value"),
    "range": _leaf(lambda p, o: q.Range(p, **{k: o[k] for k in ("lt", "lte", "gt", "gte", "format", "time_zone", "relation") if k in o}), "gte"),
    "match": _match("match"),
    "match_phrase": _match("match_phrase"),
    "match_phrase_prefix": _match("match_phrase_prefix"),
    "match_bool_prefix": _match("match_bool_prefix"),
    "multi_match": lambda b: q.MultiMatch(tuple(b["fields"]), b["query"], b.get("type", "best_fields"), b.get("operator", "or"), b.get("fuzziness"), b.get("tie_breaker"), b.get("minimum_should_match")),
    "combined_fields": lambda b: q.MultiMatch(tuple(b["fields"]), b["query"], "combined", b.get("operator", "or"), None, None, b.get("minimum_should_match")),
    "query_string": lambda b: query_string(b["query"], tuple(b.get("fields") or [b.get("default_field", "*")]), b.get("default_operator", "or"), b.get("lenient", False), b.get("analyzer")),
    "simple_query_string": lambda b: simple_query_string(b["query"], tuple(b["fields"]), b.get("default_operator", "or"), b.get("minimum_should_match")),
    "more_like_this": lambda b: q.MoreLikeThis(tuple(b["fields"]), tuple(b["like"] if isinstance(b["like"], list) else [b["like"]]), b.get("min_term_freq", 2), b.get("max_query_terms", 25), b.get("minimum_should_match", "30%")),
    "constant_score": lambda b: q.ConstantScore(parse(b["filter"])),
    "dis_max": lambda b: q.DisMax(_many(b["queries"]), float(b.get("tie_breaker", 0))),
    "boosting": lambda b: q.Boosting(parse(b["positive"]), parse(b["negative"]), float(b["negative_boost"])),
    "function_score": _function_score,
    "script": lambda b: q.Script(*_script(b)),
    "script_score": lambda b: q.ScriptScore(parse(b["query"]), *_script(b), min_score=b.get("min_score")),
    "distance_feature": lambda b: q.DistanceFeature(b["field"], _point(b["origin"]) if not isinstance(b["origin"], str) or "," in b["origin"] else b["origin"], b["pivot"]),
    "rank_feature": _rank_feature,
    "geo_distance": _geo_distance,
    "geo_bounding_box": _geo_box,
    "geo_polygon": _geo_polygon,
    "nested": lambda b: q.Nested(b["path"], parse(b["query"]), score_mode=b.get("score_mode", "avg"), ignore_unmapped=b.get("ignore_unmapped", False)),
}


def parse_sort(x: Any) -> Sort:
    if isinstance(x, str):
        return Sort(x, descending=x == "_score")
    (path, o), = x.items()
    o = {"order": o} if isinstance(o, str) else dict(o)
    down = o.get("order", "desc" if path == "_score" else "asc") == "desc"
    if path == "_script":
        source, params = _script(o)
        return Sort("", descending=down, script=source, params=params)
    if path == "_geo_distance":
        (field, p), = ((k, v) for k, v in o.items() if k not in ("order", "unit", "mode", "distance_type", "ignore_unmapped"))
        return Sort(field, descending=down, near=_point(p), unit=o.get("unit", "m"), mode=o.get("mode"))
    nested = o.get("nested", {})
    return Sort(path, down, o.get("missing", "_last"), o.get("mode"), parse(nested["filter"]) if "filter" in nested else None, o.get("unmapped_type"), o.get("numeric_type"))


def parse_search(index: Index, body: dict[str, Any]) -> Search:
    """A whole search body."""
    known = {"query", "sort", "from", "size", "search_after", "collapse", "post_filter", "min_score", "highlight", "_source", "track_total_hits", "track_scores"}
    if unknown := set(body) - known:
        raise q.QueryError(f"`{sorted(unknown)[0]}` in a search body is not supported")
    s = index.search()
    if "query" in body:
        s = s.raw_query(body["query"])
    sorts = body.get("sort", [])
    s = s.sort(*map(parse_sort, sorts if isinstance(sorts, list) else [sorts])).page(body.get("from", 0), body.get("size"))
    if "search_after" in body:
        s = s.search_after(*body["search_after"])
    if "collapse" in body:
        s = s.collapse(body["collapse"]["field"])
    if "post_filter" in body:
        s = s.post_filter(parse(body["post_filter"]))
    if "min_score" in body:
        s = s.min_score(body["min_score"])
    if h := body.get("highlight"):
        s = s.highlight(*h["fields"], pre=(h.get("pre_tags") or ["<em>"])[0], post=(h.get("post_tags") or ["</em>"])[0], fragment_size=h.get("fragment_size", 100), fragments=h.get("number_of_fragments", 5), require_field_match=h.get("require_field_match", True))
    if isinstance(body.get("_source"), list):
        s = s.fields(*body["_source"])
    return s


__all__ = ["NestedProjection", "parse", "parse_search", "parse_sort"]
