"""The two query-string languages, parsed on the driver to clauses."""

from __future__ import annotations

import re

from . import clauses as q

_TOKEN = re.compile(r'\s*(?:(?P<op>AND\b|OR\b|NOT\b|&&|\|\||[+\-!()])|(?P<field>[\w.\\*]+):|(?P<range>[\[{][^\]}]*[\]}])|(?P<cmp>[<>]=?)|(?P<phrase>"(?:\\.|[^"\\])*")(?:~(?P<slop>\d+))?|/(?P<regex>(?:\\.|[^/\\])+)/|(?P<word>(?:\\.|[^\s()"\[\]{}^~:])+)(?P<fuzzy>~\d*)?)(?:\^(?P<boost>[\d.]+))?')


def query_string(text: str, fields: tuple[str, ...], operator: str = "or", lenient: bool = False, analyzer: str | None = None) -> q.Clause:
    """Lucene syntax: fields, + - ! NOT AND OR, groups, phrases, ranges, wildcards, ~ and ^."""
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            if not lenient:
                raise q.QueryError(f"cannot read the query string at `{text[at : at + 20]}`")
            at += 1
            continue
        tokens.append(m)
        at = m.end()
    parser = _Parser(tokens, fields, operator, analyzer)
    out = parser.group()
    if parser.at < len(tokens) and not lenient:
        raise q.QueryError("the query string has an unopened parenthesis")
    return out or q.MatchNone()


class _Parser:
    def __init__(self, tokens: list[re.Match], fields: tuple[str, ...], operator: str, analyzer: str | None) -> None:
        self.tokens, self.fields, self.operator, self.analyzer, self.at = tokens, fields, operator.lower(), analyzer, 0

    def peek(self, *ops: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at]["op"] in ops

    def group(self) -> q.Clause | None:
        items: list[tuple[str, q.Clause]] = []  # how, clause
        link = None
        while self.at < len(self.tokens) and not self.peek(")"):
            if self.peek("AND", "&&", "OR", "||"):
                link = "and" if self.tokens[self.at]["op"] in ("AND", "&&") else "or"
                self.at += 1
                continue
            how = "should" if self.operator == "or" else "must"
            while self.peek("+", "-", "!", "NOT"):
                how = "must" if self.tokens[self.at]["op"] == "+" else "must_not"
                self.at += 1
            clause = self.unit(self.fields)
            if clause is None:
                continue
            if link == "and" and how != "must_not":
                how = "must"
            if link == "and" and items and items[-1][0] == "should":
                items[-1] = ("must", items[-1][1])
            if link == "or" and how == "must" and self.operator == "and":
                how = "should"
                if items and items[-1][0] == "must":
                    items[-1] = ("should", items[-1][1])
            items.append((how, clause))
            link = None
        if not items:
            return None
        if len(items) == 1 and items[0][0] != "must_not":
            return items[0][1]
        return q.Bool(**{k: tuple(c for h, c in items if h == k) for k in ("must", "should", "must_not")})

    def unit(self, fields: tuple[str, ...]) -> q.Clause | None:
        if self.at >= len(self.tokens):
            return None
        t = self.tokens[self.at]
        self.at += 1
        boost = float(t["boost"] or 1)
        if t["op"] == "(":
            inner = _Parser(self.tokens, fields, self.operator, self.analyzer)
            inner.at = self.at
            out = inner.group()
            self.at = inner.at
            if self.peek(")"):
                boost = float(self.tokens[self.at]["boost"] or 1)
                self.at += 1
            return out.boosted(boost) if out and boost != 1 else out
        if t["op"]:
            return None
        if t["field"]:
            return self.unit((t["field"],) if t["field"] != "_exists_" else ("_exists_",))
        each = [c for f in fields if (c := self.leaf(t, *f.partition("^")[::2])) is not None]
        if not each:
            return None
        out = each[0] if len(each) == 1 else q.DisMax(tuple(each))
        return out.boosted(boost) if boost != 1 else out

    def leaf(self, t: re.Match, path: str, weight: str) -> q.Clause | None:
        boost = float(weight or 1)
        if path == "_exists_":
            return q.Exists(t["word"])
        if t["range"]:
            low, _, high = t["range"][1:-1].partition(" TO ")
            bounds = {}
            if low.strip() not in ("*", ""):
                bounds["gte" if t["range"][0] == "[" else "gt"] = low.strip().strip('"')
            if high.strip() not in ("*", ""):
                bounds["lte" if t["range"][-1] == "]" else "lt"] = high.strip().strip('"')
            return q.Range(path, **bounds, boost=boost)
        if t["cmp"]:
            value = self.tokens[self.at]
            self.at += 1
            return q.Range(path, **{{"<": "lt", "<=": "lte", ">": "gt", ">=": "gte"}[t["cmp"]]: value["word"]}, boost=boost)
        if t["phrase"]:
            return q.Match(path, _unescape(t["phrase"][1:-1]), kind="match_phrase", slop=int(t["slop"] or 0), analyzer=self.analyzer, boost=boost)
        if t["regex"]:
            return q.Pattern(path, "regexp", t["regex"], boost=boost)
        word = t["word"]
        if word == "*":
            return q.Exists(path)
        if re.search(r"(?<!\\)[*?]", word):
            return q.Pattern(path, "wildcard", word, boost=boost)
        if t["fuzzy"]:
            return q.Match(path, _unescape(word), fuzziness=t["fuzzy"][1:] or "AUTO", boost=boost)
        return q.Match(path, _unescape(word), analyzer=self.analyzer, boost=boost)


def _unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s)


_SIMPLE = re.compile(r'\s*(?:(?P<op>[+|\-()])|(?P<phrase>"[^"]*")(?:~(?P<slop>\d+))?|(?P<word>[^\s|()"]+))')


def simple_query_string(text: str, fields: tuple[str, ...], operator: str = "or", minimum_should_match: int | str | None = None) -> q.Clause:
    """+ and, | or, - not, "phrase", prefix*, (group), word~n; never an error."""
    tokens = list(_SIMPLE.finditer(text))
    at = 0

    def leaf(m: re.Match) -> q.Clause:
        each = []
        for f in fields:
            path, _, w = f.partition("^")
            boost = float(w or 1)
            if m["phrase"]:
                each.append(q.Match(path, m["phrase"][1:-1], kind="match_phrase", slop=int(m["slop"] or 0), boost=boost))
                continue
            word = m["word"]
            if word.endswith("*") and len(word) > 1:
                each.append(q.Match(path, word[:-1], kind="match_bool_prefix", boost=boost))
            elif fuzzy := re.fullmatch(r"(.+)~(\d*)", word):
                each.append(q.Match(path, fuzzy[1], fuzziness=fuzzy[2] or "AUTO", boost=boost))
            else:
                each.append(q.Match(path, word, boost=boost))
        return each[0] if len(each) == 1 else q.DisMax(tuple(each))

    def group() -> q.Clause | None:
        nonlocal at
        out: q.Clause | None = None
        link, negate = None, False
        parts: list[q.Clause] = []
        while at < len(tokens):
            m = tokens[at]
            at += 1
            if m["op"] == ")":
                break
            if m["op"] == "(":
                c = group()
            elif m["op"]:
                if m["op"] == "-":
                    negate = True
                else:
                    link = m["op"]
                continue
            else:
                c = leaf(m)
            if c is None:
                continue
            c, negate = (~c if negate else c), False
            how = {"+": "and", "|": "or"}.get(link, operator.lower())
            parts.append(c)
            out = c if out is None else out & c if how == "and" else out | c
            link = None
        if minimum_should_match is not None and len(parts) > 1 and operator.lower() == "or":
            return q.Bool(should=tuple(parts), minimum_should_match=minimum_should_match)
        return out

    return group() or q.MatchNone()
