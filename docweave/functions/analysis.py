"""Text analysis as column expressions, and the same for query strings on the driver."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, functions as F

# one accented Latin letter to one plain letter, by canonical decomposition
_ACCENTED = [chr(c) for c in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and d[0].isascii()]
_PLAIN = [unicodedata.normalize("NFD", c)[0] for c in _ACCENTED]
# fixed values: letters that fold to others, or to two
_PLAIN_FOR = {"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ı": "i"}
_TWO_FOR = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "TH"}
_FROM = "".join(_ACCENTED) + "".join(_PLAIN_FOR)
_TO = "".join(_PLAIN) + "".join(_PLAIN_FOR.values())

#: A word by the standard segmentation rules: letters, digits and underscores, joined
#: by apostrophes, stops and colons between letters or by stops and commas between digits.
_W = r"[\p{L}\p{M}\p{N}_]"
STANDARD = rf"{_W}+(?:(?:(?<=\p{{L}})[:'’.·](?=\p{{L}})|(?<=\p{{N}})[.,;'’](?=\p{{N}})){_W}+)*"
CODE_PART = r"\p{Lu}+(?!\p{Ll})|\p{Lu}?\p{Ll}+|\p{N}+|[\p{Lo}\p{Lm}\p{Lt}]+"


def fold(c: Column) -> Column:
    c = F.translate(c, _FROM, _TO)
    for a, b in _TWO_FOR.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def fold_lower(c: Column) -> Column:
    return F.lower(fold(c))


def text_tokens(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(STANDARD), 0), fold_lower)


def code_tokens(c: Column) -> Column:
    def parts(t: Column) -> Column:
        joined = F.regexp_replace(t, r"[^\p{L}\p{N}]", "")
        return F.array_distinct(F.concat(F.array(t, joined), F.regexp_extract_all(t, F.lit(CODE_PART), 0)))

    words = F.filter(F.split(c, r"\s+"), lambda t: t != "")
    return F.filter(F.transform(F.flatten(F.transform(words, parts)), fold_lower), lambda t: t != "")


def tokens(c: Column, analyzer: str) -> Column:
    if analyzer == "keyword":
        return F.array(c)
    if analyzer == "lowercase":
        return F.array(fold_lower(c))
    return code_tokens(c) if analyzer == "code" else text_tokens(c)


def _fold_str(s: str) -> str:
    s = s.translate(str.maketrans(_FROM, _TO))
    for a, b in _TWO_FOR.items():
        s = s.replace(a, b)
    return s.lower()


def analyze(s: str, analyzer: str) -> list[str]:
    """The query side of ``tokens``."""
    import regex

    if analyzer == "keyword":
        return [s]
    if analyzer == "lowercase":
        return [_fold_str(s)]
    if analyzer == "code":
        out: list[str] = []
        for t in s.split():
            out += dict.fromkeys([t, regex.sub(r"[^\p{L}\p{N}]", "", t), *regex.findall(CODE_PART, t)])
        return [_fold_str(t) for t in out if t]
    return [_fold_str(t) for t in regex.findall(STANDARD, s)]


def wildcard_pattern(pattern: str) -> str:
    """``*`` any characters, ``?`` one, a backslash takes the next as it is; anchored."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(".*" if c == "*" else "." if c == "?" else re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def lucene_pattern(pattern: str) -> str:
    """A whole-value Lucene expression to Java: ``@`` any string, ``#`` nothing, ``<a-b>`` numbers, quotes literal; ^ and $ are characters."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append(re.escape(pattern[i + 1]) if not pattern[i + 1].isalnum() else pattern[i : i + 2])
            i += 2
            continue
        if in_class:
            in_class = c != "]"
            out.append(c)
        elif c == "[":
            in_class = True
            out.append(c)
        elif c == '"' and (end := pattern.find('"', i + 1)) > 0:
            out.append(re.escape(pattern[i + 1 : end]))
            i = end
        elif c == "<" and (m := re.match(r"<(\d+)-(\d+)>", pattern[i:])):
            low, high = sorted((int(m[1]), int(m[2])))
            if high - low > 10_000:
                raise ValueError(f"the interval {m[0]} is too wide")
            out.append("(?:" + "|".join(f"0*{n}" for n in range(low, high + 1)) + ")")
            i += len(m[0]) - 1
        elif c == "@":
            out.append(".*")
        elif c == "#":
            out.append("(?!)")
        elif c in "^$":
            out.append("\\" + c)
        elif c in "&~":
            raise ValueError(f"`{c}` in a regular expression is not supported")
        else:
            out.append(c)
        i += 1
    return "(?s)^(?:" + "".join(out) + ")$"


def edits(fuzziness: str | int | None, term: str) -> int:
    if fuzziness in (None, 0, "0"):
        return 0
    m = re.fullmatch(r"AUTO(?::(\d+),(\d+))?", str(fuzziness).upper())
    if not m:
        return int(fuzziness)
    low, high = int(m[1] or 3), int(m[2] or 6)
    return 0 if len(term) < low else 1 if len(term) < high else 2


def near(c: Column, term: str, distance: int, prefix: int = 0, transpositions: bool = True) -> Column:
    """Within ``distance`` edits; a swap of neighbours counts one edit by testing the swapped terms too."""
    ok = F.levenshtein(c, F.lit(term), distance) >= 0
    if transpositions and distance:
        for i in range(len(term) - 1):
            if term[i] != term[i + 1]:
                swapped = term[:i] + term[i + 1] + term[i] + term[i + 2 :]
                ok = ok | (F.levenshtein(c, F.lit(swapped), distance - 1) >= 0)
    return ok & c.startswith(term[:prefix]) if prefix else ok
