from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and in to is that it for was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 60)) for _ in range(n))


def lower(t: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def edge_rows() -> list[tuple]:
    """Nulls in every column, empty and odd texts, copies, near copies, repeated rows, a long text."""
    a = prose(1, 120)
    near = a.replace(a.split()[60], "CHANGED", 1)
    long = prose(2, 30_000)
    rows = [
        (1, a, "en", "s1", 1), (2, a, "en", "s2", 1), (3, near, "en", "s3", 1), (4, a.upper(), None, None, None), (5, None, "en", "s1", None), (6, "", "en", "s1", 0),
        (7, " \n\t \x0b ", "en", "s1", 5), (8, "one two", "en", "s2", 7), (9, "one  two", "en", "s3", 8), (10, "a b c d e", "fr", "s1", 9), (11, long, "de", "s4", 1), (12, long + " tail", "de", "s5", 1),
        (13, "é ü × ÷ 日本語 🙂 don't stop.\n" * 6, "ja", "s1", 3), (14, "x" * 5000, "en", "s1", 1), (15, prose(9, 300) + "\n" + a, "en", "s9", 1),
    ]
    return rows


def repeated_rows() -> list[tuple]:
    """Ids that repeat or are null."""
    a = prose(1, 120)
    return [(1, a, "en", "s1", 1), (1, a, "en", "s1", 1), (1, prose(5, 90), "en", "s1", 1), (None, a, "en", "s1", 1), (None, None, None, None, None), (7, a, "en", "s2", 1)]


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema).repartition(3)


def clashing(df):
    """Extra columns named like what operators add."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in ("node", "component_id", "token", "k", "doc", "at", "word", "line", "kind", "score", "key", "length", "ids", "start", "chunk", "copies", "payload_digest", "record_type", "sequence_id", "side", "__gone", "__id", "__text", "spans", "kept", "n_bytes", "row", "gone", "at", "id", "of_text", "hit_id", "carried", "loss", "level", "low", "in_text", "in_doc_id", "bytes", "site", "n_lines", "a.b", "anchor")})
