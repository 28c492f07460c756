from __future__ import annotations

import hashlib
import math
import os
import pickle
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from docweave.llm import text as tx
from docweave.llm.bpe import Encoder, bpe_round_trip, latin_pattern
from docweave.llm.jaccard import jaccard_components
from docweave.llm.lines import line_dedup
from docweave.llm.packing import BestFit, best_fit_decreasing, pack_documents
from docweave.llm.quality import CLASSES, FREQUENT, GRAMS, REST, KneserNey, quality_rules
from docweave.llm.scoring import Bits, Tables, _count_bits, _spread, mixing_scores, table_bits
from docweave.llm.suffix import substring_dedup
from docweave.llm.toxicity import toxicity_scores

from .common import clashing, edge_rows, frame, lower, prose, repeated_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALL = [edge_rows(), repeated_rows(), []]


def by_row(rows):
    return sorted(rows, key=str)


def base_counts(t):
    w = WORD.findall(t or "")
    lines, seen, dup = (t or "").split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered), failed


@pytest.mark.parametrize("rows", ALL)
def test_quality(spark, rows):
    out = quality_rules(spark, clashing(frame(spark, rows)), carry=("source", "text")).collect()
    assert by_row(tuple(r)[:7] for r in out) == by_row((r[0], *base_counts(r[1])) for r in rows)
    assert all(not r["kept"] for r in out if r["base_failed"])
    assert by_row((r["doc_id"], r["in_text"]) for r in out) == by_row((r[0], r[1]) for r in rows)


def test_quality_bands_reject_noise(spark):
    rows = [(i, prose(i, 150), "en", "s", 1) for i in range(80)] + [(500 + i, " ".join("zqxj"[k % 4] * 7 + "##" for k in range(i, 90 + i)) + " " + " ".join(str(k * 7919 % 9973) for k in range(200)), "en", "s", 1) for i in range(3)]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules(spark, frame(spark, rows)).collect()}
    assert all(kept[i] for i in range(80)) and not any(kept[500 + i] for i in range(3))


def test_quality_bands_reject_scrambled_words(spark):
    def scrambled(seed, share):
        r = random.Random(seed)
        return " ".join("".join(r.sample(w, len(w))) if r.random() < share else w for w in prose(seed, 400).split())

    rows = [(i, prose(i, 400), "en", "s", 1) for i in range(200)] + [(500 + i, scrambled(500 + i, i / 40), "en", "s", 1) for i in range(16)]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules(spark, frame(spark, rows), below=3.0, above=3.0).collect()}
    assert all(kept[i] for i in range(200)) and not any(kept[500 + i] for i in range(2, 16))
    # the default bands, wider to keep clean documents of mixed content, take scrambling of an eighth of the words and more
    kept = {r["doc_id"]: r["kept"] for r in quality_rules(spark, frame(spark, rows)).collect()}
    assert all(kept[i] for i in range(200)) and not any(kept[500 + i] for i in range(5, 16))


def _fold(c):
    if ord(c) >= 0x20000:  # rarer ideographs share classes
        return chr(0x4E00 | ord(c) & 0x3FFF)
    low = c.lower()
    return " " if c in "\t\n\x0b\x0c\r" else low if len(low) == 1 else c


def _letter(c):
    return unicodedata.category(c)[0] in "LMN"


def brute_perplexity(texts):
    """Modified Kneser-Ney 4-grams over the alphabet of these texts, with dicts of tuples; log10 loss a letter."""
    folded = [[_fold(c) for c in t or ""] for t in texts]
    often = Counter(c for t in folded for c in t if c != " ")
    top = {c: 1 + i for i, (c, _) in enumerate(sorted(often.items(), key=lambda x: (-x[1], ord(x[0])))[:FREQUENT])}
    classes = {}
    for c in often:
        rest = int(tx.mix(np.array([ord(c)], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))[0] % np.uint64(REST))
        classes[c] = top.get(c, 1 + FREQUENT + rest if _letter(c) else CLASSES - 1)
    streams = [[0, 0, 0] + [classes.get(c, 0) for c in t] for t in folded]
    counts = [None] * 5
    counts[4] = Counter(tuple(s[i - 3 : i + 1]) for s in streams for i in range(3, len(s)))
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def discount(k):
        n = [sum(v == j for v in counts[k].values()) for j in range(5)]
        if not (n[1] and n[2] and n[3]):
            return [0, 0.5, 0.75, 0.9]
        y = n[1] / (n[1] + 2 * n[2])
        return [0] + [min(max(j - (j + 1) * y * n[j + 1] / n[j], 0.05), j - 0.05) for j in (1, 2, 3)]

    d = [None] + [discount(k) for k in (1, 2, 3, 4)]
    total, freed = [Counter() for _ in range(5)], [Counter() for _ in range(5)]
    for k in (1, 2, 3, 4):
        for g, v in counts[k].items():
            total[k][g[:-1]] += v
            freed[k][g[:-1]] += min(d[k][min(v, 3)], v)

    def p(g):
        k = len(g)
        if not k:
            return 1 / CLASSES
        h = g[:-1]
        if h not in total[k]:
            return p(g[1:])
        v = counts[k].get(g, 0)
        return (v - min(d[k][min(v, 3)], v)) / total[k][h] + freed[k][h] / total[k][h] * p(g[1:])

    known = {g: math.log10(p(g)) for g in counts[4]}
    return [-sum(known[tuple(s[i - 3 : i + 1])] for i in range(3, len(s))) / max(1, sum(map(_letter, t))) if t else None for s, t in zip(streams, folded)]


def brute_quality(rows, below=5.0, above=6.0, width=0.01):
    """doc_id -> (kept, perplexity)."""
    failed = {r[0]: base_counts(r[1])[-1] for r in rows}
    out = {}
    for lang in {r[2] for r in rows}:
        own = [r for r in rows if r[2] == lang]
        loss = dict(zip((r[0] for r in own), brute_perplexity([r[1] for r in own])))
        level = sorted(math.log(x) for i, x in loss.items() if x and not failed[i])
        q = [level[max(0, math.ceil(s * len(level)) - 1)] for s in (0.16, 0.5, 0.84)] if level else None
        for i, x in loss.items():
            inside = not (q and x) or q[1] - max(width, below * (q[1] - q[0])) - 1e-6 <= math.log(x) <= q[1] + max(width, above * (q[2] - q[1])) + 1e-6
            out[i] = (not failed[i] and inside, x and 10**x)
    return out


SCRIPTS = {"el": 0x3B1, "ru": 0x430, "hy": 0x561, "ja": 0x4E00, "hi": 0x905, "xx": 0x10400}


def _script_words(lang, seed, n, noise=False):
    r, base, own = random.Random(seed), SCRIPTS[lang], random.Random(lang)
    vocabulary = ["".join(chr(base + own.randrange(24)) for _ in range(own.randint(2, 7))) for _ in range(60)]
    words = [r.choice(vocabulary) for _ in range(n)]
    return " ".join("".join(r.sample(w, len(w))) if noise else w for w in words)


def test_quality_equals_brute_force(spark):
    rows = [(i, prose(i, 60 + i), "en", "s", 1) for i in range(40)] + [(100 + i, f"{prose(i, 70)} | {'#' * i} \u00c9t\u00c9 \u0130 \U0001f642", None, "s", 1) for i in range(9)]
    rows += [(200 + 20 * k + i, _script_words(lang, 50 * k + i, 80, i == 9), lang, "s", 1) for k, lang in enumerate(SCRIPTS) for i in range(10)]
    rows += [(900, "\U00024b62 " * 80, "ja", "s", 1), (901, "-- " * 70, "ru", "s", 1), (902, "", "ru", "s", 1), (903, None, "zz", "s", 1)]
    want = brute_quality(rows)
    for r in quality_rules(spark, frame(spark, rows)).collect():
        kept, perplexity = want[r["doc_id"]]
        assert r["kept"] == kept, r
        assert (r["perplexity"] is None) if perplexity is None else r["perplexity"] == pytest.approx(perplexity, rel=1e-3), (r, perplexity)


def test_quality_no_two_characters_share_a_symbol(spark):
    """Texts that differ only in a rare mark or a rare letter of a language with 200 letters."""
    r = random.Random(4)
    words = ["".join(chr(0x4E00 + r.randrange(200)) for _ in range(3)) for _ in range(120)]
    rows = [(i, " ".join(r.choice(words) for _ in range(80)), "zh", "s", 1) for i in range(40)]
    rows += [(100 + i, f"{rows[0][1]} {c}", "zh", "s", 1) for i, c in enumerate("\u00a7\u00a7\u00b6")]
    rows += [(200 + i, f"{rows[0][1]} {chr(0x5000 + i // 2)}", "zh", "s", 1) for i in range(1, 60)]  # each letter twice but the first
    got = {x["doc_id"]: x["perplexity"] for x in quality_rules(spark, frame(spark, rows)).collect()}
    assert got[100] == pytest.approx(got[101], rel=1e-9) and got[100] != pytest.approx(got[102], rel=1e-6)
    assert all(got[201] != pytest.approx(got[i], rel=1e-6) for i in range(202, 260))


def test_quality_alphabets_over_the_limit_are_spelled(monkeypatch):
    import docweave.llm.quality as quality

    monkeypatch.setattr(quality, "FREQUENT", 4)
    c = np.array([97, 98, 0x4E00, 32, 0x10FFFF, 0x24B62, 97, 0x4F62, 200], np.uint32)
    symbols, offsets = quality.spell(c, np.array([0, 3, 3, 9]), quality.alphabet(np.array([97, 98, 99, 100])))
    assert offsets.tolist() == [0, 4, 4, 14]
    pair = [[5 + x // REST, 5 + REST + x % REST] for x in c.tolist()]
    assert symbols.tolist() == [1, 2, *pair[2], 0, *pair[4], *pair[5], 1, *pair[7], *pair[8]]
    assert symbols.max() < CLASSES and 2 * REST + FREQUENT + 1 <= CLASSES and REST**2 >= 0x110000


def test_quality_noise_in_other_scripts_goes(spark):
    rows = [(1000 * k + i, _script_words(lang, i, 120, i >= 40), lang, "s", 1) for k, lang in enumerate(SCRIPTS) for i in range(43)]
    for r in quality_rules(spark, frame(spark, rows)).collect():
        assert r["kept"] == (r["doc_id"] % 1000 < 40), r


def test_quality_two_hundred_languages(spark, monkeypatch):
    """Every code has its own model, whatever is loaded or packed together."""
    import docweave.llm.quality as quality

    monkeypatch.setattr(quality, "PACK_BYTES", 200_000)
    monkeypatch.setattr(quality, "LOADED_BYTES", 100_000)
    rows = [(3 * k + i, prose(3 * k + i, 55) + f" {k}" * 3, f"l{k}", "s", 1) for k in range(200) for i in range(3)]
    want = brute_quality(rows)
    out = quality_rules(spark, frame(spark, rows)).collect()
    assert len(out) == 600
    for r in out:
        assert (r["kept"], r["perplexity"]) == (want[r["doc_id"]][0], pytest.approx(want[r["doc_id"]][1], rel=1e-3))


def test_kneser_ney_is_a_distribution():
    rng = np.random.default_rng(0)
    n = CLASSES
    grams, counts = np.unique(rng.integers(0, 4, 5000) * n**3 + rng.integers(0, 5, 5000) * n**2 + rng.integers(0, 6, 5000) * n + rng.integers(0, 7, 5000), return_counts=True)
    m = KneserNey(grams, counts)
    for context in (int(grams[0]) // n, 31 * n * n + 7, 999):
        p = 10.0 ** m.log10(np.arange(context * n, (context + 1) * n) % GRAMS)
        assert abs(p.sum() - 1) < 1e-3 and (p > 0).all()


def _thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_self_similar_words_and_lines_differ(spark):
    """Two long words that a polynomial hash modulo 2**64 takes for one."""
    x = _thue_morse(2048)
    y = x.translate({97: "b", 98: "a"})
    docs = frame(spark, [(1, x, "en", "s", 1), (2, y, "en", "s", 1), (3, x.upper(), "en", "s", 1), (4, f"{x}\n{y}", "en", "s", 1), (5, " ".join([x, "p", "q", y, "p", "q"]), "en", "s", 1)])
    counts = {r["doc_id"]: r for r in quality_rules(spark, docs).collect()}
    assert counts[4]["n_dup_lines"] == 0 and counts[5]["n_repeat_words"] == 0
    assert {r["doc_id"]: (r["component_id"], r["n_links"]) for r in jaccard_components(spark, docs).collect()} == {1: (1, 1), 2: (2, 0), 3: (1, 1), 4: (4, 0), 5: (5, 0)}


@pytest.mark.parametrize("rows", ALL)
def test_lines(spark, rows):
    df = line_dedup(spark, clashing(frame(spark, rows)), min_sites=2)
    assert set(clashing(frame(spark, rows)).columns) < set(df.columns)
    sites: dict[str, set] = {}
    for r in rows:
        for line in (r[1].split("\n") if r[1] is not None else []):
            sites.setdefault(line.strip(" \t\r\x0b\x0c"), set()).add(r[3] or "")
    want = []
    for r in rows:
        parts = r[1].split("\n") if r[1] is not None else []
        kept = [x for x in parts if not x.strip(" \t\r\x0b\x0c") or len(sites[x.strip(" \t\r\x0b\x0c")]) < 2]
        want.append((r[0], "\n".join(kept) if r[1] is not None else None, len(parts), len(parts) - len(kept)))
    assert by_row((r["doc_id"], r["text"], r["n_lines"], r["n_removed_lines"]) for r in df.collect()) == by_row(want)


def test_lines_near_the_threshold_are_exact(spark):
    rows = [(100 * n + s, f"own {n} {s}\nshared by {n} sites", "en", f"site{s}", 1) for n in range(60, 141, 4) for s in range(n)]
    gone = {r["doc_id"] // 100 for r in []}
    out = line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), min_sites=100).collect()
    for r in out:
        n = int(re.search(r"own (\d+)", r["text"])[1])
        assert (r["n_removed_lines"] == 1) == (n >= 100), (n, r)
    assert not gone


def brute_substrings(rows, length=100):
    """Rows in (doc_id nulls last, text) order, each a document."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1] is not None, rows[i][1] or ""))
    seen, out = set(), []
    for i in order:
        b = (rows[i][1] or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((rows[i][0], len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return by_row(out)


SHARED = "".join(chr(97 + (i * i * 31 + i) % 26) for i in range(400))
CASES = [edge_rows()[:10] + edge_rows()[12:], repeated_rows(), [], [(i, prose(300 + i, 30) + SHARED[: 99 + i] + prose(400 + i, 20), "en", "s", 1) for i in range(5)], [(i, f"{i % 7}{i % 5}" + SHARED[i % 9 :] + str(i), "en", "s", 1) for i in range(120)], [(1, "ab" * 300, "en", "s", 1), (2, "x" + "ab" * 80, "en", "s", 1)]]


@pytest.mark.parametrize("rows", CASES)
def test_substrings(spark, rows):
    got = []
    for r in substring_dedup(spark, clashing(frame(spark, rows))).collect():
        got.append((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()))
    assert by_row(got) == brute_substrings(rows)


def test_substrings_split_hot_anchors(spark, monkeypatch):
    import docweave.llm.suffix as suffix

    monkeypatch.setattr(suffix, "SPLIT_AT", 5)
    rows = [(i, f"{i}" * 3 + SHARED[: 150 + i] + f"-{i}", "en", "s", 1) for i in range(40)]
    for limit in (0, 1000):
        monkeypatch.setattr(suffix, "BROADCAST_ANCHORS", limit)
        got = [(r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"]).hex()) for r in substring_dedup(spark, frame(spark, rows), output="sha256").collect()]
        assert by_row(got) == brute_substrings(rows)


def test_substrings_text_and_carry(spark):
    rows = [(1, "é" * 120, "en", "s", 1), (2, "xé" + "é" * 99 + "ü", "fr", "t", 2)]
    docs = clashing(frame(spark, rows))
    out = {r["doc_id"]: r for r in substring_dedup(spark, docs, output="text", carry=tuple(docs.columns)).collect()}
    # the first byte of ü is that of é, so it goes too, and the second with it
    assert bytes(out[2]["kept"]).decode() == "x" and out[2]["in_lang"] == "fr" and out[2]["in_kept"] == "clash"


SPECIAL = [(1, "hello <|startoftext|> there", "en", "s", 1), (2, "a<|endoftext|>b<|ENDOFTEXT|>", "en", "s", 1), (3, "<|endoftext|>", "en", "s", 1), (4, "caf<|endoftext|>e\u0301 <|endoftext|><|startoftext|>", "fr", "s", 1)]


@pytest.mark.parametrize("rows", [*ALL, SPECIAL])
def test_packing(spark, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    out = pack_documents(spark, clashing(frame(spark, rows)), path, window=512, with_ids=True).collect()
    want = Counter(tuple(t.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in rows)
    assert sum(r["length"] for r in out) == sum(len(k) * n for k, n in want.items())
    sequences: dict[int, list] = {}
    for r in out:
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 512
    if rows is ALL[0] or rows is SPECIAL:
        for r in rows:
            own = sorted((p["start"], bytes(p["ids"])) for p in out if p["doc_id"] == r[0])
            assert b"".join(x for _, x in own) == np.array(t.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4").tobytes()


def test_best_fit_takes_the_tightest():
    fit = BestFit(10)
    assert [fit.place(n) for n in (7, 6, 4, 3, 10, 2)] == [(0, 0), (1, 0), (1, 6), (0, 7), (2, 0), (3, 0)]
    sizes = np.random.default_rng(0).integers(1, 4096, 3000)
    which, _ = best_fit_decreasing(sizes, 4096)
    assert which.max() + 1 <= 1.03 * sizes.sum() / 4096 + 2


def _tiktoken():
    import base64

    import tiktoken

    raw = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return raw, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("rows", ALL)
def test_bpe(spark, rows):
    _, own = _tiktoken()
    out = bpe_round_trip(spark, clashing(frame(spark, rows)), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert by_row((r["doc_id"], r["n_tokens"], np.frombuffer(bytes(r["ids"]), "<u4").tolist(), bytes(r["decoded"]).decode()) for r in out) == by_row((r[0], len(e := own.encode_ordinary(r[1] or "")), e, r[1] or "") for r in rows)


def test_bpe_long_and_odd_pre_tokens():
    raw, own = _tiktoken()
    e = Encoder(raw, public_tokenizers.PATTERN)
    for t in ("a" * 9000, "ab" * 3000 + "c", "ɐx" * 50, "\x1c \x85\xa0  x'll 12½ ²", "the" * 2000):
        assert np.frombuffer(e.encode(t), "<u4").tolist() == own.encode_ordinary(t)
        assert e.decode(e.encode(t)).decode() == t
    assert latin_pattern(r"\d+") is None and latin_pattern(r"\p{L}++") is None


@pytest.mark.parametrize("rows", ALL)
def test_scoring_base(spark, rows):
    tokens = [[*WORD.findall(lower(r[1] or "")), None] for r in rows]
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows]
    c = Counter(t for w, h in zip(tokens, held) if not h for t in w)
    n, v = sum(c.values()), len(c)
    want = [(r[0], h, len(w), sum(c[t] > 0 for t in w), n, round(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in w), 6)) for r, w, h in zip(rows, tokens, held)]
    out = mixing_scores(spark, clashing(frame(spark, rows))).collect()
    assert by_row((*tuple(r)[:5], round(r["base_score"], 6)) for r in out) == by_row(want)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in out)


def test_scoring_beats_the_base_on_held_out(spark):
    rows = [(i, prose(i, 200), "en" if i % 2 else "xx", "s", 1) for i in range(120)]
    held = [r for r in mixing_scores(spark, frame(spark, rows)).collect() if r["held_out"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held) * 1.02


def _counted(words, bits):
    """Tables of the bit counts of some words."""
    got = np.zeros(sum(2 << n for n in bits), np.float32)
    for batch in _count_bits(bits)(iter([pa.RecordBatch.from_arrays([pa.array(words, pa.binary())], names=["word"])])):
        i = batch.column(0)[0].as_py()
        got[i << 15 : (i + 1) << 15] = _spread(batch.column(1)[0].as_py())
    return Tables(bits, np.split(got, np.cumsum([2 << n for n in bits])[:-1]))


def test_scoring_knows_a_letter_after_its_last_one():
    words = [bytes([c]) + b"qu" for c in range(97, 123) if c != ord("k")]
    tables = _counted(words, table_bits(len(words)))
    bits = Bits([b"kqu"], tables.bits)
    x, (_, depth) = tables.price_inputs(bits)
    u = slice(16, 24)  # after "kq", which no word has; "q" is always followed by "u"
    assert (depth[u] // 4 == 1).all()
    assert (sum(x)[u] * np.where(bits.bit[u] == 1, 1, -1) > 2).all()


def test_scoring_tables_grow_with_the_vocabulary():
    assert [table_bits(n) for n in (0, 1000, 1 << 20, 3_200_000, 10**10)] == [(17, 19, 19, 19, 19), (17, 19, 19, 19, 19), (17, 19, 20, 20, 20), (17, 19, 21, 22, 22), (17, 19, 21, 24, 24)]
    words = [f"w{i:x}y".encode() for i in range(4000)]
    tables = _counted(words, table_bits(len(words)))
    assert all(t.sum() == sum(8 * (len(w) + 1) for w in words) for t in tables.counts)


def test_scoring_equals_its_definitions(spark):
    """The score recomputed a token at a time from the formulas, given the price of spelling."""
    rows = [(i, prose(i, 60) + " Ünïcode" * (i % 3), ("en", "de", None)[i % 3], "s", 1) for i in range(40)] + [(77, None, "en", "s", 1), (None, "w1 zz9", "de", "s", 1)]
    tokens = [[w.encode() for w in lower(r[1] or "").split()] + [b"\n"] for r in rows]
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows]
    langs = Counter(r[2] for r, h in zip(rows, held) if not h)
    order = sorted(langs, key=lambda x: (-langs[x], x is not None, x or ""))
    counts = {lang: Counter(t for w, r, h in zip(tokens, rows, held) if not h and r[2] == lang for t in w) for lang in order}
    every = sum(counts.values(), Counter())

    def level(c):
        n, once, twice = sum(c.values()), sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        return n, min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5, len(c)

    words = sorted(set(every) | {t for w in tokens for t in w})
    train = sorted(every)
    tables = _counted(train, table_bits(len(train)))
    # the mixer learns in the order of hashes, in one task here
    hashed = spark.createDataFrame([(bytearray(w),) for w in train], "word binary").repartition(1).collect()
    out = {(r["doc_id"], r["n_tokens"]): r["score"] for r in mixing_scores(spark, frame(spark, rows)).collect()}
    assert len(hashed) == len(train) and len(out) == len(rows)
    n, d, v = level(every)
    # base-free bounds: each token costs no more than its count alone, and no less than with free spelling
    shares = np.array([langs[x] + 0.5 for x in order] + [0.5, 0.5])
    priors = np.log10(shares / shares.sum())
    for r, w in zip(rows, tokens):
        def prob(spelled):
            shared = {t: max(every[t] - d, 0) / n + d * v / n * spelled for t in w}
            logs = []
            for x in order:
                m, e, k = level(counts[x])
                logs.append(sum(math.log10(max(counts[x][t] - e, 0) / m + e * k / m * shared[t]) if counts[x][t] or spelled else -math.inf for t in w))
            logs.append(sum(math.log10(shared[t]) if shared[t] else -math.inf for t in w))  # the rest of the languages: no documents, so the shared model
            logs.append(logs[-1])
            top = max(p + x for p, x in zip(priors, logs))
            return -math.inf if top == -math.inf else top + math.log10(sum(10 ** (p + x - top) for p, x in zip(priors, logs)))

        got = out[r[0], len(w)]
        assert prob(0.0) - 1e-6 <= got <= prob(1.0) + 1e-6, r
    bits = Bits(words, tables.bits)
    assert len(bits) == 8 * sum(len(w) + (w != b"\n") for w in words)


def test_scoring_contexts_cross_words(spark):
    """The same words in an order that was learned are likelier than in another."""
    r = random.Random(5)
    pairs = [(f"a{i}x", f"b{i}y") for i in range(30)]
    rows = [(i, " ".join(w for _ in range(40) for w in r.choice(pairs)), "en", "s", 1) for i in range(120)]
    text = " ".join(w for p in pairs for w in p)
    other = " ".join(w for i in range(30) for w in (pairs[i][0], pairs[(i + 7) % 30][1]))
    held = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    got = {x["doc_id"]: x["score"] for x in mixing_scores(spark, frame(spark, [*rows, (held[0], text, "en", "s", 1), (held[1], other, "en", "s", 1)])).collect()}
    assert got[held[0]] > got[held[1]] + 3


def test_scoring_pieces_change_nothing(monkeypatch):
    """A document in pieces has the bits and slots of the whole."""
    import docweave.llm.scoring as scoring

    text = (prose(3, 40) + " a b  c " + prose(4, 40)).encode()
    bits = table_bits(1000)
    whole = Bits([b" ".join(scoring._tokens(text))], bits, [0])
    monkeypatch.setattr(scoring, "PIECE_BYTES", 7)
    pieces, skip = zip(*scoring._pieces(text))
    assert len(pieces) > 20
    parts = Bits(list(pieces), bits, list(skip))
    assert parts.bit.tolist() == whole.bit.tolist() and parts.place.tolist() == whole.place.tolist()
    assert all(a.tolist() == b.tolist() for a, b in zip(parts.slots, whole.slots))


def _disk(spark):
    """Bytes that lie in the driver's temporary folder, where broadcasts are written."""
    return sum(os.path.getsize(os.path.join(d, x)) for d, _, names in os.walk(spark.sparkContext._temp_dir) for x in names)


def test_scoring_broadcasts_take_little_disk(spark):
    """Tables lie on the disk of the driver and of each executor: compressed, and those of documents go once they are scanned."""
    before = _disk(spark)
    out = mixing_scores(spark, frame(spark, [(i, prose(i, 80), "en", "s", 1) for i in range(60)]).repartition(12))
    assert out.count() == 60
    assert 0 < _disk(spark) - before < 2e6


def test_scoring_tables_survive_their_way():
    tables = _counted([f"w{i:x}y".encode() for i in range(4000)], (17, 19, 19, 19, 19))
    raw = pickle.dumps(tables)
    got = pickle.loads(raw)
    assert len(raw) < sum(c.nbytes for c in tables.counts) / 20
    assert got.bits == tables.bits and all((a == b).all() and a.dtype == b.dtype for a, b in zip(got.counts, tables.counts))


def test_scoring_holds_one_form_of_the_tables():
    """A worker that learned and then prices keeps the compressed counts and the logits of prices, nothing else."""
    tables = pickle.loads(pickle.dumps(_counted([b"abc", b"abd"], (17, 19, 19, 19, 19))))
    for learn in (True, False):
        bits = Bits([b"abc"], tables.bits)
        tables.short_inputs(bits, bits.same()[0], learn)
    held = [a for v in vars(tables).values() for x in (v if isinstance(v, (list, tuple)) else [v]) for a in (x if isinstance(x, list) else [x]) if isinstance(a, np.ndarray)]
    assert sum(a.nbytes for a in held) == sum(4 << n for n in tables.bits)


def _refined(mixer, logit, gate):
    p = 1 / (1 + np.exp(-logit.astype(float)))
    cell = gate * 33 + np.clip(np.rint(logit * 2) + 16, 0, 32).astype(int)
    return np.clip((p + (mixer.ones[cell] + 50 * p) / (mixer.hits[cell] + 50)) / 2, 1e-5, 1 - 1e-5), cell


@pytest.mark.parametrize("documents", [False, True])
def test_scoring_mixes_as_bit_by_bit(documents):
    """What is worked out once for equal contexts gives the counts, weights and prices of every bit on its own."""
    import docweave.llm.scoring as scoring

    texts = [(prose(i, 300) + " \x00a Ünïcode " + "ab" * 40).encode() for i in range(6)]
    if documents:
        words, skip = [b"".join(p for p, _ in scoring._pieces(t)) for t in texts], [i for i in range(6)]
    else:
        words, skip = sorted({w for t in texts for w in scoring._tokens(t)}), None
    bits = Bits(words, (17, 19, 19, 19, 19), skip)
    assert len(bits) == len(bits.bit) == len(bits.place) == 8 * sum(len(w) + (not documents and w != b"\n") - (skip[i] if documents else 0) for i, w in enumerate(words))
    counts = [np.bincount(s * 2 + bits.bit, minlength=2 << n).astype(np.float32) for s, n in zip(bits.slots, bits.bits)]
    if not documents:
        assert all((a == b).all() for a, b in zip(_counted(words, bits.bits).counts, counts))
    tables, mixer = Tables(bits.bits, counts), scoring.Mixer()

    # learning: a batch at a time, each bit without itself
    weights, hits, ones, seen = [w.astype(float) for w in mixer.weights], mixer.hits.copy(), mixer.ones.copy(), 0
    for lo in range(0, len(bits), scoring.BATCH):
        s = slice(lo, lo + scoring.BATCH)
        y, x = bits.bit[s], []
        for c, slots in zip(counts, bits.slots):
            one, zero = c[1::2][slots[s]] - y, c[::2][slots[s]] - (1 - y)
            x.append(scoring._logits(one.astype(np.float32), zero.astype(np.float32)).astype(float))
        gates = [bits.node[s], sum((v != 0).astype(int) for v in x) * 4 + bits.place[s]]
        logit = sum(w[k][g] * x[k] for w, g in zip(weights, gates) for k in range(5))
        _, cell = _refined(mixer, logit, gates[1])
        np.add.at(hits, cell, 1)
        np.add.at(ones, cell, y)
        error, rate = y - 1 / (1 + np.exp(-logit)), 0.15 / (1 + seen / 2e6) ** 0.3
        for w, g in zip(weights, gates):
            n = np.bincount(g, minlength=w.shape[1]) + 30
            for k in range(5):
                w[k] += rate * np.bincount(g, weights=error * x[k], minlength=w.shape[1]) / n
        seen += len(y)
    mixer.learn(tables, bits)
    assert mixer.seen == seen and mixer.hits.sum() == seen and mixer.ones.sum() == bits.bit.sum()
    assert all(np.allclose(a, b, atol=1e-4) for a, b in zip(mixer.weights, weights))
    assert abs(mixer.hits - hits).sum() < seen / 1000 and abs(mixer.ones - ones).sum() < seen / 1000  # roundings at a bucket's edge

    x, gates = tables.price_inputs(bits)
    p, _ = _refined(mixer, sum(w[k][g] * x[k] for w, g in zip(mixer.weights, gates) for k in range(5)), gates[1])
    want = np.bincount(np.repeat(bits.word, 8), weights=np.log10(np.where(bits.bit == 1, p, 1 - p)), minlength=len(words))
    assert np.allclose(mixer.log10(tables, words, skip), want, rtol=1e-4, atol=1e-3)


def _toxic_rows(n):
    return [(i, prose(i, 120) + (" vilenessword rottenone" if i % 4 == 0 else "") + " " + prose(9000 + i, 60), "en", "s", 1) for i in range(n)]


def test_toxicity_held_out(spark):
    rows = _toxic_rows(300)
    labels = [(r[0], int(r[0] % 4 == 0)) for r in rows] + [(0, 1), (None, 1), (5, None)]
    out = toxicity_scores(spark, clashing(frame(spark, rows)), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    held = [r for r in out if r["held_out"]]
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held) >= 0.95 * len(held)


@pytest.mark.parametrize("rows", ALL)
@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 0), (3, 1), (8, 0), (10, 0)], [(1, 1)]])
def test_toxicity_edges(spark, rows, labels):
    out = toxicity_scores(spark, frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert by_row(r["doc_id"] for r in out) == by_row(r[0] for r in rows)
