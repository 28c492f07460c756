"""Quality rules: plain counts, and perplexity bands of a Kneser-Ney model.

The model is an interpolated modified Kneser-Ney model of 4-grams of characters, one for each
language code, whatever their number, counted by Spark over all texts.  A language's alphabet
is its own: white space and every other character of its texts (case folded), none of which
shares a symbol with another; should it have more than ``FREQUENT`` of them, each of
the rarest is spelled by two symbols that spell nothing else.  So a model grows with the distinct grams of
its language.  It is built where they meet, kept as
sorted arrays of grams with the log probabilities beside them, and broadcast with small
ones packed together; a worker loads those it meets and drops the oldest over ``LOADED_BYTES``.
A run's distinct grams are looked up by binary search.

A document's perplexity is per letter or digit: by character, the predictable marks of table
junk would offset their rarity.  Each language has its band: of log(log perplexity),
the median, ``below`` and ``above`` times the spread on that side (median to 16 % or 84 %
quantile) away, never nearer than ``least_width``.  Bands come from the documents that pass the base rule.

Edge cases: null and empty texts count zeros, fail the base rule and have a null
perplexity.  A null language is a language of its own.  A text without letters counts as having one.
Ties, repeated rows and null doc_ids come out row for row.  Other columns are
ignored.
"""

from __future__ import annotations

import pickle
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from . import text as tx
from .scratch import Scratch

ORDER, CLASSES = 4, 1 << 15  # symbols, so that a gram is a long
GRAMS = CLASSES**ORDER
FREQUENT, REST = 30_655, 1056  # of the symbols: characters of their own, and each half of a spelled one; the other is white space
SYMBOLS = b"#*$%&|<>"
FLUSH = 1 << 22
#: Models kept in a worker, and those put into one broadcast.
LOADED_BYTES, PACK_BYTES = 96 << 20, 8 << 20
BROADCAST_LANGUAGES = 100_000

U64 = np.uint64
_SPACE, _SPELLED = 0, CLASSES
_PLANES = 0x110000
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


@lru_cache(1)
def _folding() -> tuple[np.ndarray, np.ndarray]:
    """For each character its lower case, where that is one character, and whether it is a letter, a digit or a part of one."""
    fold, letter = np.arange(_PLANES, dtype=np.uint32), np.zeros(_PLANES, bool)
    for i in range(_PLANES):
        c = chr(i)
        low = c.lower()
        if len(low) == 1 and ord(low) < _PLANES:
            fold[i] = ord(low)
        letter[i] = unicodedata.category(c)[0] in "LMN"
    fold[[9, 10, 11, 12, 13]] = 32
    return fold, letter


def characters(run: tx.Run) -> tuple[np.ndarray, np.ndarray]:
    """Folded characters of a run's documents end to end, and where each document begins (and the end)."""
    data = run.data
    fold, _ = _folding()
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    c = data[at].astype(np.uint32)
    if len(at) < len(data):
        high = np.flatnonzero(c >= 0xC0)
        x, first = at[high], c[high]
        size = 2 + (first >= 0xE0).astype(np.int64) + (first >= 0xF0)
        value = first & (np.uint32(0x7F) >> size.astype(np.uint32))
        last = len(data) - 1
        for j in (1, 2, 3):
            more = size > j
            value = np.where(more, (value << np.uint32(6)) | (data[np.minimum(x + j, last)] & 0x3F), value)
        c[high] = np.minimum(value, _PLANES - 1)  # beyond: not UTF-8
    offsets = np.searchsorted(at, run.offsets)
    return fold[c], offsets


def gram_codes(symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each symbol the code of the gram that ends there; a document starts after white space."""
    n, docs = len(symbols), len(offsets) - 1
    pad = ORDER - 1
    place = np.arange(n) + pad * np.repeat(np.arange(1, docs + 1), np.diff(offsets))
    s = np.full(n + pad * docs, _SPACE, np.int64)
    s[place] = symbols
    codes = s[place]
    for j in range(1, ORDER):
        codes += s[place - j] * CLASSES**j
    return codes


def alphabet(frequent: np.ndarray) -> np.ndarray:
    """Symbol of each folded character up to the greatest of the language's most frequent ones; the last entry stands for all beyond."""
    out = np.full(max(32, int(frequent.max(initial=0))) + 2, _SPELLED, np.uint16)
    out[frequent] = 1 + np.arange(len(frequent))
    out[32] = _SPACE
    return out


def spell(c: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of some documents' characters, and where each document begins among them (and the end)."""
    s = classes[np.minimum(c, len(classes) - 1)]
    rare = np.flatnonzero(s == _SPELLED)
    if not len(rare):
        return s, offsets
    sizes = np.ones(len(c), np.int64)
    sizes[rare] = 2
    at = np.append(0, np.cumsum(sizes))
    out = np.empty(at[-1], np.uint16)
    out[at[:-1]] = s
    out[at[rare]] = 1 + FREQUENT + c[rare] // REST
    out[at[rare] + 1] = 1 + FREQUENT + REST + c[rare] % REST
    return out, at[offsets]


def _by_language(b: pa.RecordBatch, column: int) -> Iterator[tuple[str | None, pa.RecordBatch]]:
    """The rows of each language, one after the other."""
    codes = b.column(column).dictionary_encode()
    which = np.asarray(pc.fill_null(codes.indices, -1))
    for k in np.unique(which).tolist():
        rows = np.flatnonzero(which == k)
        yield (None if k < 0 else codes.dictionary[k].as_py()), (b if len(rows) == b.num_rows else b.take(pa.array(rows)))


def _count_characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str | None, np.ndarray] = {}
    schema = pa.schema([("lang", pa.string()), ("c", pa.int32()), ("n", pa.int64())])

    def out() -> Iterator[pa.RecordBatch]:
        for lang, n in counts.items():
            c = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(c.astype(np.int32)), pa.array(n[c])], schema=schema)
        counts.clear()

    tx.worker_slot("quality", lambda: None)
    for b in batches:
        for lang, part in _by_language(b, 1):
            if lang not in counts and sum(map(len, counts.values())) >= 1 << 22:
                yield from out()
            for run in tx.runs(part.column(0)):
                n, seen = np.bincount(characters(run)[0]), counts.get(lang, np.zeros(0, np.int64))
                n, seen = (n, seen) if len(n) > len(seen) else (seen, n)
                n[: len(seen)] += seen
                counts[lang] = n
    yield from out()


class _Alphabets(dict):
    """Classes by language, made when first asked for."""

    def __init__(self, frequent: dict[str | None, np.ndarray]) -> None:
        super().__init__()
        self.frequent = frequent

    def __missing__(self, lang: str | None) -> np.ndarray:
        if len(self) >= 64:
            self.clear()
        out = self[lang] = alphabet(self.frequent.get(lang, np.empty(0, np.int32)))
        return out


def _count_grams(frequent):
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def run_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tx.worker_slot("quality", lambda: None)
        alphabets = _Alphabets(frequent.value)
        held: dict[str | None, list[np.ndarray]] = defaultdict(list)
        sizes: dict[str | None, int] = defaultdict(int)

        def out(lang: str | None) -> pa.RecordBatch:
            grams, n = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
            del sizes[lang]
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n.astype(np.int64))], schema=schema)

        for b in batches:
            for lang, part in _by_language(b, 1):
                classes = alphabets[lang]
                for run in tx.runs(part.column(0)):
                    c, offsets = characters(run)
                    if len(c):
                        held[lang].append(gram_codes(*spell(c, offsets, classes)))
                        sizes[lang] += len(held[lang][-1])
                    if sizes[lang] > FLUSH:
                        yield out(lang)
            while sum(sizes.values()) > 2 * FLUSH:
                yield out(max(sizes, key=sizes.get))
        for lang in list(held):
            yield out(lang)

    return run_over


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more."""
    n1, n2, n3, n4 = ((counts == k).sum() for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    d = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, [0, 0.05, 0.05, 0.05], [0, 0.95, 1.95, 2.95])


class KneserNey:
    """Interpolated log10 probabilities of seen grams, and log10 back-off weights of seen contexts, by order."""

    @property
    def n_bytes(self) -> int:
        return sum(x.nbytes for pair in (*self.tables, *self.weights) for x in pair)

    def __init__(self, grams: np.ndarray, counts: np.ndarray) -> None:
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        self.weights: list[tuple[np.ndarray, np.ndarray]] = []
        by_order = [(grams.astype(np.int64), counts.astype(np.float64))]
        for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct longer grams that end so
            by_order.append(tuple(np.unique(by_order[-1][0] % CLASSES**k, return_counts=True)))
        shorter, lower = np.zeros(1, np.int64), np.full(1, 1.0 / CLASSES)  # the order below: it has every end of a gram
        for k, (g, c) in enumerate(reversed(by_order), 1):
            c = c.astype(np.float64)
            d = _discounts(c)[np.minimum(c, 3).astype(int)]
            used, which = np.unique(g // CLASSES, return_inverse=True)
            total = np.bincount(which, weights=c)
            freed = np.bincount(which, weights=np.minimum(d, c)) / total
            below = lower[np.searchsorted(shorter, g % CLASSES ** (k - 1))] if len(g) else np.empty(0)
            p = (c - np.minimum(d, c)) / total[which] + freed[which] * below
            shorter, lower = g, p
            self.tables.append((g, np.log10(p).astype(np.float32)))
            self.weights.append((used, np.log10(np.maximum(freed, 1e-9)).astype(np.float32)))

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = table
        if not len(keys):
            return np.zeros(len(g), bool), np.zeros(len(g), np.float32)
        i = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
        return keys[i] == g, values[i]

    def log10(self, grams: np.ndarray) -> np.ndarray:
        out = np.zeros(len(grams), np.float32)
        todo = np.arange(len(grams))
        for k in range(ORDER, 0, -1):
            g = grams[todo] % CLASSES**k
            hit, value = self._find(self.tables[k - 1], g)
            out[todo[hit]] += value[hit]
            todo, g = todo[~hit], g[~hit]
            if not len(todo):
                return out
            seen, weight = self._find(self.weights[k - 1], g // CLASSES)
            out[todo] += np.where(seen, weight, 0)
        out[todo] -= np.log10(CLASSES)
        return out


def base_counts(run: tx.Run) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each document of a run."""
    starts, ends, bounds = tx.word_spans(run)
    sums = tx.prefix_hashes(run.data, tx.BYTE)
    docs = len(run)

    def per_doc(flags: np.ndarray) -> np.ndarray:
        c = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=c[1:])
        return c[run.offsets[1:]] - c[run.offsets[:-1]]

    n_words = np.diff(bounds)
    chars = per_doc(~tx.SEPARATOR[run.data] & ((run.data & 0xC0) != 0x80))
    symbols = per_doc(_SYMBOL[run.data])

    # lines: runs of bytes between \n inside a document
    data = run.data
    breaks = np.flatnonzero(data == 10)
    owner = np.searchsorted(run.offsets, breaks, "right") - 1
    line_start = np.concatenate([run.offsets[:-1], breaks + 1])
    line_end = np.concatenate([breaks, run.offsets[1:]])
    line_doc = np.concatenate([np.arange(docs), owner])
    order = np.lexsort((line_start, line_doc))
    line_start, line_doc = line_start[order], line_doc[order]
    line_end = np.sort(line_end) if len(line_end) else line_end
    line_end = np.maximum(line_end, line_start)
    wordy = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    h, d = tx.sure_hashes(data, sums, line_start[wordy], line_end[wordy]), line_doc[wordy]
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
    dup_lines = np.bincount(d[again], minlength=docs)

    # words in 3-word windows that occur twice or more
    w = tx.sure_hashes(data, sums, starts, ends)
    word_doc = np.repeat(np.arange(docs), n_words)
    covered = np.zeros(len(w), bool)
    if len(w) >= 3:
        g = tx.gram_hashes(w, 3)
        inside = np.flatnonzero(word_doc[2:] == word_doc[:-2])
        g, d = g[inside], word_doc[inside]
        order = np.lexsort((g, d))
        g, d = g[order], d[order]
        same = (g[1:] == g[:-1]) & (d[1:] == d[:-1])
        twice = np.zeros(len(g), bool)
        twice[1:] |= same
        twice[:-1] |= same
        at = inside[order[twice]]
        for j in range(3):
            covered[at + j] = True
    repeat = np.bincount(word_doc[covered], minlength=docs)
    return {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat}


def _build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One language's model; its distinct grams meet here."""
    grams, n = table.column("gram").to_numpy(), table.column("n").to_numpy()
    order = np.argsort(grams)
    model = KneserNey(grams[order], n[order])
    return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "size": pa.array([model.n_bytes], pa.int64()), "model": pa.array([pickle.dumps(model)], pa.binary())})


class Models:
    """Where each language's model is; a worker loads what it meets."""

    def __init__(self, packs: list, where: dict[str | None, int]) -> None:
        self.packs, self.where = packs, where

    def of(self, lang: str | None, loaded: dict[str | None, KneserNey]) -> KneserNey:
        model = loaded.pop(lang, None)
        if model is None:
            if lang not in self.where:
                return KneserNey(np.empty(0, np.int64), np.empty(0))
            pack = self.packs[self.where[lang]]
            model = pickle.loads(pack.value[lang])
            pack.__dict__.pop("_value", None)  # the worker's copy of the whole pack; its file stays
        loaded[lang] = model
        while len(loaded) > 1 and sum(m.n_bytes for m in loaded.values()) > LOADED_BYTES:
            del loaded[next(iter(loaded))]
        return model


def _score(models: Models, frequent, carried: list[str]):
    """Over rows (doc_id, text, lang, others); the columns ``carried`` come along."""

    def run_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tx.worker_slot("quality", lambda: None)
        loaded: dict[str | None, KneserNey] = {}
        alphabets = _Alphabets(frequent.value)
        _, letter = _folding()
        for b in batches:
            for lang, rows in _by_language(b, 2):
                model, classes = models.of(lang, loaded), alphabets[lang]
                for run in tx.runs(rows.column(1)):
                    stats = base_counts(run)
                    c, offsets = characters(run)
                    symbols, at = spell(c, offsets, classes)
                    used, which = np.unique(gram_codes(symbols, at), return_inverse=True)
                    price = model.log10(used)[which]
                    sums = np.zeros(len(price) + 1)
                    np.cumsum(price, out=sums[1:])
                    letters = np.zeros(len(c) + 1, np.int64)
                    np.cumsum(letter[c], out=letters[1:])
                    size = np.diff(offsets)
                    cost = -np.diff(sums[at]) / np.maximum(np.diff(letters[offsets]), 1)
                    part = rows.slice(run.first, len(run))
                    columns = [part.column(0), part.column(2), *(pa.array(x.astype(np.int64)) for x in stats.values()), pa.array(cost, mask=size == 0), *(part.column(x) for x in carried)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang", *stats, "loss", *carried])

    return run_over


def language_models(spark: SparkSession, docs: DataFrame, scratch: Scratch):
    """(Models, broadcast alphabets, number of languages) of (text, lang): two scans, and a model a language."""
    sc = spark.sparkContext
    seen = docs.select("text", "lang").mapInArrow(_count_characters, "lang string, c int, n long").groupBy("lang", "c").agg(F.sum("n").alias("n")).where("c <> 32")
    top = seen.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "c"))).where(F.col("rank") <= FREQUENT)
    frequent: dict[str | None, np.ndarray] = {}
    for r in top.groupBy("lang").agg(F.collect_list("c").alias("cs")).toLocalIterator():  # a language's alphabet
        frequent[r["lang"]] = np.sort(np.array(r["cs"], np.int32))
    frequent_of = sc.broadcast(frequent)
    grams = docs.select("text", "lang").mapInArrow(_count_grams(frequent_of), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    built = scratch.stage(grams.groupBy("lang").applyInArrow(_build, "lang string, size long, model binary"), "models")
    packs, where, pack, size = [], {}, {}, 0
    for r in built.toLocalIterator():  # the driver holds a pack at a time
        if pack and size + r["size"] > PACK_BYTES:
            packs.append(sc.broadcast(pack))
            pack, size = {}, 0
        pack[r["lang"]], where[r["lang"]] = bytes(r["model"]), len(packs)
        size += r["size"]
    if pack:
        packs.append(sc.broadcast(pack))
    return Models(packs, where), frequent_of, len(frequent)


def quality_rules(spark: SparkSession, docs: DataFrame, below: float = 5.0, above: float = 6.0, least_width: float = 0.01, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lang, perplexity, lower, upper), row for row.

    Columns of ``docs`` named in ``carry`` come along as in_<name>.
    """
    scratch = Scratch(spark, "quality")
    own = {"doc_id": "bigint", "text": "string", "lang": "string"}
    # a column that goes through Python goes once; the others travel in one struct
    shared = [c for c in carry if own.get(c) == docs.schema[c].dataType.simpleString()]
    others = [c for c in carry if c not in shared]
    docs = docs.select(*(F.col(c).cast(t).alias(c) for c, t in own.items()), *([F.struct(*(F.col(f"`{c}`") for c in others)).alias("others")] if others else []))
    models, frequent, n_languages = language_models(spark, docs, scratch)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    extra = [c for c in ("text", "others") if c in shared or c in docs.columns[3:]]
    schema = T.StructType([docs.schema["doc_id"], docs.schema["lang"], *(T.StructField(x, T.LongType()) for x in names), T.StructField("loss", T.DoubleType()), *(docs.schema[c] for c in extra)])
    scored = scratch.stage(docs.mapInArrow(_score(models, frequent, extra), schema), "scored")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed).withColumn("level", F.when(F.col("loss") > 0, F.log("loss")))
    # the bands come from documents that pass the base rule, where a language has any
    bands = scored.where("level is not null").groupBy("lang").agg(F.percentile_approx(F.when(~F.col("base_failed"), F.col("level")), [0.16, 0.5, 0.84], 10_000).alias("q"))
    low = F.greatest(F.lit(least_width), below * (F.col("q")[1] - F.col("q")[0]))
    high = F.greatest(F.lit(least_width), above * (F.col("q")[2] - F.col("q")[1]))
    bands = bands.select(F.col("lang").alias("band_lang"), (F.col("q")[1] - low).alias("low"), (F.col("q")[1] + high).alias("high"))
    if n_languages <= BROADCAST_LANGUAGES:  # else Spark joins by language
        bands = F.broadcast(bands)
    out = scored.join(bands, F.col("lang").eqNullSafe(F.col("band_lang")), "left")
    inside = F.coalesce(F.col("level").between(F.col("low"), F.col("high")), F.lit(True))

    def perplexity(level):
        return F.pow(F.lit(10.0), F.exp(level))

    return out.select("doc_id", *names, "base_failed", (~F.col("base_failed") & inside).alias("kept"), "lang",
                      F.pow(F.lit(10.0), F.col("loss")).alias("perplexity"), perplexity(F.col("low")).alias("lower"), perplexity(F.col("high")).alias("upper"), *((F.col(c) if c in shared else F.col("others")[c]).alias(f"in_{c}") for c in carry))
