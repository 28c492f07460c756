"""Toxicity by compression distance: two zstandard dictionaries, calibrated thresholds.

Training reads labelled documents only, a bounded sample of them (``max_toxic``
and ``max_ordinary`` documents and ``max_bytes`` bytes a class, those whose hashed doc_id is least),
and never one whose crc32(doc_id) mod ``folds`` is 0.  Of near copies among them one is learned from.

  1. A toxic document is mostly ordinary text, and a dictionary of all of it would compress
     ordinary windows as well as toxic ones.  So its windows (words, with the space before) are
     told apart first: those stay that hold a byte 6-gram which toxic documents hold significantly
     oftener (a two-proportion z of ``min_z``, the level at which about one gram in a million would pass by
     chance, whatever the sample: with more labels rarer grams pass).  The toxic dictionary is
     trained on what stays, the ordinary one, eight times as large, on all windows of ordinary texts;
     there are two such pairs, from the samples in either order.
  2. A window's distance is its length compressed with the ordinary dictionaries less
     that with the toxic ones.  The window is written four times over, so that even a
     short word makes a block that zstandard compresses.  Windows are counted by distance
     and by the length that the toxic dictionaries leave.
  3. Calibration is cross-fitted: the counts of each quarter of the sample come from dictionaries
     trained on the other three.  They give the log likelihood ratio of each kind of window, and a
     ridge-penalised logistic regression on a document's total ratio and its counts at or past each
     distance; its threshold is set where the held-back counts give the best F1, and that is the score 0.5.

Every window of every whole text is scored.  Labels, language, source and doc_id
are not inputs.

Edge cases: null and empty texts have no windows and score what that says.  If
one class has no training rows the score is 0 for all.  Repeated label rows
count once each, null labels not at all; of repeated documents the least text is
learned from.  They come out row for row;
a null doc_id is not held out.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import text as tx
from .scratch import Scratch

TOXIC_BYTES, ORDINARY_BYTES = 8192, 65536
LEVEL = 16
GRAM = 6
REPEAT = 4
LOW, HIGH = -10, 26  # the distances of both pairs, added
SPAN, LEFT = HIGH - LOW + 1, 6  # kinds of windows: by distance, and by what is left
PARTS = 4
CACHE_WINDOWS = 400_000


def windows(text: bytes) -> list[bytes]:
    return text.lower().split()


class Distances(dict):
    """A dict from window to its kind: the distance, clipped to LOW..HIGH, and the length left; filled on demand."""

    def __init__(self, pairs: list[tuple[bytes, bytes]]) -> None:
        super().__init__()
        import zstandard

        def compressor(raw: bytes):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress

        self.pairs = [(compressor(toxic), compressor(ordinary)) for toxic, ordinary in pairs]
        self.older: dict[bytes, int] = {}

    def __missing__(self, window: bytes) -> int:
        kind = self.older.get(window)
        if kind is None:
            w = (b" " + window) * REPEAT
            left = plain = 0
            for toxic, ordinary in self.pairs:
                left += len(toxic(w))
                plain += len(ordinary(w))
            kind = min(max(plain - left, LOW), HIGH) - LOW + SPAN * min(max(left - 16, 0) // 8, LEFT - 1)
        if len(self) >= CACHE_WINDOWS:
            self.older = dict(self)
            self.clear()
        self[window] = kind
        return kind

    def counts(self, text: bytes) -> np.ndarray:
        found = bytes(map(self.__getitem__, windows(text)))
        return np.bincount(np.frombuffer(found, np.uint8), minlength=SPAN * LEFT).astype(np.float64)


def features(counts: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Of each document: its total log likelihood ratio, and its counts of windows at or past each distance with their shares, in logs."""
    n, total = counts.sum(1), counts @ ratio
    by_distance = counts.reshape(len(counts), LEFT, SPAN).sum(1)
    above = np.log1p(np.cumsum(by_distance[:, ::-1], 1)[:, ::-1][:, 1 - LOW : 13 - LOW])  # 1 to 12 and over
    size = np.log1p(n)
    return np.column_stack([total, size, total / np.sqrt(n + 1), np.sign(total) * np.log1p(np.abs(total)), above, above - size[:, None]])


def distinct(texts: list[bytes]) -> list[bytes]:
    """Without near copies of earlier texts: those that share half of 16 least hashes of five-word shingles.

    A text copied many times would make all of its grams look toxic, or ordinary.
    """
    odd = tx.mix(np.arange(1, 17, dtype=np.uint64)) | np.uint64(1)
    seen: list[set[int]] = [set() for _ in odd]
    out = []
    for run in tx.runs(pa.array(texts, pa.large_binary())):
        for i, s in enumerate(tx.shingle_sets(run), run.first):
            least = tx.mix(s[None, :] * odd[:, None]).min(1).tolist() if len(s) else [0] * len(odd)
            if sum(x in known for x, known in zip(least, seen)) * 2 < len(odd):
                out.append(texts[i])
            for x, known in zip(least, seen):
                known.add(x)
    return out


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    import zstandard

    samples = [s for s in samples if s] or [b" "]
    more = max(1, -(-120 * size // sum(map(len, samples))))  # the trainer wants a hundred times the size
    try:
        return zstandard.train_dictionary(size, samples * min(more, 400), k=16, d=GRAM, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples: their bytes are the dictionary
        return b"".join(samples)[-size:]


def _grams(text: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct windows, grams as numbers, the window of each) of a text; a window shorter than a gram is one itself."""
    ws = [b" " + w for w in dict.fromkeys(windows(text))]
    if not ws:
        return ws, np.empty(0, np.uint64), np.empty(0, np.int64)
    sizes = np.array([max(len(w), GRAM) for w in ws])
    data = np.frombuffer(b"".join(w.ljust(GRAM, b"\0") for w in ws), np.uint8).astype(np.uint64)
    codes = np.zeros(len(data) - GRAM + 1, np.uint64)
    for j in range(GRAM):
        codes |= data[j : len(codes) + j] << np.uint64(8 * j)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(ws)), sizes)[: len(codes)]
    inside = np.arange(len(codes)) + GRAM <= ends[owner]
    return ws, codes[inside], owner[inside]


class Classifier:
    """Dictionaries, ratios and weights; small and of fixed size."""

    def __init__(self, toxic: list[bytes], ordinary: list[bytes], min_z: float, share: float = 0.5) -> None:
        """``share``: of toxic ones among all labels."""
        self.weights = None
        if not toxic or not ordinary:
            return
        marks = [_grams(t) for t in toxic]
        known = np.unique(np.concatenate([np.unique(g) for _, g, _ in marks]))
        counts = np.zeros((2, PARTS, len(known)))  # documents that hold a gram of toxic texts, by class and part
        for side, texts in enumerate((toxic, ordinary)):
            for i, t in enumerate(texts):
                own = np.unique(marks[i][1] if side == 0 else _grams(t)[1])
                at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
                if len(known):
                    counts[side, i % PARTS, at[known[at] == own]] += 1

        def dictionaries(without: int | None) -> list[tuple[bytes, bytes]]:
            """Two pairs: what the trainer picks depends on the order of its samples, and the distances of both tell more than one's."""
            stay = [p for p in range(PARTS) if p != without]
            n1, n0 = (max(1, sum(i % PARTS in stay for i in range(len(side)))) for side in (toxic, ordinary))
            x, y = counts[0, stay].sum(0), counts[1, stay].sum(0)
            p = (x + y + 0.5) / (n1 + n0 + 1)
            z = (x / n1 - y / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
            z[x < min(3, n1)] = -np.inf
            level = min(min_z, float(np.sort(z)[-min(len(z), 30)])) if len(z) else min_z  # few labels: the thirty clearest grams
            marked = known[(z >= level) & (z > 0)]
            clear = []
            for i, (ws, grams, owner) in enumerate(marks):
                if i % PARTS in stay:
                    clear.append(b"".join(ws[j] for j in np.unique(owner[np.isin(grams, marked)]).tolist()))
            plain = [b"".join(b" " + w for w in dict.fromkeys(windows(t))) for i, t in enumerate(ordinary) if i % PARTS in stay]
            return [(train_dictionary(clear[::step], TOXIC_BYTES), train_dictionary(plain[::step], ORDINARY_BYTES)) for step in (1, -1)]

        texts = [(t, 1.0, i % PARTS) for i, t in enumerate(toxic)] + [(t, 0.0, i % PARTS) for i, t in enumerate(ordinary)]
        y = np.array([label for _, label, _ in texts])
        found = np.zeros((len(texts), SPAN * LEFT))
        apart = min(len(toxic), len(ordinary)) >= 2 * PARTS  # else there is too little to hold a part back
        for part in range(PARTS if apart else 1):
            distances = Distances(dictionaries(part if apart else None))
            for i, (t, _, own) in enumerate(texts):
                if own == part or not apart:
                    found[i] = distances.counts(t)
        self.pairs = dictionaries(None)
        a, b = found[y == 1].sum(0) + 0.5, found[y == 0].sum(0) + 0.5 * len(ordinary) / len(toxic)
        self.ratio = np.clip(np.log(a / a.sum()) - np.log(b / b.sum()), -1, 6)
        f = features(found, self.ratio)
        self.mean, self.scale = f.mean(0), f.std(0) + 1e-9
        f = np.column_stack([(f - self.mean) / self.scale, np.ones(len(f))])
        w = np.zeros(f.shape[1])
        ridge = np.full(len(w), 1.0)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
            step = np.linalg.solve((f * (p * (1 - p))[:, None]).T @ f + np.diag(ridge), f.T @ (p - y) + ridge * w)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        # the cut at 0.5 goes where the held-back counts give the best F1, the classes weighing as they do among all labels
        odds = f @ w
        order = np.argsort(-odds)
        weight = np.where(y == 1, share / len(toxic), (1 - share) / len(ordinary))[order]
        caught, flagged = np.cumsum(weight * y[order]), np.cumsum(weight)
        best = int(np.argmax(2 * caught / (flagged + share)))
        w[-1] -= odds[order[best]] if best + 1 == len(odds) else (odds[order[best]] + odds[order[best + 1]]) / 2
        self.weights = w

    def scores(self, counts: np.ndarray) -> np.ndarray:
        f = (features(counts, self.ratio) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(f @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _score(model):
    def run_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Classifier = model.value
        if m.weights is not None:
            distances = tx.worker_slot(("toxicity", hash(tuple(m.pairs))), lambda: Distances(m.pairs))
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                part = b.slice(lo, 128)
                if m.weights is None:
                    score = np.zeros(part.num_rows)
                    n = np.array([len(windows((t or "").encode())) for t in part.column(1).to_pylist()], np.int64)
                else:
                    counts = np.array([distances.counts((t or "").encode()) for t in part.column(1).to_pylist()])
                    score, n = m.scores(counts), counts.sum(1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array(n)], names=["doc_id", "score", "n_windows"])

    return run_over


def _texts(docs: DataFrame, picked: DataFrame, max_bytes: int, scratch: Scratch) -> list[bytes]:
    """The texts of the picked documents, in the order of their hashed ids, as far as ``max_bytes`` go (one at least)."""
    own = scratch.stage(docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")), "sample")
    sizes = own.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").collect()  # numbers, at most as many as picked
    ids, held = [], 0
    for r in sizes:
        held += r["n"]
        if ids and held > max_bytes:
            break
        ids.append(r["doc_id"])
    place = {x: i for i, x in enumerate(ids)}
    rows = own.collect() if len(ids) == len(sizes) else own.where(F.col("doc_id").isin(ids)).collect()
    return [(r["text"] or "").encode() for r in sorted(rows, key=lambda r: place[r["doc_id"]])]


def toxicity_scores(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, folds: int = 5, max_toxic: int = 3000, max_ordinary: int = 6000, max_bytes: int = 32 << 20, min_z: float = 5.0
) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_windows), a row for each row of ``docs``."""
    scratch = Scratch(spark, "toxicity")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out)
    sides, totals = [], []
    for toxic, most in ((1, max_toxic), (0, max_ordinary)):
        own = labels.where(F.col("toxic") == toxic)
        picked = own.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # at most so many ids
        sides.append(_texts(docs, picked, max_bytes, scratch))
        totals.append(own.count())
    sides = [distinct(texts) for texts in sides]
    model = Classifier(*sides, min_z=min_z, share=totals[0] / max(1, sum(totals)))
    out = docs.mapInArrow(_score(spark.sparkContext.broadcast(model)), "doc_id long, score double, n_windows long")
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_windows")
