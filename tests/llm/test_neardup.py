from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import pytest

from docweave.llm.graph import components, forest
from docweave.llm.jaccard import BLOCK_NODES, jaccard_components
from docweave.llm.neardup import embedding_components
from docweave.llm.scratch import Scratch

from .common import clashing, edge_rows, frame, lower, prose, repeated_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORD.findall(lower(t or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, percent=80):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), math.inf), r[0])
    return sorted(((r[0], len(sets[i]), least.get(find(i)), links[i]) for i, r in enumerate(rows)), key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "n_links").collect()), key=str)


@pytest.mark.parametrize("rows", [edge_rows(), repeated_rows()])
def test_jaccard_edges(spark, rows):
    assert result(jaccard_components(spark, clashing(frame(spark, rows)))) == brute(rows)


def test_jaccard_cloud_over_many_blocks(spark):
    """A cloud of near copies larger than a block, hot passages, and a chain at the threshold."""
    import random

    r, rows = random.Random(3), []
    base, passage = prose(50, 60).split(), prose(51, 40)
    for i in range(BLOCK_NODES + 60):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = f"e{r.randint(0, 9)}"
        rows.append((i, " ".join(w), "en", "s", 1))
    rows += [(10_000 + i, prose(100 + i, 60) + " " + passage, "en", "s", 1) for i in range(60)]
    assert result(jaccard_components(spark, frame(spark, rows))) == brute(rows)


def test_jaccard_empty_table(spark):
    assert jaccard_components(spark, frame(spark, [])).collect() == []


def test_forest_and_components(spark):
    assert sorted(forest([(5, 3), (3, 9), (7, 8)])) == [(5, 3), (8, 7), (9, 3)]
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2))] + [(i, i + 1) for i in range(1000, 1200)]
    want = {}
    for node, root in forest([e for e in edges if e[0] != e[1]]):
        want[node] = root
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long").repartition(7), Scratch(spark, "t")).collect()}
    assert {k: v for k, v in got.items() if k != v} == want


def brute_vectors(rows, threshold=0.98):
    def unit(v):
        if v is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, float)
        return x / np.sqrt((x * x).sum())

    units = [unit(r[1]) if r[2] is not None else None for r in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and float(units[i] @ units[j]) >= threshold:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = defaultdict(lambda: math.inf)
    for i, r in enumerate(rows):
        least[find(i)] = min(least[find(i)], r[0])
    return sorted((r[0], links[i], least[find(i)], r[0] == least[find(i)]) for i, r in enumerate(rows))


def test_embeddings(spark):
    rng, rows = np.random.default_rng(1), []
    for c in range(12):
        centre = rng.standard_normal(16)
        for _ in range(25 if c else 300):
            rows.append((len(rows), (centre + 0.08 * rng.standard_normal(16)).tolist(), c % 3))
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [None] + [1.0] * 15, 1), (n + 4, rows[0][1], None), (n + 5, rows[0][1], 0), (n + 6, [2 * x for x in rows[0][1]], 0), (n + 7, [1.0, 2.0], 0), (n + 8, [1.0, 2.0], 0), (n + 9, [], 2)]
    rows += [rows[3]]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3))
    got = sorted(tuple(r) for r in embedding_components(spark, df).collect())
    assert got == brute_vectors(rows)


def test_embeddings_empty(spark):
    assert embedding_components(spark, spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def _cloud(rng, n, dim, cosine):
    """Unit vectors around one direction, of mean cosine ``cosine`` to each other."""
    centre = rng.standard_normal(dim)
    centre /= np.linalg.norm(centre)
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = np.sqrt(cosine) * centre + np.sqrt(1 - cosine) * x
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _recall(spark, folder, x, labels, **options):
    """Share of the exact links that were found, and whether no count is too high."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float64())), "label": pa.array(labels)}), f"{folder}/e.parquet", row_group_size=4000)
    got = np.zeros(len(x), np.int64)
    for r in embedding_components(spark, spark.read.parquet(f"{folder}/e.parquet"), **options).select("vec_id", "n_links").toLocalIterator():
        got[r["vec_id"]] = r["n_links"]
    want = np.zeros(len(x), np.int64)
    labels = np.array(labels)
    for label in np.unique(labels):
        at = np.flatnonzero(labels == label)
        for lo in range(0, len(at), 1000):
            want[at[lo : lo + 1000]] = (x[at[lo : lo + 1000]] @ x[at].T >= 0.98).sum(1) - 1
    assert (got <= want).all() and want.sum() > 0
    return got.sum() / want.sum()


@pytest.mark.parametrize("cosine", [0.0, 0.9, 0.96])
def test_embeddings_recall_in_a_dense_cloud(spark, tmp_path, cosine):
    rng = np.random.default_rng(7)
    x = _cloud(rng, 20_000, 64, cosine)
    near = x[:500] + 0.02 * rng.standard_normal((500, 64))
    x = np.concatenate([x, near / np.linalg.norm(near, axis=1, keepdims=True)])
    assert _recall(spark, tmp_path, x, [3] * len(x)) >= 0.99


def test_embeddings_recall_in_several_clouds_and_a_clique(spark, tmp_path):
    """One hot label of four close clouds and a large group of near copies, small labels beside it, and narrow windows to begin with."""
    rng = np.random.default_rng(8)
    parts = [_cloud(rng, 800, 32, 0.95) for _ in range(4)] + [_cloud(rng, 700, 32, 0.995)] + [_cloud(rng, 12, 32, 0.97) for _ in range(20)]
    labels = [0] * 3900 + [1 + i // 12 for i in range(240)]
    assert _recall(spark, tmp_path, np.concatenate(parts), labels, passes=4, window=8, sample=400) >= 0.99


def test_embeddings_no_link_rests_on_the_sample(spark, tmp_path, monkeypatch):
    """One pass, a narrow window and a sample of one node, which tells nothing: the exact check finds every link, over many blocks."""
    import docweave.llm.neardup as neardup

    monkeypatch.setattr(neardup, "BLOCK_BYTES", 100_000)
    rng = np.random.default_rng(9)
    x = _cloud(rng, 1500, 32, 0.9)
    near = x[:300] + 0.02 * rng.standard_normal((300, 32))
    x = np.concatenate([x, near / np.linalg.norm(near, axis=1, keepdims=True)])
    assert _recall(spark, tmp_path, x, [i % 2 for i in range(1500)] + [i % 2 for i in range(300)], passes=1, window=1, sample=1) == 1.0
