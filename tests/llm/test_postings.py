import math

import numpy as np
import pytest

from folioscope.llm import postings
from folioscope.llm.queries import op11_ann_postings

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, asks, k):
    good = sorted({(i, tuple(x + 0.0 for x in v)) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    out = []
    for i, v in good:
        if asks(i):
            others = [(float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for j, w in good if j != i and len(w) == len(v)]
            out += [(i, rank, j, s) for rank, (s, j) in enumerate(sorted(others)[:k], 1)]
    return sorted(out)


def results(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def recall(found, expected):
    return len({(r[0], r[2]) for r in found} & {(r[0], r[2]) for r in expected}) / len(expected)


def same(found, expected):
    assert [r[:3] for r in found] == [r[:3] for r in expected]
    assert np.allclose([r[3] for r in found], [r[3] for r in expected], rtol=0, atol=1e-15)


@pytest.fixture
def clustered():
    rng = np.random.default_rng(3)
    rows = []
    for c in range(12):
        centre = rng.normal(size=24)
        rows += [(len(rows) + i, (centre + rng.normal(size=24) * 0.2).tolist(), None) for i in range(100)]
    # a third of all rows are one vector; some ties
    hot = rows[0][1]
    rows += [(2000 + i, hot, None) for i in range(600)] + [(3000 + i, rows[i][1], 1) for i in range(20)]
    return rows


def test_query_has_recall(spark, sf):
    expected = brute([tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()], lambda i: i % 100 == 0, 10)
    found = results(op11_ann_postings(spark, sf))
    assert recall(found, expected) >= 0.9 and len(found) == len(expected)
    scores = {(r[0], r[2]): r[3] for r in expected}
    assert all(abs(scores.get((r[0], r[2]), r[3]) - r[3]) < 1e-14 for r in found)


def test_recall_of_vectors_without_structure(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 64)) + 0.5
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    found = results(postings.approximate_neighbours(df, "vec_id % 100 = 0"))
    asked = np.arange(0, 6000, 100)
    square = postings._squares(x[asked], x)
    square[np.arange(60), asked] = np.inf
    expected = {(int(q), int(j)) for q, near in zip(asked, np.argsort(square, axis=1)[:, :10], strict=True) for j in near}
    assert len({r[:1] + r[2:3] for r in found} & expected) >= 0.9 * len(expected)


def test_clusters_copies_and_ties(spark, clustered, monkeypatch):
    monkeypatch.setattr(postings, "UNIT", 40 * 24)
    monkeypatch.setattr(postings, "QUERIES", 3)
    monkeypatch.setattr(postings, "LIST", 16)
    df = spark.createDataFrame(clustered, SCHEMA).repartition(4)
    expected = brute(clustered, lambda i: i % 10 == 0, 7)
    found = results(postings.approximate_neighbours(df, "vec_id % 10 = 0", k=7))
    assert len(found) == len(expected) and recall(found, expected) >= 0.95
    # a bound beyond every centroid searches all lists
    same(results(postings.approximate_neighbours(df, "vec_id % 10 = 0", k=7, ratio=100.0)), expected)


def test_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(postings, "LIST", 8)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist(), i) for i in range(60)] + [(100 + i, rng.normal(size=4).tolist(), i) for i in range(40)]
    rows += [(200, None, 1), (201, [], 1), (202, [0.0] * 6, 1), (203, [float("nan")] * 6, 1), (204, [None] + [1.0] * 5, 1), (205, [float("inf")] * 6, 1), (None, [1.0] * 6, 1)]
    rows += [(0, rows[0][1], 5), (0, [-0.0] + rows[0][1][1:], 5), (20, rows[1][1], 5), (300, [1.0, 2.0], 1), (310, [5.0], 1), (310, [7.0], 1), (320, [6.0], 1)]
    df = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], SCHEMA + ", node string, ids double").repartition(3)
    same(results(postings.approximate_neighbours(df, "vec_id % 10 = 0", k=5, ratio=100.0)), brute(rows, lambda i: i % 10 == 0, 5))
    assert results(postings.approximate_neighbours(df.limit(0), "vec_id % 10 = 0")) == []
    assert results(postings.approximate_neighbours(df, "vec_id < 0")) == []


def test_few_near_lists_still_give_all_results(spark, monkeypatch):
    monkeypatch.setattr(postings, "LIST", 8)
    rows = [(i, [100.0 * (i % 40) + i / 1000, 1.0]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = results(postings.approximate_neighbours(df, "vec_id % 100 = 0", k=30, ratio=0.0))
    assert len(found) == 4 * 30


def test_cells_are_balanced_and_walks_find_the_nearest():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(3000, 16)), rng.normal(size=(1500, 16)) * 0.01 + 3]).astype(np.float32)
    centroids = postings.cells(x, 70)
    assert len(centroids) == 70
    # a dense third of the vectors gets a third of the cells
    assert 20 <= (np.linalg.norm(centroids - 3, axis=1) < 1).sum() <= 26
    graph = postings.Graph(centroids)
    found = graph.within(x[:500], 0.2)
    square = np.sqrt(postings._squares(x[:500], centroids))
    inside = square <= 1.2 * square.min(axis=1, keepdims=True)
    assert (np.isfinite(found) & inside).sum() >= 0.99 * inside.sum()
    assert (found.argmin(axis=1) == square.argmin(axis=1)).mean() >= 0.99
