import numpy as np
import pytest

from folioscope.llm import embeddedup
from folioscope.llm.queries import op5_embedding_dedup, op9_exact_topk
from folioscope.llm.topk import CANDIDATES, QUERIES, UNITS, TopK, grid, searched, top_k


def brute(rows, threshold):
    ids = [i for i, _ in rows]
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    parent, links = {i: i for i in ids}, dict.fromkeys(range(len(rows)), 0)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    p, q = root(ids[a]), root(ids[b])
                    parent[max(p, q)] = min(p, q)
    return sorted((i, links[k], root(i), root(i) == i) for k, i in enumerate(ids))


def results(df, key="vec_id"):
    return sorted((r[key], r["n_links"], r["component_id"], r["kept"]) for r in df.collect())


def test_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddedup, "BLOCK", 20)
    rng = np.random.default_rng(5)
    rows, centre = [], rng.normal(size=16)
    for i in range(150):
        v = centre + rng.normal(size=16) * rng.choice([0, 0.02, 0.15, 0.3]) if i % 3 else rng.normal(size=16)
        rows.append((i, [float(x) for x in v]))
    rows += [(200, None), (201, []), (202, [0.0] * 16), (203, [float("nan")] * 16), (204, [None] + [1.0] * 15), (205, [float("inf")] * 16), (206, [1.0, 2.0]), (207, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got, expected = results(embeddedup.near_duplicates(df)), brute(rows, 0.95)
    found = sum(r[1] for r in got)
    assert all(g[1] <= e[1] for g, e in zip(got, expected, strict=True)), "a link below the threshold"
    assert found >= 0.99 * sum(r[1] for r in expected)
    assert [g for g in got if g[0] >= 200] == [e for e in expected if e[0] >= 200]


def test_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=(1500, 64))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    a, b = embeddedup.bucket_keys(x), embeddedup.bucket_keys(0.95 * x + np.sqrt(1 - 0.95**2) * z)
    shared = np.array([bool(set(p) & set(q)) for p, q in zip(a.tolist(), b.tolist(), strict=True)])
    assert shared.mean() >= 0.99


def test_query_equals_brute_force(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert results(op5_embedding_dedup(spark, sf)) == brute(rows, 0.95)


def test_repeated_ids_and_empty_tables(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as n_links", "2 as kept")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddedup.near_duplicates(df).collect()), key=str)
    assert got == [(1, 1, 1), (1, 1, 1), (1, 1, 1), (2, 1, 1), (None, 0, None)]
    assert embeddedup.near_duplicates(df.limit(0)).count() == 0


def expected_top(rows, k, asks):
    out = set()
    for q, v in rows:
        if asks(q) and v is not None:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q and w is not None)
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


def test_top_k_equals_brute_force_with_ties(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [int(x) for x in rng.integers(-3, 4, 6)]) for i in range(300)] + [(i, [1, 2, 3, 0, 0, 0]) for i in range(300, 340)] + [(400, None)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>").repartition(3).selectExpr("*", "7 as score", "8 as rank")
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_k(df, "vec_id % 20 = 0", k=7).collect()}
    assert got == expected_top(rows, 7, lambda i: i % 20 == 0)
    assert top_k(df.limit(0), "true").count() == 0
    few = spark.createDataFrame([(20, [1, 1]), (21, [2, 0]), (22, [0, 0, 1])], "vec_id long, vector array<long>")
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in top_k(few, "vec_id % 20 = 0").collect()] == [(20, 21, 2)]


def test_threshold_algorithm_stops_early():
    rng = np.random.default_rng(3)
    vectors = rng.integers(-2, 3, (4000, 8))
    vectors[:30] *= 60
    search = TopK(np.array([-1]), np.array([[1, 1, 0, 0, 0, 0, 0, 0]]), 5)
    search.search(np.arange(4000), vectors)
    best = np.lexsort((np.arange(4000), -(vectors[:, 0] + vectors[:, 1])))[:5]
    assert search.found[0].tolist() == best.tolist() and search.scored < 100


def test_few_pairs_are_scored_where_dimensions_are_few():
    """Skewed values in few dimensions: the bound bites, and results stay exact."""
    rng = np.random.default_rng(8)
    vectors = (rng.standard_t(2, (20_000, 6)) * 50).astype(np.int64)
    queries = (rng.normal(size=(50, 6)) * 20).astype(np.int64)
    search = TopK(-1 - np.arange(50), queries, 20)
    for part in np.array_split(np.arange(20_000), 3):
        search.search(part, vectors[part])
    scores = queries @ vectors.T
    for q in range(50):
        assert search.found[q].tolist() == np.lexsort((np.arange(20_000), -scores[q]))[:20].tolist()
    assert search.scored < 0.2 * 50 * 20_000


def test_all_pairs_are_scored_where_no_direction_stands_out(spark):
    """Of 64 alike dimensions, lists must be read so deep that they hold every vector: the share that is scored is reported."""
    embeddings = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id", "transform(embedding, x -> floor(64 * double(x))) as vector")
    n, q = embeddings.count(), embeddings.where("vec_id % 20 = 0").count()
    scored = searched(embeddings, "vec_id % 20 = 0", 20).agg({"scored": "sum"}).first()[0]
    assert n * q <= round(scored) <= 2 * n * q


def test_large_scores_are_exact_or_an_error():
    search = TopK(np.array([-1]), np.array([[2**40, 2**20]]), 2)
    search.search(np.array([5, 6]), np.array([[2**20, 0], [2**20, 1]]))
    assert search.found[0].tolist() == [6, 5] and search.scores[0].tolist() == [2**60 + 2**20, 2**60]
    with pytest.raises(ValueError, match="range of long"):
        TopK(np.array([-1]), np.array([[2**40, 0]]), 2).search(np.array([5]), np.array([[2**40, 0]]))


def test_query_rows_of_one_id_ask_each_for_itself(spark):
    df = spark.createDataFrame([(20, [1, 0]), (20, [0, 1]), (20, [0, 1]), (21, [5, 1]), (22, [1, 9])], "vec_id long, vector array<long>")
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in top_k(df, "vec_id % 20 = 0", k=1).collect())
    assert got == [(1, 21, 5), (1, 22, 9), (1, 22, 9)]
    many = spark.createDataFrame([(20, [9, 9])] * 30 + [(i, [i, 0]) for i in range(30, 50)], "vec_id long, vector array<long>")
    assert {(r["rank"], r["vec_id"]) for r in top_k(many, "vec_id = 20", k=3).collect()} == {(1, 49), (2, 48), (3, 47)}


def test_units_are_bounded():
    for n, q in ((0, 0), (1, 1), (51_300, 2_565), (10**6, 50_000), (10**9, 5 * 10**7)):
        blocks, groups = grid(n, q)
        assert q <= blocks * QUERIES and n <= groups * CANDIDATES and blocks * groups <= max(2 * UNITS, 3 * n * q / (QUERIES * CANDIDATES))


def test_top_query_equals_brute_force(spark, sf):
    rows = [(r["vec_id"], np.floor(64 * np.array(r["embedding"], float)).astype(int).tolist()) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = op9_exact_topk(spark, sf)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert {tuple(r) for r in got.collect()} == expected_top(rows, 20, lambda i: i % 20 == 0)
