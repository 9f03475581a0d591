import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from folioscope.llm import mixing
from folioscope.llm.queries import op10_source_mixing


def tempered(shares, exponent):
    raised = {s: p**exponent for s, p in shares.items() if p > 0}
    return {s: r / math.fsum(raised.values()) for s, r in raised.items()}


def entropy(weights):
    return -math.fsum(w * math.log(w) for w in weights.values())


def planned(spark, tokens, **target):
    """Goals by source, and the exponent that gave them."""
    totals = spark.createDataFrame([(s, n, 1) for s, n in tokens.items()], "source string, have long, n long")
    args = {"budget": None, "target_entropy": None, "max_repeats": None, **target}
    total = sum(tokens.values())
    shares = totals.selectExpr(f"have / {float(total)} as share")
    of = mixing.Shares(min(tokens.values()) / total, max(tokens.values()) / total, total)
    return {r["source"]: r["goal"] for r in mixing.plan(totals, **args).collect()}, mixing.exponent_for(shares, of, **args)


def test_exponent_meets_the_target(spark):
    tokens = {"a": 8000, "b": 1000, "c": 1000}
    shares = {s: n / 10_000 for s, n in tokens.items()}
    goals, a = planned(spark, tokens, budget=10_000.0, target_entropy=0.9)
    assert abs(entropy(tempered(shares, a)) - 0.9) < 1e-9 and abs(sum(goals.values()) - 10_000) < 1e-6
    goals, _ = planned(spark, tokens, budget=10_000.0, max_repeats=1.5)
    assert abs(max(goals[s] / tokens[s] for s in tokens) - 1.5) < 1e-9
    goals, a = planned(spark, tokens, max_repeats=2.0)
    assert abs(goals["a"] - 8000) < 1e-6 and abs(goals["b"] - 2000) < 1e-6 and abs(goals["a"] / goals["b"] - 8**a) < 1e-6
    assert planned(spark, tokens, budget=10_000.0, target_entropy=math.log(3) + 1)[1] == 0.0
    assert mixing.plan(spark.createDataFrame([], "source string, have long, n long"), None, None, 1.0).count() == 0


def passes(rows):
    out = defaultdict(lambda: defaultdict(list))
    for r in rows:
        out[r["source"]][r["mix_pass"]].append((r["mix_end"], r["mix_tokens"], r["doc_id"]))
    return out


@pytest.mark.parametrize("bucket_rows", [3, 2000])
def test_budgets_and_passes(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
    rows = [(i, "big" if i % 4 else "small", 1 + i % 7) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, source string, words long")
    budget = 1600.0
    got = passes(mixing.mix(df, F.col("words"), budget=budget, max_repeats=3.0).collect())
    have = {s: sum(w for _, x, w in rows if x == s) for s in ("big", "small")}
    # bisection by plain arithmetic
    low, high = 0.0, 1.0
    shares = {s: n / sum(have.values()) for s, n in have.items()}
    repeats = lambda a: max(budget * w / have[s] for s, w in tempered(shares, a).items())
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if repeats(middle) <= 3.0 else (middle, high)
    weights = tempered(shares, 0.0 if repeats(0.0) <= 3.0 else high)
    for source, total in have.items():
        ids = {i for i, s, _ in rows if s == source}
        goal, spent = budget * weights[source], 0
        whole = int(goal // total + 1e-9)
        for number, taken in sorted(got[source].items()):
            taken.sort()
            at = 0
            for end, words, _ in taken:
                at += words
                assert end == at, "running sums follow the permutation"
            spent += at
            chosen = {i for *_, i in taken}
            assert len(chosen) == len(taken) and (chosen == ids if number < whole else chosen <= ids)
        assert goal - 7 <= spent <= goal + 1e-6 * goal


def test_orders_differ_between_passes_and_are_stable(spark):
    df = spark.createDataFrame([(i, "a", 1) for i in range(50)], "doc_id long, source string, words long")
    run = lambda n: passes(mixing.mix(df.repartition(n), F.col("words"), budget=100.0, max_repeats=2.0).collect())["a"]
    first, second = run(1), run(7)
    assert {k: sorted(v) for k, v in first.items()} == {k: sorted(v) for k, v in second.items()}
    assert [x[2] for x in sorted(first[0])] != [x[2] for x in sorted(first[1])]


def test_odd_rows(odd, none):
    rows = mixing.mix(odd.withColumn("mix_pass", F.lit("clash")), mixing.word_count(F.col("text")), max_repeats=2.0).collect()
    assert {r["doc_id"] for r in rows} == {1, 2, 3, 4, 5, 6, 7, 8, None}
    assert sum(r["doc_id"] == 2 and r["mix_pass"] == 0 for r in rows) == 2
    assert mixing.mix(none, mixing.word_count(F.col("text"))).count() == 0


def test_internal_names_may_clash(spark):
    names = ("own", "id", "have", "goal", "buckets", "whole", "left", "key", "bucket", "held", "before", "n", "_source", "_goal")
    df = spark.createDataFrame([(i, "a" if i % 3 else "b", 2, *("x",) * len(names)) for i in range(30)], "doc_id long, source string, words long, " + ", ".join(f"{n} string" for n in names))
    rows = mixing.mix(df, F.col("words"), max_repeats=1.0).collect()
    assert len(rows) == 30 and all(r[n] == "x" for r in rows for n in names) and rows[0].asDict().keys() == {*df.columns, "mix_tokens", "mix_pass", "mix_end"}


def brute(documents):
    """(id, source, tokens, pass, end) of every row that the query's mixture takes, by plain Python: budgets, orders and running sums."""
    keys = [F.xxhash64("doc_id", F.lit(0), F.lit(k)).alias(f"k{k}") for k in range(3)]
    documents = documents.select("doc_id", "source", "text", *keys).collect()
    words = {r["doc_id"]: len(re.findall(r"[^ \t\n\x0b\f\r]+", r["text"] or "")) for r in documents}
    by_source = defaultdict(list)
    for r in documents:
        by_source[r["source"]].append(r)
    have = {s: sum(words[r["doc_id"]] for r in rows) for s, rows in by_source.items()}
    most, least = max(have.values()), min(n for n in have.values() if n)
    exponent = 0.0 if most / least <= 2 else 1 - math.log(2) / math.log(most / least)
    expected = set()
    for s, rows in by_source.items():
        goal = most * (have[s] / most) ** exponent
        whole = int(goal / have[s] + 1e-9)
        left = max(0.0, goal - whole * have[s])
        buckets = max(1, math.ceil(len(rows) / mixing.BUCKET_ROWS))
        for number in range(whole + (left > 1e-6)):
            key = f"k{number}"
            at = 0
            for r in sorted(rows, key=lambda r: ((r[key] % 2**64 >> 20) % buckets, r[key], r["doc_id"])):
                at += words[r["doc_id"]]
                if number < whole or at <= left:
                    expected.add((r["doc_id"], s, words[r["doc_id"]], number, at))
    return expected


def test_whole_query_equals_brute_force(spark, sf):
    got = [(r["doc_id"], r["source"], r["mix_tokens"], r["mix_pass"], r["mix_end"]) for r in op10_source_mixing(spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(spark.read.parquet(f"{sf}/documents.parquet"))


def test_query_keeps_every_document(spark, sf):
    rows = op10_source_mixing(spark, sf).collect()
    first = [r["doc_id"] for r in rows if r["mix_pass"] == 0]
    assert len(first) == len(set(first)) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert {r["mix_pass"] for r in rows} <= {0, 1, 2}
