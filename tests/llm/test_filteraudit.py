import collections
import itertools
import re

import pyarrow as pa
import pytest

from folioscope.llm import filteraudit
from folioscope.llm.queries import op13_filter_audit

COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def brute(docs, labels):
    """All orders, walked through document by document."""
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    told = collections.defaultdict(set)
    for i, quality, toxic in labels:
        told[i] |= ({"good"} if quality == 1 else set()) | ({"toxic"} if toxic == 1 else set())
    parts = collections.defaultdict(list)
    for i, text, source in docs:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        fails = (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), re.search("[#$%&*|]", text), i is not None and first[text] < i)
        parts[source or ""].append(({f for f, bad in zip("ABCDE", fails, strict=True) if bad}, told[i] if i is not None else set()))
    out = []
    for part, rows in parts.items():
        shapley, own = collections.Counter(), []
        for order in itertools.permutations("ABCDE"):
            here = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in here if f in r[0]]
                here_ids = set(map(id, here))
                shapley[f] += len(gone)
                redundant = sum(f in r[0] and id(r) not in here_ids for r in rows)
                own.append((f, (part, "".join(order), step, len(here) - len(gone), len(gone), redundant, sum(r[0] == {f} for r in rows), sum("good" in r[1] for r in gone), sum("toxic" in r[1] for r in gone))))
                here = [r for r in here if f not in r[0]]
        out += [(*row, shapley[f]) for f, row in own]
    return sorted(out)


def results(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect())


def plain(docs):
    return [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]


def test_query_equals_brute_force(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    assert results(op13_filter_audit(spark, sf)) == brute(plain(docs), [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0, "x"), (1, 0, 1, "y"), (2, None, 1, "z"), (None, 1, 1, None), (99, 1, 1, None)], "doc_id long, quality int, toxic int, text string")
    assert results(filteraudit.audit(odd, labels)) == brute(plain(odd), [(1, 1, 0), (1, 0, 1), (2, None, 1)])
    assert results(filteraudit.audit(odd, labels.limit(0))) == brute(plain(odd), [])
    assert results(filteraudit.audit(none, labels)) == []


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_copies_over_many_ranges(spark, partitions):
    texts = ["one hot text", "another", "", None, "Third One #"]
    rows = [(i // 2 if i % 7 == 0 else i, texts[0 if i % 3 else i % 5], f"s{i % 4}") for i in range(600)]
    rows += [(None, "one hot text", "s0")] * 3 + [(5, "one hot text", "s1")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = results(filteraudit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert found == brute(rows, [])


def test_colliding_prints_are_told_apart():
    follow = filteraudit.Runs()
    import numpy as np

    rows = [(1, b"a", 3), (1, b"a", 4), (1, b"b", 1), (1, b"b", 1), (1, b"b", 2), (2, b"b", 9), (2, b"c", 2)]
    fresh, repeated, in_first = [], [], []
    for part in (rows[:1], rows[1:4], rows[4:5], rows[5:]):
        for out, got in zip((fresh, repeated, in_first), follow.take(np.array([r[0] for r in part]), pa.array([r[1] for r in part], pa.binary()), np.array([r[2] for r in part])), strict=True):
            out += got.tolist()
    assert fresh == [True, False, True, False, False, True, True]
    assert repeated == [False, True, False, False, True, False, False]
    assert in_first == [True] * 5 + [False] * 2
    assert follow.heads == [(b"b", 9), (b"c", 2)]
