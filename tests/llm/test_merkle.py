import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from folioscope.llm import merkle
from folioscope.llm.queries import op12_merkle_manifest

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def of_row(row):
    texts = [None if v is None else str(v) for v in row]
    return h(*("-" if t is None else f"{len(t.encode())}:{t}" for t in texts))


def climbed(nodes):
    """The root, and the siblings on each leaf's way to it."""
    siblings, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(place):
            run = range(p - p % 3, min(p - p % 3 + 3, len(nodes)))
            siblings[k].append(([nodes[i] for i in run if i < p], [nodes[i] for i in run if i > p]))
            place[k] = p // 3
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return (nodes or [None])[0], siblings


def brute(rows):
    sources = {}
    for row in rows:
        sources.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, of_row(row), row))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = [climbed([x[2] for x in sorted(sources[s], key=lambda x: x[:3])]) for s in order]
    root, upper = climbed([t[0] for t in trees])
    out = []
    for k, s in enumerate(order):
        for (_, _, leaf, row), path in zip(sorted(sources[s], key=lambda x: x[:3]), trees[k][1], strict=True):
            whole = [*path, *upper[k]]
            folded = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                folded = of_row((*row[:4], row[4].replace("\n", "")))
            for before, after in whole:
                folded = h(*before, folded, *after)
            out.append((row[0], leaf, trees[k][0], root, h(*(x for b, a in whole for x in (*b, *a))), folded, folded == root))
    return sorted(out, key=str)


def results(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def tampered(docs):
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return merkle.manifest(docs, tampered={"text": F.when(even, F.regexp_replace("text", "\n", "")).otherwise(F.col("text"))})


@pytest.fixture
def partitions(spark):
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    kept = {k: spark.conf.get(k) for k in names}
    spark.conf.set(names[1], "false")
    yield lambda n: spark.conf.set(names[0], str(n))
    for k, v in kept.items():
        spark.conf.set(k, v)


def test_query_equals_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*COLUMNS).collect()]
    found = results(op12_merkle_manifest(spark, sf))
    assert found == brute(docs)
    assert {r[-1] for r in found} == {True, False}


def test_odd_rows(spark, odd, none):
    assert results(tampered(odd)) == brute([tuple(r) for r in odd.select(*COLUMNS).collect()])
    assert results(tampered(none)) == []
    lone = odd.where("doc_id = 1")
    (row,) = results(tampered(lone))
    assert row[1] == row[2] == row[3] == row[5] and row[4] == h() and row[6]


@pytest.mark.parametrize("ranges", [1, 5, 37])
def test_many_ranges_and_sources(spark, partitions, ranges):
    rng = random.Random(ranges)
    sources = ["hot"] * 20 + [None, "", "é", "z", "\U0001f600", "￿", *map(str, range(30))]
    rows = [(rng.choice([i, i // 2, None]), rng.choice(sources), rng.choice(["en", None]), rng.choice([i, None]), rng.choice(["a\nb", "", None, f"text {i}\n"])) for i in range(700)]
    rows += [(9, "hot", None, None, "again\n")] * 60
    partitions(ranges)
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    assert results(tampered(docs)) == brute(rows)


def test_one_source_over_all_ranges_and_every_row_its_own(spark, partitions):
    partitions(20)
    for rows in ([(i, "s", "en", i, f"{i}\n") for i in range(244)], [(i, f"s{i:03}", "en", i, f"{i}\n") for i in range(244)]):
        assert results(tampered(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"))) == brute(rows)


@pytest.mark.parametrize("seed", range(20))
def test_forests_merge_in_any_grouping(seed):
    rng = random.Random(seed)
    widths = [rng.randint(1, 40) for _ in range(rng.randint(1, 12))]
    leaves = [(t, i, h(f"{t} {i}").encode()) for t, w in enumerate(widths) for i in range(w)]
    expected = climbed([climbed([d.decode() for t, _, d in leaves if t == tree])[0] for tree in range(len(widths))])[0]
    rng.shuffle(leaves)
    forests = []
    for a in range(0, len(leaves), 7):
        forest = merkle.Forest(len(widths))
        forest.width |= dict(enumerate(widths))
        for t, i, d in leaves[a : a + 7]:
            forest.add(t, 0, i, d)
        forests.append(forest)
    while len(forests) > 1:
        one = forests.pop(rng.randrange(len(forests)))
        forests[rng.randrange(len(forests))].merge(one)
    (last,) = forests[0].nodes.items()
    assert last[0][0] == merkle.TOP and last[1].decode() == expected


def test_a_range_leaves_few_nodes():
    span = merkle.Span(100_001, [b"x"] * 50_000, 10**6)
    assert sum(1 for _ in span.unresolved()) <= 4 * len(span.levels)
    assert sum(1 for _ in span.missing()) <= 6 * len(span.levels)
