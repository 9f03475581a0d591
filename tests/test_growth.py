"""What steps make of rows grows with the input: no pairs, no texts in several shuffles, no expression anew a use."""

import random

from pyspark.sql import functions as F

from folioscope.functions import exact, text
from folioscope.operators import catalog, components, textindex, venues
from folioscope.plans import load_queries


def most_rows(df):
    """The most rows that an operator of the plan gave."""
    df.collect()

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        told = node.metrics().get("numOutputRows")
        children = [node.children().apply(i) for i in range(node.children().size())]
        return max([told.get().value() if told.isDefined() else 0, *map(walk, children)])

    return walk(df._jdf.queryExecution().executedPlan())


VENUES, RECORDS = "venue_id long, source_id string, issn_l string, issn string, eissn string", "record long, kind string, name string, source_id string, issns array<string>"


def test_venues_of_shared_keys_make_no_pairs(spark):
    known = spark.createDataFrame([(k, "S", f"I{k % 3}", None, None) for k in range(400)], VENUES)
    asked = spark.createDataFrame([(k, "journal", "n", "S", ["i0", " i9"]) for k in range(400)], RECORDS)
    found = venues.resolved(asked, known)
    assert {tuple(r) for r in found.select("matches", "venue_id", "resolution").collect()} == {(400, None, "conflict")}
    assert most_rows(found) < 10_000


def test_venues_equal_brute_force(spark):
    pick = random.Random(7)
    some = lambda n: pick.choice([None, *(f"K{i}" for i in range(n))])
    known = [(k // 2 if k < 10 else k, some(12), some(12), some(12), some(12)) for k in range(40)]
    asked = [(k, pick.choice(["journal", "blog"]), pick.choice(["n", " "]), some(14), pick.choice([None, [], [some(14) for _ in range(pick.choice([1, 2, 3, 13]))]])) for k in range(120)]
    expected = set()
    for record, kind, name, source, issns in asked:
        wanted = {x for x in issns or [] if x}
        met = {v[0] for v in known if (source and v[1] == source) or wanted & {x for x in v[2:] if x}}
        skipped = kind == "blog" or name == " "
        told = "skip" if skipped else {0: "insert", 1: "reuse"}.get(len(met), "conflict")
        expected.add((record, len(met), min(met) if len(met) == 1 and not skipped else None, told))
    found = venues.resolved(spark.createDataFrame(asked, RECORDS), spark.createDataFrame(known, VENUES))
    assert {tuple(r) for r in found.collect()} == expected


def test_an_index_shuffles_no_posting(spark, tmp_path):
    rows = [(f"k{i}", " ".join(f"w{(i * 7 + j) % 50}s" for j in range(40))) for i in range(50)] + [("empty", ""), ("stop", "the of"), ("none", None)]
    index = textindex.Index(spark, str(tmp_path / "i"), buckets=4)
    tracker, group = spark.sparkContext.statusTracker(), "index"
    spark.sparkContext.setJobGroup(group, group)
    try:
        index.write(spark.createDataFrame(rows, "key string, text string").repartition(2).localCheckpoint(), "key", "text")
        jobs = tracker.getJobIdsForGroup(group)
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    # the postings are written by the stage that reads the texts, whose job has no other
    folders = spark.read.parquet(f"{index.folder}/postings")
    assert folders.where("word <> ''").count() == 2000 and min(len(tracker.getJobInfo(j).stageIds) for j in sorted(jobs)[1:]) == 1
    assert {tuple(r) for r in folders.where("bucket = -1").select("key", "place").collect()} == {*((f"k{i}", 40) for i in range(50)), ("empty", 0), ("stop", 0)}
    assert {r["key"] for r in index.search("-w1s").collect()} >= {"empty", "stop"} and index.search("absent").count() == 0
    assert index.search("w3s").count() == 40
    assert most_rows(index.postings(["w3s"])) < 2000


def test_a_centre_of_a_component_is_dealt_over_tasks(spark):
    rows = spark.range(4000).selectExpr("case when id < 3000 then 0L else id end as u", "id + 5 as v")
    found = components.with_least(rows, 8, components.hot_keys(rows, 500))
    assert found.where("m <> case when u = 0 then 5 else v end").count() == 0 and found.count() == 4000
    assert found.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 1000


def test_edges_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(components, "TASK_EDGES", 100)
    monkeypatch.setattr(components, "HOT_ROWS", 50)
    edges = spark.range(2000).selectExpr("id % 7 as a", "id + 7 as b").union(spark.range(300).selectExpr("id + 5000 as a", "id + 5001 as b"))
    found = components.connected_components(edges)
    assert {tuple(r) for r in found.collect()} == {*((k, k % 7) for k in range(7)), *((k + 7, k % 7) for k in range(2000)), *((k + 5000, 5000) for k in range(301))}


def test_a_decimal_is_read_once_for_its_order(spark):
    plan = spark.range(1).select(exact.decimal_order(F.col("id").cast("string")).alias("o"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("cast(id") == 1


def test_an_inverted_index_shuffles_no_word(spark, sf):
    plan = load_queries()[0]["inverted_index_text"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_an_inverted_index_equals_brute_force(spark):
    pick = random.Random(3)
    lists = [None, [], ["a"], *([pick.choice(["a", "b", "B", "é", "", "\U0001f600"]) for _ in range(pick.randint(0, 30))] for _ in range(60))]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(lists)], "i int, w array<string>")
    index = text.inverted_index(F.col("w"))
    for r in df.select("i", index.alias("x"), text.inverted_index_text(index).alias("t")).collect():
        words = lists[r["i"]]
        assert r["x"] == (None if words is None else {w: [k for k, v in enumerate(words) if v == w] for w in words})
        assert r["t"] == (None if words is None else " ".join(words))


def test_abstracts_of_a_small_file_are_read_in_several_tasks(spark, sf):
    rows = load_queries()[0]["markup_text"](spark, sf)
    tasks = rows.groupBy(F.spark_partition_id()).count()
    assert tasks.count() > spark.sparkContext.defaultParallelism and tasks.agg(F.max("count")).first()[0] < rows.count() / 4


def test_titles_of_bulk_files_derive_no_other_field(spark, sf):
    plan = load_queries()[0]["pubmed_file_revisions"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "institutions" not in plan and "identifiers" not in plan


def test_a_part_of_a_date_is_read_once(spark):
    parts = [F.col("id").cast("string") for _ in range(3)] + [F.lit(None).cast("string")] * 2
    plan = spark.range(1).select(text.bibliographic_date(*parts)["at"].alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("cast(id") == 3


def test_pairs_of_a_facet_are_dealt_by_their_number(spark, sf, monkeypatch):
    monkeypatch.setattr(catalog, "TASK_PAIRS", 100)
    rows = [(i % 700, f"t{i % 13}" if i % 5 else None) for i in range(3000)] + [(1, "t1")] * 50 + [(None, "t1")]
    facet = catalog.pair_facet(spark.createDataFrame(rows, "paper long, key string"), spark.range(0, 2000, 3).withColumnRenamed("id", "paper"), "paper", "key")
    papers = {}
    for paper, key in rows:
        if paper is not None and paper % 3 == 0:
            papers.setdefault(key, set()).add(paper)
    assert {tuple(r) for r in facet.collect()} == {(k, len(v)) for k, v in papers.items()}
    assert "hashpartitioning(paper" in (plan := facet._jdf.queryExecution().executedPlan().toString()) and ", 31), REPARTITION_BY_NUM" in plan
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    for name in ("facet_array_topics", "facet_array_sources"):
        plan = load_queries()[0][name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert f", {-(-lines // 100)}), REPARTITION_BY_NUM" in plan
