import gzip
import hashlib
import os
import threading

import pytest
from pyspark.sql import functions as F

from folioscope.functions import identifiers
from folioscope.operators import policies
from folioscope.plans import incremental, roles
from folioscope.sources.bulk import Checkpoint, Ledger, Refused
from folioscope.sources.keyed_log import KeyedLog
from folioscope.streaming.state_stream import follow

ORDER = ("source_time", "tie_break_key", "position", "event_id")


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def test_stream_equals_batch_and_survives_replays(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    for k in range(3):
        events.where(F.col("event_id") % 3 == 2 - k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = roles.as_source_events(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    states = KeyedLog(spark, str(tmp_path / "state"), ["event_key"])
    failures = follow(stream, states, str(tmp_path / "ck"), [lambda d, i: 1 / 0 if i == 1 else None])
    assert len(failures) == 1 and states.segments() == [(0, 0), (1, 1), (2, 2)]
    expected = {tuple(r) for r in roles.source_events(spark, sf).groupBy("event_key").agg(F.max_by("event_id", F.struct(*ORDER))).collect()}
    got = lambda: {(r["event_key"], r["event_id"]) for r in states.read().collect()}
    assert got() == expected
    assert not states.append(roles.source_events(spark, sf).where("event_id % 3 = 0"), 2)
    assert got() == expected


def test_a_batch_writes_in_proportion_to_itself(spark, tmp_path):
    """Ten times the state, the same bytes a batch; compactions add a logarithm."""

    def batch(first, keys):
        return spark.range(first, first + keys).select(F.col("id").alias("k"), F.lit(first).cast("long").alias("at"), F.sha2(F.col("id").cast("string"), 256).alias("v"))

    written = {}
    for rows in (2_000, 20_000):
        log = KeyedLog(spark, str(tmp_path / str(rows)), ["k"], ("at",), fan=4)
        log.append(batch(0, rows), 0)
        start = size(log.folder)
        for n in range(1, 4):
            log.append(batch(rows * 7 + n * 50, 100), n)
        written[rows] = size(log.folder) - start
    assert written[20_000] <= 1.1 * written[2_000]


def test_compaction_keeps_the_rows(spark, tmp_path):
    log = KeyedLog(spark, str(tmp_path / "log"), ["k"], ("at",), fan=3)
    expected = {}
    for n in range(11):
        rows = [(k, n, f"{k} at {n}") for k in range(n % 4, 20, 3)]
        expected |= {k: v for k, _, v in rows}
        assert log.append(spark.createDataFrame(rows, "k long, at long, v string"), n)
        log.compact()
        if n == 5:
            # what was written but not finished is no segment
            os.makedirs(tmp_path / "log/seg=6-6")
    assert log.segments() == [(0, 8), (9, 9), (10, 10)]
    assert {r["k"]: r["v"] for r in log.read().collect()} == expected
    assert {r["k"] for r in log.read(upto=9).collect()} == set(expected) and log.covers(4)
    assert not log.append(spark.createDataFrame([(0, 99, "again")], "k long, at long, v string"), 4)
    assert KeyedLog(spark, str(tmp_path / "none"), ["k"]).read() is None


def told(spark, rows):
    """Events (event_id, key, kind, hour, work, doi)."""
    base = spark.createDataFrame(rows, "event_id long, event_key string, event_kind string, hour int, work_id long, doi string")
    fields = incremental.demonstration_record(F.col("event_key"), F.col("event_id"), F.col("event_id").cast("double"), F.col("event_kind"))
    return base.select("event_id", "event_key", "event_kind", F.timestamp_seconds(F.col("hour") * 3600).alias("source_time"), F.lit("t").alias("tie_break_key"), F.lit(1).cast("long").alias("position"), F.lit("s").alias("source"), "work_id", "doi", *(v.alias(n) for n, v in fields.items()))


def test_a_batch_derives_the_works_that_it_touches(spark, tmp_path):
    policy = policies.controlled_identity("v1", {"doi": identifiers.doi(F.col("doi"))})
    held = incremental.Catalog(spark, str(tmp_path / "c"), policy, "p1")
    doi = "10.4321/x"
    first = [(k, f"k{k}", "upsert", 1, k % 10, doi) for k in range(40)]
    assert held.apply(told(spark, first), 1) == {"records": 40, "works": 10}
    works = lambda: {r["work_id"]: r["winner"] for r in held.table("works").collect()}
    assert works() == {k: f"k{k + 30}" for k in range(10)}
    # late, moved (two works), deleted, excluded and new records; the rest of the works is left alone
    second = [(100, "k30", "upsert", 0, 7, doi), (101, "k31", "upsert", 2, 2, doi), (102, "k33", "delete", 2, None, doi), (103, "k34", "upsert", 2, 4, None), (104, "new", "upsert", 1, 90, doi)]
    assert held.apply(told(spark, second), 2) == {"records": 4, "works": 5}
    assert works() == {**{k: f"k{k + 30}" for k in range(10)}, 1: "k21", 2: "k31", 3: "k23", 4: "k24", 90: "new"}
    authors = {(r["work_id"], r["name"]) for r in held.table("authors").collect()}
    assert (2, "k31") in authors and (2, "k32") not in authors and len(authors) == 22
    touched = {n: {r[0] for r in spark.read.parquet(f"{held.folder}/{n}/seg=2-2").select("work_id").collect()} for n in ("works", "authors", "topics", "assertions")}
    assert all(t == {1, 2, 3, 4, 90} for t in touched.values())
    before = {n: sorted(map(str, held.table(n).collect())) for n in ("states", "works", "authors", "metrics")}
    assert held.apply(told(spark, second), 2) is None
    # a replay under a new number changes no record
    assert held.apply(told(spark, second), 3) == {"records": 0, "works": 0}
    assert {n: sorted(map(str, held.table(n).collect())) for n in before} == before
    with pytest.raises(ValueError):
        held.apply(told(spark, second), 9)
    # all records of a work leave it
    assert held.apply(told(spark, [(200, "new", "delete", 5, None, None)]), 4) == {"records": 1, "works": 1}
    assert 90 not in works() and not held.table("authors").where("work_id = 90").collect()


def test_a_batch_without_its_commit_counts_for_nothing(spark, tmp_path):
    policy = policies.controlled_identity("v1", {"doi": identifiers.doi(F.col("doi"))})
    held = incremental.Catalog(spark, str(tmp_path / "c"), policy, "p1")
    held.apply(told(spark, [(1, "a", "upsert", 1, 1, "10.4321/x")]), 1)
    held._write(held.works, spark.createDataFrame([(1, "wrong", 9, False)], "work_id long, winner string, event_id long, gone boolean"), 2)
    assert [r["winner"] for r in held.table("works").collect()] == ["a"]
    held.apply(told(spark, [(2, "b", "upsert", 2, 1, "10.4321/x")]), 2)
    assert [r["winner"] for r in held.table("works").collect()] == ["b"]


def test_decisions_that_are_new_are_computed_once(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "event_id long, scope_policy string, status string, reason string, evidence string")
    new = policies.new_decisions(rows((1, "v", "included", "r", None)), rows((1, "v", "included", "r", None), (2, "v", "excluded", "r", None), (2, "v", "excluded", "r", None)))
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in new.collect()] == [(2, "v", "excluded", "r", None)] and "Exchange" not in plan and "Join" not in plan


def test_fields_come_with_the_latest_event_of_a_record(spark, tmp_path):
    """Of events that differ by their time alone, too; and fields are aggregated with the state, not shuffled event by event."""
    held = incremental.Catalog(spark, str(tmp_path / "c"), policies.controlled_identity("v1", {"doi": identifiers.doi(F.col("doi"))}), "p1")
    events = told(spark, [(1, f"k{k}", "upsert", hour, k, "10.4321/x") for k in range(20) for hour in (3, 9, 5)])
    events = events.withColumn("title", F.date_format("source_time", "H"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("batch", "batch")
    try:
        assert held.apply(events, 1) == {"records": 20, "works": 20}
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert {(r["work_id"], r["title"]) for r in held.table("works").collect()} == {(k, "9") for k in range(20)}
    jobs = len(tracker.getJobIdsForGroup("batch"))
    assert jobs < 45, jobs


def article(pmid, title="x"):
    return f"<PubmedArticle><MedlineCitation><PMID>{pmid}</PMID><Article><ArticleTitle>{title}</ArticleTitle></Article></MedlineCitation></PubmedArticle>\n"


def bulk(folder, number, *parts):
    path = folder / f"pubmed26n{number:04d}.xml.gz"
    with gzip.open(path, "wt") as f:
        f.write("<PubmedArticleSet>" + "".join(parts) + "</PubmedArticleSet>")
    return str(path), hashlib.sha256(path.read_bytes()).hexdigest()


def test_bulk_files_are_taken_in_whole_and_in_order(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    one, two, three = (bulk(tmp_path, n, article(n * 10), article(n * 10 + 1), f"<DeleteCitation><PMID>{n}</PMID></DeleteCitation>") for n in (1, 2, 3))
    listed = lambda: sorted((r["sequence"], r["kind"], r["record_id"], r["sha256"]) for r in ledger.events().collect())
    assert ledger.events() is None and ledger.last() == 0
    assert ledger.take(one[0], 1, one[1].upper())
    expected = [(1, "delete", "1", one[1]), (1, "upsert", "10", one[1]), (1, "upsert", "11", one[1])]
    assert listed() == expected
    for path, number, sha in ((two[0], 2, one[1]), (three[0], 3, None), (two[0], 1, None), (two[0], 0, None), (str(tmp_path / "none"), 2, None)):
        with pytest.raises(Exception) as e:
            ledger.take(path, number, sha)
        assert isinstance(e.value, Refused) or "none" in str(e.value)
        assert ledger.checkpoints() == [Checkpoint(1, one[1])] and listed() == expected
    assert not ledger.take(*one[:1], 1)
    # a mark without its content is no checkpoint
    (tmp_path / "ledger/commits/000000000002").touch()
    assert ledger.last() == 1
    with pytest.raises(Refused):
        ledger.take(two[0], 2)
    ledger.recover()
    assert ledger.take(two[0], 2) and ledger.take(three[0], 3, three[1])
    assert ledger.last() == 3 and len(listed()) == 9


def test_two_writers_give_each_event_once(spark, tmp_path):
    path, sha = bulk(tmp_path, 1, *(article(n) for n in range(1, 30)))
    done = []
    writers = [threading.Thread(target=lambda: done.append(Ledger(spark, str(tmp_path / "ledger")).take(path, 1, sha))) for _ in range(2)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    # one of them made the file count, or the other came when it did already
    assert sorted(done) == [False, True]
    assert sorted(int(r["record_id"]) for r in Ledger(spark, str(tmp_path / "ledger")).events().collect()) == list(range(1, 30))
