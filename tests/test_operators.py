import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from folioscope.functions import documents, stemming
from folioscope.operators import analytics, catalog, jobs, policies, ranking, search, state, textindex, venues
from folioscope.operators.components import connected_components
from folioscope.plans import state_queries


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def when(text):
    return F.lit(datetime.fromisoformat(text))


def test_velocity(spark):
    args = [F.lit(6), F.lit(12), when("2026-01-01"), when("2026-01-03")]
    status, value = analytics.citation_velocity(*args)
    assert tuple(one(spark, status, value)) == ("ok", 3)
    for k, v, expected in ((0, F.lit(None).cast("int"), "missing_signal"), (3, when("2025-01-01"), "reversed_time"), (3, when("2026-01-01"), "zero_denominator"), (1, F.lit(-1), "invalid_metric")):
        assert tuple(one(spark, *analytics.citation_velocity(*args[:k], v, *args[k + 1 :]))) == (expected, None)


def test_growth_and_adoption(spark):
    t0, t1 = when("2026-01-01"), when("2026-01-02")
    assert tuple(one(spark, *analytics.code_growth(F.lit(0), F.lit(2), t0, t1))) == ("zero_denominator", None)
    assert one(spark, *analytics.code_growth(F.lit(3), F.lit(5), t0, t0))[0] == "window_mismatch"
    assert str(one(spark, *analytics.code_growth(F.lit(3), F.lit(5), t0, t1))[1]) == "0.666666666666666667"
    assert one(spark, *analytics.topic_growth(F.lit(0), F.lit(-1)))[0] == "invalid_metric"
    assert one(spark, *analytics.method_adoption(F.lit(5), F.lit(0), F.lit(1), F.lit(2)))[0] == "zero_denominator"
    assert one(spark, *analytics.method_adoption(F.lit(5), F.lit(4), F.lit(1), F.lit(2)))[0] == "invalid_metric"
    assert str(one(spark, *analytics.method_adoption(F.lit(1), F.lit(3), F.lit(1), F.lit(2)))[1]) == "0.166666666666666667"


def test_percentile_leaves_out_the_work_itself(spark):
    df = spark.createDataFrame([("t", 20, "x"), ("a", 30, "x"), ("b", 20, "x"), ("c", 10, "x"), ("d", 20, "x"), ("alone", 1, "y")], "id string, v int, k string")
    got = {r["id"]: r["percentile"] for r in analytics.citation_percentile(df, ["k"], "v").collect()}
    assert got["t"] == 75 and got["alone"] is None


def test_opportunity_thresholds(spark):
    policy = analytics.OpportunityPolicy()
    f = lambda *x, missing=False: one(spark, analytics.opportunity(policy, F.lit(x[0]), F.lit(missing), *map(F.lit, x[1:])))[0]
    assert f(0.8, 0.25, 0.4, 0.7, 0.6, 0.75) == "worth_pursuing"
    assert f(0.79, 0.25, 0.4, 0.7, 0.6, 0.75) == f(0.8, 0.25, 0.4, 0.7, 0.6, 0.75, missing=True) == "insufficient_evidence"
    assert f(0.8, -0.1, 0.8, 0.3, 0.2, 0.7) == "not_recommended" and f(0.8, 0.0, 0.5, 0.5, 0.5, 0.9) == "proceed_with_caution"
    analytics.OpportunityPolicy(avoid=(0.3, 0.8, 0.3, 0.2, 0.7)).validate()
    for wrong in ({"avoid": (0.3, 0.3, 0.8, 0.7, 0.7)}, {"version": " "}, {"required": analytics.SIGNALS[:-1]}, {"required": (*analytics.SIGNALS, "growth_score")}):
        with pytest.raises(ValueError):
            analytics.OpportunityPolicy(**wrong).validate()


def test_venue_policy(spark):
    rows = [("a", "journal", 12.5, "Q2"), ("a", "journal", 12.5, "Q1"), ("b", "journal", None, None), ("c", "journal", 9.999, "Q2"), ("c", "journal", 0.0, "Q3"), ("d", "conference", 50.0, "Q1")]
    got = {r["v"]: (r["decision"], r["reasons"]) for r in analytics.venue_policy(spark.createDataFrame(rows, "v string, venue_type string, jif double, quartile string"), ["v"]).collect()}
    assert got == {"a": ("accepted", "jif_gte_10,jcr_q1"), "b": ("unknown", ""), "c": ("rejected", ""), "d": ("not_applicable", "")}


def test_state_is_independent_of_arrival(spark):
    rows = [(1, "k", "upsert", datetime(2026, 1, 2), "b", 1), (2, "k", "delete", datetime(2026, 1, 1), "z", 9), (3, "k", "upsert", datetime(2026, 1, 2), "a", 7)]
    df = spark.createDataFrame(rows, "event_id long, event_key string, event_kind string, source_time timestamp, tie_break_key string, position long")
    for d in (df, df.orderBy(F.desc("event_id"))):
        assert state.latest_by(d, ["event_key"]).first()["event_id"] == 1
    ledger = state.appended(df.limit(0), df, ["event_id"])
    assert ledger.count() == 3 and state.appended(ledger, df, ["event_id"]).count() == 0
    with pytest.raises(state.ConflictError):
        state.checked(df, df, "clash")


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (5, 4), (9, 9), (None, 1), (6, 5), (7, 6), (8, 7)], "a long, b long")
    assert {r["node"]: r["component"] for r in connected_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 4, 8: 4, 9: 9}
    assert connected_components(edges.limit(0)).count() == 0
    chain = spark.range(60).selectExpr("id as a", "id + 1 as b")
    assert {r["component"] for r in connected_components(chain).collect()} == {0}


def test_components_of_every_link(spark, tmp_path):
    links = [(1, 10, 50.0), (2, 10, 5.0), (2, 11, 46.0), (3, 12, 1.0), (4, 12, 49.0), (5, 13, 2.0), (3, 11, 45.0), (6, 14, 45.0)]
    spark.createDataFrame(links, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(k, "HIGH" if k == 4 else "LOW") for k in range(1, 7)], "o_orderkey long, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for record, identifier, _ in links:
        high, low = sorted((root(record), root(-identifier)), reverse=True)
        parent[high] = low
    assert {tuple(r) for r in state_queries.identity_components(spark, str(tmp_path)).collect()} == {(x, root(x)) for x in list(parent)}
    rows = {r["component"]: (r["records"], r["conflict"]) for r in state_queries.identity_conflicts(spark, str(tmp_path)).collect()}
    assert rows == {-12: (4, True), -13: (1, False), -14: (1, False)}


def catalog_rows(spark):
    known = lambda v: ("known", v)
    rows = [
        ("openalex:W100001", *known(datetime(2026, 7, 15, 12)), *known("research_article"), "known", True, "unknown", None, *known(42), *known(0.9), "active", ["agents"], ["causal-inference"], ["crossref", "openalex"], "Agents are strictly reproducible"),
        ("openalex:W100002", *known(datetime(2026, 7, 14, 12)), *known("preprint"), "known", False, "known", False, *known(3), *known(0.2), "active", ["agents"], ["rag"], ["openalex"], "retrieval for agents"),
        ("pubmed:12345678", "missing", None, "missing", None, "unknown", None, "missing", None, "unknown", None, "missing", None, "active", ["safety"], ["causal-inference"], ["pubmed"], "safety"),
    ]
    schema = "canonical_key string, published_at_state string, published_at_value timestamp, paper_type_state string, paper_type_value string, has_code_state string, has_code_value boolean, has_data_state string, has_data_value boolean, citation_count_state string, citation_count_value long, trend_score_state string, trend_score_value double, lifecycle_status string, topic_slugs array<string>, method_slugs array<string>, source_names array<string>, search_text string"
    return spark.createDataFrame(rows, schema)


def test_catalog_filters_pages_and_facets(spark):
    df = catalog_rows(spark)
    keys = lambda **q: [r["canonical_key"][-1] for r in catalog.page(df, catalog.PaperQuery(**q).normalised()).collect()]
    assert keys() == ["1", "2", "8"] and keys(has_code=True) == ["1"] and keys(has_code=False) == ["2"]
    assert keys(topic="agents", method="causal-inference", source="crossref", paper_type="research_article", q="agent reproducible") == ["1"]
    assert keys(q="safety or retrieval -agents") == ["8"]
    following = catalog.page(df, catalog.PaperQuery(limit=1).normalised(), (0, datetime(2026, 7, 15, 12), "openalex:W100001")).collect()
    assert [r["canonical_key"][-1] for r in following] == ["2", "8"]
    facets = catalog.facets(catalog.filtered(df, catalog.PaperQuery(topic="agents").normalised()))
    assert {k: [(r["key"], r["papers"]) for r in v.collect()] for k, v in facets.items()}["topics"] == [("agents", 2)]
    stats = catalog.statistics(df, F.lit(datetime(2026, 7, 16))).first()
    assert (stats["has_code_ratio_state"], stats["recent_state"], stats["papers_last_7_days"]) == ("unknown", "unknown", None)


@pytest.mark.parametrize("bad", [[("q", "a"), ("q", "b")], [("x", "1")], [("limit", "101")], [("sort", "relevance")], [("topic", "Not A Slug")], [("paper_type", "survey")], [("paper_type", "other")], [("source", "blog")], [("has_code", "yes")], [("q", "漢" * 101)], [("published_from", "2026-02-01"), ("published_to", "2026-01-01")]])
def test_invalid_parameters(bad):
    with pytest.raises(catalog.InvalidQuery):
        catalog.PaperQuery.from_parameters(bad)


def test_cursor_is_bound_and_signed():
    signer = catalog.CursorSigner(b"k" * 32)
    fields = {"generation": "g", "resource": "papers", "filters": catalog.PaperQuery().normalised().filter_hash(), "sort": "trend_desc", "rank": 0, "value": 0.5, "key": "a"}
    cursor = signer.encode(**fields)
    assert signer.decode(cursor, generation="g", resource="papers") == fields
    for wrong in (cursor[:-2], cursor + "=", "x" + cursor, "a.b", cursor * 40):
        with pytest.raises(catalog.InvalidQuery):
            signer.decode(wrong)
    with pytest.raises(catalog.InvalidQuery):
        signer.decode(cursor, generation="h")


def test_search_language(spark):
    df = search.with_stems(spark.createDataFrame([("All rights reserved by the authors",), ("rights of all are reserved",), ("",), (None,)], "t string"), "t", "s")
    hits = lambda q: [r["h"] for r in df.select(search.matches(F.col("s"), q).alias("h")).collect()]
    assert hits('"all rights reserved"') == [True, False, False, False]
    assert hits("reserved -author") == [False, True, False, False] and hits("the of") == [False] * 4
    assert search.parse('a "x y" -"p q" or z') == [[(True, ["x", "y"]), (False, ["p", "q"])], [(True, ["z"])]]


def test_windows_are_compared_in_order(spark):
    day = lambda n: F.lit(datetime(2026, 1, n))
    status = lambda *w: one(spark, analytics.topic_growth(F.lit(2), F.lit(3), tuple(w))[0])[0]
    assert status(day(1), day(5), day(5), day(9)) == "ok"
    assert status(day(1), day(5), day(4), day(8)) == status(day(1), day(5), day(6), day(8)) == "window_mismatch"
    assert status(day(5), day(1), day(5), day(9)) == status(day(4), day(8), day(1), day(5)) == "reversed_time"
    assert status(day(1), day(1), day(5), day(9)) == "zero_denominator"
    assert status(F.lit(None).cast("timestamp"), day(5), day(5), day(9)) == "missing_signal"


def test_decisions_are_immutable(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "event_id long, scope_policy string, status string, reason string, evidence string")
    stored = rows((1, "v1", "included", "r", "e"))
    assert policies.new_decisions(stored, rows((1, "v1", "included", "r", "e"), (2, "v1", "excluded", "r", None), (1, "v2", "excluded", "r", "e"))).count() == 2
    with pytest.raises(state.ConflictError):
        policies.new_decisions(stored, rows((1, "v1", "excluded", "r", "e")))
    with pytest.raises(ValueError):
        policies.ScopePolicy(" ", lambda: F.lit(None)).decided(stored)


def test_job_states():
    job = jobs.Job("b", "openalex", "k")
    running = job.start(" 7 ").at("project")
    assert (running.id, running.status, running.stage) == ("7", "running", "project")
    assert running.end("failed").status == "failed"
    for wrong in (lambda: job.at("raw"), lambda: job.end("failed"), lambda: running.start("7"), lambda: running.end("pending"), lambda: running.at("sleep"), lambda: running.end("succeeded").at("raw"), lambda: jobs.Job("", "s", "k"), lambda: job.start("")):
        with pytest.raises(ValueError):
            wrong()


def test_files_need_names_and_hashes(spark):
    good = "0" * 64
    rows = [(1, "pubmed26n0004.xml.gz", good), (2, "pubmed26n0005.xml.gz", "ABC"), (3, "pubmed25n0006.xml.gz", good), (4, "pubmed26n0004.xml.gz", good)]
    found = jobs.sequence_problems(spark.createDataFrame(rows, "position int, name string, sha256 string"), 2026, 3).orderBy("position").collect()
    assert [r["problem"] for r in found] == [None, "sha256", "name", "duplicate"]


def test_places_over_ranges(spark):
    rows = spark.range(1000).selectExpr("id", "id % 7 as k").repartition(5)
    got = ranking.placed(rows, [F.desc("k"), F.asc("id")], "place").collect()
    assert [(r["k"], r["id"]) for r in sorted(got, key=lambda r: r["place"])] == sorted(((r["k"], r["id"]) for r in got), key=lambda x: (-x[0], x[1]))
    assert sorted(r["place"] for r in got) == list(range(1, 1001))


def test_statuses(spark):
    allowed = lambda a, b: one(spark, state.allowed_transition(F.lit(a), F.lit(b)))[0]
    assert allowed("active", "rejected") and allowed("superseded", "superseded")
    assert not allowed("rejected", "active") and not allowed("active", "deleted") and not allowed("deleted", "deleted")


#: Words and their stems, from the stemmer's published description and sample vocabulary.
STEMS = """
consign consign consigned consign consignment consign consistency consist consistently consist consolation consol consolatory consolatori consolidate consolid
consolingly consol conspicuously conspicu conspiracy conspiraci conspirators conspir constable constabl constancy constanc knackeries knackeri knavish knavish
kneaded knead kneeling kneel knightly knight knives knive knocker knocker knotted knot generate generat generously generous communication communic arsenal arsenal
skies sky dying die news news happy happi cry cri by by say say hopping hop hoping hope agreed agre feed feed luxuriated luxuri relational relat conditional condit
rational ration digitizer digit radically radic analogous analog vileli vile hopefulness hope callousness callous formaliti formal sensibiliti sensibl triplicate triplic
electriciti electr goodness good revival reviv airliner airlin adjustable adjust replacement replac adoption adopt controll control roll roll proceeded proceed
succeed succeed inning inning youth youth enjoying enjoy yellow yellow ties tie cries cri gas gas gaps gap kiwis kiwi this this be be
""".split()


def test_stems_of_the_published_vocabulary(spark):
    pairs = list(zip(STEMS[::2], STEMS[1::2], strict=True))
    row = spark.createDataFrame([([w for w, _ in pairs],)], "ws array<string>").select(stemming.stems("ws").alias("s")).first()
    assert list(zip([w for w, _ in pairs], row["s"], strict=True)) == pairs
    told = stemming.vocabulary(spark.createDataFrame(pairs, "w string, s string"), "w").collect()
    assert {r["w"]: r["stem"] for r in told} == dict(pairs)
    assert stemming.stems_of(("reserved", "o'clock\\")) == {"reserved": "reserv", "o'clock\\": "o'clock\\"}


def test_the_index_equals_a_scan(spark, tmp_path):
    rng = random.Random(5)
    words = "tide tides turning turned harbour reserved rights author the of owner mood".split()
    rows = [(f"k{i}", " ".join(rng.choices(words, k=rng.randrange(0, 14)))) for i in range(120)] + [("none", None), ("again", "tide")]
    df = spark.createDataFrame(rows, "key string, text string").repartition(3)
    index = textindex.Index(spark, str(tmp_path / "i"), buckets=16).write(df, "key", "text")
    scanned = search.with_stems(df, "text", "s")
    for q in ("tide", "tides turn", '"rights reserved"', '"tide turning tides" or author', "-tide", "mood or -author", 'harbour -"rights reserved"', "the of", "nothing", '"tide tide"'):
        expected = {(r["key"], r["v"]) for r in scanned.where(search.matches(F.col("s"), q)).select("key", search.relevance(F.col("s"), q).alias("v")).collect()}
        assert {tuple(r) for r in index.search(q).collect()} == expected, q
    plan = index.postings(["tide", "author"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "PushedFilters: [In(stem" in plan or "In(stem" in plan


def test_aliases_are_planned_once_and_got(spark):
    rows = [("v1", " Nature ", "jcr"), ("v1", "Nature", "jcr"), ("v2", "Cell", "jcr"), ("v2", " ", "jcr"), ("v3", "X", "other")]
    plan = venues.alias_plan(spark.createDataFrame(rows, "venue_id string, alias string, source string"), " jcr ")
    assert sorted((r["key"], r["problem"]) for r in plan.collect()) == [("2:v1:6:Nature:3:jcr", None), ("2:v2:0::3:jcr", "blank"), ("2:v2:4:Cell:3:jcr", None), ("2:v3:1:X:5:other", "source")]
    locks = [r["lock"] for r in plan.collect()]
    assert locks == sorted(locks) and all(-(2**31) <= x < 2**31 for x in locks)
    stored = spark.createDataFrame([("2:v1:6:Nature:3:jcr", 9)], "key string, alias_id long")
    assert {r["key"]: r["alias_id"] for r in venues.aliases_got(plan, stored).collect()} == {"2:v1:6:Nature:3:jcr": 9, "2:v2:4:Cell:3:jcr": None}


def test_json_values_are_compared_whatever_their_order(spark):
    same = lambda a, b: one(spark, documents.same_json(F.lit(a), F.lit(b)))[0]
    assert same('{"a": 1, "b": [2]}', '{"b":[2],"a":1}') and not same('{"a": 1}', '{"a": 2}') and not same("{", "{")
