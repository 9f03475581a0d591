import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import catalog, constraints, ranking


def told(found):
    return {r["rule"]: (r["violations"], r["least"], r["greatest"]) for r in found.collect()}


VENUE = "venue_id int, venue_type string, display_title string, issn_l string, issn string, eissn string, source_scheme string, source_identifier string"


def test_venue_rules(spark):
    rows = [
        (1, "journal", "A", "1234-567X", None, None, None, None),
        (2, "magazine", "B", "1234-567x", None, None, "doaj", "x"),
        (3, "journal", " ", "12345678", None, "1", "wiki", "x"),
        (4, None, None, None, None, None, "doaj", None),
        (10, "journal", "C", None, None, None, "nlm", " "),
    ]
    found = told(constraints.row_violations(spark.createDataFrame(rows, VENUE), "venue_id", constraints.venue_rules()))
    assert found == {"venue type": (1, "2", "2"), "display title": (1, "3", "3"), "form of issn_l": (2, "2", "3"), "form of issn": (0, None, None), "form of eissn": (1, "3", "3"), "controlled source": (3, "3", "10")}
    empty = told(constraints.row_violations(spark.createDataFrame([], VENUE), "venue_id", constraints.venue_rules()))
    assert set(empty.values()) == {(0, None, None)}


def test_paper_rules_follow_the_columns(spark):
    rows = [("a", "t", "known", 1, ["x"]), ("b ", " ", "known", None, ["x", None]), ("c", "t", "missing", -1, None), ("d", "t", "pending", None, [])]
    papers = spark.createDataFrame(rows, "canonical_key string, title string, citation_count_state string, citation_count_value long, topic_slugs array<string>")
    found = told(constraints.row_violations(papers, "canonical_key", constraints.paper_rules(papers.columns)))
    assert found == {
        "canonical_key is trimmed": (1, "b ", "b "), "title is trimmed": (1, "b ", "b "), "state of citation_count": (1, "d", "d"), "value of citation_count by state": (3, "b ", "d"),
        "range of citation_count_value": (1, "c", "c"), "range of topic_slugs": (1, "b ", "b "),
    }


def test_works_of_one_identity_agree(spark):
    rows = [(1, "T", "a", 1, 1, "active"), (1, " ", None, 1, None, "retracted"), (2, "T", "a", 1, 1, "retracted"), (2, "U", "b", 2, 2, "withdrawn"), (None, "T", "a", 1, 1, "active"), (None, "U", "b", 2, 2, "rejected"), (7, "X", "", 3, 4, "active"), (7, "Y", " ", 3, 4, "active")]
    works = spark.createDataFrame(rows, "id int, title string, abstract string, published_at int, venue_id int, status string")
    found = told(constraints.disagreements(works, "id", constraints.work_fields()))
    assert found == {"conflicting title": (2, "2", "7"), "conflicting abstract": (1, "2", "2"), "conflicting published_at": (1, "2", "2"), "conflicting venue_id": (1, "2", "2"), "conflicting status": (1, "2", "2")}


def test_assessments_and_their_venues(spark):
    rows = [(1, 1, "accepted", ["r"], "journal", None), (2, 1, "accepted", [], "journal", None), (3, 2, "not_applicable", [], "conference", constraints.NO_JOURNAL), (4, 2, "rejected", [], "journal", None), (5, 9, "postponed", [], None, None), (6, 1, "not_applicable", ["r"], "journal", None), (7, None, "unknown", None, None, None)]
    assessments = spark.createDataFrame(rows, "id int, venue_id int, decision string, matched_rules array<string>, evidence_type string, reason string")
    venues = spark.createDataFrame([(1, "journal"), (2, "conference")], "venue_id int, venue_type string")
    found = told(constraints.joined_violations(assessments, "id", venues, ["venue_id"], constraints.assessment_rules()))
    assert found == {"no row of that key": (1, "5", "5"), "decision": (1, "5", "5"), "evidence names the type": (3, "4", "7"), "accepted journals match a rule": (1, "2", "2"), "others match none": (2, "4", "7"), "not applicable to journals": (1, "6", "6")}


def test_receipts_keys_and_errors(spark):
    receipts = spark.createDataFrame([(1, 5, 3, 2, 5, 3), (2, 5, 3, 2, 4, 3)], "id int, input_rows int, inserted_rows int, unchanged_rows int, associated_rows int, created_rows int")
    found = constraints.all_of(("receipt", constraints.row_violations(receipts, "id", constraints.receipt_rules())), ("receipt", constraints.shared_keys(receipts, "id", "input is shared", [F.col("input_rows")])))
    assert told(found) == {"associated rows are the input": (1, "2", "2"), "created rows are the inserted": (0, None, None), "the rest is unchanged": (1, "2", "2"), "input is shared": (2, "1", "2")}
    with pytest.raises(constraints.Violated, match="receipt: the rest is unchanged: 1, from 2 to 2"):
        constraints.enforce(found)
    constraints.enforce(found.where("violations = 0"))


def test_one_scan_for_all_rules_of_a_table(spark, sf):
    papers = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_name").alias("canonical_key"), F.col("s_name").alias("title"), F.col("s_name").alias("search_text"))
    found = constraints.row_violations(papers, "canonical_key", constraints.paper_rules(papers.columns))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1


def test_places_of_a_hot_key_are_dense(spark):
    rng = random.Random(3)
    rows = [(None if k == 0 else ("hot" if k < 6 else f"k{k}"), i) for i, k in ((i, rng.randrange(12)) for i in range(3000))]
    df = spark.createDataFrame(rows, "k string, i int").repartition(7)
    got = {(r["k"], r["i"]): r["place"] for r in ranking.placed_within(df, ["k"], ["i"], "place").collect()}
    expected, seen = {}, {}
    for k, i in sorted(rows, key=lambda r: r[1]):
        seen[k] = seen.get(k, 0) + 1
        expected[k, i] = seen[k]
    assert got == expected
    assert ranking.placed_within(df.limit(0), ["k"], ["i"], "place").collect() == []


def test_papers_of_a_taxon_in_bounded_lists(spark):
    rows = [("a", p % 25) for p in range(60)] + [("b", 3), (None, 4), ("c", None), ("d", 9), ("d", 1)]
    lists = catalog.taxon_papers(spark.createDataFrame(rows, "slug string, paper int"), "paper", "slug", 10).collect()
    assert {(r["slug"], r["chunk"]): (r["papers"], r["paper_ids"]) for r in lists} == {("a", 0): (10, list(range(10))), ("a", 1): (10, list(range(10, 20))), ("a", 2): (5, list(range(20, 25))), ("b", 0): (1, [3]), ("d", 0): (2, [1, 9])}


def test_taxa_that_disagree(spark):
    rows = [("a", 1, "N", "d"), ("a", 2, "N", "d"), ("b", 1, "N", "d"), ("b", 2, "N", None), ("c", 1, "N", "d"), ("c", 1, "N", "e"), ("e", 1, "N", "d"), ("e", 2, "M", "d"), ("f", 1, "N", None)]
    df = spark.createDataFrame(rows, "slug string, paper int, name string, description string")
    assert {r["slug"]: r["conflict"] for r in catalog.taxonomy(df, "paper", "slug", "name", "description").collect()} == {"a": False, "b": True, "c": True, "e": True, "f": False}
    assert {r["slug"]: r["conflict"] for r in catalog.taxonomy(df, "paper", "slug", "name").collect()} == {"a": False, "b": False, "c": False, "e": True, "f": False}
