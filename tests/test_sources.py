import gzip
import json

import pytest
from pyspark.sql import functions as F
from folioscope.operators.components import checkpointed
from folioscope.plans import publication
from folioscope.sources import records
from folioscope.sources.generations import PublicationRefused, Store, revision

WORK = {"id": "https://openalex.org/W1", "doi": "https://doi.org/10.4321/HARBOR.7", "title": " Tides  of the harbour ", "publication_date": "2026-07-08", "updated_date": "2026-07-10T01:02:03", "authorships": [{"author": {"display_name": "A. B", "orcid": "https://orcid.org/0000-0002-1825-0097"}, "is_corresponding": True, "institutions": [{"display_name": "Harbour School"}, {"id": "x"}]}], "locations": [{"landing_page_url": "https://github.com/Org/Repo", "pdf_url": None}], "is_retracted": False, "type": "article", "cited_by_count": 4, "abstract_inverted_index": {"Tides": [0], "turn": [1]}, "topics": [{"id": "https://openalex.org/T9", "display_name": "Marine Life", "score": 0.9}, {"id": "https://openalex.org/T8", "display_name": "Marine life", "score": 0.1}], "primary_location": {"license": "cc-by", "license_id": None, "source": {"display_name": "J", "type": "journal", "issn": ["0378-5955"]}}}
ITEM = {"DOI": "10.4321/harbor.7", "title": ["Tides of the harbour"], "author": [{"given": "A.", "family": "B"}], "ISSN": ["0378-5955", "03785955"], "published": {"date-parts": [[2026, 7]]}, "indexed": {"date-time": "2026-08-02T21:10:30+05:30"}}
XML = """<?xml version="1.0"?><PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>42</PMID><Article><Journal><ISSN>0378-5955</ISSN><JournalIssue><PubDate><MedlineDate>2025 Nov-Dec</MedlineDate></PubDate></JournalIssue></Journal><ArticleTitle>Otters in spring</ArticleTitle><AuthorList><Author><LastName>C</LastName><ForeName>D</ForeName></Author></AuthorList><PublicationTypeList><PublicationType>Journal Article</PublicationType><PublicationType>Retracted Publication</PublicationType></PublicationTypeList></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="doi">10.4321/otters</ArticleId></ArticleIdList></PubmedData></PubmedArticle><DeleteCitation><PMID>7</PMID></DeleteCitation></PubmedArticleSet>"""


@pytest.fixture()
def read(spark, tmp_path):
    (tmp_path / "oa.json").write_text(json.dumps({"meta": {"count": 1}, "results": [WORK]}))
    (tmp_path / "cr.json").write_text(json.dumps({"message": {"items": [ITEM]}}))
    with gzip.open(tmp_path / "pm.xml.gz", "wt") as f:
        f.write(XML)
    return {n: f(spark, str(tmp_path / p)) for n, f, p in (("openalex", records.openalex, "oa.json"), ("crossref", records.crossref, "cr.json"), ("pubmed", records.pubmed, "pm.xml.gz"), ("gone", records.pubmed_deletions, "pm.xml.gz"))}


def test_readers_give_one_shape(read):
    oa, cr, pm = (read[n].first() for n in ("openalex", "crossref", "pubmed"))
    assert (oa["record_id"], oa["doi"], oa["title"], oa["urls"]) == ("W1", "10.4321/harbor.7", "Tides of the harbour", ["https://github.com/org/repo"])
    assert (cr["doi"], cr["issns"], cr["published"]["precision"], cr["published"]["at"], str(cr["updated_at"])) == ("10.4321/harbor.7", ["0378-5955"], "month", None, "2026-08-02 15:40:30")
    assert (pm["record_id"], pm["doi"], [tuple(a) for a in pm["authors"]], pm["retracted"], pm["published"]["year"]) == ("42", "10.4321/otters", [("D C", None, None, 1, False, None)], True, 2025)
    assert [tuple(a) for a in oa["authors"]] == [("A. B", None, "0000-0002-1825-0097", 1, True, ["Harbour School"])]
    assert [r["record_id"] for r in read["gone"].collect()] == ["7"]


def test_two_sources_converge_and_publish(spark, read, tmp_path):
    events = publication.events_of(read["openalex"].unionByName(read["crossref"]).unionByName(read["pubmed"]))
    papers = checkpointed(publication.papers(publication.works(publication.current_records(events))))
    rows = {r["canonical_key"]: r for r in papers.collect()}
    assert rows.keys() == {"doi:10.4321/harbor.7", "doi:10.4321/otters"}
    both = rows["doi:10.4321/harbor.7"]
    assert both["source_names"] == ["crossref", "openalex"] and both["published_at_state"] == "missing" and not both["conflict"]
    assert rows["doi:10.4321/otters"]["lifecycle_status"] == "retracted"
    assert [s["source"] for s in both["source_provenance"]] == ["crossref", "openalex"] and both["has_data_state"] == "unknown" and both["trend_score_state"] == "missing"
    alone = publication.papers(publication.works(publication.current_records(publication.events_of(read["openalex"])))).first()
    assert (alone["abstract_value"], alone["paper_type_value"], alone["citation_count_value"], alone["topic_slugs"]) == ("Tides turn", "research_article", 4, ["marine-life"])
    assert [tuple(x) for x in alone["licenses"]] == [("cc-by", "", "$.primary_location")] and tuple(alone["venue"]) == ("journal", "J") and "turn" in alone["search_text"]
    store = Store(spark, str(tmp_path / "catalog"))
    first = store.publish(papers, "canonical_key", "v1", "2026-07-16T00:00:00Z")
    assert store.publish(papers.repartition(3), "canonical_key", "v1", "2026-07-17T00:00:00Z") == first == store.current()
    assert store.publish(papers, "canonical_key", "v2", "2026-07-17T00:00:00Z") != first
    assert store.read(first).count() == store.read().count() == 2
    with pytest.raises(PublicationRefused, match="canonical_key is shared: 2"):
        store.publish(papers.union(papers), "canonical_key", "v1", "2026-07-17T00:00:00Z")


def test_a_broken_catalog_is_not_published(spark, read, tmp_path):
    papers = checkpointed(publication.papers(publication.works(publication.current_records(publication.events_of(read["openalex"].unionByName(read["pubmed"]))))))
    store = Store(spark, str(tmp_path / "catalog"))
    publish = lambda rows: store.publish(rows, "canonical_key", "v1", "2026-07-16T00:00:00Z", publication.broken(), publication.one_of_a_kind())
    first = publish(papers)
    for column, value, rule in (
        ("has_code_state", F.lit("pending"), "state is invalid"),
        ("citation_count_state", F.lit("known"), "known without a value"),
        ("abstract_state", F.lit("unknown"), "a value that isn't known"),
        ("source_provenance", F.filter("source_provenance", lambda p: F.lit(False)), "no provenance"),
        ("source_provenance", F.transform("source_provenance", lambda p: p.withField("raw_hash", F.lit(None).cast("string"))), "provenance is incomplete"),
        ("title", F.lit(" "), "no title"),
        ("lifecycle_status", F.lit("gone"), "lifecycle is invalid"),
        ("canonical_key", F.when(F.col("canonical_key").contains("harbor"), "DOI:10.4321/otters").otherwise(F.col("canonical_key")), "slug is shared"),
    ):
        with pytest.raises(PublicationRefused) as e:
            publish(papers.withColumn(column, value))
        assert set(e.value.verdict) == {rule} and e.value.verdict[rule][0] >= 1 and e.value.verdict[rule][1]
        assert store.current() == first and store.read().count() == 2
    assert publish(papers) == first


def test_the_revision_is_that_of_the_rows(spark):
    df = spark.createDataFrame([(k, str(k)) for k in range(300)], "k int, v string")
    assert revision(df, "f") == revision(df.orderBy(F.desc("k")).repartition(7), "f") != revision(df, "g")
    assert revision(df.where("k > 0"), "f") != revision(df, "f") != revision(df.withColumn("v", F.when(F.col("k") == 7, "x").otherwise(F.col("v"))), "f")
    assert revision(df.limit(0), "f")


def test_records_without_a_doi_meet_by_other_identifiers(spark, tmp_path):
    works = [
        {"id": "https://openalex.org/W2", "title": "Mice", "ids": {"pmid": "https://pubmed.ncbi.nlm.nih.gov/42", "arxiv": "arXiv:2101.00001v2"}},
        {"id": "https://openalex.org/W3", "title": "Mice", "ids": {"arxiv": "https://arxiv.org/abs/2101.00001"}},
        {"id": "https://openalex.org/W4", "title": "Rats", "ids": {"pmcid": "PMC77"}},
        {"id": "https://openalex.org/W5", "title": "Alone"},
    ]
    (tmp_path / "oa.json").write_text(json.dumps({"results": works}))
    article = '<PubmedArticle><MedlineCitation><PMID>{0}</PMID><Article><ArticleTitle>x</ArticleTitle></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="pubmed">{0}</ArticleId>{1}</ArticleIdList></PubmedData></PubmedArticle>'
    (tmp_path / "pm.xml").write_text("<PubmedArticleSet>" + article.format(42, "") + article.format(43, '<ArticleId IdType="pmc">PMC77</ArticleId>') + "</PubmedArticleSet>")
    events = publication.events_of(records.openalex(spark, str(tmp_path / "oa.json")).unionByName(records.pubmed(spark, str(tmp_path / "pm.xml"))))
    rows = publication.papers(publication.works(publication.current_records(events))).collect()
    assert {r["canonical_key"]: (r["source_names"], r["conflict"]) for r in rows} == {
        "arxiv:2101.00001": (["openalex", "pubmed"], True),
        "openalex:W4": (["openalex", "pubmed"], False),
        "openalex:W5": (["openalex"], False),
    }


def test_metrics_are_checked(spark, tmp_path):
    (tmp_path / "m.csv").write_text("title,issn_l,issn,eissn,metric_year,category,jif,quartile,status,source\nA,0378-5955,,,2025,x,12.5,Q1,known,s\nB,0378-5954,,,2025,x,1,Q2,known,s\nC,0378-5955,,,2025,y,,,unknown,s\nD,0378-5955,,,2025,z,,,known,s\n")
    assert [r["problem"] for r in records.metrics(spark, str(tmp_path / "m.csv")).orderBy("title").collect()] == [None, "issn_l", None, "known_without_value"]


def test_raw_hashes_are_of_the_article_itself(spark, tmp_path):
    """Articles that differ only in parts that aren't parsed have different hashes; order and sequence are kept."""
    one = "<PubmedArticle><MedlineCitation><PMID Version='1'>{}</PMID><Article><ArticleTitle>same</ArticleTitle>{}</Article></MedlineCitation></PubmedArticle>"
    body = one.format(1, "<Extra>a</Extra>") + "\n" + one.format(1, "<Extra>b</Extra>") + "<DeleteCitation>\n<PMID Version='1'>5</PMID><PMID>6</PMID></DeleteCitation>"
    (tmp_path / "pubmed26n0003.xml").write_text(f"<PubmedArticleSet>\n{body}</PubmedArticleSet>")
    rows = records.pubmed(spark, str(tmp_path)).collect()
    assert len({r["raw_hash"] for r in rows}) == 2 and {r["record_id"] for r in rows} == {"1"} and {r["title"] for r in rows} == {"same"}
    events = records.pubmed_events(spark, str(tmp_path)).orderBy("sequence", "position").collect()
    assert [(r["sequence"], r["kind"], r["record_id"]) for r in events] == [(3, "upsert", "1"), (3, "upsert", "1"), (3, "delete", "5"), (3, "delete", "6")]
    assert events[0]["raw"] == one.format(1, "<Extra>a</Extra>")


def test_rejected_identifiers_are_kept_apart(spark, tmp_path):
    article = "<PubmedArticle><MedlineCitation><PMID>8</PMID><Article><ArticleTitle>x</ArticleTitle><ELocationID EIdType='doi' ValidYN='N'> 10.4321/wrong </ELocationID><ELocationID EIdType='doi' ValidYN='Y'>10.4321/right</ELocationID></Article></MedlineCitation></PubmedArticle>"
    (tmp_path / "a.xml").write_text(f"<PubmedArticleSet>{article}</PubmedArticleSet>")
    assert [tuple(r) for r in records.pubmed_rejected(spark, str(tmp_path)).collect()] == [("8", "doi", "10.4321/wrong")]


def test_pointers_appear_at_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "c"))
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    first, second = (store.publish(df, "k", f, "2026-01-01") for f in ("v1", "v2"))
    assert store.current() == second != first
    assert store.publish(df, "k", "v1", "2026-01-02") == first == store.current()
    # the pointer before the current one stays for readers that have listed it
    assert [r for _, r in store._pointers()] == [second, first]


def test_malformed_pages_and_items_are_errors(spark, tmp_path):
    good, bad = dict(WORK), {"id": "https://openalex.org/W9", "topics": [{"id": "https://openalex.org/T8", "display_name": "Junk", "score": 7.0}]}
    pages = {"a": json.dumps({"results": [good, {"title": "no id"}]}), "b": json.dumps({"results": [good]})[:-30], "c": json.dumps({"results": [good, bad, 5, None, {**good, "cited_by_count": "many"}]}), "d": "", "e": json.dumps({"results": []})}
    for name, text in pages.items():
        (tmp_path / f"{name}.json").write_text(text)
    found = sorted(tuple(r) for r in records.malformed(spark, str(tmp_path), "openalex").collect())
    assert found == [("a.json", 2, "id"), ("b.json", 0, "page"), ("c.json", 2, "topic_score"), ("c.json", 3, "form"), ("c.json", 4, "form"), ("c.json", 5, "form")]
    # an empty file has no rows for a reader; it holds no page
    with pytest.raises(Exception, match="malformed .*item"):
        records.openalex(spark, str(tmp_path)).select("title").collect()
    assert [r["record_id"] for r in records.openalex(spark, str(tmp_path), on_error="skip").collect()] == ["W1", "W1"]
    (tmp_path / "cr.json").write_text(json.dumps({"message": {"items": [ITEM, {**ITEM, "update-to": [{"type": "retraction"}]}, {**ITEM, "abstract": "<jats:p>cut"}]}}))
    assert [tuple(r) for r in records.malformed(spark, str(tmp_path / "cr.json"), "crossref").collect()] == [("cr.json", 2, "update_to"), ("cr.json", 3, "abstract: incomplete")]


def _article(pmid, title, revised="", more="", corrections=""):
    date = "" if not revised else "<DateRevised><Year>{}</Year><Month>{}</Month><Day>{}</Day></DateRevised>".format(*revised.split("-"))
    return f"<PubmedArticle><MedlineCitation><PMID>{pmid}</PMID>{date}<Article><ArticleTitle>{title}</ArticleTitle>{more}</Article>{corrections}</MedlineCitation></PubmedArticle>\n"


def _write(folder, number, *parts):
    (folder / f"pubmed26n{number:04d}.xml").write_text("<PubmedArticleSet>" + "".join(parts) + "</PubmedArticleSet>")


def _titles(spark, folder):
    events = publication.events_of(records.pubmed(spark, str(folder)))
    events = events.unionByName(publication.deletions_of(records.pubmed_deletions(spark, str(folder)), events))
    return {r["event_key"]: r["title"] for r in publication.current_records(events).select("event_key", "record.title").collect()}


@pytest.mark.parametrize("files", [(1, 2), (2, 1)])
def test_the_later_revision_wins_in_whatever_file(spark, tmp_path, files):
    for turn in range(3):
        folder = tmp_path / str(turn)
        folder.mkdir()
        _write(folder, files[0], _article(77, f"old {turn}", "2020-02-03"), _article(5, f"first {turn}", "2021-01-01"))
        _write(folder, files[1], _article(77, f"new {turn}", "2024-5-06"), _article(5, f"second {turn}", "2021-01-01"))
        # of one time, the later file wins
        assert _titles(spark, folder) == {"pubmed:77": f"new {turn}", "pubmed:5": f"{'second' if files == (1, 2) else 'first'} {turn}"}


def test_deletions_are_events_in_file_order(spark, tmp_path):
    delete = "<DeleteCitation><PMID>{}</PMID></DeleteCitation>"
    _write(tmp_path, 1, _article(1, "one", "2024-01-02"), _article(2, "two", "2024-01-02"), _article(3, "three", "2024-03-02"), _article(4, "undated"))
    _write(tmp_path, 2, delete.format(1), delete.format(2), _article(2, "two again", "2024-03-02"), delete.format(4))
    _write(tmp_path, 3, _article(1, "one again", "2024-04-02"), delete.format(3))
    assert _titles(spark, tmp_path) == {"pubmed:1": "one again", "pubmed:2": "two again"}
    _write(tmp_path, 4, delete.format(1), delete.format(99))
    assert _titles(spark, tmp_path) == {"pubmed:2": "two again"}


def test_dates_of_articles(spark, tmp_path):
    online = "<ArticleDate DateType='Electronic'><Year>2023</Year><Month>Feb</Month><Day>3</Day></ArticleDate>"
    _write(tmp_path, 1, _article(1, "a", "2024-01-02", online), _article(2, "b", "", online), _article(3, "c", "2024-13-02"))
    assert {r["record_id"]: str(r["updated_at"]) for r in records.pubmed(spark, str(tmp_path)).collect()} == {"1": "2024-01-02 00:00:00", "2": "2023-02-03 00:00:00", "3": "None"}


def test_a_notice_retracts_its_target_and_not_itself(spark, tmp_path):
    items = [
        {"DOI": "10.5555/notice", "title": ["Retraction note"], "update-to": [{"DOI": "https://doi.org/10.5555/X", "type": "Retraction", "label": " Retracted  here"}]},
        {"DOI": "10.5555/x", "title": ["A paper"]},
        {"DOI": "10.5555/fix", "title": ["A correction"], "update-to": [{"DOI": "10.5555/y", "type": "correction", "label": None}]},
        {"DOI": "10.5555/y", "title": ["Another"]},
    ]
    (tmp_path / "cr.json").write_text(json.dumps({"message": {"items": items}}))
    correct = "<CommentsCorrectionsList><CommentsCorrections RefType='{}'><RefSource>J 1</RefSource><PMID>{}</PMID></CommentsCorrections></CommentsCorrectionsList>"
    _write(tmp_path, 1, _article(10, "notice", "2024-01-01", corrections=correct.format("RetractionOf", 11)), _article(11, "named", "2024-01-01"), _article(12, "own", "2024-01-01", corrections=correct.format("RetractionIn", 13)), _article(13, "other", "2024-01-01"))
    rows = records.crossref(spark, str(tmp_path / "cr.json")).unionByName(records.pubmed(spark, str(tmp_path / "pubmed26n0001.xml")))
    told = {r["record_id"]: [tuple(x) for x in r["relations"] or []] for r in rows.collect()}
    assert told["10.5555/notice"] == [("Retraction", "doi", "10.5555/x", "Retracted here")] and told["10"] == [("RetractionOf", "pmid", "11", "J 1")]
    papers = publication.papers(publication.works(publication.current_records(publication.events_of(rows)))).collect()
    assert {r["canonical_key"] for r in papers if r["lifecycle_status"] == "retracted"} == {"doi:10.5555/x", "pubmed:11", "pubmed:12"}
    assert len(papers) == 8
