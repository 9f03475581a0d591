import random
from xml.etree import ElementTree

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.functions import documents, identifiers, text, tristate


def values(spark, raw, f):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    return [r["v"] for r in df.select("i", f(F.col("raw")).alias("v")).orderBy("i").collect()]


CASES = [
    (identifiers.doi, ["https://doi.org/10.1234/ABC", "doi: 10.5555/x.y", " 10.1000/182 ", "10.12/x", "10.1234/", None], ["10.1234/abc", "10.5555/x.y", "10.1000/182", None, None, None]),
    (
        identifiers.arxiv,
        ["https://arxiv.org/abs/2401.01234v2", "arXiv:0704.0001", "1412.12345", "1501.12345", "2413.00001", "hep-th/9901001v3", "hep-th/9107001", "foo/9901001", "2401.00000", "math.GT/0309136", "2401.01234v0"],
        ["2401.01234", "0704.0001", None, "1501.12345", None, "hep-th/9901001", None, None, None, "math.gt/0309136", None],
    ),
    (identifiers.issn, ["0378-5955", "03785955", " 2434-561x", "0378-5954", "abc", "037-85955"], ["0378-5955", None, "2434-561X", None, None, None]),
    (identifiers.orcid, ["https://orcid.org/0000-0002-1825-0097", "0000-0001-5109-3700", "0000-0002-1825-0098", "x"], ["0000-0002-1825-0097", "0000-0001-5109-3700", None, None]),
    (identifiers.pmid, ["https://pubmed.ncbi.nlm.nih.gov/12345678/", "PMID: 42", "0", "x"], ["12345678", "42", None, None]),
    (identifiers.pmcid, ["pmcid: pmc123", "PMC0"], ["PMC123", None]),
    (identifiers.openalex_work, ["https://openalex.org/W123", "w9", "A9"], ["W123", "W9", None]),
    (identifiers.github_repository, ["https://github.com/Example-Org/agent.git", "http://www.github.com/a/b/tree/x", "https://github.com.evil/a/b", "https://github.com/a"], ["https://github.com/example-org/agent", "https://github.com/a/b", None, None]),
    (text.slug, ["Machine  Learning!", "--A--", ""], ["machine-learning", "a", ""]),
    (text.trim_space, [" \t a b  "], ["a b"]),
    (text.collapse_space, [" a \n\t b c "], ["a b c"]),
    (text.month_number, ["Jan", "december", "7", "13", "x"], [1, 12, 7, None, None]),
]


@pytest.mark.parametrize(("f", "raw", "expected"), CASES)
def test_normal_forms(spark, f, raw, expected):
    assert values(spark, raw, f) == expected


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=40))
def test_doi_is_stable(spark, raw):
    raw = [r.replace("\x00", "") for r in raw] + ["10.1234/" + r.replace("\x00", "") for r in raw]
    once = values(spark, raw, identifiers.doi)
    assert values(spark, once, identifiers.doi) == once


def test_identity_precedence_and_conflict(spark):
    df = spark.createDataFrame([(["10.1/x", None], ["2401.01234"]), ([], ["2401.01234"]), (["a", "b"], []), ([], [])], "doi array<string>, arxiv array<string>")
    rows = df.select(identifiers.canonical_identity({"doi": F.col("doi"), "arxiv": F.col("arxiv")}).alias("i")).collect()
    assert [tuple(r["i"]) for r in rows] == [("doi", "10.1/x", False), ("arxiv", "2401.01234", False), ("doi", "a", True), (None, None, False)]


def test_cohort_key_and_inverted_index(spark):
    row = spark.range(1).select(
        text.cohort_key(F.lit("machine-learning"), F.lit("2026-07"), F.lit("research_article")).alias("k"),
        text.inverted_index_text(F.expr("map('Tides', array(0), 'the', array(2), 'turn', array(1, 4), 'moon', array(3))")).alias("whole"),
        text.inverted_index_text(F.expr("map('a', array(0), 'b', array(2))")).alias("gap"),
        text.inverted_index_text(F.expr("map('a', array(0), 'b', array(0))")).alias("twice"),
        text.partial_date(F.lit(2026), F.lit(2), F.lit(30)).alias("unreal"),
        text.partial_date(F.lit(2026), F.lit(7), F.lit(None).cast("int")).alias("month"),
    ).first()
    assert row["k"] == "t16:machine-learningm7:2026-07p16:research_article"
    assert (row["whole"], row["gap"], row["twice"]) == ("Tides turn the moon turn", None, None)
    assert row["unreal"]["precision"] == row["month"]["precision"] == "month" and row["month"]["at"] is None


def test_tri_state(spark):
    df = spark.createDataFrame([("known", True), ("known", False), ("unknown", None)], "x_state string, x_value boolean")
    assert df.where(tristate.equals("x", True)).count() == df.where(tristate.equals("x", False)).count() == 1
    assert df.where(tristate.consistent("x")).count() == 3
    assert spark.createDataFrame([("known", True), ("known", None)], df.schema).agg(*tristate.ratio("x")).first()["x_ratio_state"] == "unknown"
    share = lambda d: d.agg(*tristate.ratio("x")).first()["x_ratio_state"]
    assert (share(df), share(df.limit(0)), share(df.where("x_state = 'known'")), share(df.where("x_state = 'missing'"))) == ("unknown", "unknown", "known", "unknown")


def test_marked_up_abstracts_equal_an_xml_parser(spark):
    r = random.Random(2)

    def piece(depth):
        if depth > 4 or r.random() < 0.4:
            return r.choice(["a  b", " x ", "1 &lt; 2 &amp;&#x2013;", "&#233;\n", "<![CDATA[<raw> & ]]>", "&quot;q&apos;", "😀 &#x1F600;"])
        name = r.choice(["p", "sec", "title", "bold", "italic", "list-item", "sup"])
        if r.random() < 0.1:
            return f"<jats:{name} a='1'/>"
        return f"<jats:{name} id=\"x>y\">{''.join(piece(depth + 1) for _ in range(r.randint(0, 3)))}</jats:{name}>"

    def text(e):
        gap = " " if e.tag in documents.JATS_BLOCKS else ""
        return gap + (e.text or "") + "".join(text(c) + (c.tail or "") for c in e) + gap

    texts = [f"<jats:p>{''.join(piece(1) for _ in range(r.randint(1, 4)))}</jats:p>" for _ in range(150)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", documents.marked_text(F.col("t")).alias("m")).collect()
    for row in rows:
        assert row["m"]["problem"] is None
        assert row["m"]["text"] == " ".join(text(ElementTree.fromstring(row["t"].replace("jats:", ""))).split())


def test_abstracts_that_are_not_well_formed_have_no_text(spark):
    deep = "<jats:sec>" * 64 + "x" + "</jats:sec>" * 64
    cases = {
        "1 < 2 and 3 > 2": ("1 < 2 and 3 > 2", None), " a &amp;  b\n": ("a &amp; b", None), "": ("", None), deep: ("x", None),
        f"<jats:p>{deep}</jats:p>": (None, "depth"), "<jats:p>" + "<jats:bold/>" * 9_999 + "</jats:p>": ("", None), "<jats:p>" + "<jats:bold/>" * 10_000 + "</jats:p>": (None, "elements"),
        "<jats:p>" + "x" * (1 << 20) + "</jats:p>": ("x" * (1 << 20), None), "<jats:p>" + "x" * ((1 << 20) + 1) + "</jats:p>": (None, "text_bytes"),
        "<jats:p>a": (None, "incomplete"), "<jats:p>a</jats:sec>": (None, "nesting"), "<jats:p>a</jats:p></jats:p>": (None, "nesting"), "<jats:p>a</jats:p> b": (None, "outside"),
        "<jats:p>a</jats:p> <jats:p>b</jats:p>": ("a b", None), "<p>a</p>": (None, "element"), "<jats:p><b>a</b></jats:p>": (None, "element"), "<jats:bold>a</jats:bold>": (None, "root"),
        "<jats:p>a<!-- c --></jats:p>": (None, "markup"), "<?x?><jats:p>a</jats:p>": (None, "markup"), "<jats:p>a &nbsp; b</jats:p>": (None, "entity"), "<jats:p>&#0;</jats:p>": (None, "entity"),
        "<jats:p>&#xD800;</jats:p>": (None, "entity"), "<jats:p>a & b</jats:p>": (None, "entity"), "<jats:p>a < b</jats:p>": (None, "syntax"), "<jats:p id=x>a</jats:p>": (None, "syntax"), "<jats:p>a ]]> b</jats:p>": (None, "syntax"),
        '<p xmlns="http://www.ncbi.nlm.nih.gov/JATS1">a<bold>b</bold></p>': ("ab", None), "<x:p xmlns:x='http://jats.nlm.nih.gov'>a</x:p>": ("a", None), "<x:p xmlns:x='http://other'>a</x:p>": (None, "element"),
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", documents.marked_text(F.col("t")).alias("m")).collect()
    assert {r["t"][:60]: tuple(r["m"]) for r in rows} == {t[:60]: told for t, told in cases.items()}
    assert spark.sql("select cast(null as string) as t").select(documents.marked_text(F.col("t")).alias("m")).first()["m"] is None
