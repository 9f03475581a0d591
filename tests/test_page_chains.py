import json
import os

import pytest

from folioscope.operators.ranking import summed_before
from folioscope.sources.page_chains import Chains


def work(k):
    return {"id": f"https://openalex.org/W{k}", "title": f"work {k}"}


def paper(k):
    return {"DOI": f"10.5555/{k}", "title": [f"paper {k}"]}


def put(folder, chain, page, body, name="part-0.json"):
    at = f"{folder}/chain={chain}/page={page}"
    os.makedirs(at, exist_ok=True)
    with open(f"{at}/{name}", "w") as f:
        f.write(body if isinstance(body, str) else json.dumps(body))


def alex(items, cursor=None):
    return {"meta": {"next_cursor": cursor}, "results": items}


def cross(items, cursor=None):
    return {"message": {"items": items, "next-cursor": cursor}}


def verdicts(chains):
    return {r["chain"]: tuple(r[c] for c in ("pages", "items", "page", "item", "problem")) for r in chains.verdicts().collect()}


def ordinals(chains):
    out = {}
    for r in sorted(chains.items().collect(), key=lambda r: (r["chain"], r["ordinal"])):
        out.setdefault(r["chain"], []).append((r["ordinal"], json.loads(r["raw"])["id"].rsplit("W")[-1]))
    return out


@pytest.fixture(scope="module")
def openalex(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("openalex"))
    put(folder, "good", 1, alex([work(1), work(2)], "a"))
    put(folder, "good", 2, alex([work(3)], "b"))
    put(folder, "good", 3, alex([], None))
    put(folder, "cut", 1, alex([work(1)], "a"))
    put(folder, "cut", 2, '{"meta": {"next_cursor": null}, "results": [{"id": "https')
    put(folder, "item", 1, alex([work(1)], "a"))
    put(folder, "item", 2, alex([work(2), {"id": "nothing"}, work(3)], "b"))
    put(folder, "item", 3, alex([work(4)]))
    put(folder, "repeat", 1, alex([work(1)], "a"))
    put(folder, "repeat", 2, alex([work(2)], "b"))
    put(folder, "repeat", 3, alex([work(3), work(4)], "a"))
    put(folder, "repeat", 4, alex([work(5)]))
    put(folder, "start", 1, alex([work(1)], "*"))
    put(folder, "empty", 1, alex([work(1)], "a"))
    put(folder, "empty", 2, alex([], "b"))
    put(folder, "behind", 1, alex([work(1)], ""))
    put(folder, "behind", 2, alex([work(2)]))
    put(folder, "gap", 1, alex([work(1)], "a"))
    put(folder, "gap", 3, alex([work(2)]))
    put(folder, "late", 2, alex([work(2)]))
    put(folder, "twice", 1, alex([work(1)], "a"))
    put(folder, "twice", 2, alex([work(2)]), "part-0.json")
    put(folder, "twice", 2, alex([work(3)]), "part-1.json")
    put(folder, "no_list", 1, '{"error": "quota"}')
    return Chains(spark, folder, "openalex")


def test_where_chains_stop(openalex):
    assert verdicts(openalex) == {
        "good": (3, 3, None, None, None),
        "cut": (2, 1, 2, 0, "page"),
        "item": (3, 2, 2, 2, "id"),
        "repeat": (4, 4, 3, 3, "cursor repeated"),
        "start": (1, 1, 1, 2, "cursor repeated"),
        "empty": (2, 1, 2, 0, "empty page"),
        "behind": (2, 1, 2, 0, "page after the end"),
        "gap": (2, 1, 3, 0, "page missing"),
        "late": (1, 0, 2, 0, "page missing"),
        "twice": (2, 1, 2, 0, "page given twice"),
        "no_list": (1, 0, 1, 0, "page"),
    }


def test_what_comes_before_is_delivered(openalex):
    got = ordinals(openalex)
    assert got == {
        "good": [(1, "1"), (2, "2"), (3, "3")], "cut": [(1, "1")], "item": [(1, "1"), (2, "2")], "repeat": [(1, "1"), (2, "2"), (3, "3"), (4, "4")], "start": [(1, "1")],
        "empty": [(1, "1")], "behind": [(1, "1")], "gap": [(1, "1")], "twice": [(1, "1")],
    }
    assert {chain: len(rows) for chain, rows in got.items()} == {chain: v[1] for chain, v in verdicts(openalex).items() if v[1]}
    assert sorted(r["title"] for r in openalex.records().where("record_id = 'W3'").collect()) == ["work 3", "work 3"]


def test_lists_that_a_short_page_ends(spark, tmp_path):
    folder = str(tmp_path)
    put(folder, "good", 1, cross([paper(1), paper(2)], "a"))
    put(folder, "good", 2, cross([paper(3)], "a"))
    put(folder, "exact", 1, cross([paper(1), paper(2)], "a"))
    put(folder, "exact", 2, cross([], None))
    put(folder, "missing", 1, cross([paper(1), paper(2)]))
    put(folder, "blank", 1, cross([paper(1), paper(2)], " \t "))
    put(folder, "duplicate", 1, cross([paper(1), paper(2)], "r"))
    put(folder, "duplicate", 2, cross([paper(3), paper(4)], "r"))
    put(folder, "behind", 1, cross([paper(1)], "a"))
    put(folder, "behind", 2, cross([paper(2)]))
    chains = Chains(spark, folder, "crossref", full=2)
    assert verdicts(chains) == {
        "good": (2, 3, None, None, None),
        "exact": (2, 2, None, None, None),
        "missing": (1, 2, 1, 3, "no cursor"),
        "blank": (1, 2, 1, 3, "no cursor"),
        "duplicate": (2, 4, 2, 3, "cursor repeated"),
        "behind": (2, 1, 2, 0, "page after the end"),
    }
    assert chains.records().count() == 14


def test_sizes_and_places_are_told_apart(spark, tmp_path):
    for source, full in (("openalex", 2), ("crossref", None), ("crossref", 0), ("pubmed", None)):
        with pytest.raises(ValueError):
            Chains(spark, str(tmp_path), source, full)
    os.makedirs(f"{tmp_path}/chain=a b/page=1")
    put(str(tmp_path), "a b", 1, alex([work(1)]))
    with pytest.raises(Exception, match="isn't in a chain"):
        Chains(spark, str(tmp_path), "openalex")


def test_sums_before_a_row(spark):
    rows = [("a" if i % 3 else "b", i, i % 5) for i in range(900)] + [(None, 1, 7), (None, 2, 1)]
    got = {(r["k"], r["i"]): r["s"] for r in summed_before(spark.createDataFrame(rows, "k string, i int, v int").repartition(5), ["k"], ["i"], "v", "s").collect()}
    assert got == {(k, i): sum(v for o, j, v in rows if o == k and j < i) for k, i, _ in rows}
