import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from folioscope.llm.queries import op8_pii
from tests.llm.test_minhash import brute
from tests.llm.test_mixing import brute as mixed_by_hand


def test_stages_on_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        out = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        stage(spark, docs, sf).write.mode("overwrite").parquet(out)
        before, docs = docs, spark.read.parquet(out)
        held[name] = (before, docs)
        if name != "bpe_encode":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    before, after = held["language_id"]
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect() if re.search(r"[^\W\d_]", r["text"] or "")}
    before, after = held["minhash_dedup"]
    expected = brute([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80)
    assert {r["doc_id"] for r in after.collect()} == {i for i, x in expected.items() if x[2]}
    before, after = held["pii"]
    old = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.collect():
        assert r["n_chars"] == len(r["text"])
        assert r["text"] == old[r["doc_id"]] or re.search("<[A-Z_]+>", r["text"])
        assert "@mail" not in r["text"]
    before, after = held["source_mixing"]
    taken = Counter(i for i, *_ in mixed_by_hand(before))
    assert Counter(r["doc_id"] for r in after.collect()) == taken and set(taken) == {r["doc_id"] for r in before.collect()}
    assert {tuple(r) for r in after.collect()} == {tuple(r) for r in before.collect()}
    before, after = held["bpe_encode"]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = []
    for r in before.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        expected.append((r["doc_id"], len(ids), np.array(ids, dtype="<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert sorted((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in after.collect()) == sorted(expected)


def test_run_gives_the_last_stage(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "n_tokens", "ids", "decoded"]


def test_clean_documents_at_the_edges_stay(spark):
    """Rows without ids, with one id and several texts, repeated rows, and no language at all."""
    rows = [(1, "a clean text about trees and rivers", None, "s", 35), (1, "another text under the same id", None, "s", 30), (2, "repeated row of words", None, "s", 21), (2, "repeated row of words", None, "s", 21), (None, "no id but clean", None, "s", 15), (None, "no id but clean", None, None, 15), (3, "12 34", None, "s", 5), (4, "a clean text about trees and rivers", None, "t", 35)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.known_language(spark, docs, "")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted((i or 0, t) for i, t, *_ in rows if t != "12 34")
    one = sorted((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect())
    assert one == sorted([(1, rows[0][1]), (1, rows[1][1]), (2, rows[2][1]), (0, rows[4][1]), (0, rows[4][1]), (3, "12 34")])


def test_the_pii_stage_equals_brute_force(spark, sf):
    """Texts with the spans of op8 (tested against plain Python) replaced, run by run."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    after = {r["doc_id"]: r for r in corpus_pipeline.without_personal_data(spark, docs, sf).collect()}
    found = {r["doc_id"]: r["spans"] for r in op8_pii(spark, sf).collect()}
    for r in docs.collect():
        expected, at = "", 0
        for span in filter(None, found[r["doc_id"]].split(",")):
            kind, start, end = span.split(":")
            if int(start) >= at:
                expected += f"{r['text'][at:int(start)]}<{kind.upper()}>"
            at = max(at, int(end))
        expected += (r["text"] or "")[at:]
        got = after[r["doc_id"]]
        assert (got["text"] or "") == expected and got["n_chars"] == len(expected)
        assert (got["lang"], got["source"]) == (r["lang"], r["source"])


def test_no_near_duplicate_of_a_second_text_stays(spark):
    """Rows that share an id, one of which another document repeats."""
    a, b = (" ".join(f"{k}{i}" for i in range(200)) for k in "ab")
    rows = [(1, a, "en", "s", 9), (1, b, "en", "s", 9), (2, b + " tail", "en", "s", 9), (3, "an own text of some words more", "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()) == sorted((i, t) for i, t, *_ in rows if i != 2)


def test_the_language_stage_rejects_junk(spark):
    """Rejection at work: junk and an unlearned script go, clean documents stay, with or without a language."""
    r = random.Random(4)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*corpus_pipeline.COLUMNS)
    letters = ["bcdfghjklmnpqrstvwxz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"]
    junk = [(10**6 + k, " ".join("".join(r.choice(letters[k % 3]) for _ in range(r.randint(2, 9))) for _ in range(300)), None, "junk", 1) for k in range(12)]
    kept = corpus_pipeline.known_language(spark, docs.union(spark.createDataFrame(junk, docs.schema)), "").collect()
    assert not {k for k, *_ in junk} & {x["doc_id"] for x in kept}
    clean = {x["doc_id"] for x in docs.collect() if re.search(r"[^\W\d_]", x["text"] or "")}
    assert len(clean - {x["doc_id"] for x in kept}) <= len(clean) // 200 and all(x["lang"] for x in kept)
