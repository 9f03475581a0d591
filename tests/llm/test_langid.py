import base64
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from folioscope.llm import langid, textscan
from folioscope.llm.queries import held_out, op2_language_id

LETTERLESS = {3, 4, 5}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op2_language_id(spark, sf).collect()
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    held = [r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in rows if r["held_out"]]
    assert sum(held) / len(held) > 0.98
    assert not any(r["rejected"] for r in rows if truth[r["doc_id"]]["n_chars"] > 200 and r["lang_pred"] == truth[r["doc_id"]]["lang"] and r["score"] > 0.5)


def plain_counts(text):
    """Hashed n-grams by a loop over characters."""
    classes, out = textscan.character_classes(), np.zeros(langid.DIMENSIONS)
    symbols = [c if classes[ord(c)] == textscan.LETTER else " " for c in text.lower() + " "]
    for i, c in enumerate(symbols):
        b = symbols[i - 1] if i else " "
        a = symbols[i - 2] if i > 1 else " "
        for n, gram in ((1, c), (2, b + c), (3, a + b + c)):
            if (n == 1 and c != " ") or (n == 2 and gram != "  ") or (n == 3 and b != " "):
                value = sum(ord(x) << 21 * k for k, x in enumerate(reversed(gram)))
                out[int(textscan.mix(np.array([value * 4 + n], dtype=np.uint64))[0] % np.uint64(langid.DIMENSIONS))] += 1
    return out


def test_query_equals_nearest_centroid_by_plain_loops(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    rows = documents.collect()
    train = [r for r in rows if r["lang"] and r["text"] and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]
    counts = {r["doc_id"]: plain_counts(r["text"] or "") for r in rows}
    having = sum((counts[r["doc_id"]] > 0).astype(int) for r in train if counts[r["doc_id"]].any())
    idf = np.log((1 + sum(counts[r["doc_id"]].any() for r in train)) / (1 + having)) + 1
    model = langid.fit(documents.where(held_out() == F.lit(False)))
    assert np.allclose(model.idf, idf, rtol=1e-5) and set(model.labels) == {r["lang"] for r in train}
    texts = {r["doc_id"]: r["text"] or "" for r in rows}
    for r in op2_language_id(spark, sf).collect():
        v = np.log1p(counts[r["doc_id"]]) * idf
        letters = sum(textscan.character_classes()[ord(c)] == textscan.LETTER for c in texts[r["doc_id"]].lower())
        if not letters:
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        cosine = model.centroids.astype(float) @ v / np.linalg.norm(v)
        assert abs(r["score"] - cosine.max()) < 1e-4 and cosine[[n == r["lang_pred"] for n in model.labels]].max() > cosine.max() - 1e-5


def test_every_label_is_learned(spark):
    df = spark.createDataFrame([(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)} " * 5, f"l{i:03d}") for i in range(300)], "doc_id long, text string, lang string")
    assert len(set(langid.fit(df).labels)) == 300


def test_far_texts_are_rejected(spark):
    df = spark.createDataFrame([(i, "the cat and the dog went over there with another one " * 3, "en") for i in range(20)], "doc_id long, text string, lang string")
    model = langid.fit(df)
    (near, far) = model.predict(["the dog went over there with the cat and another", "жщъы хцчш эюя " * 20])
    assert near[0] == "en" and not near[2] and far[2]


def test_odd_rows(odd, none):
    model = langid.fit(odd)
    rows = langid.identify(odd, model).collect()
    assert len(rows) == 10 and set(rows[0].asDict()) == {*odd.columns, "lang_pred", "rejected"}
    for r in rows:
        if r["doc_id"] in LETTERLESS:
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
        else:
            assert r["lang_pred"] in ("en", "fr")
    assert langid.identify(none, model).count() == 0
    blank = langid.fit(none)
    for r in langid.identify(odd, blank).collect():
        assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, r["doc_id"] in LETTERLESS)


def test_junk_and_unlearned_languages_are_rejected_at_any_length(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(documents.where("doc_id % 2 = 0"))
    r = random.Random(7)

    def words(letters, n):
        return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 9))) for _ in range(n))

    latin, cyrillic, greek = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"
    junk = [words(a, n) for a in (latin, "bcdfghjklmnpqrstvwxz", cyrillic, greek) for n in (20, 300, 1500, 10_000)]
    junk += [base64.b64encode(r.randbytes(n)).decode() for n in (150, 2250, 30_000)]
    for text in (
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. ",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler. ",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. ",
    ):
        junk += [text, text * 40]
    assert [t[:30] for t, found in zip(junk, model.predict(junk), strict=True) if not found[2]] == []
    clean = [r["text"] for r in documents.where("doc_id % 2 = 1").collect() if re.search(r"[^\W\d_]", r["text"] or "")]
    assert sum(found[2] for found in model.predict(clean)) <= len(clean) // 200
