import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from folioscope.llm import bpe, textscan
from folioscope.llm.bpecodec import Encoder, decode, encode_decode
from folioscope.llm.queries import op4_token_counts, op6_bpe_codec
from folioscope.llm.tokencount import PieceCounter, count_tokens

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def bytes_library():
    return Tokenizer.from_file(BYTES)


@pytest.fixture(scope="module")
def words_library():
    return Tokenizer.from_file(WORDS)


def texts(n):
    random.seed(7)
    alphabet = [*"aabZ 's't're've'll'd'm\n\t 12!?.,'’éÉΣσİ\u0085　漢字٣½", "<|endoftext|>", "<|startoftext|>", "'LL", " \n", "\U0001f600", "é", "\x1c"]
    return ["".join(random.choices(alphabet, k=random.randint(0, 40))) for _ in range(n)]


def test_counts_equal_the_library(bytes_library):
    sample = texts(2000)
    assert PieceCounter(bpe.load(BYTES)).count(sample).tolist() == [len(bytes_library.encode(t, add_special_tokens=False).ids) for t in sample]


def test_ids_and_decoded_text_equal_the_library(words_library):
    sample = texts(2000)
    ids, decoded = Encoder(bpe.load(WORDS)).encode(sample)
    expected = [words_library.encode(t, add_special_tokens=False).ids for t in sample]
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == expected
    assert [d.decode() for d in decoded] == [words_library.decode(x, skip_special_tokens=False) for x in expected]


def test_memory_is_bounded_without_changing_results(words_library, monkeypatch):
    from folioscope.llm import bpecodec, tokencount

    monkeypatch.setattr(bpecodec, "REMEMBERED", 5)
    monkeypatch.setattr(tokencount, "REMEMBERED", 5)
    encoder, sample = Encoder(bpe.load(WORDS)), texts(60)
    encoder.number.limit = 5
    got = [np.frombuffer(encoder.encode([t])[0][0], "<u4").tolist() for t in sample]
    assert got == [words_library.encode(t, add_special_tokens=False).ids for t in sample]


def test_equal_hashes_of_different_words_change_nothing(bytes_library, words_library, monkeypatch):
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    sample = [word, word.translate(str.maketrans("ab", "ba")), *texts(300), "y" * 70 + " " + "z" * 70, "y" * 70]
    real = textscan.span_hashes
    for bits in (64, 8, 1):
        monkeypatch.setattr(textscan, "span_hashes", lambda *a, bits=bits: real(*a) & np.uint64(2**bits - 1))
        counter, encoder = PieceCounter(bpe.load(BYTES)), Encoder(bpe.load(WORDS))
        for part in (sample[:100], sample[100:], sample):
            assert counter.count(part).tolist() == [len(bytes_library.encode(t, add_special_tokens=False).ids) for t in part]
            ids = encoder.encode(part)[0]
            assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [words_library.encode(t, add_special_tokens=False).ids for t in part]


def test_blocks_cover_all_texts():
    assert list(textscan.blocks(np.array([5, 1, 1, 9, 1]), 6)) == [(0, 2), (2, 3), (3, 4), (4, 5)]
    assert list(textscan.blocks(np.array([], dtype=int))) == []


def test_odd_rows(odd, none, bytes_library, words_library):
    rows = count_tokens(odd, BYTES).collect()
    assert len(rows) == 10
    by_text = {r["doc_id"]: r for r in odd.collect()}
    for r in rows:
        text = by_text[r["doc_id"]]["text"] or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(bytes_library.encode(text, add_special_tokens=False).ids))
    for r in encode_decode(odd, WORDS).collect():
        ids = words_library.encode(by_text[r["doc_id"]]["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == ids and r["n_tokens"] == len(ids)
    assert count_tokens(none, BYTES).count() == encode_decode(none, WORDS).count() == 0


def test_decode_is_the_inverse_view(odd):
    coded = encode_decode(odd, WORDS)
    rows = decode(coded.withColumnRenamed("decoded", "expected"), WORDS).collect()
    assert all(r["decoded"] == r["expected"] for r in rows)


def test_queries_equal_the_library_on_whole_tables(spark, sf, bytes_library, words_library):
    documents = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    counted = {r["doc_id"]: r for r in op4_token_counts(spark, sf).collect()}
    coded = {r["doc_id"]: r for r in op6_bpe_codec(spark, sf).collect()}
    assert counted.keys() == coded.keys() == documents.keys()
    for i, text in documents.items():
        n = len(bytes_library.encode(text, add_special_tokens=False).ids)
        assert (counted[i]["n_tokens"], counted[i]["over_limit"], counted[i]["n_bytes"]) == (n, n > 1024, len(text.encode()))
        ids = words_library.encode(text, add_special_tokens=False).ids
        assert coded[i]["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert coded[i]["decoded_sha256"] == hashlib.sha256(words_library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
