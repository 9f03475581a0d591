import random
import re
from collections import Counter, defaultdict

import numpy as np

from folioscope.llm import families, minhash
from folioscope.llm.queries import op1_minhash_dedup


def shingles(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return set()
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))}


def brute(rows, words, percent):
    """(size, component, kept) of each id by comparing all that share a shingle."""
    sets = {i: shingles(t, words) for i, t in rows}
    holders, parent = defaultdict(list), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in holders[g] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def brute_ids(rows, words, percent):
    """Sorted (id, size, component, kept) of rows whose ids may have several texts."""
    sets = [shingles(t, words) for _, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b, (j, _) in enumerate(rows[:a]):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return sorted((i, len(s), root(i), root(i) == i) for (i, _), s in zip(rows, sets, strict=True))


def results(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_query_equals_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert results(op1_minhash_dedup(spark, sf)) == brute(rows, 3, 85)


def test_hot_group_in_many_units(spark, monkeypatch):
    """A large group of copies, near copies of all degrees, and blocks so small that they split."""
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 600)
    monkeypatch.setattr(minhash, "STAR", 7)
    monkeypatch.setattr(families, "MEMBERS", 5)
    random.seed(3)
    words = [f"w{i}" for i in range(3000)]
    origin = random.choices(words, k=80)
    rows = []
    for i in range(240):
        text = list(origin)
        for _ in range(random.choice([0, 0, 1, 2, 3, 5])):
            text[random.randrange(80)] = random.choice(words)
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join(random.choices(words, k=60))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert results(minhash.near_duplicates(df, words=3, percent=85)) == brute(rows, 3, 85)


def test_odd_rows(odd, none):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == 10
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows}
    assert got[1] == (6, 1, True) and got[2] == (6, 1, False)
    assert got[3] == (0, 3, True) and got[4] == (0, 4, True) and got[5] == (0, 5, True)
    assert got[6] == (4, 6, True) and got[8] == (1, 8, True)
    assert got[None][1:] == (None, False)
    assert minhash.near_duplicates(none).count() == 0


def test_shared_counts_equal_sets():
    random.seed(1)
    sets = [np.unique(np.array(random.choices(range(40), k=k), dtype=np.int64)) for k in (0, 1, 7, 30, 30, 12)]
    expected = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    owner = np.repeat(np.arange(12), [len(s) for s in sets] * 2)
    assert minhash.shared_counts(owner, np.concatenate(sets + sets), 6, 6, step=8).tolist() == expected


def test_signature_values_estimate_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 1150).astype(np.uint64)
    a, b = np.sort(pool[:1000]), np.sort(pool[150:])
    keys = minhash.signatures(np.concatenate([a, b]), np.array([0, 1000, 2000]), 200, 1)
    assert abs((keys[0] == keys[1]).mean() - 850 / 1150) < 0.1


def test_words_that_collide_under_polynomial_hashes_stay_apart(spark):
    """Thue-Morse words and their complements have equal polynomial hashes modulo 2**64."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, other), (3, f"{word} x y z"), (4, f"{other} x y z"), (5, word)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert results(minhash.near_duplicates(df, words=3, percent=85)) == brute(rows, 3, 85)


def test_shingles_with_one_equal_hash_count_apart():
    a = np.array([5, 5, 7, 5], dtype=np.uint64)
    b = np.array([1, 2, 1, 1], dtype=np.uint64)
    code = minhash.codes((a, b))
    assert code[0] == code[3] and len(set(code.tolist())) == 3


def test_short_hashes_are_told_apart_by_the_second_one(monkeypatch):
    """With the first hash cut to two bits, sets stay the same."""
    real = minhash.textscan.span_hashes
    texts = [t.encode() for t in ("a b c d e f g h a b c d", "one", "", "p q r s t u v w x y z p q")]
    sizes = np.diff(minhash.shingle_sets(texts, 3)[2]).tolist()
    monkeypatch.setattr(minhash.textscan, "span_hashes", lambda d, b, n, seed=0: real(d, b, n, seed) & np.uint64(3 if seed == 1 else 2**64 - 1))
    assert np.diff(minhash.shingle_sets(texts, 3)[2]).tolist() == sizes == [len(shingles(t.decode(), 3)) for t in texts]


def test_joining_keeps_components_with_few_pairs():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 300, 250), rng.integers(0, 300, 250)
    p, q = families.joining(a, b)

    def roots(x, y):
        parent = list(range(300))
        find = lambda i: i if parent[i] == i else find(parent[i])
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            i, j = find(i), find(j)
            parent[max(i, j)] = min(i, j)
        return [find(i) for i in range(300)]

    assert roots(a, b) == roots(p, q) and len(p) < 300


def test_meeting_slots_drop_lone_keys(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 6)], "node long, key long")
    assert {r["node"] for r in families.meeting_slots(df).collect()} == {1, 2}


def test_bands_keep_their_bounds():
    for percent, shape in ((85, (53, 9)), (80, (76, 8))):
        bands, rows = minhash.banding(percent)
        shared = lambda s: 1 - (1 - s**rows) ** bands  # noqa: E731, B023
        assert (bands, rows) == shape
        assert 1 - shared(percent / 100) <= 1e-6 and shared(percent / 100 - 0.35) <= 0.125
    assert minhash.banding(100)[0] == 1 and minhash.banding(20)[1] >= 1


def test_no_text_of_an_id_is_lost(spark):
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(200)) for k in "abcd")
    rows = [(1, a), (1, b), (2, b + " tail"), (5, c), (5, d), (3, d), (7, ""), (7, c + " end"), (9, None)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found) == brute_ids([*rows], 3, 85)
    assert {r["doc_id"]: r["component_id"] for r in found} == {1: 1, 2: 1, 3: 3, 5: 3, 7: 3, 9: 9}


def test_repeated_ids_equal_brute_force(spark):
    random.seed(11)
    words = [f"w{i}" for i in range(400)]
    origins = [random.choices(words, k=60) for _ in range(25)]
    rows = []
    for _ in range(300):
        text = list(random.choice(origins))
        for _ in range(random.choice([0, 0, 1, 2, 4])):
            text[random.randrange(60)] = random.choice(words)
        rows.append((random.randrange(200), random.choice([" ".join(text), " ".join(text), " ".join(random.choices(words, k=40)), "", None])))
    rows += rows[:20]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), words=3, percent=85).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found) == brute_ids(rows, 3, 85)
