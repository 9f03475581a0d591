import random
import re
from decimal import ROUND_HALF_UP, Context, Decimal

from pyspark.sql import functions as F

from folioscope.functions import exact

WIDE = Context(prec=120)


def rounded(n, d):
    return format(WIDE.divide(Decimal(n), Decimal(d)).quantize(Decimal(1).scaleb(-18), ROUND_HALF_UP, WIDE), "f")


def same(mine, theirs):
    return mine == theirs or (Decimal(mine) == 0 and Decimal(theirs) == 0)


def test_quotients_of_38_digits(spark):
    rng = random.Random(5)
    number = lambda: rng.choice((-1, 1)) * rng.randrange(10 ** rng.randint(1, 38))
    pairs = [(number(), number() or 1) for _ in range(400)]
    pairs += [(10**38 - 1, 1), (10**38 - 1, 10**38 - 1), (1, 10**38 - 1), (-1, 3), (2, 3), (0, -5), (5, 10**19), (4, 10**19), (-5, 10**19), (10**18 * 2 - 1, 2 * 10**18), (1999999999999999999, 2 * 10**18), (9999999999999999999, 10**19)]
    df = spark.createDataFrame([(i, str(n), str(d)) for i, (n, d) in enumerate(pairs)], "i int, n string, d string")
    n, d = F.col("n").cast("decimal(38,0)"), F.col("d").cast("decimal(38,0)")
    for r in df.select("i", exact.quotient_text(n, d).alias("q"), exact.quotient(n, d).alias("x")).collect():
        expected = rounded(*pairs[r["i"]])
        assert same(r["q"], expected), pairs[r["i"]]
        if abs(Decimal(expected)) < 10**20:
            assert r["x"] == Decimal(expected), pairs[r["i"]]
        else:
            assert r["x"] is None


def test_quotients_of_nothing(spark):
    df = spark.createDataFrame([(None, 1), (1, None), (1, 0), (None, None)], "n long, d long")
    assert [tuple(r) for r in df.select(exact.quotient_text(F.col("n"), F.col("d")), exact.quotient(F.col("n"), F.col("d"))).collect()] == [(None, None)] * 4
    assert df.limit(0).select(exact.quotient_text(F.col("n"), F.col("d"))).collect() == []


def test_decimals_as_text(spark):
    rng = random.Random(6)
    texts = ["0", "00", "0.0", "10", "10.", ".5", "1e3", "-1", "+1", " 7.50 ", "", None, "1.2.3", "9" * 60, "0." + "0" * 60 + "1", "1,5"]
    texts += [f"{'0' * rng.randint(0, 2)}{rng.randrange(30)}.{rng.randrange(30):02d}{'0' * rng.randint(0, 3)}" for _ in range(40)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(texts)], "i int, v string")
    text = dict(df.select("i", exact.decimal_text(F.col("v"))).collect())
    for i, v in enumerate(texts):
        valid = v is not None and re.fullmatch(r"[0-9]+(\.[0-9]+)?", v.strip())
        if not valid:
            assert text[i] is None, v
            continue
        shortest = format(Decimal(v.strip()), "f")
        shortest = shortest.rstrip("0").rstrip(".") if "." in shortest else shortest
        assert text[i] == shortest, v
    a, b = df.select(F.col("v").alias("x")), df.select(F.col("v").alias("y"))
    x, y = exact.decimal_order(F.col("x")), exact.decimal_order(F.col("y"))
    for r in a.join(b, F.lit(True)).where(x.isNotNull() & y.isNotNull()).select("x", "y", (x < y).alias("less"), (x == y).alias("same")).collect():
        left, right = Decimal(r["x"].strip()), Decimal(r["y"].strip())
        assert (r["less"], r["same"]) == (left < right, left == right), (r["x"], r["y"])


def test_quotients_by_chunks_of_digits(spark):
    rng = random.Random(8)
    ends = [10**k + j for k in (1, 10, 14, 19, 20, 23) for j in (-1, 0, 1)] + [10**24 - 1]
    pairs = [(a * 10**14 + b, d) for d in ends for a, b in ((0, 1), (10**23, 10**14 - 1), (rng.randrange(10**24), rng.randrange(10**14)))]
    # rounding that carries over all chunks
    pairs += [(10**24 - 2, 10**24 - 1), (2 * 10**20 - 1, 2 * 10**20), (10**37 - 1, 10**20), (10**38 - 1, 10**24 - 1), (10**38 - 1, 1)]
    df = spark.createDataFrame([(i, str(n), str(d)) for i, (n, d) in enumerate(pairs)], "i int, n string, d string")
    n, d = F.col("n").cast("decimal(38,0)"), F.col("d").cast("decimal(38,0)")
    for r in df.select("i", exact._by_chunks(n, d).alias("c"), exact._by_digits(n, d).alias("q")).collect():
        expected = int(Decimal(rounded(*pairs[r["i"]])).scaleb(18, WIDE))
        assert len(r["c"]) == 56 and int(r["c"]) == int(r["q"]) == expected, pairs[r["i"]]
