"""Exact numbers beyond the width of Spark's arithmetic: quotients of 38 digits, decimals as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.text import trim_space

SCALE = 18
#: Digits of a limb: three limbs hold ten times a number of 38 digits.
DIGITS = 13
LIMB = 10**DIGITS
#: Digits that are divided at a time, four times for 38 and the decimals; denominators of so many digits at most leave room for them.
CHUNK, NARROW = 14, 24


def _unsigned(v: Column) -> Column:
    """Digits of a whole number; ``abs`` rounds negative decimals to 34 digits."""
    return F.regexp_replace(v.cast("string"), "^-", "")


def _with(v: Column, f) -> Column:
    """``f(v)``, for which ``v`` is evaluated once."""
    return F.get(F.transform(F.array(v), f), F.lit(0))


def _number(high: Column, middle: Column, low: Column) -> Column:
    """A number of three limbs, of which those that are too large are carried; numbers compare as structs."""
    over = lambda x: ((x - x % LIMB) / LIMB).cast("long")
    m = middle + over(low)
    return F.struct((high + over(m)).alias("a"), (m % LIMB).alias("b"), (low % LIMB).alias("c"))


def _limbs(digits: Column) -> Column:
    whole = F.lpad(digits, 3 * DIGITS, "0")
    part = lambda k: F.substring(whole, 1 + k * DIGITS, DIGITS).cast("long")
    return F.struct(part(0).alias("a"), part(1).alias("b"), part(2).alias("c"))


def _times(x: Column, k: int) -> Column:
    return _number(x["a"] * k, x["b"] * k, x["c"] * k)


def _minus(x: Column, y: Column) -> Column:
    """``x - y``, not negative."""
    c, b = x["c"] - y["c"], x["b"] - y["b"]
    lent_c, lent_b = F.when(c < 0, 1).otherwise(0), F.when((b < 0) | ((b == 0) & (c < 0)), 1).otherwise(0)
    return F.struct((x["a"] - y["a"] - lent_b).cast("long").alias("a"), (b - lent_c + lent_b * F.lit(LIMB)).cast("long").alias("b"), (c + lent_c * F.lit(LIMB)).cast("long").alias("c"))


def quotient_text(numerator: Column, denominator: Column) -> Column:
    """Quotient of whole numbers of up to 38 digits as text with 18 decimals, rounded once, half away from zero.

    Long division: 14 digits at a time by Spark's decimals, or, by denominators of more than 24
    digits, a digit at a time in limbs of 13 digits.  Null for a zero denominator and for nulls.
    """
    both = F.struct(numerator.cast("decimal(38,0)").alias("n"), denominator.cast("decimal(38,0)").alias("d"))

    def shown(x: Column) -> Column:
        n, d = x["n"], x["d"]
        narrow = F.lit("9" * NARROW).cast("decimal(38,0)")

        def signed(q: Column) -> Column:
            whole = F.regexp_replace(F.substring(q, F.lit(1), F.length(q) - SCALE), "^0+(?=.)", "")
            negative = ((n < 0) != (d < 0)) & q.rlike("[1-9]")
            return F.concat(F.when(negative, "-").otherwise(""), whole, F.lit("."), F.right(q, F.lit(SCALE)))

        digits = F.when(d.between(-narrow, narrow), _by_chunks(n, d)).otherwise(_by_digits(n, d))
        return F.when(d.isNotNull() & n.isNotNull() & (d != 0), _with(digits, signed))

    return _with(both, shown)


def _by_chunks(n: Column, d: Column) -> Column:
    """Digits of the rounded quotient, by a denominator of up to ``NARROW`` digits, which isn't zero."""
    raised = F.concat(F.lpad(_unsigned(n), 4 * CHUNK - SCALE, "0"), F.lit("0" * SCALE))
    operands = F.struct(raised.alias("n"), _unsigned(d).cast(f"decimal({NARROW},0)").alias("d"))

    def divided(x: Column, k: int, rest: Column, *quotients: Column) -> Column:
        if k == 4:
            return rounded(rest * 2 >= x["d"], quotients)
        chunk = F.substring(x["n"], 1 + k * CHUNK, CHUNK).cast(f"decimal({CHUNK},0)")
        shifted = (rest * F.lit(10**CHUNK).cast(f"decimal({CHUNK + 1},0)") + chunk).cast("decimal(38,0)")
        taken = lambda s: F.struct(F.call_function("div", s, x["d"]).alias("q"), (s % x["d"]).cast(f"decimal({NARROW},0)").alias("r"))
        return _with(shifted, lambda s: _with(taken(s), lambda t: divided(x, k + 1, t["r"], *quotients, t["q"])))

    def rounded(up: Column, quotients: tuple[Column, ...]) -> Column:
        carry, shown = up.cast("long"), []
        for q in reversed(quotients):
            shown.insert(0, F.lpad(((q + carry) % 10**CHUNK).cast("string"), CHUNK, "0"))
            carry = F.when(q + carry == 10**CHUNK, 1).otherwise(0)
        return F.concat(*shown)

    return _with(operands, lambda x: divided(x, 0, F.lit(0).cast(f"decimal({NARROW},0)")))


def _by_digits(n: Column, d: Column) -> Column:
    """Digits of the rounded quotient, by any denominator but zero."""
    digits = F.split(F.concat(_unsigned(n), F.lit("0" * SCALE)), "")
    none = F.struct(*(F.lit(0).cast("long").alias(x) for x in "abc"))

    def divided(multiples: Column) -> Column:
        def step(done: Column, digit: Column) -> Column:
            r = done["r"]
            shifted = _number(r["a"] * 10, r["b"] * 10, r["c"] * 10 + digit.cast("long"))
            taken = lambda s: _with(F.size(F.filter(multiples, lambda m: m <= s)), lambda k: F.struct(_minus(s, F.element_at(multiples, k)).alias("r"), F.concat(done["q"], (k - 1).cast("string")).alias("q")))
            return _with(shifted, taken)

        def rounded(done: Column) -> Column:
            up = F.regexp_extract(done["q"], "^(.*)([0-8])(9*)$", 1)
            last = (F.regexp_extract(done["q"], "^(.*)([0-8])(9*)$", 2).cast("int") + 1).cast("string")
            nines = F.length(F.regexp_extract(done["q"], "^(.*)([0-8])(9*)$", 3))
            return F.when(_times(done["r"], 2) >= F.element_at(multiples, 2), F.concat(up, last, F.repeat(F.lit("0"), nines))).otherwise(done["q"])

        return F.aggregate(digits, F.struct(none.alias("r"), F.lit("0").alias("q")), step, rounded)

    by = _limbs(_unsigned(d))
    return _with(_with(by, lambda x: F.array(*(_times(x, k) for k in range(10)))), divided)


def quotient(numerator: Column, denominator: Column) -> Column:
    """``quotient_text`` as decimal(38,18); null where 20 digits before the point don't hold it."""
    n, d = numerator.cast("decimal(38,0)"), denominator.cast("decimal(38,0)")
    least, most = (F.lit(sign + "9" * 20).cast("decimal(20,0)") for sign in ("-", ""))
    narrow = F.try_divide(n.try_cast("decimal(20,0)"), d.try_cast("decimal(20,0)"))
    return F.when(n.between(least, most) & d.between(least, most), narrow).otherwise(quotient_text(n, d).try_cast("decimal(38,18)"))


def decimal_text(raw: Column) -> Column:
    """A decimal that isn't negative in its shortest form, of any length; null for other texts."""

    def shortest(v: Column) -> Column:
        whole = F.regexp_replace(F.regexp_extract(v, r"^([0-9]+)", 1), "^0+(?=.)", "")
        fraction = F.regexp_replace(F.regexp_extract(v, r"\.([0-9]+)$", 1), "0+$", "")
        return F.when(v.rlike(r"^[0-9]+(\.[0-9]+)?$"), _with(fraction, lambda f: F.concat(whole, F.when(f != "", F.concat(F.lit("."), f)).otherwise(""))))

    return _with(trim_space(raw), shortest)


def decimal_order(raw: Column) -> Column:
    """What decimals of any length and scale compare by; null for what isn't one."""

    def order(v: Column) -> Column:
        whole = F.substring_index(v, ".", 1)
        return F.when(v.isNotNull(), F.struct(F.length(whole).alias("size"), whole.alias("whole"), F.substring(v, F.length(whole) + 2, F.length(v)).alias("fraction")))

    return _with(decimal_text(raw), order)
