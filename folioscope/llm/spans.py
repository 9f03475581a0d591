"""Spans of pattern matches as native columns: arrays of (kind, start, end, hit).

Starts and ends count code points; ends are exclusive.  ``kind`` is a number, by which
spans of equal start are ordered.  Arrays of any length take time in proportion to it:
running values are taken in blocks of ``BLOCK`` items, so that no array grows item by item
beyond a block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<kind:int,start:int,end:int,hit:string>"
#: Items of a block of a running value.
BLOCK = 128


def empty() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(items: Column) -> Column:
    """Items, one at least, in blocks."""
    last = F.floor((F.size(items) - 1) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))


def running(items: Column, start: Column, after: Callable[[Column, Column], Column], told: Callable[[Column, Column], Column]) -> Column:
    """``told`` of the state before each item and the item; ``after`` gives the state that follows.

    ``items`` has one item at least; the state is a number.
    """

    def begins(blocks: Column) -> Column:
        def step(acc: Column, block: Column) -> Column:
            return F.struct(F.aggregate(block, acc["at"], after).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

        return F.aggregate(blocks, F.struct(start.alias("at"), F.slice(F.array(start), 1, 0).alias("out")), step, lambda acc: acc["out"])

    def within(block: Column, begin: Column) -> Column:
        none = F.slice(F.array(told(start, F.get(block, F.lit(0)))), 1, 0)

        def step(acc: Column, x: Column) -> Column:
            return F.struct(after(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(told(acc["at"], x))).alias("out"))

        return F.aggregate(block, F.struct(begin.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    return let(_blocks(items), lambda blocks: F.flatten(F.zip_with(blocks, begins(blocks), within)))


def matches(text: Column, pattern: str, kind: int, if_found: str | None = None, before: int = 0) -> Column:
    """All leftmost, non-overlapping matches of a Java pattern that can't match nothing.

    The text between matches gives their places: both come from one search order.
    ``if_found`` is a plainer pattern that every text with a match holds; texts without it
    aren't searched.  With ``before``, spans have a further field: so many characters at
    most before the span, back to the match before it.
    """

    def span(at: Column, pair: Column) -> Column:
        begin = at + F.char_length(pair["gap"])
        fields = [F.lit(kind).alias("kind"), begin.alias("start"), (begin + F.char_length(pair["hit"])).alias("end"), pair["hit"].alias("hit")]
        return F.struct(*fields, *([F.substring(pair["gap"], -before, before).alias("before")] if before else []))

    def found(hits: Column) -> Column:
        pairs = F.zip_with(hits, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
        return F.when(F.size(hits) > 0, let(pairs, lambda p: running(p, F.lit(0), lambda at, x: at + F.char_length(x["gap"]) + F.char_length(x["hit"]), span)))

    none = F.array().cast(f"array<{SPAN[:-1]},before:string>>") if before else empty()
    return F.when(text.rlike(if_found or pattern), F.coalesce(let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found), none)).otherwise(none)


def ordered(*arrays: Column) -> Column:
    """The spans of all arrays by start, then kind, then end."""
    keyed = F.concat(*(F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["hit"].alias("hit"))) for a in arrays))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit")))


def joined(spans: Column, names: tuple[str, ...]) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    named = F.array(*(F.lit(n) for n in names))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(named, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def outside(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others, in order of start.

    Few pairs are compared with each other; many spans are merged with the others by start:
    one pass forth holds the last end so far against each span, one back the first start.
    """

    def swept(items: Column, state: Column, after: Callable[[Column, Column], Column], met: Callable[[Column, Column], Column]) -> Column:
        told = lambda at, x: F.struct(x["start"].alias("start"), x["tag"].alias("tag"), x["end"].alias("end"), (x["met"] | met(at, x)).alias("met"), x["span"].alias("span"))
        return let(items, lambda i: running(i, state, after, told))

    def merged() -> Column:
        own = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(1).alias("tag"), s["end"].alias("end"), F.lit(False).alias("met"), s.alias("span")))
        both = F.array_sort(F.concat(own, F.transform(others, lambda o: F.struct(o["start"].alias("start"), F.lit(0).alias("tag"), o["end"].alias("end"), F.lit(False).alias("met"), F.lit(None).alias("span")))))
        forth = swept(both, F.lit(-1), lambda at, x: F.when(x["tag"] == 0, F.greatest(at, x["end"])).otherwise(at), lambda at, x: at > x["start"])
        back = swept(F.reverse(forth), F.lit(2**31 - 1), lambda at, x: F.when(x["tag"] == 0, F.least(at, x["start"])).otherwise(at), lambda at, x: at < x["end"])
        return F.reverse(F.transform(F.filter(back, lambda x: (x["tag"] == 1) & ~x["met"]), lambda x: x["span"]))

    few = F.size(spans).cast("long") * F.size(others) <= BLOCK * BLOCK
    apart = F.filter(spans, lambda s: ~F.exists(others, lambda o: (s["start"] < o["end"]) & (o["start"] < s["end"])))
    return F.when(few, apart).otherwise(merged())


def replaced(text: Column, spans: Column, names: tuple[str, ...]) -> Column:
    """The text with each span, or run of overlapping spans, as ``<NAME>`` of its first kind.

    ``spans`` are in order of start.  The text is cut in two steps, blocks of spans first.
    """
    named = F.array(*(F.lit(f"<{n.upper()}>") for n in names))
    mark = lambda at, s: F.struct(at.alias("at"), s["start"].alias("start"), s["kind"].alias("kind"))
    marks = F.filter(running(spans, F.lit(0), lambda at, s: F.greatest(at, s["end"]), mark), lambda m: m["start"] >= m["at"])

    def written(block: Column) -> Column:
        first = F.get(block, F.lit(0))["at"]
        part = F.substring(text, first + 1, F.element_at(block, -1)["start"] - first)
        return let(part, lambda p: F.array_join(F.transform(block, lambda m: F.concat(F.substring(p, m["at"] - first + 1, m["start"] - m["at"]), F.element_at(named, m["kind"] + 1))), ""))

    out = let(marks, lambda m: F.array_join(F.transform(_blocks(m), written), ""))
    rest = F.substring(text, F.array_max(F.transform(spans, lambda s: s["end"])) + 1, F.char_length(text))
    return F.when(F.size(spans) > 0, F.concat(out, rest)).otherwise(text)
