"""Text, key and date functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def evaluated_once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_space(v: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(v, r"(?U)^\s+|\s+$", "")


def collapse_space(v: Column) -> Column:
    """White space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(v, r"(?U)\s+", " "))


def slug(v: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(v), "[^a-z0-9]+", "-"), F.lit("-"))


def length_prefixed(tag: str, v: Column) -> Column:
    """``<tag><bytes>:<value>``: joined keys of this form never collide."""
    return F.concat(F.lit(tag), F.octet_length(v).cast("string"), F.lit(":"), v)


def cohort_key(topic: Column, month: Column, paper_type: Column) -> Column:
    return F.concat(length_prefixed("t", topic), length_prefixed("m", month), length_prefixed("p", paper_type))


def rfc3339(ts: Column) -> Column:
    """UTC time in microseconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def search_text(*parts: Column) -> Column:
    """Title, key, abstract and joined lists, as one searchable text."""
    return F.concat_ws(" ", *parts)


def inverted_index(words: Column) -> Column:
    """Map from each word of a list to its places, from 0 and in order."""

    def spans(xs: Column) -> Column:
        """Where each word begins among its places."""
        return F.filter(F.transform(xs, lambda _, i: i), lambda i: ~F.get(xs, i)["w"].eqNullSafe(F.get(xs, i - 1)["w"]))

    def entries(xs: Column, starts: Column) -> Column:
        last = lambda j: F.coalesce(F.get(starts, j + 1), F.size(xs)) - 1
        return F.transform(starts, lambda s, j: F.struct(F.get(xs, s)["w"].alias("key"), F.transform(F.sequence(s, last(j)), lambda i: F.get(xs, i)["p"]).alias("value")))

    placed = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("p"))))
    return F.map_from_entries(evaluated_once(placed, lambda xs: evaluated_once(spans(xs), lambda starts: entries(xs, starts))))


def inverted_index_text(index: Column) -> Column:
    """Text of a map from word to positions; null if a position is missing, negative or taken twice."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))

    def joined(placed: Column) -> Column:
        whole = F.forall(F.transform(placed, lambda x, i: x["p"].eqNullSafe(i)), lambda same: same)
        return F.when(F.size(placed) == 0, "").when(whole, F.array_join(F.transform(placed, lambda x: x["w"]), " "))

    return evaluated_once(F.sort_array(pairs), joined)


def person_name(given: Column, family: Column, collective: Column | None = None) -> Column:
    """Given and family name, or the collective's; null if all are blank."""
    own = collapse_space(F.concat_ws(" ", given, family))
    name = F.nullif(own, F.lit(""))
    return name if collective is None else F.coalesce(F.nullif(collapse_space(collective), F.lit("")), name)


#: English month names of bibliographic dates.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def month_number(v: Column) -> Column:
    """1 to 12 of a number or an English month name; else null."""
    name = F.lower(F.substring(trim_space(v), 1, 3))
    position = F.array_position(F.array(*(F.lit(m) for m in MONTHS)), name).cast("int")
    number = F.when(trim_space(v).rlike(r"^[0-9]{1,2}$"), trim_space(v).cast("int"))
    return F.when(number.between(1, 12), number).when(position > 0, position)


def partial_date(year: Column, month: Column, day: Column) -> Column:
    """struct(year, month, day, precision, at); a time only where the day is known and real."""
    whole = F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), F.try_to_timestamp(F.format_string("%04d-%02d-%02d", year, month, day)))
    precision = F.when(whole.isNotNull(), "day").when(year.isNotNull() & month.between(1, 12), "month").when(year.isNotNull(), "year")
    return F.struct(year.alias("year"), month.alias("month"), day.alias("day"), precision.alias("precision"), whole.alias("at"))


def revision_time(updated: Column, revised: Column, created: Column, published_online: Column, published: Column) -> Column:
    """The first of these times that is known."""
    return F.coalesce(updated, revised, created, published_online, published)


def month_in_own_zone(time: Column) -> Column:
    """First day, in UTC, of the calendar month that an RFC 3339 text names in its own zone."""
    month = F.regexp_extract(time, r"^([0-9]{4}-[0-9]{2})-[0-9]{2}[Tt]", 1)
    return F.when(month != "", F.try_to_timestamp(F.concat(month, F.lit("-01")), F.lit("yyyy-MM-dd")))


def bibliographic_date(year: Column, month: Column, day: Column, season: Column, plain: Column) -> Column:
    """struct(year, month, day, season, raw, precision, problem, at) of a date of an article.

    A plain text excludes structured parts, a season excludes month and day, and a day needs
    a month.  Only a whole date has a time.  Each part is trimmed and read once.
    """
    names = ("year", "month", "day", "season", "plain")
    trimmed = F.struct(*(F.coalesce(trim_space(c), F.lit("")).alias(n) for n, c in zip(names, (year, month, day, season, plain))))

    def read(v: Column) -> Column:
        number = lambda n, digits: F.when(v[n].rlike(f"^[0-9]{{1,{digits}}}$"), v[n].cast("int"))
        return F.struct(*(v[n].alias(n) for n in names), number("year", 4).alias("y"), F.when(v["month"] != "", month_number(v["month"])).alias("m"), number("day", 2).alias("d"))

    def dated(v: Column) -> Column:
        return evaluated_once(F.try_to_timestamp(F.format_string("%04d-%02d-%02d", v["y"], v["m"], v["d"]), F.lit("yyyy-MM-dd")), lambda at: evaluated_once(judged(v, at), lambda x: told(v, at, x)))

    def judged(v: Column, at: Column) -> Column:
        blank = lambda n: v[n] == ""
        none = blank("year") & blank("month") & blank("day") & blank("season")
        problem = (
            F.when(~blank("plain"), F.when(~none, "plain_and_structured"))
            .when(none, F.lit(None))
            .when(blank("year"), "no_year")
            .when(v["y"].isNull() | (v["y"] <= 0), "year")
            .when(~blank("season"), F.when(~blank("month") | ~blank("day"), "season_and_month"))
            .when(blank("month"), F.when(~blank("day"), "day_without_month"))
            .when(v["m"].isNull(), "month")
            .when(~blank("day") & at.isNull(), "day")
        )
        precision = F.when(~blank("plain"), "text").when(none, F.lit(None)).when(~blank("season"), "season").when(blank("month"), "year").when(blank("day"), "month").otherwise("day")
        return F.struct(problem.alias("problem"), precision.alias("precision"))

    def told(v: Column, at: Column, x: Column) -> Column:
        part = lambda c, *kinds: F.when(x["problem"].isNull() & x["precision"].isin(*kinds), c)
        return F.struct(
            part(v["y"], "year", "season", "month", "day").alias("year"), part(v["m"], "month", "day").alias("month"), part(v["d"], "day").alias("day"), part(collapse_space(v["season"]), "season").alias("season"),
            part(collapse_space(v["plain"]), "text").alias("raw"), F.when(x["problem"].isNull(), x["precision"]).alias("precision"), x["problem"].alias("problem"), part(at, "day").alias("at"),
        )

    return evaluated_once(evaluated_once(trimmed, read), dated)


def no_nulls(v: Column) -> Column:
    """Whether a list is there and holds no null."""
    return F.coalesce(~F.exists(v, lambda x: x.isNull()), F.lit(False))


def licenses(named: list[tuple[str, Column]], lists: list[tuple[str, Column]]) -> Column:
    """Licences of locations, array of struct(name, id, path): each once, with the path where it came first.

    ``named`` are single locations (struct with license, license_id), ``lists`` arrays of them.
    """

    def one(path: Column, x: Column) -> Column:
        return F.struct(F.coalesce(x["license"], F.lit("")).alias("name"), F.coalesce(x["license_id"], F.lit("")).alias("id"), path.alias("path"))

    def numbered(path: str, xs: Column) -> Column:
        return F.transform(xs, lambda x, i: one(F.concat(F.lit(f"{path}["), i.cast("string"), F.lit("]")), x))

    empty = F.array().cast("array<struct<name:string,id:string,path:string>>")
    found = [F.array(one(F.lit(path), x)) for path, x in named] + [F.coalesce(numbered(path, xs), empty) for path, xs in lists]
    every = F.filter(F.concat(*found), lambda x: (x["name"] != "") | (x["id"] != ""))
    keys = lambda: F.transform(every, lambda x: F.struct(x["name"], x["id"]))
    return F.filter(every, lambda x, i: F.array_position(keys(), F.struct(x["name"], x["id"])) == i + 1)


def in_range(score: Column) -> Column:
    """Whether a score is from 0 to 1; a missing one is."""
    return F.coalesce(score.between(0, 1), F.lit(True))


def evidence(fields: dict[str, tuple[Column, str]]) -> Column:
    """Paths of the fields that are there, in the order given: ``field<-path``."""
    return F.array_compact(F.array(*(F.when(v.isNotNull(), F.lit(f"{name}<-{path}")) for name, (v, path) in fields.items())))


def percent(share: Column) -> Column:
    """Per cent to one decimal, halves upwards."""
    return F.floor(share * 1000 + 0.5) / 10
