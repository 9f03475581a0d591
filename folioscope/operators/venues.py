"""Venues: resolution by source identifier and ISSN, types, and aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import length_prefixed, trim_space

#: Fixed values.
TYPES = ("journal", "conference", "preprint", "repository")
WORK_TYPES = {"journal-article": "journal", "proceedings-article": "conference"}
#: Keys of a record whose sets are looked up.
FEW_KEYS = 8


def venue_type(raw: Column) -> Column:
    """A known type in lower case, or null."""
    v = F.lower(trim_space(raw))
    return F.when(v.isin(*TYPES), v)


def type_of_work(work_type: Column) -> Column:
    """The type of venue that a kind of work appears in."""
    case = None
    for name, kind in WORK_TYPES.items():
        case = F.when(work_type == name, kind) if case is None else case.when(work_type == name, kind)
    return case


def _keys(source_id: Column, issns: Column) -> Column:
    """Keys of a venue or record by which they match, each once, in order."""
    told = F.concat(F.array(F.concat(F.lit("s:"), source_id)), F.coalesce(F.transform(issns, lambda x: F.concat(F.lit("i:"), x)), F.array().cast("array<string>")))
    return F.array_compact(told)


def _keyed(rows: DataFrame, name: str, keys: Column) -> DataFrame:
    """(``name``, keys): the keys of all rows of a name."""
    return rows.select(name, keys.alias("keys")).groupBy(name).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("keys")))).alias("keys"))


def _sets(keys: Column) -> Column:
    """The sets that can be made of keys in order, but the empty one and those of more than ``FEW_KEYS``."""
    more = lambda made, k: F.concat(made, F.transform(F.filter(made, lambda s: F.size(s) < FEW_KEYS), lambda s: F.array_append(s, k)))
    return F.filter(F.aggregate(keys, F.array(F.array().cast("array<string>")), more), lambda s: F.size(s) > 0)


def resolved(candidates: DataFrame, venues: DataFrame) -> DataFrame:
    """(record, matches, venue_id, resolution): skip, insert, reuse or conflict.

    ``candidates`` has (record, kind, name, source_id, issns), ``venues`` (venue_id,
    source_id, issn_l, issn, eissn).  A venue matches by source identifier or by an ISSN in
    any role.  Venues are counted by each set of their keys; a record's venues are those with
    its first key, and its second, less those with both, and so on over its own sets: no pair of
    a record and a venue is made.  Records of more than ``FEW_KEYS`` keys are joined key by key.
    """
    known = _keyed(venues, "venue_id", _keys(F.col("source_id"), F.array("issn_l", "issn", "eissn")))
    asked = _keyed(candidates, "record", _keys(F.col("source_id"), F.transform("issns", lambda x: F.upper(trim_space(x)))))
    having = known.select("venue_id", F.explode(_sets(F.col("keys"))).alias("having")).groupBy("having").agg(F.count("*").alias("n"), F.min("venue_id").alias("venue_id"))
    sets = asked.where(F.size("keys") <= FEW_KEYS).select("record", F.explode(_sets(F.col("keys"))).alias("having"))
    signed = F.when(F.size("having") % 2 == 1, F.col("n")).otherwise(-F.col("n"))
    few = sets.join(having, "having").groupBy("record").agg(F.sum(signed).alias("matches"), F.min("venue_id").alias("venue_id"))
    pairs = asked.where(F.size("keys") > FEW_KEYS).select("record", F.explode("keys").alias("key")).join(known.select("venue_id", F.explode("keys").alias("key")), "key")
    found = few.union(pairs.groupBy("record").agg(F.count_distinct("venue_id").alias("matches"), F.min("venue_id").alias("venue_id")))
    rows = candidates.select("record", (venue_type(F.col("kind")).isNull() | (F.coalesce(trim_space(F.col("name")), F.lit("")) == "")).alias("skipped")).join(found, "record", "left")
    matches = F.coalesce("matches", F.lit(0))
    resolution = F.when(F.col("skipped"), "skip").when(matches == 0, "insert").when(matches == 1, "reuse").otherwise("conflict")
    return rows.select("record", matches.alias("matches"), F.when(~F.col("skipped") & (matches == 1), F.col("venue_id")).alias("venue_id"), resolution.alias("resolution"))


def alias_plan(aliases: DataFrame, import_source: str) -> DataFrame:
    """(venue_id, alias, source, key, lock): each alias once, in the order in which locks are taken.

    Rows of another source than the import's have a ``problem``, as have blank ones.
    """
    rows = aliases.select(F.col("venue_id").cast("string").alias("venue_id"), trim_space(F.col("alias")).alias("alias"), trim_space(F.col("source")).alias("source"))
    key = F.concat(length_prefixed("", F.col("venue_id")), F.lit(":"), length_prefixed("", F.col("alias")), F.lit(":"), length_prefixed("", F.col("source")))
    lock = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    signed = F.when(lock >= 2**31, lock - 2**32).otherwise(lock)
    problem = F.when(F.coalesce(F.col("alias"), F.lit("")) == "", "blank").when(F.col("source") != import_source.strip(), "source")
    return rows.select("*", key.alias("key"), signed.alias("lock"), problem.alias("problem")).dropDuplicates(["key"]).orderBy("lock", "key")


def aliases_got(plan: DataFrame, stored: DataFrame) -> DataFrame:
    """Each planned alias with the id that is stored, or null where it is to be inserted."""
    return plan.where("problem is null").join(stored.select("key", "alias_id"), "key", "left")
