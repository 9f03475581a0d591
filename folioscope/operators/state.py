"""Current state from append-only events: late data, tombstones, winners, conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = ("source_time", "tie_break_key", "position", "event_id")
#: Statuses of a work, the first of which may be left.
STATUSES = ("active", "withdrawn", "retracted", "rejected", "superseded")
TERMINAL = STATUSES[1:]


class ConflictError(ValueError):
    """Rows that must agree don't."""


def latest_by(events: DataFrame, keys: list[str], order: tuple[str, ...] = ORDER) -> DataFrame:
    """The row with the greatest ordering tuple of each key, whatever the order of arrival.

    A partial aggregation runs before the shuffle, so a hot key sends a row per task.
    """
    rest = [c for c in events.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return events.groupBy(*keys).agg(best).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def deduplicated(events: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key (the first by position and event), with how often it was seen."""
    rest = [c for c in events.columns if c not in keys]
    agg = events.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("position", "event_id")).alias("_r"), F.count("*").alias("times_seen"))
    return agg.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest), "times_seen")


def visible(states: DataFrame, kind: str = "event_kind") -> DataFrame:
    """Current states that aren't tombstones."""
    return states.where(F.col(kind) != "delete")


def winners(states: DataFrame, work: str, order: tuple[str, ...] = ORDER) -> DataFrame:
    """The winning source of each work among visible, included states."""
    return latest_by(visible(states).where("included"), [work], order)


def monotonic_status(events: DataFrame, work: str) -> DataFrame:
    """Status of each work: the first terminal one by time, else active."""
    first = F.min_by(F.when(F.col("status").isin(*TERMINAL), F.col("status")), F.when(F.col("status").isin(*TERMINAL), F.struct("source_time", "event_id")))
    return events.groupBy(work).agg(F.coalesce(first, F.lit("active")).alias("status"))


def allowed_transition(before: Column, after: Column) -> Column:
    """Active goes to any status; a terminal one only to itself; what is no status goes nowhere."""
    return F.coalesce(before.isin(*STATUSES) & after.isin(*STATUSES) & ((before == "active") | (before == after)), F.lit(False))


def latest_assertions(assertions: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Latest value of each key, with ``conflict`` where the latest time has several.

    Times are merged first and the latest is an aggregation, so a hot key isn't sorted anywhere.
    """
    least, most = F.min(value), F.max(value)
    each = assertions.groupBy(*keys, at).agg(least.alias("least"), F.coalesce(least != most, F.lit(False)).alias("differs"))
    last = each.groupBy(*keys).agg(F.max_by(F.struct(F.col(at).alias("at"), "least", "differs"), F.col(at)).alias("last"))
    return last.select(*keys, F.col("last.at").alias(at), F.col("last.least").alias(value), F.col("last.differs").alias("conflict"))


def checked(df: DataFrame, violations: DataFrame, what: str) -> DataFrame:
    """``df``, or an error naming one violation."""
    bad = violations.limit(1).collect()
    if bad:
        raise ConflictError(f"{what}: {bad[0].asDict()}")
    return df


def appended(ledger: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a batch that the ledger doesn't have; replays append nothing."""
    return batch.dropDuplicates(keys).join(ledger.select(*keys), keys, "left_anti")


def replay_differences(stored: DataFrame, replay: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on which a replay differs from what is stored (null-safe on all columns)."""
    rest = [c for c in stored.columns if c not in keys]
    other = replay.select(*keys, F.struct(*rest).alias("_replay"))
    return stored.withColumn("_stored", F.struct(*rest)).join(other, keys).where(~F.col("_stored").eqNullSafe(F.col("_replay"))).select(*keys)


def merged_survivors(works: DataFrame, identity: str, order: list[str], backfill: list[str]) -> DataFrame:
    """One work per identity: the earliest, with nulls filled from the next that has a value."""
    earliest = F.struct(*order)
    fills = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), earliest)).alias(c) for c in backfill]
    return works.groupBy(identity).agg(F.min_by(order[-1], earliest).alias("survivor"), F.count("*").alias("merged"), *fills)
