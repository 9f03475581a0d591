"""Values that are known, unknown or missing, flattened to ``<name>_state`` and ``<name>_value``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KNOWN, UNKNOWN, MISSING = "known", "unknown", "missing"


def state(name: str) -> Column:
    return F.col(f"{name}_state")


def value(name: str) -> Column:
    return F.col(f"{name}_value")


def is_known(name: str) -> Column:
    return state(name) == KNOWN


def equals(name: str, wanted: object) -> Column:
    """Known and equal; unknown and missing match neither a value nor its opposite."""
    return is_known(name) & (value(name) == F.lit(wanted))


def known(v: Column, absent: str = MISSING) -> tuple[Column, Column]:
    """State and value of a nullable column; ``absent`` is the state of null."""
    return F.when(v.isNotNull(), KNOWN).otherwise(absent), v


def rank(s: Column) -> Column:
    """Order of states: known, then unknown, then all else."""
    return F.when(s == KNOWN, 0).when(s == UNKNOWN, 1).otherwise(2)


def consistent(name: str) -> Column:
    """A value is there exactly if the state is known."""
    return F.coalesce((state(name) == KNOWN) == value(name).isNotNull(), F.lit(False))


def ratio(name: str) -> list[Column]:
    """Aggregates: state, count of true, count of all, share of true where all are known.

    The state is known only if every row's is and has a value, missing only if every row's
    is, else unknown.
    """
    n = F.count(F.lit(1))
    all_known = F.coalesce(F.bool_and(is_known(name) & value(name).isNotNull()), F.lit(False))
    all_missing = F.coalesce(F.bool_and(state(name) == MISSING), F.lit(False))
    hits = F.count_if(equals(name, True))
    return [
        F.when(all_known, KNOWN).when(all_missing, MISSING).otherwise(UNKNOWN).alias(f"{name}_ratio_state"),
        hits.alias(f"{name}_true"),
        n.alias(f"{name}_total"),
        F.when(all_known & (n > 0), hits / n).alias(f"{name}_ratio"),
    ]


def presented(s: Column, v: Column, unknown: str = "not covered", absent: str = "missing", suffix: str = "") -> Column:
    """A value as text: a label of its state, yes or no, or the value with a suffix."""
    shown = F.when(v.cast("string") == "true", "yes").when(v.cast("string") == "false", "no").otherwise(F.concat(v.cast("string"), F.lit(suffix)))
    return F.when(s == KNOWN, shown).when(s == UNKNOWN, unknown).otherwise(absent)
