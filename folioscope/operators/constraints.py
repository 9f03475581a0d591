"""Constraints over tables of any size: a table is read once for all its rules, and a key joined once.

Every function gives one row a rule, zeros included: (rule, violations, least, greatest), the
last two the keys of the first and the last violator as text.  As in SQL a condition that is
null isn't violated.  All are aggregations with partial sums: a hot key sends one row a task.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import tristate
from folioscope.operators import catalog, state, venues


class Violated(ValueError):
    """Rules that don't hold, with their counts and first and last violators."""

    def __init__(self, found: dict[str, tuple[int, str, str]]) -> None:
        self.found = found
        super().__init__("; ".join(f"{rule}: {n}, from {least} to {greatest}" for rule, (n, least, greatest) in found.items()))


def row_violations(rows: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """Rows for which a condition is false, all conditions in one pass."""
    broken = {rule: ~F.coalesce(holds, F.lit(True)) for rule, holds in checks.items()}
    return _counted(rows, key, broken)


def _counted(rows: DataFrame, key: str, broken: dict[str, Column]) -> DataFrame:
    told = [(F.count_if(bad).alias(f"n{i}"), F.min(F.when(bad, F.col(key))).alias(f"least{i}"), F.max(F.when(bad, F.col(key))).alias(f"greatest{i}")) for i, bad in enumerate(broken.values())]
    one = rows.agg(*(c for three in told for c in three))
    out = (F.struct(F.lit(rule).alias("rule"), F.col(f"n{i}").alias("violations"), F.col(f"least{i}").cast("string").alias("least"), F.col(f"greatest{i}").cast("string").alias("greatest")) for i, rule in enumerate(broken))
    return one.select(F.inline(F.array(*out)))


def disagreements(rows: DataFrame, identity: str, fields: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Identities whose rows hold several values of a field; only rows that meet the field's condition count.

    ``fields`` maps a rule to (value, condition).  Least and greatest values tell whether there
    are several, so no set of values is kept; null is no value, and no identity.
    """
    ends = [(F.min(F.when(where, value)).alias(f"low{i}"), F.max(F.when(where, value)).alias(f"high{i}")) for i, (value, where) in enumerate(fields.values())]
    each = rows.where(F.col(identity).isNotNull()).groupBy(identity).agg(*(c for two in ends for c in two))
    return _counted(each, identity, {rule: F.coalesce(F.col(f"low{i}") != F.col(f"high{i}"), F.lit(False)) for i, rule in enumerate(fields)})


def shared_keys(rows: DataFrame, key: str, rule: str, columns: list[Column]) -> DataFrame:
    """Rows whose columns, none of them null, another row has too; the least and greatest such row."""
    whole = functools.reduce(operator.and_, (c.isNotNull() for c in columns))
    each = rows.where(whole).groupBy(*(c.alias(f"c{i}") for i, c in enumerate(columns))).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).where("n > 1")
    return each.agg(F.lit(rule).alias("rule"), F.coalesce(F.sum("n"), F.lit(0)).alias("violations"), F.min("low").cast("string").alias("least"), F.max("high").cast("string").alias("greatest"))


def joined_violations(rows: DataFrame, key: str, others: DataFrame, on: list[str], checks: dict[str, Column]) -> DataFrame:
    """Rows for which a condition on them and the row of ``others`` that they name is false, in one join.

    ``others`` has one row a key.  A row that names none violates ``no row of that key``;
    a row that holds a null in ``on`` names nothing, and its other columns are null.
    """
    found = others.withColumn("found_by_key", F.lit(True))
    named = functools.reduce(operator.and_, (F.col(c).isNotNull() for c in on))
    return row_violations(rows.join(found, on, "left"), key, {"no row of that key": ~named | F.coalesce("found_by_key", F.lit(False)), **checks})


def all_of(*parts: tuple[str, DataFrame]) -> DataFrame:
    """(subject, rule, violations, least, greatest) of several constraints' results."""
    return functools.reduce(DataFrame.unionByName, (found.withColumn("subject", F.lit(subject)) for subject, found in parts))


def enforce(found: DataFrame) -> None:
    """An error that tells what is violated, if anything is; ``found`` has a row for each rule."""
    bad = found.where("violations > 0").collect()
    if bad:
        raise Violated({(f"{r['subject']}: " if "subject" in found.columns else "") + r["rule"]: (r["violations"], r["least"], r["greatest"]) for r in bad})


#: Catalogs whose identifiers of venues are controlled, decisions on venues, a reason.
VENUE_SCHEMES = ("openalex", "crossref", "doaj", "issn_portal", "nlm")
DECISIONS = ("accepted", "rejected", "unknown", "not_applicable")
NO_JOURNAL = "venue_type_not_journal"
ISSN_FORM = "^[0-9]{4}-[0-9]{3}[0-9X]$"


def _filled(c: str) -> Column:
    return F.trim(c) != ""


def _trimmed(c: str) -> Column:
    return _filled(c) & (F.trim(c) == F.col(c))


def venue_rules() -> dict[str, Column]:
    """Of venues (venue_type, display_title, issn_l, issn, eissn, source_scheme, source_identifier)."""
    scheme, identifier = F.col("source_scheme"), F.col("source_identifier")
    both = scheme.isNotNull() & identifier.isNotNull() & scheme.isin(*VENUE_SCHEMES) & _filled("source_identifier")
    return {
        "venue type": F.col("venue_type").isin(*venues.TYPES),
        "display title": _filled("display_title"),
        **{f"form of {c}": F.col(c).rlike(ISSN_FORM) for c in ("issn_l", "issn", "eissn")},
        "controlled source": (scheme.isNull() & identifier.isNull()) | F.coalesce(both, F.lit(False)),
    }


def paper_rules(columns: list[str]) -> dict[str, Column]:
    """Of a catalog's papers, as far as their ``columns`` go: keys, states, ranges and lists."""
    rules = {f"{c} is trimmed": _trimmed(c) for c in ("canonical_key", "title") if c in columns}
    if "search_text" in columns:
        rules["search_text is filled"] = _filled("search_text")
    for name in [c.removesuffix("_state") for c in columns if c.endswith("_state") and c.removesuffix("_state") + "_value" in columns]:
        s, v = F.col(f"{name}_state"), F.col(f"{name}_value")
        rules[f"state of {name}"] = s.isin(tristate.KNOWN, tristate.UNKNOWN, tristate.MISSING)
        rules[f"value of {name} by state"] = ((s == tristate.KNOWN) & v.isNotNull()) | (s.isin(tristate.UNKNOWN, tristate.MISSING) & v.isNull())
    ranges = {
        "paper_type_value": lambda c: c.isin(*catalog.PAPER_TYPES),
        "citation_count_value": lambda c: c >= 0,
        "trend_score_value": lambda c: c.between(0, 1),
        "lifecycle_status": lambda c: c.isin(*state.STATUSES),
        **{c: lambda v: ~F.exists(v, lambda x: x.isNull()) for c in ("topic_slugs", "method_slugs", "source_names")},
    }
    rules.update({f"range of {c}": holds(F.col(c)) for c, holds in ranges.items() if c in columns})
    return rules


def work_fields() -> dict[str, tuple[Column, Column]]:
    """Core fields on which records of one identity must agree: blank ones and active statuses tell nothing."""
    told = {c: _filled(c) for c in ("title", "abstract")}
    told.update({c: F.col(c).isNotNull() for c in ("published_at", "venue_id")})
    told["status"] = F.col("status") != "active"
    return {f"conflicting {c}": (F.col(c), where) for c, where in told.items()}


def assessment_rules() -> dict[str, Column]:
    """Of assessments (decision, matched_rules, evidence_type, reason) joined to their venue's ``venue_type``.

    Only journals are accepted, rejected or unknown, only with a matched rule are they accepted,
    and the evidence names the venue's own type.  A list that is null is as wrong as a matched rule
    where there must be none.
    """
    decision, journal, n = F.col("decision"), F.col("venue_type").eqNullSafe("journal"), F.size("matched_rules")
    is_a = lambda *names: F.coalesce(decision.isin(*names), F.lit(False))
    return {
        "decision": is_a(*DECISIONS),
        "evidence names the type": F.col("evidence_type").isNotNull() & F.col("evidence_type").eqNullSafe(F.col("venue_type")),
        "accepted journals match a rule": ~is_a("accepted") | (journal & (n > 0)),
        "others match none": ~is_a("rejected", "unknown") | (journal & (n == 0)),
        "not applicable to journals": ~is_a("not_applicable") | (~journal & (n == 0) & F.col("reason").eqNullSafe(NO_JOURNAL)),
    }


def receipt_rules() -> dict[str, Column]:
    """Of receipts (input_rows, inserted_rows, unchanged_rows, associated_rows, created_rows)."""
    return {
        "associated rows are the input": F.col("associated_rows") == F.col("input_rows"),
        "created rows are the inserted": F.col("created_rows") == F.col("inserted_rows"),
        "the rest is unchanged": F.col("associated_rows") - F.col("created_rows") == F.col("unchanged_rows"),
    }
