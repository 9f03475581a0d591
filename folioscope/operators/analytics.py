"""Exact trend formulas and decisions, as typed outcomes rather than errors.

Each formula has a status column: ``ok`` or the first check that fails, in order; a value is
there only where the status is ``ok``.  Quotients of whole numbers are rounded once, half away
from zero, at 18 decimals; products are divided in up to 38 digits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions import exact

DAY_MICROS = 86_400_000_000


def quotient(numerator: Column, denominator: Column) -> Column:
    """Exact quotient of whole numbers below 10**20 at 18 decimals; null for a zero denominator."""
    return F.try_divide(numerator.cast("decimal(20,0)"), denominator.cast("decimal(20,0)"))


def _product(a: Column, b: Column) -> Column:
    """Product of longs, which a long may not hold."""
    return a.cast("decimal(20,0)") * b.cast("decimal(19,0)")


def _micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def _outcome(checks: list[tuple[Column, str]]) -> Column:
    status = F.when(checks[0][0], checks[0][1])
    for condition, name in checks[1:]:
        status = status.when(condition, name)
    return status.otherwise("ok")


def missing(fields: dict[str, Column]) -> Column:
    """Names of the fields that are null, in order, joined by commas: what ``missing_signal`` is about."""
    return F.array_join(F.array_compact(F.array(*(F.when(c.isNull(), F.lit(n)) for n, c in fields.items()))), ",")


def citation_velocity(start: Column, end: Column, start_at: Column, end_at: Column) -> tuple[Column, Column]:
    """Change of a count per day."""
    absent = start.isNull() | end.isNull() | start_at.isNull() | end_at.isNull()
    status = _outcome([(absent, "missing_signal"), (end_at < start_at, "reversed_time"), (end_at == start_at, "zero_denominator"), ((start < 0) | (end < 0), "invalid_metric")])
    return status, F.when(status == "ok", exact.quotient(_product(end.cast("decimal(20,0)") - start.cast("decimal(20,0)"), F.lit(DAY_MICROS)), _micros(end_at) - _micros(start_at)))


def code_growth(start: Column, end: Column, start_at: Column, end_at: Column) -> tuple[Column, Column]:
    """Change in proportion to the start."""
    absent = start.isNull() | end.isNull() | start_at.isNull() | end_at.isNull()
    status = _outcome([(absent, "missing_signal"), (end_at < start_at, "reversed_time"), (end_at == start_at, "window_mismatch"), ((start < 0) | (end < 0), "invalid_metric"), (start == 0, "zero_denominator")])
    return status, F.when(status == "ok", quotient(end - start, start))


#: Start and end of a baseline window and of a current one.
Windows = tuple[Column, Column, Column, Column]


def window_checks(windows: Windows | None) -> list[tuple[Column, str]]:
    """What is wrong with two windows that are to be compared: both must be as long, one after the other."""
    if windows is None:
        return []
    b0, b1, c0, c1 = windows
    return [
        (b0.isNull() | b1.isNull() | c0.isNull() | c1.isNull(), "missing_signal"),
        ((b1 < b0) | (c1 < c0), "reversed_time"),
        ((b1 == b0) | (c1 == c0), "zero_denominator"),
        (c0 < b0, "reversed_time"),
        ((c0 < b1) | ((_micros(b1) - _micros(b0)) != (_micros(c1) - _micros(c0))), "window_mismatch"),
    ]


def topic_growth(baseline: Column, current: Column, windows: Windows | None = None) -> tuple[Column, Column]:
    """Growth from a baseline window to an equally long later one."""
    checks = [(baseline.isNull() | current.isNull(), "missing_signal"), *window_checks(windows)]
    status = _outcome([*checks, ((baseline < 0) | (current < 0), "invalid_metric"), (baseline == 0, "zero_denominator")])
    return status, F.when(status == "ok", quotient(current - baseline, baseline))


def method_adoption(b_adopted: Column, b_total: Column, c_adopted: Column, c_total: Column, windows: Windows | None = None) -> tuple[Column, Column]:
    """Difference of two shares, over a common denominator, rounded once."""
    absent = b_adopted.isNull() | b_total.isNull() | c_adopted.isNull() | c_total.isNull()
    wrong = (b_adopted < 0) | (b_total < 0) | (c_adopted < 0) | (c_total < 0) | (b_adopted > b_total) | (c_adopted > c_total)
    status = _outcome([(absent, "missing_signal"), *window_checks(windows), ((b_total == 0) | (c_total == 0), "zero_denominator"), (wrong, "invalid_metric")])
    return status, F.when(status == "ok", exact.quotient(_product(c_adopted, b_total) - _product(b_adopted, c_total), _product(c_total, b_total)))


def citation_percentile(works: DataFrame, cohort: list[str], value: str) -> DataFrame:
    """``works`` with the share, per cent, of its cohort's other works that have no more.

    Counts of each distinct value are summed before the running sum over values, so a hot
    cohort sorts its distinct values only.  Null for a work alone in its cohort.
    """
    per_value = works.groupBy(*cohort, value).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*cohort).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*cohort)
    ranked = per_value.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_all", F.sum("_n").over(whole)).drop("_n")
    joined = works.join(ranked, [*cohort, value])
    return joined.withColumn("cohort_size", F.col("_all") - 1).withColumn("percentile", F.when(F.col("_all") > 1, quotient((F.col("_upto") - 1) * 100, F.col("_all") - 1))).drop("_upto", "_all")


#: The inputs of an assessment.
SIGNALS = ("evidence_paper_ids", "growth_window", "growth_score", "competition_density", "data_availability", "reproducibility", "confidence")


def assessment_problem(topic_id: Column, name: Column, generated_at: Column, shares: list[Column], papers: Column, missing_signals: Column, start: Column, end: Column) -> Column:
    """What is wrong with an assessment, the first of all checks; null if nothing is.

    Id and name must be there and trimmed, shares lie from 0 to 1, papers not be null, missing
    signals be known ones, and the growth window be ordered unless it is what is missing.
    """
    trimmed = lambda c: F.coalesce((F.trim(c) != "") & (F.trim(c) == c), F.lit(False))
    window = F.array_contains(missing_signals, "growth_window") | F.coalesce(start < end, F.lit(False))
    outside = F.lit(False)
    for share in shares:
        outside = outside | ~F.coalesce(share.between(0, 1), F.lit(False))
    return (
        F.when(~trimmed(topic_id), "topic_id")
        .when(~trimmed(name), "topic_name")
        .when(generated_at.isNull(), "generated_at")
        .when(outside, "share")
        .when(F.exists(papers, lambda p: p.isNull()), "paper_id")
        .when(F.size(F.array_except(missing_signals, F.array(*(F.lit(s) for s in SIGNALS)))) > 0, "signal")
        .when(~window, "growth_window")
    )


@dataclass(frozen=True)
class OpportunityPolicy:
    """Versioned thresholds; the two regions must be apart in one dimension at least."""

    version: str = "v1"
    coverage: float = 0.8
    worth: tuple[float, float, float, float, float] = (0.25, 0.4, 0.7, 0.6, 0.75)
    avoid: tuple[float, float, float, float, float] = (-0.1, 0.8, 0.3, 0.2, 0.7)
    required: tuple[str, ...] = SIGNALS

    def validate(self) -> None:
        if not self.version.strip():
            raise ValueError("a policy needs a version")
        if sorted(self.required) != sorted(SIGNALS):
            raise ValueError("a policy requires each signal once")
        units = (self.coverage, *self.worth[1:], *self.avoid[1:])
        if not all(0 <= x <= 1 for x in units):
            raise ValueError("a threshold isn't from 0 to 1")
        w, a = self.worth, self.avoid
        if not (w[0] > a[0] or w[1] < a[1] or w[2] > a[2] or w[3] > a[3]):
            raise ValueError("the regions aren't separate")


def opportunity(policy: OpportunityPolicy, coverage: Column, has_missing: Column, growth: Column, density: Column, data: Column, reproducibility: Column, confidence: Column) -> Column:
    """Insufficient evidence first, then worth pursuing, then not recommended, else caution."""
    policy.validate()
    w, a = policy.worth, policy.avoid
    worth = (growth >= w[0]) & (density <= w[1]) & (data >= w[2]) & (reproducibility >= w[3]) & (confidence >= w[4])
    avoid = (growth <= a[0]) & (density >= a[1]) & (data <= a[2]) & (reproducibility <= a[3]) & (confidence >= a[4])
    return F.when(has_missing | (coverage < policy.coverage), "insufficient_evidence").when(worth, "worth_pursuing").when(avoid, "not_recommended").otherwise("proceed_with_caution")


def venue_policy(metrics: DataFrame, venue: list[str], kind: str = "venue_type", factor: str = "jif", quartile: str = "quartile") -> DataFrame:
    """Decision on each venue: a factor of 10 or more, or any first quartile, is accepted.

    ``metrics`` has a row for each category of a venue; null factor or quartile is unknown.
    """
    high = F.bool_or(F.coalesce(F.col(factor) >= 10, F.lit(False)))
    first = F.bool_or(F.coalesce(F.col(quartile) == "Q1", F.lit(False)))
    unknown = F.bool_or(F.col(factor).isNull() | F.col(quartile).isNull())
    journal = F.bool_and(F.col(kind) == "journal")
    decision = F.when(~journal, "not_applicable").when(high | first, "accepted").when(unknown, "unknown").otherwise("rejected")
    reasons = F.array_join(F.array_compact(F.array(F.when(high, "jif_gte_10"), F.when(first, "jcr_q1"))), ",")
    return metrics.groupBy(*venue).agg(decision.alias("decision"), F.when(journal, reasons).otherwise("").alias("reasons"))


def segments(points: DataFrame, subject: str, at: str, value: str) -> DataFrame:
    """Runs of known points of each subject, split at unknown ones, scaled to 0..1."""
    w = Window.partitionBy(subject).orderBy(at)
    whole = Window.partitionBy(subject)
    low, high = F.min(value).over(whole), F.max(value).over(whole)
    marked = points.withColumn("_gap", F.sum(F.when(F.col(value).isNull(), 1).otherwise(0)).over(w))
    scaled = marked.withColumn("scaled", F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(0.5))
    return scaled.where(F.col(value).isNotNull()).withColumn("segment", F.dense_rank().over(Window.partitionBy(subject).orderBy("_gap"))).drop("_gap")
