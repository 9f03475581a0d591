"""Mixing of sources to target weights, in DataFrame functions only.

Method (temperature mixing): each source's share of tokens is raised to an exponent and
the results are normalised to weights.  The exponent is bisected until the weights meet a
target entropy, or until no source is repeated more than a limit allows.  Weights become
rows by budgeted block permutations: a source's rows are put in a new pseudo-random order
in each pass; whole passes are used while the source's budget lasts, and the last pass is
used as far as the budget goes.

Running sums are taken in two levels (within small hash buckets, then over bucket sums), so
that no source, however large, is sorted in one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.operators.components import checkpointed

#: Rows that a bucket of the permutation holds about.
BUCKET_ROWS = 2000
#: Sources up to which their plan is broadcast (a few MB); beyond it the join is shuffled.
BROADCAST_SOURCES = 50_000
#: Parts that a pass of the bisection halves an interval into, and passes; the exponent is
#: then known to 1 in 10**14.
FAN, ROUNDS = 64, 8


def word_count(text: Column) -> Column:
    """Words between white space; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Shares:
    """Sources with tokens: the smallest and the largest share of the tokens, and their sum."""

    least: float
    most: float
    total: int


def _sums(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """For each exponent a, the sums over sources of p**a and of p**a * ln p, in one pass."""
    columns = []
    for i, a in enumerate(exponents):
        raised = F.pow("share", F.lit(a))
        columns += [F.sum(raised).alias(f"z{i}"), F.sum(raised * F.log("share")).alias(f"s{i}")]
    row = shares.agg(*columns).first()
    return [(row[f"z{i}"], row[f"s{i}"]) for i in range(len(exponents))]


def exponent_for(shares: DataFrame, of: Shares, budget: float | None, target_entropy: float | None, max_repeats: float | None) -> float:
    """The exponent in [0, 1] nearest to 0 that meets the target, by bisection.

    With ``target_entropy`` (in nats), the exponent at which the weights have that entropy;
    0 or 1 where the target is out of reach.  With ``max_repeats``, the smallest exponent at
    which no source is repeated more often; 1, the sources' own shares, where even these
    repeat more.  Halvings are taken ``FAN`` points at a time, each batch in one pass over
    the shares, so that no table of sources comes to the driver.
    """

    def enough(points: list[float]) -> list[bool]:
        if target_entropy is None and budget is None:
            # the source with the least repetition passes once, so Z cancels out
            return [(of.most / of.least) ** (1 - a) <= max_repeats for a in points]
        sums = _sums(shares, points)
        if target_entropy is not None:
            return [math.log(z) - a * s / z <= target_entropy for a, (z, s) in zip(points, sums, strict=True)]
        return [budget * of.least ** (a - 1) / (z * of.total) <= max_repeats for a, (z, _) in zip(points, sums, strict=True)]

    if enough([0.0])[0]:
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        points = [low + (high - low) * k / FAN for k in range(1, FAN)]
        first = next((k for k, yes in enumerate(enough(points)) if yes), len(points))
        low, high = (points[first - 1] if first else low), (points[first] if first < len(points) else high)
    return high


def mix(df: DataFrame, tokens: Column, id_col: str = "doc_id", source_col: str = "source", budget: float | None = None, target_entropy: float | None = None, max_repeats: float | None = None, seed: int = 0) -> DataFrame:
    """``df``'s rows as often as the mixture takes them, with the mixture's columns.

    Columns added: ``mix_tokens`` (of the row), ``mix_pass`` (from 0) and ``mix_end`` (running
    sum of tokens of the source in its pass).  Of columns with those names in ``df`` the
    mixture's stay; other columns stay, whatever their names.  ``budget`` is the mixture's
    number of tokens; by default that at which the source with the least repetition passes
    exactly once, so that every row is taken.  Sources may be any number, and one may hold
    any part of the rows.  A null source counts as a source of its own; rows without tokens
    are taken in every whole pass.  Rows with equal id and tokens are interchangeable.  An
    empty table gives an empty one.
    """
    name = F.coalesce(F.concat(F.lit("s:"), F.col(source_col).cast("string")), F.lit("null"))
    own = df.drop("mix_tokens", "mix_pass", "mix_end").columns
    # the caller's columns travel in a struct, so that no name of theirs meets one of these
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("own"), F.col(id_col).alias("id"), name.alias("source"), F.coalesce(tokens.cast("long"), F.lit(0).cast("long")).alias("mix_tokens"))
    totals = checkpointed(rows.groupBy("source").agg(F.sum("mix_tokens").cast("long").alias("have"), F.count("*").alias("n")))
    if target_entropy is None and max_repeats is None:
        max_repeats = 1.0
    goals = plan(totals, budget, target_entropy, max_repeats)
    if totals.count() <= BROADCAST_SOURCES:
        goals = F.broadcast(goals)
    # a row of one pass more than whole ones is taken while the source's budget lasts
    passes = F.when(F.col("have") > 0, F.floor(F.col("goal") / F.col("have") + 1e-9)).otherwise(1).cast("int")
    spread = rows.join(goals, "source").withColumn("whole", passes).withColumn("left", F.when(F.col("have") > 0, F.greatest(F.lit(0.0), F.col("goal") - F.col("whole") * F.col("have"))).otherwise(0.0))
    last = F.when(F.col("left") > 0, F.col("whole")).otherwise(F.col("whole") - 1)
    spread = spread.where(last >= 0).withColumn("mix_pass", F.explode(F.sequence(F.lit(0), last)))
    key = F.xxhash64("id", F.lit(seed), F.col("mix_pass"))
    spread = spread.withColumn("key", key).withColumn("bucket", F.pmod(F.shiftrightunsigned("key", 20), F.col("buckets").cast("long")).cast("int"))
    place = ["source", "mix_pass", "bucket"]
    sums = spread.groupBy(*place).agg(F.sum("mix_tokens").alias("held"))
    before = Window.partitionBy("source", "mix_pass").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*place, F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy(*place).orderBy("key", "id", "mix_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = spread.withColumn("mix_end", F.sum("mix_tokens").over(within)).join(sums, place).withColumn("mix_end", F.col("mix_end") + F.col("before"))
    taken = running.where((F.col("mix_pass") < F.col("whole")) | (F.col("mix_end") <= F.col("left")))
    return taken.select(*(F.col("own").getField(c).alias(c) for c in own), "mix_tokens", "mix_pass", "mix_end")


def plan(totals: DataFrame, budget: float | None, target_entropy: float | None, max_repeats: float | None) -> DataFrame:
    """(source, have, goal, buckets) of (source, have, n): the tokens that a source is to give (see ``mix``)."""
    found = totals.where("have > 0").agg(F.min("have").alias("least"), F.max("have").alias("most"), F.sum("have").alias("total")).first()
    goal = F.lit(0.0)
    if found["total"]:
        total = int(found["total"])
        of = Shares(found["least"] / total, found["most"] / total, total)
        share = F.col("have") / F.lit(float(total))
        shares = totals.where("have > 0").select(share.alias("share"))
        exponent = exponent_for(shares, of, budget, target_entropy, max_repeats)
        z = _sums(shares, [exponent])[0][0]
        spent = total * z * of.most ** (1 - exponent) if budget is None else budget
        goal = F.when(F.col("have") > 0, F.lit(float(spent)) * F.pow(share, F.lit(exponent)) / F.lit(z)).otherwise(0.0)
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET_ROWS)).cast("int")
    return totals.select("source", F.col("have").cast("double").alias("have"), goal.alias("goal"), buckets.alias("buckets"))
