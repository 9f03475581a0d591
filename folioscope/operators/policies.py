"""Versioned policies of ingestion: what is in scope, and which states a projection changes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators import state
from folioscope.operators.components import checkpointed

INCLUDED, EXCLUDED = "included", "excluded"
#: The projection policy of a state that was excluded before any projection.
NOT_APPLICABLE = "not_applicable"
#: Parts of a state that a new policy may change while its event stays the same.
REVISABLE = ("work_id", "scope_status", "scope_policy", "projection_policy", "event_kind")


@dataclass(frozen=True)
class ScopePolicy:
    """A rule under a version: a column of struct(status, reason, evidence) for each record."""

    version: str
    rule: Callable[[], Column]

    def decided(self, records: DataFrame) -> DataFrame:
        """``records`` with status, reason, evidence and the policy's version."""
        if not self.version.strip():
            raise ValueError("a policy needs a version")
        told = records.withColumn("decision", self.rule())
        return told.select(*records.columns, "decision.*", F.lit(self.version.strip()).alias("scope_policy"))


def controlled_identity(version: str, schemes: dict[str, Column]) -> ScopePolicy:
    """Records with an identifier in any controlled scheme are included; ``schemes`` are normalised values."""

    def rule() -> Column:
        found = F.lit(False)
        for v in schemes.values():
            found = found | v.isNotNull()
        return F.struct(
            F.when(found, INCLUDED).otherwise(EXCLUDED).alias("status"),
            F.when(found, "controlled_canonical_identity_present").otherwise("no_supported_canonical_identity").alias("reason"),
            F.lit("identity<-normalized.controlled_identifiers").alias("evidence"),
        )

    return ScopePolicy(version, rule)


def new_decisions(stored: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions (event_id, scope_policy, status, reason, evidence) that aren't stored.

    A stored decision is never changed: a replay that tells otherwise is an error.  One aggregation
    of both tells what is new and what differs; what it finds is kept, and computed once.
    """
    keys, said = ["event_id", "scope_policy"], F.struct("status", "reason", "evidence").alias("said")
    both = stored.select(*keys, said, F.lit(True).alias("kept")).unionByName(decisions.select(*keys, said, F.lit(False).alias("kept")))
    each = both.groupBy(*keys).agg(F.min("said").alias("said"), F.max("said").alias("most"), F.bool_or("kept").alias("kept"))
    differs = ~F.col("said").eqNullSafe(F.col("most"))
    found = checkpointed(each.select(*keys, "said", "kept", differs.alias("differs")).where("differs or not kept"))
    bad = found.agg(F.min(F.when(F.col("differs"), F.struct(*keys, "kept")))).first()[0]
    if bad:
        raise state.ConflictError(f"{'a decision differs from the stored one' if bad['kept'] else 'decisions of one replay differ'}: {bad.asDict()}")
    return found.select(*keys, "said.*")


def projected_states(stored: DataFrame, incoming: DataFrame, keys: list[str], order: tuple[str, ...] = state.ORDER, carried: tuple[str, ...] = ()) -> DataFrame:
    """States after a batch, each with its ``outcome``: projected, excluded, deleted or unchanged.

    An event wins by its ordering tuple.  The same event again changes the state where a
    policy has changed what it says of it; its work stays if the new one names none.
    ``old_work`` is the work of the stored state; columns of ``incoming`` that are ``carried`` come with its latest event.
    """
    rest = [c for c in stored.columns if c not in keys]
    old = stored.select(*keys, F.struct(*rest).alias("old"))
    latest = state.latest_by(incoming.select(*stored.columns, *carried), keys, (*order, "projection_policy", "scope_policy"))
    new = latest.select(*keys, F.struct(*rest, *carried).alias("new"))
    both = old.join(new, keys, "full")
    rank = lambda side: F.struct(*(F.col(f"{side}.{c}").alias(c) for c in order))
    kept_work = F.coalesce(F.col("new.work_id"), F.col("old.work_id"))
    said = lambda side, work: F.struct(work.alias("work_id"), *(F.col(f"{side}.{c}").alias(c) for c in REVISABLE[1:]))
    same = F.col("new.event_id") == F.col("old.event_id")
    revised = same & ~said("new", kept_work).eqNullSafe(said("old", F.col("old.work_id")))
    changed = F.col("new").isNotNull() & (F.col("old").isNull() | (rank("new") > rank("old")) | revised)
    outcome = F.when(~F.coalesce(changed, F.lit(False)), "unchanged").when(F.col("new.event_kind") == "delete", "deleted").when(F.col("new.scope_status") == EXCLUDED, "excluded").otherwise("projected")
    now = F.struct(*(F.col(f"new.{c}").alias(c) for c in rest))
    taken = F.when(outcome == "unchanged", F.coalesce(F.col("old"), F.when(F.col("new").isNotNull(), now))).otherwise(now)
    return both.select(*keys, taken.alias("s"), kept_work.alias("work"), outcome.alias("outcome"), F.col("old.work_id").alias("old_work"), *(F.col(f"new.{c}").alias(c) for c in carried)).select(
        *keys, *(F.when(F.col("outcome") == "unchanged", F.col("s.work_id")).otherwise(F.col("work")).alias(c) if c == "work_id" else F.col(f"s.{c}").alias(c) for c in rest), "outcome", "old_work", *carried
    )
