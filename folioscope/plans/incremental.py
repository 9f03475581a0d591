"""A catalog kept up batch by batch: events, decisions, states, winners, and what these say of works.

A batch touches the works that its changed records belong to, now and before.  Only those
works' winners, authors, topics, repositories, assertions and metrics are derived anew; rows
of other works are neither computed nor written.  All tables of a batch become visible at
once, by one numbered commit, and a batch that runs again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import policies, projection, state
from folioscope.operators.components import checkpointed
from folioscope.sources import exclusive
from folioscope.sources.keyed_log import KeyedLog, existing

#: The newest commit's row of a key counts.
_NEWEST = ("commit",)
#: What is derived from a work's winner, and how.
CHILDREN = {"authors": projection.authors, "topics": projection.topics, "repositories": projection.repositories, "assertions": projection.assertions}
#: Columns of a record that the children are derived from.
FIELDS = ("title", "abstract", "published_at", "venue", "citation_count", "authors", "topics", "code_urls", "observed_at")


class Catalog:
    """Tables of a catalog below a folder, under a scope policy and the version of a projection.

    ``decisions``, ``states`` (by event key), ``members`` (the records of each work), ``works``
    (the winner of each), the ``CHILDREN`` of works and ``metrics``.
    """

    def __init__(self, spark: SparkSession, folder: str, policy: policies.ScopePolicy, projection_policy: str) -> None:
        self.spark, self.folder, self.policy, self.projection_policy = spark, folder.rstrip("/"), policy, projection_policy
        log = lambda name, keys: KeyedLog(spark, f"{self.folder}/{name}", keys, _NEWEST)
        self.decisions = log("decisions", ["event_id", "scope_policy"])
        self.states = log("states", ["event_key"])
        self.members = log("members", ["work_id", "event_key"])
        self.works = log("works", ["work_id"])
        self.children = {name: log(name, ["work_id"]) for name in CHILDREN}
        self.metrics = log("metrics", ["work_id", "source", "observed_at"])
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _logs(self) -> list[KeyedLog]:
        return [self.decisions, self.states, self.members, self.works, self.metrics, *self.children.values()]

    def committed(self) -> int:
        """The number of the newest commit; 0 before the first."""
        folder = self._path(f"{self.folder}/commits")
        return max((int(s.getPath().getName()) for s in self._fs.listStatus(folder)), default=0) if self._fs.exists(folder) else 0

    def apply(self, events: DataFrame, number: int) -> dict[str, int] | None:
        """Takes in batch ``number``, which follows the newest commit; null if it was taken in before.

        ``events`` have event_key, event_kind, source, the ordering tuple, work_id, the columns that the
        policy reads, and ``FIELDS``; they are computed twice, for decisions and for states, and must be the same.  Returns how many records changed and works were derived.
        """
        last = self.committed()
        if number <= last:
            return None
        if number != last + 1:
            raise ValueError(f"batch {number} doesn't follow {last}")
        decided = self.policy.decided(events).withColumn("projection_policy", F.lit(self.projection_policy))
        told = decided.select("event_id", "scope_policy", "status", "reason", "evidence")
        self._write(self.decisions, policies.new_decisions(existing(self._stored(self.decisions, last), told), told), number)

        incoming = decided.select("event_key", *state.ORDER, "event_kind", "work_id", F.col("status").alias("scope_status"), "scope_policy", "projection_policy")
        before = existing(self._read(self.states, last), incoming)
        # fields come with the latest event of a record, which is all that is shuffled of them; where its
        # policy alone has changed, it brings them again
        fields = decided.select(*(F.col("status").alias(c) if c == "scope_status" else F.col(c) for c in incoming.columns), F.struct("source", *FIELDS).alias("fields"))
        changed = checkpointed(policies.projected_states(before, fields, ["event_key"], carried=("fields",)).where("outcome <> 'unchanged'"))
        self._write(self.states, changed.select(*incoming.columns), number)

        # a record is a member of its work now, and is gone from the one that it has left
        now = F.when(F.col("work_id").isNotNull(), F.struct("work_id", F.lit(False).alias("gone")))
        left = F.when(F.col("old_work").isNotNull() & ~F.col("old_work").eqNullSafe(F.col("work_id")), F.struct(F.col("old_work").alias("work_id"), F.lit(True).alias("gone")))
        works = F.filter(F.array(now, left), lambda w: w.isNotNull())
        fresh = changed.withColumn("w", F.explode(works)).select("event_key", "event_kind", *state.ORDER, "w.work_id", (F.col("scope_status") == policies.INCLUDED).alias("included"), "fields.*", "w.gone")
        self._write(self.members, fresh, number)

        touched = checkpointed(fresh.select("work_id").distinct())
        kept = existing(self._read(self.members, last), fresh).join(touched, "work_id", "left_semi").join(fresh.select("work_id", "event_key"), ["work_id", "event_key"], "left_anti")
        winners = checkpointed(state.winners(kept.unionByName(fresh).where("not gone"), "work_id"))
        rows = touched.join(winners.select("work_id", F.col("event_key").alias("winner"), "event_id", "source", "source_time", "title"), "work_id", "left")
        self._write(self.works, rows.withColumn("gone", F.col("winner").isNull()), number)
        for name, derive in CHILDREN.items():
            # all rows of a work in one, so that a work's former rows are replaced together
            held = derive(winners).groupBy("work_id").agg(F.sort_array(F.collect_list(F.struct(*(c for c in derive(winners).columns if c != "work_id")))).alias("rows"))
            self._write(self.children[name], touched.join(held, "work_id", "left"), number)
        counted = winners.select("work_id", "source", "observed_at", "citation_count")
        metric = counted.select("work_id", "source", "observed_at", F.col("citation_count").alias("value"))
        self._write(self.metrics, projection.citation_metrics(counted, existing(self._read(self.metrics, last), metric)), number)

        if not exclusive.create(self.spark, f"{self.folder}/commits/{number:012d}", b""):
            raise RuntimeError("another writer took this number")
        for log in self._logs():
            log.compact(number)
        return {"records": changed.count(), "works": touched.count()}

    def _write(self, log: KeyedLog, rows: DataFrame, number: int) -> None:
        # what a batch left behind that didn't come to its commit is overwritten
        # every table of a batch is an aggregation by its keys, or made of one
        log.append(rows.withColumn("commit", F.lit(number).cast("long")), number, again=True, unique=True)

    def _read(self, log: KeyedLog, upto: int) -> DataFrame | None:
        rows = log.read(upto)
        return None if rows is None else rows.drop("commit")

    def _stored(self, log: KeyedLog, upto: int) -> DataFrame | None:
        """Rows of a log as batches wrote them, for a reader that merges those of a key itself."""
        rows = log.rows(upto)
        return None if rows is None else rows.drop("commit")

    def table(self, name: str) -> DataFrame:
        """A table as of the newest commit: ``states``, ``works``, ``metrics`` or one of ``CHILDREN``; works without a winner are left out."""
        last = self.committed()
        if name in self.children:
            return self._read(self.children[name], last).select("work_id", F.inline("rows"))
        rows = self._read(getattr(self, name), last)
        return rows.where("not gone").drop("gone") if name == "works" else rows


def demonstration_record(key: Column, event: Column, value: Column, kind: Column) -> dict[str, Column]:
    """Fields of a record in the roles of ``events``: what the queries feed a catalog with."""
    none = F.lit(None).cast("string")
    author = lambda name, orcid: F.struct(name.alias("name"), none.alias("collective"), orcid.alias("orcid"), F.lit(0).alias("position"), F.lit(None).cast("boolean").alias("corresponding"))
    return {
        "title": F.concat(kind, F.lit(" "), event.cast("string")),
        "abstract": F.when(event % 4 == 0, F.lit("told")),
        "published_at": none,
        "venue": kind,
        "citation_count": F.floor(value),
        "authors": F.array(author(F.concat(F.lit("Author "), (event % 9).cast("string")), none), author(key, none)),
        "topics": F.array(F.struct(kind.alias("name"), F.lit(None).cast("double").alias("score"))),
        "code_urls": F.when(event % 2 == 0, F.array(F.concat(F.lit("https://github.com/org/r"), (event % 7).cast("string")))),
        "observed_at": F.lit("2024-02-01"),
    }
