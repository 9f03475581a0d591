"""State of an ingestion job, and the order of the files it takes."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values.
STAGES = ("batch", "raw", "normalize", "project", "policy", "ranking")
STATUSES = ("pending", "running", "succeeded", "failed", "cancelled")


@dataclass(frozen=True)
class Job:
    """A job: pending, then running through stages in any order, then ended for good."""

    batch_key: str
    source: str
    idempotency_key: str
    id: str = ""
    status: str = "pending"
    stage: str = "batch"

    def __post_init__(self) -> None:
        for name in ("batch_key", "source", "idempotency_key"):
            if not getattr(self, name).strip():
                raise ValueError(f"a job needs a {name}")
        if self.status not in STATUSES or self.stage not in STAGES:
            raise ValueError("no such status or stage")
        if self.status != "pending" and not self.id.strip():
            raise ValueError("a job that was started has an id")

    def start(self, id: str) -> Job:
        if self.status != "pending":
            raise ValueError(f"a job can't start when {self.status}")
        if not id.strip() or (self.id and self.id != id.strip()):
            raise ValueError("the id is blank or another one")
        return replace(self, id=id.strip(), status="running")

    def at(self, stage: str) -> Job:
        self._running("change its stage")
        return replace(self, stage=stage)

    def end(self, status: str) -> Job:
        self._running("end")
        if status not in STATUSES[2:]:
            raise ValueError(f"a job doesn't end as {status}")
        return replace(self, status=status)

    def _running(self, what: str) -> None:
        if self.status != "running":
            raise ValueError(f"a job can't {what} when {self.status}")


def sequence_problems(files: DataFrame, year: int, previous: int) -> DataFrame:
    """(position, name, sequence, problem) of bulk files in the order they are given.

    Names are ``pubmed<yy>n<nnnn>.xml.gz``; sequences follow ``previous`` one by one, and each
    file has a SHA-256 in lower case.  Files are few (one for each day), so one window orders them.
    """
    pattern = rf"^pubmed{year % 100:02d}n([0-9]{{4}})\.xml\.gz$"
    text = F.regexp_extract("name", pattern, 1)
    rows = files.withColumn("sequence", F.when(text != "", text.cast("int")))
    before = F.lag("sequence", 1, previous).over(Window.orderBy("position"))
    seen = F.count("*").over(Window.partitionBy("sequence").orderBy("position"))
    problem = (
        F.when(F.col("sequence").isNull(), "name")
        .when(seen > 1, "duplicate")
        .when(~F.coalesce(F.trim("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "sha256")
        .when(F.col("sequence") <= before, "out_of_order")
        .when(F.col("sequence") != before + 1, "missing_before")
    )
    return rows.select("position", "name", "sequence", problem.alias("problem"))
