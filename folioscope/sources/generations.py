"""Immutable, content-addressed generations of a catalog in Parquet, and the pointer to one."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class PublicationRefused(ValueError):
    """A generation that must not be published: how many rows violate each rule, and some keys of theirs."""

    def __init__(self, verdict: dict[str, tuple[int, list[str]]]) -> None:
        self.verdict = verdict
        super().__init__("; ".join(f"{rule}: {n}, such as {', '.join(keys)}" for rule, (n, keys) in verdict.items()))


def _digest_of(order: str, digest: str) -> Column:
    held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(digest).alias("d"))))
    return F.sha2(F.array_join(F.transform(held, lambda x: x["d"]), ","), 256).alias("d")


def tree_digest(hashed: DataFrame, column: str = "h") -> DataFrame:
    """One row (d, n): the digest of a table of hex hashes, whatever their order, and how many there are.

    65,536 leaves hash their sorted hashes, 256 branches their leaves, and the root those, so
    that no task holds all of them; unlike a sum of hashes it can't be met by other rows.
    """
    leaves = hashed.groupBy(F.substring(column, 1, 4).alias("leaf")).agg(_digest_of(column, column), F.count("*").alias("n"))
    branches = leaves.groupBy(F.substring("leaf", 1, 2).alias("branch")).agg(_digest_of("leaf", "d"), F.sum("n").alias("n"))
    return branches.agg(_digest_of("branch", "d"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def revision(papers: DataFrame, formula_version: str) -> str:
    """Content hash: rows in any order give the same one; the time of publication isn't in it."""
    row = F.sha2(F.to_json(F.struct(*sorted(papers.columns)), {"ignoreNullFields": "false"}), 256)
    found = tree_digest(papers.select(row.alias("h"))).first()
    return hashlib.sha256(json.dumps([formula_version, found["d"], found["n"]]).encode()).hexdigest()


#: Keys that a refusal names for each rule.
SAMPLES = 5


def verdict(papers: DataFrame, key: str, rules: dict[str, Column], unique: dict[str, Column]) -> dict[str, tuple[int, list[str]]]:
    """Rules that rows violate: how many, and the smallest keys.

    ``rules`` are conditions that must not hold, all counted in one pass; values of ``unique``,
    where not null, must not be shared by rows.  Aggregations alone: a hot value sends one row a task.
    """
    bad = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    rows = papers.select(F.col(key).cast("string").alias("k"), F.explode(bad).alias("rule")) if rules else None
    for name, value in {f"{key} is shared": F.col(key), **unique}.items():
        shared = papers.groupBy(value.cast("string").alias("v")).agg(F.count("*").alias("n"), F.min(F.col(key).cast("string")).alias("k")).where("n > 1 and v is not null").select("k", F.lit(name).alias("rule"))
        rows = shared if rows is None else rows.union(shared)
    counted = rows.groupBy("rule").agg(F.count("*").alias("n"))
    first = rows.distinct().withColumn("place", F.row_number().over(Window.partitionBy("rule").orderBy("k"))).where(F.col("place") <= SAMPLES)
    named = first.groupBy("rule").agg(F.sort_array(F.collect_list("k")).alias("keys"))
    return {r["rule"]: (r["n"], r["keys"]) for r in counted.join(named, "rule").collect()}


class Store:
    """Generations below a folder of any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def publish(self, papers: DataFrame, key: str, formula_version: str, generated_at: str, rules: dict[str, Column] | None = None, unique: dict[str, Column] | None = None) -> str:
        """Writes a generation, unless the same content is there, and points to it.

        The pointer moves only if the rows that were written have unique keys and violate none of
        the rules (see ``verdict``); else the generation before stays the one that readers get.
        """
        stage = f"{self.folder}/stage-{uuid.uuid4().hex}"
        papers.write.parquet(stage)
        written = self.spark.read.parquet(stage)
        told = verdict(written, key, rules or {}, unique or {})
        if told:
            self._fs.delete(self._path(stage), True)
            raise PublicationRefused(told)
        name = revision(written, formula_version)
        target = f"{self.folder}/gen={name}"
        if self._fs.exists(self._path(f"{target}/_SUCCESS")):
            self._fs.delete(self._path(stage), True)
        else:
            # what a writer left half done goes
            self._fs.delete(self._path(target), True)
            self._fs.rename(self._path(stage), self._path(target))
            self._put(f"{target}.json", json.dumps({"revision": name, "formula_version": formula_version, "generated_at": generated_at}))
        self._point(name)
        return name

    def _put(self, path: str, content: str) -> None:
        stream = self._fs.create(self._path(path), True)
        stream.write(content.encode())
        stream.close()

    def _pointers(self) -> list[tuple[int, str]]:
        """Pointers (number, revision) by their names alone, in order."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        return sorted((int(n.split("=")[1]), n.split("=")[2]) for n in names if n.startswith("current="))

    def _point(self, name: str) -> None:
        """A new numbered pointer: it appears at once, and readers find one at any time.

        Its name says all, so a reader never sees half of one; the one before it stays for
        readers that have just listed it.
        """
        found = self._pointers()
        if found and found[-1][1] == name:
            return
        number = found[-1][0] + 1 if found else 1
        if not self._fs.createNewFile(self._path(f"{self.folder}/current={number:012d}={name}")):
            raise RuntimeError("another publication took this number")
        for n, r in found[:-1]:
            self._fs.delete(self._path(f"{self.folder}/current={n:012d}={r}"), False)

    def current(self) -> str:
        """The revision that readers get; read once for each query."""
        return self._pointers()[-1][1]

    def read(self, name: str | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/gen={name or self.current()}")
