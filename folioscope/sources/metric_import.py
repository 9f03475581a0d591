"""Metrics of venues from CSV, taken in as a whole or not at all.

First the file gets one verdict: its header, its rows and their limits.  Then its rows are
merged into what is stored: a key that isn't there is inserted, an equal row is unchanged, and
a row that differs is an error.  A receipt, which only one writer can put under its number,
makes the inserted rows count; it carries the hash of the file, so that the same file again is
told the same and changes nothing.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import identifiers
from folioscope.functions.text import trim_space
from folioscope.sources import exclusive
from folioscope.sources.bulk import Refused, digest

#: Columns that a file must have.
REQUIRED = ("issn_l", "issn", "eissn", "metric_year", "category", "jif", "quartile", "status", "source")
KEY = ("issn_l", "metric_year", "category")


class Limits(NamedTuple):
    """What a file may hold at most."""

    size: int = 32 << 20
    rows: int = 250_000
    field_bytes: int = 16 << 10
    decimal_places: int = 6


class Receipt(NamedTuple):
    number: int
    sha256: str
    source: str
    imported_at: str
    input: int
    inserted: int
    unchanged: int


def decimal_text(raw: Column) -> Column:
    """A nonnegative decimal without zeros that say nothing: equal values have equal texts; null if it isn't one."""
    v = trim_space(raw)
    whole, fraction = (F.regexp_extract(v, r"^0*([0-9]+)(?:\.([0-9]+))?$", k) for k in (1, 2))
    fraction = F.regexp_replace(fraction, "0+$", "")
    return F.when(v.rlike(r"^[0-9]+(\.[0-9]+)?$"), F.concat(whole, F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise("")))


def row_problem(limits: Limits) -> Column:
    """What is the matter with a row of ``REQUIRED`` texts, or null."""
    blank = lambda c: F.coalesce(trim_space(F.col(c)), F.lit("")) == ""
    known = trim_space(F.col("status")) == "known"
    places = F.char_length(F.regexp_extract(trim_space(F.col("jif")), r"\.([0-9]+)$", 1))
    long = F.lit(False)
    for c in REQUIRED:
        long = long | (F.octet_length(F.coalesce(F.col(c), F.lit(""))) > limits.field_bytes)
    return (
        F.when(F.col("malformed").isNotNull(), "columns")
        .when(long, "field_bytes")
        .when(identifiers.issn(F.col("issn_l")).isNull(), "issn_l")
        .when((~blank("issn") & identifiers.issn(F.col("issn")).isNull()) | (~blank("eissn") & identifiers.issn(F.col("eissn")).isNull()), "issn")
        .when(~F.coalesce(trim_space(F.col("metric_year")).rlike("^[1-9][0-9]{3}$"), F.lit(False)), "metric_year")
        .when(blank("category"), "category")
        .when(blank("source"), "source")
        .when(~F.coalesce(trim_space(F.col("status")).isin("known", "unknown"), F.lit(False)), "status")
        .when(known & (blank("jif") | blank("quartile")), "known_without_value")
        .when(~known & (~blank("jif") | ~blank("quartile")), "unknown_with_value")
        .when(~blank("jif") & decimal_text(F.col("jif")).isNull(), "jif")
        .when(places > limits.decimal_places, "decimal_places")
        .when(~blank("quartile") & ~trim_space(F.col("quartile")).isin("Q1", "Q2", "Q3", "Q4"), "quartile")
    )


def _header(spark: SparkSession, path: str, limits: Limits) -> list[str]:
    """Names of the columns, in order."""
    first = spark.read.option("multiLine", True).option("escape", '"').csv(path).first()
    names = [(c or "").removeprefix("﻿") if k == 0 else c or "" for k, c in enumerate(first or [])]
    if not names:
        raise Refused("the file is empty")
    if any(len(n.encode()) > limits.field_bytes for n in names):
        raise Refused("a name of a column is too long")
    names = [n.strip() for n in names]
    for k, n in enumerate(names):
        if not n:
            raise Refused(f"column {k + 1} has no name")
        if n in names[:k]:
            raise Refused(f"column {n} is there twice")
    for n in REQUIRED:
        if n not in names:
            raise Refused(f"column {n} is missing")
    return names


def parsed(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """(file, line, problem, ``REQUIRED``) of a file's rows, in a normal form."""
    names = _header(spark, path, limits)
    schema = ", ".join([*(f"_c{k} string" for k in range(len(names))), "malformed string"])
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("columnNameOfCorruptRecord", "malformed").csv(path)
    rows = rows.select(F.col("_metadata.file_name").alias("file"), (F.monotonically_increasing_id().bitwiseAND(2**33 - 1) + 2).alias("line"), "malformed", *(F.col(f"_c{names.index(c)}").alias(c) for c in REQUIRED))
    texts = {c: F.nullif(trim_space(F.col(c)), F.lit("")) for c in REQUIRED}
    texts |= {c: identifiers.issn(F.col(c)) for c in ("issn_l", "issn", "eissn")} | {"jif": decimal_text(F.col("jif"))}
    return rows.withColumn("problem", row_problem(limits)).select("file", "line", "problem", *(texts[c].alias(c) for c in REQUIRED))


class MetricStore:
    """Metrics by ``KEY`` and the receipts of their imports, below a folder that Spark can reach."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def receipts(self) -> list[Receipt]:
        """Receipts in order; one that its writer didn't finish counts for nothing."""
        folder = self._path(f"{self.folder}/receipts")
        found = []
        for s in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            stream = self._fs.open(s.getPath())
            try:
                text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if text.endswith("}"):
                found.append(Receipt(**json.loads(text)))
        return sorted(found)

    def read(self) -> DataFrame | None:
        """All rows that receipts speak of."""
        paths = [f"{self.folder}/rows/{r.number:012d}={r.sha256}" for r in self.receipts() if r.inserted]
        return self.spark.read.parquet(*paths) if paths else None

    def take(self, path: str, imported_at: str, limits: Limits = Limits()) -> Receipt:
        """Takes a file in, or raises ``Refused`` and changes nothing; the same file again gives its first receipt."""
        sha, read = digest(self.spark, path)
        if sum(size for _, size, _ in read) > limits.size:
            raise Refused(f"the file has more than {limits.size} bytes")
        before = self.receipts()
        for r in before:
            if r.sha256 == sha:
                return r
        rows = parsed(self.spark, path, limits)
        told = rows.agg(F.count("*").alias("n"), F.min(F.struct(F.lit(1), "file", "line", "problem")).alias("any"), F.min(F.when(F.col("problem").isNotNull(), F.struct("file", "line", "problem"))).alias("bad"), F.min("source").alias("least"), F.max("source").alias("most")).first()
        if not told["n"]:
            raise Refused("the file has no rows")
        if told["n"] > limits.rows:
            raise Refused(f"the file has more than {limits.rows} rows")
        if told["bad"]:
            raise Refused(f"{told['bad']['file']}, row {told['bad']['line']}: {told['bad']['problem']}")
        if told["least"] != told["most"]:
            raise Refused(f"several sources: {told['least']} and {told['most']}")
        # repeated rows of a key must agree, with each other and with what is stored
        rest = F.struct(*(c for c in REQUIRED if c not in KEY))
        keyed = rows.groupBy(*KEY).agg(F.count("*").alias("times"), F.min(rest).alias("least"), F.max(rest).alias("most"))
        stored = self.read()
        if stored is None:
            both = keyed.withColumn("stored", F.lit(None).cast(keyed.schema["least"].dataType))
        else:
            both = keyed.join(stored.select(*KEY, rest.alias("stored")), list(KEY), "left")
        both = both.withColumn("conflict", ~F.col("least").eqNullSafe(F.col("most")) | (F.col("stored").isNotNull() & ~F.col("stored").eqNullSafe(F.col("least"))))
        sums = both.agg(F.count_if("conflict").alias("conflicts"), F.min(F.when(F.col("conflict"), F.struct(*KEY))).alias("first"), F.count_if(F.col("stored").isNull()).alias("fresh")).first()
        if sums["conflicts"]:
            raise Refused(f"{sums['conflicts']} keys differ from what is told of them elsewhere, such as {tuple(sums['first'])}")
        number = max((r.number for r in before), default=0) + 1
        target = f"{self.folder}/rows/{number:012d}={sha}"
        if sums["fresh"]:
            stage = f"{self.folder}/stage/{uuid.uuid4().hex}"
            both.where("stored is null").select(*KEY, "least.*").write.parquet(stage)
            self._fs.mkdirs(self._path(f"{self.folder}/rows"))
            if not self._fs.exists(self._path(target)):
                self._fs.rename(self._path(stage), self._path(target))
                # beneath the other one's, if that came between
                self._fs.delete(self._path(f"{target}/{stage.rsplit('/', 1)[1]}"), True)
        receipt = Receipt(number, sha, told["least"], imported_at, told["n"], sums["fresh"], told["n"] - sums["fresh"])
        if not exclusive.create(self.spark, f"{self.folder}/receipts/{number:012d}", json.dumps(receipt._asdict()).encode()):
            raise Refused(f"another import has number {number}; try again")
        return receipt
