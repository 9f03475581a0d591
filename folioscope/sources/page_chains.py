"""Chains of stored pages: what an interface gave page after page, each page naming the next by a cursor.

Pages lie in ``<path>/chain=<name>/page=<number>/``, a file each, numbered from 1; names of chains
have letters, digits, ``.``, ``_`` and ``-``.  A chain is good up to its first problem: all before it
is delivered, and nothing behind it.  Chains of any length are checked by ranges and joins of small
rows, a row a page; texts of pages aren't shuffled.

=====================  ================================================================
problem                where
=====================  ================================================================
``page``               a page that isn't whole JSON or has no list of items
``page given twice``   a number with several files
``page missing``       the page whose number follows a gap
``page after the end`` a page behind one that ends the chain
``empty page``         no items, but a cursor (lists that a missing cursor ends)
``no cursor``          a full page without a cursor (lists that a short page ends)
``cursor repeated``    behind the items of a page whose cursor an earlier one, or the start, has
an item's problem      see ``records.malformed``
=====================  ================================================================
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import trim_space
from folioscope.operators.components import checkpointed
from folioscope.operators.ranking import placed_within, summed_before
from folioscope.sources import records

PLACE = r"/chain=([A-Za-z0-9._-]+)/page=([0-9]{1,9})/[^/]+$"
START = "*"
FORM = "results array<string>, meta struct<next_cursor:string>, message struct<items:array<string>,`next-cursor`:string>, _corrupt_record string"


def _place() -> list[Column]:
    lost = F.raise_error(F.format_string("%s isn't in a chain", "file")).cast("string")
    part = lambda k: F.when(F.col("file").rlike(PLACE), F.regexp_extract("file", PLACE, k)).otherwise(lost)
    return [part(1).alias("chain"), part(2).cast("int").alias("page")]


def _headers(spark: SparkSession, path: str) -> DataFrame:
    """(chain, page, files, n, next, whole): a row for each number of a page."""
    pages = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("file"))
    told = pages.select("file", F.from_json("value", FORM, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("p"))
    found = F.when(F.col("p._corrupt_record").isNull(), F.coalesce("p.results", "p.message.items"))
    cursor = F.nullif(trim_space(F.coalesce("p.meta.next_cursor", "p.message.`next-cursor`")), F.lit(""))
    rows = told.select(*_place(), F.coalesce(F.size(F.coalesce(found, F.array().cast("array<string>"))), F.lit(0)).cast("long").alias("n"), cursor.alias("next"), found.isNotNull().alias("whole"))
    return rows.groupBy("chain", "page").agg(F.count("*").alias("files"), F.min(F.struct("n", "next", "whole")).alias("h")).select("chain", "page", "files", "h.*")


def _page_problems(headers: DataFrame, full: int | None) -> DataFrame:
    """(chain, page, at, problem): ``at`` is 0 before a page's items and one more than they are behind them."""
    ends = F.col("whole") & (F.col("next").isNull() if full is None else F.col("n") < full)
    last = headers.where(ends).groupBy("chain").agg(F.min("page").alias("end"))
    first = headers.where("next is not null").groupBy("chain", "next").agg(F.min("page").alias("first"))
    rows = placed_within(headers, ["chain"], ["page"], "place").join(last, "chain", "left").join(first, ["chain", "next"], "left")
    before = (
        F.when(F.col("files") > 1, "page given twice")
        .when(F.col("page") != F.col("place"), "page missing")
        .when(F.col("page") > F.col("end"), "page after the end")
        .when(~F.col("whole"), "page")
    )
    if full is None:
        before = before.when((F.col("n") == 0) & F.col("next").isNotNull(), "empty page")
        none, goes_on = F.lit(False), F.lit(True)
    else:
        none, goes_on = F.col("next").isNull() & (F.col("n") >= full), F.col("n") >= full
    behind = F.when(none, "no cursor").when(goes_on & ((F.col("first") < F.col("page")) | (F.col("next") == START)), "cursor repeated")
    found = rows.select("chain", "page", F.when(before.isNotNull(), 0).otherwise(F.col("n") + 1).cast("long").alias("at"), F.coalesce(before, behind).alias("problem"))
    return found.where("problem is not null")


class Chains:
    """The chains below a folder; ``source`` is ``openalex`` (a missing cursor ends) or ``crossref``.

    ``full`` is the number of items of a full page, for ``crossref`` only: a page with fewer ends.
    """

    def __init__(self, spark: SparkSession, path: str, source: str, full: int | None = None) -> None:
        if source not in ("openalex", "crossref") or (full is None) != (source == "openalex") or (full is not None and full < 1):
            raise ValueError("chains are of openalex, or of crossref with the size of a full page")
        self._items = {"openalex": records._openalex_items, "crossref": records._crossref_items}[source](spark, path + "/*/*", "file_path")
        self._read = {"openalex": records.openalex, "crossref": records.crossref}[source]
        self.spark, self.path = spark, path
        headers = checkpointed(_headers(spark, path))
        self._pages = checkpointed(summed_before(headers, ["chain"], ["page"], "n", "items_before"))
        wrong = self._items.where("problem is not null").select(*_place(), F.col("item").cast("long").alias("at"), "problem").where("at > 0")
        every = _page_problems(headers, full).unionByName(wrong)
        # items and pages that are wrong are few or many: the first of a chain is an aggregate
        self._first = checkpointed(every.groupBy("chain").agg(F.min(F.struct("page", "at", "problem")).alias("first")))

    def verdicts(self) -> DataFrame:
        """(chain, pages, items, page, item, problem): what each chain delivers, and what it stops at, if anything.

        ``items`` are those before the problem; ``item`` is the number within its page, 0 for
        the page itself.
        """
        at = F.col("first.at")
        until = F.when(F.col("page") == F.col("first.page"), F.col("items_before") + F.greatest(at - 1, F.lit(0)))
        chains = self._pages.groupBy("chain").agg(F.count("*").alias("pages"), F.sum("n").alias("all_items"))
        stops = self._pages.join(self._first, "chain").where(F.col("page") == F.col("first.page")).select("chain", until.alias("items"), F.col("first.page").alias("page"), at.alias("item"), F.col("first.problem").alias("problem"))
        return chains.join(stops, "chain", "left").select("chain", "pages", F.coalesce("items", "all_items").alias("items"), "page", "item", "problem")

    def items(self) -> DataFrame:
        """(chain, page, item, ordinal, raw, r): the items before each chain's problem, with their place in it."""
        rows = self._items.where("item > 0").select(*_place(), F.col("item").cast("long").alias("item"), "raw", "r")
        kept = rows.join(self._first, "chain", "left").where(F.col("first").isNull() | (F.struct(F.col("page").alias("p"), F.col("item").alias("i")) < F.struct(F.col("first.page").alias("p"), F.col("first.at").alias("i"))))
        # a file of a number that is given twice stands behind its problem
        placed = kept.join(self._pages.select("chain", "page", "items_before"), ["chain", "page"])
        return placed.select("chain", "page", "item", (F.col("items_before") + F.col("item")).alias("ordinal"), "raw", "r")

    def records(self) -> DataFrame:
        """The items' records, in the shape of all readers."""
        return self._read(self.spark, self.path, items=self.items())
