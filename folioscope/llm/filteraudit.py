"""Interaction of quality filters: what each order of them removes, part by part.

Method: exact duplicates come from a sort.  Documents are dealt by ranges of (text
fingerprint, doc_id) and sorted within a range by fingerprint, full text and doc_id, so that
each is compared with its predecessor.  A text may go on over the edge of a range: the heads
of a range's first and last fingerprints are settled afterwards, by one aggregation over at
most a few rows a range.  A document's five outcomes are a mask of failures; masks are counted
per part, and since counts add up, every order of the filters follows from the counts.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.batches import small_batches
from folioscope.operators.components import checkpointed

#: The filters, in order of their bits in a mask of failures.
FILTERS = "ABCDE"
_E = 1 << FILTERS.index("E")


def failures(text: Column) -> Column:
    """The mask of what a text fails by itself, filters A to D; the text isn't null.

    A: under 50 words; B: 100 * distinct words < 65 * words; C: 100 * capitals A-Z > 5 * code
    points; D: one of ``#$%&*|``.  Words are between ASCII white space.
    """
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    capitals = F.octet_length(text) - F.octet_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = (
        n < 50,
        F.lit(100) * F.size(F.array_distinct(words)) < F.lit(65) * n,
        F.lit(100) * capitals > F.lit(5) * F.char_length(text),
        F.octet_length(F.translate(text, "#$%&*|", "")) < F.octet_length(text),
    )
    return sum((F.when(fail, 1 << k).otherwise(0) for k, fail in enumerate(fails)), F.lit(0)).cast("int")


class Runs:
    """Follows the rows of a range, which come in order of print, text and id."""

    def __init__(self) -> None:
        self.print: int | None = None
        #: Texts with the latest print, and the smallest id of each in this range.
        self.heads: list[tuple[bytes, int]] = []
        self.in_first = True

    def take(self, prints: np.ndarray, texts: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the next rows: whether each is the first of its text here, whether its id is above that
        of its text's first row, and whether its print is the first one of the range."""
        n = len(ids)
        fresh, turned = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
        turned[1:] = prints[1:] != prints[:-1]
        fresh[1:] = turned[1:] | ~pc.equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        turned[0] = self.print is not None and int(prints[0]) != self.print
        fresh[0] = self.print is None or turned[0] or texts[0].as_py() != self.heads[-1][0]
        head = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))
        head_ids = np.where(head < 0, self.heads[-1][1] if self.heads else 0, ids[head])
        in_first = self.in_first & (np.cumsum(turned) == 0)
        if turned.any():
            self.heads = []
        last = np.flatnonzero(fresh & (prints == prints[-1]))
        self.heads += zip(texts.take(pa.array(last)).to_pylist(), ids[last].tolist(), strict=True)
        self.print, self.in_first = int(prints[-1]), bool(in_first[-1])
        return fresh, ids > head_ids, in_first


def _compared(ordered: DataFrame) -> DataFrame:
    """(id, part, mask, n, print, text) of rows (print, text, id, part, mask) in order.

    ``n`` counts equal neighbours.  ``text`` is there where an earlier range may hold a row of
    the same text: in the first print of a range.  Rows with an ``n`` of 0 tell the later ranges
    of a range's last print.
    """
    names = ["id", "part", "mask", "n", "print", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        follow = Runs()
        for batch in batches:
            if not len(batch):
                continue
            prints, ids, parts = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(3)
            texts = batch.column(1).cast(pa.binary())
            fresh, repeated, in_first = follow.take(prints, texts, ids)
            mask = batch.column(4).to_numpy() | np.where(repeated, _E, 0).astype(np.int32)
            new = fresh | repeated
            new[1:] |= ~pc.equal(parts.slice(1), parts.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False)
            new[0] = True
            at = np.flatnonzero(new)
            open_texts = pc.if_else(pa.array((in_first & ~repeated)[at]), texts.take(pa.array(at)), pa.scalar(None, pa.binary()))
            n = np.diff(np.append(at, len(ids))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), parts.take(pa.array(at)), pa.array(mask[at]), pa.array(n), pa.array(prints[at]), open_texts], names=names)
        if follow.heads:
            texts, ids = zip(*follow.heads, strict=True)
            k = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([""] * k), pa.array([0] * k, pa.int32()), pa.array([0] * k, pa.int64()), pa.array([follow.print] * k, pa.int64()), pa.array(texts, pa.binary())], names=names
            )

    return small_batches(ordered).mapInArrow(run, "id long, part string, mask int, n long, print long, text binary")


def masks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Rows (id, part, mask, n): the failures of all documents; ``n`` tells how many rows are alike.

    Bits of ``mask``, from the lowest, are filters A to E.  A null text counts as the empty one
    and a null part as the empty string.  E fails a row whose text a row with a smaller id has,
    in any part; rows of one id and text fare alike.  A row without an id neither repeats a text
    nor is repeated.  An empty table gives an empty one; other columns are not read.
    """
    text, part = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("id"), part.alias("part"), text.alias("text"))
    known = rows.where("id is not null").select(F.xxhash64("text").alias("print"), "text", "id", "part", F.monotonically_increasing_id().alias("place"))
    # ranges are told by numbers only, so that no text is sampled; ``place`` splits a row that is repeated many times
    ranged = known.repartitionByRange("print", "id", "place").sortWithinPartitions("print", "text", "id", "part")
    found = checkpointed(_compared(ranged.select("print", "text", "id", "part", failures(F.col("text")).alias("mask"))))
    open_rows = found.where("text is not null")
    least = open_rows.groupBy("print", "text").agg(F.min("id").alias("least")).hint("merge")
    mask = F.when(F.col("id") > F.col("least"), F.col("mask").bitwiseOR(_E)).otherwise(F.col("mask"))
    settled = open_rows.join(least, ["print", "text"]).where("n > 0").select("id", "part", mask.alias("mask"), "n")
    lone = rows.where("id is null").select("id", "part", failures(F.col("text")).alias("mask"), F.lit(1).cast("long").alias("n"))
    return found.where("text is null").select("id", "part", "mask", "n").union(settled).union(lone)


def _steps() -> list[tuple[str, int, int, int]]:
    """(filter_order, step, bit, bits of the filters before it) of all orders."""
    out = []
    for order in itertools.permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            out.append(("".join(order), step, bit, before))
            before |= bit
    return out


def audit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    One row for each part, order of the five filters and step; the filter of a step is that
    letter of ``filter_order``.  ``labels`` has (``id_col``, quality, toxic); of several rows of
    an id, one with quality 1 (toxic 1) is enough; ids that are null or not among the documents
    count for nothing.  What a part holds is read once: a part has at most 128 kinds of documents
    (mask, good, toxic), whatever its size.  See ``masks`` for nulls and repeats.
    """
    told = labels.select(F.col(id_col).cast("long").alias("id"), (F.col("quality") == 1).alias("g"), (F.col("toxic") == 1).alias("t")).where("id is not null")
    told = told.groupBy("id").agg(F.coalesce(F.max("g"), F.lit(False)).alias("good"), F.coalesce(F.max("t"), F.lit(False)).alias("toxic"))
    found = masks(df, id_col, text_col, part_col).join(told.hint("merge"), "id", "left")
    kinds = found.groupBy("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(F.sum("n").alias("n"))
    # what a filter does after a set of others, in whatever order those came
    every = 2 ** len(FILTERS) - 1
    after = [F.struct(F.lit(1 << k).alias("bit"), F.lit(b).alias("before")) for k in range(len(FILTERS)) for b in range(every + 1) if not b >> k & 1]
    at = kinds.withColumn("at", F.explode(F.array(*after))).select("part", "mask", "good", "toxic", "n", "at.bit", "at.before")
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    count = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    # of the orders, the filter comes first among the failed ones in an equal share
    share = F.when(fails, F.col("n") * F.expr(f"{len(_steps()) // len(FILTERS)} div bit_count(mask)")).otherwise(0)
    counted = at.groupBy("part", "bit", "before").agg(
        count(~gone & ~fails).alias("kept"),
        count(~gone & fails).alias("removed"),
        count(gone & fails).alias("redundant"),
        count(F.col("mask") == F.col("bit")).alias("unique_fails"),
        count(~gone & fails & F.col("good")).alias("good_lost"),
        count(~gone & fails & F.col("toxic")).alias("toxic_lost"),
        F.sum(share).alias("shapley"),
    )
    steps = df.sparkSession.createDataFrame(_steps(), "filter_order string, step int, bit int, before int")
    # 600 rows, whatever the documents
    return counted.join(F.broadcast(steps), ["bit", "before"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
