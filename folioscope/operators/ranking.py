"""Places in a total order over a table of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.operators.components import checkpointed


def placed(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their place from 1 in ``order``, in which no two rows are equal.

    Rows are dealt by ranges of the order, numbered within each range, and moved up by the
    rows of the ranges before, of which there are as many as partitions.
    """
    ranged = checkpointed(rows.repartitionByRange(*order).withColumn("range_of_rows", F.spark_partition_id()))
    counts = ranged.groupBy("range_of_rows").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range_of_rows").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("range_of_rows", before.alias("rows_before"))
    within = F.row_number().over(Window.partitionBy("range_of_rows").orderBy(*order))
    return ranged.withColumn(name, within).join(F.broadcast(offsets), "range_of_rows").withColumn(name, F.col(name) + F.col("rows_before")).drop("range_of_rows", "rows_before")


def best_before(rows: DataFrame, keys: list[str], order: str, value: str, width: int, name: str) -> DataFrame:
    """``rows`` with the greatest ``value`` of their key before them in ``order``, a whole number; null for the first.

    A key's rows are cut into spans of ``width`` numbers: maxima of whole spans are carried
    over, so that a hot key is sorted span by span and not in one task.
    """
    spans = rows.withColumn("span_of_rows", F.floor(F.col(order) / width))
    whole = spans.groupBy(*keys, "span_of_rows").agg(F.max(value).alias("whole"))
    over = Window.partitionBy(*keys).orderBy("span_of_rows").rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select(*keys, "span_of_rows", F.max("whole").over(over).alias("carried"))
    within = Window.partitionBy(*keys, "span_of_rows").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn(name, F.max(value).over(within)).join(carried, [*keys, "span_of_rows"]).withColumn(name, F.greatest(name, "carried")).drop("carried", "span_of_rows")


def placed_within(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with their place from 1 among the rows of their keys, of which no two are equal in ``order``.

    A place in the table by keys and order, less the places before the keys' first row: a hot
    key lies in several ranges.  Null is a key like others.
    """
    everywhere = placed(rows, [F.col(c) for c in (*keys, *order)], name)
    first = everywhere.groupBy(*(F.col(k).alias(f"first_{k}") for k in keys)).agg(F.min(name).alias("first_place"))
    same = [F.col(k).eqNullSafe(F.col(f"first_{k}")) for k in keys]
    return everywhere.join(first, same).withColumn(name, F.col(name) - F.col("first_place") + 1).drop("first_place", *(f"first_{k}" for k in keys))


def summed_before(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value``, not negative, of the rows of their keys before them in ``order``.

    As in ``placed_within``: sums within ranges, sums of the ranges before, less the first of a key.
    """
    by = [F.col(c) for c in (*keys, *order)]
    ranged = checkpointed(rows.repartitionByRange(*by).withColumn("range_of_rows", F.spark_partition_id()))
    until = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("range_of_rows").agg(F.sum(value).alias("n"))
    offsets = sums.select("range_of_rows", F.coalesce(F.sum("n").over(until(Window.orderBy("range_of_rows"))), F.lit(0)).alias("sum_before"))
    within = F.coalesce(F.sum(value).over(until(Window.partitionBy("range_of_rows").orderBy(*by))), F.lit(0))
    everywhere = ranged.withColumn(name, within).join(F.broadcast(offsets), "range_of_rows").withColumn(name, F.col(name) + F.col("sum_before")).drop("range_of_rows", "sum_before")
    first = everywhere.groupBy(*(F.col(k).alias(f"first_{k}") for k in keys)).agg(F.min(name).alias("first_sum"))
    return everywhere.join(first, [F.col(k).eqNullSafe(F.col(f"first_{k}")) for k in keys]).withColumn(name, F.col(name) - F.col("first_sum")).drop("first_sum", *(f"first_{k}" for k in keys))
