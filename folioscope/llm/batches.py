"""Arrow batches of bounded size for operators that read whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows and bytes that one Arrow batch between Spark and a Python worker holds at most.
ROWS, BYTES = 1000, 16 * 2**20


def small_batches(df: DataFrame) -> DataFrame:
    """The same rows, with the Arrow batch limits of their session set to those above.

    The limits stay set for the session: other operators that use Arrow then get batches of
    the same bounded size, with the same results.
    """
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES))
    return df


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each run of equal values in the first column, which may span batches."""
    held: list[pa.RecordBatch] = []
    value = None
    for batch in batches:
        if not len(batch):
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, b in zip(cuts, cuts[1:]):
            if held and key[a] != value:
                yield pa.Table.from_batches(held)
                held = []
            value = key[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of numbers of equal length as the rows of an array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
