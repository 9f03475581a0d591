"""A keyed table kept as a log: a batch writes its own rows, and readers merge.

Segments are folders ``seg=<first>-<last>`` of rows that the batches with these numbers wrote.
A key's row is the one with the greatest ordering tuple over all segments, so a batch never
reads nor rewrites what other batches wrote.  ``compact`` merges runs of ``FAN`` segments of like
width into one, level by level: a row is rewritten once a level, that is a logarithm of the
number of batches times.  What is live follows from the names alone: a wide segment replaces
those within it, and a batch whose number it covers has been taken in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import state

#: Segments of like width that one compaction merges.
FAN = 8
#: Rows of a file of a segment, about.
FILE_ROWS = 1_000_000


class KeyedLog:
    """Rows by ``keys``, of which the greatest by ``order`` counts, below a folder that Spark can reach."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], order: tuple[str, ...] = state.ORDER, fan: int = FAN) -> None:
        self.spark, self.folder, self.keys, self.order, self.fan = spark, folder.rstrip("/"), keys, order, fan
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _named(self) -> list[tuple[int, int]]:
        """Segments (first, last) that were written whole."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        found = [tuple(int(x) for x in n[4:].split("-")) for n in names if n.startswith("seg=")]
        return sorted((a, b) for a, b in found if self._fs.exists(self._path(f"{self._of(a, b)}/_SUCCESS")))

    def _of(self, first: int, last: int) -> str:
        return f"{self.folder}/seg={first}-{last}"

    def segments(self, upto: int | None = None) -> list[tuple[int, int]]:
        """Live segments in order, of batches up to a number: those within no other one."""
        named = [s for s in self._named() if upto is None or s[1] <= upto]
        return [s for s in named if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in named)]

    def covers(self, number: int) -> bool:
        """Whether a batch of this number has been taken in."""
        return any(a <= number <= b for a, b in self._named())

    def rows(self, upto: int | None = None) -> DataFrame | None:
        """Rows of all live segments, several of a key among them; null before the first batch."""
        paths = [self._of(a, b) for a, b in self.segments(upto)]
        return self.spark.read.option("mergeSchema", str(len(paths) > 1).lower()).parquet(*paths) if paths else None

    def read(self, upto: int | None = None) -> DataFrame | None:
        """The row of each key."""
        rows = self.rows(upto)
        return None if rows is None else state.latest_by(rows, self.keys, self.order)

    def append(self, rows: DataFrame, number: int, again: bool = False, unique: bool = False) -> bool:
        """Writes a batch's rows, one of each key; a number that was taken in is passed over, unless ``again``.

        ``unique`` rows have one of each key already, and are written without a shuffle.
        """
        if not again and self.covers(number):
            return False
        (rows if unique else state.latest_by(rows, self.keys, self.order)).write.mode("overwrite").parquet(self._of(number, number))
        return True

    def compact(self, upto: int | None = None) -> list[tuple[int, int]]:
        """Merges what is due, and drops what an earlier compaction replaced; returns the new segments.

        The segments that a compaction replaces stay until the next one, for readers that
        have listed them.
        """
        for s in set(self._named()) - set(self.segments()):
            self._fs.delete(self._path(self._of(*s)), True)
        made = []
        while due := self._due(upto):
            parts = [self.spark.read.parquet(self._of(*s)) for s in due]
            rows = parts[0]
            for p in parts[1:]:
                rows = rows.unionByName(p, allowMissingColumns=True)
            files = max(1, -(-rows.count() // FILE_ROWS))
            target = (due[0][0], due[-1][1])
            state.latest_by(rows, self.keys, self.order).repartition(files, *self.keys).write.mode("overwrite").parquet(self._of(*target))
            made.append(target)
        return made

    def _due(self, upto: int | None) -> list[tuple[int, int]]:
        """The oldest ``fan`` neighbours of one level."""
        live = self.segments(upto)
        level = lambda s: next(k for k in range(64) if s[1] - s[0] + 1 <= self.fan**k)
        for i in range(len(live) - self.fan + 1):
            run = live[i : i + self.fan]
            if len({level(s) for s in run}) == 1:
                return run
        return []


def existing(rows: DataFrame | None, like: DataFrame) -> DataFrame:
    """``rows``, or none of the schema of ``like``."""
    return like.where(F.lit(False)) if rows is None else rows.select(*like.columns)
