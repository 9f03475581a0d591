"""Numbered bulk files taken in one by one, each whole or not at all.

A file's events are written to a folder named by its number and the SHA-256 of the bytes that
were parsed; one small file, which only one writer can create, then makes them count.  A file
whose hash isn't the promised one, that changes while it is read, or that doesn't follow the
file before it changes nothing, and the checkpoint stays where it was.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.sources import exclusive, records

#: Bytes of a file at most: a task hashes one, which Spark hands over whole.
LARGEST = 1 << 30


class Refused(ValueError):
    """A file that isn't taken in; nothing has changed."""


class Checkpoint(NamedTuple):
    sequence: int
    sha256: str


def digest(spark: SparkSession, path: str) -> tuple[str, list[tuple[str, int, int]]]:
    """SHA-256 of a file (of a folder: of its files' ones, in order), and (name, bytes, time) of what was read."""
    files = spark.read.format("binaryFile").load(path)
    if files.where(F.col("length") > LARGEST).select("path").limit(1).collect():
        raise Refused(f"{path} has a file of more than {LARGEST} bytes")
    found = sorted(tuple(r) for r in files.select("path", "length", F.unix_millis("modificationTime"), F.sha2("content", 256)).collect())
    if not found:
        raise Refused(f"{path} holds no file")
    whole = found[0][3] if len(found) == 1 else spark.range(1).select(F.sha2(F.lit("".join(f[3] for f in found)), 256)).first()[0]
    return whole, [f[:3] for f in found]


class Ledger:
    """Files of one series below a folder of any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, folder: str, after: int = 0) -> None:
        self.spark, self.folder, self.after = spark, folder.rstrip("/"), after
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def checkpoints(self) -> list[Checkpoint]:
        """Files taken in, in order; a mark that its writer didn't finish counts for nothing."""
        folder = self._path(f"{self.folder}/commits")
        if not self._fs.exists(folder):
            return []
        found = []
        for s in self._fs.listStatus(folder):
            if s.getLen() == 64:
                stream = self._fs.open(s.getPath())
                try:
                    text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                finally:
                    stream.close()
                found.append(Checkpoint(int(s.getPath().getName()), text))
        return sorted(found)

    def last(self) -> int:
        return max((c.sequence for c in self.checkpoints()), default=self.after)

    def take(self, path: str, sequence: int, sha256: str | None = None) -> bool:
        """Takes in the file at ``path`` as number ``sequence``; false if the same one was taken in before."""
        known = {c.sequence: c.sha256 for c in self.checkpoints()}
        found, before = digest(self.spark, path)
        if sha256 is not None and found != sha256.lower():
            raise Refused(f"{path} has the hash {found}")
        if sequence in known:
            if known[sequence] != found:
                raise Refused(f"number {sequence} was another file")
            return False
        if sequence <= self.last():
            raise Refused(f"number {sequence} comes after {self.last()}")
        if sequence != self.last() + 1:
            raise Refused(f"number {sequence} doesn't follow {self.last()}")
        target = f"{self.folder}/events/{sequence:012d}={found}"
        if not self._fs.exists(self._path(f"{target}/_SUCCESS")):
            stage = f"{self.folder}/stage/{uuid.uuid4().hex}"
            records.pubmed_events(self.spark, path).withColumn("sequence", F.lit(sequence)).write.parquet(stage)
            if digest(self.spark, path)[1] != before:
                raise Refused(f"{path} changed while it was read")
            self._fs.mkdirs(self._path(f"{self.folder}/events"))
            # of two writers of one file, either's events will do
            if not self._fs.exists(self._path(target)):
                self._fs.rename(self._path(stage), self._path(target))
                # beneath the other one's, if that came between
                self._fs.delete(self._path(f"{target}/{stage.rsplit('/', 1)[1]}"), True)
        return self._commit(sequence, found)

    def _commit(self, sequence: int, sha256: str) -> bool:
        if exclusive.create(self.spark, f"{self.folder}/commits/{sequence:012d}", sha256.encode()):
            return True
        if {c.sequence: c.sha256 for c in self.checkpoints()}.get(sequence) == sha256:
            return False
        raise Refused(f"another writer has number {sequence}")

    def recover(self) -> None:
        """Removes marks that their writers didn't finish; for when no writer is at work."""
        folder = self._path(f"{self.folder}/commits")
        for s in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            if s.getLen() != 64:
                self._fs.delete(s.getPath(), False)

    def events(self) -> DataFrame | None:
        """Events of all files taken in, with the names and hashes they came by."""
        paths = [f"{self.folder}/events/{c.sequence:012d}={c.sha256}" for c in self.checkpoints()]
        return self.spark.read.parquet(*paths).withColumn("sha256", F.regexp_extract(F.col("_metadata.file_path"), "=([0-9a-f]{64})/", 1)) if paths else None
