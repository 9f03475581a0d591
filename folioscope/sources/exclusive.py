"""Creation of a small file by one writer only."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def create(spark: SparkSession, path: str, content: bytes) -> bool:
    """Creates a file with its content; false if it is there, whoever made it.

    File systems of a cluster create exclusively themselves; that of the machine (or a folder
    that is mounted there) does by its own call, which Hadoop's client doesn't use.
    """
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() == "file":
        local = where.toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            with open(local, "xb") as f:
                f.write(content)
        except FileExistsError:
            return False
        return True
    if fs.exists(where):
        return False
    try:
        stream = fs.create(where, False)
    except Exception:
        if fs.exists(where):
            return False
        raise
    stream.write(content)
    stream.close()
    return True
