"""Files of the driver by Hadoop's file systems, so that any path that Spark can open will do."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def write_bytes(spark: SparkSession, path: str, parts: Iterable[bytes]) -> None:
    """Write the parts one after another, in place of what is there."""
    files, where = _path(spark, path)
    out = files.create(where, True)
    try:
        for part in parts:
            out.write(bytearray(part))
    finally:
        out.close()


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A whole small file."""
    files, where = _path(spark, path)
    stream = files.open(where)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()
