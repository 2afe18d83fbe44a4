"""Tables that operators write between their passes.

Lineage is cut by writing Parquet below the folder that the cluster names in
``spark.checkpoint.dir``; all executors share it, so a lost executor costs a
recomputed task and never a lost table.  Only in a local session without the setting is a folder of our own made and
recorded in the session; a cluster must name one.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lattica-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


class Workspace:
    """One operator call's tables; they go when the driver's JVM ends, or earlier by drop()."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/lattica-{uuid.uuid4().hex}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(path)

    def store(self, df: DataFrame, name: str) -> DataFrame:
        where = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(where)
        for _ in range(2):  # lets the cleaner drop shuffle files of finished stages
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.1)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}"), True)
