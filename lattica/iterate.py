"""Driver loops over DataFrames: each round is one Catalyst plan, with its lineage cut by a checkpoint.

Checkpoints go to the folder that the cluster names in ``spark.checkpoint.dir``, which all
executors share; only a local session may go without, and gets a folder of its own.
"""

from __future__ import annotations

import tempfile
import time
from functools import reduce
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def checkpoint_folder(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="lattica-"))


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_with(df: DataFrame, *measures: Column) -> tuple[DataFrame, dict]:
    """As cut(), with aggregates (aliased) taken in the same pass, so that a loop needs no further job to know whether it is done."""
    checkpoint_folder(df.sparkSession)
    seen = Observation()
    out = df.observe(seen, *measures).checkpoint(eager=True)
    return out, seen.get


class Levels:
    """A table that grows by levels: each is kept as it was written, and they are written together now and then, so that the plan stays short."""

    def __init__(self, first: DataFrame, width: int = 16):
        self.parts, self.width = [first], width

    def add(self, part: DataFrame) -> None:
        self.parts.append(part)
        if len(self.parts) > self.width:
            self.parts = [cut(self.all())]

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)


class Cancelled(RuntimeError):
    """A loop was told to stop, or ran out of time."""


class Control:
    """Progress, cancellation and a time limit for loops; looked at between rounds."""

    def __init__(self, timeout: float | None = None, progress: Callable[[int], None] | None = None):
        self.began, self.timeout, self.progress, self.cancelled = time.monotonic(), timeout, progress, False

    def can_continue(self) -> bool:
        return not self.cancelled and (self.timeout is None or time.monotonic() - self.began < self.timeout)

    def check(self, round_: int) -> None:
        if not self.can_continue():
            raise Cancelled(f"stopped before round {round_}")
        if self.progress:
            self.progress(round_)
