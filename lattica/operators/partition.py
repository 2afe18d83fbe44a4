"""Partition assignment, its statistics, and retry helpers for driver-side jobs."""

from __future__ import annotations

import random
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph


def hash_partition(parts: int, seed: int = 0, column: str = "id") -> Column:
    return F.pmod(F.xxhash64(F.col(column), F.lit(seed)), F.lit(parts)).cast("int")


def range_partition(per_part: int | None, parts: int, column: str = "id") -> Column:
    """id div per_part, the last part taking the rest; without a size, id modulo parts."""
    if per_part is None:
        return F.pmod(F.col(column), F.lit(parts)).cast("int")
    return F.least(F.floor(F.col(column) / per_part), F.lit(parts - 1)).cast("int")


def max_node_index(graph: Graph) -> int | None:
    return graph.vertices.agg(F.max("id")).first()[0]


def partition_graph(graph: Graph, pid: Column) -> tuple[DataFrame, DataFrame]:
    """(id, pid, is_boundary) and edges with pid_src, pid_dst; a boundary vertex has an out-neighbour elsewhere."""
    v = graph.vertices.select("id", pid.alias("pid"))
    a, b = v.select(F.col("id").alias("src"), F.col("pid").alias("pid_src")), v.select(F.col("id").alias("dst"), F.col("pid").alias("pid_dst"))
    e = graph.arcs().join(a, "src").join(b, "dst")
    cross = e.where("pid_src <> pid_dst").select(F.col("src").alias("id"), F.lit(True).alias("x")).distinct()
    return v.join(cross, "id", "left").select("id", "pid", F.coalesce("x", F.lit(False)).alias("is_boundary")), e


def partition_stats(graph: Graph, pid: Column) -> DataFrame:
    """(pid, nodes, edges, boundary)."""
    v, e = partition_graph(graph, pid)
    edges = e.groupBy(F.col("pid_src").alias("pid")).agg(F.count("*").alias("edges"))
    return v.groupBy("pid").agg(F.count("*").alias("nodes"), F.sum(F.col("is_boundary").cast("long")).alias("boundary")).join(edges, "pid", "left").na.fill(0, ["edges"])


def balance(stats: DataFrame) -> DataFrame:
    """One row: least, greatest and mean part, boundary share, greatest / least."""
    return stats.agg(
        F.min("nodes").alias("min_nodes"), F.max("nodes").alias("max_nodes"), F.avg("nodes").alias("avg_nodes"), (F.sum("boundary") / F.sum("nodes")).alias("boundary_share"), (F.max("nodes") / F.min("nodes")).alias("balance")
    )


def is_balanced(stats: DataFrame, threshold: float) -> bool:
    return balance(stats).first()["balance"] <= threshold


def inner_edges(graph: Graph, pid: Column) -> DataFrame:
    return partition_graph(graph, pid)[1].where("pid_src = pid_dst")


def execute_with_retry(job: Callable, attempts: int = 3, first_delay: float = 0.1, max_delay: float = 10.0, factor: float = 2.0, jitter: float = 0.1, log: list | None = None):
    """Run a driver-side job again after failures; tasks are retried by Spark itself."""
    delay = first_delay
    for k in range(1, attempts + 1):
        try:
            return job()
        except Exception as e:
            if log is not None:
                log.append({"level": "error" if k == attempts else "warn", "attempt": k, "message": str(e)})
            if k == attempts:
                raise
            time.sleep(min(max_delay, delay) * (1 + jitter * random.random()))
            delay *= factor


class HealthChecker:
    """Heartbeats of nodes by name: one that has been silent for longer than `timeout` seconds, or was never heard, has failed."""

    def __init__(self, nodes, timeout: float = 30.0, clock: Callable[[], float] = time.monotonic):
        self.timeout, self.clock = timeout, clock
        self.heard: dict = dict.fromkeys(nodes)

    def heartbeat(self, node) -> None:
        self.heard[node] = self.clock()

    def is_failed(self, node) -> bool:
        at = self.heard.get(node)
        return at is None or self.clock() - at > self.timeout

    def failed(self) -> list:
        return [n for n in self.heard if self.is_failed(n)]

    def healthy(self) -> list:
        return [n for n in self.heard if not self.is_failed(n)]


class CircuitBreaker:
    """Closed, then open after `threshold` failures, half open after `reset` seconds."""

    def __init__(self, threshold: int = 5, reset: float = 30.0, clock: Callable[[], float] = time.monotonic):
        self.threshold, self.reset, self.clock, self.failures, self.opened = threshold, reset, clock, 0, None

    @property
    def state(self) -> str:
        if self.opened is None:
            return "closed"
        return "half_open" if self.clock() - self.opened >= self.reset else "open"

    def is_allowed(self) -> bool:
        return self.state != "open"

    def record(self, ok: bool) -> None:
        self.failures = 0 if ok else self.failures + 1
        self.opened = None if ok else self.clock() if self.failures >= self.threshold or self.state == "half_open" else self.opened
