"""Graph generators, all as arithmetic on spark.range; seeded where they are random."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..iterate import cut


def _graph(spark: SparkSession, n: int, edges: DataFrame, directed: bool = False) -> Graph:
    return Graph.from_edges(edges.select(F.col("src").cast("long"), F.col("dst").cast("long")), spark.range(n), directed)


def _unit(*cols: Column | str) -> Column:
    """A repeatable number in [0, 1) for each combination of values."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def complete_graph(spark: SparkSession, n: int) -> Graph:
    return _graph(spark, n, spark.range(n).select(F.col("id").alias("src"), F.explode(F.expr(f"IF(id + 1 <= {n - 1}, sequence(id + 1, {n - 1}L), array())")).alias("dst")))


def erdos_renyi(spark: SparkSession, n: int, p: float, directed: bool = False, seed: int = 42) -> Graph:
    """Each vertex steps through its possible targets by geometric gaps, so only about as many rows are made as there are edges.

    A vertex draws eight standard deviations more gaps than it is expected to need.
    """
    if p >= 1:
        all_ = spark.range(n).select(F.col("id").alias("src"), F.explode(F.expr(f"sequence(0L, {n - 1}L)")).alias("dst"))
        return _graph(spark, n, all_.where("src <> dst" if directed else "src < dst"), directed)
    room = F.lit(n - 1) if directed else F.lit(n - 1) - F.col("id")
    draws = F.ceil(room * p + 8 * F.sqrt(room * p) + 8).cast("long")
    rows = spark.range(n if p > 0 else 0).select(F.col("id").alias("src"), room.alias("room"), F.explode(F.sequence(F.lit(1).cast("long"), draws)).alias("k"))
    gap = F.floor(F.log(1 - _unit(F.lit(seed), "src", "k")) / math.log1p(-p)).cast("long") + 1 if p > 0 else F.lit(1)
    at = F.sum(gap).over(Window.partitionBy("src").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    chosen = rows.withColumn("at", at).where("at <= room")
    # the at-th of the other vertices, or of the later ones
    dst = F.when(F.col("at") <= F.col("src"), F.col("at") - 1).otherwise(F.col("at")) if directed else F.col("src") + F.col("at")
    return _graph(spark, n, chosen.select("src", dst.alias("dst")), directed)


def barabasi_albert(spark: SparkSession, n: int, m: int, preferential: bool = False, seed: int = 42) -> Graph:
    """Each vertex from m on joins m earlier ones: the first m, or by preference through copying.

    With preference, target j of vertex v is a uniformly drawn earlier end point, followed back from copy to copy
    until it is a vertex; each step goes to an earlier one.
    """
    rows = spark.range(m, n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("j"))
    seedling = complete_graph(spark, m).edges.select("src", "dst")
    if not preferential:
        return _graph(spark, n, seedling.union(rows.select("src", F.col("j").cast("long"))))
    slot = F.col("slot")
    cur = rows.withColumn("slot", F.floor(_unit(F.lit(seed), "src", "j") * (2 * m * (F.col("src") - m) + m)).cast("long"))
    while True:
        past = F.floor((slot - m) / 2)
        chosen = F.floor(_unit(F.lit(seed), F.floor(past / m) + m, F.pmod(past, F.lit(m)).cast("int")) * F.greatest(F.lit(1), slot - m)).cast("long")
        cur = cut(cur.withColumn("slot", F.when((slot >= m) & ((slot - m) % 2 == 1), F.least(chosen, slot - 1)).otherwise(slot)))
        if cur.where((slot >= m) & ((slot - m) % 2 == 1)).isEmpty():
            break
    dst = F.when(slot < m, slot).otherwise((m + F.floor((slot - m) / (2 * m))).cast("long"))
    return _graph(spark, n, seedling.union(cur.select("src", F.least(dst, F.col("src") - 1).alias("dst"))).distinct())


def watts_strogatz(spark: SparkSession, n: int, k: int, beta: float, seed: int = 42) -> Graph:
    """Ring of k/2 neighbours a side, with a shortcut added at rate beta for each ring edge (none is removed)."""
    ring = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(max(1, k // 2)))).alias("j")).where(F.lit(k >= 2))
    short = ring.where(_unit(F.lit(seed), "src", "j") < beta).select("src", F.floor(_unit(F.lit(seed + 1), "src", "j") * n).cast("long").alias("dst")).where("src <> dst")
    return _graph(spark, n, ring.select("src", F.pmod(F.col("src") + F.col("j"), F.lit(n)).alias("dst")).union(short))


def grid(spark: SparkSession, rows: int, cols: int, diagonal: bool = False) -> Graph:
    r, c = F.expr(f"id div {cols}"), F.col("id") % cols
    steps = [(c < cols - 1, 1), (r < rows - 1, cols)] + ([((r < rows - 1) & (c < cols - 1), cols + 1), ((r < rows - 1) & (c > 0), cols - 1)] if diagonal else [])
    targets = F.array_compact(F.array(*[F.when(ok, F.col("id") + d) for ok, d in steps]))
    return _graph(spark, rows * cols, spark.range(rows * cols).select(F.col("id").alias("src"), F.explode(targets).alias("dst")))


def path(spark: SparkSession, n: int) -> Graph:
    return _graph(spark, n, spark.range(max(0, n - 1)).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))


def binary_tree(spark: SparkSession, height: int) -> Graph:
    n = (1 << height) - 1
    return _graph(spark, n, spark.range(1, max(1, n)).select(F.expr("(id - 1) div 2").alias("src"), F.col("id").alias("dst")))
