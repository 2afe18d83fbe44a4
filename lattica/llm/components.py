"""Distributed union-find over an edge table, by alternating stars.

Large-star hangs every larger neighbour of a node on the node's least
neighbour; small-star does the same among the smaller ones.  Each round is
two group-by-minimum steps and joins, so a hub of any degree is combined on
the map side and split by the adaptive skew join.  An edge's two ends are made by a generator, not by a union, so that
each table is read and each join made once.  It ends when a round
leaves the edges as they were, however many that takes; every node then points at its component's
least node.  What the edges are is seen as they are written, in no job of its own.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .workspace import Workspace


def _star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u").withColumn("m", F.least("u", "m"))
    return joined


def _ends(edges: DataFrame, x: tuple[str, str], y: tuple[str, str]) -> DataFrame:
    """Two rows (u, v) for each edge: its columns x, and its columns y."""
    rows = [F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in (x, y)]
    return edges.select(F.inline(F.array(*rows)))


def _stored(edges: DataFrame, work: Workspace, name: str) -> tuple[DataFrame, dict]:
    """The edges as they are written, and what tells them from others."""
    seen = Observation()
    marks = [F.count(F.lit(1)).alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("sum"), F.bit_xor(F.xxhash64("u", "v")).alias("xor")]
    out = work.store(edges.observe(seen, *marks), name)
    return out, seen.get


def connected_components(edges: DataFrame, work: Workspace) -> DataFrame:
    """edges(u, v) of any one orderable type -> (node, root), for nodes that have an edge.

    Loops, repeated edges and nulls are ignored; an empty table gives no rows.
    """
    e = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, before = _stored(e, work, "cc0")
    for k in count(1):
        both = _ends(e, ("u", "v"), ("v", "u"))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        joined = _star(large)  # all edges point from larger to smaller here
        small = _ends(joined, ("v", "m"), ("u", "m")).where("u <> v").distinct()
        e, seen = _stored(small, work, f"cc{k}")
        work.drop(f"cc{k - 1}")
        if seen == before:
            break
        before = seen
    return _ends(e, ("u", "v"), ("v", "v")).groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
