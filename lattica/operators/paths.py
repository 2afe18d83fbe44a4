"""Shortest paths by relaxation of the distances that changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import NegativeCycle, NegativeWeight, NodeNotFound
from ..graph import Graph
from ..iterate import Control, cut, cut_with


def _arcs(graph: Graph) -> DataFrame:
    """Least weight of parallel edges."""
    return cut(graph.arcs().groupBy("src", "dst").agg(F.min("weight").alias("w")).repartition("src"))


def _relax(graph: Graph, source: int, limit: int, prune: Column | None = None, goal: int | None = None, max_distance: float | None = None, control: Control | None = None) -> tuple[DataFrame, bool]:
    arcs = _arcs(graph)
    dist, found = cut_with(graph.vertices.where(F.col("id") == source).select("id", F.lit(0.0).alias("distance"), F.lit(None).cast("long").alias("parent")), F.count(F.lit(1)).alias("rows"))
    if not found["rows"]:
        raise NodeNotFound(source)
    front = dist
    for k in range(limit):
        if control:
            control.check(k)
        step = front.join(arcs, front["id"] == arcs["src"]).select(F.col("dst").alias("id"), (F.col("distance") + F.col("w")).alias("d"), F.col("src").alias("p"))
        if max_distance is not None:
            step = step.where(F.col("d") <= max_distance)
        if goal is not None:
            best = dist.where(F.col("id") == goal).agg(F.min("distance")).first()[0]
            if best is not None:
                step = step.where((F.col("d") + (prune if prune is not None else F.lit(0.0))) <= best)
        step = step.groupBy("id").agg(F.min(F.struct("d", "p")).alias("b"))
        joined = dist.join(step, "id", "full").select("id", "distance", "parent", "b", (F.col("b").isNotNull() & (F.col("distance").isNull() | (F.col("b.d") < F.col("distance")))).alias("up"))
        joined, moved = cut_with(joined, F.count_if("up").alias("rows"))
        new = joined.select("id", F.when(F.col("up"), F.col("b.d")).otherwise(F.col("distance")).alias("distance"), F.when(F.col("up"), F.col("b.p")).otherwise(F.col("parent")).alias("parent"), "up")
        front = new.where("up").drop("up")
        dist = new.drop("up")
        if not moved["rows"]:
            return dist, True
    return dist, False


def has_negative_weights(graph: Graph) -> bool:
    return not graph.edges.where("weight < 0").isEmpty()


def dijkstra(graph: Graph, source: int, max_distance: float | None = None, control: Control | None = None) -> DataFrame:
    """(id, distance, parent) of the vertices reached; raises NegativeWeight before it starts."""
    if has_negative_weights(graph):
        raise NegativeWeight("use bellman_ford")
    return _relax(graph, source, graph.node_count() + 1, max_distance=max_distance, control=control)[0]


def delta_stepping(graph: Graph, source: int, delta: float) -> DataFrame:
    """As dijkstra(), settling distances bucket by bucket of width delta."""
    if has_negative_weights(graph):
        raise NegativeWeight("use bellman_ford")
    arcs = _arcs(graph)
    least = F.min(F.when(F.col("open"), F.floor(F.col("distance") / delta))).alias("low")
    dist, seen = cut_with(graph.vertices.where(F.col("id") == source).select("id", F.lit(0.0).alias("distance"), F.lit(True).alias("open")), least)
    while True:
        low = seen["low"]
        if low is None:
            return dist.drop("open")
        now = F.col("open") & (F.floor(F.col("distance") / delta) == low)
        step = dist.where(now).join(arcs, F.col("id") == F.col("src")).groupBy("dst").agg(F.min(F.col("distance") + F.col("w")).alias("d"))
        joined = dist.withColumn("open", F.col("open") & ~now).join(step, dist["id"] == step["dst"], "full")
        up = F.col("d").isNotNull() & (F.col("distance").isNull() | (F.col("d") < F.col("distance")))
        dist, seen = cut_with(joined.select(F.coalesce("id", "dst").alias("id"), F.when(up, F.col("d")).otherwise(F.col("distance")).alias("distance"), (up | F.coalesce("open", F.lit(False))).alias("open")), least)


def bellman_ford(graph: Graph, source: int) -> DataFrame:
    """(id, distance, parent) of all vertices, null where unreachable; raises NegativeCycle if the source reaches one."""
    n = graph.node_count()
    if n == 0:
        return graph.vertices.select("id", F.lit(None).cast("double").alias("distance"), F.lit(None).cast("long").alias("parent"))
    dist, settled = _relax(graph, source, n)
    if not settled:
        raise NegativeCycle(source)
    return graph.vertices.select("id").join(dist, "id", "left")


def astar(graph: Graph, start: int, goal: int, heuristic: Column) -> tuple[list[int], float]:
    """Path and its length; heuristic is a column over id that never overestimates what is left to the goal."""
    dist, _ = _relax(graph, start, graph.node_count() + 1, prune=heuristic, goal=goal)
    row = dist.where(F.col("id") == goal).first()
    if row is None:
        raise NodeNotFound(goal)
    return reconstruct_path(dist, start, goal), row["distance"]


def path_rows(found: DataFrame, target: int) -> DataFrame:
    """(id, back): the target's ancestors by parent, back steps behind it; by pointer doubling, so the rounds grow with the logarithm of the path."""
    jump = cut(found.where("parent IS NOT NULL").select("id", F.col("parent").alias("to")))
    path = cut(found.where(F.col("id") == target).select("id", F.lit(0).alias("back")))
    step = 1
    while True:
        new, more = cut_with(path.join(jump, "id").select(F.col("to").alias("id"), (F.col("back") + step).alias("back")), F.count(F.lit(1)).alias("rows"))
        path = path.unionByName(new)
        if more["rows"] < step:
            return path
        further = jump.select(F.col("id").alias("to"), F.col("to").alias("far"))
        jump = cut(jump.join(further, "to").select("id", F.col("far").alias("to")))
        step *= 2


def reconstruct_path(found: DataFrame, source: int, target: int) -> list[int]:
    """found(id, parent) -> the path from the source; empty if the target was not reached."""
    path = [r.id for r in path_rows(found, target).orderBy(F.desc("back")).collect()]
    return path if path and path[0] == source else []


def floyd_warshall(graph: Graph) -> DataFrame:
    """(src, dst, distance) of all pairs that are joined, by min-plus squaring; raises NegativeCycle."""
    loops = graph.vertices.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("distance"))
    d = cut(graph.arcs().select("src", "dst", F.col("weight").alias("distance")).unionByName(loops).groupBy("src", "dst").agg(F.min("distance").alias("distance")))
    n, span, before = graph.node_count(), 1, None
    while True:
        seen = d.agg(F.count("*"), F.sum("distance")).first()
        if not d.where("src = dst and distance < 0").isEmpty():
            raise NegativeCycle("a diagonal entry is negative")
        if seen == before or span >= 2 * max(1, n):
            return d
        before, span = seen, span * 2
        a, b = d.select("src", F.col("dst").alias("k"), F.col("distance").alias("x")), d.select(F.col("src").alias("k"), "dst", F.col("distance").alias("y"))
        d = cut(a.join(b, "k").groupBy("src", "dst").agg(F.min(F.col("x") + F.col("y")).alias("distance")))


def farthest(found: DataFrame):
    return found.agg(F.max_by("id", F.struct("distance", -F.col("id"))).alias("id"), F.max("distance").alias("distance")).first()


def validate_path(graph: Graph, path: list[int], expected: float, tolerance: float = 1e-9) -> bool:
    spark = graph.edges.sparkSession
    if not path:
        return False
    steps = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(path, path[1:]))], "i int, src long, dst long")
    got = steps.join(_arcs(graph), ["src", "dst"]).agg(F.count("*"), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    return got[0] == len(path) - 1 and abs(got[1] - expected) <= tolerance
