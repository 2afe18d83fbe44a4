"""Yes-or-no and scalar properties of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import GraphHasCycle
from ..graph import Graph
from .community import connected_components
from .traversal import all_pairs_hops, bfs, topological_levels


def is_connected(graph: Graph) -> bool:
    """All vertices are reached from the first; an empty graph is connected."""
    first = graph.vertices.agg(F.min("id")).first()[0]
    return first is None or bfs(graph, [first]).count() == graph.node_count()


def is_bipartite(graph: Graph) -> bool:
    """No odd closed walk in the undirected view: distances' parities from each component's least vertex must differ along every edge."""
    g = graph.undirected()
    if not graph.edges.where("src = dst").isEmpty():
        return False
    depth = bfs(g, connected_components(g).select(F.col("component").alias("id")))
    a, b = depth.select(F.col("id").alias("src"), F.col("depth").alias("x")), depth.select(F.col("id").alias("dst"), F.col("depth").alias("y"))
    return graph.edges.join(a, "src").join(b, "dst").where("x % 2 = y % 2").isEmpty()


def is_dag(graph: Graph) -> bool:
    try:
        topological_levels(graph)
        return True
    except GraphHasCycle:
        return False


def has_cycle(graph: Graph) -> bool:
    return not is_dag(graph)


def is_tree(graph: Graph) -> bool:
    return graph.edge_count() == graph.node_count() - 1 and is_connected(graph)


def diameter(graph: Graph, sources: DataFrame | None = None) -> int:
    """Greatest finite distance in edges, 0 for no vertex; from sources(id) only, where given, which is then a lower bound."""
    return all_pairs_hops(graph, sources).agg(F.max("depth")).first()[0] or 0


def density(graph: Graph) -> float:
    n = graph.node_count()
    return graph.edge_count() / (n * (n - 1)) if n > 1 else 0.0


def girth(graph: Graph, sources: DataFrame | None = None) -> int:
    """Length of the shortest directed cycle (of the undirected view for an undirected graph), 0 if there is none; loops count 1.

    With sources(id) given, of the shortest cycle that passes one of them.
    """
    if not graph.edges.where("src = dst").isEmpty():
        return 1
    hops = all_pairs_hops(graph, sources)
    if graph.directed:
        arcs = graph.edges.select(F.col("src").alias("id"), F.col("dst").alias("source")).distinct()
        return arcs.join(hops, ["source", "id"]).agg(F.min(F.col("depth") + 1)).first()[0] or 0
    pairs = graph.edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    if not pairs.groupBy("a", "b").count().where("count > 1").isEmpty():
        return 2
    a = hops.select("source", F.col("id").alias("a"), F.col("depth").alias("x"))
    b = hops.select("source", F.col("id").alias("b"), F.col("depth").alias("y"))
    e = pairs.join(a, "a").join(b, ["source", "b"])
    odd = e.where("x = y").agg(F.min(2 * F.col("x") + 1)).first()[0]
    # an even cycle closes where two edges of the same level meet a vertex
    even = e.where("x <> y").select("source", F.when(F.col("x") > F.col("y"), F.col("a")).otherwise(F.col("b")).alias("far"), F.greatest("x", "y").alias("d"))
    even = even.groupBy("source", "far", "d").count().where("count > 1").agg(F.min(2 * F.col("d"))).first()[0]
    found = [v for v in (odd, even) if v]
    return min(found) if found else 0
