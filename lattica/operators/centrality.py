"""Degree centrality, PageRank, closeness and betweenness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..iterate import Control, cut, cut_with
from .traversal import all_pairs_hops


def degree_centrality(graph: Graph) -> DataFrame:
    """(id, centrality): out-degree over n - 1; no rows for one vertex or none."""
    n = graph.node_count()
    return graph.degrees().where(F.lit(n > 1)).select("id", (F.col("out_degree") / max(1, n - 1)).alias("centrality"))


def pagerank(graph: Graph, damping: float = 0.85, iterations: int = 20, tolerance: float | None = None, dangling: str = "drop", distinct_edges: bool = False, control: Control | None = None) -> DataFrame:
    """(id, rank) after `iterations` rounds, or fewer once no rank moves by the tolerance.

    Shares are precomputed on the edges, which keep one partitioning by dst, so that a round is one join with the
    ranks and one aggregation.  dangling="redistribute" spreads the rank of vertices without out-edges over all.
    """
    vertices, size = cut_with(graph.vertices.select("id"), F.count(F.lit(1)).alias("rows"))
    n = size["rows"]
    if n == 0:
        return graph.vertices.select("id", F.lit(0.0).alias("rank"))
    arcs = graph.arcs().select("src", "dst")
    arcs = arcs.distinct() if distinct_edges else arcs
    out = arcs.groupBy("src").agg(F.count("*").alias("out"))
    links = cut(arcs.groupBy("src", "dst").agg(F.count("*").alias("k")).join(out, "src").select("src", "dst", (F.col("k") / F.col("out")).alias("share")))
    sinks = cut(vertices.join(out, F.col("id") == out["src"], "left_anti")) if dangling == "redistribute" else None
    ranks = vertices.select("id", F.lit(1.0 / n).alias("rank"))
    base = (1 - damping) / n
    for k in range(iterations):
        if control:
            control.check(k)
        extra = 0.0
        if sinks is not None:
            extra = damping * (ranks.join(sinks, "id", "left_semi").agg(F.sum("rank")).first()[0] or 0.0) / n
        into = links.join(ranks, links["src"] == ranks["id"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("s"))
        new = ranks.join(into, ranks["id"] == into["dst"], "left").select("id", (F.lit(base + extra) + damping * F.coalesce("s", F.lit(0.0))).alias("rank"), F.col("rank").alias("old"))
        moved = {"most": None}
        if tolerance is not None:
            new, moved = cut_with(new, F.max(F.abs(F.col("rank") - F.col("old"))).alias("most"))
        elif k % 5 == 4:
            new = cut(new)
        ranks = new.select("id", "rank")
        if tolerance is not None and moved["most"] < tolerance:
            break
    return ranks


def top_k(scores: DataFrame, column: str, k: int) -> DataFrame:
    return scores.orderBy(F.desc(column), "id").limit(k)


def closeness_centrality(graph: Graph, variant: str = "reach", sources: DataFrame | None = None) -> DataFrame:
    """(id, closeness): reached / sum of distances ("reach"), (n-1) / sum ("standard"), or reached^2 / ((n-1) sum) ("improved")."""
    n = graph.node_count()
    hops = all_pairs_hops(graph, sources).where("depth > 0").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("r"), F.sum("depth").alias("d"))
    value = {"reach": F.col("r") / F.col("d"), "standard": F.lit(float(n - 1)) / F.col("d"), "improved": (F.col("r") / max(1, n - 1)) * (F.col("r") / F.col("d"))}[variant]
    return (graph.vertices if sources is None else sources).select("id").join(hops, "id", "left").select("id", F.coalesce(value, F.lit(0.0)).alias("closeness"))


def betweenness_centrality(graph: Graph, normalized: bool = True, sources: DataFrame | None = None) -> DataFrame:
    """(id, betweenness) by Brandes' recurrences on tables of (source, vertex, depth, paths), all sources at once.

    For an undirected graph each pair counts once.  With sources given, only paths from them count.
    """
    n = graph.node_count()
    arcs = cut(graph.arcs().select("src", "dst").where("src <> dst").distinct())
    hops = all_pairs_hops(graph, sources)
    deepest = hops.agg(F.max("depth")).first()[0] or 0
    a, b = hops.select("source", F.col("id").alias("src"), F.col("depth").alias("da")), hops.select("source", F.col("id").alias("dst"), F.col("depth").alias("db"))
    dag = cut(arcs.join(a, "src").join(b, ["source", "dst"]).where("db = da + 1").select("source", "src", "dst", "db"))
    sigma = cut(hops.where("depth = 0").select("source", "id", F.lit(1.0).alias("sigma")))
    front = sigma
    for k in range(1, deepest + 1):
        step = dag.where(F.col("db") == k).join(front.withColumnRenamed("id", "src"), ["source", "src"]).groupBy("source", F.col("dst").alias("id")).agg(F.sum("sigma").alias("sigma"))
        front = cut(step)
        sigma = cut(sigma.unionByName(front))
    delta = cut(sigma.select("source", "id", F.lit(0.0).alias("delta")).limit(0))
    for k in range(deepest, 0, -1):
        down = sigma.select("source", F.col("id").alias("dst"), F.col("sigma").alias("sw"))
        up = sigma.select("source", F.col("id").alias("src"), F.col("sigma").alias("sv"))
        d = delta.select("source", F.col("id").alias("dst"), "delta")
        step = dag.where(F.col("db") == k).join(down, ["source", "dst"]).join(up, ["source", "src"]).join(d, ["source", "dst"], "left")
        got = step.groupBy("source", F.col("src").alias("id")).agg(F.sum(F.col("sv") / F.col("sw") * (1 + F.coalesce("delta", F.lit(0.0)))).alias("delta"))
        delta = cut(delta.unionByName(got))
    total = delta.where("id <> source").groupBy("id").agg(F.sum("delta").alias("b"))
    scale = 1.0 if graph.directed else 0.5
    if normalized and n > 2:
        scale = 1.0 / ((n - 1) * (n - 2))
    return graph.vertices.select("id").join(total, "id", "left").select("id", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))
