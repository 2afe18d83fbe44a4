"""Message passing over features(id, x array<double>): a join along the edges and an aggregation by target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph
from . import arrays, matrix


def _long(features: DataFrame) -> DataFrame:
    return features.select("id", F.posexplode("x").alias("j", "v"))


def _rows(long: DataFrame, key: str = "id") -> DataFrame:
    return long.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda s: s["v"]).alias("x"))


def linear(x: Column | str, weights: list[list[float]]) -> Column:
    """x W^T for a small weight matrix of (out x in) literals."""
    return F.array(*[arrays.dot(x, F.array(*[F.lit(float(v)) for v in row])) for row in weights])


def aggregate(graph: Graph, features: DataFrame, how: str = "sum", message: Column | None = None) -> DataFrame:
    """(id, x): for each vertex with in-edges the element-wise sum, mean or max of its sources' messages."""
    f = {"sum": F.sum("v"), "mean": F.avg("v"), "max": F.max("v")}[how].alias("v")
    sent = features.select(F.col("id").alias("src"), (message if message is not None else F.col("x")).alias("x"))
    return _rows(graph.arcs().join(sent, "src").select(F.col("dst").alias("id"), F.posexplode("x").alias("j", "v")).groupBy("id", "j").agg(f))


def message_passing(graph: Graph, features: DataFrame, how: str = "sum", message: Column | None = None, update=None) -> DataFrame:
    """update(old, message) for vertices that get one; the others keep their state."""
    got = aggregate(graph, features, how, message).withColumnRenamed("x", "_m")
    value = F.col("_m") if update is None else update(F.col("x"), F.col("_m"))
    return features.join(got, "id", "left").select("id", F.when(F.col("_m").isNotNull(), value).otherwise(F.col("x")).alias("x"))


def gcn(graph: Graph, features: DataFrame, weights: list[list[float]] | None = None) -> DataFrame:
    """D^-1/2 (A + I) D^-1/2 H W^T."""
    a = matrix.symmetric_normalized(matrix.self_loops(matrix.adjacency(graph), graph.vertices))
    h = features if weights is None else features.select("id", linear("x", weights).alias("x"))
    out = matrix.matmul(matrix.transpose(a), _long(h).withColumnRenamed("id", "i"))
    return _rows(out, "i").withColumnRenamed("i", "id")


def gat(graph: Graph, features: DataFrame, attend_src: list[float], attend_dst: list[float], weights: list[list[float]] | None = None, slope: float = 0.2) -> DataFrame:
    """Attention over each vertex's in-edges: softmax by target of leaky_relu(a.h_src + b.h_dst), by edge."""
    h = features if weights is None else features.select("id", linear("x", weights).alias("x"))
    lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
    s = h.select(F.col("id").alias("src"), "x", arrays.dot("x", lit(attend_src)).alias("es"))
    t = h.select(F.col("id").alias("dst"), arrays.dot("x", lit(attend_dst)).alias("ed"))
    e = graph.arcs().select("edge_id", "src", "dst").join(s, "src").join(t, "dst").withColumn("e", arrays.leaky_relu(F.col("es") + F.col("ed"), slope))
    w = Window.partitionBy("dst")
    e = e.withColumn("p", F.exp(F.col("e") - F.max("e").over(w))).withColumn("alpha", F.col("p") / F.sum("p").over(w))
    return _rows(e.select(F.col("dst").alias("id"), "alpha", F.posexplode("x").alias("j", "v")).groupBy("id", "j").agg(F.sum(F.col("alpha") * F.col("v")).alias("v")))


def sage(graph: Graph, features: DataFrame, k: int, out_features: int | None = None) -> DataFrame:
    """[own || mean of the first k out-neighbours in order of edge_id], cut to out_features."""
    nth = F.row_number().over(Window.partitionBy("src").orderBy("edge_id"))
    few = graph.arcs().withColumn("_n", nth).where(F.col("_n") <= k)
    sent = features.select(F.col("id").alias("dst"), "x")
    m = _rows(few.join(sent, "dst").select(F.col("src").alias("id"), F.posexplode("x").alias("j", "v")).groupBy("id", "j").agg(F.avg("v").alias("v"))).withColumnRenamed("x", "_m")
    both = F.concat("x", F.coalesce("_m", F.transform("x", lambda v: F.lit(0.0))))
    return features.join(m, "id", "left").select("id", (F.slice(both, 1, out_features) if out_features else both).alias("x"))
