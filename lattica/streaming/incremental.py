"""Graph measures kept up to date over a stream of edges or events, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_edge_weights(events: DataFrame, time: str = "ts", window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """(window, src, dst, weight) of events(ts, src, dst, weight), late rows being dropped after the delay."""
    return events.withWatermark(time, delay).groupBy(F.window(time, window), "src", "dst").agg(F.sum("weight").alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """Running (id, out_degree, in_degree) of a stream edges(src, dst); for output mode complete or update."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


def components_sink(path: str):
    """A foreachBatch function that merges each batch of edges(src, dst) into a table of components at `path`.

    Only the batch's ends and their components are joined; batch n is written to its own folder, so a batch that is run
    again after a failure replaces its own result.
    """

    def merge(batch: DataFrame, n: int) -> None:
        from ..graph import Graph
        from ..operators.community import connected_components

        spark = batch.sparkSession
        e = batch.select("src", "dst")
        old = spark.read.parquet(f"{path}/{n - 1}") if n else spark.createDataFrame([], "id long, component long")
        known = e.union(old.select("id", "component").where("id <> component"))
        ids = e.select(F.col("src").alias("id")).union(e.select("dst")).union(old.select("id")).distinct()
        connected_components(Graph.from_edges(known, ids, False)).write.mode("overwrite").parquet(f"{path}/{n}")

    return merge
