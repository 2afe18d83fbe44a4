"""Checks and edits of operator graphs: defects, constraints, modules, history."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from .community import connected_components
from .structure import is_dag
from .traversal import bfs


def defects(graph: Graph) -> DataFrame:
    """(kind, severity, id): vertices without out-edges, and components beyond the first."""
    lone = graph.vertices.select("id").join(graph.arcs().select(F.col("src").alias("id")).distinct(), "id", "left_anti")
    parts = connected_components(graph).select("component").distinct()
    first = parts.agg(F.min("component")).first()[0]
    return lone.select(F.lit("IsolatedNode").alias("kind"), F.lit("Warning").alias("severity"), "id").union(
        parts.where(F.col("component") != F.lit(first)).select(F.lit("DisconnectedComponent"), F.lit("Error"), "component")
    )


def topology_report(graph: Graph) -> dict:
    lone = defects(graph).where("kind = 'IsolatedNode'").count()
    return {"components": connected_components(graph).select("component").distinct().count(), "is_dag": is_dag(graph), "isolated": lone}


def gradient_flow(graph: Graph, start: Column, end: Column) -> bool:
    """Some vertex that meets `end` is reached from one that meets `start`."""
    reached = bfs(graph, graph.vertices.where(start)).select("id")
    return not graph.vertices.where(end).join(reached, "id", "left_semi").isEmpty()


def residual_present(graph: Graph) -> bool:
    return not graph.edges.where("kind = 'Residual'").isEmpty() if "kind" in graph.edges.columns else False


def attention_balance(edges: DataFrame, tolerance: float) -> bool:
    """edges(layer, head, weight): no head's share of its layer is off the even share by more than the tolerance."""
    h = edges.groupBy("layer", "head").agg(F.sum("weight").alias("w"))
    t = h.groupBy("layer").agg(F.sum("w").alias("t"), F.count("*").alias("n"))
    return h.join(t, "layer").where(F.abs(F.col("w") / F.col("t") - 1.0 / F.col("n")) > tolerance).isEmpty()


def assembly_errors(graph: Graph) -> DataFrame:
    """Edges whose source's out_dim is not their target's in_dim; vertices carry both."""
    a = graph.vertices.select(F.col("id").alias("src"), "out_dim")
    b = graph.vertices.select(F.col("id").alias("dst"), "in_dim")
    return graph.edges.join(a, "src").join(b, "dst").where("out_dim <> in_dim")


def extract_module(graph: Graph, path: str, column: str = "label") -> Graph:
    return graph.subgraph(F.contains(F.col(column), F.lit(path)))


def replace_module(graph: Graph, path: str, module: Graph, column: str = "label") -> Graph:
    old = graph.vertices.where(F.contains(F.col(column), F.lit(path))).select("id")
    kept = graph.remove_nodes(old)
    return replace(kept, vertices=kept.vertices.unionByName(module.vertices, allowMissingColumns=True), edges=kept.edges.unionByName(module.edges, allowMissingColumns=True))


@dataclass
class Editor:
    """Edits of a graph with undo: every version is kept, as immutable frames."""

    graph: Graph
    history: list[Graph] = field(default_factory=list)

    def apply(self, new: Graph) -> Graph:
        self.history.append(self.graph)
        self.graph = new
        return new

    def undo(self) -> bool:
        if not self.history:
            return False
        self.graph = self.history.pop()
        return True

    def rollback(self, index: int) -> bool:
        if not 0 <= index < len(self.history):
            return False
        self.graph, self.history = self.history[index], self.history[:index]
        return True

    def connect_components(self) -> int:
        """Join every component to the first by an edge from that one's least vertex; returns how many edges were added."""
        parts = connected_components(self.graph).select("component").distinct()
        first = parts.agg(F.min("component")).first()[0]
        last = self.graph.edges.agg(F.coalesce(F.max("edge_id"), F.lit(-1))).first()[0]
        new = parts.where(F.col("component") != F.lit(first)).select((F.lit(last + 1) + F.col("component")).alias("edge_id"), F.lit(first).alias("src"), F.col("component").alias("dst"), F.lit(1.0).alias("weight"))
        n = new.count()
        if n:
            self.apply(self.graph.add_edges(new))
        return n
