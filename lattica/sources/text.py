"""Text exports.  The line tables are ordered DataFrames; the strings are for graphs that fit the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import TooLarge
from ..graph import Graph

DRAW_LIMIT = 20_000


def _label(graph: Graph) -> Column:
    return F.col("label").cast("string") if "label" in graph.vertices.columns else F.col("id").cast("string")


def adjacency_list(graph: Graph) -> DataFrame:
    """(id, line): `label: n1 n2 ...`, in order of edges."""
    return graph.adjacency().join(graph.vertices.select("id", _label(graph).alias("_l")), "id").select("id", F.rtrim(F.concat("_l", F.lit(": "), F.array_join(F.transform("neighbors", lambda x: x.cast("string")), " "))).alias("line"))


def edge_list(graph: Graph) -> DataFrame:
    """(edge_id, line): `src dst weight`."""
    return graph.edges.select("edge_id", F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string"), F.col("weight").cast("string")).alias("line"))


def write_lines(lines: DataFrame, key: str, path: str) -> None:
    lines.repartitionByRange(F.col(key)).sortWithinPartitions(key).select("line").write.mode("overwrite").text(path)


def _escape(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def dot_lines(graph: Graph, node_labels: bool = True, edge_labels: bool = True, arrow: str = "->", node_attrs: str = "", edge_attrs: str = "") -> DataFrame:
    """(part, key, line) whose order by (part, key) is the body of a DOT graph."""
    extra = lambda labels, text, attrs: F.concat(F.lit(" ["), F.concat_ws(", ", *([F.concat(F.lit('label="'), _escape(text), F.lit('"'))] if labels else []), *([F.lit(attrs)] if attrs else [])), F.lit("]")) if labels or attrs else F.lit("")
    v = graph.vertices.select(F.lit(0).alias("part"), F.col("id").alias("key"), F.concat(F.lit("    "), F.col("id").cast("string"), extra(node_labels, _label(graph), node_attrs), F.lit(";")).alias("line"))
    e = graph.edges.select(F.lit(1), "edge_id", F.concat(F.lit("    "), F.col("src").cast("string"), F.lit(f" {arrow} "), F.col("dst").cast("string"), extra(edge_labels, F.col("weight").cast("string"), edge_attrs), F.lit(";")))
    return v.union(e)


def to_dot(graph: Graph, name: str = "G", **options) -> str:
    kind, arrow = ("digraph", "->") if graph.directed else ("graph", "--")
    rows = dot_lines(graph, arrow=arrow, **options).orderBy("part", "key").limit(DRAW_LIMIT + 1).collect()
    if len(rows) > DRAW_LIMIT:
        raise TooLarge("write dot_lines() with write_lines() instead")
    return "\n".join([f"{kind} {name} {{", *(r.line for r in rows), "}"]) + "\n"


def circular_layout(vertices: DataFrame, width: float = 800, height: float = 600) -> DataFrame:
    """(id, x, y) on a circle of 0.8 of the half side; positions by rank of id."""
    from pyspark.sql import Window

    n = max(1, vertices.count())
    rank = F.row_number().over(Window.orderBy("id")) - 1
    r = 0.8 * min(width, height) / 2
    angle = 2 * math.pi * F.col("_k") / n
    return vertices.select("id", rank.alias("_k")).select("id", (F.cos(angle) * r + width / 2).alias("x"), (F.sin(angle) * r + height / 2).alias("y"))


def _force(nodes, edges, width, height, rounds=50, repel=1000.0, attract=0.01, damping=0.85):
    import numpy as np

    n = len(nodes)
    k = np.arange(n) * 2 * math.pi / max(1, n)
    p = np.stack([np.cos(k), np.sin(k)], 1) * 0.4 * min(width, height) + [width / 2, height / 2]
    v = np.zeros_like(p)
    at = {x: i for i, x in enumerate(nodes)}
    s, d = (np.array([at[e[i]] for e in edges], int) for i in (0, 1))
    for _ in range(rounds):
        f = np.zeros_like(p)
        for i in range(0, n, 256):
            diff = p[i : i + 256, None] - p[None]
            f[i : i + 256] += (diff * (repel / np.maximum(1e-2, (diff**2).sum(-1)) ** 1.5)[..., None]).sum(1)
        pull = (p[d] - p[s]) * attract if len(edges) else np.zeros((0, 2))
        np.add.at(f, s, pull)
        np.add.at(f, d, -pull)
        v = (v + f) * damping
        p = np.clip(p + v, 20, [width - 20, height - 20])
    return {x: tuple(p[i]) for x, i in at.items()}


def write_text(graph: Graph, path: str, text: str) -> None:
    """A drawing or DOT text to any path that Spark can open."""
    from .files import write_bytes

    write_bytes(graph.edges.sparkSession, path, [text.encode()])


def to_svg(graph: Graph, layout: str = "circular", width: float = 800, height: float = 600, radius: float = 10) -> str:
    nodes = [r.id for r in graph.vertices.select("id").orderBy("id").limit(DRAW_LIMIT + 1).collect()]
    edges = [(r.src, r.dst) for r in graph.edges.orderBy("edge_id").select("src", "dst").limit(DRAW_LIMIT + 1).collect()]
    if max(len(nodes), len(edges)) > DRAW_LIMIT:
        raise TooLarge("too large to draw")
    if layout == "force":
        at = _force(nodes, edges, width, height)
    elif layout == "hierarchical":
        at = {x: (width * (i + 1) / (len(nodes) + 1), height / 2) for i, x in enumerate(nodes)}
    else:
        at = {r.id: (r.x, r.y) for r in circular_layout(graph.vertices, width, height).collect()}
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:g}" height="{height:g}">']
    out += [f'<line x1="{at[s][0]:.2f}" y1="{at[s][1]:.2f}" x2="{at[d][0]:.2f}" y2="{at[d][1]:.2f}" stroke="#999"/>' for s, d in edges]
    out += [f'<circle cx="{at[n][0]:.2f}" cy="{at[n][1]:.2f}" r="{radius:g}" fill="#69b"/><text x="{at[n][0]:.2f}" y="{at[n][1]:.2f}">{n}</text>' for n in nodes]
    return "\n".join([*out, "</svg>"]) + "\n"
