"""A property graph as two DataFrames, vertices(id, ...) and edges(edge_id, src, dst, weight, ...).

Both are immutable, so every editing operation returns a new graph and every
graph is its own snapshot.  A graph with directed=False keeps each edge once
and is symmetrised where it is read.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import EdgeNotFound, NodeDeleted, NodeNotFound

VERTEX_SCHEMA = "id long, gen int"
EDGE_SCHEMA = "edge_id long, src long, dst long, weight double"


def opposite(direction: str) -> str:
    return {"out": "in", "in": "out"}[direction]


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame
    directed: bool = True

    # construction
    @classmethod
    def empty(cls, spark: SparkSession, directed: bool = True) -> Graph:
        return cls(spark.createDataFrame([], VERTEX_SCHEMA), spark.createDataFrame([], EDGE_SCHEMA), directed)

    @classmethod
    def from_edges(cls, edges: DataFrame, vertices: DataFrame | None = None, directed: bool = True) -> Graph:
        """edges(src, dst[, weight, edge_id, ...]); vertices are their ends unless given."""
        if "weight" not in edges.columns:
            edges = edges.withColumn("weight", F.lit(1.0))
        if "edge_id" not in edges.columns:
            edges = edges.withColumn("edge_id", F.monotonically_increasing_id())
        if vertices is None:
            vertices = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
        if "gen" not in vertices.columns:
            vertices = vertices.withColumn("gen", F.lit(1))
        return cls(vertices, edges, directed)

    @classmethod
    def build(cls, spark: SparkSession, nodes: list, edges: list[tuple[int, int, float]], directed: bool = True) -> Graph:
        """From literal nodes (labels; ids are positions) and edges over positions, which are checked."""
        for s, d, _ in edges:
            if not (0 <= s < len(nodes) and 0 <= d < len(nodes)):
                raise NodeNotFound(f"edge {s}->{d} leaves the {len(nodes)} nodes")
        v = spark.createDataFrame([(i, 1, str(x)) for i, x in enumerate(nodes)], "id long, gen int, label string")
        e = spark.createDataFrame([(i, s, d, float(w)) for i, (s, d, w) in enumerate(edges)], EDGE_SCHEMA)
        return cls(v, e, directed)

    def dangling_edges(self) -> DataFrame:
        """Edges one of whose ends is no vertex."""
        ids = self.vertices.select("id")
        bad = [self.edges.join(ids, self.edges[c] == ids["id"], "left_anti") for c in ("src", "dst")]
        return bad[0].union(bad[1]).dropDuplicates(["edge_id"])

    # counts and access
    def node_count(self) -> int:
        return self.vertices.count()

    def edge_count(self) -> int:
        return self.edges.count()

    def is_empty(self) -> bool:
        return self.vertices.isEmpty()

    def contains_node(self, node: int, gen: int | None = None) -> bool:
        found = self.vertices.where(F.col("id") == node)
        return not (found if gen is None else found.where(F.col("gen") == gen)).isEmpty()

    def contains_edge(self, edge: int) -> bool:
        return not self.edges.where(F.col("edge_id") == edge).isEmpty()

    def get_node(self, node: int, gen: int | None = None):
        row = self.vertices.where(F.col("id") == node).first()
        if row is None:
            raise NodeNotFound(node)
        if gen is not None and row["gen"] != gen:
            raise NodeDeleted(f"{node} generation {gen}")
        return row

    def get_edge(self, edge: int):
        row = self.edges.where(F.col("edge_id") == edge).first()
        if row is None:
            raise EdgeNotFound(edge)
        return row

    def edge_endpoints(self, edge: int) -> tuple[int, int]:
        row = self.get_edge(edge)
        return row["src"], row["dst"]

    def edges_between(self, pairs: DataFrame) -> DataFrame:
        """For pairs(src, dst): the first edge (least edge_id) of each that has one."""
        first = self.arcs().groupBy("src", "dst").agg(F.min_by("weight", "edge_id").alias("weight"), F.min("edge_id").alias("edge_id"))
        return pairs.join(first, ["src", "dst"])

    def get_edge_by_nodes(self, src: int, dst: int):
        row = self.arcs().where((F.col("src") == src) & (F.col("dst") == dst)).orderBy("edge_id").first()
        if row is None:
            raise EdgeNotFound((src, dst))
        return row

    def has_edge(self, src: int, dst: int) -> bool:
        return not self.arcs().where((F.col("src") == src) & (F.col("dst") == dst)).isEmpty()

    def neighbors(self, node: int, direction: str = "out") -> DataFrame:
        a, b = ("src", "dst") if direction == "out" else ("dst", "src")
        return self.arcs().where(F.col(a) == node).orderBy("edge_id").select(F.col(b).alias("id"))

    def incident_edges(self, node: int) -> DataFrame:
        return self.arcs().where(F.col("src") == node).orderBy("edge_id").select("edge_id")

    def arcs(self) -> DataFrame:
        """Edges as they are walked: each way for an undirected graph (a loop once)."""
        if self.directed:
            return self.edges
        ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
        both = self.edges.withColumn("_way", F.explode(F.when(F.col("src") == F.col("dst"), F.slice(ways, 1, 1)).otherwise(ways)))
        return both.withColumns({"src": F.col("_way.src"), "dst": F.col("_way.dst")}).drop("_way")

    def undirected(self) -> Graph:
        return replace(self, directed=False)

    def reversed(self) -> Graph:
        return replace(self, edges=self.edges.withColumns({"src": F.col("dst"), "dst": F.col("src")}))

    def degrees(self) -> DataFrame:
        """(id, in_degree, out_degree, degree) for every vertex, in one aggregation over both ends."""
        ends = self.arcs().select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o")))).alias("e"))
        d = ends.groupBy("e.id").agg(F.sum(1 - F.col("e.o")).alias("in_degree"), F.sum("e.o").alias("out_degree"))
        out = self.vertices.select("id").join(d, "id", "left").na.fill(0)
        return out.withColumn("degree", F.col("in_degree") + F.col("out_degree"))

    def adjacency(self) -> DataFrame:
        """(id, neighbors) in order of edge_id; the list is as long as the vertex's degree."""
        lists = self.arcs().groupBy(F.col("src").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("edge_id", "dst"))), lambda x: x["dst"]).alias("neighbors"))
        return self.vertices.select("id").join(lists, "id", "left").withColumn("neighbors", F.coalesce("neighbors", F.array().cast("array<long>")))

    # editing
    def add_nodes(self, rows: DataFrame) -> Graph:
        """rows(id, ...); an id that was removed comes back with its generation raised by the caller."""
        if "gen" not in rows.columns:
            rows = rows.withColumn("gen", F.lit(1))
        return replace(self, vertices=self.vertices.unionByName(rows, allowMissingColumns=True))

    def add_node(self, **values) -> tuple[Graph, int]:
        node = (self.vertices.agg(F.max("id")).first()[0] if "id" not in values else values.pop("id") - 1) or 0
        node = node + 1 if self.contains_node(node) or node else node
        fields = {"id": node, "gen": values.pop("gen", 1), **values}
        kinds = {f.name: f.dataType.simpleString() for f in self.vertices.schema}
        row = self.vertices.sparkSession.createDataFrame([tuple(fields.values())], ", ".join(f"{k} {kinds.get(k, 'string')}" for k in fields))
        return self.add_nodes(row), node

    def add_edges(self, rows: DataFrame) -> Graph:
        """rows(edge_id, src, dst, weight, ...), both ends of which must be vertices."""
        new = replace(self, edges=self.edges.unionByName(rows, allowMissingColumns=True))
        if not Graph(self.vertices, rows).dangling_edges().isEmpty():
            raise NodeNotFound("an end of a new edge is no vertex")
        return new

    def add_edge(self, src: int, dst: int, weight: float = 1.0) -> tuple[Graph, int]:
        last = self.edges.agg(F.max("edge_id")).first()[0]
        edge = 0 if last is None else last + 1
        return self.add_edges(self.edges.sparkSession.createDataFrame([(edge, src, dst, float(weight))], EDGE_SCHEMA)), edge

    def remove_nodes(self, ids: DataFrame) -> Graph:
        """Without the vertices ids(id) and all edges at them."""
        gone = ids.select("id").distinct()
        e = self.edges.join(gone, F.col("src") == gone["id"], "left_anti").join(gone, F.col("dst") == gone["id"], "left_anti")
        return replace(self, vertices=self.vertices.join(gone, "id", "left_anti"), edges=e)

    def remove_node(self, node: int, gen: int | None = None) -> Graph:
        self.get_node(node, gen)
        return replace(self, vertices=self.vertices.where(F.col("id") != node), edges=self.edges.where((F.col("src") != node) & (F.col("dst") != node)))

    def remove_edge(self, edge: int) -> Graph:
        self.get_edge(edge)
        return replace(self, edges=self.edges.where(F.col("edge_id") != edge))

    def update_node(self, node: int, **values) -> Graph:
        self.get_node(node)
        return replace(self, vertices=self.vertices.withColumns({k: F.when(F.col("id") == node, F.lit(v)).otherwise(F.col(k)) for k, v in values.items()}))

    def update_edge(self, edge: int, **values) -> Graph:
        self.get_edge(edge)
        return replace(self, edges=self.edges.withColumns({k: F.when(F.col("edge_id") == edge, F.lit(v)).otherwise(F.col(k)) for k, v in values.items()}))

    def clear(self) -> Graph:
        return replace(self, vertices=self.vertices.limit(0), edges=self.edges.limit(0))

    def subgraph(self, condition: Column) -> Graph:
        """Induced by the vertices that meet the condition."""
        v = self.vertices.where(condition)
        ids = v.select("id")
        e = self.edges.join(ids, F.col("src") == ids["id"], "left_semi").join(ids, F.col("dst") == ids["id"], "left_semi")
        return replace(self, vertices=v, edges=e)

    def find_nodes(self, column: str, value) -> DataFrame:
        return self.vertices.where(F.col(column) == value).select("id")

    # the algorithms, under their usual names
    def pagerank(self, **options) -> DataFrame:
        from .operators.centrality import pagerank

        return pagerank(self, **options)

    def degree_centrality(self) -> DataFrame:
        from .operators.centrality import degree_centrality

        return degree_centrality(self)

    def connected_components(self) -> DataFrame:
        from .operators.community import connected_components

        return connected_components(self)

    def shortest_paths(self, source: int) -> DataFrame:
        from .operators.paths import dijkstra

        return dijkstra(self, source)

    def bfs_order(self, start: int) -> list[int]:
        from .operators.traversal import bfs

        return [r.id for r in bfs(self, [start]).orderBy("depth", "id").collect()]

    def is_connected(self) -> bool:
        from .operators.structure import is_connected

        return is_connected(self)

    def is_dag(self) -> bool:
        from .operators.structure import is_dag

        return is_dag(self)

    def has_cycle(self) -> bool:
        return not self.is_dag()

    def density(self) -> float:
        from .operators.structure import density

        return density(self)

    def to_dot(self, **options) -> str:
        from .sources.text import to_dot

        return to_dot(self, **options)
