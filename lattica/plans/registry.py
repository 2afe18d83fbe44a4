"""Named algorithms: registration, configuration checks, tags, and dispatch over graphs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..graph import Graph
from ..operators import centrality, community, paths, structure, traversal


@dataclass(frozen=True)
class Field:
    kind: type
    default: object = None
    low: float | None = None
    high: float | None = None


@dataclass
class Algorithm:
    name: str
    run: Callable[..., object]
    tags: tuple[str, ...] = ()
    config: dict[str, Field] = field(default_factory=dict)

    def checked(self, config: dict) -> dict:
        unknown = set(config) - set(self.config)
        if unknown:
            raise ValueError(f"{self.name}: unknown settings {sorted(unknown)}")
        out = {}
        for k, f in self.config.items():
            v = config.get(k, f.default)
            if v is not None and not isinstance(v, (int, float) if f.kind is float else f.kind):
                raise ValueError(f"{self.name}: {k} must be {f.kind.__name__}")
            if v is not None and (f.low is not None and v < f.low or f.high is not None and v > f.high):
                raise ValueError(f"{self.name}: {k} out of range")
            out[k] = v
        return out


class Registry:
    def __init__(self):
        self._all: dict[str, Algorithm] = {}

    def register(self, algorithm: Algorithm) -> None:
        if algorithm.name in self._all:
            raise ValueError(f"{algorithm.name} is already registered")
        self._all[algorithm.name] = algorithm

    def unregister(self, name: str) -> None:
        del self._all[name]

    def names(self) -> list[str]:
        return sorted(self._all)

    def find_by_tag(self, tag: str) -> list[str]:
        return sorted(n for n, a in self._all.items() if tag in a.tags)

    def execute(self, name: str, graph: Graph, **config):
        if name not in self._all:
            raise KeyError(name)
        a = self._all[name]
        return a.run(graph, **a.checked(config))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(a.name, list(a.tags), sorted(a.config)) for a in self._all.values()], "name string, tags array<string>, settings array<string>")


def builtin() -> Registry:
    r, number = Registry(), Field(int)
    for a in (
        Algorithm("pagerank", centrality.pagerank, ("centrality",), {"damping": Field(float, 0.85, 0, 1), "iterations": Field(int, 100, 0), "tolerance": Field(float, 1e-6)}),
        Algorithm("bfs", lambda g, start: traversal.bfs(g, [start]), ("traversal",), {"start": number}),
        Algorithm("dfs", lambda g, start: traversal.dfs(g, start), ("traversal",), {"start": number}),
        Algorithm("connected_components", community.connected_components, ("community",)),
        Algorithm("dijkstra", lambda g, source: paths.dijkstra(g, source), ("path",), {"source": number}),
        Algorithm("bellman_ford", lambda g, source: paths.bellman_ford(g, source), ("path",), {"source": number}),
        Algorithm("topological_sort", traversal.topological_sort, ("traversal", "dag")),
        Algorithm("betweenness_centrality", centrality.betweenness_centrality, ("centrality",), {"normalized": Field(bool, True)}),
        Algorithm("closeness_centrality", centrality.closeness_centrality, ("centrality",), {"variant": Field(str, "standard")}),
        Algorithm("louvain", community.louvain, ("community",), {"resolution": Field(float, 1.0, 0)}),
    ):
        r.register(a)
    return r


#: Phrases and the call that answers them.
INTENTS = {"rank": "pagerank", "important": "pagerank", "shortest": "shortest_paths", "route": "shortest_paths", "communit": "louvain", "cluster": "connected_components", "cycle": "has_cycle", "order": "topological_sort", "central": "degree_centrality"}


def intent_to_api(text: str) -> str | None:
    return next((call for word, call in INTENTS.items() if word in text.lower()), None)


class Catalog:
    """Named graphs, with the eight calls of a graph tool server; each graph's frames are temporary views as well."""

    def __init__(self, spark: SparkSession):
        self.spark, self.graphs = spark, {}

    def _put(self, name: str, graph: Graph) -> Graph:
        self.graphs[name] = graph
        graph.vertices.createOrReplaceTempView(f"g_{name}_vertices")
        graph.edges.createOrReplaceTempView(f"g_{name}_edges")
        return graph

    def create_graph(self, name: str, directed: bool = True) -> None:
        self._put(name, Graph.empty(self.spark, directed))

    def add_node(self, name: str, **values) -> int:
        graph, node = self.graphs[name].add_node(**values)
        self._put(name, graph)
        return node

    def add_edge(self, name: str, src: int, dst: int, weight: float = 1.0) -> int:
        graph, edge = self.graphs[name].add_edge(src, dst, weight)
        self._put(name, graph)
        return edge

    def get_neighbors(self, name: str, node: int) -> list[int]:
        return [r.id for r in self.graphs[name].neighbors(node).collect()]

    def page_rank(self, name: str, **options) -> DataFrame:
        return centrality.pagerank(self.graphs[name], **options)

    def shortest_path(self, name: str, source: int, target: int) -> list[int]:
        return paths.reconstruct_path(paths.dijkstra(self.graphs[name], source), source, target)

    def graph_info(self, name: str) -> dict:
        g = self.graphs[name]
        return {"nodes": g.node_count(), "edges": g.edge_count(), "density": structure.density(g), "directed": g.directed}

    def list_graphs(self) -> list[str]:
        return sorted(self.graphs)
