"""Registered queries for the graph and tensor operators, each with the SQL it is held against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, decompose, differentiable, gnn, matrix, transformer
from ..graph import Graph
from ..operators import centrality, community, flow, model, partition, paths, structure, traversal
from ..sources import generators, text
from ..sources.tables import edges_sql, graph, table, vertices_sql

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _r(c, name: str):
    return F.round(c, 6).alias(name)


def _one(spark: SparkSession, **values) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], list(values))


def with_(name: str, body: str, more: str = "") -> str:
    """SQL over e (edges) and v (vertices) of a table graph."""
    return f"WITH RECURSIVE e AS ({edges_sql(name)}), v AS ({vertices_sql(name)}){', ' + more if more else ''} {body}"


BOTH = "u AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e)"
HOPS = "h AS (SELECT id AS source, id, 0 AS depth FROM v UNION SELECT h.source, e.dst, h.depth + 1 FROM h JOIN e ON h.id = e.src WHERE h.depth < 26), d AS (SELECT source, id, MIN(depth) AS depth FROM h GROUP BY source, id)"


# containers and access
@query(with_("trade", "SELECT v.id, COALESCE(i.n, 0) AS in_degree, COALESCE(o.n, 0) AS out_degree, COALESCE(i.n, 0) + COALESCE(o.n, 0) AS degree FROM v LEFT JOIN (SELECT dst, COUNT(*) AS n FROM e GROUP BY dst) i ON v.id = i.dst LEFT JOIN (SELECT src, COUNT(*) AS n FROM e GROUP BY src) o ON v.id = o.src"))
def degrees(spark, sf):
    return graph(spark, sf, "trade").degrees()


@query(with_("part_supp", "SELECT id, COUNT(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) x GROUP BY id"))
def degrees_part_supp(spark, sf):
    return graph(spark, sf, "part_supp").degrees().select("id", "degree")


@query(with_("trade", "SELECT CAST((SELECT COUNT(*) FROM v) AS BIGINT) AS nodes, CAST((SELECT COUNT(*) FROM e) AS BIGINT) AS edges, ROUND((SELECT COUNT(*) FROM e) / 600.0::DOUBLE, 6) AS density"))
def graph_counts(spark, sf):
    g = graph(spark, sf, "trade")
    return _one(spark, nodes=g.node_count(), edges=g.edge_count(), density=round(structure.density(g), 6))


@query(with_("partners", "SELECT src, dst, edge_id, weight FROM e WHERE src < dst"))
def edge_lookup(spark, sf):
    g = graph(spark, sf, "partners")
    return g.edges_between(g.edges.select("src", "dst").where("src < dst")).select("src", "dst", "edge_id", "weight")


@query(with_("partners", "SELECT v.id, COALESCE((SELECT string_agg(CAST(dst AS VARCHAR), ' ' ORDER BY edge_id) FROM e WHERE e.src = v.id), '') AS line FROM v"))
def adjacency_list(spark, sf):
    return text.adjacency_list(graph(spark, sf, "partners")).select("id", F.ltrim(F.regexp_replace("line", r"^\d+:", "")).alias("line"))


@query(with_("partners", "SELECT edge_id, CAST(src AS VARCHAR) || ' ' || CAST(dst AS VARCHAR) || ' ' || CAST(weight AS VARCHAR) AS line FROM e"))
def edge_list(spark, sf):
    return text.edge_list(graph(spark, sf, "partners"))


@query(with_("partners", "SELECT v.id FROM v WHERE v.id % 4 <> 1"))
def remove_nodes(spark, sf):
    g = graph(spark, sf, "partners")
    return g.remove_nodes(g.vertices.where("id % 4 = 1")).vertices.select("id")


@query(with_("partners", "SELECT edge_id, src, dst, CASE WHEN edge_id % 3 = 0 THEN weight * 2 ELSE weight END AS weight FROM e WHERE src % 4 <> 1 AND dst % 4 <> 1"))
def edit_edges(spark, sf):
    g = graph(spark, sf, "partners")
    g = g.remove_nodes(g.vertices.where("id % 4 = 1"))
    return g.edges.withColumn("weight", F.when(F.col("edge_id") % 3 == 0, F.col("weight") * 2).otherwise(F.col("weight"))).select("edge_id", "src", "dst", "weight")


@query(with_("partners", "SELECT dst AS src, src AS dst, weight FROM e"))
def reversed_edges(spark, sf):
    return graph(spark, sf, "partners").reversed().edges.select("src", "dst", "weight")


# traversal
@query(with_("partners", "SELECT id, CAST(depth AS BIGINT) AS depth FROM d WHERE source = 0", HOPS))
def bfs(spark, sf):
    return traversal.bfs(graph(spark, sf, "partners"), [0]).select("id", F.col("depth").cast("long").alias("depth"))


@query(with_("partners", "SELECT id, CAST(MIN(depth) AS BIGINT) AS depth FROM d WHERE source IN (1, 2, 3) AND depth <= 2 GROUP BY id", HOPS))
def multi_source_bfs(spark, sf):
    return traversal.bfs(graph(spark, sf, "partners"), [1, 2, 3], max_depth=2).select("id", F.col("depth").cast("long").alias("depth"))


@query(with_("partners", "SELECT d.id, MIN(p.id) AS parent FROM d JOIN e ON e.dst = d.id JOIN d p ON p.source = 0 AND p.id = e.src AND p.depth = d.depth - 1 WHERE d.source = 0 GROUP BY d.id", HOPS))
def bfs_parents(spark, sf):
    return traversal.bfs(graph(spark, sf, "partners"), [0]).where("parent IS NOT NULL").select("id", "parent")


@query(with_("geo", "SELECT CAST(depth AS BIGINT) AS depth, COUNT(*) AS n FROM t GROUP BY depth", "t AS (SELECT DISTINCT src AS id, 0 AS depth FROM e WHERE src < 5 UNION ALL SELECT e.dst, t.depth + 1 FROM t JOIN e ON t.id = e.src)"))
def bfs_geo(spark, sf):
    return traversal.bfs(graph(spark, sf, "geo"), [0, 1, 2, 3, 4]).groupBy(F.col("depth").cast("long").alias("depth")).agg(F.count("*").alias("n"))


@query(with_("ranked", "SELECT id, CAST(MAX(level) AS BIGINT) AS level FROM t GROUP BY id", "t AS (SELECT id, 0 AS level FROM v UNION SELECT e.dst, t.level + 1 FROM t JOIN e ON t.id = e.src)"))
def topological_levels(spark, sf):
    return traversal.topological_levels(graph(spark, sf, "ranked")).select("id", F.col("level").cast("long").alias("level"))


@query(with_("ranked", "SELECT path FROM t WHERE id = (SELECT MAX(dst) FROM e)", "t AS (SELECT MIN(src) AS id, CAST(MIN(src) AS VARCHAR) AS path, 0 AS n FROM e UNION ALL SELECT e.dst, t.path || '>' || CAST(e.dst AS VARCHAR), n + 1 FROM t JOIN e ON t.id = e.src WHERE n < 12)"))
def all_paths(spark, sf):
    g = graph(spark, sf, "ranked")
    a, b = g.edges.agg(F.min("src"), F.max("dst")).first()
    return traversal.all_paths(g, a, b, 12).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query(with_("partners", "SELECT a.source AS id, MAX(a.id) AS scc FROM d a JOIN d b ON a.source = b.id AND a.id = b.source GROUP BY a.source", HOPS))
def strong_components(spark, sf):
    return traversal.strong_components(graph(spark, sf, "partners"))


@query(with_("partners", "SELECT id, TRUE AS in_parent, CAST(depth = 0 AS BOOLEAN) AS start FROM d WHERE source = 0", HOPS))
def dfs(spark, sf):
    """Reached vertices; whether each lies within its parent's time and is joined to it by an edge."""
    g = graph(spark, sf, "partners")
    rows = traversal.dfs(g, 0)
    own = {r["id"]: r for r in rows}
    edges = {(r.src, r.dst) for r in g.edges.collect()}
    ok = lambda r: r["parent"] is None or ((r["parent"], r["id"]) in edges and own[r["parent"]]["discovery"] < r["discovery"] < r["finish"] < own[r["parent"]]["finish"])
    return spark.createDataFrame([(r["id"], ok(r), r["parent"] is None) for r in rows], "id long, in_parent boolean, start boolean")


@query(with_("ranked", "SELECT e.edge_id, TRUE AS forward FROM e"))
def dfs_topological_sort(spark, sf):
    g = graph(spark, sf, "ranked")
    at = {v: i for i, v in enumerate(traversal.dfs_topological_sort(g))}
    return spark.createDataFrame([(r.edge_id, at[r.src] < at[r.dst]) for r in g.edges.collect()], "edge_id long, forward boolean")


@query("SELECT conv_id * 1000 + turn AS id, conv_id * 1000 + turn AS scc FROM conversations c WHERE EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND abs(d.turn - c.turn) = 1)")
def strong_components_talk(spark, sf):
    return traversal.strong_components(graph(spark, sf, "talk"))


_WALK = BOTH + ", h AS (SELECT (SELECT MIN(src) FROM e) AS id, 0 AS depth UNION SELECT u.dst, h.depth + 1 FROM h JOIN u ON h.id = u.src WHERE h.depth < 6)"


@query(with_("part_supp", "SELECT id, CAST(MIN(depth) AS BIGINT) AS depth FROM h GROUP BY id", _WALK))
def bfs_part_supp(spark, sf):
    g = graph(spark, sf, "part_supp", False)
    return traversal.bfs(g, [g.edges.agg(F.min("src")).first()[0]]).select("id", F.col("depth").cast("long").alias("depth"))


@query(with_("partners", "SELECT array_to_string(path, '>') AS path FROM t WHERE id = 24", "t AS (SELECT CAST(0 AS BIGINT) AS id, [CAST(0 AS BIGINT)] AS path UNION ALL SELECT e.dst, list_append(t.path, e.dst) FROM t JOIN e ON t.id = e.src WHERE t.id <> 24 AND len(t.path) <= 6 AND NOT list_contains(t.path, e.dst))"))
def simple_paths(spark, sf):
    return traversal.all_paths(graph(spark, sf, "partners"), 0, 24, 6).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


# paths
def _relaxed(rounds: int = 25, start: str = "CAST(0 AS BIGINT)", arcs: str = "e") -> str:
    parts = [f"r0 AS (SELECT {start} AS id, CAST(0 AS DOUBLE) AS d)"]
    parts += [f"r{k} AS MATERIALIZED (SELECT id, MIN(d) AS d FROM (SELECT id, d FROM r{k - 1} UNION ALL SELECT e.dst, r.d + e.weight FROM r{k - 1} r JOIN {arcs} e ON r.id = e.src) x GROUP BY id)" for k in range(1, rounds + 1)]
    return ", ".join(parts)


@query(with_("partners", "SELECT id, d AS distance FROM r25", _relaxed()))
def dijkstra(spark, sf):
    return paths.dijkstra(graph(spark, sf, "partners"), 0).select("id", "distance")


@query(with_("partners", "SELECT id, d AS distance FROM r25", _relaxed()))
def delta_stepping(spark, sf):
    return paths.delta_stepping(graph(spark, sf, "partners"), 0, 20.0).select("id", "distance")


@query(with_("partners", "SELECT v.id, r25.d AS distance FROM v LEFT JOIN r25 ON v.id = r25.id", _relaxed()))
def bellman_ford(spark, sf):
    return paths.bellman_ford(graph(spark, sf, "partners"), 0).select("id", "distance")


_NEAR = BOTH + ", " + _relaxed(12, "(SELECT MIN(src) FROM e)", "u")


@query(with_("part_supp", "SELECT id, d AS distance FROM r12", _NEAR))
def dijkstra_part_supp(spark, sf):
    g = graph(spark, sf, "part_supp", False)
    return paths.dijkstra(g, g.edges.agg(F.min("src")).first()[0]).select("id", "distance")


@query(with_("part_supp", "SELECT id, d AS distance FROM r12", _NEAR))
def delta_stepping_part_supp(spark, sf):
    g = graph(spark, sf, "part_supp", False)
    return paths.delta_stepping(g, g.edges.agg(F.min("src")).first()[0], 2.0).select("id", "distance")


@query(with_("partners", "SELECT d AS distance, TRUE AS is_path FROM r25 WHERE id = (SELECT MAX(id) FROM r25)", _relaxed()))
def shortest_path(spark, sf):
    """The path's length, and whether its edges are there and add up to it."""
    g = graph(spark, sf, "partners")
    found = paths.dijkstra(g, 0)
    goal, distance = found.orderBy(F.desc("id")).select("id", "distance").first()
    path = paths.reconstruct_path(found, 0, goal)
    return _one(spark, distance=distance, is_path=paths.validate_path(g, path, distance) and (path[0], path[-1]) == (0, goal))


def _squared(rounds: int = 5) -> str:
    parts = ["m0 AS (SELECT src, dst, MIN(d) AS d FROM (SELECT src, dst, weight AS d FROM e UNION ALL SELECT id, id, 0.0::DOUBLE FROM v) x GROUP BY src, dst)"]
    parts += [f"m{k} AS MATERIALIZED (SELECT a.src, b.dst, MIN(a.d + b.d) AS d FROM m{k - 1} a JOIN m{k - 1} b ON a.dst = b.src GROUP BY a.src, b.dst)" for k in range(1, rounds + 1)]
    return ", ".join(parts)


@query(with_("partners", "SELECT src, dst, d AS distance FROM m5", _squared()))
def floyd_warshall(spark, sf):
    return paths.floyd_warshall(graph(spark, sf, "partners"))


@query(with_("partners", "SELECT (SELECT MAX(d) FROM r25) AS distance", _relaxed()))
def farthest_node(spark, sf):
    return _one(spark, distance=paths.farthest(paths.dijkstra(graph(spark, sf, "partners"), 0))["distance"])


@query(with_("partners", "SELECT d AS distance FROM r25 WHERE id = (SELECT MAX(id) FROM r25)", _relaxed()))
def astar(spark, sf):
    g = graph(spark, sf, "partners")
    goal = traversal.bfs(g, [0]).agg(F.max("id")).first()[0]
    least = g.edges.agg(F.min("weight")).first()[0]  # what is left to go is at least one edge
    return _one(spark, distance=paths.astar(g, 0, goal, F.when(F.col("id") == goal, 0.0).otherwise(least))[1])


# centrality
@query(with_("trade", "SELECT v.id, ROUND(COALESCE(o.n, 0) / 24.0::DOUBLE, 6) AS centrality FROM v LEFT JOIN (SELECT src, COUNT(*) AS n FROM e GROUP BY src) o ON v.id = o.src"))
def degree_centrality(spark, sf):
    return centrality.degree_centrality(graph(spark, sf, "trade")).select("id", _r("centrality", "centrality"))


def _ranked(rounds: int, n: str = "(SELECT COUNT(*) FROM v)") -> str:
    parts = ["o AS (SELECT src, COUNT(*) AS k FROM e GROUP BY src)", f"p0 AS (SELECT id, 1.0::DOUBLE / {n} AS rank FROM v)"]
    parts += [f"p{k} AS MATERIALIZED (SELECT v.id, 0.15::DOUBLE / {n} + 0.85::DOUBLE * COALESCE(s.s, 0) AS rank FROM v LEFT JOIN (SELECT e.dst, SUM(p.rank / o.k) AS s FROM e JOIN o ON e.src = o.src JOIN p{k - 1} p ON p.id = e.src GROUP BY e.dst) s ON v.id = s.dst)" for k in range(1, rounds + 1)]
    return ", ".join(parts)


@query(with_("partners", "SELECT id, ROUND(rank, 6) AS rank FROM p10", _ranked(10)))
def pagerank(spark, sf):
    return centrality.pagerank(graph(spark, sf, "partners"), iterations=10).select("id", _r("rank", "rank"))


@query(with_("part_supp", "SELECT id, ROUND(rank * 1000, 6) AS rank FROM p5", _ranked(5)))
def pagerank_part_supp(spark, sf):
    return centrality.pagerank(graph(spark, sf, "part_supp"), iterations=5).select("id", _r(F.col("rank") * 1000, "rank"))


@query(with_("partners", "SELECT id, ROUND(rank, 4) AS rank FROM p60", _ranked(60)))
def pagerank_tolerance(spark, sf):
    return centrality.pagerank(graph(spark, sf, "partners"), iterations=60, tolerance=1e-9).select("id", F.round("rank", 4).alias("rank"))


@query(with_("partners", "SELECT id, ROUND(rank, 6) AS rank FROM p10 ORDER BY p10.rank DESC, id LIMIT 5", _ranked(10)))
def pagerank_top_k(spark, sf):
    return centrality.top_k(centrality.pagerank(graph(spark, sf, "partners"), iterations=10), "rank", 5).select("id", _r("rank", "rank"))


@query(with_("partners", "SELECT v.id, ROUND(COALESCE(c.n / c.s::DOUBLE, 0), 6) AS closeness FROM v LEFT JOIN (SELECT source, COUNT(*) AS n, SUM(depth) AS s FROM d WHERE depth > 0 GROUP BY source) c ON v.id = c.source", HOPS))
def closeness(spark, sf):
    return centrality.closeness_centrality(graph(spark, sf, "partners")).select("id", _r("closeness", "closeness"))


@query(with_("partners", "SELECT v.id, ROUND(COALESCE(c.n / 24.0::DOUBLE * c.n / c.s, 0), 6) AS closeness FROM v LEFT JOIN (SELECT source, COUNT(*) AS n, SUM(depth) AS s FROM d WHERE depth > 0 GROUP BY source) c ON v.id = c.source", HOPS))
def closeness_improved(spark, sf):
    return centrality.closeness_centrality(graph(spark, sf, "partners"), "improved").select("id", _r("closeness", "closeness"))


_SIGMA = (
    "dag AS (SELECT a.source, e.src, e.dst, b.depth FROM e JOIN d a ON a.id = e.src JOIN d b ON b.source = a.source AND b.id = e.dst AND b.depth = a.depth + 1), "
    "w AS (SELECT id AS source, id, 1.0::DOUBLE AS n, 0 AS k FROM v UNION ALL SELECT w.source, g.dst, SUM(w.n), w.k + 1 FROM w JOIN dag g ON g.source = w.source AND g.src = w.id AND g.depth = w.k + 1 GROUP BY w.source, g.dst, w.k), "
    "s AS (SELECT source, id, SUM(n) AS n FROM w GROUP BY source, id)"
)


@query(
    with_(
        "partners",
        "SELECT v.id, ROUND(COALESCE(x.b, 0) / 552.0::DOUBLE, 6) AS betweenness FROM v LEFT JOIN (SELECT a.id, SUM(sa.n * sb.n / st.n) AS b FROM d a JOIN d b ON b.source = a.id JOIN d t ON t.source = a.source AND t.id = b.id AND t.depth = a.depth + b.depth JOIN s sa ON sa.source = a.source AND sa.id = a.id JOIN s sb ON sb.source = a.id AND sb.id = b.id JOIN s st ON st.source = a.source AND st.id = b.id WHERE a.id <> a.source AND b.id <> a.id AND b.id <> a.source GROUP BY a.id) x ON v.id = x.id",
        f"{HOPS}, {_SIGMA}",
    )
)
def betweenness(spark, sf):
    return centrality.betweenness_centrality(graph(spark, sf, "partners")).select("id", _r("betweenness", "betweenness"))


# communities
_WCC = BOTH + ", c AS (SELECT id, id AS k FROM v UNION SELECT u.dst, c.k FROM c JOIN u ON c.id = u.src)"


@query(with_("ranked", "SELECT id, MIN(k) AS component FROM c GROUP BY id", _WCC))
def components(spark, sf):
    return community.connected_components(graph(spark, sf, "ranked"))


@query("SELECT conv_id, COUNT(*) AS n FROM conversations GROUP BY conv_id HAVING COUNT(*) > 1")
def components_talk(spark, sf):
    c = community.connected_components(graph(spark, sf, "talk"))
    return community.component_sizes(c).select(F.expr("component div 1000").alias("conv_id"), F.col("size").alias("n"))


def _voted(rounds: int) -> str:
    parts = ["l0 AS (SELECT id, id AS label FROM v)"]
    for k in range(1, rounds + 1):
        parts.append(f"n{k} AS MATERIALIZED (SELECT e.src, l.label, COUNT(*) AS n FROM e JOIN l{k - 1} l ON l.id = e.dst GROUP BY e.src, l.label)")
        parts.append(f"l{k} AS MATERIALIZED (SELECT p.id, COALESCE((SELECT label FROM n{k} WHERE n{k}.src = p.id ORDER BY n DESC, label LIMIT 1), p.label) AS label FROM l{k - 1} p)")
    return ", ".join(parts)


@query(with_("trade", "SELECT id, label FROM l4", _voted(4)))
def label_propagation(spark, sf):
    return community.label_propagation(graph(spark, sf, "trade"), 4)


_REGION = "w AS (SELECT src, dst, SUM(weight) AS w FROM (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e) x GROUP BY src, dst), g AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_regionkey AS c FROM nation), k AS (SELECT a.c, SUM(w) AS k, SUM(CASE WHEN a.c = b.c THEN w ELSE 0 END) AS i FROM w JOIN g a ON w.src = a.id JOIN g b ON w.dst = b.id GROUP BY a.c)"


@query(with_("trade", "SELECT ROUND(SUM(i / t - (k / t) * (k / t)), 6) AS q FROM k, (SELECT SUM(k) AS t FROM k) s", _REGION))
def modularity(spark, sf):
    c = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").alias("community"))
    return _one(spark, q=round(community.modularity(graph(spark, sf, "trade"), c), 6))


@query(with_("trade", "SELECT CAST((SELECT COUNT(*) FROM v) AS BIGINT) AS nodes, TRUE AS named_by_least, (SELECT SUM(i / t - (k / t) * (k / t)) FROM k, (SELECT SUM(k) AS t FROM k) s) <= 1 AS no_worse_than_regions", _REGION))
def louvain(spark, sf):
    """Vertices that have a community, whether each community has its least member's name, and whether the modularity is no less than that of the regions."""
    g = graph(spark, sf, "trade")
    c = community.louvain(g)
    regions = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").alias("community"))
    wrong = c.groupBy("community").agg(F.min("id").alias("least")).where("least <> community").count()
    return _one(spark, nodes=c.count(), named_by_least=wrong == 0, no_worse_than_regions=community.modularity(g, c) >= community.modularity(g, regions) - 1e-9)


# flow, matching, trees, structure
@query(with_("partners", "SELECT e.edge_id, e.weight FROM e WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.edge_id = e.edge_id AND t.id = e.dst)", "t AS (SELECT edge_id, weight, src AS id FROM e UNION SELECT t.edge_id, t.weight, CASE WHEN f.src = t.id THEN f.dst ELSE f.src END FROM t JOIN e f ON (f.src = t.id OR f.dst = t.id) AND (f.weight < t.weight OR (f.weight = t.weight AND f.edge_id < t.edge_id)))"))
def spanning_forest(spark, sf):
    return flow.minimum_spanning_forest(graph(spark, sf, "partners")).select("edge_id", "weight")


_SIDE = "({c} = 0 OR ({c} BETWEEN 1 AND 3 AND (cut >> CAST({c} - 1 AS INTEGER)) & 1 = 1))"


@query(with_("regions", f"SELECT MIN(c) AS push_relabel, MIN(c) AS dinic, MIN(c) AS edmonds_karp FROM (SELECT cut, SUM(weight) AS c FROM range(8) m(cut), e WHERE {_SIDE.format(c='src')} AND NOT {_SIDE.format(c='dst')} GROUP BY cut) x"))
def max_flow(spark, sf):
    """From region 0 to region 4, against the least of all cuts."""
    g = graph(spark, sf, "regions")
    return _one(spark, push_relabel=flow.max_flow(g, 0, 4), dinic=flow.max_flow(g, 0, 4, "dinic"), edmonds_karp=flow.max_flow(g, 0, 4, "edmonds_karp"))


@query(with_("part_supp", "SELECT LEAST(COUNT(DISTINCT src), COUNT(DISTINCT dst)) AS pairs, LEAST(COUNT(DISTINCT src), COUNT(DISTINCT dst)) AS lefts, LEAST(COUNT(DISTINCT src), COUNT(DISTINCT dst)) AS rights FROM e"))
def bipartite_matching(spark, sf):
    """Edges of the matching, and their different ends: every supplier can be given a part of its own."""
    e = graph(spark, sf, "part_supp").edges.select(F.col("src").alias("l"), F.col("dst").alias("r"))
    m = flow.bipartite_matching(e).join(e.distinct(), ["l", "r"])
    return m.agg(F.count("*").alias("pairs"), F.countDistinct("l").alias("lefts"), F.countDistinct("r").alias("rights"))


_GREEDY = "k AS (SELECT edge_id, src, dst, ROW_NUMBER() OVER (ORDER BY weight DESC, edge_id) AS n FROM e), t AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS edge_id UNION ALL SELECT k.n, CASE WHEN list_contains(used, src) OR list_contains(used, dst) THEN used ELSE list_append(list_append(used, src), dst) END, CASE WHEN list_contains(used, src) OR list_contains(used, dst) THEN NULL ELSE k.edge_id END FROM t JOIN k ON k.n = t.n + 1)"


@query(with_("partners", "SELECT e.edge_id, e.src, e.dst FROM t JOIN e ON e.edge_id = t.edge_id", _GREEDY))
def maximal_matching(spark, sf):
    return flow.maximal_matching(graph(spark, sf, "partners"))


@query(with_("trade", "SELECT LEAST((SELECT COUNT(*) // 2 FROM v), COUNT(DISTINCT src)) AS pairs, 2 * LEAST((SELECT COUNT(*) // 2 FROM v), COUNT(DISTINCT src)) AS ends FROM e"))
def maximum_matching(spark, sf):
    """Nations that sell sell to every other, so all of them are paired, or all nations but one of an odd number."""
    m = flow.maximum_matching(graph(spark, sf, "trade"))
    return m.select(F.explode(F.array("src", "dst")).alias("id")).agg((F.count("*") / 2).cast("long").alias("pairs"), F.countDistinct("id").alias("ends"))


@query(with_("partners", "SELECT CAST((SELECT MAX(depth) FROM d) AS BIGINT) AS diameter, CAST((SELECT MIN(depth) + 1 FROM d JOIN e ON d.source = e.dst AND d.id = e.src) AS BIGINT) AS girth, (SELECT COUNT(*) FROM d WHERE source = 0) = 25 AS connected", HOPS))
def structure_report(spark, sf):
    g = graph(spark, sf, "partners")
    return _one(spark, diameter=structure.diameter(g), girth=structure.girth(g), connected=structure.is_connected(g))


_CLOSED = "c AS (SELECT src AS a, dst AS b FROM e UNION SELECT c.a, e.dst FROM c JOIN e ON c.b = e.src)"


@query(with_("partners", "SELECT NOT EXISTS (SELECT 1 FROM c WHERE a = b) AS is_dag, EXISTS (SELECT 1 FROM c WHERE a = b) AS has_cycle, NOT EXISTS (SELECT 1 FROM w WHERE s = id AND odd = 1) AS is_bipartite, (SELECT COUNT(*) FROM e) = (SELECT COUNT(*) FROM v) - 1 AND (SELECT COUNT(*) FROM d WHERE source = 0) = (SELECT COUNT(*) FROM v) AS is_tree", f"{HOPS}, {_CLOSED}, {BOTH}, w AS (SELECT id AS s, id, 0 AS odd FROM v UNION SELECT w.s, u.dst, 1 - w.odd FROM w JOIN u ON w.id = u.src)"))
def structure_flags(spark, sf):
    g = graph(spark, sf, "partners")
    return _one(spark, is_dag=structure.is_dag(g), has_cycle=structure.has_cycle(g), is_bipartite=structure.is_bipartite(g), is_tree=structure.is_tree(g))


@query(with_("ranked", f"SELECT NOT EXISTS (SELECT 1 FROM c WHERE a = b) AS is_dag, (SELECT MAX(p.src) < MIN(p.dst) FROM ({edges_sql('part_supp')}) p) AS part_supp_is_bipartite", _CLOSED))
def structure_flags_ranked(spark, sf):
    return _one(spark, is_dag=structure.is_dag(graph(spark, sf, "ranked")), part_supp_is_bipartite=structure.is_bipartite(graph(spark, sf, "part_supp")))


# generators
@query(
    "SELECT 'complete' AS kind, a.i AS src, b.i AS dst FROM range(12) a(i) JOIN range(12) b(i) ON a.i < b.i UNION ALL SELECT 'path', i, i + 1 FROM range(9) p(i) UNION ALL SELECT 'tree', (i - 1) // 2, i FROM range(1, 15) t(i) "
    "UNION ALL SELECT 'grid', i, i + 1 FROM range(12) g(i) WHERE i % 4 < 3 UNION ALL SELECT 'grid', i, i + 4 FROM range(12) g(i) WHERE i < 8 UNION ALL SELECT 'ring', i, (i + j) % 10 FROM range(10) r(i), range(1, 3) k(j) UNION ALL SELECT 'ba', i, j FROM range(3, 8) b(i), range(3) c(j) UNION ALL SELECT 'ba', a.i, b.i FROM range(3) a(i) JOIN range(3) b(i) ON a.i < b.i"
)
def generated_graphs(spark, sf):
    kinds = {"complete": generators.complete_graph(spark, 12), "path": generators.path(spark, 10), "tree": generators.binary_tree(spark, 4), "grid": generators.grid(spark, 3, 4), "ring": generators.watts_strogatz(spark, 10, 4, 0.0), "ba": generators.barabasi_albert(spark, 8, 3)}
    out = None
    for k, g in kinds.items():
        e = g.edges.select(F.lit(k).alias("kind"), "src", "dst")
        out = e if out is None else out.union(e)
    return out


@query("SELECT kind, TRUE AS simple, TRUE AS as_many FROM (VALUES ('erdos_renyi'), ('erdos_renyi_directed'), ('watts_strogatz'), ('barabasi_albert')) x(kind)")
def random_graphs(spark, sf):
    """Whether each has no loop and no repeated edge, and as many edges as it must have, or within five deviations of what is expected."""
    n, p = 2000, 0.01
    pairs = n * (n - 1) / 2
    far = lambda m, count, q: abs(count - m * q) <= 5 * (m * q * (1 - q)) ** 0.5
    kinds = {
        "erdos_renyi": (generators.erdos_renyi(spark, n, p), lambda e: far(pairs, e, p)),
        "erdos_renyi_directed": (generators.erdos_renyi(spark, n, p, True), lambda e: far(2 * pairs, e, p)),
        "watts_strogatz": (generators.watts_strogatz(spark, n, 6, 0.2), lambda e: far(n * 3, e - n * 3, 0.2)),
        "barabasi_albert": (generators.barabasi_albert(spark, n, 3, True), lambda e: 0.95 * 3 * (n - 3) <= e <= 3 + 3 * (n - 3)),
    }
    rows = []
    for kind, (g, ok) in kinds.items():
        e = g.edges.agg(F.count("*").alias("n"), F.countDistinct("src", "dst").alias("different"), F.count_if(F.col("src") == F.col("dst")).alias("loops")).first()
        rows.append((kind, e.loops == 0 and (kind == "watts_strogatz" or e.n == e.different), bool(ok(e.n))))
    return spark.createDataFrame(rows, "kind string, simple boolean, as_many boolean")


# partitions
@query(with_("trade", "SELECT p.pid, p.nodes, p.boundary, COALESCE(q.edges, 0) AS edges FROM (SELECT id // 7 AS pid, COUNT(*) AS nodes, COUNT(*) FILTER (EXISTS (SELECT 1 FROM e WHERE e.src = v.id AND e.dst // 7 <> v.id // 7)) AS boundary FROM v GROUP BY 1) p LEFT JOIN (SELECT src // 7 AS pid, COUNT(*) AS edges FROM e GROUP BY 1) q USING (pid)"))
def partition_stats(spark, sf):
    return partition.partition_stats(graph(spark, sf, "trade"), partition.range_partition(7, 4)).select(F.col("pid").cast("long").alias("pid"), "nodes", "boundary", "edges")


@query(with_("part_supp", "SELECT COUNT(*) AS inner_edges FROM e WHERE src % 8 = dst % 8"))
def partition_inner_edges(spark, sf):
    return partition.inner_edges(graph(spark, sf, "part_supp"), partition.range_partition(None, 8)).agg(F.count("*").alias("inner_edges"))


# matrices
@query(with_("trade", "SELECT src AS i, ROUND(SUM(weight * (dst + 1)), 6) AS v FROM e GROUP BY src"))
def spmv(spark, sf):
    g = graph(spark, sf, "trade")
    return matrix.matvec(matrix.adjacency(g), g.vertices.select(F.col("id").alias("j"), (F.col("id") + 1.0).alias("x"))).select("i", _r("v", "v"))


@query(with_("trade", "SELECT a.src AS i, b.dst AS j, ROUND(SUM(a.weight * b.weight), 6) AS v FROM e a JOIN e b ON a.dst = b.src GROUP BY a.src, b.dst"))
def spmm(spark, sf):
    a = matrix.adjacency(graph(spark, sf, "trade"))
    return matrix.matmul(a, a).select("i", "j", _r("v", "v"))


@query(with_("part_supp", "SELECT a.dst AS i, b.dst AS j, ROUND(SUM(a.weight * b.weight), 6) AS v FROM e a JOIN e b ON a.src = b.src GROUP BY a.dst, b.dst"))
def cosupply(spark, sf):
    a = matrix.adjacency(graph(spark, sf, "part_supp"))
    return matrix.matmul(matrix.transpose(a), a).select("i", "j", _r("v", "v"))


@query(with_("partners", "SELECT i, j, ROUND(SUM(v), 6) AS v FROM (SELECT src AS i, dst AS j, -weight AS v FROM u UNION ALL SELECT src, src, weight FROM u) x GROUP BY i, j", BOTH))
def laplacian(spark, sf):
    return matrix.laplacian(graph(spark, sf, "partners")).select("i", "j", _r("v", "v"))


@query(with_("trade", "SELECT src AS i, CAST(SUM(COUNT(*)) OVER (ORDER BY src) - COUNT(*) AS BIGINT) AS offset, COUNT(*) AS n FROM e GROUP BY src"))
def csr(spark, sf):
    return matrix.to_csr(matrix.adjacency(graph(spark, sf, "trade"))).select("i", "offset", F.size("cols").cast("long").alias("n"))


@query(with_("partners", "SELECT i, j, ROUND(v / SQRT(a.d) / SQRT(b.d), 6) AS v FROM l JOIN (SELECT i AS k, SUM(v) AS d FROM l GROUP BY i) a ON a.k = l.i JOIN (SELECT i AS k, SUM(v) AS d FROM l GROUP BY i) b ON b.k = l.j", "l AS (SELECT src AS i, dst AS j, weight AS v FROM e UNION ALL SELECT id, id, 1.0::DOUBLE FROM v)"))
def normalized_adjacency(spark, sf):
    g = graph(spark, sf, "partners")
    return matrix.symmetric_normalized(matrix.self_loops(matrix.adjacency(g), g.vertices)).select("i", "j", _r("v", "v"))


_EMB = "m AS (SELECT vec_id AS i, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


def _embeddings(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), "label")


def _long(spark, sf) -> DataFrame:
    return _embeddings(spark, sf).select(F.col("vec_id").alias("i"), F.posexplode("x").alias("j", "v")).withColumn("j", F.col("j").cast("long"))


@query(f"WITH {_EMB} SELECT a.j AS i, b.j, ROUND(SUM(a.v * b.v), 4) AS v FROM m a JOIN m b ON a.i = b.i GROUP BY a.j, b.j")
def gram(spark, sf):
    m = _long(spark, sf)
    return matrix.matmul(matrix.transpose(m), m).select("i", "j", F.round("v", 4).alias("v"))


@query(f"WITH {_EMB} SELECT j, ROUND(SUM(v), 5) AS total, ROUND(AVG(v), 6) AS mean, ROUND(VAR_POP(v), 6) AS var, ROUND(MAX(v), 6) AS high, ROUND(MIN(v), 6) AS low FROM m GROUP BY j")
def column_statistics(spark, sf):
    return _long(spark, sf).groupBy("j").agg(F.round(F.sum("v"), 5).alias("total"), _r(F.avg("v"), "mean"), _r(F.var_pop("v"), "var"), _r(F.max("v"), "high"), _r(F.min("v"), "low"))


@query(f"WITH {_EMB} SELECT (i * 64 + j) // 16 AS i, (i * 64 + j) % 16 AS j, ROUND(v, 6) AS v FROM m")
def reshape(spark, sf):
    return matrix.reshape(_long(spark, sf), 64, 16).select("i", "j", _r("v", "v"))


@query(f"WITH {_EMB} SELECT i, j - 8 AS j, ROUND(v, 6) AS v FROM m WHERE j >= 8 AND j < 24")
def slice_columns(spark, sf):
    return matrix.slice_(_long(spark, sf), (0, 1 << 62), (8, 24)).select("i", "j", _r("v", "v"))


@query(f"WITH {_EMB}, t AS (SELECT i, j, EXP(v - MAX(v) OVER (PARTITION BY i)) AS e FROM m) SELECT i, j, ROUND(e / SUM(e) OVER (PARTITION BY i), 6) AS v FROM t")
def softmax(spark, sf):
    return matrix.softmax_rows(_long(spark, sf)).select("i", "j", _r("v", "v"))


@query(f"WITH {_EMB} SELECT i, j, ROUND(v / SQRT(SUM(v * v) OVER (PARTITION BY i)), 6) AS unit, ROUND((v - AVG(v) OVER (PARTITION BY i)) / SQRT(VAR_POP(v) OVER (PARTITION BY i) + 0.00001), 6) AS layer, ROUND(v / SQRT(AVG(v * v) OVER (PARTITION BY i) + 0.000001), 6) AS rms FROM m")
def norms(spark, sf):
    e = _embeddings(spark, sf).select("vec_id", F.explode(F.arrays_zip(arrays.normalize("x").alias("unit"), arrays.layer_norm("x").alias("layer"), arrays.rms_norm("x").alias("rms"), F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long")).alias("j"))).alias("z"))
    return e.select(F.col("vec_id").alias("i"), "z.j", _r("z.unit", "unit"), _r("z.layer", "layer"), _r("z.rms", "rms"))


@query(
    "WITH t AS (SELECT p_partkey, (p_retailprice - 1200) / 300.0::DOUBLE AS x FROM part) SELECT p_partkey, ROUND(GREATEST(x, 0), 6) AS relu, ROUND(CASE WHEN x > 0 THEN x ELSE x * 0.01::DOUBLE END, 6) AS leaky, ROUND(1 / (1 + EXP(-x)), 6) AS sigmoid, ROUND(TANH(x), 6) AS tanh, ROUND(x / (1 + EXP(-x)), 6) AS silu, ROUND(0.5::DOUBLE * x * (1 + TANH(SQRT(2 / PI()) * (x + 0.044715::DOUBLE * x * x * x))), 6) AS gelu FROM t"
)
def activations(spark, sf):
    t = table(spark, sf, "part").withColumn("x", (F.col("p_retailprice") - 1200) / 300.0)
    return t.select("p_partkey", *[_r(f("x"), n) for n, f in (("relu", arrays.relu), ("leaky", arrays.leaky_relu), ("sigmoid", arrays.sigmoid), ("tanh", arrays.tanh), ("silu", arrays.silu), ("gelu", arrays.gelu))])


@query(f"WITH {_EMB}, p AS (SELECT a.i, a.j, a.v AS x, b.v AS y, POW(10000.0::DOUBLE, -2.0::DOUBLE * a.j / 64) * a.i AS t FROM m a JOIN m b ON a.i = b.i AND b.j = a.j + 32 WHERE a.j < 32) SELECT i, j, ROUND(x * COS(t) - y * SIN(t), 5) AS v FROM p UNION ALL SELECT i, j + 32, ROUND(y * COS(t) + x * SIN(t), 5) FROM p")
def rotary(spark, sf):
    return _embeddings(spark, sf).select(F.col("vec_id").alias("i"), F.posexplode(arrays.rope("x", F.col("vec_id").cast("double"))).alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), F.round("v", 5).alias("v"))


# graph neural layers
_FEAT = "f AS (SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS DOUBLE) AS x0, CAST(n_nationkey AS DOUBLE) / 10 AS x1 FROM nation)"


def _features(spark, sf) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.array(F.col("n_regionkey").cast("double"), F.col("n_nationkey").cast("double") / 10).alias("x"))


def _xy(df: DataFrame) -> DataFrame:
    return df.select("id", _r(F.col("x")[0], "x0"), _r(F.col("x")[1], "x1"))


@query(with_("partners", "SELECT f.id, ROUND(COALESCE(s.a, f.x0), 6) AS x0, ROUND(COALESCE(s.b, f.x1), 6) AS x1 FROM f LEFT JOIN (SELECT e.dst, AVG(f.x0) AS a, AVG(f.x1) AS b FROM e JOIN f ON e.src = f.id GROUP BY e.dst) s ON s.dst = f.id", _FEAT))
def message_passing(spark, sf):
    return _xy(gnn.message_passing(graph(spark, sf, "partners"), _features(spark, sf), "mean"))


@query(with_("partners", "SELECT e.dst AS id, ROUND(MAX(f.x0), 6) AS x0, ROUND(MAX(f.x1), 6) AS x1 FROM e JOIN f ON e.src = f.id GROUP BY e.dst", _FEAT))
def aggregate_max(spark, sf):
    return _xy(gnn.aggregate(graph(spark, sf, "partners"), _features(spark, sf), "max"))


@query(with_("partners", "SELECT l.j AS id, ROUND(SUM(v / SQRT(a.d) / SQRT(b.d) * f.x0), 6) AS x0, ROUND(SUM(v / SQRT(a.d) / SQRT(b.d) * f.x1), 6) AS x1 FROM l JOIN (SELECT i AS k, SUM(v) AS d FROM l GROUP BY i) a ON a.k = l.i JOIN (SELECT i AS k, SUM(v) AS d FROM l GROUP BY i) b ON b.k = l.j JOIN f ON f.id = l.i GROUP BY l.j", "l AS (SELECT src AS i, dst AS j, weight AS v FROM e UNION ALL SELECT id, id, 1.0::DOUBLE FROM v), " + _FEAT))
def gcn(spark, sf):
    return _xy(gnn.gcn(graph(spark, sf, "partners"), _features(spark, sf)))


@query(with_("partners", "SELECT dst AS id, ROUND(SUM(p * x0) / SUM(p), 6) AS x0, ROUND(SUM(p * x1) / SUM(p), 6) AS x1 FROM (SELECT e.dst, s.x0, s.x1, EXP(CASE WHEN z > 0 THEN z ELSE z * 0.2::DOUBLE END) AS p FROM (SELECT e.*, 0.3::DOUBLE * s.x0 + 0.1::DOUBLE * s.x1 + 0.2::DOUBLE * t.x0 - 0.4::DOUBLE * t.x1 AS z FROM e JOIN f s ON s.id = e.src JOIN f t ON t.id = e.dst) e JOIN f s ON s.id = e.src) q GROUP BY dst", _FEAT))
def gat(spark, sf):
    return _xy(gnn.gat(graph(spark, sf, "partners"), _features(spark, sf), [0.3, 0.1], [0.2, -0.4]))


@query(with_("partners", "SELECT f.id, ROUND(f.x0, 6) AS x0, ROUND(f.x1, 6) AS x1, ROUND(COALESCE(a, 0), 6) AS x2, ROUND(COALESCE(b, 0), 6) AS x3 FROM f LEFT JOIN (SELECT src, AVG(x0) AS a, AVG(x1) AS b FROM (SELECT e.src, e.dst, ROW_NUMBER() OVER (PARTITION BY src ORDER BY edge_id) AS n FROM e) k JOIN f ON f.id = k.dst WHERE n <= 2 GROUP BY src) s ON s.src = f.id", _FEAT))
def graph_sage(spark, sf):
    return gnn.sage(graph(spark, sf, "partners"), _features(spark, sf), 2).select("id", *[_r(F.col("x")[k], f"x{k}") for k in range(4)])


# quantisation, decomposition, model tables
@query("SELECT vec_id, ROUND(s, 8) AS scale, CAST(list_sum(list_transform(embedding, lambda x: CAST(GREATEST(-127, LEAST(127, ROUND(CAST(x AS DOUBLE) / s))) AS INTEGER))) AS BIGINT) AS total FROM (SELECT *, list_max(list_transform(embedding, lambda x: ABS(CAST(x AS DOUBLE)))) / 127.0::DOUBLE AS s FROM embeddings) t")
def quantize(spark, sf):
    q = _embeddings(spark, sf).select("vec_id", transformer.quantize_int8("x").alias("z"))
    return q.select("vec_id", F.round("z.scale", 8).alias("scale"), F.aggregate("z.q", F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))


@query("SELECT vec_id, ROUND(list_sum(list_transform(embedding, lambda x: CAST(GREATEST(-127, LEAST(127, ROUND(CAST(x AS DOUBLE) / s))) AS INTEGER) * s)), 4) + 0 AS total, TRUE AS within_half_step FROM (SELECT *, list_max(list_transform(embedding, lambda x: ABS(CAST(x AS DOUBLE)))) / 127.0::DOUBLE AS s FROM embeddings) t")
def dequantize(spark, sf):
    q = _embeddings(spark, sf).withColumn("z", transformer.quantize_int8("x")).withColumn("y", transformer.quantize_int4("x"))
    worst = lambda d, s: F.array_max(F.transform(F.zip_with("x", d, lambda a, b: a - b), lambda e: F.abs(e))) <= s * 0.5 + 1e-9
    near = worst(transformer.dequantize(F.col("z")), F.col("z.scale")) & worst(transformer.dequantize(F.col("y"), True), F.col("y.scale"))
    return q.select("vec_id", (F.round(arrays.total(transformer.dequantize(F.col("z"))), 4) + 0.0).alias("total"), near.alias("within_half_step"))


@query("SELECT l_returnflag || l_linestatus AS layer, COUNT(*) AS n, ROUND(AVG(l_discount), 6) AS mean, ROUND(STDDEV_POP(l_discount), 6) AS std, MIN(l_discount) AS min, MAX(l_discount) AS max FROM lineitem GROUP BY 1")
def error_report(spark, sf):
    e = table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("layer"), F.col("l_discount").alias("error"))
    return decompose.error_report(e).select("layer", "n", _r("mean", "mean"), _r("std", "std"), "min", "max")


@query("SELECT CAST(vec_id AS VARCHAR) AS name, CASE WHEN vec_id % 10 = 3 THEN NULL ELSE ROUND(SQRT(list_sum(list_transform(embedding, lambda x: POW(CAST(x AS DOUBLE) * 0.5::DOUBLE, 2)))), 6) END AS l2 FROM embeddings")
def weight_difference(spark, sf):
    t = _embeddings(spark, sf).select(F.col("vec_id").cast("string").alias("name"), F.array(F.lit(8), F.lit(8)).alias("shape"), F.col("x").alias("data"), "vec_id")
    other = t.where("vec_id % 10 <> 3").withColumn("data", arrays.scale("data", 0.5))
    return decompose.weight_difference(t, other).select("name", _r("l2", "l2"))


@query("SELECT CAST(vec_id AS VARCHAR) AS name, ROUND(CAST(embedding[5] AS DOUBLE) / SQRT(list_sum(list_transform(range(16), lambda k: POW(CAST(embedding[4 * k + 1] AS DOUBLE), 2)))), 6) AS first, TRUE AS orthogonal FROM embeddings")
def orthogonalize(spark, sf):
    """The second entry of Q's first column, which is the matrix's own first column made a unit."""
    t = _embeddings(spark, sf).select(F.col("vec_id").cast("string").alias("name"), F.array(F.lit(16), F.lit(4)).alias("shape"), F.col("x").alias("data"))
    return decompose.orthogonalize(t).select("name", _r(F.col("q")[4], "first"), (F.col("error") < 1e-9).alias("orthogonal"))


@query("SELECT COUNT(*) AS n, CAST(SUM(64) AS BIGINT) AS original, CAST(SUM(2 * 16) AS BIGINT) AS compressed FROM embeddings")
def tensor_ring_compress(spark, sf):
    t = _embeddings(spark, sf).select(F.col("vec_id").cast("string").alias("name"), F.array(F.lit(8), F.lit(8)).alias("shape"), F.col("x").alias("data"))
    return decompose.compress(t, 2).agg(F.count("*").alias("n"), F.sum("original").alias("original"), F.sum("compressed").alias("compressed"))


# attention and generation
_SEQ = "s AS (SELECT label AS b, ROW_NUMBER() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, embedding::DOUBLE[64] AS x FROM embeddings)"


@query(
    f"WITH {_SEQ}, p AS (SELECT a.b, a.pos, c.x, EXP(list_sum(list_transform(range(1, 65), lambda k: a.x[k] * c.x[k])) / 8.0::DOUBLE - list_sum(list_transform(range(1, 65), lambda k: a.x[k] * a.x[k])) / 8.0::DOUBLE) AS e FROM s a JOIN s c ON a.b = c.b AND c.pos BETWEEN a.pos - 3 AND a.pos) SELECT CAST(b AS BIGINT) AS b, pos, ROUND(SUM(e * x[1]) / SUM(e), 5) AS first, ROUND(SUM(e * x[64]) / SUM(e), 5) AS last FROM p GROUP BY b, pos"
)
def sliding_attention(spark, sf):
    from pyspark.sql import Window

    s = _embeddings(spark, sf).select(F.col("label").cast("long").alias("b"), F.lit(0).cast("long").alias("h"), (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long").alias("pos"), "x")
    out = transformer.sliding_window_attention(s, s, s, 3)
    return out.select("b", F.col("pos"), F.round(F.col("x")[0], 5).alias("first"), F.round(F.col("x")[63], 5).alias("last"))


@query(
    "SELECT 'sliding' AS kind, a.i, b.i AS j FROM range(20) a(i) JOIN range(20) b(i) ON b.i BETWEEN a.i - 3 AND a.i UNION ALL SELECT 'two_sided', a.i, b.i FROM range(20) a(i) JOIN range(20) b(i) ON b.i >= a.i - 4 AND b.i < a.i + 4 "
    "UNION ALL SELECT 'block', a.i, b.i FROM range(20) a(i) JOIN range(20) b(i) ON b.i // 4 BETWEEN a.i // 4 - 1 AND a.i // 4 UNION ALL SELECT 'star', a.i, b.i FROM range(20) a(i) JOIN range(20) b(i) ON a.i < 3 OR b.i < 3 OR (b.i >= a.i - 2 AND b.i < a.i + 2)"
)
def attention_masks(spark, sf):
    kinds = {"sliding": transformer.sliding_window_mask(spark, 20, 4), "two_sided": transformer.sliding_window_mask(spark, 20, 4, False), "block": transformer.block_sparse_mask(spark, 20, 4, 2), "star": transformer.star_mask(spark, 20, 0.12, 2)}
    out = None
    for k, m in kinds.items():
        m = m.select(F.lit(k).alias("kind"), "i", "j")
        out = m if out is None else out.union(m)
    return out


_PROB = "c AS (SELECT user_id AS seq, event_type AS token, COUNT(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT seq, token, n / SUM(n) OVER (PARTITION BY seq)::DOUBLE AS p FROM c)"


def _token_probs(spark, sf) -> DataFrame:
    from pyspark.sql import Window

    c = table(spark, sf, "events").groupBy(F.col("user_id").alias("seq"), F.col("event_type").alias("token")).agg(F.count("*").alias("n"))
    return c.select("seq", "token", (F.col("n") / F.sum("n").over(Window.partitionBy("seq"))).alias("p"))


@query(f"WITH {_PROB}, k AS (SELECT *, RANK() OVER (PARTITION BY seq ORDER BY p DESC) AS r FROM p) SELECT seq, token, ROUND(p / SUM(p) OVER (PARTITION BY seq), 6) AS p FROM k WHERE r <= 2")
def top_k_filter(spark, sf):
    return transformer.top_k(_token_probs(spark, sf), 2).select("seq", "token", _r("p", "p"))


@query(f"WITH {_PROB}, k AS (SELECT *, ROUND(COALESCE(SUM(p) OVER (PARTITION BY seq ORDER BY p DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 9) AS c FROM p) SELECT seq, token, ROUND(p / SUM(p) OVER (PARTITION BY seq), 6) AS p FROM k WHERE c < 0.7001::DOUBLE")
def top_p_filter(spark, sf):
    return transformer.top_p(_token_probs(spark, sf), 0.7001).select("seq", "token", _r("p", "p"))


@query(f"WITH {_PROB} SELECT seq, MAX(token) AS token FROM p WHERE (seq, p) IN (SELECT seq, MAX(p) FROM p GROUP BY seq) GROUP BY seq")
def greedy_tokens(spark, sf):
    return transformer.greedy(_token_probs(spark, sf).select("seq", "token", F.col("p").alias("logit")))


@query("SELECT conv_id AS seq, n AS length, m - n AS padding FROM (SELECT conv_id, COUNT(*) AS n FROM conversations GROUP BY conv_id) a, (SELECT MAX(n) AS m FROM (SELECT COUNT(*) AS n FROM conversations GROUP BY conv_id) b) c")
def pad_sequences(spark, sf):
    s = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("seq")).agg(F.sort_array(F.collect_list("turn")).alias("tokens"))
    p = transformer.pad(s, -1)
    return p.select("seq", F.col("length").cast("long").alias("length"), F.size(F.filter("tokens", lambda x: x == -1)).cast("long").alias("padding"))


_STATE = "t AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS value, (p_retailprice - 1000) / 1000 AS g, p_retailprice / 5000 AS m, p_size / 100.0::DOUBLE AS v FROM part), a AS (SELECT *, 0.9::DOUBLE * m + 0.1::DOUBLE * g AS m2, 0.999::DOUBLE * v + 0.001::DOUBLE * g * g AS v2 FROM t), b AS (SELECT *, 0.1::DOUBLE * (m2 / (1 - POW(0.9::DOUBLE, 3))) / (SQRT(v2 / (1 - POW(0.999::DOUBLE, 3))) + 0.00000001::DOUBLE) AS step FROM a)"


@query(f"WITH {_STATE} SELECT p_partkey, ROUND(value - 0.1::DOUBLE * (0.9::DOUBLE * m + g + 0.01::DOUBLE * value), 5) AS sgd, ROUND(value - step, 5) AS adam, ROUND(value - step - 0.001::DOUBLE * value, 5) AS adamw, ROUND(m2, 6) AS m, ROUND(v2, 6) AS v FROM b")
def optimizers(spark, sf):
    """The third step, from moments that are not zero; one row of parameters gives all three."""
    price, size = F.col("p_retailprice"), F.col("p_size").cast("double")
    t = table(spark, sf, "part").select("p_partkey", size.alias("value"), ((price - 1000) / 1000).alias("grad"), (price / 5000).alias("m"), (size / 100).alias("v"), (price / 5000).alias("velocity"))
    kept = t.withColumns({"value0": F.col("value"), "m0": F.col("m"), "v0": F.col("v")})
    a = transformer.sgd(kept, 0.1, 0.9, 0.01).withColumn("sgd", F.col("value")).withColumn("value", F.col("value0"))
    b = transformer.adam(a, 3, 0.1).withColumns({"adam": F.col("value"), "m1": F.col("m"), "v1": F.col("v")}).withColumns({"value": F.col("value0"), "m": F.col("m0"), "v": F.col("v0")})
    c = transformer.adam(b, 3, 0.1, decay=0.01, decoupled=True)
    return c.select("p_partkey", F.round("sgd", 5).alias("sgd"), F.round("adam", 5).alias("adam"), F.round("value", 5).alias("adamw"), _r("m1", "m"), _r("v1", "v"))


# learnable edges
_LEARN = "l AS (SELECT src, dst, LN(p / (1 - p)) AS logit, p, weight FROM (SELECT *, 0.05::DOUBLE + 0.9::DOUBLE * ((src * 7 + dst) % 10) / 10 AS p FROM e) x)"


def _learnable(spark, sf) -> DataFrame:
    return differentiable.learnable(graph(spark, sf, "partners").edges, 0.05 + 0.9 * ((F.col("src") * 7 + F.col("dst")) % 10) / 10)


@query(with_("partners", "SELECT src, dst, ROUND(g * p * (1 - p) + 0.1::DOUBLE * SIGN(logit) + 0.01::DOUBLE * (2 * (COUNT(*) OVER (PARTITION BY src) * p - SUM(p) OVER (PARTITION BY src)) + 2 * (COUNT(*) OVER (PARTITION BY dst) * p - SUM(p) OVER (PARTITION BY dst))), 6) AS grad FROM (SELECT *, weight / 100 AS g FROM l) y", _LEARN))
def structure_gradients(spark, sf):
    e = _learnable(spark, sf)
    return differentiable.structure_gradients(e, e.select("src", "dst", (F.col("weight") / 100).alias("g")), sparsity=0.1, smoothness=0.01).select("src", "dst", _r("grad", "grad"))


@query(with_("partners", "SELECT src, dst, CASE WHEN g > 0.1 AND p < 0.5 THEN 'add' WHEN g < -0.1 AND p > 0.5 THEN 'remove' ELSE 'modify' END AS action, ROUND(GREATEST(0.01::DOUBLE, LEAST(0.99::DOUBLE, p + 0.1::DOUBLE * g)), 6) AS prob FROM (SELECT *, (src - dst) / 10.0::DOUBLE AS g FROM l) y", _LEARN))
def structure_edits(spark, sf):
    return differentiable.edit_policy(_learnable(spark, sf).withColumn("grad", (F.col("src") - F.col("dst")) / 10.0)).select("src", "dst", "action", _r("prob", "prob"))


@query(with_("partners", "SELECT src, dst FROM l WHERE p > 0.5 OR p >= 0.3", _LEARN))
def prune_weak_edges(spark, sf):
    return differentiable.prune_weak(_learnable(spark, sf), 0.3).select("src", "dst")


@query(with_("partners", "SELECT src AS grp, COUNT(*) AS items, CAST(1 AS DOUBLE) AS chosen, CAST(1 AS DOUBLE) AS shares FROM l GROUP BY src", _LEARN))
def gumbel_sample(spark, sf):
    """For each group its items, how many are chosen when hard, and the sum of the soft shares."""
    options = _learnable(spark, sf).select(F.col("src").alias("grp"), F.col("dst").alias("item"), "logit")
    hard, soft = (differentiable.gumbel_softmax(options, 0.5, hard=h) for h in (True, False))
    both = hard.join(soft.withColumnRenamed("y", "z"), ["grp", "item"])
    return both.groupBy("grp").agg(F.count("*").alias("items"), F.sum("y").alias("chosen"), F.round(F.sum("z"), 6).alias("shares"))


# operator graphs
@query(with_("ranked", "SELECT 'IsolatedNode' AS kind, id FROM v WHERE id NOT IN (SELECT src FROM e) UNION ALL SELECT 'DisconnectedComponent', k FROM (SELECT DISTINCT MIN(k) AS k FROM c GROUP BY id) x WHERE k <> 0", _WCC))
def topology_defects(spark, sf):
    return model.defects(graph(spark, sf, "ranked")).select("kind", "id")


@query("SELECT kind, COUNT(*) AS n FROM (SELECT CASE WHEN i // 6 = 0 THEN 'Token' WHEN (i // 6) % 2 = 1 THEN 'Hidden' ELSE 'FFN' END AS kind FROM range(42) r(i) UNION ALL SELECT 'SelfAttention' FROM range(3) l(i), range(6) a(p), range(6) b(q) WHERE q <= p UNION ALL SELECT 'Residual' FROM range(18) z(i) UNION ALL SELECT 'DataFlow' FROM range(18) y(i)) x GROUP BY kind")
def token_graph(spark, sf):
    g = transformer.token_graph(spark, 6, 3)
    return g.vertices.select("kind").union(g.edges.select("kind")).groupBy("kind").agg(F.count("*").alias("n"))


# graphs from logs and pages
@query(with_("clicks", "SELECT src, dst, weight FROM e"))
def click_transitions(spark, sf):
    return graph(spark, sf, "clicks").edges.select("src", "dst", "weight")


@query("SELECT page_id, COUNT(*) AS links, COUNT(DISTINCT t) AS targets FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS t FROM pages) x GROUP BY page_id")
def page_links(spark, sf):
    t = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("t"))
    return t.groupBy("page_id").agg(F.count("*").alias("links"), F.countDistinct("t").alias("targets"))


@query("SELECT conv_id, MAX(turn) AS depth FROM (SELECT conv_id, turn, MIN(turn) OVER (PARTITION BY conv_id) AS f, COUNT(*) OVER (PARTITION BY conv_id) AS n FROM conversations) x WHERE n > 1 GROUP BY conv_id HAVING MIN(f) = 0")
def talk_depth(spark, sf):
    g = graph(spark, sf, "talk")
    return traversal.topological_levels(g).groupBy(F.expr("id div 1000").alias("conv_id")).agg(F.max("level").cast("long").alias("depth"))


from . import catalog_more  # noqa: E402, F401  (registers its queries)

__all__ = ["queries", "oracle_sql", "Graph"]
