"""Graphs over relational tables.  Each is one SQL text that both engines run; {table} stands for a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..graph import Graph
from ..iterate import cut

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_TRADE = (
    "SELECT CAST(s_nationkey AS BIGINT) * 100 + CAST(c_nationkey AS BIGINT) AS edge_id, CAST(s_nationkey AS BIGINT) AS src, CAST(c_nationkey AS BIGINT) AS dst, CAST(COUNT(*) AS DOUBLE) AS weight "
    "FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey GROUP BY s_nationkey, c_nationkey"
)
#: Each nation's three closest buyers: those with the greatest share of what they buy from it.
_PARTNERS = f"SELECT edge_id, src, dst, weight FROM (SELECT t.*, ROW_NUMBER() OVER (PARTITION BY src ORDER BY weight / bought DESC, dst) AS nth FROM ({_TRADE}) t JOIN (SELECT dst AS buyer, SUM(weight) AS bought FROM ({_TRADE}) u GROUP BY dst) b ON buyer = dst) q WHERE nth <= 3"
EDGES = {
    "trade": _TRADE,
    "partners": _PARTNERS,
    "ranked": f"SELECT MIN(edge_id) AS edge_id, LEAST(src, dst) AS src, GREATEST(src, dst) AS dst, SUM(weight) AS weight FROM ({_PARTNERS}) p GROUP BY LEAST(src, dst), GREATEST(src, dst)",
    "regions": f"SELECT CAST(a.n_regionkey AS BIGINT) * 10 + CAST(b.n_regionkey AS BIGINT) AS edge_id, CAST(a.n_regionkey AS BIGINT) AS src, CAST(b.n_regionkey AS BIGINT) AS dst, SUM(weight) AS weight FROM ({_TRADE}) t JOIN {{nation}} a ON a.n_nationkey = src JOIN {{nation}} b ON b.n_nationkey = dst WHERE a.n_regionkey <> b.n_regionkey GROUP BY a.n_regionkey, b.n_regionkey",
    "part_supp": "SELECT l_suppkey * 10000000 + l_partkey AS edge_id, l_partkey AS src, 100000000 + l_suppkey AS dst, CAST(COUNT(*) AS DOUBLE) AS weight FROM {lineitem} GROUP BY l_suppkey, l_partkey",
    "clicks": (
        "SELECT CAST(ROW_NUMBER() OVER (PARTITION BY a ORDER BY b) AS BIGINT) + a * 100 AS edge_id, a AS src, b AS dst, weight FROM (SELECT a, b, CAST(COUNT(*) AS DOUBLE) AS weight FROM "
        "(SELECT CAST(ASCII(event_type) AS BIGINT) AS a, CAST(LEAD(ASCII(event_type)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS b FROM {events}) s WHERE b IS NOT NULL GROUP BY a, b) t"
    ),
    "talk": "SELECT a.conv_id * 1000 + a.turn AS edge_id, a.conv_id * 1000 + a.turn AS src, b.conv_id * 1000 + b.turn AS dst, CAST(1 AS DOUBLE) AS weight FROM {conversations} a JOIN {conversations} b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1",
    "geo": "SELECT c_custkey AS edge_id, 1000 + CAST(c_nationkey AS BIGINT) AS src, 100000 + c_custkey AS dst, CAST(1 AS DOUBLE) AS weight FROM {customer} UNION ALL SELECT -1 - CAST(n_nationkey AS BIGINT), CAST(n_regionkey AS BIGINT), 1000 + CAST(n_nationkey AS BIGINT), CAST(1 AS DOUBLE) FROM {nation}",
}
_ENDS = "SELECT src AS id FROM ({e}) x UNION SELECT dst FROM ({e}) y"
VERTICES = {k: "SELECT CAST(n_nationkey AS BIGINT) AS id FROM {nation}" for k in ("trade", "partners", "ranked")}


def edges_sql(name: str) -> str:
    return EDGES[name].format(**{t: t for t in TABLES})


def vertices_sql(name: str) -> str:
    return VERTICES[name].format(nation="nation") if name in VERTICES else _ENDS.format(e=edges_sql(name))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def run(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    """SQL with {table} marks over the Parquet tables of a folder."""
    return spark.sql(sql, **{t: table(spark, sf, t) for t in TABLES if "{" + t + "}" in sql})


def graph(spark: SparkSession, sf: str, name: str, directed: bool = True) -> Graph:
    """The narrow table of edges is written once: algorithms read it again and again, and never the tables behind it."""
    edges = cut(run(spark, sf, EDGES[name]))
    vertices = run(spark, sf, VERTICES[name]) if name in VERTICES else None
    return Graph.from_edges(edges, vertices, directed)
