"""Registered queries of element access, matrices, models, generation and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import NodeNotFound
from ..functions import arrays, decoder, decompose, differentiable, gnn, matrix, transformer
from ..graph import Graph, opposite
from ..iterate import checkpoint_folder, cut
from ..operators import centrality, community, model, partition, paths, traversal
from ..sources import tensors, text
from ..sources.tables import graph, table
from .catalog import _EMB, _FEAT, _LEARN, _embeddings, _features, _learnable, _long, _one, _r, _relaxed, _token_probs, _xy, query, with_
from .registry import Catalog, builtin, intent_to_api


# access and editing
@query(with_("partners", "SELECT (SELECT COUNT(*) FROM e) = 0 AS empty, EXISTS (SELECT 1 FROM v WHERE id = 3) AS has_node, EXISTS (SELECT 1 FROM v WHERE id = 99) AS has_other, EXISTS (SELECT 1 FROM e WHERE src = 0 AND dst = 1) AS has_edge, (SELECT MIN(edge_id) FROM e) AS edge, (SELECT src FROM e ORDER BY edge_id LIMIT 1) AS src, (SELECT dst FROM e ORDER BY edge_id LIMIT 1) AS dst, (SELECT weight FROM e ORDER BY edge_id LIMIT 1) AS weight, (SELECT string_agg(dst, ' ' ORDER BY edge_id) FROM e WHERE src = 7) AS neighbors, (SELECT string_agg(src, ' ' ORDER BY edge_id) FROM e WHERE dst = 7) AS sources, (SELECT string_agg(edge_id, ' ' ORDER BY edge_id) FROM e WHERE src = 7) AS incident, 'NodeNotFound' AS missing"))
def graph_access(spark, sf):
    g = graph(spark, sf, "partners")
    edge = g.edges.agg(F.min("edge_id")).first()[0]
    src, dst = g.edge_endpoints(edge)
    line = lambda df: " ".join(str(r[0]) for r in df.collect()) or None
    try:
        g.get_node(99)
        missing = "found"
    except NodeNotFound:
        missing = "NodeNotFound"
    assert g.get_node(3)["id"] == 3 and g.contains_edge(edge) and g.get_edge_by_nodes(src, dst)["edge_id"] == edge
    values = [g.is_empty(), g.contains_node(3), g.contains_node(99), g.has_edge(0, 1), edge, src, dst, g.get_edge(edge)["weight"], line(g.neighbors(7)), line(g.neighbors(7, opposite("out"))), line(g.incident_edges(7)), missing]
    return spark.createDataFrame([tuple(values)], "empty boolean, has_node boolean, has_other boolean, has_edge boolean, edge long, src long, dst long, weight double, neighbors string, sources string, incident string, missing string")


@query(with_("partners", "SELECT 'edge' AS kind, edge_id AS id, CASE WHEN edge_id = (SELECT MIN(edge_id) FROM e) THEN 1.5::DOUBLE ELSE weight END AS value FROM e WHERE src <> 4 AND dst <> 4 AND edge_id <> (SELECT MAX(edge_id) FROM e) UNION ALL SELECT 'edge', (SELECT MAX(edge_id) FROM e) + 1, 9.0::DOUBLE UNION ALL SELECT 'node', id, 1.0::DOUBLE FROM v WHERE id <> 4 UNION ALL SELECT 'node', 25, 1.0::DOUBLE"))
def graph_edits(spark, sf):
    """A node and an edge are added, a node, its edges and the last edge go, and the first edge's weight changes."""
    g = graph(spark, sf, "partners")
    low, high = g.edges.agg(F.min("edge_id"), F.max("edge_id")).first()
    g, node = g.add_node()
    g, _ = g.add_edge(node, 0, 9.0)
    g = g.remove_node(4).remove_edge(high).update_edge(low, weight=1.5)
    return g.edges.select(F.lit("edge").alias("kind"), F.col("edge_id").alias("id"), F.col("weight").alias("value")).union(g.vertices.select(F.lit("node"), "id", F.col("gen").cast("double")))


@query(with_("partners", "SELECT edge_id FROM e WHERE src % 2 = 0 AND dst % 2 = 0"))
def induced_subgraph(spark, sf):
    return graph(spark, sf, "partners").subgraph(F.col("id") % 2 == 0).edges.select("edge_id")


@query(with_("partners", "SELECT CAST(0 AS INTEGER) AS part, id AS key, '    ' || id || ' [label=\"' || id || '\"];' AS line FROM v UNION ALL SELECT 1, edge_id, '    ' || src || ' -> ' || dst || ' [label=\"' || weight || '\"];' FROM e"))
def dot_lines(spark, sf):
    return text.dot_lines(graph(spark, sf, "partners"))


@query(with_("partners", "SELECT 'digraph' AS kind, (SELECT COUNT(*) FROM v) + (SELECT COUNT(*) FROM e) + 2 AS lines, (SELECT COUNT(*) FROM e) AS arrows UNION ALL SELECT 'graph', (SELECT COUNT(*) FROM v) + (SELECT COUNT(*) FROM e) + 2, (SELECT COUNT(*) FROM e) UNION ALL SELECT 'svg', (SELECT COUNT(*) FROM v) + (SELECT COUNT(*) FROM e) + 2, (SELECT COUNT(*) FROM e)"))
def drawings(spark, sf):
    """DOT of both kinds and a drawing, each written to a file and read again as lines."""
    checkpoint_folder(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    g = graph(spark, sf, "partners")
    texts = {"digraph": (text.to_dot(g), " -> "), "graph": (text.to_dot(g.undirected()), " -- "), "svg": (text.to_svg(g, "force"), "<line")}
    out = None
    for kind, (body, mark) in texts.items():
        text.write_text(g, f"{folder}/{kind}.txt", body)
        own = spark.read.text(f"{folder}/{kind}.txt").agg(F.lit(kind).alias("kind"), F.count("*").alias("lines"), F.count_if(F.contains("value", F.lit(mark))).alias("arrows"))
        out = own if out is None else out.union(own)
    return out


@query("SELECT * FROM (VALUES ('bellman_ford', 'path', 1), ('betweenness_centrality', 'centrality', 1), ('bfs', 'traversal', 1), ('closeness_centrality', 'centrality', 1), ('connected_components', 'community', 0), ('dfs', 'traversal', 1), ('dijkstra', 'path', 1), ('louvain', 'community', 1), ('pagerank', 'centrality', 3), ('topological_sort', 'traversal', 0)) t(name, tag, settings)")
def registry(spark, sf):
    return builtin().table(spark).select("name", F.col("tags")[0].alias("tag"), F.size("settings").alias("settings"))


@query(with_("partners", "SELECT id, d AS distance FROM r25", _relaxed()))
def registry_dijkstra(spark, sf):
    return builtin().execute("dijkstra", graph(spark, sf, "partners"), source=0).select("id", "distance")


@query(with_("partners", "SELECT CAST(25 AS BIGINT) AS nodes, (SELECT COUNT(*) FROM e) AS edges, COALESCE((SELECT string_agg(dst, ' ' ORDER BY edge_id) FROM e WHERE src = 0), '') AS neighbors, (SELECT d FROM r25 WHERE id = (SELECT MAX(id) FROM r25)) AS distance, 'pagerank' AS api", _relaxed()))
def named_graph(spark, sf):
    c = Catalog(spark)
    c._put("partners", graph(spark, sf, "partners"))
    info, g = c.graph_info("partners"), c.graphs["partners"]
    path = c.shortest_path("partners", 0, traversal.bfs(g, [0]).agg(F.max("id")).first()[0])
    found = sum(g.get_edge_by_nodes(a, b)["weight"] for a, b in zip(path, path[1:]))
    return _one(spark, nodes=info["nodes"], edges=info["edges"], neighbors=" ".join(map(str, c.get_neighbors("partners", 0))), distance=found, api=intent_to_api("Which vertices rank highest?"))


# partitions and components
@query(with_("trade", "SELECT MIN(n) AS min_nodes, MAX(n) AS max_nodes, AVG(n) AS avg_nodes, MAX(n) / MIN(n)::DOUBLE AS balance, MAX(n) <= 2 * MIN(n) AS balanced FROM (SELECT COUNT(*) AS n FROM v GROUP BY LEAST(id // 7, 3)) x"))
def partition_balance(spark, sf):
    stats = partition.partition_stats(graph(spark, sf, "trade"), partition.range_partition(7, 4))
    return partition.balance(stats).select("min_nodes", "max_nodes", "avg_nodes", "balance").withColumn("balanced", F.lit(partition.is_balanced(stats, 2.0)))


@query(with_("part_supp", "SELECT COUNT(*) AS nodes, TRUE AS all_parts FROM v"))
def hash_partitions(spark, sf):
    v = graph(spark, sf, "part_supp").vertices.withColumn("pid", partition.hash_partition(8, 3))
    return v.agg(F.count("*").alias("nodes"), (F.countDistinct("pid") == 8).alias("all_parts"))


@query("WITH c AS (SELECT conv_id, COUNT(*) AS n FROM conversations GROUP BY conv_id HAVING COUNT(*) > 1) SELECT (SELECT MAX(n) FROM c) AS largest, (SELECT COUNT(*) FROM c) AS parts, (SELECT COUNT(*) FROM c) - 1 AS last_number")
def largest_component(spark, sf):
    c = cut(community.connected_components(graph(spark, sf, "talk")))
    top = community.renumber(c).agg(F.max("number")).first()[0]
    return _one(spark, largest=community.largest_component(c)["size"], parts=community.component_sizes(c).count(), last_number=int(top))


@query(with_("partners", "SELECT MIN(id) AS id, ROUND(MAX(rank), 6) AS rank FROM (SELECT id, rank FROM (SELECT dst AS id, COUNT(*) / 24.0::DOUBLE AS rank FROM e GROUP BY dst) x ORDER BY rank DESC, id LIMIT 1) y"))
def most_popular(spark, sf):
    return centrality.top_k(centrality.degree_centrality(graph(spark, sf, "partners").reversed()), "centrality", 1).select("id", _r("centrality", "rank"))


@query(with_("partners", "SELECT EXISTS (SELECT 1 FROM d WHERE source = 0 AND id = 24) AS flows, (SELECT COUNT(DISTINCT k) FROM (SELECT MIN(k) AS k FROM c GROUP BY id) x) AS components, (SELECT COUNT(*) FROM v WHERE id NOT IN (SELECT src FROM e)) AS isolated", "h AS (SELECT id AS source, id, 0 AS depth FROM v UNION SELECT h.source, e.dst, h.depth + 1 FROM h JOIN e ON h.id = e.src WHERE h.depth < 26), d AS (SELECT source, id, MIN(depth) AS depth FROM h GROUP BY source, id), u AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), c AS (SELECT id, id AS k FROM v UNION SELECT u.dst, c.k FROM c JOIN u ON c.id = u.src)"))
def topology(spark, sf):
    g = graph(spark, sf, "partners")
    report = model.topology_report(g)
    return _one(spark, flows=model.gradient_flow(g, F.col("id") == 0, F.col("id") == 24), components=report["components"], isolated=report["isolated"])


# matrices
_AB = "a AS (SELECT src AS i, dst AS j, weight AS x FROM e), b AS (SELECT dst AS i, src AS j, weight AS y FROM e)"


@query(with_("partners", "SELECT COALESCE(a.i, b.i) AS i, COALESCE(a.j, b.j) AS j, COALESCE(x, 0) + COALESCE(y, 0) AS plus, COALESCE(x, 0) - COALESCE(y, 0) AS minus, x * y AS times, ROUND(x / y, 6) AS over FROM a FULL JOIN b ON a.i = b.i AND a.j = b.j", _AB))
def matrix_arithmetic(spark, sf):
    a = matrix.adjacency(graph(spark, sf, "partners"))
    b = cut(matrix.transpose(a))
    out = matrix.combine(a, b, "add").withColumnRenamed("v", "plus")
    for op, name in (("sub", "minus"), ("mul", "times"), ("div", "over")):
        out = out.join(matrix.combine(a, b, op).withColumnRenamed("v", name), ["i", "j"], "left")
    return out.withColumn("over", F.round("over", 6))


@query(with_("trade", "SELECT SUM(weight) AS total, ROUND(AVG(weight), 6) AS mean, MAX(weight) AS high, MIN(weight) AS low, ROUND(SQRT(SUM(weight * weight)), 6) AS norm, ROUND(1 - COUNT(*) / 625.0::DOUBLE, 6) AS sparsity, CAST(COUNT(*) FILTER (weight > 50) AS BIGINT) AS large FROM e"))
def matrix_reductions(spark, sf):
    m = matrix.adjacency(graph(spark, sf, "trade"))
    value = lambda how: matrix.reduce_axis(m, None, how).first()[0]
    return _one(spark, total=value("sum"), mean=round(value("mean"), 6), high=value("max"), low=value("min"), norm=round(matrix.frobenius(m), 6), sparsity=round(matrix.sparsity(m, 25, 25), 6), large=matrix.sparsify(m, 50).count())


@query(with_("trade", "SELECT 'row' AS axis, src AS at, SUM(weight) AS total, ROUND(AVG(weight), 6) AS mean FROM e GROUP BY src UNION ALL SELECT 'column', dst, SUM(weight), ROUND(AVG(weight), 6) FROM e GROUP BY dst"))
def matrix_axes(spark, sf):
    m = matrix.adjacency(graph(spark, sf, "trade"))
    out = None
    for axis, name, key in ((1, "row", "i"), (0, "column", "j")):
        own = matrix.reduce_axis(m, axis, "sum").withColumnRenamed("v", "total").join(matrix.reduce_axis(m, axis, "mean").withColumnRenamed("v", "mean"), key).select(F.lit(name).alias("axis"), F.col(key).alias("at"), "total", _r("mean", "mean"))
        out = own if out is None else out.union(own)
    return out


@query(with_("partners", "SELECT src AS i, dst AS j, weight AS v FROM e UNION ALL SELECT src + 25, dst, weight FROM e"))
def csr_round_trip(spark, sf):
    """COO to CSR and back, and the matrix put below itself."""
    m = matrix.adjacency(graph(spark, sf, "partners"))
    return matrix.concat_rows(m, 25, matrix.from_csr(matrix.to_csr(m)))


@query(with_("partners", "SELECT a.id AS i, b.id AS j, COALESCE(e.weight, 0) AS v FROM v a CROSS JOIN v b LEFT JOIN e ON e.src = a.id AND e.dst = b.id"))
def dense_adjacency(spark, sf):
    return matrix.dense_adjacency(graph(spark, sf, "partners")).select("i", F.posexplode("row").alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), "v")


@query(with_("partners", "SELECT src AS i, COUNT(*) AS d FROM e GROUP BY src"))
def degree_matrix(spark, sf):
    return matrix.degree(matrix.adjacency(graph(spark, sf, "partners")))


@query(f"WITH {_EMB}, w AS (SELECT a.i AS k, b.i AS j, (a.i * 3 + b.i) / 10.0::DOUBLE AS y FROM range(8) a(i), range(2) b(i)) SELECT m.i AS b, m.j // 8 AS i, w.j, ROUND(SUM(m.v * w.y), 5) AS v FROM m JOIN w ON m.j % 8 = w.k GROUP BY m.i, m.j // 8, w.j")
def batch_matmul(spark, sf):
    """Each embedding as an 8 x 8 matrix, times one 8 x 2 weight."""
    batches = _long(spark, sf).select(F.col("i").alias("b"), F.expr("j div 8").alias("i"), (F.col("j") % 8).alias("j"), "v")
    w = matrix.expand_last(spark.range(8).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("j"), (F.col("id") * 3).alias("v")), 2).select("i", "j", ((F.col("v") + F.col("j")) / 10.0).alias("v"))
    return matrix.batch_matmul(batches, w).select("b", "i", "j", F.round("v", 5).alias("v"))


@query("WITH s AS (SELECT conv_id, COUNT(*) AS n FROM conversations GROUP BY conv_id), o AS (SELECT conv_id, SUM(n) OVER (ORDER BY conv_id) - n AS o FROM s), t AS (SELECT conv_id, turn, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p FROM conversations) SELECT CAST(t.p + o.o AS BIGINT) AS i, CAST(t.p + o.o + 1 AS BIGINT) AS j, 1.0::DOUBLE AS v FROM t JOIN o USING (conv_id) JOIN s USING (conv_id) WHERE t.p + 1 < s.n")
def block_diagonal(spark, sf):
    """The chains of all conversations as one block-diagonal matrix."""
    sizes = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("graph_id")).agg(F.count("*").alias("n"))
    edges = sizes.where("n > 1").select("graph_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 2)).alias("i")).select("graph_id", "i", (F.col("i") + 1).alias("j"), F.lit(1.0).alias("v"))
    return matrix.batch_block_diagonal(edges, sizes)


@query("WITH s AS (SELECT conv_id, COUNT(*) AS n FROM conversations GROUP BY conv_id), m AS (SELECT MAX(n) AS m FROM s) SELECT conv_id AS graph_id, CAST(m AS BIGINT) AS slots, CAST(n AS DOUBLE) AS filled FROM s, m")
def padded_features(spark, sf):
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("graph_id"), (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("pos"), F.array(F.lit(1.0), F.lit(0.5)).alias("x"))
    return matrix.pad_features(rows).groupBy("graph_id").agg(F.count("*").alias("slots"), F.sum(F.col("x")[0]).alias("filled"))


def _powers(rounds: int) -> str:
    parts = ["y0 AS (SELECT id, 1.0::DOUBLE AS x FROM v)"]
    parts += [f"z{k} AS MATERIALIZED (SELECT e.src AS id, SUM(e.weight * y.x) AS x FROM e JOIN y{k - 1} y ON y.id = e.dst GROUP BY e.src), y{k} AS MATERIALIZED (SELECT id, x / (SELECT SQRT(SUM(x * x)) FROM z{k}) AS x FROM z{k})" for k in range(1, rounds + 1)]
    return ", ".join(parts)


@query(with_("trade", "SELECT ROUND((SELECT SQRT(SUM(x * x)) FROM z40), 3) AS radius", _powers(40)))
def spectral_radius(spark, sf):
    return _one(spark, radius=round(matrix.spectral_radius(graph(spark, sf, "trade")), 3))


@query(f"WITH {_EMB} SELECT i, ROUND(SUM(v * 2 + 1), 5) AS scaled, ROUND(AVG(v), 6) AS mean, ROUND(VAR_POP(v), 6) AS var, ROUND(SUM(CASE WHEN v > 0.1::DOUBLE THEN -1 ELSE v END), 5) AS filled, ROUND(SUM(v * v - v / 2), 5) AS arithmetic FROM m GROUP BY i")
def vector_operations(spark, sf):
    e = _embeddings(spark, sf)
    half = arrays.scale("x", 0.5)
    return e.select(
        F.col("vec_id").alias("i"), F.round(arrays.total(arrays.add_scalar(arrays.scale("x", 2.0), 1.0)), 5).alias("scaled"), _r(arrays.mean("x"), "mean"), _r(arrays.variance("x"), "var"),
        F.round(arrays.total(arrays.mask_fill("x", arrays.greater_mask("x", 0.1), -1.0)), 5).alias("filled"), F.round(arrays.total(arrays.sub(arrays.mul("x", "x"), half)), 5).alias("arithmetic"),
    )


@query("WITH t AS (SELECT p_partkey, (p_retailprice - 1200) / 300.0::DOUBLE AS x FROM part), u AS (SELECT *, TANH(SQRT(2 / PI()) * (x + 0.044715::DOUBLE * x * x * x)) AS t FROM t) SELECT p_partkey, ROUND(0.5::DOUBLE * (1 + t) + 0.5::DOUBLE * x * (1 - t * t) * SQRT(2 / PI()) * (1 + 3 * 0.044715::DOUBLE * x * x), 6) AS slope FROM u")
def gelu_slopes(spark, sf):
    return table(spark, sf, "part").withColumn("x", (F.col("p_retailprice") - 1200) / 300.0).select("p_partkey", _r(arrays.gelu_derivative("x"), "slope"))


# decompositions
@query("SELECT CAST(vec_id AS VARCHAR) AS name, ROUND(list_sum(list_transform(embedding, lambda x: POW(CAST(x AS DOUBLE), 2))), 4) AS energy, CAST(8 AS INTEGER) AS many, TRUE AS whole FROM embeddings")
def singular_values(spark, sf):
    """The squares of the singular values add up to the matrix's own squares, and U S V^T is the matrix."""
    t = _embeddings(spark, sf).select(F.col("vec_id").cast("string").alias("name"), F.array(F.lit(8), F.lit(8)).alias("shape"), F.col("x").alias("data"))
    return decompose.singular_values(t).select("name", F.round(arrays.dot("s", "s"), 4).alias("energy"), F.size("s").alias("many"), (F.col("error") < 1e-9).alias("whole"))


@query("SELECT vec_id, ROUND(COS(a), 6) AS cosine, ROUND(SIN(a), 6) AS sine, ROUND((1 - a * a / 4) / (1 + a * a / 4), 6) AS cayley, ROUND(SIN(a), 6) AS logarithm, TRUE AS is_skew FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a FROM embeddings) t")
def lie_maps(spark, sf):
    """The generator of plane rotations times an angle: its exponential, Cayley map, and the logarithm of what comes out."""

    def kernel(a):
        angle = float(a[0, 0])
        s = decompose.so_generator(2, 0, 1) * angle
        r = decompose.lie_exponential(s)
        return {"cosine": float(r[0, 0]), "sine": float(r[0, 1]), "cayley": float(decompose.cayley(s)[0, 0]), "logarithm": float(decompose.lie_logarithm(r)[0, 1]), "is_skew": decompose.is_skew_symmetric(s)}

    t = _embeddings(spark, sf).select(F.col("vec_id").cast("string").alias("name"), F.array(F.lit(1), F.lit(64)).alias("shape"), F.col("x").alias("data"))
    out = decompose.map_tensors(t, kernel, "cosine double, sine double, cayley double, logarithm double, is_skew boolean")
    return out.select(F.col("name").cast("long").alias("vec_id"), *[_r(c, c) for c in ("cosine", "sine", "cayley", "logarithm")], "is_skew")


@query("SELECT CAST(vec_id AS VARCHAR) AS name, CAST(4 AS INTEGER) AS blocks, ROUND(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS total, TRUE AS falling FROM embeddings")
def blocks_and_ranks(spark, sf):
    """The 4 x 4 blocks of 8 x 8 matrices; approximations of rising rank come nearer, and all energy needs every rank."""
    import numpy as np

    def kernel(a):
        blocks = decompose.so_blocks(a, 4)
        errors = [float(np.linalg.norm(decompose.low_rank(a, k) - a)) for k in range(1, 9)]
        ok = all(x >= y - 1e-12 for x, y in zip(errors, errors[1:])) and errors[-1] < 1e-9 and decompose.adaptive_rank(a, 0.5) <= decompose.adaptive_rank(a, 1.0) <= 8 and decompose.condition_number(a) >= 1
        return {"blocks": len(blocks), "total": float(sum(b.sum() for b in blocks)), "falling": ok}

    t = _embeddings(spark, sf).select(F.col("vec_id").cast("string").alias("name"), F.array(F.lit(8), F.lit(8)).alias("shape"), F.col("x").alias("data"))
    return decompose.map_tensors(t, kernel, "blocks int, total double, falling boolean").select("name", "blocks", F.round("total", 5).alias("total"), "falling")


# graph layers
@query(with_("partners", "SELECT e.dst AS id, ROUND(SUM(f.x0 * 2 + f.x1), 6) AS x0, ROUND(SUM(f.x0 - f.x1), 6) AS x1 FROM e JOIN f ON e.src = f.id GROUP BY e.dst", _FEAT))
def linear_messages(spark, sf):
    return _xy(gnn.aggregate(graph(spark, sf, "partners"), _features(spark, sf), "sum", gnn.linear("x", [[2.0, 1.0], [1.0, -1.0]])))


@query("SELECT id, ROUND(GREATEST(x0 + x1, 0) * 0.5::DOUBLE, 6) AS relu, ROUND((x0 - x1) / (1 + EXP(-(x0 - x1))) * (x0 + x1) * 0.5::DOUBLE, 6) AS swiglu FROM (SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS DOUBLE) AS x0, CAST(n_nationkey AS DOUBLE) / 10 AS x1 FROM nation) f")
def feed_forward(spark, sf):
    up, down, gate = [[1.0, 1.0]], [[0.5]], [[1.0, -1.0]]
    return _features(spark, sf).select("id", _r(transformer.feed_forward("x", up, down)[0], "relu"), _r(transformer.feed_forward("x", up, down, gate, "swiglu")[0], "swiglu"))


@query(f"WITH {_EMB}, q AS (SELECT i, MAX(ABS(v)) / 127 AS s FROM m GROUP BY i), z AS (SELECT m.i, m.j, CAST(GREATEST(-127, LEAST(127, ROUND(m.v / q.s))) AS INTEGER) AS q, q.s FROM m JOIN q ON q.i = m.i) SELECT i, CAST(0 AS BIGINT) AS j, ROUND(SUM(q * (j % 3 - 1)) * MAX(s) * 0.5::DOUBLE, 5) AS v FROM z GROUP BY i")
def gemm_int8(spark, sf):
    """Quantised embeddings times a column of -1, 0, 1 at scale a half."""
    a = _embeddings(spark, sf).select("vec_id", transformer.quantize_int8("x").alias("z")).select(F.col("vec_id").alias("i"), F.posexplode("z.q").alias("j", "q"), "z.scale").withColumn("j", F.col("j").cast("long"))
    b = spark.range(64).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("j"), (F.col("id") % 3 - 1).alias("q"), F.lit(0.5).alias("scale"))
    return transformer.gemm_int8(a, b).select("i", "j", F.round("v", 5).alias("v"))


# model files, layered models and generation
def _named(spark, sf) -> DataFrame:
    part = F.when(F.col("vec_id") % 3 == 0, ".self_attn.q_proj.").when(F.col("vec_id") % 3 == 1, ".mlp.up_proj.").otherwise(".input_layernorm.")
    name = F.concat(F.lit("model.layers."), F.col("label").cast("string"), part, F.col("vec_id").cast("string"))
    return _embeddings(spark, sf).select(name.alias("name"), F.array(F.lit(8), F.lit(8)).alias("shape"), F.col("x").alias("data"), "vec_id")


@query("SELECT 'model.layers.' || label || CASE vec_id % 3 WHEN 0 THEN '.self_attn.q_proj.' WHEN 1 THEN '.mlp.up_proj.' ELSE '.input_layernorm.' END || vec_id AS name, 'F32' AS dtype, CAST(64 AS INTEGER) AS n, ROUND(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS total FROM embeddings")
def tensor_file(spark, sf):
    """All embeddings as tensors of one file, written and read again."""
    checkpoint_folder(spark)
    where = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}.safetensors"
    tensors.write_safetensors(_named(spark, sf), where)
    return tensors.read_safetensors(spark, where).select("name", "dtype", F.size("data").alias("n"), F.round(arrays.total("data"), 5).alias("total"))


@query("SELECT CASE vec_id % 3 WHEN 0 THEN 'Attention' WHEN 1 THEN 'MLP' ELSE 'Norm' END AS kind, CAST(label AS INTEGER) AS layer, COUNT(*) AS n FROM embeddings GROUP BY 1, 2 UNION ALL SELECT 'Layer', -1, COUNT(DISTINCT label) - 1 FROM embeddings UNION ALL SELECT 'Sequence', -1, COUNT(*) - COUNT(DISTINCT label) FROM embeddings")
def operator_graph(spark, sf):
    """Vertices by operator and layer, and edges by kind, of a checkpoint read as a graph."""
    g = tensors.operator_graph(_named(spark, sf))
    return g.vertices.groupBy("kind", "layer").agg(F.count("*").alias("n")).union(g.edges.groupBy("kind").agg(F.lit(-1).alias("layer"), F.count("*").alias("n")))


@query("SELECT CAST(COUNT(*) * 64 AS BIGINT) AS parameters FROM embeddings")
def parameter_count(spark, sf):
    return _one(spark, parameters=transformer.parameter_count(_named(spark, sf)))


#: A model of two dimensions and four tokens: even attention (queries are zero), and diagonal projections.
_TINY = {
    "model.embed_tokens": [[1.0, 0.2], [0.3, 1.0], [0.9, 1.1], [1.0, -0.7]], "model.norm": [1.0, 1.0],
    "model.layers.0.self_attn.q_proj": [[0.0, 0.0], [0.0, 0.0]], "model.layers.0.self_attn.k_proj": [[1.0, 0.0], [0.0, 1.0]], "model.layers.0.self_attn.v_proj": [[1.0, 0.0], [0.0, 1.0]], "model.layers.0.self_attn.o_proj": [[0.5, 0.0], [0.0, 0.5]],
    "model.layers.0.mlp.gate_proj": [[1.0, 0.0], [0.0, 1.0]], "model.layers.0.mlp.up_proj": [[1.0, 0.0], [0.0, 1.0]], "model.layers.0.mlp.down_proj": [[0.5, 0.0], [0.0, 0.5]],
    "model.layers.0.input_layernorm": [1.0, 1.0], "model.layers.0.post_attention_layernorm": [2.0, 1.0],
}
_DECODED = (
    "t AS (SELECT conv_id AS seq, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, turn % 4 AS tok FROM conversations), w AS (SELECT * FROM (VALUES (0, 1.0::DOUBLE, 0.2::DOUBLE), (1, 0.3, 1.0), (2, 0.9, 1.1), (3, 1.0, -0.7)) w(tok, x0, x1)), "
    "x AS (SELECT seq, pos, x0, x1, x0 / SQRT((x0 * x0 + x1 * x1) / 2 + 0.000001::DOUBLE) AS n0, x1 / SQRT((x0 * x0 + x1 * x1) / 2 + 0.000001::DOUBLE) AS n1 FROM t JOIN w USING (tok)), "
    "h AS (SELECT seq, pos, x0 + 0.5::DOUBLE * AVG(n0) OVER (PARTITION BY seq) AS x0, x1 + 0.5::DOUBLE * AVG(n1) OVER (PARTITION BY seq) AS x1 FROM x), "
    "n AS (SELECT *, 2 * x0 / SQRT((x0 * x0 + x1 * x1) / 2 + 0.000001::DOUBLE) AS n0, x1 / SQRT((x0 * x0 + x1 * x1) / 2 + 0.000001::DOUBLE) AS n1 FROM h), "
    "f AS (SELECT seq, pos, x0 + 0.5::DOUBLE * n0 * n0 / (1 + EXP(-n0)) AS x0, x1 + 0.5::DOUBLE * n1 * n1 / (1 + EXP(-n1)) AS x1 FROM n), "
    "o AS (SELECT f.seq, f.pos, CAST(w.tok AS BIGINT) AS token, (f.x0 * w.x0 + f.x1 * w.x1) / SQRT((f.x0 * f.x0 + f.x1 * f.x1) / 2 + 0.000001::DOUBLE) AS logit FROM f CROSS JOIN w)"
)


def _tiny(spark) -> decoder.Model:
    rows = [(f"{k}.weight", [len(v), len(v[0])] if isinstance(v[0], list) else [len(v)], [x for r in v for x in r] if isinstance(v[0], list) else v) for k, v in _TINY.items()]
    return decoder.build_model(spark.createDataFrame(rows, "name string, shape array<int>, data array<double>"), decoder.Config(1, 1))


def _turns(spark, sf) -> DataFrame:
    turns = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("seq")).agg(F.sort_array(F.collect_list("turn")).alias("t"))
    return turns.select("seq", F.transform("t", lambda x: x % 4).alias("tokens"))


@query(f"WITH {_DECODED} SELECT seq, pos, token, ROUND(logit, 6) AS logit FROM o")
def decoder_logits(spark, sf):
    return decoder.forward(_tiny(spark), _turns(spark, sf)).select("seq", "pos", "token", _r("logit", "logit"))


@query(f"WITH {_DECODED}, l AS (SELECT seq, MAX(pos) AS pos FROM t GROUP BY seq) SELECT seq, pos + 2 AS length, token AS next FROM (SELECT o.*, ROW_NUMBER() OVER (PARTITION BY o.seq ORDER BY logit DESC, token DESC) AS r FROM o JOIN l ON l.seq = o.seq AND l.pos = o.pos) x WHERE r = 1")
def generate_greedy(spark, sf):
    out = transformer.generate(decoder.next_logits(_tiny(spark)), _turns(spark, sf), 1)
    return out.select("seq", F.size("tokens").cast("long").alias("length"), F.element_at("tokens", -1).alias("next"))


@query(f"WITH {_DECODED}, l AS (SELECT seq, MAX(pos) AS pos FROM t GROUP BY seq), z AS (SELECT o.seq, o.pos, token, logit - LN(SUM(EXP(logit)) OVER (PARTITION BY o.seq)) AS lp FROM o JOIN l ON l.seq = o.seq AND l.pos = o.pos) SELECT seq, MAX(pos) + 2 AS length, ROUND(MAX(lp), 6) AS score FROM z GROUP BY seq")
def generate_beams(spark, sf):
    out = transformer.beam_search(decoder.next_logits(_tiny(spark)), _turns(spark, sf), 1, 3)
    return out.select("seq", F.size("tokens").cast("long").alias("length"), _r("score", "score"))


@query("SELECT conv_id AS seq, COUNT(*) + 2 AS length, TRUE AS known FROM conversations GROUP BY conv_id")
def generate_samples(spark, sf):
    out = transformer.generate(decoder.next_logits(_tiny(spark)), _turns(spark, sf), 2, "sample", temperature=0.8, k=3, p=0.95, repetition=1.2)
    return out.select("seq", F.size("tokens").cast("long").alias("length"), F.forall("tokens", lambda x: x.between(0, 3)).alias("known"))


@query("WITH t AS (SELECT conv_id, turn, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS nth FROM conversations) SELECT CAST(conv_id AS INTEGER) AS layer, turn AS pos, CASE WHEN nth = 1 THEN 9.0::DOUBLE ELSE CAST(turn AS DOUBLE) END AS k, CAST(turn // 2 AS INTEGER) AS page FROM t")
def key_value_cache(spark, sf):
    """One entry a turn; the last of each conversation is written again."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").cast("int").alias("layer"), F.col("turn").alias("pos"), F.col("turn").cast("double").alias("k"), F.lit(0.0).alias("v"))
    last = c.groupBy("layer").agg(F.max("pos").alias("pos")).select("layer", "pos", F.lit(9.0).alias("k"), F.lit(1.0).alias("v"))
    return transformer.cache_append(c, last, 2).select("layer", "pos", "k", "page")


@query("SELECT event_id AS request FROM events ORDER BY ts, event_id LIMIT 13")
def schedule(spark, sf):
    return transformer.schedule(table(spark, sf, "events").select(F.col("event_id").alias("request"), F.col("ts").alias("arrived")), 16, 3).select("request")


@query("SELECT id, ROUND(x, 6) AS x FROM (SELECT i AS id, CAST(i + 1 AS DOUBLE) AS x FROM range(4) r(i) UNION ALL SELECT 4 + i, (i + 1) + (i + 2) / 2.0::DOUBLE FROM range(4) r(i) UNION ALL SELECT 8 + i, y / (1 + EXP(-y)) FROM (SELECT i, (i + 1) + (i + 2) / 2.0::DOUBLE AS y FROM range(4) r(i)) s) t")
def token_graph_states(spark, sf):
    g = transformer.token_graph(spark, 4, 1)
    start = spark.range(4).select("id", F.array((F.col("id") + 1).cast("double")).alias("x"))
    return transformer.execute_token_graph(g, start).select("id", _r(F.col("x")[0], "x"))


# learnable structure
@query(with_("partners", "SELECT src, dst, ROUND(1 / (1 + EXP(-logit / 0.5::DOUBLE)), 6) AS prob, logit > 0 AS exist, ROUND(CASE WHEN logit > 0 THEN 1 ELSE 0 END - p, 6) AS ste FROM l", _LEARN))
def discretized_edges(spark, sf):
    return differentiable.discretize(_learnable(spark, sf), 0.5).select("src", "dst", _r("prob", "prob"), F.col("exists").alias("exist"), _r("ste", "ste"))


@query(with_("partners", "SELECT src, dst, ROUND(0.9::DOUBLE * weight / 100 + (src - dst) / 10.0::DOUBLE, 6) AS velocity FROM l", _LEARN))
def edge_momentum(spark, sf):
    e = _learnable(spark, sf)
    return differentiable.momentum(e.select("src", "dst", (F.col("weight") / 100).alias("velocity")), e.select("src", "dst", ((F.col("src") - F.col("dst")) / 10.0).alias("grad"))).select("src", "dst", _r("velocity", "velocity"))


@query(with_("partners", "SELECT src, dst, ROUND(weight - 0.0001::DOUBLE * error * p * x, 6) AS weight, ROUND((SELECT SUM(error * error) / 2 FROM y), 4) AS loss FROM q JOIN y ON y.id = q.dst WHERE 1 / (1 + EXP(-(logit - 0.001::DOUBLE * (error * weight * x * s * (1 - s) + CASE WHEN error * weight * x <> 0 THEN CASE WHEN s > 0.5 THEN 1 ELSE 0 END - p ELSE 0 END)))) >= 0.2", f"{_LEARN}, q AS (SELECT *, CAST(src AS DOUBLE) / 10 AS x, 1 / (1 + EXP(-logit)) AS s FROM l), y AS (SELECT v.id, COALESCE(g.got, 0) - 1 AS error FROM v LEFT JOIN (SELECT dst, SUM(p * weight * x) AS got FROM q GROUP BY dst) g ON g.dst = v.id)"))
def joint_optimization(spark, sf):
    """One step on weights and structure together."""
    e = _learnable(spark, sf)
    v = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    kept, loss = differentiable.joint_step(e, v.select("id", (F.col("id") / 10.0).alias("x")), v.select("id", F.lit(1.0).alias("y")), 0, 10, 0.001, 0.0001, 0.2)
    return kept.select("src", "dst", _r("weight", "weight"), F.lit(round(loss, 4)).alias("loss"))


@query(with_("partners", "SELECT COUNT(*) AS total, CAST(COUNT(*) FILTER (p > 0.5) AS BIGINT) AS kept, TRUE AS fell FROM l", _LEARN))
def optimize_structure(spark, sf):
    """Steps that push every probability away from a half: the loss falls, and the edges below a half are pruned."""
    e = _learnable(spark, sf)

    def loss_of(edges):
        p = F.col("prob")
        return edges.agg(F.sum(p * (1 - p))).first()[0], edges.select("src", "dst", (1 - 2 * p).alias("g"))

    kept, report = differentiable.optimize(e, loss_of, 3, 0.05)
    return _one(spark, total=report["total_edges"], kept=kept.count(), fell=report["final_loss"] < report["initial_loss"])
