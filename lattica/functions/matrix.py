"""Matrices as long tables (i, j, v).  Repeated coordinates add up; zeros may be absent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import TooLarge
from ..graph import Graph
from ..iterate import cut


def canonical(m: DataFrame) -> DataFrame:
    return m.groupBy("i", "j").agg(F.sum("v").alias("v"))


def adjacency(graph: Graph) -> DataFrame:
    return graph.arcs().groupBy(F.col("src").alias("i"), F.col("dst").alias("j")).agg(F.sum("weight").alias("v"))


def dense_adjacency(graph: Graph, limit: int = 4096) -> DataFrame:
    """(i, row): for each vertex, in order of id, its weights to all vertices in that order.  n entries a row, so for at most `limit` vertices."""
    ids = sorted(r.id for r in graph.vertices.select("id").limit(limit + 1).collect())
    if len(ids) > limit:
        raise TooLarge("use adjacency()")
    cells = adjacency(graph).groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "v"))).alias("m"))
    rows = graph.vertices.select(F.col("id").alias("i")).join(cells, "i", "left")
    return rows.select("i", F.transform(F.lit(ids).cast("array<long>"), lambda j: F.coalesce(F.try_element_at("m", j), F.lit(0.0))).alias("row"))


def batch_matmul(batches: DataFrame, weight: DataFrame) -> DataFrame:
    """batches(b, i, j, v) times weight(i, j, v), the same for every batch -> (b, i, j, v): one join on the inner index."""
    left, right = batches.select("b", "i", F.col("j").alias("k"), F.col("v").alias("x")), weight.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("b", "i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def expand_last(m: DataFrame, width: int) -> DataFrame:
    """A matrix of one column, repeated to `width` columns."""
    return m.select(*[c for c in m.columns if c not in ("j", "v")], F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))).alias("j"), "v")


def combine(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """add, sub, mul (Hadamard) or div of canonical matrices; mul and div keep the coordinates of both."""
    how = "full" if op in ("add", "sub") else "inner"
    x, y = F.coalesce("v", F.lit(0.0)), F.coalesce("_w", F.lit(0.0))
    value = {"add": x + y, "sub": x - y, "mul": x * y, "div": F.try_divide(x, y)}[op]
    return a.join(b.withColumnRenamed("v", "_w"), ["i", "j"], how).select("i", "j", value.alias("v"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """A join on the inner index, then one sum; partial sums are combined before the shuffle."""
    left, right = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")), b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def matvec(a: DataFrame, x: DataFrame) -> DataFrame:
    """(i, v) of A x, for x(j, x)."""
    return a.join(x, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v"))


def reduce_axis(m: DataFrame, axis: int | None, how: str = "sum") -> DataFrame:
    f = {"sum": F.sum("v"), "mean": F.avg("v"), "max": F.max("v"), "min": F.min("v"), "var": F.var_pop("v")}[how].alias("v")
    return m.agg(f) if axis is None else m.groupBy("j" if axis == 0 else "i").agg(f)


def frobenius(m: DataFrame) -> float:
    return m.agg(F.sqrt(F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0)))).first()[0]


def softmax_rows(m: DataFrame) -> DataFrame:
    w = Window.partitionBy("i")
    e = m.withColumn("_e", F.exp(F.col("v") - F.max("v").over(w)))
    return e.select("i", "j", (F.col("_e") / F.sum("_e").over(w)).alias("v"))


def reshape(m: DataFrame, cols: int, new_cols: int) -> DataFrame:
    p = F.col("i") * cols + F.col("j")
    return m.select(F.floor(p / new_cols).cast("long").alias("i"), (p % new_cols).cast("long").alias("j"), "v")


def slice_(m: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    keep = F.col("i").between(rows[0], rows[1] - 1) & F.col("j").between(cols[0], cols[1] - 1)
    return m.where(keep).select((F.col("i") - rows[0]).alias("i"), (F.col("j") - cols[0]).alias("j"), "v")


def concat_rows(a: DataFrame, a_rows: int, b: DataFrame) -> DataFrame:
    return a.unionByName(b.withColumn("i", F.col("i") + a_rows))


def eye(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))


def full(spark: SparkSession, rows: int, cols: int, value: float) -> DataFrame:
    return spark.range(rows * cols).select(F.expr(f"id div {cols}").alias("i"), (F.col("id") % cols).alias("j"), F.lit(float(value)).alias("v"))


def sparsify(m: DataFrame, threshold: float = 1e-10) -> DataFrame:
    return m.where(F.abs("v") > threshold)


def sparsity(m: DataFrame, rows: int, cols: int) -> float:
    return 1.0 - m.count() / (rows * cols) if rows * cols else 0.0


def to_csr(m: DataFrame) -> DataFrame:
    """(i, offset, cols, values): one row of the matrix a row; offset is the running count of what lies above."""
    rows = m.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("r"))
    # counts of rows are summed range by range, not over one global window
    sized = rows.select("i", F.size("r").cast("long").alias("n"), F.expr("i div 4096").alias("b"))
    blocks = sized.groupBy("b").agg(F.sum("n").alias("t")).withColumn("base", F.coalesce(F.sum("t").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("b").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sized.withColumn("o", inner).join(blocks, "b").select("i", (F.col("o") + F.col("base")).alias("offset"))
    return rows.join(offsets, "i").select("i", "offset", F.col("r.j").alias("cols"), F.col("r.v").alias("values"))


def from_csr(csr: DataFrame) -> DataFrame:
    return csr.select("i", F.explode(F.arrays_zip("cols", "values")).alias("x")).select("i", F.col("x.cols").alias("j"), F.col("x.values").alias("v"))


def degree(m: DataFrame) -> DataFrame:
    """(i, d): entries a row."""
    return m.groupBy("i").agg(F.count("*").alias("d"))


def laplacian(graph: Graph) -> DataFrame:
    """Degrees on the diagonal, minus the symmetrised weights elsewhere."""
    e = graph.edges.where("src <> dst").select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("weight").alias("v"))
    both = e.union(transpose(e).select("i", "j", "v"))
    return canonical(both.select("i", "j", (-F.col("v")).alias("v")).union(both.select("i", F.col("i").alias("j"), "v")))


def self_loops(m: DataFrame, vertices: DataFrame) -> DataFrame:
    return canonical(m.union(vertices.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))))


def symmetric_normalized(m: DataFrame) -> DataFrame:
    """D^-1/2 A D^-1/2 of a canonical matrix, D being row sums."""
    d = m.groupBy("i").agg(F.sum("v").alias("d")).select("i", F.when(F.col("d") > 0, 1 / F.sqrt("d")).otherwise(0.0).alias("s"))
    return m.join(d, "i").join(d.select(F.col("i").alias("j"), F.col("s").alias("t")), "j").select("i", "j", (F.col("v") * F.col("s") * F.col("t")).alias("v"))


def power_iteration(m: DataFrame, ids: DataFrame, rounds: int = 100, tolerance: float = 1e-10, shift: float = 0.0, orthogonal_to_ones: bool = False) -> tuple[float, DataFrame]:
    """Largest eigenvalue by magnitude of (shift I - M), or of M for shift 0, with its vector x(j, x)."""
    n = ids.count()
    x = cut(ids.select(F.col("id").alias("j"), (1.0 + F.pmod(F.col("id") * 7919, F.lit(101)) / 101.0).alias("x")))
    value = before = 0.0
    for _ in range(rounds):
        y = ids.select(F.col("id").alias("i")).join(matvec(m, x), "i", "left").select(F.col("i").alias("j"), F.coalesce("v", F.lit(0.0)).alias("y")).join(x, "j")
        y = y.select("j", (F.col("y") if not shift else shift * F.col("x") - F.col("y")).alias("x"))
        if orthogonal_to_ones:
            y = cut(y)
            y = y.withColumn("x", F.col("x") - (y.agg(F.sum("x")).first()[0] or 0.0) / max(1, n))
        y = cut(y)
        value = y.agg(F.sqrt(F.coalesce(F.sum(F.col("x") * F.col("x")), F.lit(0.0)))).first()[0]
        if value == 0:
            return 0.0, y
        x = y.withColumn("x", F.col("x") / value)
        if abs(value - before) < tolerance:
            break
        before = value
    return value, x


def spectral_radius(graph: Graph, rounds: int = 100) -> float:
    return power_iteration(adjacency(graph), graph.vertices, rounds)[0]


def fiedler_vector(graph: Graph, rounds: int = 100) -> DataFrame:
    """x(j, x): the eigenvector of the Laplacian's second least eigenvalue, by power iteration on c I - L off the ones."""
    lap = cut(laplacian(graph))
    c = 2 * (lap.where("i = j").agg(F.max("v")).first()[0] or 0.0) + 1.0
    return power_iteration(lap, graph.vertices, rounds, shift=c, orthogonal_to_ones=True)[1]


def batch_block_diagonal(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """edges(graph_id, i, j, v) with sizes(graph_id, n) -> one block-diagonal matrix."""
    at = sizes.withColumn("o", F.coalesce(F.sum("n").over(Window.orderBy("graph_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return edges.join(at, "graph_id").select((F.col("i") + F.col("o")).alias("i"), (F.col("j") + F.col("o")).alias("j"), "v")


def pad_features(features: DataFrame) -> DataFrame:
    """features(graph_id, pos, x) padded with zero vectors to the longest graph."""
    top = features.groupBy("graph_id").agg(F.count("*").alias("n"))
    m, width = features.groupBy("graph_id").count().agg(F.max("count")).first()[0], features.agg(F.max(F.size("x"))).first()[0]
    slots = top.select("graph_id", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("pos"))
    return slots.join(features, ["graph_id", "pos"], "left").select("graph_id", "pos", F.coalesce("x", F.array_repeat(F.lit(0.0), width)).alias("x"))
