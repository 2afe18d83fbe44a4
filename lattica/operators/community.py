"""Components, label propagation, modularity and Louvain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..iterate import Control, cut, cut_with


def connected_components(graph: Graph, control: Control | None = None) -> DataFrame:
    """(id, component): weak components, named by their least id.

    Each round takes the least label among a vertex and its neighbours, then jumps to that label's own label, so the
    rounds grow with the logarithm of the diameter.
    """
    ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = cut(graph.edges.where("src <> dst").select(F.explode(ways).alias("e")).select("e.src", "e.dst").distinct().repartition("src"))
    labels = cut(graph.vertices.select("id", F.col("id").alias("c")))
    k = 0
    while True:
        if control:
            control.check(k)
        k += 1
        near = both.join(labels, both["dst"] == labels["id"]).groupBy("src").agg(F.min("c").alias("m"))
        hooked = labels.join(near, labels["id"] == near["src"], "left").select("id", "c", F.least("c", F.coalesce("m", "c")).alias("h"))
        # a root also takes the least label that any of its members met
        roots = hooked.groupBy("c").agg(F.min("h").alias("r")).withColumnRenamed("c", "k")
        new = hooked.join(roots, hooked["h"] == roots["k"], "left").select("id", F.least("h", F.coalesce("r", "h")).alias("c"), (F.least("h", F.coalesce("r", "h")) < F.col("c")).alias("up"))
        new, moved = cut_with(new, F.count_if("up").alias("rows"))
        labels = new.select("id", "c")
        if not moved["rows"]:
            return labels.select("id", F.col("c").alias("component"))


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count("*").alias("size"))


def largest_component(components: DataFrame):
    return component_sizes(components).orderBy(F.desc("size"), "component").first()


def renumber(components: DataFrame) -> DataFrame:
    """Dense numbers 0, 1, ... in order of the components' names: counts of ranges of names, then ranks within them."""
    names = cut(components.select("component").distinct().repartitionByRange("component").withColumn("r", F.spark_partition_id()))
    sizes = names.groupBy("r").count().withColumn("base", F.coalesce(F.sum("count").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = names.withColumn("n", F.row_number().over(Window.partitionBy("r").orderBy("component")) - 1).join(sizes, "r")
    return components.join(ranked.select("component", (F.col("base") + F.col("n")).alias("number")), "component").select("id", "number")


def label_propagation(graph: Graph, max_iterations: int = 10) -> DataFrame:
    """(id, label): synchronous rounds; each vertex takes its out-neighbours' commonest label, the least on ties."""
    arcs = cut(graph.arcs().select("src", "dst"))
    labels = cut(graph.vertices.select("id", F.col("id").alias("label")))
    for _ in range(max_iterations):
        votes = arcs.join(labels, arcs["dst"] == labels["id"]).groupBy("src", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("src").agg(F.min(F.struct(-F.col("n"), "label")).alias("b"))
        new = labels.join(best, labels["id"] == best["src"], "left").select("id", F.coalesce("b.label", "label").alias("label"), F.col("label").alias("old"))
        new, moved = cut_with(new, F.count_if(F.col("label") != F.col("old")).alias("rows"))
        labels = new.select("id", "label")
        if not moved["rows"]:
            break
    return labels


def _weights(graph: Graph) -> DataFrame:
    """Undirected weights, both ways; loops count twice at their vertex."""
    e = graph.edges.select("src", "dst", "weight")
    return e.union(e.select("dst", "src", "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("w"))


def modularity(graph: Graph, communities: DataFrame, resolution: float = 1.0) -> float:
    """Q of communities(id, community), from each community's inner weight and total degree."""
    w = _weights(graph)
    c = communities.select("id", "community")
    a = w.join(c, w["src"] == c["id"]).select("dst", "w", F.col("community").alias("a"))
    ab = a.join(c, a["dst"] == c["id"]).select("w", "a", F.col("community").alias("b"))
    rows = ab.groupBy("a").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("inner"))
    m2 = rows.agg(F.sum("k")).first()[0]
    if not m2:
        return 0.0
    return rows.select(F.sum(F.col("inner") / m2 - resolution * (F.col("k") / m2) * (F.col("k") / m2))).first()[0]


def louvain(graph: Graph, resolution: float = 1.0, max_sweeps: int = 10, levels: int = 5, tolerance: float = 1e-6) -> DataFrame:
    """(id, community): local moves by the standard gain, then communities are merged to vertices and moved again.

    All vertices move at once, of alternating halves by hash, so that two never swap; a sweep that does not raise the modularity is taken back.
    """
    w = cut(_weights(graph))
    m2 = w.agg(F.sum("w")).first()[0]
    member = cut(graph.vertices.select("id", F.col("id").alias("community")))
    if not m2:
        return member
    level_graph = w
    for _ in range(levels):
        k = cut(level_graph.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")))
        state = cut(k.select("id", F.col("id").alias("c"), "k"))

        def quality(s: DataFrame) -> float:
            e = level_graph.join(s.select(F.col("id").alias("src"), F.col("c").alias("a")), "src").join(s.select(F.col("id").alias("dst"), F.col("c").alias("b")), "dst")
            inner = e.where("a = b").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0] / m2
            return inner - resolution * s.groupBy("c").agg(F.sum("k").alias("t")).agg(F.sum((F.col("t") / m2) ** 2)).first()[0]

        q, moved = quality(state), False
        for sweep in range(max_sweeps):
            tot = state.groupBy("c").agg(F.sum("k").alias("t"))
            near = level_graph.where("src <> dst").join(state.select(F.col("id").alias("dst"), "c"), "dst").groupBy(F.col("src").alias("id"), "c").agg(F.sum("w").alias("kc"))
            own = state.select("id", F.col("c").alias("mine"), "k")
            gain = near.join(tot, "c").join(own, "id")
            gain = gain.withColumn("g", F.col("kc") - resolution * F.col("k") * (F.col("t") - F.when(F.col("c") == F.col("mine"), F.col("k")).otherwise(0.0)) / m2)
            stay = gain.groupBy("id").agg(F.max(F.when(F.col("c") == F.col("mine"), F.col("g"))).alias("g0"), F.min(F.struct((-F.col("g")).alias("n"), "c")).alias("b"))
            half = F.pmod(F.xxhash64("id"), F.lit(2)) == sweep % 2
            go = half & (-F.col("b.n") > F.coalesce("g0", -resolution * F.col("k") * 0.0) + 1e-12)
            new = cut(state.join(stay, "id", "left").select("id", F.when(go, F.col("b.c")).otherwise(F.col("c")).alias("c"), "k"))
            got = quality(new)
            if got > q + tolerance:
                state, q, moved = new, got, True
            elif sweep % 2:
                break
        if not moved:
            break
        names = state.select(F.col("id").alias("community"), "c")
        member = cut(member.join(names, "community", "left").select("id", F.coalesce("c", "community").alias("community")))
        s = state.select("id", "c")
        level_graph = cut(level_graph.join(s.select(F.col("id").alias("src"), F.col("c").alias("a")), "src").join(s.select(F.col("id").alias("dst"), F.col("c").alias("b")), "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")))
    # named by their least member
    least = member.groupBy("community").agg(F.min("id").alias("least"))
    return member.join(least, "community").select("id", F.col("least").alias("community"))
