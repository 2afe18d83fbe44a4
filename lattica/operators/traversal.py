"""Breadth-first levels, reachability, topological order, simple paths and strong components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import GraphHasCycle, TooLarge
from ..graph import Graph
from ..iterate import Control, Levels, cut, cut_with

DRIVER_EDGES = 200_000  # bound of the algorithms whose order is sequential by nature


def some() -> Column:
    return F.count(F.lit(1)).alias("rows")


def bfs(graph: Graph, sources: list[int] | DataFrame, max_depth: int | None = None, expand: Column | None = None, control: Control | None = None) -> DataFrame:
    """(id, depth, parent) of all that the sources reach; parent is the least neighbour of the level before.

    Sources are ids, or a table with a column id.  Vertices that fail `expand` (a condition on id and depth) are reached but not gone beyond.
    Each level is one join, one aggregation and one anti-join, written once.
    """
    spark = graph.edges.sparkSession
    arcs = cut(graph.arcs().select("src", "dst").distinct().repartition("src"))
    given = sources.select("id").distinct() if isinstance(sources, DataFrame) else spark.createDataFrame([(s,) for s in dict.fromkeys(sources)], "id long")
    start = given.select("id", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent"))
    front, found = cut_with(start.join(graph.vertices.select("id"), "id", "left_semi"), some())
    seen, depth = Levels(front), 0
    while found["rows"] and (max_depth is None or depth < max_depth):
        if control:
            control.check(depth)
        depth += 1
        open_ = front if expand is None else front.where(expand)
        met = open_.join(arcs, open_["id"] == arcs["src"]).groupBy(F.col("dst").alias("id")).agg(F.lit(depth).alias("depth"), F.min("src").alias("parent"))
        front, found = cut_with(met.join(seen.all().select("id"), "id", "left_anti"), some())
        if found["rows"]:
            seen.add(front)
    return seen.all()


def all_pairs_hops(graph: Graph, sources: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """(source, id, depth) by frontiers of all sources(id) at once; pass few sources on large graphs."""
    arcs = cut(graph.arcs().select("src", "dst").where("src <> dst").distinct())
    start = (graph.vertices if sources is None else sources).select(F.col("id").alias("source"))
    front, found = cut_with(start.select("source", F.col("source").alias("id"), F.lit(0).alias("depth")), some())
    seen, depth = Levels(front), 0
    while found["rows"] and (max_depth is None or depth < max_depth):
        depth += 1
        met = front.join(arcs, front["id"] == arcs["src"]).select("source", F.col("dst").alias("id")).distinct()
        front, found = cut_with(met.join(seen.all().select("source", "id"), ["source", "id"], "left_anti").withColumn("depth", F.lit(depth)), some())
        if found["rows"]:
            seen.add(front)
    return seen.all()


def topological_levels(graph: Graph) -> DataFrame:
    """(id, level), level being the longest path into the vertex; raises GraphHasCycle.

    Each round takes away the vertices without in-edges: their out-edges lower the counts of what they point to.
    """
    arcs = cut(graph.edges.select("src", "dst").repartition("src"))
    into = arcs.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("left"))
    state = graph.vertices.select("id").join(into, "id", "left").select("id", F.coalesce("left", F.lit(0)).alias("left"))
    rest, n = cut_with(state, some(), F.coalesce(F.sum((F.col("left") == 0).cast("long")), F.lit(0)).alias("free"))
    level, out = 0, Levels(rest.where("left = 0").select("id", F.lit(0).alias("level")))
    while n["rows"]:
        if not n["free"]:
            raise GraphHasCycle(f"{n['rows']} vertices are on or behind a cycle")
        free = rest.where("left = 0").select("id")
        fewer = free.join(arcs, free["id"] == arcs["src"]).groupBy("dst").agg(F.count("*").alias("gone"))
        state = rest.where("left > 0").join(fewer, F.col("id") == F.col("dst"), "left").select("id", (F.col("left") - F.coalesce("gone", F.lit(0))).alias("left"))
        rest, n = cut_with(state, some(), F.coalesce(F.sum((F.col("left") == 0).cast("long")), F.lit(0)).alias("free"))
        level += 1
        if n["free"]:
            out.add(rest.where("left = 0").select("id", F.lit(level).alias("level")))
    return out.all()


def topological_sort(graph: Graph) -> DataFrame:
    """(id, level) whose order by (level, id) is topological."""
    return topological_levels(graph).orderBy("level", "id")


def all_paths(graph: Graph, source: int, target: int, max_len: int) -> DataFrame:
    """(path) of every simple path from source to target of at most max_len edges."""
    arcs = cut(graph.arcs().select("src", "dst").distinct())
    back = bfs(graph.reversed(), [target], max_len).select(F.col("id").alias("dst"), F.col("depth").alias("_left"))
    front = graph.vertices.where(F.col("id") == source).select(F.array("id").alias("path"))
    out = front.where(F.lit(source == target))
    for k in range(max_len):
        ends = front.withColumn("src", F.element_at("path", -1)).where(F.col("src") != target)
        step = ends.join(arcs, "src").join(back, "dst").where((F.col("_left") <= max_len - k - 1) & ~F.array_contains("path", F.col("dst")))
        front, found = cut_with(step.select(F.concat("path", F.array("dst")).alias("path")), some())
        if not found["rows"]:
            break
        out = out.unionByName(front.where(F.element_at("path", -1) == target))
    return out


def strong_components(graph: Graph) -> DataFrame:
    """(id, scc): scc is the greatest id of the strong component.

    Colours (the greatest id that reaches a vertex) spread forward; from each colour's root, what reaches
    it backward within the colour is one component.  Vertices with no edge in or out that counts are peeled first.
    """
    rest, arcs, out = cut(graph.vertices.select("id")), cut(graph.arcs().select("src", "dst").where("src <> dst").distinct()), None
    while not rest.isEmpty():
        while True:  # single vertices
            lone = cut(rest.join(arcs.select(F.col("src").alias("id")).distinct(), "id", "left_semi").join(arcs.select(F.col("dst").alias("id")).distinct(), "id", "left_semi"))
            single = cut(rest.join(lone, "id", "left_anti").withColumn("scc", F.col("id")))
            if single.isEmpty():
                break
            out = single if out is None else out.unionByName(single)
            rest = lone
            arcs = cut(arcs.join(rest, arcs["src"] == rest["id"], "left_semi").join(rest, F.col("dst") == rest["id"], "left_semi"))
        if rest.isEmpty():
            break
        color = cut(rest.withColumn("color", F.col("id")))
        while True:
            best = arcs.join(color, arcs["src"] == color["id"]).groupBy("dst").agg(F.max("color").alias("_c"))
            new = color.join(best, color["id"] == best["dst"], "left").select("id", F.greatest("color", F.coalesce("_c", "color")).alias("color"), (F.col("_c") > F.col("color")).alias("up"))
            new, moved = cut_with(new, F.count_if("up").alias("rows"))
            color = new.select("id", "color")
            if not moved["rows"]:
                break
        a, b = color.select(F.col("id").alias("src"), F.col("color").alias("ca")), color.select(F.col("id").alias("dst"), F.col("color").alias("cb"))
        inner = cut(arcs.join(a, "src").join(b, "dst").where("ca = cb").select("src", "dst"))
        found = cut(color.where("id = color"))
        front = found
        while True:
            met = inner.join(front, inner["dst"] == front["id"]).select(F.col("src").alias("id"), "color").distinct()
            front, more = cut_with(met.join(found.select("id"), "id", "left_anti"), some())
            if not more["rows"]:
                break
            found = cut(found.unionByName(front))
        got = found.select("id", F.col("color").alias("scc"))
        out = got if out is None else out.unionByName(got)
        ids = found.select("id")
        rest = cut(rest.join(ids, "id", "left_anti"))
        arcs = cut(arcs.join(ids, arcs["src"] == ids["id"], "left_anti").join(ids, F.col("dst") == ids["id"], "left_anti"))
    return out if out is not None else graph.vertices.select("id", F.col("id").alias("scc"))


def dfs_topological_sort(graph: Graph) -> list[int]:
    """Vertices by falling finish time of a depth-first search over all starts, of a graph of at most DRIVER_EDGES edges; raises GraphHasCycle."""
    rows = dfs(graph)
    finish = {r["id"]: r["finish"] for r in rows}
    _, out = _adjacency(graph)
    if any(finish[d] >= finish[s] for s, own in out.items() for d in own):
        raise GraphHasCycle("an edge leads to a vertex that is finished later")
    return sorted(finish, key=finish.get, reverse=True)


def _adjacency(graph: Graph, limit: int = DRIVER_EDGES) -> tuple[list[int], dict[int, list[int]]]:
    rows = graph.arcs().orderBy("edge_id").select("src", "dst").limit(limit + 1).collect()
    if len(rows) > limit:
        raise TooLarge(f"more than {limit} edges; use bfs() for reachability")
    nodes = sorted(r.id for r in graph.vertices.select("id").limit(limit + 1).collect())
    out: dict[int, list[int]] = {n: [] for n in nodes}
    for s, d in rows:
        out[s].append(d)
    return nodes, out


def dfs(graph: Graph, start: int | None = None, visit=None) -> list[dict]:
    """Depth-first visits in order, with discovery and finish times, of a graph of at most DRIVER_EDGES edges.

    The last neighbour is visited first.  Without start, every vertex is a start in turn.  A `visit` that returns False ends it.
    """
    nodes, out = _adjacency(graph)
    seen, rows, clock = set(), [], 0
    for root in [start] if start is not None else nodes:
        if root in seen:
            continue
        stack = [(root, None, False)]
        where = {}
        while stack:
            node, parent, leaving = stack.pop()
            if leaving:
                clock += 1
                where[node]["finish"] = clock
                continue
            if node in seen:
                continue
            seen.add(node)
            clock += 1
            where[node] = {"id": node, "parent": parent, "root": root, "discovery": clock, "finish": None}
            rows.append(where[node])
            if visit is not None and visit(node) is False:
                return rows
            stack.append((node, None, True))
            stack.extend((n, node, False) for n in out[node] if n not in seen)
    return rows
