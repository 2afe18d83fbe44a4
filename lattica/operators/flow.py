"""Maximum flow, matching and minimum spanning forests."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import TooLarge
from ..graph import Graph
from ..iterate import Levels, cut, cut_with
from .traversal import DRIVER_EDGES, bfs, some

EPSILON = 1e-9


def _capacities(graph: Graph) -> DataFrame:
    """Capacities, summed over parallel edges."""
    return graph.arcs().where((F.col("weight") > EPSILON) & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.sum("weight").alias("capacity"))


def _between(graph: Graph, source: int, sink: int) -> DataFrame:
    """Capacities of the edges on some path from source to sink."""
    ahead, behind = bfs(graph, [source]).select("id"), bfs(graph.reversed(), [sink]).select("id")
    on = cut(ahead.join(behind, "id", "left_semi"))
    e = _capacities(graph)
    return e.join(on, e["src"] == on["id"], "left_semi").join(on, F.col("dst") == on["id"], "left_semi")


def max_flow(graph: Graph, source: int, sink: int, method: str = "push_relabel", limit: int = DRIVER_EDGES) -> float:
    """Value of a maximum flow.

    "push_relabel" runs as rounds over tables and has no bound; "dinic" and "edmonds_karp" augment paths in the
    driver over what lies between source and sink, of at most `limit` edges.
    """
    if source == sink:
        return 0.0
    if method == "push_relabel":
        return _push_relabel(_capacities(graph), source, sink)
    rows = _capacities(graph).limit(limit + 1).collect()
    if len(rows) > limit:  # paths are looked for only where the whole graph is too large
        rows = _between(graph, source, sink).limit(limit + 1).collect()
    if len(rows) > limit:
        raise TooLarge("use push_relabel")
    residual: dict[int, dict[int, float]] = {}
    for s, d, c in rows:
        residual.setdefault(s, {})[d] = residual.get(s, {}).get(d, 0.0) + c
        residual.setdefault(d, {}).setdefault(s, 0.0)
    return (_dinic if method == "dinic" else _edmonds_karp)(residual, source, sink)


def _levels(residual, source):
    level, queue = {source: 0}, deque([source])
    while queue:
        u = queue.popleft()
        for v, c in residual.get(u, {}).items():
            if c > EPSILON and v not in level:
                level[v] = level[u] + 1
                queue.append(v)
    return level


def _edmonds_karp(residual, source, sink) -> float:
    total = 0.0
    while True:
        parent, queue = {source: None}, deque([source])
        while queue and sink not in parent:
            u = queue.popleft()
            for v, c in residual.get(u, {}).items():
                if c > EPSILON and v not in parent:
                    parent[v] = u
                    queue.append(v)
        if sink not in parent:
            return total
        path, v = [], sink
        while parent[v] is not None:
            path.append((parent[v], v))
            v = parent[v]
        push = min(residual[u][w] for u, w in path)
        for u, w in path:
            residual[u][w] -= push
            residual[w][u] += push
        total += push


def _dinic(residual, source, sink) -> float:
    total = 0.0
    while sink in (level := _levels(residual, source)):
        open_ = {u: list(vs) for u, vs in residual.items()}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                push = min(residual[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    residual[a][b] -= push
                    residual[b][a] += push
                total += push
                path = [source]
                continue
            while open_.get(u) and not (residual[u][open_[u][-1]] > EPSILON and level.get(open_[u][-1]) == level[u] + 1):
                open_[u].pop()
            if open_.get(u):
                path.append(open_[u][-1])
            else:
                path.pop()
                if path:
                    open_[path[-1]].pop()
    return total


def _heights(res: DataFrame, sink: int) -> DataFrame:
    """(id, h): the distance to the sink along edges that are open, where there is one."""
    open_ = res.where(F.col("r") > EPSILON)
    front, found = cut_with(res.sparkSession.createDataFrame([(sink, 0)], "id long, h int"), some())
    seen, h = Levels(front), 0
    while found["rows"]:
        h += 1
        met = open_.join(front.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id")).distinct()
        front, found = cut_with(met.join(seen.all().select("id"), "id", "left_anti").withColumn("h", F.lit(h)), some())
        if found["rows"]:
            seen.add(front)
    return seen.all()


def _push_relabel(edges: DataFrame, source: int, sink: int) -> float:
    """Phases until no vertex that has an excess reaches the sink.

    In each, all vertices are relabelled by their distance to the sink, and push level by level, the highest first, along
    all admissible edges in order of dst.  What is left at a vertex then has to take a longer way.  For the value alone nothing need go back
    to the source, so edges at the source, once full, and edges out of the sink are left out.
    """
    one = cut(edges)
    both = one.select("src", "dst", F.col("capacity").alias("r")).union(one.select("dst", "src", F.lit(0.0)))
    res = cut(both.where((F.col("src") != source) & (F.col("dst") != source) & (F.col("src") != sink)).groupBy("src", "dst").agg(F.sum("r").alias("r")))
    excess = cut(one.where(F.col("src") == source).select(F.col("dst").alias("id"), F.col("capacity").alias("x")))
    while True:
        height = _heights(res, sink)
        active = excess.where((F.col("x") > EPSILON) & (F.col("id") != sink)).join(height, "id")
        top = active.agg(F.max("h")).first()[0]
        if top is None:
            return excess.where(F.col("id") == sink).agg(F.coalesce(F.sum("x"), F.lit(0.0))).first()[0]
        low = height.select(F.col("id").alias("dst"), F.col("h").alias("hd"))
        steps = cut(res.where(F.col("r") > EPSILON).join(height.where(F.col("h") <= top).withColumnRenamed("id", "src"), "src").join(low, "dst").where("h = hd + 1").select("src", "dst", "r", "h"))
        active = cut(active.select("id", "x", "h"))
        pushed = Levels(steps.select("src", "dst", F.col("r").alias("f")).limit(0))
        come = active.select("id", "x").limit(0)
        for h in range(top, 0, -1):
            own = active.where(F.col("h") == h).select("id", "x").union(come).groupBy(F.col("id").alias("src")).agg(F.sum("x").alias("x"))
            before = F.coalesce(F.sum("r").over(Window.partitionBy("src").orderBy("dst").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
            f = steps.where(F.col("h") == h).join(own, "src").withColumn("f", F.least(F.col("r"), F.col("x") - before)).where(F.col("f") > EPSILON).select("src", "dst", "f")
            f = cut(f)
            pushed.add(f)
            come = f.select(F.col("dst").alias("id"), F.col("f").alias("x"))
        moved = pushed.all()
        less = moved.select("src", "dst", -F.col("f")).union(moved.where(F.col("dst") != sink).select("dst", "src", "f"))
        res = cut(res.union(less).groupBy("src", "dst").agg(F.sum("r").alias("r")))
        excess = cut(excess.union(moved.select("dst", "f")).union(moved.select("src", -F.col("f"))).groupBy("id").agg(F.sum("x").alias("x")))


def bipartite_matching(edges: DataFrame) -> DataFrame:
    """edges(l, r) -> a maximum matching (l, r).

    Rounds of alternating breadth-first layers from all free left vertices, each reached vertex keeping one parent and
    one root; of the augmenting paths found, one for each root is taken, so those taken are disjoint.
    """
    e = cut(edges.select("l", "r").distinct())
    # a greedy start: mutual least choices
    match = e.limit(0)
    while True:
        left_free = e.join(match.select("l"), "l", "left_anti").join(match.select("r"), "r", "left_anti")
        pick = left_free.groupBy("l").agg(F.min("r").alias("r")).groupBy("r").agg(F.min("l").alias("l")).select("l", "r")
        new, found = cut_with(pick, F.count(F.lit(1)).alias("rows"))
        if not found["rows"]:
            break
        match = cut(match.unionByName(new))
    while True:
        free = e.select("l").distinct().join(match.select("l"), "l", "left_anti")
        front = cut(free.select("l", F.col("l").alias("root"), F.array().cast("array<struct<l:bigint,r:bigint>>").alias("path")))
        seen = e.select("r").limit(0)
        found = None
        while not front.isEmpty():
            kinds = dict(e.dtypes)
            step = front.join(e, "l").join(seen, "r", "left_anti")
            step = step.groupBy("r").agg(F.min_by(F.struct("l", "root", "path"), F.struct("root", "l")).alias("b"))
            step = cut(step.select("r", "b.root", F.concat("b.path", F.array(F.struct(F.col("b.l").cast("long").alias("l"), F.col("r").cast("long").alias("r")))).alias("path")))
            ends = cut(step.join(match.select("r"), "r", "left_anti").groupBy("root").agg(F.min_by("path", "r").alias("path")))
            if not ends.isEmpty():
                found = ends
                break
            seen = cut(seen.unionByName(step.select("r")))
            front = cut(step.join(match, "r").select(F.col("l").cast(kinds["l"]), "root", "path"))
        if found is None:
            return match
        # paths of different roots share no right vertex, as each keeps one parent; the alternate edges swap
        steps = cut(found.select(F.explode("path").alias("p")).select("p.l", "p.r"))
        match = cut(match.join(steps.select("l"), "l", "left_anti").unionByName(steps))
    return match


def maximal_matching(graph: Graph) -> DataFrame:
    """(edge_id, src, dst) of a matching to which no edge can be added: rounds of mutually heaviest edges, then least edge_id.

    It is not always of the greatest size; maximum_matching() is.
    """
    e = cut(graph.edges.where("src <> dst").select("edge_id", "src", "dst", "weight"))
    out = Levels(cut(e.limit(0)))
    while not e.isEmpty():
        best = F.min(F.struct((-F.col("weight")).alias("w"), F.col("edge_id").alias("e"))).alias("b")
        ends = e.select(F.col("src").alias("id"), "weight", "edge_id").union(e.select("dst", "weight", "edge_id")).groupBy("id").agg(best).select("id", F.col("b.e").alias("e"))
        won = cut(e.join(ends.select(F.col("id").alias("src"), F.col("e").alias("a")), "src").join(ends.select(F.col("id").alias("dst"), F.col("e").alias("b")), "dst").where("edge_id = a and edge_id = b").select("edge_id", "src", "dst", "weight"))
        out.add(won)
        used = cut(won.select(F.col("src").alias("id")).union(won.select("dst")))
        e = cut(e.join(used, e["src"] == used["id"], "left_anti").join(used, F.col("dst") == used["id"], "left_anti"))
    return out.all().select("edge_id", "src", "dst")


def maximum_matching(graph: Graph, limit: int = DRIVER_EDGES) -> DataFrame:
    """(edge_id, src, dst) of a matching of the greatest size, by Edmonds' blossoms; parallel edges give their first.

    It grows one alternating forest at a time in the driver, over at most `limit` edges; maximal_matching() has no bound.
    """
    rows = graph.edges.where("src <> dst").orderBy("edge_id").select("edge_id", "src", "dst").limit(limit + 1).collect()
    if len(rows) > limit:
        raise TooLarge("use maximal_matching")
    first: dict[frozenset, int] = {}
    near: dict[int, list[int]] = {}
    for e, s, d in rows:
        if frozenset((s, d)) not in first:
            first[frozenset((s, d))] = e
            near.setdefault(s, []).append(d)
            near.setdefault(d, []).append(s)
    mate = _blossoms(near)
    chosen = [(first[frozenset((a, b))], a, b) for a, b in mate.items() if a < b]
    ends = {e: (s, d) for e, s, d in rows}
    return graph.edges.sparkSession.createDataFrame([(e, *ends[e]) for e, _, _ in sorted(chosen)], "edge_id long, src long, dst long")


def _blossoms(near: dict[int, list[int]]) -> dict[int, int]:
    """Partner of each matched vertex."""
    mate: dict[int, int] = {}
    for root in near:
        if root in mate:
            continue
        base = {v: v for v in near}  # of the blossom that a vertex lies in
        parent: dict[int, int] = {}
        outer, queue = {root}, deque([root])

        def common(a: int, b: int) -> int:
            """The base at which the paths of a and b to the root meet."""
            above = set()
            while True:
                a = base[a]
                above.add(a)
                if a not in mate:
                    break
                a = parent[mate[a]]
            while base[b] not in above:
                b = parent[mate[base[b]]]
            return base[b]

        def shrink(v: int, top: int, child: int, inside: set[int]) -> None:
            while base[v] != top:
                inside |= {base[v], base[mate[v]]}
                parent[v] = child
                child = mate[v]
                v = parent[child]

        end = None
        while queue and end is None:
            v = queue.popleft()
            for w in near[v]:
                if base[v] == base[w] or mate.get(v) == w:
                    continue
                if w == root or (w in mate and mate[w] in parent):
                    top, inside = common(v, w), set()
                    shrink(v, top, w, inside)
                    shrink(w, top, v, inside)
                    for x in near:
                        if base[x] in inside:
                            base[x] = top
                            if x not in outer:
                                outer.add(x)
                                queue.append(x)
                elif w not in parent:
                    parent[w] = v
                    if w not in mate:
                        end = w
                        break
                    outer.add(mate[w])
                    queue.append(mate[w])
        while end is not None:
            v = parent[end]
            after = mate.get(v)
            mate[end], mate[v] = v, end
            end = after
    return mate


def minimum_spanning_forest(graph: Graph) -> DataFrame:
    """(edge_id, src, dst, weight) by Boruvka's rounds; ties by edge_id, so the forest is the one Kruskal's stable order takes."""
    from .community import connected_components

    part = cut(graph.vertices.select("id", F.col("id").alias("c")))
    e = cut(graph.edges.where("src <> dst").select("edge_id", "src", "dst", "weight"))
    chosen = e.limit(0)
    while True:
        a, b = part.select(F.col("id").alias("src"), F.col("c").alias("ca")), part.select(F.col("id").alias("dst"), F.col("c").alias("cb"))
        cross = cut(e.join(a, "src").join(b, "dst").where("ca <> cb"))
        if cross.isEmpty():
            break
        row = F.struct("weight", "edge_id", "src", "dst")
        best = cross.select(F.col("ca").alias("c"), row.alias("x")).union(cross.select("cb", row)).groupBy("c").agg(F.min("x").alias("x")).select("x.edge_id", "x.src", "x.dst", "x.weight").distinct()
        chosen = cut(chosen.unionByName(best))
        part = connected_components(Graph(graph.vertices, chosen, False)).select("id", F.col("component").alias("c"))
        e = cross.select("edge_id", "src", "dst", "weight")
    return chosen
