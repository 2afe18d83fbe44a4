"""Graph operators on the literal graphs of FIXTURES.md, and properties of the small kernels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.errors import GraphError, GraphHasCycle, NegativeCycle, NodeDeleted, NodeNotFound, TooLarge
from lattica.functions import autograd, decoder, decompose, differentiable, matrix, transformer
from lattica.graph import Graph
from lattica.operators import centrality, community, flow, model, partition, paths, structure, traversal
from lattica.plans.registry import Catalog, builtin
from lattica.sources import generators, tensors, text


def build(spark, n, edges, directed=True):
    return Graph.build(spark, list(range(n)), [(*e, 1.0) if len(e) == 2 else e for e in edges], directed)


SP4 = [(0, 1, 1.0), (0, 2, 4.0), (1, 2, 2.0), (1, 3, 5.0), (2, 3, 1.0)]


def ids(df, *columns):
    return {r[0]: r[1] for r in df.select(*columns).collect()}


def test_editing(spark):
    g = build(spark, 3, [(0, 1), (1, 2), (0, 1)])
    assert (g.node_count(), g.edge_count(), g.has_edge(0, 1), g.edge_endpoints(1)) == (3, 3, True, (1, 2))
    assert g.remove_edge(0).edge_count() == 2 and g.remove_node(1).edge_count() == 0 and g.node_count() == 3
    h, node = g.add_node(label="new")
    assert node == 3 and h.add_edge(3, 0)[0].edge_count() == 4
    with pytest.raises(NodeNotFound):
        g.add_edge(0, 9)
    with pytest.raises(NodeDeleted):
        g.get_node(0, gen=2)
    assert [r.id for r in g.neighbors(0).collect()] == [1, 1] and [r.id for r in g.neighbors(2, "in").collect()] == [1]


def test_traversal(spark):
    g = build(spark, 5, [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4)])
    assert ids(traversal.bfs(g, [0]), "id", "depth") == {0: 0, 1: 1, 2: 1, 3: 2, 4: 3}
    assert ids(traversal.topological_levels(g), "id", "level") == {0: 0, 1: 1, 2: 1, 3: 2, 4: 3}
    assert sorted(r.path for r in traversal.all_paths(g, 0, 4, 5).collect()) == [[0, 1, 3, 4], [0, 2, 3, 4]]
    assert [r["id"] for r in traversal.dfs(g, 0)] == [0, 2, 3, 4, 1]
    with pytest.raises(GraphHasCycle):
        traversal.topological_levels(build(spark, 2, [(0, 1), (1, 0)]))
    scc = build(spark, 8, [(0, 1), (1, 3), (3, 0), (0, 4), (4, 0), (5, 6), (6, 5), (2, 5), (5, 7)])
    assert ids(traversal.strong_components(scc), "id", "scc") == {0: 4, 1: 4, 3: 4, 4: 4, 5: 6, 6: 6, 2: 2, 7: 7}


def test_paths(spark):
    g = build(spark, 4, SP4)
    assert ids(paths.dijkstra(g, 0), "id", "distance") == {0: 0, 1: 1, 2: 3, 3: 4}
    assert paths.astar(g, 0, 3, F.abs(F.lit(3) - F.col("id")) * 0.5) == ([0, 1, 2, 3], 4.0)
    assert paths.validate_path(g, [0, 1, 2, 3], 4.0)
    with pytest.raises(NegativeCycle):
        paths.bellman_ford(build(spark, 3, [(0, 1, 1.0), (1, 2, -2.0), (2, 0, -3.0)]), 0)


def test_flow_and_matching(spark):
    g = build(spark, 4, [(0, 1, 10.0), (0, 2, 5.0), (1, 2, 4.0), (1, 3, 6.0), (2, 3, 10.0)])
    assert [flow.max_flow(g, 0, 3, m) for m in ("push_relabel", "dinic", "edmonds_karp")] == [15.0] * 3
    t = build(spark, 4, [(0, 1, 1.0), (0, 2, 4.0), (1, 2, 2.0), (1, 3, 5.0), (2, 3, 3.0)], False)
    assert flow.minimum_spanning_forest(t).agg(F.sum("weight")).first()[0] == 6.0
    e = spark.createDataFrame([(0, 10), (0, 11), (1, 10), (2, 11), (2, 12), (3, 12)], "l long, r long")
    assert flow.bipartite_matching(e).count() == 3


def test_structure(spark):
    ring = build(spark, 5, [(i, (i + 1) % 5) for i in range(5)])
    assert (structure.girth(ring), structure.girth(ring.undirected()), structure.diameter(ring), structure.is_bipartite(ring), structure.is_connected(ring)) == (5, 5, 4, False, True)
    assert structure.is_tree(generators.binary_tree(spark, 3)) and structure.is_bipartite(generators.grid(spark, 3, 3))
    k5 = generators.complete_graph(spark, 5)
    assert {r.component for r in community.connected_components(k5).collect()} == {0}
    assert all(abs(r.betweenness) < 1e-9 for r in centrality.betweenness_centrality(k5).collect())


def test_louvain_splits_two_cliques(spark):
    e = [(a + o, b + o) for o in (0, 4) for a in range(4) for b in range(a + 1, 4)] + [(0, 4)]
    got = ids(community.louvain(build(spark, 8, e, False)), "id", "community")
    assert got == {i: 0 if i < 4 else 4 for i in range(8)}


def test_registry_and_catalog(spark):
    r = builtin()
    assert len(r.names()) == 10 and "pagerank" in r.find_by_tag("centrality")
    with pytest.raises(ValueError):
        r.execute("pagerank", build(spark, 2, [(0, 1)]), damping=7)
    c = Catalog(spark)
    c.create_graph("x")
    for _ in range(3):
        c.add_node("x")
    assert c.graph_info("x")["nodes"] == 3


def test_partitions_and_breaker(spark):
    g = generators.path(spark, 10)
    s = partition.partition_stats(g, partition.range_partition(5, 2))
    assert partition.is_balanced(s, 1.0) and s.agg(F.sum("boundary")).first()[0] == 2
    calls = []
    assert partition.execute_with_retry(lambda: calls.append(1) or (1 / (len(calls) - 1) and 7), first_delay=0.0) == 7
    b = partition.CircuitBreaker(2, 10, lambda: 0)
    b.record(False), b.record(False)
    assert not b.is_allowed()


def test_kernels():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(4, 4))
    q, r = decompose.qr(a)
    assert np.allclose(q @ r, a) and decompose.orthogonality_error(q) < 1e-12 and (np.diag(r) >= 0).all()
    e = decompose.lie_exponential(decompose.skew(a))
    assert np.allclose(e.T @ e, np.eye(4)) and decompose.orthogonality_error(decompose.cayley(a)) < 1e-12
    assert np.allclose(decompose.tensor_ring_reconstruct(decompose.tensor_ring(a, 4)), a)
    x, w = autograd.Tensor(rng.normal(size=(3, 4))), autograd.Tensor(rng.normal(size=(4, 2)))
    loss = lambda m: ((x @ autograd.Tensor(m)).gelu().softmax() * autograd.Tensor(np.arange(6).reshape(3, 2))).sum()
    ((x @ w).gelu().softmax() * autograd.Tensor(np.arange(6).reshape(3, 2))).sum().backward()
    h = np.zeros((4, 2))
    h[1, 1] = 1e-6
    assert abs((loss(w.value + h).value - loss(w.value - h).value) / 2e-6 - w.grad[1, 1]) < 1e-5


def test_tensor_files(spark, tmp_path):
    data = {"model.layers.0.attn.q_proj": np.arange(6.0).reshape(2, 3), "model.norm": np.ones(4)}
    tensors.write_safetensors(decompose.tensors_from(spark, data), str(tmp_path / "m.safetensors"))
    back = {r.name: np.array(r.data).reshape(tuple(r.shape)) for r in tensors.read_safetensors(spark, str(tmp_path / "m.safetensors")).collect()}
    assert all(np.allclose(back[k], v) for k, v in data.items())


def test_exports_and_models(spark):
    g = build(spark, 3, [(0, 1), (1, 2)])
    assert "0 -> 1" in text.to_dot(g) and text.to_svg(g).count("<circle") == 3 and text.to_svg(g, "force").count("<line") == 2
    two = build(spark, 4, [(0, 1), (2, 3)])
    ed = model.Editor(two)
    assert ed.connect_components() == 1 and structure.is_connected(ed.graph.undirected()) and ed.undo()
    t = transformer.token_graph(spark, 4, 2)
    assert transformer.prune_attention(t, 0.5).edge_count() < t.edge_count()
    e = differentiable.learnable(g.edges, 0.3)
    assert differentiable.prune_weak(e, 0.5).isEmpty()


def test_flows_of_small_networks(spark):
    none = build(spark, 2, [])
    one = build(spark, 3, [(0, 1, 5.0), (1, 2, 3.0)])
    three = build(spark, 5, [(0, 1, 10.0), (1, 4, 10.0), (0, 2, 5.0), (2, 4, 5.0), (0, 3, 3.0), (3, 4, 3.0)])
    for g, sink, value in ((none, 1, 0.0), (one, 2, 3.0), (three, 4, 18.0)):
        assert [flow.max_flow(g, 0, sink, m) for m in ("push_relabel", "dinic", "edmonds_karp")] == [value] * 3


def test_push_relabel_writes_few_tables(spark, monkeypatch):
    count = []
    for name in ("cut", "cut_with"):
        own = getattr(flow, name)
        monkeypatch.setattr(flow, name, lambda *a, own=own: count.append(1) or own(*a))
    full = build(spark, 5, [(i, j, float(20 + (7 * i + 3 * j) % 5)) for i in range(5) for j in range(5) if i != j])
    neck = build(spark, 8, [(i, i + 1, 1.0 if i == 6 else 9.0) for i in range(7)])  # what is pushed too far has to come back
    for g, sink in ((full, 4), (neck, 7)):
        count.clear()
        assert flow.max_flow(g, 0, sink) == flow.max_flow(g, 0, sink, "dinic")
        print("tables written", len(count))
        assert len(count) <= 40


def test_push_relabel_on_random_graphs(spark):
    rng = np.random.default_rng(18)
    for n in (6, 10):
        g = build(spark, n, [(int(a), int(b), float(c)) for a, b, c in zip(rng.integers(0, n, 3 * n), rng.integers(0, n, 3 * n), rng.integers(1, 9, 3 * n))])
        assert flow.max_flow(g, 0, n - 1) == flow.max_flow(g, 0, n - 1, "edmonds_karp")


def test_maximum_matching_against_all_subsets(spark):
    from functools import lru_cache

    rng = np.random.default_rng(7)
    for _ in range(60):
        n = int(rng.integers(2, 10))
        edges = [(int(a), int(b)) for a, b in rng.integers(0, n, (int(rng.integers(1, 16)), 2)) if a != b]
        near = {}
        for a, b in edges:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        mate = flow._blossoms(near)
        assert all(mate[mate[v]] == v and mate[v] in near[v] for v in mate)

        @lru_cache(None)
        def most(used):
            free = [v for v in range(n) if not used >> v & 1]
            if not free:
                return 0
            rest = used | 1 << free[0]
            return max([most(rest), *(1 + most(rest | 1 << w) for w in near.get(free[0], []) if not rest >> w & 1)])

        assert len(mate) // 2 == most(0)
    five = build(spark, 5, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (0, 1)])
    assert flow.maximum_matching(five).count() == 2 and flow.maximum_matching(build(spark, 2, [])).count() == 0


def test_paths_by_doubling(spark):
    chain = build(spark, 40, [(i, i + 1) for i in range(38)])
    found = paths.dijkstra(chain, 0)
    assert [paths.reconstruct_path(found, 0, t) for t in (0, 1, 6, 38, 39)] == [[0], [0, 1], list(range(7)), list(range(39)), []]


def test_depth_first_topological_order(spark):
    g = build(spark, 5, [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4)])
    order = traversal.dfs_topological_sort(g)
    assert sorted(order) == list(range(5)) and all(order.index(s) < order.index(d) for s, d in [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4)])
    with pytest.raises(GraphHasCycle):
        traversal.dfs_topological_sort(build(spark, 3, [(0, 1), (1, 2), (2, 0)]))


def test_searches_from_a_table_and_deep_graphs(spark):
    g = generators.path(spark, 40)
    deep = traversal.bfs(Graph(g.vertices, g.edges), spark.createDataFrame([(0,), (30,), (99,)], "id long"))
    assert ids(deep, "id", "depth") == {i: i if i < 30 else i - 30 for i in range(40)}
    assert model.gradient_flow(Graph(g.vertices, g.edges), F.col("id") == 3, F.col("id") == 39) and not model.gradient_flow(Graph(g.vertices, g.edges), F.col("id") == 5, F.col("id") == 3)
    assert structure.diameter(Graph(g.vertices, g.edges), spark.createDataFrame([(30,)], "id long")) == 9
    numbers = community.renumber(spark.createDataFrame([(1, 7), (2, 9), (3, 7), (4, 40)], "id long, component long"))
    assert ids(numbers, "id", "number") == {1: 0, 2: 1, 3: 0, 4: 2}


def test_random_graph_edges_are_evenly_drawn(spark):
    for directed in (True, False):
        e = [(r.src, r.dst) for r in generators.erdos_renyi(spark, 60, 0.3, directed).edges.collect()]
        assert len(e) == len(set(e)) and all(s != d and 0 <= s < 60 and 0 <= d < 60 and (directed or s < d) for s, d in e)
        assert abs(len(e) - (60 * 59 * 0.3 if directed else 30 * 59 * 0.3)) < 130
    assert generators.erdos_renyi(spark, 10, 0.0).edge_count() == 0 and generators.erdos_renyi(spark, 10, 1.0).edge_count() == 45


def tiny_weights(rng, hidden=4, vocabulary=6, inner=5, layers=2, keys=2):
    out = {"model.embed_tokens": (vocabulary, hidden), "model.norm": (hidden,), "lm_head": (vocabulary, hidden)}
    for i in range(layers):
        at = f"model.layers.{i}."
        out |= {at + "self_attn.q_proj": (hidden, hidden), at + "self_attn.k_proj": (hidden, keys), at + "self_attn.v_proj": (hidden, keys), at + "self_attn.o_proj": (hidden, hidden)}
        out |= {at + "mlp.gate_proj": (hidden, inner), at + "mlp.up_proj": (hidden, inner), at + "mlp.down_proj": (inner, hidden), at + "input_layernorm": (hidden,), at + "post_attention_layernorm": (hidden,)}
    return {f"{k}.weight": rng.normal(size=s) for k, s in out.items()}


def test_decoder_against_loops(spark):
    rng = np.random.default_rng(3)
    w = tiny_weights(rng)
    config = decoder.Config(2, 2, 1)
    m = decoder.build_model(decompose.tensors_from(spark, w), config)
    norm = lambda x, g: x / np.sqrt(np.mean(x**2) + 1e-6) * g

    def slow(tokens, causal):
        x = [w["model.embed_tokens.weight"][t] for t in tokens]
        for i in range(2):
            p = lambda n: w[f"model.layers.{i}.{n}.weight"]  # noqa: B023, E731
            h = [norm(v, p("input_layernorm")) for v in x]
            new = []
            for a in range(len(x)):
                heads = []
                for head in range(2):  # both query heads share the one key head
                    q = (h[a] @ p("self_attn.q_proj"))[2 * head : 2 * head + 2]
                    seen = range(a + 1) if causal else range(len(x))
                    e = np.exp([q @ (h[b] @ p("self_attn.k_proj")) / np.sqrt(2) for b in seen])
                    heads.append(sum(z * (h[b] @ p("self_attn.v_proj")) for z, b in zip(e / e.sum(), seen)))
                new.append(x[a] + np.concatenate(heads) @ p("self_attn.o_proj"))
            x = []
            for v in new:
                y = norm(v, p("post_attention_layernorm"))
                g = y @ p("mlp.gate_proj")
                x.append(v + (g / (1 + np.exp(-g)) * (y @ p("mlp.up_proj"))) @ p("mlp.down_proj"))
        return np.array([norm(v, w["model.norm.weight"]) @ w["lm_head.weight"].T for v in x])

    tokens = [1, 5, 0, 2]
    for causal in (False, True):
        assert np.allclose(m.logits(tokens, causal), slow(tokens, causal))
    # the first position is not turned, and turning keeps lengths
    x = rng.normal(size=(2, 5, 4))
    y = decoder.rotate(x, 10000.0, 3)
    assert np.allclose(y[:, 0], x[:, 0]) and np.allclose(np.linalg.norm(y, axis=-1), np.linalg.norm(x, axis=-1)) and not np.allclose(y[:, 1], x[:, 1])
    rows = decoder.forward(m, spark.createDataFrame([(7, tokens), (8, [3]), (9, [])], "seq long, tokens array<long>")).collect()
    assert {(r.seq, r.pos) for r in rows} == {(7, 0), (7, 1), (7, 2), (7, 3), (8, 0)}
    assert np.allclose([r.logit for r in sorted(rows) if r.seq == 7], m.logits(tokens).ravel())
    with pytest.raises(GraphError):
        decoder.build_model(decompose.tensors_from(spark, {k: v for k, v in w.items() if "q_proj" not in k}), config)
    with pytest.raises(TooLarge):
        decoder.build_model(decompose.tensors_from(spark, w), config, 100)


def test_generation_ends(spark):
    """The next token is the last one plus one, up to 5; two hypotheses compete for sequence 2."""
    def model(sequences):
        last = F.element_at("tokens", -1)
        steps = F.array(F.struct(F.least(last + 1, F.lit(5)).alias("token"), F.lit(3.0).alias("logit")), F.struct(F.lit(0).cast("long").alias("token"), F.lit(1.0).alias("logit")))
        keys = [c for c in ("seq", "beam") if c in sequences.columns]
        return sequences.select(*keys, F.explode(steps).alias("s")).select(*keys, "s.token", "s.logit")

    prompts = spark.createDataFrame([(1, [2]), (2, [4])], "seq long, tokens array<long>")
    out = ids(transformer.generate(model, prompts, 3, eos=5), "seq", "tokens")
    assert out == {1: [2, 3, 4], 2: [4]}
    assert ids(transformer.generate(model, prompts, 2), "seq", "tokens") == {1: [2, 3, 4], 2: [4, 5, 5]}
    assert ids(transformer.generate(model, prompts, 2, eos=5, min_length=1), "seq", "tokens")[2] == [4, 0, 1]
    beams = {r.seq: r for r in transformer.beam_search(model, prompts, 3, 2, eos=5).collect()}
    assert beams[1].tokens == [2, 3, 4] and beams[2].tokens == [4] and beams[2].score < 0
    drawn = ids(transformer.generate(model, prompts, 3, "sample", k=1, eos=5), "seq", "tokens")
    assert drawn == out


def test_checkpoint_to_graph_and_back(spark, tmp_path):
    w = tiny_weights(np.random.default_rng(1))
    path = "file://" + str(tmp_path / "model.safetensors")
    tensors.write_safetensors(decompose.tensors_from(spark, w), path)
    g = tensors.load_operator_graph(spark, path)
    assert g.node_count() == len(w) and structure.is_dag(g) and structure.is_connected(g)
    kinds = {r.label: r.kind for r in g.vertices.collect()}
    assert kinds["model.layers.1.self_attn.k_proj.weight"] == "Attention" and kinds["model.layers.0.mlp.up_proj.weight"] == "MLP" and kinds["model.embed_tokens.weight"] == "Embedding"
    order = [r.label for r in g.vertices.orderBy("id").collect()]
    assert order[0] == "model.embed_tokens.weight" and set(order[-2:]) == {"lm_head.weight", "model.norm.weight"}
    tensors.save_operator_graph(g, path + ".2")
    back = {r.name: np.array(r.data).reshape(tuple(r.shape)) for r in tensors.read_safetensors(spark, path + ".2").collect()}
    assert back.keys() == w.keys() and all(np.allclose(back[k], w[k], atol=1e-6) for k in w)
    large = {r.name: r.data for r in tensors.read_large_safetensors(spark, path[7:]).collect()}
    assert all(np.allclose(large[k], w[k].ravel(), atol=1e-6) for k in w)


def test_decompositions_and_health():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(6, 4))
    u, s, v = decompose.svd(a)
    assert np.allclose((u * s) @ v.T, a) and (np.diff(s) <= 0).all() and decompose.svd(a, 2)[2].shape == (4, 2)
    with pytest.raises(ValueError):
        decompose.svd(a, 5)
    assert decompose.is_skew_symmetric(decompose.skew(rng.normal(size=(3, 3)))) and not decompose.is_skew_symmetric(np.eye(2)) and not decompose.is_skew_symmetric(a)
    now = [0.0]
    h = partition.HealthChecker(["a", "b"], 5, lambda: now[0])
    h.heartbeat("a")
    assert h.failed() == ["b"] and h.healthy() == ["a"]
    now[0] = 6.0
    assert h.is_failed("a") and h.is_failed("never seen")


def test_structure_learning(spark):
    e = differentiable.learnable(build(spark, 3, [(0, 2, 1.0), (1, 2, 1.0)]).edges, 0.6)
    x = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 0.0)], "id long, x double")
    y = spark.createDataFrame([(2, 1.5)], "id long, y double")
    loss, g, gw = differentiable.linear_loss(e, x, y)
    assert abs(loss - (0.6 * 3 - 1.5) ** 2 / 2) < 1e-9
    assert ids(g, "src", "g") == pytest.approx({0: 0.3, 1: 0.6}) and ids(gw, "src", "gw") == pytest.approx({0: 0.18, 1: 0.36})
    kept, before = differentiable.joint_step(e, x, y, 0, 5)
    assert kept.count() == 2 and differentiable.linear_loss(kept, x, y)[0] < before
    with pytest.raises(TooLarge):
        matrix.dense_adjacency(build(spark, 3, []), 2)


def test_structure_optimization_descends(spark):
    e = differentiable.learnable(build(spark, 3, [(0, 1, 1.0), (0, 2, 1.0), (1, 2, 1.0)]).edges, 0.2 + 0.3 * (F.col("src") + F.col("dst") - 1))

    def loss_of(edges):  # least where every probability is 0 or 1
        p = F.col("prob")
        return edges.agg(F.sum(p * (1 - p))).first()[0], edges.select("src", "dst", (1 - 2 * p).alias("g"))

    kept, report = differentiable.optimize(e, loss_of, 3, 0.05)
    assert all(a > b for a, b in zip(report["losses"], report["losses"][1:])) and len(report["losses"]) == 4
    assert ids(kept, "src", "dst") == {1: 2} and report["pruned_edges"] == 2
