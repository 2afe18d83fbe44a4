"""Attention, masks, quantisation, generation filters, batching and caches as relational steps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import arrays


# masks: (i, j) of what position i may attend to
def causal_mask(spark: SparkSession, n: int) -> DataFrame:
    return sliding_window_mask(spark, n, n, True)


def sliding_window_mask(spark: SparkSession, n: int, window: int, causal: bool = True) -> DataFrame:
    """Causal: i-window+1 .. i; else i-window .. i+window-1."""
    low = F.greatest(F.lit(0).cast("long"), F.col("id") - (window - 1 if causal else window))
    high = F.col("id") if causal else F.least(F.lit(n - 1).cast("long"), F.col("id") + window - 1)
    return spark.range(n).select(F.col("id").alias("i"), F.explode(F.sequence(low, high)).alias("j"))


def block_sparse_mask(spark: SparkSession, n: int, block: int, blocks: int) -> DataFrame:
    """The last `blocks` blocks up to the own one, whole."""
    b = F.floor(F.col("id") / block)
    low = F.greatest(F.lit(0).cast("long"), (b - blocks + 1) * block)
    return spark.range(n).select(F.col("id").alias("i"), F.explode(F.sequence(low, F.least(F.lit(n - 1).cast("long"), (b + 1) * block - 1))).alias("j"))


def star_mask(spark: SparkSession, n: int, center_ratio: float, window: int = 64) -> DataFrame:
    """Centres (the first share of positions, rounded up) attend to all; the others to the centres and to i-window .. i+window-1."""
    centers = math.ceil(n * center_ratio)
    own = F.array_union(F.sequence(F.greatest(F.lit(0).cast("long"), F.col("id") - window), F.least(F.lit(n).cast("long"), F.col("id") + window) - 1), F.sequence(F.lit(0).cast("long"), F.lit(centers - 1).cast("long"))) if centers else F.sequence(F.greatest(F.lit(0).cast("long"), F.col("id") - window), F.least(F.lit(n).cast("long"), F.col("id") + window) - 1)
    every = F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    return spark.range(n).select(F.col("id").alias("i"), F.explode(F.when(F.col("id") < centers, every).otherwise(own)).alias("j"))


def apply_mask(scores: DataFrame, mask: DataFrame) -> DataFrame:
    """scores(i, j, v): minus infinity outside the mask."""
    return scores.join(mask.withColumn("_m", F.lit(True)), ["i", "j"], "left").select("i", "j", F.when(F.col("_m"), F.col("v")).otherwise(F.lit(float("-inf"))).alias("v"))


def attention(q: DataFrame, k: DataFrame, v: DataFrame, mask: DataFrame | None = None, groups: int = 1) -> DataFrame:
    """q, k, v(b, h, pos, x) -> (b, h, pos, x).  With groups > 1, query head h uses key head h div groups.

    A mask is an inner join, so only allowed pairs are ever scored.
    """
    a = q.select("b", "h", F.floor(F.col("h") / groups).cast("long").alias("g"), F.col("pos").alias("i"), F.col("x").alias("qx"))
    c = k.select("b", F.col("h").cast("long").alias("g"), F.col("pos").alias("j"), F.col("x").alias("kx"))
    if mask is not None:
        a = a.join(mask, "i")
        pairs = a.join(c, ["b", "g", "j"])
    else:
        pairs = a.join(c, ["b", "g"])
    w = Window.partitionBy("b", "h", "i")
    s = pairs.withColumn("s", arrays.dot("qx", "kx") / F.sqrt(F.size("qx").cast("double"))).drop("qx", "kx")
    s = s.withColumn("e", F.exp(F.col("s") - F.max("s").over(w))).withColumn("p", F.col("e") / F.sum("e").over(w))
    d = v.select("b", F.col("h").cast("long").alias("g"), F.col("pos").alias("j"), F.posexplode("x").alias("c", "y"))
    out = s.join(d, ["b", "g", "j"]).groupBy("b", "h", "i", "c").agg(F.sum(F.col("p") * F.col("y")).alias("y"))
    return out.groupBy("b", "h", F.col("i").alias("pos")).agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "y"))), lambda z: z["y"]).alias("x"))


def sliding_window_attention(q: DataFrame, k: DataFrame, v: DataFrame, window: int, groups: int = 1) -> DataFrame:
    """Attention of position i to i-window .. i, both included."""
    n = q.agg(F.max("pos")).first()[0]
    return attention(q, k, v, sliding_window_mask(q.sparkSession, (n if n is not None else -1) + 1, window + 1), groups)


def feed_forward(x: Column | str, up: list[list[float]], down: list[list[float]], gate: list[list[float]] | None = None, kind: str = "standard") -> Column:
    """standard: down(relu(up x)); swiglu: down(silu(gate x) * up x); geglu: down(gelu(gate x) * up x)."""
    from .gnn import linear

    h = linear(x, up)
    if kind == "standard":
        h = F.transform(h, arrays.relu)
    else:
        h = arrays.mul(F.transform(linear(x, gate), arrays.silu if kind == "swiglu" else arrays.gelu), h)
    return linear(h, down)


# quantisation
def quantize_int8(data: Column | str) -> Column:
    """struct(q array<int>, scale): symmetric, scale = max |x| / 127."""
    top = F.array_max(F.transform(data, lambda x: F.abs(x)))
    scale = F.when(top > 0, top / 127.0).otherwise(1.0)
    return F.struct(F.transform(data, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x / scale).cast("int")))).alias("q"), scale.alias("scale"))


def quantize_int4(data: Column | str) -> Column:
    """struct(q array<int> 0..15, scale, low)."""
    low, high = F.array_min(data), F.array_max(data)
    scale = F.when(high > low, (high - low) / 15.0).otherwise(1.0)
    return F.struct(F.transform(data, lambda x: F.greatest(F.lit(0), F.least(F.lit(15), F.round((x - low) / scale).cast("int")))).alias("q"), scale.alias("scale"), low.alias("low"))


def dequantize(quantized: Column, int4: bool = False) -> Column:
    return F.transform(quantized["q"], lambda q: q * quantized["scale"] + (quantized["low"] if int4 else F.lit(0.0)))


def gemm_int8(a: DataFrame, b: DataFrame) -> DataFrame:
    """a(i, j, q, scale), b(i, j, q, scale) -> (i, j, v): integer products, scaled once by row and column."""
    x, y = a.select("i", F.col("j").alias("k"), F.col("q").alias("p"), F.col("scale").alias("sa")), b.select(F.col("i").alias("k"), "j", F.col("q").alias("r"), F.col("scale").alias("sb"))
    return x.join(y, "k").groupBy("i", "j").agg((F.sum(F.col("p").cast("long") * F.col("r")) * F.first("sa") * F.first("sb")).alias("v"))


def compression_ratio(bits: int, source_bits: int = 64) -> float:
    return source_bits / bits


# generation: logits(seq, token, logit)
def probabilities(logits: DataFrame, temperature: float = 1.0) -> DataFrame:
    w = Window.partitionBy("seq")
    e = logits.withColumn("_z", F.col("logit") / temperature).withColumn("_e", F.exp(F.col("_z") - F.max("_z").over(w)))
    return e.select("seq", "token", (F.col("_e") / F.sum("_e").over(w)).alias("p"))


def greedy(logits: DataFrame) -> DataFrame:
    """The last of the tokens with the greatest logit."""
    return logits.groupBy("seq").agg(F.max(F.struct("logit", "token")).alias("b")).select("seq", F.col("b.token").alias("token"))


def top_k(probs: DataFrame, k: int) -> DataFrame:
    """Tokens at least as likely as the k-th, renormalised."""
    w = Window.partitionBy("seq").orderBy(F.desc("p"))
    kept = probs.withColumn("_r", F.rank().over(w)).where(F.col("_r") <= k)
    return kept.select("seq", "token", (F.col("p") / F.sum("p").over(Window.partitionBy("seq"))).alias("p"))


def top_p(probs: DataFrame, p: float) -> DataFrame:
    """The shortest run of the likeliest tokens that reaches p, renormalised."""
    w = Window.partitionBy("seq").orderBy(F.desc("p"), "token").rowsBetween(Window.unboundedPreceding, -1)
    kept = probs.withColumn("_c", F.coalesce(F.sum("p").over(w), F.lit(0.0))).where(F.col("_c") < p)
    return kept.select("seq", "token", (F.col("p") / F.sum("p").over(Window.partitionBy("seq"))).alias("p"))


def sample(probs: DataFrame, seed: int = 42) -> DataFrame:
    """One token a sequence, by the Gumbel trick on seeded hashes."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "seq", "token"), 11) + 1) / F.lit(float((1 << 53) + 1))
    return probs.where("p > 0").groupBy("seq").agg(F.max_by("token", F.log("p") - F.log(-F.log(u))).alias("token"))


def repetition_penalty(logits: DataFrame, sequences: DataFrame, penalty: float) -> DataFrame:
    """logits(seq, token, logit) of tokens that sequences(seq, tokens) hold: divided by the penalty if positive, else multiplied."""
    held = sequences.select("seq", F.explode(F.array_distinct("tokens")).alias("token"), F.lit(True).alias("_held"))
    z = F.col("logit")
    return logits.join(held, ["seq", "token"], "left").select("seq", "token", F.when(F.col("_held"), F.when(z > 0, z / penalty).otherwise(z * penalty)).otherwise(z).alias("logit"))


def beam_step(beams: DataFrame, logits: DataFrame, width: int) -> DataFrame:
    """beams(seq, beam, tokens, score) with logits(seq, beam, token, logit) -> the best `width` continuations of each sequence."""
    w = Window.partitionBy("seq", "beam")
    z = logits.withColumn("_m", F.max("logit").over(w))
    z = z.withColumn("lp", F.col("logit") - F.col("_m") - F.log(F.sum(F.exp(F.col("logit") - F.col("_m"))).over(w)))
    all_ = beams.join(z, ["seq", "beam"]).select("seq", F.concat("tokens", F.array("token")).alias("tokens"), (F.col("score") + F.col("lp")).alias("score"))
    nth = F.row_number().over(Window.partitionBy("seq").orderBy(F.desc("score"), "tokens"))
    return all_.withColumn("beam", nth - 1).where(F.col("beam") < width).select("seq", "beam", "tokens", "score")


def generate(
    model, prompts: DataFrame, max_length: int, choose: str = "greedy", temperature: float = 1.0, k: int = 0, p: float = 0.0, repetition: float = 1.0, eos: int | None = None, min_length: int = 0, seed: int = 42
) -> DataFrame:
    """prompts(seq, tokens) with up to max_length new tokens each; model(sequences) -> logits(seq, token, logit) of the next token.

    choose is "greedy" or "sample".  A sequence ends before its EOS token, which is not kept and not chosen within min_length.  All sequences take
    a step together; those that have ended wait.
    """
    from ..iterate import cut_with

    rows = F.count_if("_open").alias("rows")
    out, left = cut_with(prompts.select("seq", F.col("tokens").cast("array<long>").alias("tokens"), F.lit(True).alias("_open")), rows)
    for step in range(max_length):
        if not left["rows"]:
            break
        live = out.where("_open").drop("_open")
        logits = model(live)
        if repetition != 1.0:
            logits = repetition_penalty(logits, live, repetition)
        if eos is not None and step < min_length:
            logits = logits.where(F.col("token") != eos)
        if choose == "greedy":
            chosen = greedy(logits)
        else:
            probs = probabilities(logits, temperature)
            probs = top_k(probs, k) if k else probs
            probs = top_p(probs, p) if p else probs
            chosen = sample(probs, seed + step)
        chosen = chosen.select("seq", F.col("token").cast("long").alias("_next"))
        ends = F.lit(False) if eos is None else F.col("_next") == eos
        goes_on = F.col("_next").isNotNull() & ~ends
        new = out.join(chosen, "seq", "left").select("seq", F.when(goes_on, F.concat("tokens", F.array("_next"))).otherwise(F.col("tokens")).alias("tokens"), F.coalesce(goes_on, F.lit(False)).alias("_open"))
        out, left = cut_with(new, rows)
    return out.drop("_open")


def beam_search(model, prompts: DataFrame, max_length: int, width: int, eos: int | None = None, length_penalty: float = 1.0) -> DataFrame:
    """(seq, tokens, score): the best of `width` hypotheses by log probability over length ** length_penalty.

    model(sequences with beam) -> logits(seq, beam, token, logit).  A hypothesis that ends in EOS is kept as it is, and the search of a
    sequence ends when all its hypotheses have ended.
    """
    from ..iterate import cut, cut_with

    beams = cut(prompts.select("seq", F.lit(0).alias("beam"), F.col("tokens").cast("array<long>").alias("tokens"), F.lit(0.0).alias("score"), F.lit(0).alias("new"), F.lit(False).alias("done")))
    rank = Window.partitionBy("seq").orderBy(F.desc("value"), "tokens")
    value = F.col("score") / F.pow(F.greatest(F.col("new"), F.lit(1)).cast("double"), F.lit(float(length_penalty)))
    for _ in range(max_length):
        live = beams.where("NOT done")
        w = Window.partitionBy("seq", "beam")
        z = model(live.select("seq", "beam", "tokens")).withColumn("_m", F.max("logit").over(w))
        z = z.withColumn("lp", F.col("logit") - F.col("_m") - F.log(F.sum(F.exp(F.col("logit") - F.col("_m"))).over(w)))
        ended = F.lit(False) if eos is None else F.col("token") == eos
        more = live.join(z, ["seq", "beam"]).select("seq", F.concat("tokens", F.array(F.col("token").cast("long"))).alias("tokens"), (F.col("score") + F.col("lp")).alias("score"), (F.col("new") + 1).alias("new"), ended.alias("done"))
        every = more.unionByName(beams.where("done").drop("beam")).withColumn("value", value).withColumn("beam", F.row_number().over(rank) - 1)
        beams, left = cut_with(every.where(F.col("beam") < width).drop("value"), F.count_if(~F.col("done")).alias("rows"))
        if not left["rows"]:
            break
    best = beams.withColumn("value", value).withColumn("_n", F.row_number().over(rank)).where("_n = 1")
    tokens = F.col("tokens") if eos is None else F.when(F.element_at("tokens", -1) == eos, F.slice("tokens", 1, F.size("tokens") - 1)).otherwise(F.col("tokens"))
    return best.select("seq", F.when(F.col("done"), tokens).otherwise(F.col("tokens")).alias("tokens"), "score")


# batching and caches
def pad(sequences: DataFrame, pad_token: int) -> DataFrame:
    """sequences(seq, tokens) -> (seq, tokens, mask, length) padded to the longest."""
    longest = sequences.agg(F.max(F.size("tokens"))).first()[0] or 0
    n = F.size("tokens")
    return sequences.select("seq", F.concat("tokens", F.array_repeat(F.lit(pad_token).cast(dict(sequences.dtypes)["tokens"][6:-1]), longest - n)).alias("tokens"), F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), longest - n)).alias("mask"), n.alias("length"))


def schedule(requests: DataFrame, max_batch: int, running: int = 0) -> DataFrame:
    """requests(request, arrived): those that fill the free places, first come first served."""
    return requests.orderBy("arrived", "request").limit(max(0, max_batch - running))


def cache_append(cache: DataFrame, rows: DataFrame, block: int = 16) -> DataFrame:
    """cache(layer, pos, k, v) with newer rows put in place of those at their positions; page is pos div block."""
    kept = cache.join(rows.select("layer", "pos"), ["layer", "pos"], "left_anti")
    return kept.select("layer", "pos", "k", "v").unionByName(rows.select("layer", "pos", "k", "v")).withColumn("page", F.floor(F.col("pos") / block).cast("int"))


def cache_get(cache: DataFrame, layer: int, length: int) -> DataFrame:
    return cache.where((F.col("layer") == layer) & (F.col("pos") < length)).orderBy("pos")


def parameter_count(tensors: DataFrame) -> int:
    return tensors.agg(F.sum(F.aggregate("shape", F.lit(1).cast("long"), lambda a, x: a * x))).first()[0] or 0


# optimisers over parameter tables (name, value, grad and state columns)
def sgd(params: DataFrame, rate: float, momentum: float = 0.0, decay: float = 0.0) -> DataFrame:
    g = F.col("grad") + decay * F.col("value")
    v = momentum * F.col("velocity") + g
    return params.withColumns({"velocity": v, "value": F.col("value") - rate * v})


def adam(params: DataFrame, step: int, rate: float = 1e-3, b1: float = 0.9, b2: float = 0.999, epsilon: float = 1e-8, decay: float = 0.0, decoupled: bool = False) -> DataFrame:
    """Adam; with decoupled=True, AdamW."""
    g = F.col("grad") + (0.0 if decoupled else decay) * F.col("value")
    m, v = b1 * F.col("m") + (1 - b1) * g, b2 * F.col("v") + (1 - b2) * g * g
    move = rate * (m / (1 - b1**step)) / (F.sqrt(v / (1 - b2**step)) + epsilon) + (rate * decay * F.col("value") if decoupled else 0.0)
    return params.withColumns({"m": m, "v": v, "value": F.col("value") - move})


def token_graph(spark: SparkSession, seq: int, layers: int):
    """Vertices (id, layer, pos, kind) and edges of a transformer over a sequence: causal attention, residual, and feed-forward steps.

    Layer l has hidden vertices seq(1 + 2l).. and feed-forward ones after them; attention weights are 1/(i+1).
    """
    from ..graph import Graph

    rows = spark.range(seq * (1 + 2 * layers)).select("id", F.expr(f"id div {seq}").alias("level"), (F.col("id") % seq).alias("pos"))
    v = rows.select("id", F.lit(1).alias("gen"), "level", "pos", F.when(F.col("level") == 0, "Token").when(F.col("level") % 2 == 1, "Hidden").otherwise("FFN").alias("kind"))
    hidden, ffn = rows.where("level % 2 = 1"), rows.where("level > 0 AND level % 2 = 0")
    att = hidden.select(F.explode(F.sequence((F.col("level") - 1) * seq, (F.col("level") - 1) * seq + F.col("pos"))).alias("src"), F.col("id").alias("dst"), (1.0 / (F.col("pos") + 1)).alias("weight"), F.lit("SelfAttention").alias("kind"))
    res = hidden.select((F.col("id") - seq).alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight"), F.lit("Residual").alias("kind"))
    fwd = ffn.select((F.col("id") - seq).alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight"), F.lit("DataFlow").alias("kind"))
    return Graph.from_edges(att.union(res).union(fwd), v)


def execute_token_graph(graph, features: DataFrame) -> DataFrame:
    """(id, x) of all vertices of a token graph, from features(id, x) of the tokens: level by level, each vertex takes the weighted
    sum of what its attention and residual edges bring, and a feed-forward vertex the SiLU of its source."""
    from ..iterate import cut
    from .gnn import _rows

    levels = graph.vertices.agg(F.max("level")).first()[0] or 0
    state = cut(features.select("id", "x"))
    out = state
    for k in range(1, levels + 1):
        at = graph.vertices.where(F.col("level") == k).select(F.col("id").alias("dst"))
        came = graph.edges.join(at, "dst").join(state.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "weight", F.posexplode("x").alias("j", "v"))
        new = _rows(came.groupBy("id", "j").agg(F.sum(F.col("weight") * F.col("v")).alias("v")))
        state = cut(new if k % 2 else new.select("id", F.transform("x", arrays.silu).alias("x")))
        out = out.unionByName(state)
    return out


def prune_attention(graph, threshold: float):
    from dataclasses import replace

    return replace(graph, edges=graph.edges.where((F.col("kind") != "SelfAttention") | (F.col("weight") >= threshold)))


SQRT_HALF = math.sqrt(0.5)
