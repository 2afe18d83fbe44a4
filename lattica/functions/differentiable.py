"""Learnable edges: probabilities by logits, structure gradients, edit policies and joint steps, as edge columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLAMP = 1e-7


def logit(p: Column) -> Column:
    q = F.greatest(F.lit(CLAMP), F.least(F.lit(1 - CLAMP), p))
    return F.log(q / (1 - q))


def learnable(edges: DataFrame, prob: Column | float = 0.5) -> DataFrame:
    """edges with logit, prob, exists."""
    p = prob if isinstance(prob, Column) else F.lit(float(prob))
    e = edges.withColumn("logit", logit(p)).withColumn("prob", 1 / (1 + F.exp(-F.col("logit"))))
    return e.withColumn("exists", F.col("prob") > 0.5)


def discretize(edges: DataFrame, temperature: float = 1.0) -> DataFrame:
    """prob at the temperature, exists, and ste, the straight-through correction hard - soft."""
    e = edges.withColumn("_before", F.col("prob")).withColumn("prob", 1 / (1 + F.exp(-F.col("logit") / temperature)))
    e = e.withColumn("exists", F.col("prob") > 0.5)
    return e.withColumn("ste", F.col("exists").cast("double") - F.col("_before")).drop("_before")


def structure_gradients(edges: DataFrame, loss: DataFrame, temperature: float = 1.0, sparsity: float = 0.0, smoothness: float = 0.0) -> DataFrame:
    """loss(src, dst, g) -> edges with grad: g p(1-p)/T + ste + l1 sign(logit) + l2 times the difference from its neighbours.

    The smoothness term needs only sums by source and by target, never pairs of edges.
    """
    e = edges.join(loss, ["src", "dst"], "left").withColumn("g", F.coalesce("g", F.lit(0.0)))
    ste = F.col("ste") if "ste" in edges.columns else F.lit(0.0)
    smooth = F.lit(0.0)
    for c in ("src", "dst"):
        w = Window.partitionBy(c)
        smooth = smooth + 2 * (F.count("*").over(w) * F.col("prob") - F.sum("prob").over(w))
    grad = F.col("g") * F.col("prob") * (1 - F.col("prob")) / temperature + F.when(F.col("g") != 0, ste).otherwise(0.0) + sparsity * F.signum("logit")
    return e.withColumn("grad", grad + (smoothness * smooth if smoothness else F.lit(0.0))).drop("g")


def update(edges: DataFrame, rate: float) -> DataFrame:
    e = edges.withColumn("logit", F.col("logit") - rate * F.col("grad"))
    return e.withColumn("prob", 1 / (1 + F.exp(-F.col("logit")))).withColumn("exists", F.col("prob") > 0.5)


def annealed(step: int, total: int, low: float = 0.1) -> float:
    return max(math.exp(-3.0 * step / max(1, total)), low)


def optimization_step(edges: DataFrame, loss: DataFrame, step: int, total: int, rate: float = 0.01, **terms) -> DataFrame:
    t = annealed(step, total)
    return update(structure_gradients(discretize(edges, t), loss, t, **terms), rate)


def optimize(edges: DataFrame, loss_of, steps: int, rate: float = 0.01, **terms) -> tuple[DataFrame, dict]:
    """Gradient steps on learnable edges -> the edges that are left, and a report.

    loss_of(edges) -> (loss, gradients(src, dst, g)): the loss and its derivative by each edge's probability.  The steps follow this derivative alone: the
    straight-through correction hard - soft is no derivative of the loss, and pulls every edge towards a half.  After the steps edges are discretised, and those that do not exist are pruned.
    """
    from ..iterate import cut

    losses, total = [], edges.count()
    for step in range(steps):
        loss, g = loss_of(edges)
        losses.append(float(loss))
        t = annealed(step, steps)
        edges = cut(update(structure_gradients(discretize(edges, t).drop("ste"), g, t, **terms), rate).select(*edges.columns))
    losses.append(float(loss_of(edges)[0]))
    edges = cut(discretize(edges, annealed(steps, steps)))
    kept = edges.where("exists")
    n = kept.count()
    return kept, {"initial_loss": losses[0], "final_loss": losses[-1], "losses": losses, "steps": steps, "total_edges": total, "pruned_edges": total - n}


def linear_loss(edges: DataFrame, features: DataFrame, target: DataFrame) -> tuple[float, DataFrame, DataFrame]:
    """Half the squared error of y_dst = sum of p w x_src against target(id, y), for features(id, x) -> (loss, gradients by p (src, dst, g), gradients by w (src, dst, gw))."""
    e = edges.join(features.select(F.col("id").alias("src"), "x"), "src")
    got = e.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("prob") * F.col("weight") * F.col("x")).alias("got"))
    error = target.join(got, "id", "left").select("id", (F.coalesce("got", F.lit(0.0)) - F.col("y")).alias("error"))
    loss = error.agg(F.coalesce(F.sum(F.col("error") * F.col("error")) / 2, F.lit(0.0))).first()[0]
    back = e.join(error.withColumnRenamed("id", "dst"), "dst")
    return loss, back.select("src", "dst", (F.col("error") * F.col("weight") * F.col("x")).alias("g")), back.select("src", "dst", (F.col("error") * F.col("prob") * F.col("x")).alias("gw"))


def joint_step(edges: DataFrame, features: DataFrame, target: DataFrame, step: int, total: int, rate: float = 0.01, weight_rate: float = 0.01, threshold: float = 0.1, **terms) -> tuple[DataFrame, float]:
    """One step on weights and structure together: both gradients of linear_loss(), then weak edges (not existing and below the threshold) are pruned."""
    loss, g, gw = linear_loss(edges, features, target)
    moved = edges.join(gw, ["src", "dst"], "left").withColumn("weight", F.col("weight") - weight_rate * F.coalesce("gw", F.lit(0.0))).select(*edges.columns)
    return prune_weak(optimization_step(moved, g, step, total, rate, **terms).select(*edges.columns), threshold), loss


def gumbel_softmax(options: DataFrame, temperature: float = 1.0, seed: int = 42, hard: bool = False) -> DataFrame:
    """options(grp, item, logit) -> (grp, item, y); hard gives the one-hot of the greatest."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "grp", "item"), 11) + 1) / F.lit(float((1 << 53) + 1))
    w = Window.partitionBy("grp")
    z = options.withColumn("_z", (F.col("logit") - F.log(-F.log(u))) / temperature)
    z = z.withColumn("_e", F.exp(F.col("_z") - F.max("_z").over(w))).withColumn("y", F.col("_e") / F.sum("_e").over(w))
    if hard:
        z = z.withColumn("y", (F.row_number().over(w.orderBy(F.desc("_z"), "item")) == 1).cast("double"))
    return z.select("grp", "item", "y")


def edit_policy(edges: DataFrame, rate: float = 0.1, threshold: float = 0.1) -> DataFrame:
    """(src, dst, action, prob): add if grad > threshold and p < .5, remove if grad < -threshold and p > .5, else modify; p within .01 to .99."""
    p = F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("prob") + rate * F.col("grad")))
    action = F.when((F.col("grad") > threshold) & (F.col("prob") < 0.5), "add").when((F.col("grad") < -threshold) & (F.col("prob") > 0.5), "remove").otherwise("modify")
    return edges.select("src", "dst", action.alias("action"), p.alias("prob"))


def momentum(state: DataFrame, grads: DataFrame, mu: float = 0.9) -> DataFrame:
    """state(src, dst, velocity), grads(src, dst, grad) -> the new state."""
    return state.join(grads, ["src", "dst"], "full").select("src", "dst", (mu * F.coalesce("velocity", F.lit(0.0)) + F.coalesce("grad", F.lit(0.0))).alias("velocity"))


def prune_weak(edges: DataFrame, threshold: float) -> DataFrame:
    return edges.where(F.col("exists") | (F.col("prob") >= threshold))


def probability_matrix(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("prob").alias("v"))


def unified_forward(graph, features: DataFrame) -> DataFrame:
    """(id, x): relu of the weighted sum of the sources' states along existing edges, level by level of a DAG."""
    from ..iterate import cut
    from ..operators.traversal import topological_levels
    from . import arrays
    from .gnn import _rows

    live = cut(graph.edges.where(F.col("exists")) if "exists" in graph.edges.columns else graph.edges)
    levels = cut(topological_levels(graph))
    deepest = levels.agg(F.max("level")).first()[0] or 0
    state = cut(features)
    for k in range(1, deepest + 1):
        at = levels.where(F.col("level") == k).select(F.col("id").alias("dst"))
        got = live.join(at, "dst").join(state.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "weight", F.posexplode("x").alias("j", "v"))
        new = _rows(got.groupBy("id", "j").agg(F.sum(F.col("weight") * F.col("v")).alias("v"))).select("id", F.transform("x", arrays.relu).alias("_x"))
        state = cut(state.join(new, "id", "left").select("id", F.coalesce("_x", "x").alias("x")))
    return state
