"""A layered decoder model: weights by name, the forward pass to logits, and what generation needs of it.

The model's weights are checked for size and broadcast once; sequences are rows, and each task runs the layers over its sequences, one
numpy product a weight.  Weight matrices are (in x out): a projection is x W.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import GraphError, TooLarge

#: Names of a layer's weights, and of those outside layers.
LAYER = {"q": "self_attn.q_proj", "k": "self_attn.k_proj", "v": "self_attn.v_proj", "o": "self_attn.o_proj", "gate": "mlp.gate_proj", "up": "mlp.up_proj", "down": "mlp.down_proj", "before": "input_layernorm", "after": "post_attention_layernorm"}
WHOLE = {"embed": "model.embed_tokens", "norm": "model.norm", "head": "lm_head"}


@dataclass(frozen=True)
class Config:
    """Sizes of a model; fields of a configuration file by their usual names."""

    num_hidden_layers: int
    num_attention_heads: int
    num_key_value_heads: int | None = None
    rms_norm_eps: float = 1e-6
    rope_theta: float = 10000.0
    max_position_embeddings: int = 2048

    @classmethod
    def from_row(cls, row) -> Config:
        """From a row of sources.tensors.read_config()."""
        values = row.asDict()
        return cls(**{k: values[k] for k in cls.__dataclass_fields__ if values.get(k) is not None})

    @property
    def groups(self) -> int:
        return self.num_attention_heads // (self.num_key_value_heads or self.num_attention_heads)


def rms_norm(x: np.ndarray, weight: np.ndarray, epsilon: float) -> np.ndarray:
    return x / np.sqrt((x * x).mean(-1, keepdims=True) + epsilon) * weight


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def rotate(x: np.ndarray, theta: float, limit: int) -> np.ndarray:
    """Rotary positions of x(heads, pos, size), halves as pairs; positions beyond the limit count as the last."""
    half = x.shape[-1] // 2
    at = np.minimum(np.arange(x.shape[1]), limit - 1)[:, None] * theta ** (-2.0 * np.arange(half) / x.shape[-1])
    a, b = x[..., :half], x[..., half:]
    return np.concatenate([a * np.cos(at) - b * np.sin(at), b * np.cos(at) + a * np.sin(at)], -1)


@dataclass
class Layer:
    """A pre-norm decoder layer with residuals: attention with grouped keys and values, then a gated feed-forward step."""

    weights: dict[str, np.ndarray]
    config: Config

    def attention(self, x: np.ndarray, mask: np.ndarray | None, rope: bool) -> np.ndarray:
        c, w = self.config, self.weights
        heads = lambda y, n: y.reshape(len(x), n, -1).swapaxes(0, 1)
        q = heads(x @ w["q"], c.num_attention_heads)
        k, v = (heads(x @ w[n], c.num_attention_heads // c.groups) for n in "kv")
        if rope:
            q, k = (rotate(y, c.rope_theta, c.max_position_embeddings) for y in (q, k))
        k, v = (np.repeat(y, c.groups, 0) for y in (k, v))
        scores = q @ k.swapaxes(1, 2) / np.sqrt(q.shape[-1])
        if mask is not None:
            scores = np.where(mask, scores, -np.inf)
        return (softmax(scores) @ v).swapaxes(0, 1).reshape(len(x), -1) @ w["o"]

    def feed_forward(self, x: np.ndarray) -> np.ndarray:
        gate = x @ self.weights["gate"]
        return (gate / (1 + np.exp(-gate)) * (x @ self.weights["up"])) @ self.weights["down"]

    def forward(self, x: np.ndarray, mask: np.ndarray | None = None, rope: bool = False) -> np.ndarray:
        """x(pos, hidden)."""
        x = x + self.attention(rms_norm(x, self.weights["before"], self.config.rms_norm_eps), mask, rope)
        return x + self.feed_forward(rms_norm(x, self.weights["after"], self.config.rms_norm_eps))


@dataclass
class Model:
    config: Config
    embed: np.ndarray
    layers: list[Layer] = field(default_factory=list)
    norm: np.ndarray | None = None
    head: np.ndarray | None = None

    def logits(self, tokens: list[int], causal: bool = False, rope: bool = False) -> np.ndarray:
        """(pos, vocabulary) of one sequence; all positions see each other unless causal."""
        x = self.embed[np.asarray(tokens, int)]
        mask = np.tri(len(tokens), dtype=bool) if causal else None
        for layer in self.layers:
            x = layer.forward(x, mask, rope)
        head = self.embed if self.head is None else self.head
        return rms_norm(x, self.norm, self.config.rms_norm_eps) @ head.T

    def parameters(self) -> int:
        return sum(a.size for a in [self.embed, self.norm, *([] if self.head is None else [self.head]), *(w for x in self.layers for w in x.weights.values())])


def build_model(tensors: DataFrame, config: Config, limit_bytes: int = 4 << 30) -> Model:
    """tensors(name, shape, data) -> the model; raises GraphError for a weight that is missing and TooLarge beyond the limit.

    A missing head is tied to the embeddings.
    """
    size = tensors.agg(F.coalesce(F.sum(F.size("data")), F.lit(0))).first()[0] * 8
    if size > limit_bytes:
        raise TooLarge(f"{size} bytes of weights")
    found = {r.name: np.array(r.data, float).reshape(tuple(r.shape)) for r in tensors.select("name", "shape", "data").toLocalIterator()}

    def get(name: str) -> np.ndarray:
        if f"{name}.weight" not in found:
            raise GraphError(f"{name}.weight is missing")
        return found[f"{name}.weight"]

    layers = [Layer({k: get(f"model.layers.{i}.{name}") for k, name in LAYER.items()}, config) for i in range(config.num_hidden_layers)]
    return Model(config, get(WHOLE["embed"]), layers, get(WHOLE["norm"]), found.get(WHOLE["head"] + ".weight"))


def forward(model: Model, sequences: DataFrame, causal: bool = False, rope: bool = False, last: bool = False) -> DataFrame:
    """sequences(seq[, beam], tokens) -> (seq[, beam], pos, token, logit); with last=True of the last position only."""
    shared = sequences.sparkSession.sparkContext.broadcast(model)
    keys = [c for c in ("seq", "beam") if c in sequences.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if not len(row.tokens):
                    continue
                z = shared.value.logits(list(row.tokens), causal, rope)
                at = np.arange(len(z))[-1:] if last else np.arange(len(z))
                out = {k: getattr(row, k) for k in keys}
                yield pd.DataFrame(out | {"pos": np.repeat(at, z.shape[1]), "token": np.tile(np.arange(z.shape[1]), len(at)), "logit": z[at].ravel()})

    kinds = dict(sequences.dtypes)
    return sequences.select(*keys, "tokens").mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "pos long, token long, logit double"]))


def next_logits(model: Model, **options):
    """A function of sequences for functions.transformer.generate() and beam_search()."""
    return lambda sequences: forward(model, sequences, last=True, **options).drop("pos")
