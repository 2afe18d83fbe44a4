"""Dense kernels for tables of matrices tensor(name, shape, data): one numpy call a matrix, in Arrow batches.

A matrix must fit one task.  Larger ones are kept as (i, j, v) and their Gram matrix is taken by a join (functions.matrix).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """With a diagonal of R that is not negative."""
    q, r = np.linalg.qr(a)
    s = np.where(np.diag(r) < 0, -1.0, 1.0)
    return q * s, r * s[:, None]


def orthogonality_error(q: np.ndarray) -> float:
    return float(np.abs(q.T @ q - np.eye(q.shape[1])).max()) if q.size else 0.0


def svd(a: np.ndarray, k: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """U (m x k), the singular values in falling order, V (n x k); all min(m, n) of them unless k is given."""
    least = min(a.shape)
    if k is not None and k > least:
        raise ValueError(f"{k} singular values of a matrix with {least}")
    u, s, v = np.linalg.svd(a, full_matrices=False)
    return u[:, :k], s[:k], v[:k].T


def low_rank(a: np.ndarray, rank: int) -> np.ndarray:
    u, s, v = np.linalg.svd(a, full_matrices=False)
    return (u[:, :rank] * s[:rank]) @ v[:rank]


def adaptive_rank(a: np.ndarray, energy: float) -> int:
    s2 = np.linalg.svd(a, compute_uv=False) ** 2
    return int(np.searchsorted(np.cumsum(s2), energy * s2.sum() * (1 - 1e-15)) + 1) if s2.sum() else 0


def tensor_ring(a: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Two cores (1, m, r) and (r, n, 1) of a matrix."""
    u, s, v = np.linalg.svd(a, full_matrices=False)
    r = min(rank, s.size)
    root = np.sqrt(s[:r])
    return (u[:, :r] * root)[None], (root[:, None] * v[:r])[:, :, None]


def tensor_ring_reconstruct(cores: tuple[np.ndarray, ...]) -> np.ndarray:
    out = cores[0]
    for c in cores[1:]:
        out = np.einsum("a...b,bnc->a...nc", out, c)
    return np.einsum("a...a->...", out)


def lie_exponential(a: np.ndarray) -> np.ndarray:
    """Scaling and squaring with a Taylor kernel of the scaled matrix."""
    k = max(0, int(np.ceil(np.log2(max(np.abs(a).sum(1).max(initial=0.0), 1e-300)))) + 3)
    x, term, out = a / 2**k, np.eye(len(a)), np.eye(len(a))
    for i in range(1, 14):
        term = term @ x / i
        out = out + term
    for _ in range(k):
        out = out @ out
    return out


def skew(a: np.ndarray) -> np.ndarray:
    return (a - a.T) / 2


def is_skew_symmetric(a: np.ndarray, tolerance: float = 1e-9) -> bool:
    return a.ndim == 2 and a.shape[0] == a.shape[1] and bool((np.abs(a + a.T) <= tolerance).all())


def lie_logarithm(r: np.ndarray) -> np.ndarray:
    """First-order: the skew part of R - I."""
    return skew(r - np.eye(len(r)))


def cayley(a: np.ndarray) -> np.ndarray:
    s, i = skew(a), np.eye(len(a))
    return np.linalg.solve(i + s / 2, i - s / 2)


def so_generator(n: int, i: int, j: int) -> np.ndarray:
    out = np.zeros((n, n))
    out[i, j], out[j, i] = 1.0, -1.0
    return out


def so_blocks(a: np.ndarray, k: int) -> list[np.ndarray]:
    """Square blocks of side k, the last ones padded with zeros."""
    m, n = (-(-s // k) * k for s in a.shape)
    p = np.zeros((m, n))
    p[: a.shape[0], : a.shape[1]] = a
    return [p[i : i + k, j : j + k] for i in range(0, m, k) for j in range(0, n, k)]


def condition_number(a: np.ndarray) -> float:
    s = np.linalg.svd(a, compute_uv=False)
    return float(s[0] / s[-1]) if s.size and s[-1] > 0 else float("inf")


def map_tensors(tensors: DataFrame, kernel: Callable[[np.ndarray], dict], schema: str) -> DataFrame:
    """kernel(matrix) -> the values of `schema` after name; rows that are not 2-D are left out."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = []
            for name, shape, data in zip(pdf["name"], pdf["shape"], pdf["data"]):
                if len(shape) == 2:
                    out = kernel(np.asarray(data, float).reshape(tuple(shape)))
                    rows.append([name, *(out[c].ravel().tolist() if isinstance(out[c], np.ndarray) else out[c] for c in names)])
            yield pd.DataFrame(rows, columns=["name", *names])

    return tensors.select("name", "shape", "data").mapInPandas(run, f"name string, {schema}")


def orthogonalize(tensors: DataFrame) -> DataFrame:
    """(name, q, error) of the matrices with at least as many rows as columns."""

    def kernel(a):
        q = qr(a)[0] if a.shape[0] >= a.shape[1] else a
        return {"q": q, "error": orthogonality_error(q) if a.shape[0] >= a.shape[1] else None}

    return map_tensors(tensors, kernel, "q array<double>, error double")


def singular_values(tensors: DataFrame, k: int | None = None) -> DataFrame:
    """(name, u, s, v, error): the singular value decomposition of each matrix, and how far U S V^T is from it."""

    def kernel(a):
        u, s, v = svd(a, k)
        return {"u": u, "s": s, "v": v, "error": float(np.linalg.norm((u * s) @ v.T - a))}

    return map_tensors(tensors, kernel, "u array<double>, s array<double>, v array<double>, error double")


def compress(tensors: DataFrame, rank: int, importance: DataFrame | None = None) -> DataFrame:
    """(name, rank, original, compressed, ratio, error): tensor-ring sizes at rank, or at ceil(rank x importance(name, w))."""
    t = tensors.withColumn("w", F.lit(1.0)) if importance is None else tensors.join(importance, "name", "left").withColumn("w", F.coalesce("w", F.lit(1.0)))

    def run(batches):
        for pdf in batches:
            rows = []
            for name, shape, data, w in zip(pdf["name"], pdf["shape"], pdf["data"], pdf["w"]):
                if len(shape) != 2:
                    continue
                a = np.asarray(data, float).reshape(tuple(shape))
                r = int(min(max(1, np.ceil(rank * w)), min(a.shape)))
                cores = tensor_ring(a, r)
                size = sum(c.size for c in cores)
                rows.append((name, r, a.size, size, a.size / size, float(np.linalg.norm(tensor_ring_reconstruct(cores) - a))))
            yield pd.DataFrame(rows, columns=["name", "rank", "original", "compressed", "ratio", "error"])

    return t.select("name", "shape", "data", "w").mapInPandas(run, "name string, rank int, original long, compressed long, ratio double, error double")


def tensors_from(spark: SparkSession, arrays: dict[str, np.ndarray]) -> DataFrame:
    return spark.createDataFrame([(k, list(a.shape), a.ravel().astype(float).tolist()) for k, a in arrays.items()], "name string, shape array<int>, data array<double>")


def error_report(errors: DataFrame) -> DataFrame:
    """errors(layer, error) -> statistics for each layer, worst first."""
    e = F.col("error")
    return errors.groupBy("layer").agg(F.count("*").alias("n"), F.avg(e).alias("mean"), F.stddev_pop(e).alias("std"), F.min(e).alias("min"), F.max(e).alias("max")).orderBy(F.desc("max"), "layer")


def weight_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(name, l2): null where a weight is missing on one side or its shape differs."""
    x, y = a.select("name", F.col("shape").alias("sa"), F.col("data").alias("da")), b.select("name", F.col("shape").alias("sb"), F.col("data").alias("db"))
    l2 = F.sqrt(F.aggregate(F.zip_with("da", "db", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    return x.join(y, "name", "full").select("name", F.when(F.col("sa") == F.col("sb"), l2).alias("l2"))
