"""Element-wise functions: on columns (activations) and on array columns (row vectors)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(x) -> Column:
    return x.cast("double") if isinstance(x, Column) else F.col(x).cast("double")


def relu(x) -> Column:
    return F.greatest(_d(x), F.lit(0.0))


def leaky_relu(x, alpha: float = 0.01) -> Column:
    return F.when(_d(x) > 0, _d(x)).otherwise(_d(x) * alpha)


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-_d(x)))


def tanh(x) -> Column:
    return F.tanh(_d(x))


def silu(x) -> Column:
    return _d(x) * sigmoid(x)


def _gelu_inner(x) -> Column:
    return math.sqrt(2 / math.pi) * (_d(x) + 0.044715 * _d(x) * _d(x) * _d(x))


def gelu(x) -> Column:
    return 0.5 * _d(x) * (1 + F.tanh(_gelu_inner(x)))


def gelu_derivative(x) -> Column:
    t = F.tanh(_gelu_inner(x))
    return 0.5 * (1 + t) + 0.5 * _d(x) * (1 - t * t) * math.sqrt(2 / math.pi) * (1 + 3 * 0.044715 * _d(x) * _d(x))


def add(a, b) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def sub(a, b) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def mul(a, b) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def div(a, b) -> Column:
    """IEEE division: x/0 is an infinity of x's sign, 0/0 not a number."""
    inf = float("inf")
    return F.zip_with(a, b, lambda x, y: F.when(y != 0, F.try_divide(x, y)).when(x > 0, F.lit(inf)).when(x < 0, F.lit(-inf)).otherwise(F.lit(float("nan"))))


def scale(a, c: float) -> Column:
    return F.transform(a, lambda x: x * c)


def add_scalar(a, c: float) -> Column:
    return F.transform(a, lambda x: x + c)


def dot(a, b) -> Column:
    return total(mul(a, b))


def total(a) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a) -> Column:
    return total(a) / F.size(a)


def variance(a) -> Column:
    m = mean(a)
    return F.aggregate(F.transform(a, lambda x: (x - m) * (x - m)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a, floor: float = 1e-10) -> Column:
    n = norm(a)
    return F.when(n > floor, F.transform(a, lambda x: x / n)).otherwise(F.col(a) if isinstance(a, str) else a)


def softmax(a) -> Column:
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - top))
    s = F.aggregate(e, F.lit(0.0), lambda t, x: t + x)
    return F.transform(e, lambda x: x / s)


def layer_norm(a, epsilon: float = 1e-5) -> Column:
    m, v = mean(a), variance(a)
    return F.transform(a, lambda x: (x - m) / F.sqrt(v + epsilon))


def rms_norm(a, epsilon: float = 1e-6) -> Column:
    r = F.sqrt(dot(a, a) / F.size(a) + epsilon)
    return F.transform(a, lambda x: x / r)


def greater_mask(a, threshold: float) -> Column:
    return F.transform(a, lambda x: (x > threshold).cast("double"))


def mask_fill(a, mask, value: float) -> Column:
    return F.zip_with(a, mask, lambda x, m: F.when(m != 0, F.lit(value)).otherwise(x))


def reshape_index(position: Column, cols: int) -> tuple[Column, Column]:
    return F.floor(position / cols).cast("long"), (position % cols).cast("long")


def rope(a, position, base: float = 10000.0, max_position: int | None = None) -> Column:
    """Rotary embedding of an array of even length, halves as pairs."""
    p = position if isinstance(position, Column) else F.col(position)
    p = F.least(p, F.lit(max_position - 1)) if max_position else p
    a = F.col(a) if isinstance(a, str) else a
    half = (F.size(a) / 2).cast("int")
    angle = lambda i: p * F.pow(F.lit(base), -2.0 * i / F.size(a))
    first = F.transform(F.slice(a, 1, half), lambda x, i: x * F.cos(angle(i)) - F.get(a, i + half) * F.sin(angle(i)))
    second = F.transform(F.slice(a, half + 1, half), lambda x, i: x * F.cos(angle(i)) + F.get(a, i) * F.sin(angle(i)))
    return F.concat(first, second)
