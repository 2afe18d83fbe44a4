"""A small reverse-mode tape over numpy arrays, for kernels that run inside one task or in the driver."""

from __future__ import annotations

import math

import numpy as np


class Tensor:
    def __init__(self, value, parents=(), backward=None):
        self.value, self.parents, self.pull, self.grad = np.asarray(value, float), parents, backward, None

    def __add__(self, o):
        return Tensor(self.value + o.value, (self, o), lambda g: (g, g))

    def __sub__(self, o):
        return Tensor(self.value - o.value, (self, o), lambda g: (g, -g))

    def __mul__(self, o):
        return Tensor(self.value * o.value, (self, o), lambda g: (g * o.value, g * self.value))

    def __matmul__(self, o):
        return Tensor(self.value @ o.value, (self, o), lambda g: (g @ o.value.T, self.value.T @ g))

    @property
    def T(self):
        return Tensor(self.value.T, (self,), lambda g: (g.T,))

    def relu(self):
        return Tensor(np.maximum(self.value, 0), (self,), lambda g: (g * (self.value > 0),))

    def gelu(self):
        x, c = self.value, math.sqrt(2 / math.pi)
        t = np.tanh(c * (x + 0.044715 * x**3))
        return Tensor(0.5 * x * (1 + t), (self,), lambda g: (g * (0.5 * (1 + t) + 0.5 * x * (1 - t * t) * c * (1 + 3 * 0.044715 * x * x)),))

    def softmax(self):
        e = np.exp(self.value - self.value.max(-1, keepdims=True))
        y = e / e.sum(-1, keepdims=True)
        return Tensor(y, (self,), lambda g: (y * (g - (g * y).sum(-1, keepdims=True)),))

    def layer_norm(self, epsilon: float = 1e-5):
        x = self.value
        s = np.sqrt(x.var(-1, keepdims=True) + epsilon)
        y = (x - x.mean(-1, keepdims=True)) / s
        return Tensor(y, (self,), lambda g: ((g - g.mean(-1, keepdims=True) - y * (g * y).mean(-1, keepdims=True)) / s,))

    def sum(self):
        return Tensor(self.value.sum(), (self,), lambda g: (np.broadcast_to(g, self.value.shape),))

    def backward(self):
        order, seen = [], set()

        def visit(t):
            if id(t) not in seen:
                seen.add(id(t))
                for p in t.parents:
                    visit(p)
                order.append(t)

        visit(self)
        for t in order:
            t.grad = np.zeros_like(t.value)
        self.grad = np.ones_like(self.value)
        for t in reversed(order):
            if t.pull:
                for p, g in zip(t.parents, t.pull(t.grad)):
                    p.grad = p.grad + g
