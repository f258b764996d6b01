"""Dense model kernels in numpy: activation, layer norm, gated-attention MIL, mean-pool MLP.

Weights are drawn from a seed, as no trained weights exist; shapes and formulas are
those of the published layers.
"""

from __future__ import annotations

import math

import numpy as np


_erf = np.frompyfunc(math.erf, 1, 1)


def normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.asarray(_erf(np.asarray(x, float) / math.sqrt(2)), float))


def gelu(x: np.ndarray) -> np.ndarray:
    """Gaussian error linear unit, exact."""
    return x * normal_cdf(x)


def gelu_slope(x: np.ndarray) -> np.ndarray:
    return normal_cdf(x) + x * np.exp(-0.5 * x**2) / math.sqrt(2 * math.pi)


def layer_norm(x: np.ndarray) -> np.ndarray:
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + 1e-5)


class GatedMil:
    """A projection with GELU, gated attention over the bag, then a linear head."""

    def __init__(self, dim: int, hidden: int, seed: int, attention: int = 8):
        r = np.random.default_rng(seed)
        self.p, self.c = r.normal(0, dim**-0.5, (dim, hidden)), r.normal(0, 0.1, hidden)
        self.v, self.u = r.normal(0, hidden**-0.5, (hidden, attention)), r.normal(0, hidden**-0.5, (hidden, attention))
        self.bv, self.bu = r.normal(0, 0.1, attention), r.normal(0, 0.1, attention)
        self.w, self.head, self.bias = r.normal(0, attention**-0.5, attention), r.normal(0, hidden**-0.5, hidden), 0.1

    def items(self, bag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weight before it is divided by the bag's sum, value under the head) of each item; a weight is bounded, as both gates are."""
        h = gelu(bag @ self.p + self.c)
        a = (np.tanh(h @ self.v + self.bv) / (1 + np.exp(-(h @ self.u + self.bu)))) @ self.w
        return np.exp(a), h @ self.head

    def score(self, bag: np.ndarray) -> float:
        a, x = self.items(bag)
        return float(1 / (1 + np.exp(-(a @ x / a.sum() + self.bias))))


class MeanPoolMlp:
    """Linear, GELU, layer norm, linear over pooled vectors side by side."""

    def __init__(self, dim: int, hidden: int, seed: int):
        r = np.random.default_rng(seed)
        self.w, self.b = r.normal(0, dim**-0.5, (dim, hidden)), r.normal(0, 0.1, hidden)
        self.head = r.normal(0, hidden**-0.5, hidden)

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-layer_norm(gelu(z @ self.w + self.b)) @ self.head))
