"""One encoder layer in numpy: multi-head self-attention and a feed-forward part, each with its residual and a layer norm behind it.

Attention is worked out for a block of queries against a block of keys at a time; blocks of keys are merged by their highest scores, sums and
weighted sums, so the result is that of all keys at once, however they are cut.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from marlow.functions.gated import norm
from marlow.functions.networks import gelu


@dataclass
class Layer:
    """Weights by name (projections ``q k v o`` and feed-forward ``f1 f2`` with their biases, two layer norms) and the number of heads."""

    weights: dict[str, np.ndarray]
    heads: int

    @classmethod
    def fixed(cls, dim: int, heads: int = 4, hidden: int = 32, seed: int = 11) -> Layer:
        """Weights from a seed, where none were trained."""
        r = np.random.default_rng(seed)
        w: dict[str, np.ndarray] = {}
        for name, a, b in (("q", dim, dim), ("k", dim, dim), ("v", dim, dim), ("o", dim, dim), ("f1", dim, hidden), ("f2", hidden, dim)):
            w[name], w[f"{name}_bias"] = r.normal(0, a**-0.5, (a, b)), r.normal(0, 0.05, b)
        for name in ("norm1", "norm2"):
            w[name], w[f"{name}_bias"] = 1 + r.normal(0, 0.05, dim), r.normal(0, 0.05, dim)
        return cls(w, heads)

    def _split(self, x: np.ndarray, name: str) -> np.ndarray:
        y = x @ self.weights[name] + self.weights[f"{name}_bias"]
        return y.reshape(len(x), self.heads, -1).transpose(1, 0, 2)

    def attended(self, x: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(highest score, sum, weighted sum of values) of each head and row of ``x`` over ``keys``."""
        q, k, v = self._split(x, "q"), self._split(keys, "k"), self._split(keys, "v")
        score = q @ k.transpose(0, 2, 1) / np.sqrt(q.shape[2])
        top = score.max(2, keepdims=True)
        e = np.exp(score - top)
        return top[..., 0], e.sum(2), e @ v

    @staticmethod
    def merged(a: tuple, b: tuple) -> tuple:
        top = np.maximum(a[0], b[0])
        f, g = np.exp(a[0] - top), np.exp(b[0] - top)
        return top, a[1] * f + b[1] * g, a[2] * f[..., None] + b[2] * g[..., None]

    def finished(self, x: np.ndarray, attended: tuple) -> np.ndarray:
        """The layer's output for the rows ``x`` and what they attended to."""
        w = self.weights
        mixed = (attended[2] / attended[1][..., None]).transpose(1, 0, 2).reshape(len(x), -1)
        x = norm(x + mixed @ w["o"] + w["o_bias"])[0] * w["norm1"] + w["norm1_bias"]
        y = x + gelu(x @ w["f1"] + w["f1_bias"]) @ w["f2"] + w["f2_bias"]
        return norm(y)[0] * w["norm2"] + w["norm2_bias"]
