"""The gated evidence model in numpy: one forward pass for the queries of both kinds, and its gradient by hand.

A subject brings the items that each query retrieved and one summary vector of its notes and of its codes.  Each query attends
to its items (softmax of their dot product with the query of unit length, over a temperature); its expert adds a residual
(layer norm, linear, GELU, linear); experts whose gate is open are averaged, layer-normalised and scored by a linear head.  A gate is open where
the sigmoid of the cosine of summary and query is above that of its threshold; the first query's always is.  The gate's
gradient is passed straight through.  With ``concat`` the experts over notes and those over codes are averaged
and normalised apart and put side by side before the head.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from marlow.functions.networks import gelu, gelu_slope

EPSILON = 1e-5


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def unit_back(x: np.ndarray, g: np.ndarray) -> np.ndarray:
    n = np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)
    u = x / n
    return (g - u * (u * g).sum(-1, keepdims=True)) / n


def norm(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(normalised, deviation) over the last axis."""
    s = np.sqrt(x.var(-1, keepdims=True) + EPSILON)
    return (x - x.mean(-1, keepdims=True)) / s, s


def norm_back(n: np.ndarray, s: np.ndarray, g: np.ndarray) -> np.ndarray:
    return (g - g.mean(-1, keepdims=True) - n * (g * n).mean(-1, keepdims=True)) / s


@dataclass
class Subject:
    """What one subject brings: items (queries, k, width), which of them are real, its summaries (notes, codes; null where it has none)."""

    items: np.ndarray
    real: np.ndarray
    summaries: np.ndarray
    gates: np.ndarray | None = None  # given gates, else those of the summaries
    ids: np.ndarray | None = None  # of the items


@dataclass
class Gated:
    """Weights by name, and the number of queries over notes (the others are over codes)."""

    weights: dict[str, np.ndarray]
    notes: int
    temperature: float = 0.5
    concat: bool = False
    static: bool = False  # all gates open
    kinds: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.kinds = (np.arange(len(self.weights["queries"])) >= self.notes).astype(int)

    @classmethod
    def fixed(cls, queries: np.ndarray, notes: int, hidden: int = 16, theta: float = -0.02, **how) -> Gated:
        """Weights by a rule, where none were trained."""
        n, d = queries.shape
        q, i, j = np.arange(n)[:, None, None], np.arange(d), np.arange(hidden)
        sides = 1 + bool(how.get("concat"))
        head = ((i * 37) % 64 - 31.5) / 64
        weights = {
            "queries": queries.astype(float),
            "theta": np.full(n - 1, theta),
            "gain": np.ones((n, d)),
            "shift": np.zeros((n, d)),
            "w1": ((i[None, :, None] * 31 + j * 17 + q * 13) % 61 - 30) / 150,
            "b1": ((j * 7 + q[:, 0] * 3) % 11 - 5) / 50,
            "w2": ((j[None, :, None] * 29 + i * 19 + q * 7) % 53 - 26) / 100,
            "b2": ((i * 5 + q[:, 0] * 11) % 13 - 6) / 100,
            "final_gain": np.ones((sides, d)),
            "final_shift": np.zeros((sides, d)),
            "head": np.stack([head, -head][:sides]),
            "bias": np.zeros(1),
            "summary_gain": np.ones(d),
            "summary_shift": np.zeros(d),
        }
        return cls(weights, notes, **how)

    def gates(self, s: Subject) -> tuple[np.ndarray, dict]:
        """(open as 0 or 1, what the gradient needs)."""
        w = self.weights
        if s.gates is not None or self.static:
            return np.ones(len(w["queries"])) if s.gates is None else s.gates.astype(float), {}
        n, dev = norm(s.summaries)
        summary = n * w["summary_gain"] + w["summary_shift"]
        of = summary[self.kinds]
        u, v = unit(of), unit(w["queries"])
        cos = (u * v).sum(1)
        above = sigmoid(cos[1:]) > sigmoid(w["theta"])
        return np.r_[1.0, above.astype(float)], {"n": n, "dev": dev, "of": of, "u": u, "v": v, "cos": cos}

    def forward(self, s: Subject) -> tuple[float, dict]:
        """(logit, all that the gradient needs)."""
        w = self.weights
        queries = unit(w["queries"])
        score = np.where(s.real, np.einsum("nkd,nd->nk", s.items, queries) / self.temperature, -np.inf)
        some = s.real.any(1)
        score[~some] = 0
        a = np.exp(score - score.max(1, keepdims=True)) * s.real
        a /= np.maximum(a.sum(1, keepdims=True), 1e-300)
        context = np.einsum("nk,nkd->nd", a, s.items)
        n1, d1 = norm(context)
        z = n1 * w["gain"] + w["shift"]
        pre = np.einsum("nd,ndh->nh", z, w["w1"]) + w["b1"]
        act = gelu(pre)
        out = context + np.einsum("nh,nhd->nd", act, w["w2"]) + w["b2"]
        open_, gate = self.gates(s)
        sides = [self.kinds == 0, self.kinds == 1] if self.concat else [np.ones(len(open_), bool)]
        count = np.array([max(1.0, open_[k].sum()) for k in sides])
        mixed = np.stack([(out[k] * open_[k, None]).sum(0) / c for k, c in zip(sides, count)])
        n2, d2 = norm(mixed)
        final = n2 * w["final_gain"] + w["final_shift"]
        logit = float((final * w["head"]).sum() + w["bias"][0])
        return logit, {"a": a, "q": queries, "n1": n1, "d1": d1, "z": z, "pre": pre, "act": act, "out": out, "open": open_, "gate": gate, "sides": sides, "count": count, "n2": n2, "d2": d2, "final": final}

    def probability(self, s: Subject) -> float:
        return float(sigmoid(np.float64(self.forward(s)[0])))

    def backward(self, s: Subject, c: dict, g: float) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of ``g * logit`` to all weights and to the items."""
        w = self.weights
        grads = {k: np.zeros_like(v) for k, v in w.items()}
        grads["head"], grads["bias"][0] = g * c["final"], g
        df = g * w["head"]
        grads["final_gain"], grads["final_shift"] = df * c["n2"], df
        dm = norm_back(c["n2"], c["d2"], df * w["final_gain"])
        dout, dopen = np.zeros_like(c["out"]), np.zeros(len(c["open"]))
        for k, n, x in zip(c["sides"], c["count"], dm):
            dout[k] = c["open"][k, None] * x / n
            dopen[k] = c["out"][k] @ x / n
        grads["b2"], grads["w2"] = dout, np.einsum("nh,nd->nhd", c["act"], dout)
        dpre = np.einsum("nd,nhd->nh", dout, w["w2"]) * gelu_slope(c["pre"])
        grads["b1"], grads["w1"] = dpre, np.einsum("nd,nh->ndh", c["z"], dpre)
        dz = np.einsum("nh,ndh->nd", dpre, w["w1"])
        grads["gain"], grads["shift"] = dz * c["n1"], dz
        dcontext = dout + norm_back(c["n1"], c["d1"], dz * w["gain"])
        t = np.einsum("nkd,nd->nk", s.items, dcontext)
        dscore = c["a"] * (t - (c["a"] * t).sum(1, keepdims=True)) / self.temperature
        ditems = c["a"][..., None] * dcontext[:, None] + dscore[..., None] * c["q"][:, None]
        dq = unit_back(w["queries"], np.einsum("nk,nkd->nd", dscore, s.items))
        if p := c["gate"]:  # straight through: as if the gate were sigmoid(cos) - sigmoid(theta)
            dopen[0] = 0
            dcos = dopen * sigmoid(p["cos"]) * (1 - sigmoid(p["cos"]))
            grads["theta"] = -dopen[1:] * sigmoid(w["theta"]) * (1 - sigmoid(w["theta"]))
            dq += unit_back(w["queries"], dcos[:, None] * p["u"])
            dof = unit_back(p["of"], dcos[:, None] * p["v"])
            for k in (0, 1):
                x = dof[self.kinds == k].sum(0)
                grads["summary_gain"] += x * p["n"][k]
                grads["summary_shift"] += x
        grads["queries"] = dq
        return grads, ditems * s.real[..., None]

    def attributed(self, s: Subject, start: np.ndarray, steps: int = 50) -> np.ndarray:
        """Integrated gradients of the probability to each item, on the way from ``start`` by the trapezoid rule; gates stay."""
        held = Subject(s.items, s.real, s.summaries, self.gates(s)[0])
        delta, total = s.items - start, np.zeros_like(s.items)
        for k in range(steps + 1):
            at = Subject(start + delta * (k / steps), s.real, s.summaries, held.gates)
            logit, c = self.forward(at)
            p = float(sigmoid(np.float64(logit)))
            total += self.backward(at, c, p * (1 - p))[1] * (0.5 if k in (0, steps) else 1.0)
        return (total * delta).sum(2) / steps * s.real

    def diversity(self, simple: float = 0.1) -> tuple[float, np.ndarray]:
        """Auxiliary loss of the queries but the first, and its gradient: squared distance of their cosines from the identity, and ``simple`` times
        their mean squared norm."""
        q = self.weights["queries"][1:]
        grad = np.zeros_like(self.weights["queries"])
        if not len(q):
            return 0.0, grad
        u = unit(q)
        gap = u @ u.T - np.eye(len(q))
        grad[1:] = unit_back(q, 4 * gap @ u) + simple * 2 * q / len(q)
        return float((gap**2).sum() + simple * (q**2).sum() / len(q)), grad
