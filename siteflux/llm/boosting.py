"""Gradient-boosted trees for a two-class problem, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Trees:
    """Full binary trees: at node k of a tree, x[feature] > cut goes to 2k + 2, else to 2k + 1."""

    features: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray
    start: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.features, self.cuts, self.leaves):
            k = np.zeros(len(x), "int64")
            for _ in range(self.depth):
                k = 2 * k + 1 + (x[rows, f[k]] > c[k])
            out += leaf[k - (2**self.depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Logistic loss, second-order gains on histograms of at most so many bins a feature."""
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(e, column, "left") for e, column in zip(edges, x.T)], 1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    margin, nodes = np.full(len(y), start), 2**depth - 1
    all_f, all_c, all_l = [], [], []
    for _ in range(rounds):
        p = _sigmoid(margin)
        g, h = y - p, p * (1 - p)
        f, c, at = np.zeros(nodes, "int64"), np.full(nodes, np.inf), np.zeros(len(y), "int64")
        for k in range(nodes):
            own = np.flatnonzero(at == k)
            best, split = 1e-9, None
            if len(own) > 1:
                gs, hs = g[own].sum(), h[own].sum()
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[own, j]
                    gl = np.cumsum(np.bincount(b, g[own], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, h[own], len(e) + 1))[:-1]
                    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                    i = int(gain.argmax())
                    if gain[i] > best:
                        best, split = gain[i], (j, e[i])
            if split:
                f[k], c[k] = split
            at[own] = 2 * k + 1 + (x[own, f[k]] > c[k])
        leaf_of = at - nodes
        leaf = rate * np.bincount(leaf_of, g, nodes + 1) / (np.bincount(leaf_of, h, nodes + 1) + ridge)
        margin += leaf[leaf_of]
        all_f.append(f), all_c.append(c), all_l.append(leaf)
    return Trees(np.array(all_f), np.array(all_c), np.array(all_l), start, depth)


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a and b of the calibrated probability sigmoid(a * margin + b)."""
    z = np.stack([margin, np.ones_like(margin)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(z @ w)
        hessian = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, z.T @ (y - p) - 1e-3 * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def threshold(probability: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least threshold from which on the held-out precision is at least as asked for: half way to the next lower
    probability. Rows of one probability go together."""
    order = np.argsort(-probability, kind="stable")
    p, hits = probability[order], np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(p[1:] < p[:-1], True)[: len(p)]
    good = np.flatnonzero((hits >= precision) & last)
    if not len(good):
        return 1.1
    k = int(good[-1])
    return float((p[k] + p[k + 1]) / 2) if k + 1 < len(p) else float(p[k] / 2)
