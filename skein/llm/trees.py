"""Gradient-boosted trees in numpy, for small feature tables."""

from __future__ import annotations

import numpy as np

BINS = 32


class Trees:
    """Trees of fixed depth over binned features; node k has children 2k+1 and 2k+2."""

    def __init__(self, edges: list[np.ndarray], feature: np.ndarray, cut: np.ndarray, value: np.ndarray, bias: float, depth: int) -> None:
        self.edges, self.feature, self.cut, self.value, self.bias, self.depth = edges, feature, cut, value, bias, depth

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1).astype(np.int8)
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, f[node]] > c[node])
            out += v[node - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.25, damp: float = 2.0) -> Trees:
    """Boosting of the logistic loss with second-order leaf values and histogram splits."""
    n, m = x.shape
    edges = []
    for j in range(m):
        u = np.unique(x[:, j])
        e = (u[1:] + u[:-1]) / 2
        edges.append(e if len(e) < BINS else np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])))
    b = np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], axis=1)
    flat = b + np.arange(m) * (BINS + 1)
    mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if n else 0.5
    bias = float(np.log(mean / (1 - mean)))
    f = np.full(n, bias)
    features, cuts, values = [], [], []
    inner = 2**depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        feat, cut = np.zeros(inner, np.int64), np.full(inner, BINS + 1)
        for k in range(inner):
            at = np.flatnonzero(node == k)
            if len(at) < 10:
                node[at] = 2 * k + 1
                continue
            width = m * (BINS + 1)
            place = flat[at].ravel()
            hg = np.bincount(place, np.repeat(g[at], m), width).reshape(m, -1).cumsum(axis=1)
            hh = np.bincount(place, np.repeat(h[at], m), width).reshape(m, -1).cumsum(axis=1)
            gain = hg**2 / (hh + damp) + (hg[:, -1:] - hg) ** 2 / (hh[:, -1:] - hh + damp) - hg[:, -1:] ** 2 / (hh[:, -1:] + damp)
            j, c = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[j, c] > 1e-3:
                feat[k], cut[k] = j, c
            node[at] = 2 * k + 1 + (b[at, feat[k]] > cut[k])
        leaf = node - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + damp)
        f += value[leaf]
        features.append(feat)
        cuts.append(cut)
        values.append(value)
    return Trees(edges, np.array(features), np.array(cuts), np.array(values), bias, depth)
