"""Gradient-boosted trees for a binary label, on histograms of quantile bins (numpy)."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Complete trees of one depth: the split feature and threshold of each inner node, the leaves' values."""

    depth: int
    base: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    threshold: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of label 1."""
        out = np.full(len(x), self.base)
        row = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[row, f[node]] > t[node])
            out += leaf[node - (2**self.depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, *, rounds: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 32, penalty: float = 1.0) -> Trees:
    """Boost log loss of labels from 0 to 1, by weight. Without rows the odds are even; with one
    label only, the base says it. Rows at the threshold go left; the gain of a split is that of
    Newton's step, the first best feature and bin win."""
    n = len(y)
    if not n:
        return Trees(depth)
    w = np.ones(n) if weight is None else weight
    mean = ((w * y).sum() + 0.5) / (w.sum() + 1.0)
    out = Trees(depth, float(np.log(mean / (1 - mean))))
    if y.min() == y.max():
        return out
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    score = np.full(n, out.base)
    inner = 2**depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = w * (y - p), w * p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            local = node - first
            gain, at = np.zeros(wide), np.zeros((wide, 2), np.int64)
            for j, e in enumerate(edges):
                k = len(e) + 1
                if k == 1:
                    continue
                key = local * k + binned[:, j]
                gs = np.bincount(key, g, wide * k).reshape(wide, k).cumsum(axis=1)
                hs = np.bincount(key, h, wide * k).reshape(wide, k).cumsum(axis=1)
                gl, hl, ga, ha = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                value = gl**2 / (hl + penalty) + (ga - gl) ** 2 / (ha - hl + penalty) - ga**2 / (ha + penalty)
                best = value.argmax(axis=1)
                top = value[np.arange(wide), best]
                better = top > gain + 1e-9
                gain[better], at[better, 0], at[better, 1] = top[better], j, best[better]
            for i in np.flatnonzero(gain > 0):
                feature[first + i], threshold[first + i] = at[i, 0], edges[at[i, 0]][at[i, 1]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        values = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + penalty)
        score += values[leaf]
        out.feature.append(feature)
        out.threshold.append(threshold)
        out.leaf.append(values)
    return out
