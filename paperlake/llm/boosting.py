"""Gradient-boosted trees for two classes: logistic loss, binned features, trees of one fixed depth.

Each tree is grown on a seeded half of the rows and a third of the features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Boosted:
    """Complete binary trees; node k of a tree has children 2k+1 and 2k+2, leaves stand in the last level."""

    features: np.ndarray  # (trees, inner nodes)
    thresholds: np.ndarray  # a row goes right if its feature is above
    leaves: np.ndarray  # (trees, leaves)
    start: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The log-odds of each row."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        depth = self.leaves.shape[1].bit_length() - 1
        for feature, threshold, leaf in zip(self.features, self.thresholds, self.leaves):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        return total


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, ridge: float = 1.0, seed: int = 5) -> Boosted:
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T)], axis=1)
    width = BINS + 1
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    start = float(np.log(share / (1 - share)))
    score = np.full(len(x), start)
    n_inner = (1 << depth) - 1
    features = np.zeros((trees, n_inner), dtype=np.int64)
    thresholds = np.full((trees, n_inner), np.inf)
    leaves = np.zeros((trees, 1 << depth))
    random = np.random.default_rng(seed)
    for t in range(trees):
        rows = np.flatnonzero(random.random(len(x)) < 0.5)
        columns = np.flatnonzero(random.random(x.shape[1]) < 1 / 3)
        p = 1 / (1 + np.exp(-score))
        slope, curve = y - p, p * (1 - p)
        node = np.zeros(len(x), dtype=np.int64)
        half, slope_half, curve_half = binned[rows], slope[rows], curve[rows]
        for level in range(depth):
            first, n = (1 << level) - 1, 1 << level
            best, where = np.zeros(n), np.full((n, 2), -1)
            base = (node[rows] - first) * width
            for f in columns:
                slot = base + half[:, f]
                g = np.bincount(slot, slope_half, n * width).reshape(n, width).cumsum(axis=1)
                h = np.bincount(slot, curve_half, n * width).reshape(n, width).cumsum(axis=1)
                rest_g, rest_h = g[:, -1:] - g, h[:, -1:] - h
                gain = g**2 / (h + ridge) + rest_g**2 / (rest_h + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                gain = gain[:, : len(edges[f])]
                if gain.shape[1]:
                    at = gain.argmax(axis=1)
                    better = gain[np.arange(n), at] > best + 1e-9
                    best[better] = gain[np.arange(n), at][better]
                    where[better] = np.stack([np.full(n, f), at], axis=1)[better]
            split = where[:, 0] >= 0
            features[t, first : first + n] = np.maximum(where[:, 0], 0)
            thresholds[t, first : first + n] = [edges[f][b] if f >= 0 else np.inf for f, b in where]
            mine = node - first
            right = split[mine] & (binned[np.arange(len(x)), np.maximum(where[mine, 0], 0)] > where[mine, 1])
            node = 2 * node + 1 + right
        leaf = node - n_inner
        g, h = np.bincount(leaf, slope, 1 << depth), np.bincount(leaf, curve, 1 << depth)
        leaves[t] = rate * g / (h + ridge)
        score += leaves[t][leaf]
    return Boosted(features, thresholds, leaves, start)
