"""Gradient-boosted trees for a binary target, and isotonic calibration, in numpy.

Training runs on the driver over a bounded sample; a fitted model is a few
kilobytes and travels to executors inside the task.
"""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Log-loss boosting of complete trees of one depth, split on quantile bins."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.l2, self.least = trees, depth, rate, bins, l2, least
        self.base, self.features, self.cuts, self.leaves = 0.0, [], [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """x: rows by features, finite. y: 0 or 1. One class, or no row, gives a constant model."""
        n, width = x.shape if x.size else (len(y), 0)
        rate = (float(np.sum(y)) + 0.5) / (len(y) + 1.0)
        self.base = float(np.log(rate / (1 - rate)))
        if n == 0 or width == 0 or len(np.unique(y)) < 2:
            return self
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(width)]
        # A feature that is mostly one value still gets cuts among its other values.
        for f in range(width):
            rest = x[x[:, f] != np.median(x[:, f]), f]
            if len(edges[f]) < self.bins // 4 and len(rest):
                edges[f] = np.unique(np.concatenate([edges[f], np.quantile(rest, np.linspace(0, 1, self.bins // 2))]))
        code = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], axis=1)
        size = max(len(e) for e in edges) + 1
        margin = np.full(n, self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            feats, cuts = np.zeros(2**self.depth - 1, int), np.full(2**self.depth - 1, np.inf)
            node = np.zeros(n, int)
            for d in range(self.depth):
                first, count = 2**d - 1, 2**d
                best = np.full(count, 1e-6)
                at = node - first
                total_g, total_h = np.bincount(at, g, count), np.bincount(at, h, count)
                for f in range(width):
                    if not len(edges[f]):
                        continue
                    key = at * size + code[:, f]
                    left_g = np.cumsum(np.bincount(key, g, count * size).reshape(count, size), axis=1)[:, : len(edges[f])]
                    left_h = np.cumsum(np.bincount(key, h, count * size).reshape(count, size), axis=1)[:, : len(edges[f])]
                    right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                    gain = left_g**2 / (left_h + self.l2) + right_g**2 / (right_h + self.l2) - (total_g**2 / (total_h + self.l2))[:, None]
                    gain[(left_h < self.least) | (right_h < self.least)] = 0
                    top = gain.argmax(axis=1)
                    better = gain[np.arange(count), top] > best
                    best[better] = gain[np.arange(count), top][better]
                    feats[first : first + count][better] = f
                    cuts[first : first + count][better] = edges[f][top[better]]
                node = 2 * node + 1 + (x[np.arange(n), feats[node]] > cuts[node])
            leaf = node - (2**self.depth - 1)
            value = -self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.l2)
            margin = margin + value[leaf]
            self.features.append(feats)
            self.cuts.append(cuts)
            self.leaves.append(value)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feats, cuts, value in zip(self.features, self.cuts, self.leaves):
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feats[node]] > cuts[node])
            out += value[node - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


class Isotonic:
    """Non-decreasing least-squares map from a margin to a probability (pool adjacent violators)."""

    def __init__(self):
        self.x, self.y = np.array([0.0]), np.array([0.5])

    def fit(self, margin: np.ndarray, y: np.ndarray) -> Isotonic:
        if not len(y):
            return self
        xs, inverse = np.unique(margin, return_inverse=True)
        weight = np.bincount(inverse).astype(float)
        mean = np.bincount(inverse, y) / weight
        blocks: list[list[float]] = []
        for v, w in zip(mean, weight):
            blocks.append([v, w, 1])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                v2, w2, n2 = blocks.pop()
                v1, w1, n1 = blocks.pop()
                blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
        # Half a pseudo-case of each class keeps small blocks off 0 and 1.
        fitted = np.repeat([(v * w + 0.5 * 0.5) / (w + 0.5) for v, w, _ in blocks], [int(n) for _, _, n in blocks])
        self.x, self.y = xs, np.maximum.accumulate(fitted)
        return self

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.x, self.y)
