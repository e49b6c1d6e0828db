"""Histogram gradient-boosted trees for two classes, kept as flat arrays.

fit() takes a bounded sample (its callers document the bound) and grows complete binary trees level by level
from per-bin gradient histograms. A model is three arrays; predict() walks all rows through all trees with numpy
indexing, so that tasks can score Arrow batches without a Python loop over rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """feature, threshold: [tree, inner node] in heap order; leaf: [tree, leaf]; bias: log odds before any tree."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    bias: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of class 1. A value goes right where it is above the threshold."""
        margin = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node[:1].size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            margin += v[node - inner]
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, bins: int = 64, rate: float = 0.2, least: float = 0.5, l2: float = 1.0) -> Trees:
    """Boost on the logistic loss. Without rows, or with one class only, the model is the smoothed share of class 1."""
    n, inner = len(y), 2**depth - 1
    share = (y.sum() + 1) / (n + 2) if n else 0.5
    bias = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, 2**depth)), bias)
    width = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    flat = (binned + np.arange(width) * bins).ravel()
    margin = np.full(n, bias)
    feature, threshold, leaf = (np.zeros((trees, k), t) for k, t in ((inner, np.int64), (inner, float), (2**depth, float)))
    threshold[:] = np.inf
    for k in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = np.repeat((node - first) * width * bins, width) + flat
            size = count * width * bins
            g = np.bincount(at, np.repeat(grad, width), size).reshape(count, width, bins).cumsum(axis=2)
            h = np.bincount(at, np.repeat(hess, width), size).reshape(count, width, bins).cumsum(axis=2)
            g_all, h_all = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + l2) + (g_all - g) ** 2 / (h_all - h + l2) - g_all**2 / (h_all + l2)
            gain[(h < least) | (h_all - h < least)] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            split_on, split_at = best // bins, best % bins
            for i in range(count):
                j, b = split_on[i], split_at[i]
                if gain[i, j, b] > 1e-9 and b < len(edges[j]):
                    feature[k, first + i], threshold[k, first + i] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[k, node]] > threshold[k, node])
        at = node - inner
        leaf[k] = rate * np.bincount(at, grad, 2**depth) / (np.bincount(at, hess, 2**depth) + l2)
        margin += leaf[k][at]
    return Trees(feature, threshold, leaf, bias)
