"""Histogram gradient-boosted trees for two classes: fitted on a bounded matrix, flattened into arrays, traversed with numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth: node i has children 2i + 1 and 2i + 2. `feature` and `threshold` are (trees, inner nodes), `value` is (trees, leaves)."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 for each row."""
        n, trees = len(x), len(self.feature)
        node = np.zeros((n, trees), np.int64)
        rows, each = np.arange(n)[:, None], np.arange(trees)[None, :]
        inner = self.feature.shape[1]
        while inner and node.shape[1] and int(node.flat[0] if node.size else inner) < inner:
            node = 2 * node + 1 + (x[rows, self.feature[each, node]] > self.threshold[each, node])
        total = self.base + self.value[each, node - inner].sum(axis=1) if trees else np.full(n, self.base)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, least: float = 2.0) -> Trees:
    """Logistic loss. Without rows of both classes the score is constant: the share of class 1, one half where there are no rows."""
    n, width = x.shape
    share = (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(share / (1 - share)))
    inner = (1 << depth) - 1
    if n == 0 or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    slots = width * bins
    place = binned + np.arange(width) * bins
    cuts = np.full((width, bins), np.inf)
    for f, e in enumerate(edges):
        cuts[f, : len(e)] = e
    total = np.full(n, base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, many = (1 << level) - 1, 1 << level
            at = ((node - first)[:, None] * slots + place).ravel()
            sums = [np.bincount(at, np.repeat(w, width), many * slots).reshape(many, width, bins) for w in (grad, hess)]
            left = [s.cumsum(axis=2) for s in sums]
            right = [a[:, :, -1:] - a for a in left]
            gain = left[0] ** 2 / (left[1] + l2) + right[0] ** 2 / (right[1] + l2) - (left[0] + right[0]) ** 2 / (left[1] + right[1] + l2)
            gain[(left[1] < least) | (right[1] < least) | ~np.isfinite(cuts)[None]] = -1.0
            best = gain.reshape(many, slots).argmax(axis=1)
            good = gain.reshape(many, slots)[np.arange(many), best] > 1e-9
            feature[first : first + many] = np.where(good, best // bins, 0)
            threshold[first : first + many] = np.where(good, cuts.ravel()[best], np.inf)
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + l2)
        total += value[leaf]
        features.append(feature), thresholds.append(threshold), values.append(value)
    return Trees(np.array(features), np.array(thresholds), np.array(values), base)
