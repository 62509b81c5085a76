"""Gradient-boosted trees for two classes, on binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """Trees of one depth as heaps: feature and threshold of each inner node, value of each leaf."""

    features: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray
    start: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.features.shape[1]
        for feature, threshold, leaf in zip(self.features, self.thresholds, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            while node[0] < inner if len(node) else False:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, penalty: float = 1.0) -> Boosted:
    """Newton boosting of the logistic loss; each split is the best over all features and bins."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    n, m = x.shape
    start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    score = np.full(n, start)
    inner = 2**depth - 1
    features, thresholds, leaves = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    flat = binned + np.arange(m) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        slope, curve = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for k in range(inner):
            here = np.flatnonzero(node == k)
            if len(here) < 2:
                node[here] = 2 * k + 1
                continue
            cells = flat[here].ravel()
            g = np.bincount(cells, np.repeat(slope[here], m), bins * m).reshape(m, bins).cumsum(1)
            h = np.bincount(cells, np.repeat(curve[here], m), bins * m).reshape(m, bins).cumsum(1)
            g_all, h_all = g[:, -1:], h[:, -1:]
            gain = g**2 / (h + penalty) + (g_all - g) ** 2 / (h_all - h + penalty) - g_all**2 / (h_all + penalty)
            f, b = np.unravel_index(np.argmax(gain), gain.shape)
            if gain[f, b] > 1e-9 and b < len(cuts[f]):
                features[t, k], thresholds[t, k] = f, cuts[f][b]
            right = x[here, features[t, k]] > thresholds[t, k]
            node[here] = 2 * k + 1 + right
        leaf = node - inner
        g, h = np.bincount(leaf, slope, inner + 1), np.bincount(leaf, curve, inner + 1)
        leaves[t] = rate * g / (h + penalty)
        score += leaves[t][leaf]
    return Boosted(features, thresholds, leaves, start)
