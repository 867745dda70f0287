"""Gradient-boosted trees on histograms with logistic loss, and isotonic calibration; numpy only."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete trees of one depth: node i has children 2i + 1 and 2i + 2; leaves hold steps of the log odds."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # values <= cut go left
    leaf: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        inner = self.feature.shape[1] if len(self.feature) else 0
        depth = (inner + 1).bit_length() - 1
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - inner]
        return out


def fit_trees(
    x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, ridge: float = 2.0, least_weight: float = 1.0
) -> Trees:
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(width) * bins
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    margin = np.full(n, np.log(mean / (1 - mean)))
    inner, leaves = 2**depth - 1, 2**depth
    features, cuts, leaf_values = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (width * bins) + flat).ravel()
            shape = (count, width, bins)
            g = np.bincount(at, np.repeat(grad, width), count * width * bins).reshape(shape).cumsum(axis=2)
            h = np.bincount(at, np.repeat(hess, width), count * width * bins).reshape(shape).cumsum(axis=2)
            gt, ht = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt**2 / (ht + ridge)
            gain[(h < least_weight) | (ht - h < least_weight)] = -1
            for j, e in enumerate(edges):
                gain[:, j, len(e) :] = -1
            best = gain.reshape(count, -1).argmax(axis=1)
            for k in range(count):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-9:
                    feature[first + k], cut[first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        place = node - inner
        value = rate * np.bincount(place, grad, leaves) / (np.bincount(place, hess, leaves) + ridge)
        margin += value[place]
        features.append(feature)
        cuts.append(cut)
        leaf_values.append(value)
    shape = (len(features), inner)
    return Trees(float(np.log(mean / (1 - mean))), np.array(features, np.int64).reshape(shape), np.array(cuts).reshape(shape), np.array(leaf_values).reshape(-1, leaves))


@dataclass
class Isotonic:
    """A non-decreasing function, linear between its knots and constant beyond them."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.at, self.value)


def fit_isotonic(margin: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pools adjacent violators; each pool stands at its mean margin. One observation of each label is added at the ends."""
    order = np.argsort(margin, kind="stable")
    pools: list[list[float]] = []  # weight, sum of labels, sum of margins
    low, high = margin[order[0]], margin[order[-1]]
    for m, label in [(low, 0.0), *zip(margin[order], y[order], strict=True), (high, 1.0)]:
        pools.append([1.0, float(label), float(m)])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            top = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], top, strict=True)]
    return Isotonic(np.array([p[2] / p[0] for p in pools]), np.array([p[1] / p[0] for p in pools]))
