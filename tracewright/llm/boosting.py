"""Gradient-boosted regression trees for a yes-or-no label, small enough to fit on the driver and to score in any task."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete trees of one depth: per tree and inner node a feature and a threshold (right if above), per leaf a log-odds step."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1]))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += leaf[node - (leaf.shape[0] - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, smooth: float = 2.0, seed: int = 3, columns: float = 0.5) -> Trees:
    """Newton boosting of the logistic loss over quantile bins; each tree sees a seeded share of the columns, which spreads the evidence."""
    chooser = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    rate_of = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = float(np.log(rate_of / (1 - rate_of)))
    score = np.full(len(y), base)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        some = np.sort(chooser.choice(x.shape[1], max(1, int(columns * x.shape[1])), replace=False))
        f, t = np.zeros(2**depth - 1, dtype=np.int64), np.full(2**depth - 1, np.inf)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            own = node - first
            best = np.full(wide, 1e-6)
            total_g, total_h = np.bincount(own, g, wide), np.bincount(own, h, wide)
            for j in some:
                size = len(edges[j]) + 1
                if size < 2:
                    continue
                at = own * size + binned[:, j]
                left_g = np.bincount(at, g, wide * size).reshape(wide, size).cumsum(axis=1)[:, :-1]
                left_h = np.bincount(at, h, wide * size).reshape(wide, size).cumsum(axis=1)[:, :-1]
                right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                gain = left_g**2 / (left_h + smooth) + right_g**2 / (right_h + smooth) - (total_g**2 / (total_h + smooth))[:, None]
                gain[(left_h < 1) | (right_h < 1)] = -1
                k = gain.argmax(axis=1)
                high = gain[np.arange(wide), k]
                for w in np.flatnonzero(high > best):
                    best[w], f[first + w], t[first + w] = high[w], j, edges[j][k[w]]
            node = 2 * node + 1 + (x[np.arange(len(y)), f[node]] > t[node])
        at = node - (2**depth - 1)
        leaf = rate * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + smooth)
        score += leaf[at]
        features.append(f)
        thresholds.append(t)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(thresholds), np.array(leaves), base)
