"""Gradient-boosted trees for a handful of features: logistic loss, histogram splits, NumPy only."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Additive model of shallow trees; each is stored as flat arrays of a complete binary tree."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, least: int = 5):
        self.n, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        code = np.stack([np.searchsorted(k, c, side="left") for k, c in zip(cuts, x.T)], axis=1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        f, self.trees = np.full(len(y), self.base), []
        inner = (1 << self.depth) - 1
        for _ in range(self.n):
            q = 1 / (1 + np.exp(-f))
            g, h = y - q, q * (1 - q)
            feat, thr = np.zeros(inner, np.int64), np.full(inner, np.inf)
            node = np.zeros(len(y), np.int64)
            for k in range(inner):
                at = np.flatnonzero(node == k)
                best = (1e-9, None, None)
                if len(at) >= 2 * self.least:
                    gt, ht = g[at].sum(), h[at].sum()
                    for j, cut in enumerate(cuts):
                        m = len(cut) + 1
                        gs, hs, ns = (np.cumsum(np.bincount(code[at, j], w, m))[:-1] for w in (g[at], h[at], None))
                        if len(gs):
                            gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                            gain[(ns < self.least) | (len(at) - ns < self.least)] = -1
                            s = int(gain.argmax())
                            if gain[s] > best[0]:
                                best = (gain[s], j, cut[s])
                if best[1] is not None:
                    feat[k], thr[k] = best[1], best[2]
                node[at] = 2 * k + 1 + (x[at, feat[k]] > thr[k])
            leaf = np.zeros(inner + 1)
            for k in range(inner + 1):
                at = node == inner + k
                leaf[k] = self.rate * g[at].sum() / (h[at].sum() + 1)
            f = f + leaf[node - inner]
            self.trees.append((feat, thr, leaf))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of class 1."""
        x = np.asarray(x, np.float64)
        f = np.full(len(x), self.base)
        inner, rows = (1 << self.depth) - 1, np.arange(len(x))
        for feat, thr, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feat[node]] > thr[node])
            f += leaf[node - inner]
        return 1 / (1 + np.exp(-f))
