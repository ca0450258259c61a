"""Gradient-boosted trees for two classes, fitted on a small labelled table in memory."""

from __future__ import annotations

import numpy as np

BINS = 32


class BoostedTrees:
    """Trees of fixed depth on binned features, fitted to the logistic loss by Newton steps.

    Each tree is grown on a share of the rows, drawn anew (Friedman's stochastic gradient
    boosting), and corrects the margins of all.
    """

    def __init__(self, trees: int = 60, depth: int = 5, rate: float = 0.3, ridge: float = 1.0, least: float = 2.0, share: float = 0.4) -> None:
        self.trees, self.depth, self.rate, self.ridge, self.least, self.share = trees, depth, rate, ridge, least, share

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, k = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(k)]
        binned = self._binned(x)
        vary = np.flatnonzero((binned != binned[:1]).any(axis=0)) if n else np.empty(0, np.int64)
        flat = (binned[:, vary] + np.arange(len(vary)) * BINS).astype(np.int32)
        k = len(vary)
        self.start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        margin = np.full(n, self.start)
        self.features = np.zeros((self.trees, 2**self.depth - 1), np.int64)
        self.cuts = np.full((self.trees, 2**self.depth - 1), BINS, np.int64)  # by default all go left
        self.leaves = np.zeros((self.trees, 2**self.depth))
        rng = np.random.default_rng(0)
        for t in range(self.trees if k else 0):
            rows = np.flatnonzero(rng.random(n) < self.share) if n * self.share > 1000 else np.arange(n)
            chance = 1 / (1 + np.exp(-margin[rows]))
            pull, bend = y[rows] - chance, chance * (1 - chance)
            pulls, bends, cells = np.repeat(pull, k), np.repeat(bend, k), flat[rows]
            place = np.zeros(len(rows), np.int64)
            for level in range(self.depth):
                width = 2**level
                at = (place[:, None] * (k * BINS) + cells).ravel()
                shape = (width, k, BINS)
                g = np.bincount(at, pulls, width * k * BINS).reshape(shape).cumsum(axis=2)
                h = np.bincount(at, bends, width * k * BINS).reshape(shape).cumsum(axis=2)
                g_all, h_all = g[:, :1, -1:], h[:, :1, -1:]
                gain = g**2 / (h + self.ridge) + (g_all - g) ** 2 / (h_all - h + self.ridge) - g_all**2 / (h_all + self.ridge)
                gain[(h < self.least) | (h_all - h < self.least)] = 0
                best = gain.reshape(width, -1).argmax(axis=1)
                won = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
                nodes = slice(width - 1, 2 * width - 1)
                self.features[t, nodes] = np.where(won, vary[best // BINS], 0)
                self.cuts[t, nodes] = np.where(won, best % BINS, BINS)
                place = 2 * place + (binned[rows, self.features[t, nodes][place]] > self.cuts[t, nodes][place])
            g = np.bincount(place, pull, 2**self.depth)
            h = np.bincount(place, bend, 2**self.depth)
            self.leaves[t] = self.rate * g / (h + self.ridge)
            margin += self.leaves[t][self._places(binned, t)]
        return self

    def _places(self, binned: np.ndarray, t: int) -> np.ndarray:
        """The leaf of tree ``t`` that each row falls into."""
        rows, place = np.arange(len(binned)), np.zeros(len(binned), np.int64)
        for level in range(self.depth):
            node = place + 2**level - 1
            place = 2 * place + (binned[rows, self.features[t][node]] > self.cuts[t][node])
        return place

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(edges, x[:, j], side="left") for j, edges in enumerate(self.edges)], axis=1)

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of class 1 for each row."""
        if not len(x):
            return np.empty(0)
        binned = self._binned(x)
        total = np.full(len(x), self.start)
        for t in range(self.trees):
            total += self.leaves[t][self._places(binned, t)]
        return total
