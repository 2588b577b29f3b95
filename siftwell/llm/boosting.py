"""A small gradient-boosted tree classifier (logistic loss, Newton leaves) for a few thousand rows of few-valued features."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Trees are arrays (feature, cut, left, right, value); a row goes left where its feature is at most cut."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0, least: int = 10, cuts: int = 24):
        self.n, self.depth, self.rate, self.ridge, self.least, self.cuts = trees, depth, rate, ridge, least, cuts
        self.prior, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> BoostedTrees:
        """weight: how many rows each of x stands for, one by default."""
        w = np.ones(len(y)) if weight is None else weight
        share = ((w * y).sum() + 0.5) / (w.sum() + 1)
        self.prior = float(np.log(share / (1 - share)))
        edges = [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, self.cuts)))[:-1] for c in x.T]
        bins = [np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)]
        z = np.full(len(y), self.prior)
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-z))
            tree: list[list] = []
            self._grow(tree, np.arange(len(y)), edges, bins, w, w * (p - y), w * p * (1 - p), self.depth)
            self.trees.append([np.array(c) for c in zip(*tree)])
            z += self._leaf(self.trees[-1], x)
        return self

    def _grow(self, tree: list, rows: np.ndarray, edges: list, bins: list, w: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> int:
        at, gs, hs = len(tree), g[rows].sum(), h[rows].sum()
        tree.append([-1, 0.0, at, at, -self.rate * gs / (hs + self.ridge)])
        best, choice = 1e-3, None
        for f, (e, b) in enumerate(zip(edges, bins)):
            if not depth or not len(e):
                continue
            k = b[rows]
            count = np.bincount(k, w[rows], len(e) + 1).cumsum()[:-1]
            gl = np.bincount(k, g[rows], len(e) + 1).cumsum()[:-1]
            hl = np.bincount(k, h[rows], len(e) + 1).cumsum()[:-1]
            gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge)
            gain[(count < self.least) | (w[rows].sum() - count < self.least)] = 0
            if gain.max() > best:
                best, choice = gain.max(), (f, int(gain.argmax()))
        if choice:
            f, i = choice
            left = bins[f][rows] <= i
            tree[at][:2] = [f, float(edges[f][i])]
            tree[at][2] = self._grow(tree, rows[left], edges, bins, w, g, h, depth - 1)
            tree[at][3] = self._grow(tree, rows[~left], edges, bins, w, g, h, depth - 1)
        return at

    def _leaf(self, tree: list, x: np.ndarray) -> np.ndarray:
        feature, cut, left, right, value = tree
        node = np.zeros(len(x), int)
        for _ in range(self.depth):
            f = feature[node]
            go = x[np.arange(len(x)), np.maximum(f, 0)] <= cut[node]
            node = np.where(f < 0, node, np.where(go, left[node], right[node])).astype(int)
        return value[node]

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.prior)
        for t in self.trees:
            z += self._leaf(t, x)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
