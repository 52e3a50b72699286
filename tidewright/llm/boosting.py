"""Gradient-boosted trees for a binary label, on histograms (NumPy only)."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 32


@dataclass
class Boosted:
    """Logistic loss, depth-limited trees; scores are log-odds."""

    trees: int = 60
    depth: int = 4
    rate: float = 0.2
    ridge: float = 1.0
    least: float = 2.0
    prior: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(x.shape[1])]
        # a value that fills most of a column still gets an edge above it
        self.edges = [np.unique(np.append(e, np.nextafter(e, np.inf))) if len(e) < 3 else e for e in self.edges]
        binned = self._binned(x)
        width = max(len(e) for e in self.edges) + 1
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.prior = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.prior)
        size = 2 ** (self.depth + 1) - 1
        columns = np.arange(x.shape[1]) * width
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            feature, at, value = np.full(size, -1), np.zeros(size, int), np.zeros(size)
            node = np.zeros(len(y), int)
            for n in range(size):
                rows = np.flatnonzero(node == n)
                if len(rows) == 0:
                    continue
                value[n] = -self.rate * g[rows].sum() / (h[rows].sum() + self.ridge)
                if n >= size // 2 or len(rows) < 2 * self.least:
                    continue
                cell = (binned[rows] + columns).ravel()
                repeat = x.shape[1]
                gs = np.bincount(cell, np.repeat(g[rows], repeat), width * repeat).reshape(repeat, width).cumsum(1)
                hs = np.bincount(cell, np.repeat(h[rows], repeat), width * repeat).reshape(repeat, width).cumsum(1)
                ns = np.bincount(cell, None, width * repeat).reshape(repeat, width).cumsum(1)
                g_all, h_all = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + self.ridge) + (g_all - gs) ** 2 / (h_all - hs + self.ridge) - g_all**2 / (h_all + self.ridge)
                gain[(ns < self.least) | (ns[:, -1:] - ns < self.least)] = 0
                best = int(gain.argmax())
                if gain.flat[best] <= 1e-6:
                    continue
                feature[n], at[n] = divmod(best, width)
                node[rows] = 2 * n + 1 + (binned[rows, feature[n]] > at[n])
            self.nodes.append((feature, at, value))
            score += self._tree(binned, self.nodes[-1])
        return self

    def _tree(self, binned: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        feature, at, value = tree
        node, rows = np.zeros(len(binned), int), np.arange(len(binned))
        for _ in range(self.depth):
            f = feature[node]
            node = np.where(f >= 0, 2 * node + 1 + (binned[rows, np.maximum(f, 0)] > at[node]), node)
        return value[node]

    def score(self, x: np.ndarray) -> np.ndarray:
        binned = self._binned(x)
        return self.prior + sum((self._tree(binned, tree) for tree in self.nodes), np.zeros(len(x)))
