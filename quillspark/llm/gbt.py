"""A small gradient-boosted tree classifier in NumPy: histogram splits, logistic loss. Fitted on the driver from a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Trees of fixed depth, stored level by level as feature, threshold and leaf arrays."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    l2: float = 1.0
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        """y: 0 or 1. With one class or no rows the model is a constant."""
        self.trees = []
        p = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(p / (1 - p)))
        if len(y) == 0 or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            now = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, edges, y - now, now * (1 - now))
            self.trees.append(tree)
            score += self._leaves(tree, x)
        return self

    def _grow(self, binned, edges, gradient, hessian):
        nodes = 2**self.depth - 1
        feature, threshold = np.zeros(nodes, np.int64), np.full(nodes, np.inf)
        node = np.zeros(len(binned), np.int64)  # place in the level
        for level in range(self.depth):
            width, first = 2**level, 2**level - 1
            best = np.zeros(width)
            choice = [(0, np.inf, -1)] * width
            for f, e in enumerate(edges):
                k = len(e) + 1
                if k < 2:
                    continue
                slot = node * k + binned[:, f]
                g = np.bincount(slot, gradient, width * k).reshape(width, k).cumsum(axis=1)
                h = np.bincount(slot, hessian, width * k).reshape(width, k).cumsum(axis=1)
                gl, hl, ga, ha = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                gain = gl**2 / (hl + self.l2) + (ga - gl) ** 2 / (ha - hl + self.l2) - ga**2 / (ha + self.l2)
                at = gain.argmax(axis=1)
                for n in range(width):
                    if gain[n, at[n]] > best[n] + 1e-9:
                        best[n], choice[n] = gain[n, at[n]], (f, float(e[at[n]]), int(at[n]))
            right = np.zeros(len(binned), np.int64)
            for n, (f, t, b) in enumerate(choice):
                feature[first + n], threshold[first + n] = f, t
                if b >= 0:
                    mine = node == n
                    right[mine] = binned[mine, f] > b
            node = 2 * node + right
        g, h = np.bincount(node, gradient, 2**self.depth), np.bincount(node, hessian, 2**self.depth)
        return feature, threshold, self.rate * g / (h + self.l2)

    def _leaves(self, tree, x: np.ndarray) -> np.ndarray:
        feature, threshold, leaf = tree
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for level in range(self.depth):
            at = 2**level - 1 + node
            node = 2 * node + (x[rows, feature[at]] > threshold[at])
        return leaf[node]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        score = np.full(len(x), self.base)
        for tree in self.trees:
            score += self._leaves(tree, x)
        return 1 / (1 + np.exp(-score))
