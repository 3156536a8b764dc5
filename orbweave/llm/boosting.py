"""Gradient-boosted decision trees on binned features, in numpy, for small fits."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Complete trees of one depth: tests by level order, then leaf values."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    start: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0, bins: int = 16) -> Boosted:
    """Second-order boosting of the logistic loss."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    model = Boosted(start=float(np.log(share / (1 - share))))
    margin = np.full(n, model.start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        inner = 2**depth - 1
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for at in range(inner):
            here = np.flatnonzero(node == at)
            best = 1e-9
            for j in range(width):
                if not len(cuts[j]) or not len(here):
                    continue
                g = np.cumsum(np.bincount(binned[here, j], grad[here], len(cuts[j]) + 1))
                h = np.cumsum(np.bincount(binned[here, j], hess[here], len(cuts[j]) + 1))
                gain = g[:-1] ** 2 / (h[:-1] + ridge) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + ridge) - g[-1] ** 2 / (h[-1] + ridge)
                k = int(np.argmax(gain))
                if gain[k] > best:
                    best, feature[at], cut[at] = gain[k], j, cuts[j][k]
            node[here] = 2 * at + 1 + (x[here, feature[at]] > cut[at])
        leaf = np.zeros(inner + 1)
        g, h = np.bincount(node - inner, grad, inner + 1), np.bincount(node - inner, hess, inner + 1)
        leaf = -rate * g / (h + ridge)
        model.trees.append((feature, cut, leaf))
        margin += leaf[node - inner]
    return model
