"""Gradient-boosted trees for two labels, in numpy, over quantile bins."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: A term: feature, whether it is above, bound. A leaf: the terms on its path, and its value.
Term = tuple[int, bool, float]
Leaf = tuple[tuple[Term, ...], float]


@dataclass(frozen=True)
class Boosted:
    prior: float
    trees: tuple[tuple[Leaf, ...], ...]

    def paths(self) -> list[tuple[Term, ...]]:
        """The distinct paths from a root to a node below it."""
        return list(dict.fromkeys(terms[:k] for tree in self.trees for terms, _ in tree for k in range(1, len(terms) + 1)))

    def margins(self, values: np.ndarray) -> np.ndarray:
        out = np.full(len(values), self.prior)
        for tree in self.trees:
            for terms, value in tree:
                out[held(values, terms)] += value
        return out


def held(values: np.ndarray, terms: tuple[Term, ...]) -> np.ndarray:
    """The rows in which all terms hold."""
    out = np.ones(len(values), bool)
    for f, above, bound in terms:
        out &= (values[:, f] > bound) if above else (values[:, f] <= bound)
    return out


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, bounds: list[np.ndarray], depth: int, least: int, rate: float) -> list[tuple[tuple[Term, ...], float, np.ndarray]]:
    leaves, todo = [], [((), np.arange(len(x)))]
    while todo:
        terms, rows = todo.pop()
        best = (1e-6, -1, -1)
        if len(terms) < depth and len(rows) >= 2 * least:
            all_g, all_h = g[rows].sum(), h[rows].sum()
            for f in range(x.shape[1]):
                size = len(bounds[f]) + 1
                n, gs, hs = (np.cumsum(np.bincount(x[rows, f], w, size))[:-1] for w in (None, g[rows], h[rows]))
                if not len(n):
                    continue
                gain = gs**2 / (hs + 1) + (all_g - gs) ** 2 / (all_h - hs + 1) - all_g**2 / (all_h + 1)
                gain[(n < least) | (len(rows) - n < least)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
        _, f, k = best
        if f < 0:
            leaves.append((terms, float(-rate * g[rows].sum() / (h[rows].sum() + 1)), rows))
            continue
        low = x[rows, f] <= k
        todo.append(((*terms, (f, True, float(bounds[f][k]))), rows[~low]))
        todo.append(((*terms, (f, False, float(bounds[f][k]))), rows[low]))
    return leaves


def fit(values: np.ndarray, labels: np.ndarray, trees: int, depth: int, bins: int = 32, least: int = 10, rate: float = 0.3) -> Boosted:
    """Boosted trees for 0/1 labels; without both labels, their smoothed share alone."""
    n = len(labels)
    share = (labels.sum() + 1) / (n + 2) if n else 0.5
    prior = float(np.log(share / (1 - share)))
    if n < 2 * least or labels.min() == labels.max():
        return Boosted(prior, ())
    bounds = [np.unique(np.quantile(values[:, f], np.linspace(0, 1, bins + 1)[:-1])) for f in range(values.shape[1])]
    x = np.stack([np.searchsorted(bounds[f], values[:, f], "left") for f in range(values.shape[1])], 1)
    margin, out = np.full(n, prior), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        leaves = _tree(x, p - labels, p * (1 - p), bounds, depth, least, rate)
        for _, value, rows in leaves:
            margin[rows] += value
        out.append(tuple((terms, value) for terms, value, _ in leaves))
    return Boosted(prior, tuple(out))
