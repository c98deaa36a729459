"""Gradient-boosted trees on binned dense features with isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    feature: list[int] = field(default_factory=list)  # -1: a leaf
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, feature: int = -1, cut: float = 0.0, value: float = 0.0) -> int:
        for column, x in ((self.feature, feature), (self.cut, cut), (self.left, 0), (self.right, 0), (self.value, value)):
            column.append(x)
        return len(self.feature) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.feature[node] < 0:
                out[rows] = self.value[node]
            elif len(rows):
                low = x[rows, self.feature[node]] <= self.cut[node]
                todo += [(self.left[node], rows[low]), (self.right[node], rows[~low])]
        return out


@dataclass
class Boosted:
    """Log odds of label 1: base plus the sum of the trees; steps maps it to a calibrated probability."""

    base: float
    trees: list[Tree]
    steps: tuple[np.ndarray, np.ndarray] | None = None

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def score(self, x: np.ndarray) -> np.ndarray:
        m = self.margin(x)
        if self.steps is None:
            return 1 / (1 + np.exp(-m))
        return np.interp(m, *self.steps)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, penalty: float = 1.0) -> Boosted:
    """Second-order boosting of logistic loss; splits are searched in histograms of quantile bins."""
    p0 = float(np.clip((weight * y).sum() / weight.sum(), 1e-4, 1 - 1e-4))
    model = Boosted(float(np.log(p0 / (1 - p0))), [])
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    margin = np.full(len(x), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = weight * (p - y), weight * p * (1 - p) + 1e-9
        tree = Tree()

        def grow(rows: np.ndarray, level: int) -> int:
            g, h = grad[rows].sum(), hess[rows].sum()
            best = (1e-6, -1, 0)
            if level < depth and len(rows) >= 8:
                for f, e in enumerate(edges):
                    n = len(e) + 1
                    gl = np.cumsum(np.bincount(code[rows, f], grad[rows], n))[:-1]
                    hl = np.cumsum(np.bincount(code[rows, f], hess[rows], n))[:-1]
                    if len(gl):
                        gain = gl**2 / (hl + penalty) + (g - gl) ** 2 / (h - hl + penalty) - g**2 / (h + penalty)
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (float(gain[k]), f, k)
            if best[1] < 0:
                return tree.add(value=-rate * g / (h + penalty))
            _, f, k = best
            node = tree.add(f, float(edges[f][k]))
            low = code[rows, f] <= k
            tree.left[node] = grow(rows[low], level + 1)
            tree.right[node] = grow(rows[~low], level + 1)
            return node

        grow(np.arange(len(x)), 0)
        model.trees.append(tree)
        margin += tree.predict(x)
    return model


def isotonic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of a non-decreasing map from margin to probability: pooled adjacent violators."""
    each, place = np.unique(margin, return_inverse=True)  # rows of one margin are one point
    right, total = np.bincount(place, y * weight, len(each)), np.bincount(place, weight, len(each))
    pools: list[list[float]] = []  # sum of weighted labels, weight, least and greatest margin
    for m, t, w in zip(each.tolist(), right.tolist(), total.tolist(), strict=True):
        pools.append([t, w, m, m])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            a = pools.pop()
            pools[-1] = [pools[-1][0] + a[0], pools[-1][1] + a[1], pools[-1][2], a[3]]
    at = np.array([v for s, w, lo, hi in pools for v in (lo, hi)])
    to = np.array([v for s, w, lo, hi in pools for v in [(s + 0.02) / (w + 0.5)] * 2])  # shrunk a little towards few
    return at, np.clip(np.maximum.accumulate(to), 0, 1)
