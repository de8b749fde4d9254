"""Gradient-boosted trees for a bounded table of examples: fitted on the driver, applied in tasks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass(frozen=True)
class Tree:
    """A complete binary tree in arrays: node i has children 2i + 1 and 2i + 2."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while (inner := node < len(self.feature)).any():
            at = node[inner]
            right = x[rows[inner], self.feature[at]] > self.cut[at]
            node[inner] = 2 * at + 1 + right
        return self.value[node - len(self.feature)]


@dataclass(frozen=True)
class Boosted:
    """Log odds as a sum of trees, and the logistic curve that calibrates them."""

    base: float
    trees: tuple[Tree, ...]
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.shift, -40, 40)))


def _grow(binned: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, depth: int, rate: float, ridge: float) -> Tree:
    inner = (1 << depth) - 1
    feature, cut, value = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
    node = np.zeros(len(binned), np.int64)
    for at in range(inner):
        rows = np.flatnonzero(node == at)
        best = (1e-6, 0, np.inf, 0)
        total_g, total_h = gradient[rows].sum(), hessian[rows].sum()
        for f, edges in enumerate(cuts):
            if not len(edges) or not len(rows):
                continue
            g = np.cumsum(np.bincount(binned[rows, f], gradient[rows], len(edges) + 1))[:-1]
            h = np.cumsum(np.bincount(binned[rows, f], hessian[rows], len(edges) + 1))[:-1]
            gain = g**2 / (h + ridge) + (total_g - g) ** 2 / (total_h - h + ridge) - total_g**2 / (total_h + ridge)
            gain[(h < 1) | (total_h - h < 1)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], f, edges[k], k)
        _, feature[at], cut[at], k = best
        right = (binned[rows, feature[at]] > k) if np.isfinite(cut[at]) else np.zeros(len(rows), bool)
        node[rows] = 2 * at + 1 + right
    g = np.bincount(node - inner, gradient, inner + 1)
    h = np.bincount(node - inner, hessian, inner + 1)
    value = rate * g / (h + ridge)
    return Tree(feature, cut, value)


def fit(x: np.ndarray, y: np.ndarray, *, rounds: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0) -> Boosted:
    """Boost trees on logistic loss; cuts are quantiles of each feature."""
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    cuts = [c[c < column.max()] if len(column) else c for c, column in zip(cuts, x.T, strict=True)]
    binned = np.column_stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T, strict=True)])
    chance = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(chance / (1 - chance)))
    value, trees = np.full(len(y), base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-value))
        tree = _grow(binned, cuts, y - p, p * (1 - p), depth, rate, ridge)
        value = value + tree.predict(x)
        trees.append(tree)
    return Boosted(base, tuple(trees))


def calibrate(model: Boosted, x: np.ndarray, y: np.ndarray) -> Boosted:
    """The model with the logistic curve that fits examples it was not grown on."""
    raw = model.raw(x)
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -40, 40)))
        h = p * (1 - p)
        m = np.array([[(h * raw * raw).sum() + 1e-3, (h * raw).sum()], [(h * raw).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(m, [((p - target) * raw).sum(), (p - target).sum()])
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return Boosted(model.base, model.trees, float(max(a, 1e-3)), float(b))


def threshold(chance: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest chance from which the share of true examples is at least `precision`; 1.1 if there is none."""
    order = np.argsort(-chance, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    # chances that are equal are taken together
    last = np.append(np.diff(chance[order]) != 0, True)
    good = np.flatnonzero((right >= precision) & last)
    return float(chance[order][good[-1]]) if len(good) else 1.1
