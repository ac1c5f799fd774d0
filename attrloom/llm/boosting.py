"""Gradient-boosted trees for a few small-integer features, fitted on a bounded sample in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Trees:
    """Complete binary trees: feature and threshold per inner node, value per leaf; ``scale`` is the calibration."""

    features: np.ndarray
    thresholds: np.ndarray
    values: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)

    def score(self, x: np.ndarray) -> np.ndarray:
        total, depth = np.zeros(len(x)), (self.features.shape[1] + 1).bit_length() - 1
        rows = np.arange(len(x))
        for f, t, v in zip(self.features, self.thresholds, self.values, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += v[node - len(f)]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale[0] * self.score(x) + self.scale[1])


def _best_split(x, g, h, ridge):
    best = (1e-9, 0, BINS)
    total_g, total_h = g.sum(), h.sum()
    for feature in range(x.shape[1]):
        left_g = np.cumsum(np.bincount(x[:, feature], g, BINS))
        left_h = np.cumsum(np.bincount(x[:, feature], h, BINS))
        gain = left_g ** 2 / (left_h + ridge) + (total_g - left_g) ** 2 / (total_h - left_h + ridge) - total_g ** 2 / (total_h + ridge)
        at = int(np.argmax(gain))
        if gain[at] > best[0]:
            best = (float(gain[at]), feature, at)
    return best[1], best[2]


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, ridge: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss. Deterministic. ``x`` holds integers in [0, 64)."""
    inner, features, thresholds, values = (1 << depth) - 1, [], [], []
    score = np.zeros(len(y))
    for _ in range(rounds):
        p = sigmoid(score)
        g, h = y - p, p * (1 - p)
        f, t, v = np.zeros(inner, dtype=np.int64), np.full(inner, BINS), np.zeros(inner + 1)
        node = np.zeros(len(y), dtype=np.int64)
        for k in range(inner):
            inside = node == k
            if inside.sum() > 1:
                f[k], t[k] = _best_split(x[inside], g[inside], h[inside], ridge)
            node[inside] = 2 * k + 1 + (x[inside, f[k]] > t[k])
        leaf = node - inner
        v = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        score += v[leaf]
        features.append(f), thresholds.append(t), values.append(v)
    return Trees(np.array(features), np.array(thresholds), np.array(values))


def calibrate(trees: Trees, x: np.ndarray, y: np.ndarray, steps: int = 200) -> Trees:
    """Platt scaling on held-out rows."""
    score, a, b = trees.score(x), 1.0, 0.0
    for _ in range(steps if len(y) else 0):
        p = sigmoid(a * score + b)
        w, d = p * (1 - p) + 1e-6, y - p
        hessian = np.array([[(w * score * score).sum() + 1e-3, (w * score).sum()], [(w * score).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hessian, np.array([(d * score).sum(), d.sum()]))
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -1, 1))
    return Trees(trees.features, trees.thresholds, trees.values, (a, b))


def cut_for_precision(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest probability from which on the held-out precision holds; above 1 where none does."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero((right >= precision) & np.append(p[order][1:] < p[order][:-1], True)[:len(y)])
    return float(p[order][good[-1]]) if len(good) and y.sum() else 2.0
