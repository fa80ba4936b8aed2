"""Gradient-boosted trees in numpy: binned training with monotonic constraints, flattened node arrays for scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Trees laid end to end; a leaf has feature -1. Scores are log odds."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """All rows walk all trees at once, one level a step."""
        rows = np.arange(len(x))[:, None]
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        for _ in range(self.depth):
            f = self.feature[at]
            below = x[rows, np.maximum(f, 0)] <= self.threshold[at]
            at = np.where(f < 0, at, np.where(below, self.left[at], self.right[at]))
        return self.base + self.value[at].sum(1)

    def probability(self, x: np.ndarray, block: int = 8192) -> np.ndarray:
        out = [1 / (1 + np.exp(-self.raw(x[i : i + block]))) for i in range(0, len(x), block)]
        return np.concatenate(out) if out else np.empty(0)


def train(x: np.ndarray, y: np.ndarray, monotone: tuple[int, ...], trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: int = 10) -> Forest:
    """Logistic loss, second order. monotone: for each feature +1 (the score must not fall as it grows), -1 or 0.
    Children get bounds at the midpoint of a constrained split, so that constraints hold along whole paths."""
    n, k = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.empty(0) for j in range(k)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1) if n else np.empty((0, k), int)
    mean = min(max(y.mean() if n else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    score = np.full(n, base)
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots = []
    width = max((len(c) for c in cuts), default=0) + 1

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(min(max(-g / (h + l2), low), high))

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        g, h = grad[rows], hess[rows]
        sg, sh = g.sum(), h.sum()
        me = len(nodes)
        nodes.append([-1, 0.0, me, me, rate * leaf(sg, sh, low, high)])
        if level == depth or len(rows) < 2 * least:
            return me
        best = (1e-6, -1, 0, 0.0)
        for j in range(k):
            if not len(cuts[j]):
                continue
            b = binned[rows, j]
            gl, hl, nl = (np.cumsum(np.bincount(b, w, width))[: len(cuts[j])] for w in (g, h, np.ones(len(b))))
            vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-(sg - gl) / (sh - hl + l2), low, high)
            gain = -(gl * vl + (hl + l2) * vl**2 / 2) - ((sg - gl) * vr + (sh - hl + l2) * vr**2 / 2)
            v = leaf(sg, sh, low, high)
            gain += sg * v + (sh + l2) * v**2 / 2
            gain[(nl < least) | (len(rows) - nl < least) | (monotone[j] * (vr - vl) < 0)] = -1
            if gain[i := int(gain.argmax())] > best[0]:
                best = (float(gain[i]), j, i, float((vl[i] + vr[i]) / 2))
        _, j, i, middle = best
        if j < 0:
            return me
        goes = binned[rows, j] <= i
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[monotone[j]]
        nodes[me][:2] = [j, float(cuts[j][i])]
        nodes[me][2] = grow(rows[goes], level + 1, *bounds[0])
        nodes[me][3] = grow(rows[~goes], level + 1, *bounds[1])
        return me

    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-score))
        grad, hess = p - y, p * (1 - p)
        root = grow(np.arange(n), 0, -np.inf, np.inf)
        roots.append(root)
        one = _forest(nodes, [root], depth, 0.0)
        score += one.raw(x)
    return _forest(nodes, roots, depth, base)


def _forest(nodes: list[list], roots: list[int], depth: int, base: float) -> Forest:
    f, t, a, b, v = (np.array(c) for c in zip(*nodes)) if nodes else (np.empty(0),) * 5
    return Forest(f.astype(np.int32), t.astype(float), a.astype(np.int32), b.astype(np.int32), v.astype(float), np.array(roots, np.int32), depth, base)
