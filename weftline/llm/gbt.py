"""Histogram gradient-boosted trees in numpy: binned training on the driver, flattened node arrays for vectorised scoring.

Binary labels, logistic loss, second-order gains. A feature may be given a sign: with +1 the score never falls as the feature
grows, with -1 it never rises. Rows with a missing value (NaN) go left.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """All trees in one set of arrays; node i is a leaf where feature[i] < 0. A row goes left where its value <= threshold (or NaN)."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row of x."""
        out = np.full(len(x), self.base)
        if not len(x):
            return out
        node = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[node]
            inner = f >= 0
            if not inner.any():
                break
            v = x[rows, np.maximum(f, 0)]
            step = np.where(v > self.threshold[node], self.right[node], self.left[node])
            node = np.where(inner, step, node)
        return out + self.value[node].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1, from 0 to 1."""
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, signs: list[int] | None = None, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: int = 10, l2: float = 1.0) -> Trees:
    """Train. signs: for each feature -1, 0 or +1. With no rows, or labels of one kind only, the score is a constant."""
    width = x.shape[1]
    signs = signs or [0] * width
    share = (float(y.sum()) + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []
    cuts = [np.unique(np.quantile(c := x[~np.isnan(x[:, f]), f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if len(x) and not np.isnan(x[:, f]).all() else np.zeros(0) for f in range(width)]
    codes = np.stack([np.searchsorted(cuts[f], np.nan_to_num(x[:, f], nan=-np.inf), "left") for f in range(width)], 1) if len(x) else np.zeros((0, width), int)
    margin = np.full(len(y), base)
    if len(y) and 0 < y.sum() < len(y):
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = p - y, p * (1 - p)
            roots.append(len(nodes))
            nodes.append([-1, 0, 0, 0, 0])
            todo = [(roots[-1], np.arange(len(y)), 0, -np.inf, np.inf)]
            while todo:
                at, rows, level, low, high = todo.pop()
                g, h = grad[rows].sum(), hess[rows].sum()
                value = float(np.clip(-g / (h + l2), low, high))
                nodes[at][4] = value * rate
                split = _best(codes[rows], grad[rows], hess[rows], cuts, signs, l2, least, low, high) if level < depth and len(rows) >= 2 * least else None
                if split is None:
                    margin[rows] += value * rate
                    continue
                f, cut, vl, vr = split
                goes_left = codes[rows, f] <= cut
                left, right = len(nodes), len(nodes) + 1
                nodes[at][:4] = [f, cuts[f][cut], left, right]
                nodes += [[-1, 0, 0, 0, 0], [-1, 0, 0, 0, 0]]
                mid = (vl + vr) / 2
                bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[signs[f]]
                todo += [(left, rows[goes_left], level + 1, *bounds[0]), (right, rows[~goes_left], level + 1, *bounds[1])]
    a = np.array(nodes or [[-1, 0, 0, 0, 0]])
    return Trees(a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4], np.array(roots, np.int64), depth, base)


def _best(codes, grad, hess, cuts, signs, l2, least, low, high):
    """(feature, cut, left value, right value) of the best split that the signs allow, or None."""
    g, h, n = grad.sum(), hess.sum(), len(grad)
    best, found = 1e-6 + g * g / (h + l2), None
    for f, edges in enumerate(cuts):
        if not len(edges):
            continue
        gl = np.cumsum(np.bincount(codes[:, f], grad, len(edges) + 1))[:-1]
        hl = np.cumsum(np.bincount(codes[:, f], hess, len(edges) + 1))[:-1]
        nl = np.cumsum(np.bincount(codes[:, f], minlength=len(edges) + 1))[:-1]
        gr, hr = g - gl, h - hl
        vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
        # the gain at clipped leaf values: -(2 g v + (h + l2) v^2)
        gain = -(2 * gl * vl + (hl + l2) * vl**2) - (2 * gr * vr + (hr + l2) * vr**2)
        gain[(nl < least) | (n - nl < least) | (signs[f] * (vr - vl) < 0)] = -np.inf
        k = int(np.argmax(gain))
        if gain[k] > best:
            best, found = gain[k], (f, k, float(vl[k]), float(vr[k]))
    return found
