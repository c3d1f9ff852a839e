"""Histogram gradient-boosted trees for binary labels, flattened into arrays.

Fitting works on a bounded sample (the callers document the bound): features
are cut into quantile bins once, every tree is grown level by level from
gradient and hessian histograms, and all trees end up in five flat arrays.
Scoring walks all rows through a tree at once, one array step per level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    feature: np.ndarray  # per node; -1: leaf
    cut: np.ndarray  # go left if x <= cut (missing values are -inf)
    left: np.ndarray  # place of the left child; the right one follows it
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        x = np.where(np.isnan(x), -np.inf, x)
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots.tolist():
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                inner = f >= 0
                right = x[rows, np.maximum(f, 0)] > self.cut[at]
                at = np.where(inner, self.left[at] + right, at)
            out += self.value[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: int = 5) -> Trees:
    """Logistic loss; without both labels the trees are empty and the score is the labels' (smoothed) share."""
    n, width = x.shape if x.ndim == 2 else (len(y), 0)
    share = (float(y.sum()) + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    feature, cut, left, value, roots = [], [], [], [], []
    if n and width and 0 < y.sum() < n:
        x = np.where(np.isnan(x), -np.inf, x)
        qs = np.linspace(0, 1, bins + 1)[1:-1]
        cuts = [np.unique(np.quantile(np.where(np.isinf(x[:, f]), np.nanmin(np.where(np.isinf(x[:, f]), 0, x[:, f])), x[:, f]), qs, method="lower")) for f in range(width)]
        binned = np.stack([np.searchsorted(cuts[f], x[:, f]) for f in range(width)], axis=1)  # bin b: cuts[b-1] < x <= cuts[b]
        margin = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            roots.append(len(feature))
            node = np.full(n, len(feature))
            for store, v in ((feature, -1), (cut, 0.0), (left, -1), (value, 0.0)):
                store.append(v)
            level = [len(feature) - 1]
            for d in range(depth + 1):
                place = np.full(len(feature), -1)
                place[level] = np.arange(len(level))
                own = np.flatnonzero(place[node] >= 0)
                k = place[node[own]]
                hist = np.zeros((3, width, len(level), bins))
                for f in range(width):
                    slot = k * bins + binned[own, f]
                    for c, w in enumerate((g[own], h[own], None)):
                        hist[c, f] = np.bincount(slot, weights=w, minlength=len(level) * bins).reshape(len(level), bins)
                total = hist[:, 0].sum(axis=-1)
                grow = []
                if d < depth:
                    acc = hist.cumsum(axis=-1)
                    rest = total[:, None, :, None] - acc
                    gain = acc[0] ** 2 / (acc[1] + l2) + rest[0] ** 2 / (rest[1] + l2) - (total[0] ** 2 / (total[1] + l2))[None, :, None]
                    gain[(acc[2] < least) | (rest[2] < least)] = -1
                    for f in range(width):
                        gain[f, :, len(cuts[f]) :] = -1
                for j, at in enumerate(level):
                    value[at] = -rate * total[0, j] / (total[1, j] + l2)
                    if d < depth:
                        f, b = np.unravel_index(int(gain[:, j].argmax()), gain[:, j].shape)
                        if gain[f, j, b] > 1e-6:
                            feature[at], cut[at], left[at] = int(f), float(cuts[f][b]), len(feature)
                            for _ in range(2):
                                grow.append(len(feature))
                                for store, v in ((feature, -1), (cut, 0.0), (left, -1), (value, 0.0)):
                                    store.append(v)
                            here = own[k == j]
                            node[here] = left[at] + (binned[here, f] > b)
                level = grow
                if not level:
                    break
            margin += np.array(value)[node]
    arr = lambda v, t: np.array(v, dtype=t)
    return Trees(arr(feature, np.int64), arr(cut, float), arr(left, np.int64), arr(value, float), arr(roots, np.int64), depth, base)
