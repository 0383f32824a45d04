"""Histogram gradient-boosted trees for a binary target, in numpy, flattened into arrays for vectorised traversal.

Training works on a bounded number of rows (the callers document the bound), which may stand for many. Each feature is cut into at most ``bins``
quantile bins; a level of a tree is grown from one histogram of gradients and Hessians over (node, feature, bin).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """All trees as flat arrays: node ``i`` sends a row to ``left[i]`` if ``x[feature[i]] <= threshold[i]``."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row; a leaf points to itself, so every row takes the same number of steps."""
        x = np.nan_to_num(np.asarray(x, dtype=np.float64), nan=0.0, posinf=1e300, neginf=-1e300)
        out = np.full(len(x), self.base)
        if not len(self.roots):
            return out
        for a in range(0, len(x), 4096):
            part = x[a : a + 4096]
            at = np.broadcast_to(self.roots, (len(part), len(self.roots))).copy()
            rows = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                at = np.where(part[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out[a : a + 4096] += self.value[at].sum(axis=1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, leaf: int = 10, weight: np.ndarray | None = None, cuts: list[np.ndarray] | None = None, count: np.ndarray | None = None) -> Trees:
    """Fit ``trees`` trees. With no rows, or one class only, the model is the (smoothed) prior.

    A row may stand for ``count`` equal ones (of which a leaf wants ``leaf``) and weigh ``weight``; ``cuts``, if given, are the bins' ends.
    """
    x, y = np.nan_to_num(np.asarray(x, dtype=np.float64)), np.asarray(y, dtype=np.float64)
    n, m = x.shape if x.ndim == 2 else (0, 0)
    w = np.ones(n) if weight is None else np.asarray(weight, dtype=np.float64)
    count = np.ones(n) if count is None else np.asarray(count, dtype=np.float64)
    prior = (float((w * y).sum()) + 0.5) / (float(w.sum()) + 1.0) if n else 0.5
    base = float(np.log(prior / (1 - prior)))
    none = np.zeros(0, dtype=np.int64)
    if n == 0 or y.min() == y.max():
        return Trees(none, np.zeros(0), none, none, np.zeros(0), none, 0, base)
    cuts = cuts or [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)], axis=1).astype(np.int64)
    offset = np.arange(m) * bins
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    score = np.full(n, base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = w * (p - y), w * np.maximum(p * (1 - p), 1e-6)
        start = len(feature)
        roots.append(start)

        def node(v: float) -> int:
            i = len(feature)
            feature.append(0)
            threshold.append(np.inf)
            left.append(i)
            right.append(i)
            value.append(v)
            return i

        node(-rate * g.sum() / (h.sum() + l2))
        at = np.full(n, start)
        open_nodes = [start]
        for _level in range(depth):
            if not open_nodes:
                break
            order = {v: k for k, v in enumerate(open_nodes)}
            where = np.full(len(feature), -1)
            where[open_nodes] = np.arange(len(open_nodes))
            k = where[at]
            rows = np.flatnonzero(k >= 0)
            flat = (k[rows, None] * (m * bins) + offset[None, :] + binned[rows]).ravel()
            size = len(open_nodes) * m * bins
            hg = np.bincount(flat, np.repeat(g[rows], m), size).reshape(-1, m, bins)
            hh = np.bincount(flat, np.repeat(h[rows], m), size).reshape(-1, m, bins)
            hn = np.bincount(flat, np.repeat(count[rows], m), size).reshape(-1, m, bins)
            gl, hl, nl = hg.cumsum(2), hh.cumsum(2), hn.cumsum(2)
            gt, ht, nt = gl[:, :1, -1:], hl[:, :1, -1:], nl[:, :1, -1:]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(nl < leaf) | (nt - nl < leaf)] = -1
            nxt = []
            for v in open_nodes:
                i = order[v]
                j, b = divmod(int(gain[i].argmax()), bins)
                if gain[i, j, b] <= 1e-9 or b >= len(cuts[j]):
                    continue
                a = node(-rate * gl[i, j, b] / (hl[i, j, b] + l2))
                c = node(-rate * (gt[i, 0, 0] - gl[i, j, b]) / (ht[i, 0, 0] - hl[i, j, b] + l2))
                feature[v], threshold[v], left[v], right[v], value[v] = j, float(cuts[j][b]), a, c, 0.0
                mine = rows[k[rows] == i]
                at[mine] = np.where(binned[mine, j] <= b, a, c)
                nxt += [a, c]
            open_nodes = nxt
        score += np.asarray(value)[at]
    return Trees(np.asarray(feature), np.asarray(threshold, dtype=np.float64), np.asarray(left), np.asarray(right), np.asarray(value), np.asarray(roots), depth, base)


def auc(y: np.ndarray, s: np.ndarray) -> float:
    """Area under the ROC curve, ties shared."""
    y = np.asarray(y)
    _, inverse, count = np.unique(s, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[inverse]
    a, b = float((y == 1).sum()), float((y == 0).sum())
    return (float(rank[y == 1].sum()) - a * (a + 1) / 2) / (a * b) if a and b else 0.5
