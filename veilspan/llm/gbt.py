"""Histogram gradient-boosted trees for binary labels, in numpy.

Features are binned by quantiles once; trees grow level by level from gradient and hessian
histograms (one ``bincount`` per feature and level).  A fitted model is four flat arrays, and rows
are scored by moving all of them down all trees at once, a level at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """All trees flattened: node ``k``'s children are ``left[k]`` and ``left[k] + 1``; a leaf is its
    own left child.  Small enough to travel in a task's closure."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row; ``x`` is rows by features."""
        out = np.full(len(x), self.start)
        for at in range(0, len(x), 4096):
            rows = x[at : at + 4096]
            node = np.broadcast_to(self.roots, (len(rows), len(self.roots))).copy()
            index = np.arange(len(rows))[:, None]
            for _ in range(self.depth):
                leaf = self.left[node] == node
                node = np.where(leaf, node, self.left[node] + (rows[index, self.feature[node]] > self.threshold[node]))
            out[at : at + 4096] += self.value[node].sum(axis=1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least_rows: int = 10, l2: float = 1.0) -> Trees:
    """Log-loss boosting.  With no rows, or one class only, the model is a constant."""
    n, width = x.shape
    mean = (y.sum() + 0.5) / (n + 1.0)
    start = float(np.log(mean / (1 - mean)))
    feature, threshold, left, value, roots = [], [], [], [], []
    if n >= 2 * least_rows and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)]
        binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], axis=1)
        raw = np.full(n, start)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, p * (1 - p)
            roots.append(len(feature))
            feature.append(0), threshold.append(0.0), left.append(roots[-1]), value.append(0.0)
            node = np.full(n, roots[-1])
            level = [roots[-1]]
            for d in range(depth + 1):
                place = {k: i for i, k in enumerate(level)}
                here = np.isin(node, level)
                rows = np.flatnonzero(here)
                slot = np.array([place[k] for k in node[rows].tolist()], np.int64)
                sums = [np.bincount(slot, w, len(level)) for w in (g[rows], h[rows], np.ones(len(rows)))]
                for i, k in enumerate(level):
                    value[k] = -rate * sums[0][i] / (sums[1][i] + l2)
                if d == depth:
                    break
                best = [(1e-6, -1, -1)] * len(level)
                for f in range(width):
                    m = len(edges[f]) + 1
                    if m < 2:
                        continue
                    key = slot * m + binned[rows, f]
                    gs, hs, cs = (np.cumsum(np.bincount(key, w, m * len(level)).reshape(len(level), m), axis=1)[:, :-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                    gt, ht, ct = (s[:, None] for s in sums)
                    gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                    gain[(cs < least_rows) | (ct - cs < least_rows)] = 0
                    top = gain.argmax(axis=1)
                    for i in range(len(level)):
                        if gain[i, top[i]] > best[i][0]:
                            best[i] = (float(gain[i, top[i]]), f, int(top[i]))
                nxt = []
                for i, k in enumerate(level):
                    _, f, b = best[i]
                    if f < 0:
                        continue
                    feature[k], threshold[k], left[k] = f, float(edges[f][b]), len(feature)
                    for _ in range(2):
                        feature.append(0), threshold.append(0.0), left.append(len(feature) - 1), value.append(0.0)
                    own = node == k
                    node[own] = left[k] + (binned[own, f] > b)
                    nxt += [left[k], left[k] + 1]
                level = nxt
                if not level:
                    break
            raw = raw + np.array(value)[node]
    return Trees(np.array(feature, np.int64), np.array(threshold), np.array(left, np.int64), np.array(value), np.array(roots, np.int64), depth, start)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit of ``y`` on ``score``: knots (score, probability), both ascending."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # weight, sum, sum of scores
    for s, t in zip(score[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([1.0, t, s])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][0] >= blocks[-1][1] / blocks[-1][0]:
            w, t_, s_ = blocks.pop()
            blocks[-1][0] += w
            blocks[-1][1] += t_
            blocks[-1][2] += s_
    # the ends are drawn in by half a row, so no score is held certain, but not beyond their neighbours
    p = np.array([(b[1] + 0.5 * (b[1] == 0) - 0.5 * (b[1] == b[0])) / b[0] for b in blocks])
    if len(p) > 1:
        p[0], p[-1] = min(p[0], p[1]), max(p[-1], p[-2])
    return np.array([b[2] / b[0] for b in blocks]), p
