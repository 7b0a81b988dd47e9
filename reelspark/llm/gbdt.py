"""Histogram gradient-boosted trees for a binary label, on a bounded sample, in numpy.

Trees are complete binary trees flattened into arrays (feature, threshold, leaf value
by position), so a batch walks all trees at once by array look-ups.

Defined results: features are finite numbers (callers give texts that are null the features of
empty ones); without rows every prediction is 0.5; a feature of one value is never split on; of equally good
splits the first feature and the lowest cut win, and rows that repeat count as often as they stand.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of label 1 for each row of ``x``."""
        trees, inner = self.feature.shape
        at = np.zeros((len(x), trees), np.int64)
        tree = np.arange(trees)[None, :]
        row = np.arange(len(x))[:, None]
        while inner:
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.threshold[tree, at])
            inner >>= 1
        return self.base + self.leaf[tree, at - self.feature.shape[1]].sum(axis=1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = [1 / (1 + np.exp(-self.margin(x[a : a + 4096]))) for a in range(0, len(x), 4096)]
        return np.concatenate(out) if out else np.zeros(0)


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Cut points of each feature: midpoints between values at even ranks."""
    out = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > bins:
            values = np.unique(np.sort(column)[np.linspace(0, len(column) - 1, bins).astype(int)])
        out.append((values[1:] + values[:-1]) / 2)
    return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 1.0, l2: float = 1.0) -> Trees:
    """Fit to labels 0 and 1; ``least`` is the smallest sum of second derivatives in a child."""
    n, f = x.shape
    inner = (1 << depth) - 1
    share = (y.sum() + 0.5) / (n + 1)
    model = Trees(float(np.log(share / (1 - share))), np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    if not n:
        return model
    edges = bin_edges(x, bins)
    codes = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)])  # code <= k iff value <= edge k
    margin = np.full(n, model.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, nodes = (1 << level) - 1, 1 << level
            where = (at - first) * bins
            best = np.full(nodes, 1e-6)
            total_g, total_h = np.bincount(at - first, g, nodes), np.bincount(at - first, h, nodes)
            parent = total_g**2 / (total_h + l2)
            for k in range(f):
                if not len(edges[k]):
                    continue
                key = where + codes[k]
                left_g = np.bincount(key, g, nodes * bins).reshape(nodes, bins).cumsum(axis=1)[:, : len(edges[k])]
                left_h = np.bincount(key, h, nodes * bins).reshape(nodes, bins).cumsum(axis=1)[:, : len(edges[k])]
                right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                gain = left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2) - parent[:, None]
                gain[(left_h < least) | (right_h < least)] = 0
                cut = gain.argmax(axis=1)
                top = gain[np.arange(nodes), cut]
                for node in np.flatnonzero(top > best):
                    best[node] = top[node]
                    model.feature[t, first + node] = k
                    model.threshold[t, first + node] = edges[k][cut[node]]
            at = 2 * at + 1 + (x[np.arange(n), model.feature[t, at]] > model.threshold[t, at])
        leaf = at - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + l2)
        model.leaf[t] = value
        margin += value[leaf]
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (scores, calibrated values), both non-decreasing."""
    order = np.argsort(score, kind="stable")
    xs, start = np.unique(score[order], return_index=True)
    size = np.diff([*start, len(order)]).astype(float)
    total = np.add.reduceat(y[order].astype(float), start) if len(xs) else np.zeros(0)
    blocks: list[list[float]] = []
    for k in range(len(xs)):
        blocks.append([total[k], size[k], 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, m = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][2] += m
    values = np.concatenate([np.full(int(m), (s + 0.01) / (n + 0.02)) for s, n, m in blocks]) if blocks else np.zeros(0)
    return xs, np.maximum.accumulate(values) if len(values) else values
