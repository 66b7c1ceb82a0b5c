"""Gradient-boosted trees for several classes on a feature table that fits one task; NumPy, seeded by nothing."""

from __future__ import annotations

import numpy as np


def _bins(x: np.ndarray, most: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Cut points of each column, at most `most` - 1, and the place of every value among them."""
    cuts = [np.unique(np.quantile(column, np.arange(1, most) / most)) for column in x.T]
    return cuts, np.stack([np.searchsorted(c, column, side="right") for c, column in zip(cuts, x.T)], axis=1)


class Tree:
    """Split by split, the leaf with the largest gain first; a row goes right where its value reaches the cut."""

    def __init__(self, places: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, l2: float, least: int):
        self.nodes: list[list] = []  # column, cut, left, right or value
        self._grow(places, cuts, g, h, np.arange(len(g)), depth, l2, least)

    def _grow(self, places, cuts, g, h, rows, depth, l2, least) -> int:
        at = len(self.nodes)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        self.nodes.append([-1, 0.0, 0, 0, -total_g / (total_h + l2)])
        if not depth or len(rows) < 2 * least:
            return at
        best = (1e-9, -1, 0)
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            own = places[rows, j]
            size = np.bincount(own, minlength=len(c) + 1)[:-1].cumsum()
            left_g, left_h = (np.bincount(own, v[rows], len(c) + 1)[:-1].cumsum() for v in (g, h))
            gain = left_g**2 / (left_h + l2) + (total_g - left_g) ** 2 / (total_h - left_h + l2) - total_g**2 / (total_h + l2)
            gain[(size < least) | (len(rows) - size < least)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k)
        _, j, k = best
        if j < 0:
            return at
        right = places[rows, j] > k
        self.nodes[at][:2] = [j, float(cuts[j][k])]
        self.nodes[at][2] = self._grow(places, cuts, g, h, rows[~right], depth - 1, l2, least)
        self.nodes[at][3] = self._grow(places, cuts, g, h, rows[right], depth - 1, l2, least)
        return at

    def values(self, x: np.ndarray) -> np.ndarray:
        column, cut, left, right, value = (np.array(v) for v in zip(*self.nodes))
        at = np.zeros(len(x), np.int64)
        while (inner := column[at] >= 0).any():
            node = at[inner]
            at[inner] = np.where(x[inner, column[node]] >= cut[node], right[node], left[node])
        return value[at]


class BoostedClassifier:
    """Softmax boosting: each round adds a tree a class (one tree if there are two)."""

    def __init__(self, rounds: int = 200, rate: float = 0.06, depth: int = 4, l2: float = 1.0, least: int = 20, bins: int = 64):
        self.rounds, self.rate, self.depth, self.l2, self.least, self.bins = rounds, rate, depth, l2, least, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedClassifier:
        x = np.asarray(x, float)
        self.classes, at = np.unique(y, return_inverse=True)
        k = len(self.classes)
        share = np.bincount(at, minlength=k) / len(at)
        self.start, self.trees = np.log(np.maximum(share, 1e-12)), []
        if k < 2:
            return self
        cuts, places = _bins(x, self.bins)
        scores, truth = np.tile(self.start, (len(x), 1)), np.eye(k)[at]
        for _ in range(self.rounds):
            p = softmax(scores)
            stage = []
            for c in range(1 if k == 2 else k):
                c = 1 if k == 2 else c
                g, h = p[:, c] - truth[:, c], np.maximum(p[:, c] * (1 - p[:, c]), 1e-16)
                tree = Tree(places, cuts, g, h, self.depth, self.l2, self.least)
                scores[:, c] += self.rate * tree.values(x)
                stage.append((c, tree))
            self.trees.append(stage)
        return self

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        scores = np.tile(self.start, (len(x), 1))
        for stage in self.trees:
            for c, tree in stage:
                scores[:, c] += self.rate * tree.values(x)
        return softmax(scores)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.classes[self.probabilities(x).argmax(1)]


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def standardised(fit: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    """fit and others by the mean and population deviation of fit alone; a constant column keeps its scale."""
    mean, std = fit.mean(0), fit.std(0)
    return [(x - mean) / np.where(std > 0, std, 1.0) for x in (fit, *others)]
