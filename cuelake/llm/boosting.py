"""Gradient-boosted trees in numpy: softmax over classes, binned features, complete trees of a fixed depth."""

from __future__ import annotations

import numpy as np


class Trees:
    def __init__(self, classes: int, rounds: int = 20, depth: int = 4, rate: float = 0.3, bins: int = 24, penalty: float = 1.0):
        self.classes, self.rounds, self.depth, self.rate, self.bins, self.penalty = classes, rounds, depth, rate, bins, penalty
        self.trees: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []  # class, feature and bound of inner nodes, leaves

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, f = x.shape
        self.base = np.log(np.bincount(y, minlength=self.classes) + 1.0)
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
        width = self.bins + 1
        offsets = np.arange(f) * width
        score = np.tile(self.base, (n, 1))
        onehot = np.eye(self.classes)[y]
        for _ in range(self.rounds):
            e = np.exp(score - score.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            for c in range(self.classes):
                g, h = p[:, c] - onehot[:, c], np.maximum(p[:, c] * (1 - p[:, c]), 1e-6)
                feature, bound = np.zeros(2**self.depth - 1, int), np.full(2**self.depth - 1, np.inf)
                at = np.zeros(n, int)  # node within its level
                for level in range(self.depth):
                    k = 2**level
                    place = (at[:, None] * (f * width) + offsets[None, :] + binned).ravel()
                    sums = [np.bincount(place, np.repeat(v, f), minlength=k * f * width).reshape(k, f, width).cumsum(axis=2) for v in (g, h)]
                    gl, hl = sums
                    gt, ht = gl[:, :, -1:], hl[:, :, -1:]
                    gain = gl**2 / (hl + self.penalty) + (gt - gl) ** 2 / (ht - hl + self.penalty) - gt**2 / (ht + self.penalty)
                    gain[(hl < 1e-3) | (ht - hl < 1e-3)] = 0
                    flat = gain.reshape(k, -1)
                    best = flat.argmax(axis=1)
                    split_bin = np.full(k, width)
                    split_f = best // width
                    for node in range(k):
                        j, b = int(best[node] // width), int(best[node] % width)
                        if flat[node, best[node]] > 1e-9 and b < len(cuts[j]):
                            feature[k - 1 + node], bound[k - 1 + node], split_bin[node] = j, cuts[j][b], b
                    at = 2 * at + (binned[np.arange(n), split_f[at]] > split_bin[at])
                leaves = -self.rate * np.bincount(at, g, minlength=2**self.depth) / (np.bincount(at, h, minlength=2**self.depth) + self.penalty)
                self.trees.append((c, feature, bound, leaves))
                score[:, c] += leaves[at]
        return self

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        score = np.tile(self.base, (len(x), 1))
        columns = np.ascontiguousarray(x.T)
        rows = np.arange(len(x))
        for c, feature, bound, leaves in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                at = 2 * at + 1 + (columns[feature[at], rows] > bound[at])
            score[:, c] += leaves[at - (2**self.depth - 1)]
        e = np.exp(score - score.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)
