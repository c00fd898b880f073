"""Gradient-boosted regression trees for binary labels, on numpy arrays; small, deterministic, fit on the driver."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Histogram gradient boosting with logistic loss and a threshold calibrated on held-out rows."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 24, least: float = 4.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray, held_out: float = 0.25, seed: int = 3) -> Boosted:
        order = np.random.default_rng(seed).permutation(len(x))
        n_out = int(len(x) * held_out)
        out, into = order[:n_out], order[n_out:]
        self._grow(x[into], y[into])
        self._calibrate(self.margin(x[out]), y[out])
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray) -> None:
        n, m = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)))[:-1] if len(np.unique(x[:, j])) > self.bins else (lambda u: (u[1:] + u[:-1]) / 2)(np.unique(x[:, j])) for j in range(m)]
        code = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)], 1)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(n, self.base)
        size = 2 ** (self.depth + 1) - 1
        self.feature = np.full((self.trees, size), -1, np.int32)
        self.cut = np.zeros((self.trees, size))
        self.value = np.zeros((self.trees, size))
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, np.int32)
            for d in range(self.depth + 1):
                for k in range(2**d - 1, 2 ** (d + 1) - 1):
                    own = np.flatnonzero(node == k)
                    if not len(own):
                        continue
                    gs, hs = g[own].sum(), h[own].sum()
                    self.value[t, k] = self.rate * gs / (hs + 1.0)
                    if d == self.depth or len(own) < 2 * self.least:
                        continue
                    best = (1e-6, -1, 0)
                    for j in range(m):
                        if not len(cuts[j]):
                            continue
                        w = len(cuts[j]) + 1
                        gl = np.cumsum(np.bincount(code[own, j], g[own], w))[:-1]
                        hl = np.cumsum(np.bincount(code[own, j], h[own], w))[:-1]
                        nl = np.cumsum(np.bincount(code[own, j], minlength=w))[:-1]
                        gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                        gain[(nl < self.least) | (len(own) - nl < self.least)] = -1
                        c = int(np.argmax(gain))
                        if gain[c] > best[0]:
                            best = (float(gain[c]), j, c)
                    if best[1] >= 0:
                        self.feature[t, k], self.cut[t, k] = best[1], cuts[best[1]][best[2]]
                        right = code[own, best[1]] > best[2]
                        node[own] = np.where(right, 2 * k + 2, 2 * k + 1)
            score += self.value[t, node]

    def margin(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(self.trees):
            node = np.zeros(len(x), np.int32)
            for _ in range(self.depth):
                f = self.feature[t, node]
                inner = f >= 0
                right = x[rows, np.maximum(f, 0)] > self.cut[t, node]
                node = np.where(inner, 2 * node + 1 + right, node)
            score += self.value[t, node]
        return score

    def _calibrate(self, score: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling, and the probability above which rows are selected: the best F1 on the held-out rows."""
        a, b = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-(a * score + b)))
            a += 0.1 * np.mean((y - p) * score)
            b += 0.1 * np.mean(y - p)
        self.a, self.b = a, b
        p = self.probability_of(score)
        grid = np.linspace(0.1, 0.9, 33)
        f1 = [2 * (y[p >= g].sum()) / max((p >= g).sum() + y.sum(), 1) for g in grid]
        top = [g for g, f in zip(grid, f1) if f >= max(f1) - 0.002]
        self.threshold = float(top[len(top) // 2])

    def probability_of(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.a * score + self.b)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.probability_of(self.margin(x)) if len(x) else np.zeros(0)
