"""Small boosted models on binned features, fitted in numpy on a bounded number of rows."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def cuts_of(column: np.ndarray, bins: int) -> np.ndarray:
    """At most bins - 1 cut points: quantiles of the distinct values, so that rare large values get bins of their own."""
    values = np.unique(column)
    if len(values) <= 1:
        return np.zeros(0)
    middles = (values[1:] + values[:-1]) / 2
    if len(middles) < bins:
        return middles
    by_row = np.quantile(column, np.linspace(0, 1, bins // 2 + 1)[1:-1])
    by_value = middles[np.linspace(0, len(middles) - 1, bins // 2).astype(int)]
    return np.unique(np.concatenate((by_row, by_value)))[: bins - 1]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]).astype(np.int64) if len(cuts) else np.zeros((len(x), 0), np.int64)


@dataclass
class Isotonic:
    """A rising step function through pooled adjacent violators, linear between block centres."""

    x: np.ndarray
    y: np.ndarray

    @classmethod
    def fit(cls, scores: np.ndarray, labels: np.ndarray) -> Isotonic:
        order = np.argsort(scores, kind="stable")
        values, at = np.unique(scores[order], return_inverse=True)
        weight = np.bincount(at).astype(float)
        blocks: list[list[float]] = []  # mean label, weight, weighted sum of scores
        for v, w, s in zip(values, weight, np.bincount(at, labels[order])):
            blocks.append([s / w, w, v * w])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                m, w1, v1 = blocks.pop()
                m0, w0, v0 = blocks[-1]
                blocks[-1] = [(m0 * w0 + m * w1) / (w0 + w1), w0 + w1, v0 + v1]
        x = np.array([b[2] / b[1] for b in blocks])
        # one label of each kind is added to a block, so that no score is exactly 0 or 1
        y = np.array([(b[0] * b[1] + 0.01) / (b[1] + 0.02) for b in blocks])
        return cls(x, np.maximum.accumulate(y))

    def __call__(self, scores: np.ndarray) -> np.ndarray:
        return np.interp(scores, self.x, self.y)


@dataclass
class Trees:
    """Gradient-boosted trees of fixed depth for the logistic loss; each level of a tree splits all its nodes."""

    cuts: list[np.ndarray]
    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature, bin, leaf values

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, least: float = 2.0, shrink: float = 1.0) -> Trees:
        cuts = [cuts_of(x[:, j], bins) for j in range(x.shape[1])]
        b, p = binned(x, cuts), np.clip(y.mean(), 1e-3, 1 - 1e-3)
        model = cls(cuts, float(np.log(p / (1 - p))))
        f = np.full(len(y), model.base)
        width = bins + 1
        for _ in range(rounds):
            q = sigmoid(f)
            g, h = y - q, q * (1 - q)
            node = np.zeros(len(y), np.int64)
            feature, at = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, width, np.int64)
            for level in range(depth):
                nodes = 2**level
                gain, best = np.zeros(nodes), [(0, width)] * nodes
                for j in range(x.shape[1]):
                    key = node * width + b[:, j]
                    gl = np.bincount(key, g, nodes * width).reshape(nodes, width).cumsum(1)
                    hl = np.bincount(key, h, nodes * width).reshape(nodes, width).cumsum(1)
                    gr, hr = gl[:, -1:] - gl, hl[:, -1:] - hl
                    score = np.where((hl >= least * 0.1) & (hr >= least * 0.1), gl**2 / (hl + shrink) + gr**2 / (hr + shrink) - gl[:, -1:] ** 2 / (hl[:, -1:] + shrink), 0)
                    k = score.argmax(1)
                    for i in range(nodes):
                        if score[i, k[i]] > gain[i] + 1e-9:
                            gain[i], best[i] = score[i, k[i]], (j, int(k[i]))
                first = nodes - 1
                feature[first : first + nodes], at[first : first + nodes] = zip(*best)
                node = node * 2 + (b[np.arange(len(y)), feature[first + node]] > at[first + node])
            leaf = rate * np.bincount(node, g, 2**depth) / (np.bincount(node, h, 2**depth) + shrink)
            f += leaf[node]
            model.trees.append((feature, at, leaf))
        return model

    def __call__(self, x: np.ndarray) -> np.ndarray:
        b, rows = binned(x, self.cuts), np.arange(len(x))
        f = np.full(len(x), self.base)
        for feature, at, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(int(np.log2(len(leaf)))):
                k = 2**level - 1 + node
                node = node * 2 + (b[rows, feature[k]] > at[k])
            f += leaf[node]
        return f


@dataclass
class PairwiseGam:
    """A generalised additive model with pairwise interactions: one lookup table per feature and one per chosen pair of features."""

    cuts: list[np.ndarray]
    pair_cuts: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.1, bins: int = 48, n_pairs: int = 8, pair_bins: int = 8, pair_rounds: int = 40, shrink: float = 1.0) -> PairwiseGam:
        """Boost single-feature trees of three leaves in a cycle over the features, then small tables for the pairs that lower the loss most."""
        n, k = x.shape
        cuts, pair_cuts = [cuts_of(x[:, j], bins) for j in range(k)], [cuts_of(x[:, j], pair_bins) for j in range(k)]
        b, pb = binned(x, cuts), binned(x, pair_cuts)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        base = float(np.log(p / (1 - p)))
        f = np.full(n, base)
        tables = [np.zeros(len(c) + 1) for c in cuts]
        for _ in range(rounds):
            for j in range(k):
                q = sigmoid(f)
                step = rate * _shallow(np.bincount(b[:, j], y - q, len(tables[j])), np.bincount(b[:, j], q * (1 - q), len(tables[j])), shrink)
                tables[j] += step
                f += step[b[:, j]]
        q = sigmoid(f)
        g, h = y - q, q * (1 - q)
        width = pair_bins
        key = lambda i, j: pb[:, i] * width + pb[:, j]
        gains = {}
        for i, j in combinations(range(k), 2):
            gs, hs = np.bincount(key(i, j), g, width * width), np.bincount(key(i, j), h, width * width)
            gains[i, j] = (gs**2 / (hs + shrink)).sum()
        pairs = [(i, j, np.zeros(width * width)) for i, j in sorted(gains, key=lambda p: (-gains[p], p))[:n_pairs]]
        for _ in range(pair_rounds):
            for i, j, t in pairs:
                q = sigmoid(f)
                cell = key(i, j)
                step = rate * np.bincount(cell, y - q, len(t)) / (np.bincount(cell, q * (1 - q), len(t)) + 4 * shrink)
                t += step
                f += step[cell]
        return cls(cuts, pair_cuts, base, tables, [(i, j, t.reshape(width, width)) for i, j, t in pairs])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        b, pb = binned(x, self.cuts), binned(x, self.pair_cuts)
        f = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            f += t[b[:, j]]
        for i, j, t in self.pairs:
            f += t[pb[:, i], pb[:, j]]
        return f


def _shallow(g: np.ndarray, h: np.ndarray, shrink: float, leaves: int = 3) -> np.ndarray:
    """Newton steps of a tree with so many leaves over one feature's bins, split greedily."""
    out = np.zeros(len(g))
    parts = [(0, len(g))]
    cg, ch = np.concatenate(([0], g.cumsum())), np.concatenate(([0], h.cumsum()))
    worth = lambda a, z: (cg[z] - cg[a]) ** 2 / (ch[z] - ch[a] + shrink)
    while len(parts) < leaves:
        best = (1e-9, None, 0)
        for part in parts:
            a, z = part
            if z - a > 1:
                m = np.arange(a + 1, z)
                gain = worth(a, m) + worth(m, z) - worth(a, z)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], part, int(m[k]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    for a, z in parts:
        out[a:z] = (cg[z] - cg[a]) / (ch[z] - ch[a] + shrink)
    return out
