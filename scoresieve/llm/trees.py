"""Gradient-boosted regression trees on logistic loss, over binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 16


@dataclass
class Boosted:
    edges: list[np.ndarray]  # for each feature, the upper edges of its bins but the last
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # feature and bin of each inner node of a full tree, value of each leaf
    start: float
    depth: int

    def binned(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape, np.uint8)
        for j, edge in enumerate(self.edges):
            if len(edge) == 1:
                out[:, j] = x[:, j] > edge[0]
            elif len(edge):
                out[:, j] = np.searchsorted(edge, x[:, j], "left")
        return out

    def margins(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        rows, out = np.arange(len(b)), np.full(len(b), self.start)
        for feature, cut, value in self.trees:
            node = np.zeros(len(b), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            out += value[node - (2**self.depth - 1)]
        return out


def boosted(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.25, ridge: float = 1.0) -> Boosted:
    edges = []
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        edges.append((values[:-1] + values[1:]) / 2 if len(values) <= BINS else np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])))
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(edges, [], float(np.log(share / (1 - share))), depth)
    b = model.binned(x)
    n = len(b)
    # Two-valued features are summed by matrix products, the others by counting bins.
    many = np.array([j for j, e in enumerate(edges) if len(e) > 1], np.int64)
    two = np.array([j for j, e in enumerate(edges) if len(e) == 1], np.int64)
    flat = b[:, many].astype(np.int32) + np.arange(len(many), dtype=np.int32) * BINS
    high = b[:, two].astype(np.float32)
    margin = np.full(n, model.start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, 255, np.int64)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            at = node - (2**level - 1)
            spread = np.zeros((n, 2 * 2**level), np.float32)
            spread[np.arange(n), 2 * at], spread[np.arange(n), 2 * at + 1] = g, h
            right = high.T @ spread
            for k in range(2**level):
                own = np.flatnonzero(at == k)
                if len(own) < 10:
                    continue
                total_g, total_h = g[own].sum(), h[own].sum()
                where = flat[own].ravel()
                gs = np.bincount(where, np.repeat(g[own], len(many)), len(many) * BINS).reshape(-1, BINS).cumsum(1)
                hs = np.bincount(where, np.repeat(h[own], len(many)), len(many) * BINS).reshape(-1, BINS).cumsum(1)
                split = lambda a, c: a**2 / (c + ridge) + (total_g - a) ** 2 / (total_h - c + ridge) - total_g**2 / (total_h + ridge)
                of_many, of_two = split(gs, hs), split(right[:, 2 * k].astype(float), right[:, 2 * k + 1].astype(float))
                best, other = of_many.max(initial=0.0), of_two.max(initial=0.0)
                if max(best, other) > 1e-3:
                    if best >= other:
                        j, c = divmod(int(of_many.argmax()), BINS)
                        feature[2**level - 1 + k], cut[2**level - 1 + k] = many[j], c
                    else:
                        feature[2**level - 1 + k], cut[2**level - 1 + k] = two[int(of_two.argmax())], 0
            node = 2 * node + 1 + (b[np.arange(n), feature[node]] > cut[node])
        leaf = node - (2**depth - 1)
        value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        margin += value[leaf]
        model.trees.append((feature, cut, value))
    return model
