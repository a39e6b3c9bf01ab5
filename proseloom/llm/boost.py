"""Gradient-boosted regression trees over binned features, in numpy.

Training runs on the driver over a bounded sample; a fitted model is a few arrays and goes to the workers in a closure.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 64


@dataclass
class Boost:
    """``loss`` is "squared" or "logistic" (targets 0 and 1, predictions are log-odds)."""

    loss: str = "squared"
    rounds: int = 120
    depth: int = 4
    rate: float = 0.1
    least: int = 8
    l2: float = 1.0
    subsample: float = 0.8
    seed: int = 7
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1).astype(np.int16)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Boost:
        x, y = np.nan_to_num(np.asarray(x, dtype=np.float64)), np.asarray(y, dtype=np.float64)
        w = np.ones(len(y)) if weight is None else np.asarray(weight, dtype=np.float64)
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(x.shape[1])]
        b = self._bin(x)
        mean = float(np.average(y, weights=w))
        self.base = mean if self.loss == "squared" else float(np.log((mean + 1e-6) / (1 - mean + 1e-6)))
        score, rng = np.full(len(y), self.base), np.random.default_rng(self.seed)
        self.trees = []
        for _ in range(self.rounds):
            if self.loss == "squared":
                g, h = (y - score) * w, w
            else:
                p = 1 / (1 + np.exp(-score))
                g, h = (y - p) * w, np.maximum(p * (1 - p), 1e-6) * w
            use = rng.random(len(y)) < self.subsample
            tree = self._tree(b[use], g[use], h[use])
            self.trees.append(tree)
            score += self._apply(tree, b)
        return self

    def _tree(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = (1 << (self.depth + 1)) - 1
        feature, cut, value = np.full(n, -1, dtype=np.int32), np.zeros(n, dtype=np.int16), np.zeros(n)
        node = np.zeros(len(g), dtype=np.int64)
        n_columns = b.shape[1]
        step = n_columns * (BINS + 1)
        columns = b.astype(np.int64) + np.arange(n_columns) * (BINS + 1)
        for level in range(self.depth + 1):
            first, width = (1 << level) - 1, 1 << level
            at = node - first
            live = (at >= 0) & (at < width)
            total_g = np.bincount(at[live], g[live], width)
            total_h = np.bincount(at[live], h[live], width)
            value[first : first + width] = self.rate * total_g / (total_h + self.l2)
            if level == self.depth or not live.any():
                break
            rows = np.flatnonzero(live)
            key = (columns[rows] + (at[rows] * step)[:, None]).ravel()
            sums = [np.bincount(key, np.repeat(v[rows], n_columns), width * step).reshape(width, n_columns, BINS + 1).cumsum(2) for v in (g, h)]
            cg, ch = sums
            cn = ch if self.loss == "squared" else np.bincount(key, minlength=width * step).reshape(cg.shape).cumsum(2)
            rg, rh, rn = cg[:, :, -1:] - cg, ch[:, :, -1:] - ch, cn[:, :, -1:] - cn
            gain = cg**2 / (ch + self.l2) + rg**2 / (rh + self.l2) - cg[:, :, -1:] ** 2 / (ch[:, :, -1:] + self.l2)
            gain[(cn < self.least) | (rn < self.least)] = -1
            gain = gain.reshape(width, -1)
            best_c = gain.argmax(1)
            best_f = np.where(gain[np.arange(width), best_c] > 1e-7, best_c // (BINS + 1), -1)
            best_c = best_c % (BINS + 1)
            feature[first : first + width], cut[first : first + width] = best_f, best_c
            split = live & (feature[node] >= 0)
            right = b[np.flatnonzero(split), feature[node[split]]] > cut[node[split]]
            node[split] = 2 * node[split] + 1 + right
        return feature, cut, value

    @staticmethod
    def _apply(tree: tuple[np.ndarray, np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node, rows = np.zeros(len(b), dtype=np.int64), np.arange(len(b))
        while True:
            f = feature[node]
            go = f >= 0
            if not go.any():
                return value[node]
            node[go] = 2 * node[go] + 1 + (b[rows[go], f[go]] > cut[node[go]])

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        b = self._bin(np.nan_to_num(np.asarray(x, dtype=np.float64)))
        return self.base + sum((self._apply(t, b) for t in self.trees), np.zeros(len(b)))


    def upper(self, x: np.ndarray, free: list[int]) -> np.ndarray:
        """No less than any prediction for rows of ``x``, whatever values the columns ``free`` have."""
        b = self._bin(np.nan_to_num(np.asarray(x, dtype=np.float64)))
        total = np.full(len(b), self.base)
        for feature, cut, value in self.trees:
            reached, best = [None] * len(feature), np.full(len(b), -np.inf)
            reached[0] = np.ones(len(b), dtype=bool)
            for node, here in enumerate(reached):
                if here is None:
                    continue
                if feature[node] < 0:
                    best[here] = np.maximum(best[here], value[node])
                elif feature[node] in free:
                    reached[2 * node + 1] = reached[2 * node + 2] = here
                else:
                    right = b[:, feature[node]] > cut[node]
                    reached[2 * node + 1], reached[2 * node + 2] = here & ~right, here & right
            total += best
        return total


def folds(groups: np.ndarray, n: int = 5) -> np.ndarray:
    """A fold for each row; whole groups stay together, larger ones are dealt first."""
    names, counts = np.unique(groups, return_counts=True)
    load, of = np.zeros(n), {}
    for i in np.argsort(-counts):
        k = int(load.argmin())
        of[names[i]] = k
        load[k] += counts[i]
    return np.array([of[g] for g in groups])


def isotonic(x: np.ndarray, y: np.ndarray, strict: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing function nearest to y over x (pool adjacent violators); rows of one x are pooled first.

    ``strict`` puts one knot in the middle of each pool, so that the function rises between them all and ties stay rare.
    """
    at, back, count = np.unique(x, return_inverse=True, return_counts=True)
    blocks: list[list[float]] = []
    for a, b, n in zip(at.tolist(), (np.bincount(back, y) / count).tolist(), count.tolist()):
        blocks.append([b, float(n), a, a, a * n])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, n, _, hi, total = blocks.pop()
            u = blocks[-1]
            u[0], u[1], u[3], u[4] = (u[0] * u[1] + v * n) / (u[1] + n), u[1] + n, hi, u[4] + total
    if strict:
        knots = [(b[4] / b[1], b[0]) for b in blocks]
    else:
        knots = [(p, b[0]) for b in blocks for p in dict.fromkeys((b[2], b[3]))]
    return np.array([k for k, _ in knots]), np.array([v for _, v in knots])


def best_cut(score: np.ndarray, truth: np.ndarray) -> float:
    """The threshold with the highest F1; in the middle of the gap below it. Rows of one score are taken together."""
    order = np.argsort(-score, kind="stable")
    ranked, hits = score[order], np.cumsum(truth[order])
    if not len(hits) or not hits[-1]:
        return float("inf")
    f1 = 2 * hits / (np.arange(1, len(hits) + 1) + hits[-1])
    f1[:-1][ranked[1:] == ranked[:-1]] = -1
    i = int(f1.argmax())
    low = ranked[i + 1] if i + 1 < len(order) else ranked[i]
    return float((ranked[i] + low) / 2)
