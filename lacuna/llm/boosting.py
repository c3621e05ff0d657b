"""Gradient-boosted trees on bounded training samples."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Additive trees for a binary outcome; each is a list of (feature, threshold, left, right, value)."""

    base: float = 0.0
    trees: list[tuple[np.ndarray, ...]] = field(default_factory=list)
    depth: int = 3

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, threshold, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[node]
                right = x[np.arange(len(x)), np.maximum(f, 0)] > threshold[node]
                node = np.where(f >= 0, 2 * node + 1 + right, 2 * node + 1)
            out += value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0) -> Boosted:
    """Fit on rows ``x`` and outcomes 0 or 1, by Newton steps on quantile bins."""
    x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    p0 = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    model = Boosted(float(np.log(p0 / (1 - p0))), [], depth)
    if len(y) < 4 or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    f = np.full(len(y), model.base)
    size = 2 ** (depth + 1) - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, threshold, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth + 1):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                m = node == k
                if not m.any():
                    continue
                gs, hs = g[m].sum(), h[m].sum()
                value[k] = rate * gs / (hs + l2)
                if level == depth:
                    continue
                best = (1e-6, -1, 0)
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    gl = np.cumsum(np.bincount(binned[m, j], weights=g[m], minlength=len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[m, j], weights=h[m], minlength=len(c) + 1))[:-1]
                    gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                    gain[(hl < 0.5) | (hs - hl < 0.5)] = -1
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        best = (float(gain[i]), j, i)
                if best[1] >= 0:
                    feature[k], threshold[k] = best[1], cuts[best[1]][best[2]]
                    node[m] = 2 * k + 1 + (binned[m, best[1]] > best[2])
                else:
                    # an unsplit node passes down its left side
                    node[m] = 2 * k + 1
        model.trees.append((feature, threshold, value))
        f += value[node]
    return model
