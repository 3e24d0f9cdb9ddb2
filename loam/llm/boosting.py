"""Small gradient-boosted decision trees for yes-or-no labels, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Complete binary trees: node i splits feature[i] at cut[i] (right if above) and has the
    children 2i + 1 and 2i + 2; the last level holds values."""

    depth: int
    base: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += value[at - (2**self.depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 5, rate: float = 0.3, bins: int = 32, ridge: float = 1.0) -> Boosted:
    """Newton boosting of the logistic loss over histograms of binned features."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)  # above cut i: bin > i
    flat = binned + np.arange(width) * bins
    usable = np.arange(bins) < np.array([len(c) for c in cuts])[:, None]
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(depth, float(np.log(share / (1 - share))))
    score = np.full(n, model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(n, np.int64)
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            own = at - first
            key = (own[:, None] * (width * bins) + flat).ravel()
            gs, hs = (np.bincount(key, np.repeat(w, width), count * width * bins).reshape(count, width, bins).cumsum(2) for w in (g, h))
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
            gain = np.where(usable, gain, 0).reshape(count, -1)
            where = gain.argmax(1)
            for node in np.flatnonzero(gain[np.arange(count), where] > 1e-6):
                j, i = divmod(int(where[node]), bins)
                feature[first + node], cut[first + node] = j, cuts[j][i]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > cut[at])
        leaf = at - (2**depth - 1)
        value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        model.feature.append(feature)
        model.cut.append(cut)
        model.value.append(value)
        score += value[leaf]
    return model
