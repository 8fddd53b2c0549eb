"""Gradient-boosted trees on histograms, with monotonic constraints, flattened for scoring.

The trees are fitted on a bounded sample on the driver; scoring runs in Spark tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """All trees end to end: one array per field, ``roots`` holds where each begins."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """The probability of class 1 for each row; all trees step down one level at a time."""
        if not len(rows):
            return np.zeros(0)
        at = np.broadcast_to(self.roots, (len(rows), len(self.roots))).copy()
        line = np.arange(len(rows))[:, None]
        for _ in range(self.depth):
            at = np.where(rows[line, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit(rows: np.ndarray, label: np.ndarray, signs: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15,
        bins: int = 48, ridge: float = 1.0, least: float = 4.0) -> Forest | None:
    """Logistic loss, second order.  ``signs``: 1 rising, -1 falling, 0 free, for each feature.

    Returns None unless both classes occur.  Leaves are kept between the middle values of
    the constrained splits above them, so the whole forest is monotonic.
    """
    if len(rows) == 0 or len(np.unique(label)) < 2:
        return None
    count = rows.shape[1]
    cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(count)]
    binned = np.stack([np.searchsorted(cuts[f], rows[:, f], side="left") for f in range(count)], axis=1)
    rate0 = label.mean()
    base = float(np.log(rate0 / (1 - rate0)))
    margin = np.full(len(rows), base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        at = len(feature)
        for field, empty in ((feature, 0), (threshold, np.inf), (left, at), (right, at), (value, 0.0)):
            field.append(empty)
        return at

    def weight(g: np.ndarray, h: np.ndarray, low: float, high: float) -> np.ndarray:
        return np.clip(-g / (h + ridge), low, high)

    def gain(g, h, w):
        return -(g * w + 0.5 * (h + ridge) * w * w)

    for _ in range(trees):
        chance = 1 / (1 + np.exp(-margin))
        grad, hess = chance - label, np.maximum(chance * (1 - chance), 1e-6)
        root = node()
        roots.append(root)
        open_nodes = [(root, np.arange(len(rows)), -np.inf, np.inf, depth)]
        while open_nodes:
            at, members, low, high, levels = open_nodes.pop()
            g, h = grad[members].sum(), hess[members].sum()
            own = float(weight(g, h, low, high))
            best = (1e-6, None)
            for f in range(count if levels else 0):
                if not len(cuts[f]):
                    continue
                gs = np.cumsum(np.bincount(binned[members, f], grad[members], len(cuts[f]) + 1))[:-1]
                hs = np.cumsum(np.bincount(binned[members, f], hess[members], len(cuts[f]) + 1))[:-1]
                ns = np.cumsum(np.bincount(binned[members, f], minlength=len(cuts[f]) + 1))[:-1]
                wl, wr = weight(gs, hs, low, high), weight(g - gs, h - hs, low, high)
                better = gain(gs, hs, wl) + gain(g - gs, h - hs, wr) - gain(g, h, own)
                allowed = (ns >= least) & (len(members) - ns >= least) & (signs[f] * (wr - wl) >= 0)
                if allowed.any():
                    k = int(np.argmax(np.where(allowed, better, -np.inf)))
                    if better[k] > best[0]:
                        best = (better[k], (f, k, float(wl[k]), float(wr[k])))
            if best[1] is None:
                value[at] = own * rate
                margin[members] += own * rate
                continue
            f, k, wl, wr = best[1]
            middle = (wl + wr) / 2
            goes_left = binned[members, f] <= k
            feature[at], threshold[at], left[at], right[at] = f, cuts[f][k], node(), node()
            bound = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}
            (ll, lh), (rl, rh) = bound[int(signs[f])]
            open_nodes.append((left[at], members[goes_left], ll, lh, levels - 1))
            open_nodes.append((right[at], members[~goes_left], rl, rh, levels - 1))
    return Forest(*(np.array(x) for x in (feature, threshold, left, right, value, roots)), depth, base)
