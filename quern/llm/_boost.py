"""Gradient-boosted trees in numpy: histogram splits, monotonic constraints, flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """All trees in one set of node arrays; ``feature`` is -1 at leaves, ``left``/``right`` are node indexes."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of features."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                goes_left = x[rows, np.maximum(f, 0)] <= self.threshold[node]
                node = np.where(inner, np.where(goes_left, self.left[node], self.right[node]), node)
            out += self.value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, penalty: float = 1.0, least: int = 8, bins: int = 48) -> Trees:
    """Boosts on log loss. ``monotone``: per feature -1, 0 or 1, the direction in which the score may go.

    A split on a constrained feature is taken only if its children's values are in order, and the
    middle of the two then bounds all values below either child, so that every tree is monotonic.
    With no rows or one class only, the result is a constant.
    """
    p = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(p / (1 - p)))
    nodes: list[list] = []
    roots: list[int] = []
    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
        margin = np.full(len(y), base)

        def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, left: int) -> int:
            G, H = g[rows].sum(), h[rows].sum()
            at = len(nodes)
            nodes.append([-1, 0.0, -1, -1, float(np.clip(-G / (H + penalty), low, high)) * rate])
            best = (1e-6, -1, 0, 0.0, 0.0)
            for j, c in enumerate(cuts) if left and len(rows) >= 2 * least else ():
                if not len(c):
                    continue
                b = binned[rows, j]
                n, gs, hs = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (None, g[rows], h[rows]))
                lv, rv = np.clip(-gs / (hs + penalty), low, high), np.clip(-(G - gs) / (H - hs + penalty), low, high)
                gain = gs**2 / (hs + penalty) + (G - gs) ** 2 / (H - hs + penalty) - G**2 / (H + penalty)
                fits = (n >= least) & (len(rows) - n >= least) & (monotone[j] * (rv - lv) >= 0)
                k = int(np.argmax(np.where(fits, gain, -np.inf)))
                if fits[k] and gain[k] > best[0]:
                    best = (gain[k], j, k, lv[k], rv[k])
            _, j, k, lv, rv = best
            if j >= 0:
                middle, m = (lv + rv) / 2, monotone[j]
                goes = binned[rows, j] <= k
                nodes[at][:2] = [j, float(cuts[j][k])]
                nodes[at][2] = grow(rows[goes], g, h, middle if m < 0 else low, middle if m > 0 else high, left - 1)
                nodes[at][3] = grow(rows[~goes], g, h, middle if m > 0 else low, middle if m < 0 else high, left - 1)
            return at

        for _ in range(rounds):
            q = 1 / (1 + np.exp(-margin))
            first = len(nodes)
            roots.append(grow(np.arange(len(y)), q - y, q * (1 - q), -np.inf, np.inf, depth))
            f, t, l, r, v = (np.array(a) for a in zip(*nodes[first:], strict=True))
            tree = Trees(f, t, l - first, r - first, v, np.array([0]), depth, 0.0)
            margin += tree.margin(x)
    f, t, l, r, v = (np.array(a) for a in zip(*(nodes or [[-1, 0.0, -1, -1, 0.0]]), strict=True))
    return Trees(f.astype(np.int64), t.astype(float), l.astype(np.int64), r.astype(np.int64), v.astype(float), np.array(roots, np.int64), depth, base)
