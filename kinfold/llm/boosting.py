"""Gradient-boosted trees for two classes, in numpy: histogram splits, logistic loss.

Trained on the driver over a bounded sample. A tree is a list of nodes, a node (feature,
threshold, left, right, value): rows with x[feature] <= threshold go left; a leaf has
feature -1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

Node = tuple[int, float, int, int, float]


@dataclass
class Trees:
    base: float
    trees: list[list[Node]]

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of class 1."""
        out = np.full(len(x), self.base)
        for t in self.trees:
            f, c, left, right, value = (np.array(v) for v in zip(*t, strict=True))
            at = np.zeros(len(x), np.int64)
            while True:
                inner = f[at] >= 0
                if not inner.any():
                    break
                go = x[np.arange(len(x)), np.maximum(f[at], 0)] <= c[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            out += value[at]
        return out


def train(x: np.ndarray, y: np.ndarray, rounds: int = 30, depth: int = 3, rate: float = 0.3, bins: int = 32, least: int = 10, l2: float = 1.0, share: float = 1.0) -> Trees:
    """``share``: the part of the rows that each tree is grown from, drawn anew for each."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    p = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
    model = Trees(float(np.log(p / (1 - p))), [])
    if not len(y) or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(q, c, "left") for q, c in zip(cuts, x.T, strict=True)], 1)
    # the bins of all features side by side, so that one pass counts them; where a feature has no cut
    width = max(2, 1 + max(map(len, cuts)))
    flat = binned + np.arange(len(cuts)) * width
    beyond = np.arange(width - 1) >= np.array(list(map(len, cuts)))[:, None]
    f = np.full(len(y), model.base)
    draw = np.random.default_rng(0)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        nodes: list[list] = [[-1, 0.0, -1, -1, 0.0]]
        work = [(0, np.arange(len(y)) if share >= 1 else np.flatnonzero(draw.random(len(y)) < share), 0)]
        while work:
            at, rows, level = work.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            nodes[at][4] = float(rate * gs / (hs + l2))
            best = (1e-3, -1, 0)
            if level < depth and len(rows) >= 2 * least:
                at_bin = flat[rows].ravel()
                many = lambda w: np.repeat(w, len(cuts)) if w is not None else None
                gl, hl, nl = (np.cumsum(np.bincount(at_bin, many(w), len(cuts) * width).reshape(-1, width), 1)[:, :-1] for w in (g[rows], h[rows], None))
                gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                gain[(nl < least) | (len(rows) - nl < least) | beyond] = -1
                k, c = divmod(int(gain.argmax()), width - 1)
                if gain[k, c] > best[0]:
                    best = (float(gain[k, c]), k, c)
            if best[1] < 0:
                if share >= 1:
                    f[rows] += nodes[at][4]
                continue
            _, k, c = best
            go = binned[rows, k] <= c
            nodes[at][:4] = [k, float(cuts[k][c]), len(nodes), len(nodes) + 1]
            nodes += [[-1, 0.0, -1, -1, 0.0], [-1, 0.0, -1, -1, 0.0]]
            work += [(len(nodes) - 2, rows[go], level + 1), (len(nodes) - 1, rows[~go], level + 1)]
        model.trees.append([tuple(n) for n in nodes])
        if share < 1:
            f = f + Trees(0.0, model.trees[-1:]).raw(x)
    return model


def paths(model: Trees) -> list[tuple[tuple[int, bool, float], ...]]:
    """Each node's path from its root, as a conjunction of (feature, whether above, threshold)."""
    out: dict[tuple, None] = {}
    for t in model.trees:
        work = [(0, ())]
        while work:
            at, path = work.pop()
            if path:
                out[tuple(sorted(path))] = None
            k, c, left, right, _ = t[at]
            if k >= 0:
                work += [(left, (*path, (k, False, c))), (right, (*path, (k, True, c)))]
    return list(out)
