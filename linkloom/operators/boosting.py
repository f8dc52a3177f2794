"""Gradient-boosted trees on histograms, for training sets of a bounded size.

Features are cut into at most ``BINS`` bins by quantiles. Each tree grows level by level: the
gradients and weights of all open nodes are summed by bin at once, every node takes its best
split, and only the splits of most gain are kept until the tree has its leaves. Rows fit one
machine because the caller bounds them; a fitted model is a few small arrays, which score any
number of rows batch by batch.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 64


@dataclass(frozen=True)
class Settings:
    """The settings of the boosted trees; ``positive`` is how positives are weighted."""

    trees: int = 500
    rate: float = 0.05
    depth: int = 7
    leaves: int = 63
    least: int = 50
    rows: float = 0.8
    columns: float = 0.8
    l1: float = 0.1
    l2: float = 1.0
    positive: str | float = 1.0
    seed: int = 42


@dataclass
class Trees:
    """Complete binary trees by level order: feature (-1: leaf), threshold and value of each node."""

    base: float
    depth: int
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    losses: list[float] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row of ``x``; a missing value goes left."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                own = f[at]
                right = x[rows, np.maximum(own, 0)] > c[at]
                at = np.where(own < 0, at, 2 * at + 1 + right)
            out += v[at]
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _logistic(self.scores(np.asarray(x, np.float32)))

    def to_dict(self) -> dict:
        return {"base": self.base, "depth": self.depth, "feature": self.feature.tolist(), "cut": self.cut.tolist(), "value": self.value.tolist()}

    @staticmethod
    def from_dict(d: dict) -> Trees:
        return Trees(d["base"], d["depth"], np.array(d["feature"], np.int32), np.array(d["cut"], np.float32), np.array(d["value"]))


def _logistic(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -40, 40)))


def _edges(x: np.ndarray) -> list[np.ndarray]:
    """Cuts of each feature: values between its quantiles, each once."""
    out = []
    for col in x.T:
        u = np.unique(col)
        if len(u) > BINS:
            u = np.unique(np.quantile(col, np.linspace(0, 1, BINS), method="nearest"))
        out.append(((u[:-1].astype(np.float64) + u[1:]) / 2).astype(np.float32))
    return out


def _shrunk(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0)


def _gain(g: np.ndarray, h: np.ndarray, s: Settings) -> np.ndarray:
    return _shrunk(g, s.l1) ** 2 / (h + s.l2)


def weights(y: np.ndarray, s: Settings) -> np.ndarray:
    """1 for negatives; for positives the set number, or what makes both classes weigh alike."""
    pos = max(1, int((y == 1).sum()))
    up = max(1.0, (len(y) - pos) / pos) if s.positive == "balanced" else float(s.positive)
    return np.where(y == 1, up, 1.0)


def fit(x: np.ndarray, y: np.ndarray, s: Settings) -> Trees:
    """Trees on rows ``x`` with labels 0 and 1. Equal rows in equal order give equal trees."""
    x = np.asarray(x, np.float32)
    n, m = x.shape
    w = weights(y, s)
    p0 = np.clip((w * y).sum() / max(w.sum(), 1e-9), 1e-6, 1 - 1e-6) if n else 0.5
    base = float(np.log(p0 / (1 - p0)))
    nodes = 2 ** (s.depth + 1) - 1
    feature = np.full((s.trees, nodes), -1, np.int32)
    cut, value = np.zeros((s.trees, nodes), np.float32), np.zeros((s.trees, nodes))
    edges = _edges(x) if n else [np.zeros(0, np.float32)] * m
    code = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1).astype(np.int64) if n else np.zeros((0, m), np.int64)
    bins = max(map(len, edges), default=0) + 1
    r = np.random.RandomState(s.seed)
    f, losses = np.full(n, base), []
    for t in range(s.trees if n else 0):
        p = _logistic(f)
        grad, hess = w * (p - y), w * np.maximum(p * (1 - p), 1e-9)
        rows = np.flatnonzero(r.random_sample(n) < s.rows) if s.rows < 1 else np.arange(n)
        cols = np.sort(r.permutation(m)[: max(1, round(s.columns * m))])
        _grow(code, edges, bins, grad, hess, rows, cols, s, feature[t], cut[t], value[t])
        at = np.zeros(n, np.int64)
        every = np.arange(n)
        for _ in range(s.depth):
            own = feature[t][at]
            at = np.where(own < 0, at, 2 * at + 1 + (x[every, np.maximum(own, 0)] > cut[t][at]))
        f = f + value[t][at]
        losses.append(float((w * np.logaddexp(0, np.where(y == 1, -f, f))).sum() / w.sum()))
    return Trees(base, s.depth, feature, cut, value, losses)


def _grow(code, edges, bins, grad, hess, rows, cols, s: Settings, feature, cut, value) -> None:
    """One tree into ``feature``, ``cut`` and ``value``."""
    at = np.zeros(len(rows), np.int64)
    leaves, level = 1, np.array([0])
    value[0] = _leaf(grad[rows].sum(), hess[rows].sum(), s)
    for _ in range(s.depth):
        k = len(level)
        # nodes of a level get running numbers; rows of closed nodes are out
        number = np.full(len(feature) + 1, -1)  # the last one is for closed nodes, at -1
        number[level] = np.arange(k)
        own = number[at]
        live = own >= 0
        sub, own = rows[live], own[live]
        if not len(sub) or leaves >= s.leaves or bins < 2:
            return
        total_g, total_h = np.bincount(own, grad[sub], k), np.bincount(own, hess[sub], k)
        # all nodes and features in one table of bins
        key = (own[:, None] * len(cols) + np.arange(len(cols))) * bins + code[np.ix_(sub, cols)]
        shape, size = (k, len(cols), bins), k * len(cols) * bins
        sums = lambda x: np.bincount(key.ravel(), np.repeat(x[sub], len(cols)), size).reshape(shape).cumsum(2)[:, :, :-1]  # noqa: E731, B023
        g, h = sums(grad), sums(hess)
        q = np.bincount(key.ravel(), minlength=size).reshape(shape).cumsum(2)
        left, right = q[:, :, :-1], q[:, :, -1:] - q[:, :, :-1]
        rest = _gain(total_g[:, None, None] - g, total_h[:, None, None] - h, s) - _gain(total_g, total_h, s)[:, None, None]
        gain = np.where((left >= s.least) & (right >= s.least), _gain(g, h, s) + rest, 0.0).reshape(k, -1)
        top = gain.argmax(1)
        most = gain[np.arange(k), top]
        col, goes = cols[top // (bins - 1)], top % (bins - 1)
        chosen = np.lexsort((np.arange(k), -most))[: s.leaves - leaves]
        chosen = chosen[most[chosen] > 1e-12]
        if not len(chosen):
            return
        for j in chosen.tolist():
            feature[level[j]], cut[level[j]] = col[j], edges[col[j]][goes[j]]
        leaves += len(chosen)
        split = np.isin(own, chosen)
        sub, own = sub[split], own[split]
        to = 2 * level[own] + 1 + (code[sub, col[own]] > goes[own])
        place = np.flatnonzero(live)[split]
        at[live] = -1  # unsplit nodes are closed
        at[place] = to
        below = 2 * level[np.sort(chosen)] + 1
        level = np.stack([below, below + 1], 1).ravel()
        value[level] = _leaf(np.bincount(to, grad[sub], len(feature))[level], np.bincount(to, hess[sub], len(feature))[level], s)


def _leaf(g: np.ndarray, h: np.ndarray, s: Settings) -> np.ndarray:
    return -s.rate * _shrunk(g, s.l1) / (h + s.l2)
