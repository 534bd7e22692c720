"""Gradient boosting of small trees on a bounded table of features, and its score as a Spark expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tree:
    """Two levels: ``split`` decides which of two further (feature, threshold, low, high) applies."""

    split: tuple[int, float]
    sides: tuple[tuple[int, float, float, float], tuple[int, float, float, float]]


def _best(x: np.ndarray, g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int, float, float, float]:
    """(gain, feature, threshold, low value, high value) of the best split; low is at or under the threshold."""
    score = lambda a, b: a * a / (b + ridge)
    best = (0.0, 0, float("inf"), g.sum() / (h.sum() + ridge) if len(g) else 0.0, 0.0)
    for f in range(x.shape[1]):
        for t in np.unique(x[:, f])[:-1]:
            low = x[:, f] <= t
            gl, hl, gr, hr = g[low].sum(), h[low].sum(), g[~low].sum(), h[~low].sum()
            gain = score(gl, hl) + score(gr, hr) - score(gl + gr, hl + hr)
            if gain > best[0] + 1e-12:
                best = (gain, f, float(t), gl / (hl + ridge), gr / (hr + ridge))
    return best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 24, rate: float = 0.3, ridge: float = 1.0) -> list[Tree]:
    """Trees of depth two for the logistic loss, by second-order boosting; the same input gives the same trees."""
    trees, f = [], np.zeros(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        _, feature, at, _, _ = _best(x, g, h, ridge)
        low = x[:, feature] <= at
        sides = []
        for own in (low, ~low):
            _, k, t, a, b = _best(x[own], g[own], h[own], ridge)
            sides.append((k, t, rate * float(a), rate * float(b)))
        trees.append(Tree((feature, at), (sides[0], sides[1])))
        f += raw([trees[-1]], x)
    return trees


def raw(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for t in trees:
        sides = [np.where(x[:, k] <= at, a, b) for k, at, a, b in t.sides]
        out += np.where(x[:, t.split[0]] <= t.split[1], *sides)
    return out


def threshold(score: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least score at and above which held-out candidates are right at least as often as ``precision`` asks."""
    order = np.argsort(-score, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(score[order][1:] != score[order][:-1], True)
    good = np.flatnonzero(last & (right >= precision))
    return float(score[order][good[-1]]) if len(good) else float("inf")


def expression(trees: list[Tree], x: Column) -> Column:
    """The raw score of an array of features."""

    def side(s: tuple[int, float, float, float]) -> Column:
        k, at, low, high = s
        return F.lit(low) if at == float("inf") else F.when(x[k] <= at, low).otherwise(high)

    out = F.lit(0.0)
    for t in trees:
        low, high = map(side, t.sides)
        out = out + (low if t.split[1] == float("inf") else F.when(x[t.split[0]] <= t.split[1], low).otherwise(high))
    return out
