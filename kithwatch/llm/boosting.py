"""Gradient-boosted trees: fitted on a bounded sample, applied as a column expression.

Trees of fixed depth on binned features with logistic loss and Newton leaves (Friedman 2001;
Chen, Guestrin 2016). The fit takes a bounded number of rows, so it runs where they are; the
model becomes nested CASE expressions over columns, which Spark compiles like any other.

Defined results: without rows, or with one class only, the model is a constant.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Boosted:
    features: list[str]
    start: float = 0.0
    trees: list = field(default_factory=list)  # leaf value, or (feature, threshold, left, right)
    threshold: float = 0.5

    def margin(self) -> Column:
        """Log odds from columns named like the features."""

        def branch(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            name, limit, left, right = tree
            return F.when(F.col(name) <= F.lit(limit), branch(left)).otherwise(branch(right))

        total = F.lit(self.start)
        for tree in self.trees:
            total = total + branch(tree)
        return total

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.margin()))

    def margins(self, rows: np.ndarray) -> np.ndarray:
        """The same for a matrix with one column per feature."""

        def value(tree, chosen: np.ndarray, out: np.ndarray) -> None:
            if isinstance(tree, float):
                out[chosen] += tree
                return
            name, limit, left, right = tree
            low = rows[chosen, self.features.index(name)] <= limit
            value(left, chosen[low], out)
            value(right, chosen[~low], out)

        total = np.full(len(rows), self.start)
        for tree in self.trees:
            value(tree, np.arange(len(rows)), total)
        return total


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    distinct = np.unique(values)
    middles = (distinct[1:] + distinct[:-1]) / 2
    return middles if len(middles) < bins else np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def fit(
    features: Sequence[str],
    rows: np.ndarray,
    labels: np.ndarray,
    rounds: int = 20,
    depth: int = 3,
    rate: float = 0.3,
    bins: int = 32,
    penalty: float = 1.0,
) -> Boosted:
    """Boosted trees for labels 0 and 1; a fourth of the rows sets the threshold.

    The threshold is the probability above which the held-back rows are told apart best
    (share found of either class, averaged); every fourth row is held back.
    """
    model = Boosted(list(features))
    if not len(rows):
        return model
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
    model.start = float(np.log(share / (1 - share)))
    if labels.min() == labels.max():
        return model
    held = np.arange(len(rows)) % 4 == 3
    train_rows, train_labels = rows[~held], labels[~held].astype(float)
    edges = [_edges(train_rows[:, k], bins) for k in range(rows.shape[1])]
    binned = np.stack([np.searchsorted(edge, train_rows[:, k]) for k, edge in enumerate(edges)], axis=1)
    margin = np.full(len(train_rows), model.start)

    def grow(chosen: np.ndarray, gradient: np.ndarray, weight: np.ndarray, left_depth: int):
        g, h = gradient[chosen].sum(), weight[chosen].sum()
        best = (1e-6, None, None)
        for k, edge in enumerate(edges if left_depth else ()):
            if not len(edge):
                continue
            gs = np.cumsum(np.bincount(binned[chosen, k], gradient[chosen], len(edge) + 1))[:-1]
            hs = np.cumsum(np.bincount(binned[chosen, k], weight[chosen], len(edge) + 1))[:-1]
            gain = gs**2 / (hs + penalty) + (g - gs) ** 2 / (h - hs + penalty) - g**2 / (h + penalty)
            gain[(hs < 1e-3) | (h - hs < 1e-3)] = 0
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (float(gain[at]), k, at)
        if best[1] is None:
            value = float(-rate * g / (h + penalty))
            margin[chosen] += value
            return value
        _, k, at = best
        low = binned[chosen, k] <= at
        sides = [grow(chosen[side], gradient, weight, left_depth - 1) for side in (low, ~low)]
        return (model.features[k], float(edges[k][at]), *sides)

    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-margin))
        model.trees.append(grow(np.arange(len(train_rows)), chance - train_labels, chance * (1 - chance), depth))
    scores, truth = 1 / (1 + np.exp(-model.margins(rows[held]))), labels[held].astype(bool)
    if truth.any() and not truth.all():
        limits = np.unique(np.quantile(scores, np.linspace(0, 1, 65)))
        limits = (limits[1:] + limits[:-1]) / 2 if len(limits) > 1 else limits
        quality = [(scores[truth] > limit).mean() + (scores[~truth] <= limit).mean() for limit in limits]
        # In the middle of the limits that are equally good.
        good = limits[np.array(quality) >= max(quality) - 1e-9]
        model.threshold = float(good[len(good) // 2])
    return model
