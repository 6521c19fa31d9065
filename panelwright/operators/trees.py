"""Random forest and boosted trees on counted rows.

Rows with equal columns are one cell that carries their number per class, so the
work depends on the cells and not on the rows. Every column is cut into at most
BINS bins by MLlib's rule, over all rows. Trees grow level by level
from histograms of the cells, a tree or a class within one task; the cells
(binned) are sent to the tasks.

The forest draws each tree's rows with replacement: a cell of n rows comes
Poisson(n) times. Boosting is one-vs-rest with the log loss of MLlib's trees:
the first tree fits the label, each further one the gradient.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

# Bins of a column, groups of trees whose votes are added up in one task.
BINS = 32
TREE_GROUPS = 16
FOREST = {"trees": 200, "depth": 10}
BOOSTED = {"trees": 150, "depth": 4, "step": 0.1}


def cut_points(values: np.ndarray, weights: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Thresholds of a column: between all values if they are few, else where the running weight is nearest to equal shares."""
    v, at = np.unique(values, return_inverse=True)
    n = np.bincount(at.ravel(), weights, len(v))
    v, n = v[n > 0], n[n > 0]
    if len(v) <= bins:
        return (v[:-1] + v[1:]) / 2
    share, seen, out = n.sum() / bins, n[0], []
    target = share
    for i in range(1, len(v)):
        before, seen = seen, seen + n[i]
        if abs(before - target) < abs(seen - target):
            out.append((v[i - 1] + v[i]) / 2)
            target += share
    return np.array(out)


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin of every value [row, column]; bin i lies left of cut i."""
    return np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]).astype(np.int16)


@dataclass
class Tree:
    """Nodes in heap order; a leaf has feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        """Values [row, ...] of the leaves the rows fall into."""
        node = np.zeros(len(codes), np.int64)
        moving = np.arange(len(codes))
        while len(moving):
            f = self.feature[node[moving]]
            moving, f = moving[f >= 0], f[f >= 0]
            at = node[moving]
            node[moving] = 2 * at + 1 + (codes[moving, f] > self.cut[at])
        return self.value[node]


def _gini(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and sum of squared counts over rows of class counts [..., class]."""
    n = sums.sum(-1)
    return n, (sums * sums).sum(-1) / np.maximum(n, 1e-300)


def _squares(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and squared sum over rows of (rows, sum of values)."""
    return sums[..., 0], sums[..., 1] ** 2 / np.maximum(sums[..., 0], 1e-300)


def grow(codes: np.ndarray, stats: np.ndarray, depth: int, bins: int, score, value, some: int | None = None, rng: np.random.Generator | None = None) -> Tree:
    """One tree over cells with additive ``stats`` [cell, kind]; every node looks at ``some`` random columns (all by default)."""
    size, width = (1 << (depth + 1)) - 1, codes.shape[1]
    tree = Tree(np.full(size, -1, np.int16), np.zeros(size, np.int16), np.zeros((size, stats.shape[1])))
    mine, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
    for level in range(depth + 1):
        ids, local = np.unique(node, return_inverse=True)
        local = local.ravel()
        total = np.stack([np.bincount(local, stats[mine, k], len(ids)) for k in range(stats.shape[1])], -1)
        tree.value[ids] = total
        if level == depth or not len(mine):
            break
        hist = np.stack([
            np.stack([np.bincount(local * bins + codes[mine, f], stats[mine, k], len(ids) * bins).reshape(len(ids), bins) for f in range(width)], 1)
            for k in range(stats.shape[1])
        ], -1)
        left = hist.cumsum(2)[:, :, :-1]
        (n_left, s_left), (n_right, s_right), (n, s) = score(left), score(total[:, None, None] - left), score(total)
        gain = np.where((n_left > 0.5) & (n_right > 0.5), s_left + s_right - s[:, None, None], -np.inf)
        if some is not None and some < width:
            shut = rng.random((len(ids), width)).argsort(1).argsort(1) >= some
            gain[shut] = -np.inf
        flat = gain.reshape(len(ids), -1)
        best = flat.argmax(1)
        splits = flat[np.arange(len(ids)), best] > 1e-12 * n
        tree.feature[ids[splits]], tree.cut[ids[splits]] = best[splits] // (bins - 1), best[splits] % (bins - 1)
        on = splits[local]
        mine, node = mine[on], node[on]
        node = 2 * node + 1 + (codes[mine, tree.feature[node]] > tree.cut[node])
    tree.value = value(tree.value)
    return tree


def _shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(1, keepdims=True), 1e-300)


def _mean(sums: np.ndarray) -> np.ndarray:
    return sums[:, 1] / np.maximum(sums[:, 0], 1e-300)


def forest_votes(codes: np.ndarray, counts: np.ndarray, test: np.ndarray, numbers: range, depth: int, bins: int, seed: int) -> np.ndarray:
    """Summed class shares [test cell, class] of the trees with these numbers."""
    votes = np.zeros((len(test), counts.shape[1]))
    for number in numbers:
        rng = np.random.default_rng([seed, number])
        drawn = rng.poisson(counts).astype(float)
        here = drawn.any(1)
        if here.any():
            votes += grow(codes[here], drawn[here], depth, bins, _gini, _shares, int(np.ceil(np.sqrt(codes.shape[1]))), rng).leaves(test)
    return votes


def boosted_margin(codes: np.ndarray, counts: np.ndarray, test: np.ndarray, label: int, trees: int, depth: int, step: float, bins: int) -> np.ndarray:
    """Margin of ``label`` against all other classes for every test cell."""
    yes, n = counts[:, label], counts.sum(1)
    margin, out = np.zeros(len(codes)), np.zeros(len(test))
    for i in range(trees):
        # sums over the rows of a cell: the label (1 or -1) at first, then the negative gradient of the log loss
        pull = 2 * yes - n if i == 0 else 4 * yes / (1 + np.exp(2 * margin)) - 4 * (n - yes) / (1 + np.exp(-2 * margin))
        tree = grow(codes, np.column_stack([n, pull]), depth, bins, _squares, _mean)
        rate = 1.0 if i == 0 else step
        margin += rate * tree.leaves(codes)
        out += rate * tree.leaves(test)
    return out


def _in_tasks(spark: SparkSession, n: int, work) -> list[np.ndarray]:
    """``work(i)`` for i below n, each in a task of its own, in order."""

    def run(batches):
        for b in batches:
            for i in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([work(i).tobytes()])], ["i", "v"])

    got = spark.range(0, n, 1, n).mapInArrow(run, "i long, v binary").collect()  # n rows of one number per test cell and class
    return [np.frombuffer(r["v"], np.float64) for r in sorted(got, key=lambda r: r["i"])]


def predictions(spark: SparkSession, train: np.ndarray, counts: np.ndarray, test: np.ndarray, seed: int = 42, forest: dict = FOREST, boosted: dict = BOOSTED) -> dict[str, np.ndarray]:
    """Predicted class of every test cell by the forest and by boosting.

    ``counts`` holds the rows of each training cell per class.
    """
    cuts = [cut_points(train[:, j], counts.sum(1)) for j in range(train.shape[1])]
    bins = max([2, *(len(c) + 1 for c in cuts)])
    # cells that fall into the same bins are one
    codes, at = np.unique(binned(train, cuts), axis=0, return_inverse=True)
    merged = np.stack([np.bincount(at.ravel(), counts[:, k], len(codes)) for k in range(counts.shape[1])], 1)
    given = spark.sparkContext.broadcast((codes, merged, binned(test, cuts)))
    classes, trees = counts.shape[1], forest["trees"]
    votes = _in_tasks(spark, TREE_GROUPS, lambda g: forest_votes(*given.value, range(g, trees, TREE_GROUPS), forest["depth"], bins, seed))
    margins = _in_tasks(spark, classes, lambda k: boosted_margin(*given.value, k, boosted["trees"], boosted["depth"], boosted["step"], bins))
    given.unpersist()
    return {"forest": sum(votes).reshape(len(test), classes).argmax(1), "boosted": np.stack(margins, 1).argmax(1)}
