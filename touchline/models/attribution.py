"""Shapley values of tree ensembles, from the paths and covers of their trees.

The value of a set S of features is the expected output when splits on features
of S follow the row and all others go both ways in proportion to the cover of
the children. For a leaf with value v whose path splits on m features, feature i
is worth ``v * (o_i - z_i) * sum_s s! (m - 1 - s)! / m! * c_s`` with z the share
of cover that a feature's splits let through, o whether the row passes them,
and c_s the coefficients of the product of (z_j + o_j t) over the other
features of the path. That is polynomial in the depth; there are no samples and no subsets.
Values of a row add up to its score minus the base, per output. They are the same
for all rows between the same cuts, so neighboring trees of few features share a
table of values (see ``lattice``); leaves of other trees are visited per row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.ordered import top_per_group
from .ensembles import Tree, TreeEnsemble, matrix
from .lattice import OWN, SHARED, Group, Lattice

TABLE_FEATURES = 10  # of a path up to which all patterns of passed splits are tabulated


class Leaf:
    """A leaf's path: features with the interval that passes and the share of cover."""

    def __init__(self, features: list[int], low: list[float], high: list[float], share: list[float], value: np.ndarray) -> None:
        self.features, self.low, self.high, self.share, self.value = features, low, high, np.array(share), value
        m = len(features)
        self.table = self.credits((np.arange(1 << m)[:, None] >> np.arange(m)) & 1) if m <= TABLE_FEATURES else None

    def credits(self, passed: np.ndarray) -> np.ndarray:
        """Shapley values of the path's features per unit of leaf value, for rows of 0 and 1."""
        m = len(self.features)
        weight = np.array([factorial(s) * factorial(m - 1 - s) / factorial(m) for s in range(m)])
        out = np.zeros(passed.shape)
        for i in range(m):
            poly = np.ones((len(passed), 1))
            for j in range(m):
                if j != i:
                    longer = np.zeros((len(passed), poly.shape[1] + 1))
                    longer[:, :-1] = poly * self.share[j]
                    longer[:, 1:] += poly * passed[:, j : j + 1]
                    poly = longer
            out[:, i] = (passed[:, i] - self.share[i]) * (poly @ weight)
        return out

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        pattern = np.zeros(len(x), np.int64)
        for bit, (f, low, high) in enumerate(zip(self.features, self.low, self.high, strict=True)):
            pattern |= ((x[:, f] > low) & (x[:, f] <= high)).astype(np.int64) << bit
        return self.of_patterns(pattern)

    def patterns(self, group: Group) -> np.ndarray:
        """Which splits every row of a table passes, in the shape of its axes."""
        pattern = np.zeros((1,) * len(group.shape), np.int64)
        for bit, (f, low, high) in enumerate(zip(self.features, self.low, self.high, strict=True)):
            i = group.features.index(f)
            at = np.arange(group.shape[i])
            first = 0 if low == -np.inf else np.searchsorted(group.cuts[i], low, "left") + 1
            last = len(at) if high == np.inf else np.searchsorted(group.cuts[i], high, "left") + 1
            passed = ((at >= first) & (at < last)).astype(np.int64) << bit
            pattern = pattern | passed.reshape([-1 if j == i else 1 for j in range(len(group.shape))])
        return pattern

    def of_patterns(self, pattern: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[pattern]
        seen, at = np.unique(pattern, return_inverse=True)
        return self.credits((seen[:, None] >> np.arange(len(self.features))) & 1)[at.reshape(pattern.shape)]

    @property
    def expected(self) -> np.ndarray:
        return self.value * self.share.prod()


def leaves_of(tree: Tree) -> list[Leaf]:
    out = []

    def walk(node: int, path: dict[int, tuple[float, float, float]]) -> None:
        f = tree.feature[node]
        if f < 0:
            cells = list(path.values())
            out.append(Leaf(list(path), [c[0] for c in cells], [c[1] for c in cells], [c[2] for c in cells], np.array(tree.value[node])))
            return
        low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
        cut, total = tree.threshold[node], tree.cover[node] or 1.0
        for child, bounds in ((tree.left[node], (low, min(high, cut))), (tree.right[node], (max(low, cut), high))):
            walk(child, path | {f: (*bounds, share * tree.cover[child] / total)})

    walk(0, {})
    return out


class Shapley:
    def __init__(self, model: TreeEnsemble) -> None:
        self.columns, self.width = model.columns, model.width
        self.leaves, base = [], np.array(model.base)
        self.trees: list[list[Leaf]] = []
        for tree, group in zip(model.trees, model.groups, strict=True):
            self.trees.append([])
            for leaf in leaves_of(tree):
                value = leaf.value * model.rate if group < 0 else np.eye(self.width)[group] * leaf.value[0] * model.rate
                leaf.value = value
                base = base + leaf.expected
                if leaf.features and value.any():
                    self.leaves.append(leaf)
                    self.trees[-1].append(leaf)
        self.base = base
        self.lattice = Lattice(model.trees, "threshold", len(self.columns) * self.width, self._fill, shared=SHARED, own=OWN) if model.trees else None

    def _fill(self, table: np.ndarray, group: Group, t: int) -> None:
        table = table.reshape(*group.shape, len(self.columns), self.width)
        for leaf in self.trees[t]:
            credits = leaf.of_patterns(leaf.patterns(group))
            live = np.flatnonzero(leaf.value)
            for j, f in enumerate(leaf.features):
                for k in live:
                    table[..., f, k] += credits[..., j] * leaf.value[k]

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """(row, feature, output)."""
        if not self.lattice:
            return np.zeros((len(x), x.shape[1], self.width))
        return self.lattice.of(x, self._walked).reshape(len(x), x.shape[1], self.width)

    def _walked(self, x: np.ndarray, first: int, last: int) -> np.ndarray:
        out = np.zeros((len(x), x.shape[1], self.width))
        for leaf in (leaf for tree in self.trees[first:last] for leaf in tree):
            credits = leaf.of_rows(x)
            live = np.flatnonzero(leaf.value)
            for j, f in enumerate(leaf.features):
                for k in live:
                    out[:, f, k] += credits[:, j] * leaf.value[k]
        return out.reshape(len(x), -1)


def tree_attribution(df: DataFrame, model: TreeEnsemble, key: str) -> DataFrame:
    """Rows ``(key, output, feature, feature_value, contribution, base)``; one narrow pass.

    Boosted classes are explained on the scale of their scores.
    """
    shares = Shapley(model)
    columns, medians = model.columns, [model.medians.get(c, np.nan) for c in model.columns]
    d, k = len(columns), model.width
    step = max(256, min(8192, (1 << 22) // (d * k)))  # rows at a time

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), step):
                b = whole.slice(at, step)
                x, n = matrix(b, range(1, d + 1), medians), len(b)
                c = shares.contributions(x)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(pa.array(np.repeat(np.arange(n), d * k))), pa.array(np.tile(np.arange(k), n * d)), pa.array(columns).take(pa.array(np.tile(np.repeat(np.arange(d), k), n))),
                    pa.array(np.repeat(x.reshape(-1), k)), pa.array(c.reshape(-1)), pa.array(np.tile(shares.base, n * d)),
                ], names=["row_key", "output", "feature", "feature_value", "contribution", "base"])

    src = df.select(F.col(key).cast("long").alias("row_key"), *[F.col(c).cast("double").alias(c) for c in columns])
    return src.mapInArrow(walk, "row_key long, output long, feature string, feature_value double, contribution double, base double")


def global_attribution(attr: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean absolute value of each feature over rows and outputs."""
    return attr.groupBy(*keys, "feature").agg(F.avg(F.abs("contribution")).alias("mean_abs_contribution"))


def local_attribution(attr: DataFrame, k: int = 30) -> DataFrame:
    """The k largest contributions of each row, for the output with the largest sum of sizes (ties: the first)."""
    sums = attr.groupBy("row_key", "output").agg(F.sum(F.abs("contribution")).alias("_size"))
    chosen = sums.groupBy("row_key").agg(F.min_by("output", F.struct((-F.col("_size")).alias("less"), F.col("output"))).alias("output"))
    return top_per_group(attr.join(chosen, ["row_key", "output"]), ["row_key"], [F.abs("contribution").desc(), F.col("feature")], k)


def top_feature_timeline(attr: DataFrame, minute: str) -> DataFrame:
    """Feature with the largest mean absolute contribution per minute."""
    per = global_attribution(attr, [minute])
    return per.groupBy(minute).agg(
        F.max_by("feature", F.struct("mean_abs_contribution", "feature")).alias("top_feature"),
        F.max("mean_abs_contribution").alias("mean_abs_contribution"))
