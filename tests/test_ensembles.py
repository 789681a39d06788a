"""Forests, boosting and Shapley values against plain Python versions and subset enumeration."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from touchline.functions import hashing as H
from touchline.models import attribution as AT, ensembles as EN, trees as TR

X3 = ["x0", "x1", "x2"]


def frame(spark, x, **cols):
    pdf = pd.DataFrame(x, columns=[f"x{i}" for i in range(x.shape[1])]).assign(**cols)
    pdf["id"] = np.arange(len(pdf))
    return spark.createDataFrame(pdf)


def toy(n=300, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 40, (n, 3)) / 4.0
    y = (x[:, 0] > 5) * 2.0 + (x[:, 1] > 3) * (x[:, 2] > 7) * 3.0 + rng.normal(0, 0.3, n)
    return x, y


def plain_tree(x, rows, depth, gain, value, least, cuts):
    """Nested tuples (feature, threshold, left, right) or a leaf value."""
    if depth == 0:
        return value(rows)
    best = None
    for f, c in cuts:
        left, right = rows[x[rows, f] <= c], rows[x[rows, f] > c]
        if len(left) >= least and len(right) >= least:
            g = gain(left) + gain(right) - gain(rows)
            if g > 1e-12 and (best is None or g > best[0] * (1 + 1e-9)):
                best = (g, f, c, left, right)
    if best is None:
        return value(rows)
    _, f, c, left, right = best
    return f, c, plain_tree(x, left, depth - 1, gain, value, least, cuts), plain_tree(x, right, depth - 1, gain, value, least, cuts)


def plain_predict(tree, x):
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, c, a, b = tree
    return np.where(x[:, f] <= c, plain_predict(a, x), plain_predict(b, x))


def midpoints(x):
    return [(f, (a + b) / 2) for f in range(x.shape[1]) for a, b in itertools.pairwise(np.unique(x[:, f]))]


def plain_boosting(x, y, classes, rounds, rate, depth, loss, newton=False, quantile=0.9):
    cuts, n = midpoints(x), len(y)
    if classes:
        score = np.tile(np.log([np.mean(y == k) for k in range(classes)]), (n, 1))
    else:
        score = np.full((n, 1), np.median(y) if loss == "huber" else np.mean(y))
    reach = np.ptp(y)
    rank = lambda r: (np.minimum(np.abs(r) / reach * 4096, 4095).astype(int))
    bound_of = lambda r: (np.searchsorted(np.cumsum(np.bincount(rank(r), minlength=4096)), quantile * n) + 1) / 4096 * reach
    bound, losses = bound_of(y - score[:, 0]) if loss == "huber" else None, []
    for _ in range(rounds):
        if classes:
            p = np.exp(score) / np.exp(score).sum(axis=1, keepdims=True)
            g, h = (y[:, None] == np.arange(classes)) - p, p * (1 - p)
            losses.append(-np.log(p[np.arange(n), y.astype(int)]).mean())
        else:
            r = y - score[:, 0]
            g, h = (np.clip(r, -bound, bound) if loss == "huber" else r)[:, None], np.ones((n, 1))
            losses.append(np.where(np.abs(r) <= bound, r**2 / 2, bound * (np.abs(r) - bound / 2)).mean() if loss == "huber" else (r**2 / 2).mean())
            bound = bound_of(r) if loss == "huber" else None
        step = np.zeros_like(score)
        for k in range(score.shape[1]):
            gk, hk = g[:, k], h[:, k]
            if newton:
                gain = lambda i, gk=gk, hk=hk: gk[i].sum() ** 2 / (hk[i].sum() + 1)
                value = lambda i, gk=gk, hk=hk: gk[i].sum() / (hk[i].sum() + 1)
            else:
                gain = lambda i, gk=gk: gk[i].sum() ** 2 / len(i)
                value = lambda i, gk=gk, hk=hk: ((classes - 1) / classes if classes else 1) * gk[i].sum() / hk[i].sum()
            step[:, k] = plain_predict(plain_tree(x, np.arange(n), depth, gain, value, 1, cuts), x)
        score = score + rate * step
    return score, losses


@pytest.mark.parametrize(("classes", "loss", "newton"), [(0, "squared", False), (0, "huber", False), (3, None, False), (0, "squared", True)])
def test_boosting_equals_plain_python(spark, classes, loss, newton):
    x, y = toy(250)
    if classes:
        y = (y > 1).astype(float) + (y > 3)
    df, history = frame(spark, x, y=y), []
    m = EN.boosted_trees(df, X3, "y", "id", classes, rounds=23, rate=0.3, max_depth=2, loss=loss, newton=newton, least_curvature=0.0, history=history)
    want, losses = plain_boosting(x, y, classes, 23, 0.3, 2, loss, newton)
    np.testing.assert_allclose(m.scores(x), want, atol=1e-7)
    np.testing.assert_allclose(history, losses, atol=1e-9)
    names = ["p0", "p1", "p2"] if classes else ["prediction"]
    got = m.transform(df, names).orderBy("id").toPandas()[names].to_numpy()
    np.testing.assert_allclose(got, np.exp(want) / np.exp(want).sum(axis=1, keepdims=True) if classes else want, atol=1e-7)


def test_fits_depend_on_rows_alone(spark):
    x, y = toy(400)
    x[:130] = x[0]  # a third of all rows are equal
    df, seen = frame(spark, x, y=y), []
    for parts in (2, 8, 200):
        mixed = df.orderBy(F.rand(parts)).repartition(parts)
        forest = TR.random_forest_regressor(mixed, X3, "y", trees=3, max_depth=3, key="id")
        boosted = TR.histogram_boosting(mixed, X3, "y", rounds=3, key="id")
        seen.append([forest.nodes(), boosted.nodes()])
    assert seen[0] == seen[1] == seen[2]


def test_forest_trees_equal_plain_weighted_trees(spark):
    x, y = toy(300)
    key = np.arange(300)
    df = frame(spark, x, y=y, c=(y > 1).astype(float) + (y > 3))
    m = TR.random_forest_regressor(df, X3, "y", trees=4, max_depth=3, key="id")
    for t, tree in enumerate(m.trees):
        w = EN.poisson_ones(EN.uniforms(t + 1, key, 42))
        rows = np.repeat(key, w)
        want = plain_tree(x, rows, 3, lambda i: y[i].sum() ** 2 / len(i), lambda i: y[i].mean(), 3, midpoints(x))
        np.testing.assert_allclose(np.array(tree.value)[tree.leaves_of(x), 0], plain_predict(want, x), atol=1e-9)
        assert tree.cover[0] == len(rows)
    several, EN.LEVEL_NUMBERS = EN.LEVEL_NUMBERS, 1  # one tree at a time
    try:
        assert TR.random_forest_regressor(df, X3, "y", trees=4, max_depth=3, key="id").nodes() == m.nodes()
    finally:
        EN.LEVEL_NUMBERS = several
    c = TR.random_forest_classifier(df, X3, "c", trees=30, max_depth=4, key="id")
    p = c.transform(df, ["a", "b", "d"]).orderBy("id").toPandas()
    np.testing.assert_allclose(p[["a", "b", "d"]].sum(axis=1), 1.0)
    assert (p[["a", "b", "d"]].to_numpy().argmax(axis=1) == p["c"]).mean() > 0.9


def test_array_draws_are_the_column_draws(spark):
    df = spark.range(2000).select("id", H.uniform_hash(F.lit(5), F.col("id"), 42).alias("u"))
    rows = df.select("id", "u", H.poisson_one(F.col("u")).alias("w")).orderBy("id").toPandas()
    np.testing.assert_allclose(EN.uniforms(5, rows["id"].to_numpy(), 42), rows["u"], atol=0)
    assert (EN.poisson_ones(rows["u"].to_numpy()) == rows["w"]).all()


def test_missing_values_wide_features_and_saving(spark, tmp_path):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 3))  # more values than bins
    y = (x[:, 0] > 0.2) * 3.0 + x[:, 1]
    df = frame(spark, x, y=y).withColumn("x2", F.when(F.col("id") % 3 != 0, F.col("x2"))).withColumn("x1", F.when(F.col("id") % 7 == 0, float("nan")).otherwise(F.col("x1")))
    m = TR.gradient_boosting_regressor(df, X3, "y", rounds=30, rate=0.2, bins=64, key="id")
    got = m.transform(df).orderBy("id").toPandas()["prediction"]
    assert not got.isna().any() and ((got - y) ** 2).mean() < 0.3 * y.var() and set(m.medians) == {"x1", "x2"}
    m.save(spark, str(tmp_path / "model"))
    again = EN.TreeEnsemble.load(spark, str(tmp_path / "model"))
    assert again.nodes() == m.nodes()
    np.testing.assert_array_equal(again.transform(df).orderBy("id").toPandas()["prediction"], got)
    one = TR.random_forest_regressor(df.where("id = 1"), X3, "y", trees=2, key="id")
    assert one.transform(df).count() == 1500 and TR.random_forest_regressor(df.limit(0), X3, "y", trees=2, key="id").transform(df.limit(0)).count() == 0


def expected(tree, row, known, node=0):
    """Expected output of a row if only the features of ``known`` are known."""
    f = tree.feature[node]
    if f < 0:
        return np.array(tree.value[node])
    if f in known:
        return expected(tree, row, known, tree.left[node] if row[f] <= tree.threshold[node] else tree.right[node])
    a, b = tree.left[node], tree.right[node]
    return (tree.cover[a] * expected(tree, row, known, a) + tree.cover[b] * expected(tree, row, known, b)) / tree.cover[node]


@pytest.mark.parametrize("kind", ["forest", "classes", "boosted"])
def test_shapley_values_equal_subset_enumeration(spark, kind):
    x, y = toy(200, seed=6)
    df = frame(spark, x, y=y, c=(y > 1).astype(float) + (y > 3))
    if kind == "forest":
        m = TR.random_forest_regressor(df, X3, "y", trees=3, max_depth=5, key="id")
    elif kind == "classes":
        m = TR.random_forest_classifier(df, X3, "c", trees=3, max_depth=4, key="id")
    else:
        m = TR.gradient_boosting_classifier(df, X3, "c", 3, rounds=3, max_depth=3, rate=0.5, key="id")
    attr = AT.tree_attribution(df.where("id < 12"), m, "id").toPandas()
    for i in range(12):
        want = np.zeros((3, m.width))
        for tree, group in zip(m.trees, m.groups, strict=True):
            for f in range(3):
                others = [j for j in range(3) if j != f]
                for size in range(3):
                    for s in itertools.combinations(others, size):
                        change = expected(tree, x[i], {*s, f}) - expected(tree, x[i], set(s))
                        weight = math.factorial(size) * math.factorial(2 - size) / math.factorial(3) * m.rate
                        want[f] += weight * (change if group < 0 else np.eye(m.width)[group] * change[0])
        own = attr[attr["row_key"] == i].sort_values(["feature", "output"])
        np.testing.assert_allclose(own["contribution"].to_numpy().reshape(3, m.width), want, atol=1e-9)
        np.testing.assert_allclose(own.groupby("output")["contribution"].sum() + own.groupby("output")["base"].first(), m.scores(x[i : i + 1])[0], atol=1e-9)
    few, AT.TABLE_FEATURES = AT.TABLE_FEATURES, 0  # only the patterns that occur
    try:
        again = AT.tree_attribution(df.where("id < 12"), m, "id").toPandas()
    finally:
        AT.TABLE_FEATURES = few
    np.testing.assert_allclose(again["contribution"], attr["contribution"], atol=1e-12)
    top = AT.local_attribution(AT.tree_attribution(df.where("id < 12"), m, "id"), 2).toPandas()
    sizes = attr.assign(size=attr["contribution"].abs()).groupby(["row_key", "output"])["size"].sum()
    assert len(top) == 24 and all(sizes[r.row_key].idxmax() == r.output for r in top.itertuples())
