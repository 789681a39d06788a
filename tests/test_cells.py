"""Fits from cells of equal bin numbers and predictions from tables, against fits by rows and walked trees."""

import numpy as np
import pytest
from test_ensembles import X3, frame, toy

from touchline.functions import hashing as H
from touchline.models import attribution as AT, ensembles as EN, trees as TR
from touchline.models.lattice import Lattice


def fits(df):
    return {
        "forest": lambda: TR.random_forest_regressor(df, X3, "y", trees=5, max_depth=4, key="id"),
        "classes": lambda: TR.random_forest_classifier(df, X3, "c", trees=5, max_depth=4, key="id"),
        "huber": lambda: TR.gradient_boosting_regressor(df, X3, "y", rounds=23, rate=0.2, row_share=0.7, key="id"),
        "boosted classes": lambda: TR.gradient_boosting_classifier(df, X3, "c", rounds=4, key="id"),
        "histograms": lambda: TR.histogram_boosting(df, X3, "y", rounds=22, rate=0.2, key="id"),
        "histograms of classes": lambda: TR.histogram_boosting(df, X3, "c", 3, rounds=4, key="id"),
    }


PASSES = {"forest": 1, "classes": 1, "huber": 24, "boosted classes": 1, "histograms": 1, "histograms of classes": 1}


@pytest.mark.parametrize("kind", list(PASSES))
def test_cells_give_the_trees_of_rows_in_fewer_passes(spark, monkeypatch, kind):
    x, y = toy(900, seed=8)
    x = np.floor(x / 2)
    df = frame(spark, x, y=y, c=(y > 1).astype(float) + (y > 3))
    passes, summed = [], EN.summed
    monkeypatch.setattr(EN, "summed", lambda *a: passes.append(1) or summed(*a))
    m = fits(df)[kind]()
    assert len(passes) == PASSES[kind]
    monkeypatch.setattr(EN, "CELLS", 0)
    by_rows = fits(df)[kind]()
    assert len(passes) > 2 * PASSES[kind]
    assert [(n["feature"], n["threshold"], n["cover"]) for n in m.nodes()] == [(n["feature"], n["threshold"], n["cover"]) for n in by_rows.nodes()]
    np.testing.assert_allclose(m.scores(x), by_rows.scores(x), atol=1e-9)


def test_draws_without_divisions(spark):
    key = np.concatenate([np.random.default_rng(1).integers(0, H.PRIME, 5000), [0, 1, H.PRIME - 1]])
    for draw in (1, 200, 65537 * 9, H.PRIME + 4):
        d, u = H.Draws(key, 45), H.uniforms(draw, key, 45)
        assert (d.whole(draw) / float(H.PRIME) == u).all() and (d.poisson(draw) == H.poisson_ones(u)).all() and (d.below(draw, 0.85) == (u < 0.85)).all()


@pytest.mark.parametrize("shared", [1, 60, 1 << 15])
@pytest.mark.parametrize("own", [1, 1 << 16])
def test_tables_equal_walked_trees(spark, monkeypatch, shared, own):
    x, y = toy(300, seed=5)
    df = frame(spark, x, y=y, c=(y > 1).astype(float) + (y > 3))
    x = np.vstack([x, [[np.nan] * 3, [np.inf] * 3, [-np.inf] * 3]])
    for m in (TR.random_forest_classifier(df, X3, "c", trees=6, key="id"), TR.gradient_boosting_classifier(df, X3, "c", rounds=5, key="id"), TR.random_forest_regressor(df, X3, "y", trees=3, key="id")):
        table = Lattice(m.trees, "threshold", m.width, m._fill, shared=shared, own=own)
        np.testing.assert_allclose(table.of(x, m._some), m.scores(x), atol=1e-12)
        assert own == 1 or all(g.table is not None for g in table.groups)
        assert shared < 1 << 15 or own == 1 or len(table.groups) == 1


def test_shapley_tables_equal_leaf_sums(spark, monkeypatch):
    x, y = toy(300, seed=5)
    df = frame(spark, x, y=y, c=(y > 1).astype(float) + (y > 3))
    for m in (TR.random_forest_classifier(df, X3, "c", trees=6, key="id"), TR.random_forest_regressor(df, X3, "y", trees=5, key="id"), TR.gradient_boosting_classifier(df, X3, "c", rounds=5, key="id")):
        want = np.zeros((len(x), 3, m.width))
        for leaf in AT.Shapley(m).leaves:
            for j, f in enumerate(leaf.features):
                want[:, f] += leaf.of_rows(x)[:, j : j + 1] * leaf.value
        rows, of_rows = [], AT.Leaf.of_rows
        with monkeypatch.context() as c:
            c.setattr(AT.Leaf, "of_rows", lambda self, x, of_rows=of_rows, rows=rows: rows.append(len(x)) or of_rows(self, x))
            np.testing.assert_allclose(AT.Shapley(m).contributions(x), want, atol=1e-12)
            assert not rows  # leaves are visited per table, not per row
            c.setattr(AT, "OWN", 0)
            c.setattr(AT, "SHARED", 0)
            np.testing.assert_allclose(AT.Shapley(m).contributions(x), want, atol=1e-12)
            assert rows


def test_hashed_neighbors_write_no_copy_per_bucket(spark, monkeypatch):
    """Vectors travel per block, not per visited bucket, and blocks give what one search gives."""
    from pyspark.sql import functions as F

    from touchline.models import hashed as HN

    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 8))
    x[:400] = x[0]
    pairs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    seen, explode = [], F.explode
    monkeypatch.setattr(HN.F, "explode", lambda c: seen.append(c) or explode(c))
    one = HN.hashed_knn(pairs, pairs, 3, bucket_rows=60).orderBy("id", "rank").toPandas()
    copies = [int(spark.range(1).select(F.size(c)).first()[0]) for c in seen]
    assert len(copies) == 2 and sum(copies) <= HN.TASKS + 2  # 8 tables * 16 probes before
    several = HN.hashed_knn(pairs, pairs, 3, bucket_rows=60, chunk=400).orderBy("id", "rank").toPandas()
    assert one["neighbor"].tolist() == several["neighbor"].tolist()
    assert one[one["id"] == 0]["neighbor"].tolist() == [1, 2, 3] and one[one["id"] == 399]["neighbor"].tolist() == [0, 1, 2]


def test_cuts_of_values_that_hardly_repeat_take_few_passes(spark, monkeypatch):
    from touchline.models import cuts as CU, figs as FG

    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(3000, 16)), rng.integers(0, 10, 3000).astype(float)
    names = [f"x{i}" for i in range(16)]
    passes, one = [], CU.CutSearch._pass
    monkeypatch.setattr(CU.CutSearch, "_pass", lambda *a: passes.append(1) or one(*a))
    first = FG.figs_regressor(frame(spark, x, y=y), names, "y", max_rules=1).history[0]
    assert len(passes) <= 4  # bins of all features were looked into 512 at a time
    gains = []
    for f in range(16):
        order = np.argsort(x[:, f])
        left, n = np.cumsum(y[order])[:-1], np.arange(1, 3000)
        gains.append(left**2 / n + (y.sum() - left) ** 2 / (3000 - n) - y.sum() ** 2 / 3000)
    f, at = np.unravel_index(np.argmax(gains), (16, 2999))
    low, high = np.sort(x[:, f])[[at, at + 1]]
    assert first["feature"] == f"x{f}" and abs(first["threshold"] - (low + high) / 2) < 1e-12 and abs(first["gain"] - np.max(gains)) < 1e-6


def test_kernel_ridge_without_feature_columns(spark, monkeypatch):
    from touchline.models import kernel as KE, linear as LI

    x, y = toy(800, seed=9)
    df = frame(spark, x, y=y)
    f = KE.rbf_features(df, X3, "id", 30, 0.1)
    want = LI.ridge(f.transform(df), f.names, "y", 1.0).transform(f.transform(df)).orderBy("id").toPandas()["prediction"]
    monkeypatch.setattr(KE.RbfFeatures, "transform", None)  # a column per feature is neither built for the fit nor for predictions
    got = KE.rbf_ridge(df, X3, "y", "id", 30, 0.1).transform(df).orderBy("id").toPandas()["prediction"]
    np.testing.assert_allclose(got, want, atol=1e-6)


def test_exact_neighbors_route_queries_once_per_block(spark, monkeypatch):
    from touchline.models import neighbors as NB

    x = np.random.default_rng(6).normal(size=(600, 24))
    pairs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    written, cut = [], NB.cut_lineage
    monkeypatch.setattr(NB, "cut_lineage", lambda df: written.append(cut(df)) or written[-1])
    got = NB.exact_knn(pairs, pairs, 3, pivots=20).orderBy("id", "rank").toPandas()
    assert [w.count() for w in written] == [600, 600]  # a row per visited cell before
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) + np.where(np.eye(600) > 0, np.inf, 0)
    assert got["neighbor"].tolist() == np.argsort(d, axis=1, kind="stable")[:, :3].ravel().tolist()
