"""Merges of partial states: pooled blocks, weighted sums per draw, digests of rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from touchline.functions import hashing as H
from touchline.models import calibrate as CA, isotonic as IS
from touchline.operators import bootstrap as B
from touchline.sources import tables as TB


def plain_pooling(y, w):
    blocks = []
    for value, weight in zip(y, w, strict=True):
        blocks.append([value * weight, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, v, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + v, blocks[-1][2] + n]
    return np.concatenate([[s / v] * n for s, v, n in blocks])


@pytest.mark.parametrize("shape", ["labels", "rising", "falling", "waves"])
@pytest.mark.parametrize("range_rows", [60, 10**6])
def test_pooling_in_ranges_equals_pooling_at_once(spark, shape, range_rows):
    rng = np.random.default_rng(3)
    x = np.sort(rng.uniform(size=900))
    y = {"labels": (rng.uniform(size=900) < x).astype(float), "rising": np.arange(900.0), "falling": -np.arange(900.0), "waves": np.sin(x * 40) + x}[shape]
    w = rng.integers(1, 4, 900).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "w": w})).repartition(5)
    knots = IS.fit(df, "x", "y", "w", range_rows)
    np.testing.assert_allclose(np.interp(x, knots.x, knots.y), plain_pooling(y, w), atol=1e-9)


def test_isotonic_odd_rows(spark):
    df = spark.createDataFrame([(None, 1.0, 1.0), (0.5, None, 1.0), (0.2, 1.0, 0.0), (0.3, 1.0, 1.0), (0.3, 0.0, 1.0), (0.6, 0.25, 1.0)], "x double, y double, w double")
    knots = IS.fit(df, "x", "y", "w")
    assert knots.x.tolist() == [0.3, 0.6] and knots.y.tolist() == pytest.approx([1.25 / 3] * 2)
    got = [r.z for r in knots.transform(spark.createDataFrame([(None,), (-5.0,), (9.0,)], "x double"), "x", "z").collect()]
    assert got == [None, pytest.approx(1.25 / 3), pytest.approx(1.25 / 3)]
    assert IS.fit(df.limit(0), "x", "y", "w").y.tolist() == [0.0]


def test_rows_without_a_minute_keep_their_probabilities(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([2, 2, 2], 240)
    pdf = pd.DataFrame(p, columns=list(CA.P)).assign(actual=rng.choice(["A", "D", "H"], 240), snapshot_minute=[None if i % 8 == 0 else float(i % 91) for i in range(240)], id=range(240))
    df = spark.createDataFrame(pdf).withColumn("snapshot_minute", F.col("snapshot_minute").cast("int"))
    df = df.withColumn("snapshot_minute", F.when(F.col("id") % 8 != 0, F.col("snapshot_minute")))
    names = ["c_A", "c_D", "c_H"]
    out = CA.phase_calibrate(df, method="isotonic").transform(df, names=names).orderBy("id").toPandas()
    assert len(out) == 240
    np.testing.assert_allclose(out[names].sum(axis=1), 1.0)
    np.testing.assert_allclose(out[names].to_numpy()[::8], p[::8], atol=1e-9)
    assert np.abs(out[names].to_numpy() - p).max() > 0.05


def test_draw_vectors_equal_rows_by_draws(spark, monkeypatch):
    rows = [(i, ["a", "b", None][i % 3], float(i % 7) if i % 5 else None) for i in range(500)] + [(900, "few", 2.0)]
    df = spark.createDataFrame(rows, "id long, g string, v double").repartition(6)
    base = df.where("v IS NOT NULL").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(40)))).withColumn("w", H.poisson_one(H.uniform_hash(F.col("draw"), F.col("id"))))
    want = base.groupBy("g", "draw").agg(F.try_divide(F.sum(F.col("w") * F.col("v")), F.sum("w").cast("double")).alias("statistic"))
    key = lambda r: (str(r.g), r.draw)
    want = {key(r): r.statistic for r in want.collect()}
    monkeypatch.setattr(B, "VECTOR_BYTES", 1)  # hand on after every batch
    narrow = df.where("v IS NOT NULL").withColumn("_v", F.col("v")).withColumn("_one", F.lit(1.0))
    got = {key(r): r.statistic for r in B._draw_means(narrow, ["g"], "id", "_v", "_one", 40).collect()}
    assert got.keys() == want.keys() and any(x is None for x in want.values())
    assert all(got[k] == pytest.approx(want[k]) if want[k] is not None else got[k] is None for k in want)
    one = B.bootstrap_ci(df, "v", "id", draws=50).first()
    assert one.draws == 50 and one.ci_lower < one.mean < one.ci_upper


def test_digests_see_repeats_and_nulls(spark):
    def digest(rows):
        df = spark.createDataFrame(rows, "a int, b string, c array<float>, d double")
        return [tuple(r)[1:] for r in TB.table_manifest({"t": df}).collect()][0]

    one, two = (1, "x", [1.0, None], 0.5), (2, None, None, None)
    assert digest([one, two]) == digest([two, one]) and digest([one, two])[:2] == (2, 4)
    different = [[one], [one, one], [one, one, one], [two], [two, two], [(2, "", None, None)], [(2, "n", None, None)], [(2, None, [], None)], [(None, "2", None, None)], [one, two], []]
    assert len({digest(rows) for rows in different}) == len(different)
