"""Blocked execution must equal plain windows, also when one group is hot."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from touchline.operators import history as H, ordered as O, possession as PO, events as E
from touchline.sources import adapters as A


@pytest.fixture(scope="module")
def skewed(spark):
    """One entity owns most rows; some values are missing; order values repeat."""
    k = F.col("id")
    return spark.range(600).select(
        F.when(k % 10 < 7, 0).otherwise(k % 10).alias("team"), (k * 37 % 211).alias("clean_date"), k.alias("match_id"),
        F.when(k % 13 != 0, (k * 7 % 23).cast("double")).alias("a"), (k * 11 % 17).cast("double").alias("b"), (k % 2).alias("is_home"),
    ).cache()


def frame(df, by):
    out = df.toPandas().sort_values(by).reset_index(drop=True)
    return out[sorted(out.columns)]


@pytest.mark.parametrize("limit", [5, 40, 150])
def test_blocked_equals_plain(spark, skewed, limit):
    def run(max_rows):
        seq = O.sequence(skewed, ["team"], ["clean_date", "match_id"], max_rows=max_rows)
        seq = seq.trailing_means(["a", "b"], [3, 5, 10]).row_number("rn").running_sum("b", "total")
        return seq.neighbor({"prev": F.col("a")}, -1).neighbor({"next": F.col("clean_date")}, +1)

    plain, blocked = run(10_000), run(limit)
    assert not plain.blocked and blocked.blocked
    pd.testing.assert_frame_equal(frame(plain.result(), "match_id"), frame(blocked.result(), "match_id"), check_dtype=False)


def test_trailing_means_equal_pandas(spark, skewed):
    seq = O.sequence(skewed, ["team"], ["clean_date", "match_id"], max_rows=50).trailing_means(["a"], [3])
    got = frame(seq.result(), "match_id")
    pdf = skewed.toPandas().sort_values(["team", "clean_date", "match_id"])
    lag = pdf.groupby("team")["a"].shift(1)
    pdf["r3"] = lag.groupby(pdf["team"]).rolling(3, min_periods=1).mean().reset_index(level=0, drop=True)
    pdf["ex"] = lag.groupby(pdf["team"]).expanding(1).mean().reset_index(level=0, drop=True)
    pdf = pdf.sort_values("match_id").reset_index(drop=True)
    np.testing.assert_allclose(got["a_roll3"], pdf["r3"])
    np.testing.assert_allclose(got["a_expanding"], pdf["ex"])


def test_entity_history_blocked(spark, sf):
    rows = E.team_long(A.matches(spark, sf))
    plain, cols = H.entity_history(rows, ["goals_for", "points"], "event_")
    hot, _ = H.entity_history(rows, ["goals_for", "points"], "event_", max_rows=30)
    a, b = (frame(x.select("match_id", "team", *cols), ["match_id", "team"]) for x in (plain, hot))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_possessions_blocked(spark, sf):
    ev = E.add_zones(A.events(spark, sf))
    plain = PO.transitions_from_events(ev)
    hot = PO.transitions_from_events(E.add_zones(A.events(spark, sf, max_rows=20)), max_rows=4)
    key = ["match_id", "period", "possession"]
    pd.testing.assert_frame_equal(frame(plain, key), frame(hot, key))
    assert plain.count() == 160


def test_rank_and_quantiles(spark, skewed):
    ranked = O.rank_min(skewed.select("match_id", "b"), [], "b", "rank", max_rows=3).toPandas()
    want = ranked["b"].rank(method="min", ascending=False)
    np.testing.assert_array_equal(ranked["rank"], want)
    v = skewed.select("a").toPandas()["a"].dropna()
    for q in (0.0, 0.1, 0.5, 0.9, 1.0):
        got = O.exact_quantiles(skewed, ["a"], q, limit=10)["a"]
        assert got == pytest.approx(np.quantile(v, q))


def test_quantiles_of_continuous_data(spark):
    df = spark.range(20_000).select((F.xxhash64("id") / 1e12).alias("x"))
    v = df.toPandas()["x"]
    for q in (0.001, 0.5, 0.77):
        assert O.exact_quantiles(df, ["x"], q, limit=300)["x"] == pytest.approx(np.quantile(v, q))


def test_strict_history_rejects_same_time(spark):
    rows = spark.createDataFrame([(1, "a", 5, 1.0), (2, "a", 5, 2.0)], "match_id long, team string, clean_date long, x double")
    df, _ = H.entity_history(rows.withColumn("clean_date", F.timestamp_seconds("clean_date")), ["x"], "h_")
    with pytest.raises(Exception, match="strictly earlier"):
        df.collect()
