"""Every registered query runs and, with an oracle, agrees with it."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# Long fits without an oracle; the same code is compared with plain Python in the tests of the models.
SLOW = {"score_inplay", "score_prematch", "model_sweep", "margin_sweep", "grid_search", "power_centrality", "figs_classify", "figs_wide",
        "histogram_boosting", "histogram_boosting_classifier", "gradient_boosting_classifier", "gradient_boosting_regressor", "rbf_logistic",
        "random_forest_classifier_200", "random_forest_regressor_200", "prematch_whole_fits", "network_history_whole"}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def normal(df):
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, con, name):
    got, want = QUERIES[name](spark, sf).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    a, b = normal(got), normal(want)
    for c in a.columns:
        if str(a[c].dtype).startswith("datetime"):
            a[c], b[c] = a[c].astype("datetime64[us]"), b[c].astype("datetime64[us]")
        else:
            b[c] = b[c].astype(a[c].dtype)
    pd.testing.assert_frame_equal(a, b, check_exact=True)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "diff_event_points_roll5" in df.columns
