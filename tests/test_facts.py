"""Hand-computed facts of zones, networks, snapshots, scores and calibration."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from touchline.functions import columns as C
from touchline.models import calibrate as CA
from touchline.operators import events as E, network as N, possession as PO, quality as Q, relate as R, scoring as SC, snapshots as SN
from touchline.sources import documents as D, tables as TB


def test_zone_points(spark):
    pts = spark.createDataFrame([(0.0, 0.0), (29.999, 15.999), (30.0, 16.0), (120.0, 80.0)], "x double, y double")
    assert [r[0] for r in pts.select(C.zone_id("x", "y")).collect()] == [0, 0, 5, 19]
    out = spark.createDataFrame([(121.0, 5.0), (None, 3.0)], "x double, y double")
    assert [r[0] for r in out.select(C.zone_id("x", "y", strict=False)).collect()] == [None, None]
    with pytest.raises(Exception, match="outside the pitch"):
        out.select(C.zone_id("x", "y")).collect()


EVENT = ("match_id long, id string, idx long, period int, type string, team string, possession long, possession_team string, "
         "pass_outcome string, location_x double, location_y double, pass_end_x double, pass_end_y double, home_team string, away_team string")


def two_events(spark):
    rows = [(1, "h1", 1, 1, "Pass", "Home", 1, "Home", None, 1.0, 1.0, 31.0, 1.0, "Home", "Away"),
            (1, "a1", 2, 1, "Ball Recovery", "Away", 2, "Away", None, 61.0, 1.0, None, None, "Home", "Away")]
    return E.add_zones(spark.createDataFrame(rows, EVENT))


def test_supra_edges_and_direction(spark):
    ev = two_events(spark)
    tr = PO.transitions_from_events(ev)
    edges = {(r.src, r.dst): r.weight for r in N.supra_edges(ev, tr).collect()}
    assert edges == {(0, 1): 1, (0, 22): 1}
    matrix = N.edges_to_matrix(N.supra_edges(ev, tr)).first()["matrix"]
    assert len(matrix) == 40 and matrix[0][22] == 1.0 and sum(map(sum, matrix)) == 2.0


def test_late_tagged_event_is_left_out(spark):
    rows = [(1, "a", 1, 1, "Pass", "Home", 1, "Home", None, 1.0, 1.0, None, None, "Home", "Away"),
            (1, "b", 2, 1, "Pass", "Away", 2, "Away", None, 61.0, 1.0, None, None, "Home", "Away"),
            (1, "c", 3, 1, "Pass", "Home", 1, "Home", None, 119.0, 79.0, None, None, "Home", "Away")]
    ev = E.add_zones(spark.createDataFrame(rows, EVENT))
    first = PO.possession_summary(ev).where("possession = 1").first()
    assert (first.events, first.late_events, first.last_zone) == (1, 1, 0)


def test_right_eigenvector():
    a = np.array([[1.0, 2.0], [1.0, 0.0]])
    periodic = np.array([[0.0, 3.0], [3.0, 0.0]])
    chain = np.array([[0.0, 2.0], [0.0, 0.0]])  # all eigenvalues are 0
    v, value, residual = N.perron_vectors(np.stack([a, periodic, np.zeros((2, 2)), chain]))
    assert np.allclose(v.sum(axis=1), 1) and (residual < 1e-10).all() and (v >= 0).all()
    assert np.allclose(value, [2.0, 3.0, 0.0, 0.0], atol=1e-9)
    assert np.allclose(v[1:3], 0.5) and np.allclose(v[3], [1.0, 0.0])


def test_stacked_vectors_agree_with_eig():
    rng = np.random.default_rng(12)
    stack = rng.integers(0, 4, (30, 40, 40)) * (rng.random((30, 40, 40)) < 0.3).astype(float)
    v, value, residual = N.perron_vectors(stack)
    largest = [np.abs(np.linalg.eigvals(a)).max() for a in stack]
    assert np.allclose(value, largest, rtol=1e-10) and (residual < 1e-10).all() and (v >= 0).all()


def test_zone_ratios(spark):
    edges = spark.createDataFrame([(1, 0, 1, 2), (1, 1, 23, 1), (1, 24, 1, 1)], "match_id long, src int, dst int, weight long")
    z = N.zone_metrics(edges).where("layer = 'home' and zone = 1").first()
    assert z.leakage == pytest.approx(1 / 3) and z.recovery == pytest.approx(1 / 3) and z.switching_zone_ratio == pytest.approx(1.0)
    assert N.zone_metrics(edges).count() == 40


def test_power_iteration_agrees_with_dense(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 3, (40, 40))
    rows = [(1, int(i), int(j), int(a[i, j])) for i in range(40) for j in range(40) if a[i, j]]
    edges = spark.createDataFrame(rows, "match_id long, src int, dst int, weight long")
    got = N.power_centrality(edges, tolerance=1e-8).orderBy("node").toPandas()
    (want,), (value,), _ = N.perron_vectors(a[None].astype(float))
    np.testing.assert_allclose(got["centrality"], want, atol=1e-7)
    assert got["eigenvalue"].iloc[0] == pytest.approx(value, rel=1e-6) and got["residual"].iloc[0] < 1e-4


def test_snapshot_boundary(spark):
    rows = [(1, s, 1, i, "Pass", t, "Home", "Away") for i, (s, t) in enumerate([(1799.999, "Home"), (1800.0, "Home"), (1800.001, None)])]
    ev = spark.createDataFrame(rows, "match_id long, t double, period int, idx long, type string, team string, home_team string, away_team string").withColumns({
        "pass_outcome": F.lit(None).cast("string"), "shot_outcome": F.lit(None).cast("string"), "shot_xg": F.lit(None).cast("double"),
        "location_x": F.lit(70.0), "pass_end_x": F.lit(90.0)})
    snap = {r.snapshot_minute: r for r in SN.build_snapshots(ev).collect()}
    assert len(snap) == 19
    assert snap[30].home_cum_passes == 2 and snap[30].feature_source_max_seconds == 1800.0 and snap[30].home_in_possession == 1.0
    assert snap[30].home_cum_final_third_entries == 2 and snap[25].feature_source_max_seconds is None
    # The event without team is the last one: nobody is in possession.
    assert snap[35].home_in_possession == 0.0 and snap[35].home_recent5_passes == 0 and snap[35].home_recent10_passes == 2


def test_cards_own_goals_and_duels(spark):
    cols = ("match_id long, team string, possession long, type string, foul_committed_card string, bad_behaviour_card string, "
            "duel_outcome string, ball_recovery_recovery_failure boolean, pass_outcome string, shot_outcome string, shot_xg double, location_x double, pass_end_x double")
    rows = [(1, "A", 1, "Foul Committed", "Second Yellow", None, None, None, None, None, None, 1.0, None),
            (1, "A", 1, "Bad Behaviour", None, "Yellow Card", None, None, None, None, None, 1.0, None),
            (1, "A", 2, "Duel", None, None, "Success In Play", None, None, None, None, 1.0, None),
            (1, "A", 2, "Ball Recovery", None, None, None, True, None, None, None, 1.0, None),
            (1, "A", 3, "Ball Recovery", None, None, None, None, None, None, float("nan"), 1.0, None)]
    s = E.team_match_stats(spark.createDataFrame(rows, cols)).first()
    assert (s.yellow_cards, s.red_cards, s.fouls, s.duels_won, s.recoveries, s.possessions, s.xg) == (2, 1, 1, 1, 1, 3, 0.0)
    own = spark.createDataFrame([(1, 10.0, 1, 1, "Own Goal Against", "A", "A", "B")], "match_id long, t double, period int, idx long, type string, team string, home_team string, away_team string")
    own = own.withColumns({k: F.lit(None).cast("string") for k in ("pass_outcome", "shot_outcome")}).withColumns({k: F.lit(None).cast("double") for k in ("shot_xg", "location_x", "pass_end_x")})
    last = SN.build_snapshots(own).where("snapshot_minute = 90").first()
    assert (last.home_score, last.away_score) == (0.0, 1.0)


def test_scores(spark):
    rows = [("A", 1.0, 0.0, 0.0), ("D", 0.0, 1.0, 0.0), ("H", 0.0, 0.0, 1.0)]
    perfect = SC.metrics_by(SC.with_losses(spark.createDataFrame(rows, "actual string, p_A double, p_D double, p_H double"))).first()
    assert perfect.rps == 0 and perfect.brier == 0 and perfect.ece == 0 and perfect.accuracy == 1
    worst = SC.with_losses(spark.createDataFrame([("A", 0.0, 0.0, 1.0)], "actual string, p_A double, p_D double, p_H double")).first()
    assert worst.rps == 1.0
    scaled = SC.with_losses(spark.createDataFrame([("A", 2.0, 0.0, 0.0)], "actual string, p_A double, p_D double, p_H double")).first()
    assert scaled.rps == 0.0
    with pytest.raises(Exception, match="probabilities"):
        SC.with_losses(spark.createDataFrame([("A", -0.5, 0.5, 1.0)], "actual string, p_A double, p_D double, p_H double")).collect()
    with pytest.raises(Exception, match="unknown outcome"):
        SC.with_losses(spark.createDataFrame([("X", 0.5, 0.5, 1.0)], "actual string, p_A double, p_D double, p_H double")).collect()


def test_reliability_keeps_empty_bins(spark):
    t = SC.reliability_table(SC.with_losses(spark.createDataFrame([("A", 0.7, 0.2, 0.1)], "actual string, p_A double, p_D double, p_H double")))
    assert t.count() == 40 and t.where("count > 0").count() == 4


@pytest.fixture(scope="module")
def calibration_rows(spark):
    rng = np.random.default_rng(2)
    p, y = rng.dirichlet([2, 2, 2], size=300), rng.integers(0, 3, size=300)
    rows = [(i, *map(float, p[i]), "ADH"[y[i]], int(i % 19) * 5) for i in range(300)]
    return spark.createDataFrame(rows, "id long, p_A double, p_D double, p_H double, actual string, snapshot_minute int")


@pytest.mark.parametrize("method", ["platt", "isotonic"])
def test_calibrated_rows_sum_to_one(calibration_rows, method):
    fit = CA.platt_calibrate if method == "platt" else CA.isotonic_calibrate
    out = fit(calibration_rows).transform(calibration_rows).toPandas()
    p = out[["p_A", "p_D", "p_H"]].to_numpy()
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all()
    out = CA.phase_calibrate(calibration_rows, method=method).transform(calibration_rows).toPandas()
    assert len(out) == 300 and np.allclose(out[["p_A", "p_D", "p_H"]].sum(axis=1), 1)


def test_quality_and_joins(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k long, v string")
    row = Q.check_unique(df, ["k"]).first()
    assert (row.duplicate_keys, row.null_key_rows, row.passed) == (1, 1, False)
    with pytest.raises(Q.QualityError):
        R.checked_join(df, df, ["k"])
    with pytest.raises(Q.QualityError, match="Nowhere"):
        R.alias_lookup(spark.createDataFrame([("Nowhere",)], "home_team string"), R.alias_table(spark), {"home_team": "x"})
    assert R.alias_table(spark).count() == 24
    with pytest.raises(Exception, match="without role"):
        spark.range(1).select(C.split_role(F.lit("2015/2016"), F.lit(None).cast("date"))).collect()
    with pytest.raises(ValueError):
        R.match_catalogue(df, date_from="2020-02-01", date_to="2020-01-01")
    m = spark.createDataFrame([(1, "a")], "match_id long, key string")
    with pytest.raises(Q.QualityError, match="fixture without odds"):
        R.join_odds(m, spark.createDataFrame([("b", 2.0)], "key string, b365h double"), ["key"], ["b365h"])


def test_clip_keeps_null(spark):
    assert spark.range(1).select(C.clip(F.lit(None).cast("int"), -5, 5)).first()[0] is None


def test_event_and_lineup_documents(spark, tmp_path):
    docs = [{"id": "e1", "index": 1, "period": 1, "timestamp": "00:00:01.250", "minute": 0, "second": 1, "type": {"id": 30, "name": "Pass"},
             "team": {"id": 7, "name": "Home"}, "possession": 1, "possession_team": {"id": 7, "name": "Home"}, "location": [10, 20.5],
             "pass": {"end_location": [30.0, 40.0], "outcome": {"id": 9, "name": "Incomplete"}}},
            {"id": "e2", "index": 2, "period": 1, "timestamp": "bad", "minute": 1, "second": 0, "type": {"id": 16, "name": "Shot"},
             "shot": {"statsbomb_xg": 0.25, "outcome": {"id": 97, "name": "Goal"}, "end_location": [120.0, 40.0, 1.5]}}]
    (tmp_path / "events").mkdir()
    (tmp_path / "events" / "77.json").write_text(json.dumps(docs))
    matches = spark.createDataFrame([(77, "2016-01-01", "Home", "Away")], "match_id long, match_date string, home_team string, away_team string")
    rows = D.read_events_json(spark, str(tmp_path / "events"), matches).orderBy("index").collect()
    assert rows[0].match_id == 77 and rows[0].event_seconds_exact == 1.25 and rows[0].location_y == 20.5 and rows[0].home_team == "Home"
    assert rows[1].event_seconds_exact == 60.0 and rows[1].shot_end_z == 1.5 and rows[1].shot_xg == 0.25 and rows[1].pass_end_x is None
    lineups = [{"team_id": 7, "team_name": "Home", "lineup": [
        {"player_id": 1, "player_name": "P", "jersey_number": 9, "positions": [{"start_reason": "Starting XI"}], "cards": []},
        {"player_id": 2, "player_name": "Q", "jersey_number": 10, "positions": []}]}]
    (tmp_path / "lineups").mkdir()
    (tmp_path / "lineups" / "77.json").write_text(json.dumps(lineups))
    got = {r.player_id: r for r in D.read_lineups_json(spark, str(tmp_path / "lineups")).collect()}
    assert got[1].starter and not got[2].starter and got[2].positions_json == "[]" and got[1].match_id == 77
    with pytest.raises(Exception):
        (tmp_path / "bad").mkdir()
        (tmp_path / "bad" / "78.json").write_text("[{]")
        D.read_events_json(spark, str(tmp_path / "bad"))


def test_odds_csv(spark, tmp_path):
    (tmp_path / "odds.csv").write_text("Date,HomeTeam,AwayTeam,B365H,B365D,B365A\n21/08/15,A,B,1.5,3.5,6\n22/08/2015,C,D,2,3,4\n")
    rows = TB.read_odds_csv(spark, str(tmp_path / "odds.csv"), "2015/2016").collect()
    assert [str(r.clean_date) for r in rows] == ["2015-08-21", "2015-08-22"] and rows[0].B365H == 1.5
    (tmp_path / "bad.csv").write_text("Date,HomeTeam,AwayTeam,B365H,B365D,B365A\nnever,A,B,1.5,3.5,6\n")
    with pytest.raises(Q.QualityError):
        TB.read_odds_csv(spark, str(tmp_path / "bad.csv"), "x")
    (tmp_path / "short.csv").write_text("Date,HomeTeam\n")
    with pytest.raises(ValueError, match="lacks"):
        TB.read_odds_csv(spark, str(tmp_path / "short.csv"), "x")


def test_fixed_split_dates(spark):
    rows = [("2015/2016", d) for d in ("2016-01-10", "2016-01-11", "2016-02-14", "2016-02-15", "2016-04-01", "2016-04-02")] + [("2016/2017", "2016-09-01")]
    df = spark.createDataFrame(rows, "s string, d string").withColumn("d", F.to_date("d"))
    assert [r[0] for r in df.select(C.split_role("s", "d")).collect()] == [
        "train", "validation", "validation", "calibration", "calibration", "pilot_holdout", "final_test"]


def test_predictor_rules():
    kinds = {"home_event_goals_roll5": "double", "home_score": "bigint", "home_team": "string"}
    got = Q.predictor_rules(list(kinds), ["home_score"], ["_roll", "_expanding"], kinds)
    assert ("home_score", "forbidden") in got and ("home_team", "not numeric") in got and not any(c.startswith("home_event") for c, _ in got)


def test_whole_tables_and_reference_draws(spark, sf):
    import glob
    import os

    import pyarrow.parquet as pq
    import __spark_entry__ as entry

    queries = entry.queries()
    rows = {os.path.basename(f)[:-8]: pq.read_metadata(f).num_rows for f in glob.glob(f"{sf}/*.parquet")}
    assert {r.table_name: r.rows for r in queries["table_manifest_all"](spark, sf).collect()} == rows
    seasons = queries["union_all_seasons"](spark, sf)
    assert seasons.count() == seasons.where(F.col("first_score").isNotNull() | F.col("second_score").isNotNull()).count() == rows["orders"]
    part = spark.read.parquet(f"{sf}/part.parquet")
    assert queries["selection_stability_all"](spark, sf).count() == part.select("p_type").distinct().count()
    assert queries["concept_rollup_all"](spark, sf).agg(F.sum("features")).first()[0] == part.select("p_type").distinct().count()
    for name in ("bootstrap_ci_2000", "paired_loss_difference_2000"):
        assert {r.draws for r in queries[name](spark, sf).collect()} == {2000}
