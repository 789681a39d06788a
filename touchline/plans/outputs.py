"""Scored tables, timelines and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C, constants as K
from ..models import calibrate as CA, linear as LI, prepare as PR, sweep as SW
from ..operators import history as H, outputs as OU, relate as R, scoring as SC, snapshots as SN
from ..session import cut_lineage
from ..sources import adapters as A
from .fits import ODDS, _labelled
from .forecasts import LOSS, _metrics_sql, losses
from .histories import event_rows, long_rows
from .inplay import SNAP
from .networks import network_rows
from .registry import final, query
from .scalars import MARKET_SQL


@query("score_prematch")
def score_prematch(spark, sf_dir):
    """Fit on early seasons, calibrate on 1999, score every match."""
    df = _labelled(spark, sf_dir).drop("p_A", "p_D", "p_H").persist()
    fit, hold = df.where(F.col("season_name") < "1999"), df.where(F.col("season_name") == "1999")
    clf = LI.multinomial_logistic(fit, ODDS, "y", 1.0, max_iter=100, tol=1e-7)
    reg = LI.ridge(fit, ODDS, "goal_margin", 10.0)
    platt = CA.platt_calibrate(clf.transform(hold, OU.RAW))
    mapper = CA.margin_to_probs(reg.transform(hold))
    return final(OU.score_prematch(df, clf, platt, reg, mapper), 4)


INPLAY = ["score_diff", "snapshot_minute", "diff_cum_shots", "diff_recent10_passes", "home_in_possession"]


def inplay_rows(spark, sf_dir):
    """Snapshots with the final outcome of the event view's own goals."""
    snaps = SN.build_snapshots(A.events(spark, sf_dir)).select("match_id", "snapshot_minute", "home_score", "away_score", *[x for x in INPLAY if x != "snapshot_minute"])
    end = snaps.where(F.col("snapshot_minute") == 90).select(
        "match_id", C.outcome("home_score", "away_score").alias("actual"), C.clipped_margin("home_score", "away_score").alias("goal_margin"))
    return snaps.join(end, "match_id").withColumn("y", CA.class_number("actual"))


@query("score_inplay")
def score_inplay(spark, sf_dir):
    df = inplay_rows(spark, sf_dir).persist()
    fit, hold = df.where(F.col("match_id") % 3 != 0), df.where(F.col("match_id") % 3 == 0)
    clf = LI.multinomial_logistic(fit, INPLAY, "y", 1.0, max_iter=100, tol=1e-7)
    reg = LI.ridge(fit, INPLAY, "goal_margin", 10.0)
    phase = CA.phase_calibrate(clf.transform(hold, OU.RAW))
    mapper = CA.margin_to_probs(reg.transform(hold))
    return final(OU.score_inplay(df, clf, phase, reg, mapper), 4)


def _timeline(spark, sf_dir):
    snaps = SN.build_snapshots(A.events(spark, sf_dir), metrics=("shots", "xg"))
    score = snaps.select("match_id", "snapshot_minute", "home_score", "away_score")
    play = snaps.select("match_id", "snapshot_minute", "home_cum_shots", "away_cum_shots", "home_in_possession")
    return OU.match_timeline([score, play])


@query("match_timeline", """
SELECT match_id, CAST(snapshot_minute // 5 AS BIGINT) AS position, snapshot_minute, home_score, away_score, home_cum_shots, away_cum_shots, home_in_possession FROM s""", "e", SNAP)
def match_timeline(spark, sf_dir):
    """Ordered arrays per match, unrolled again with their positions."""
    rows = _timeline(spark, sf_dir).select("match_id", F.posexplode("points").alias("position", "p"))
    return final(rows.select("match_id", "position", "p.*"))


@query("timeline_documents", """
SELECT match_id, CAST(count(*) AS BIGINT) AS points, max(home_score) AS last_home_score FROM s GROUP BY 1""", "e", SNAP)
def timeline_documents(spark, sf_dir):
    docs = OU.timeline_documents(_timeline(spark, sf_dir))
    parsed = F.from_json("document", "array<struct<snapshot_minute:int,home_score:double>>")
    return final(docs.select("match_id", F.size(parsed).alias("points"), F.element_at(parsed, -1)["home_score"].alias("last_home_score")))


@query("match_detail", """
SELECT match_id, match_id % 2 = 0 AS has_prematch, match_id IN (SELECT user_id FROM events) AS has_snapshots,
  CAST(CASE WHEN match_id IN (SELECT user_id FROM events) THEN 19 ELSE 0 END AS BIGINT) AS minutes FROM m""", "m")
def match_detail(spark, sf_dir):
    m = A.matches(spark, sf_dir)
    grid = SN.snapshot_grid(A.table(spark, sf_dir, "events").select(F.col("user_id").alias("match_id")).distinct())
    df = OU.match_detail(m, m.where(F.col("match_id") % 2 == 0), grid)
    return final(df.withColumn("minutes", F.size("minutes")))


@query("results_summary", f"""
SELECT arg_min(model, rps) AS best_model, min(rps) AS best_rps, max(rps) FILTER (WHERE model = 'market') AS baseline_rps, max(rows) AS rows,
  round(min(rps) - max(rps) FILTER (WHERE model = 'market'), 9) AS difference FROM ({_metrics_sql(['model'])})""", "m", LOSS)
def results_summary(spark, sf_dir):
    metrics = final(SC.metrics_by(losses(spark, sf_dir), ["model"]))
    return final(OU.results_summary(metrics, "market"))


@query("prematch_dataset", """
SELECT match_id, season_name, round(ih / total, 9) AS "market_prob_H", round(total, 9) AS bookie_margin,
  round(sin(2 * pi() * dayofyear(clean_date) / 365.25), 9) AS calendar_sin, outcome FROM k""", "m", {"k": MARKET_SQL})
def prematch_dataset(spark, sf_dir):
    """The modeling table: market, calendar, lagged histories and target in one row."""
    df = prematch_table(spark, sf_dir)
    return final(df.select("match_id", "season_name", "market_prob_H", "bookie_margin", "calendar_sin", "outcome"))


def prematch_table(spark, sf_dir):
    m = R.add_market(A.matches(spark, sf_dir))
    base = m.select("match_id", "clean_date", "season_name", "market_prob_A", "market_prob_D", "market_prob_H", "bookie_margin",
                    *[v.alias(k) for k, v in C.calendar("clean_date").items()],
                    C.outcome("home_score", "away_score").alias("outcome"), C.clipped_margin("home_score", "away_score").alias("goal_margin"))
    rows, features = H.entity_history(long_rows(spark, sf_dir), ("goals_for", "goals_against", "points"), "event_")
    return base.join(H.pivot_home_away(rows, features), "match_id")


# -- the whole pre-match table and fits on it ------------------------------------------


def whole_table(spark, sf_dir):
    """Event and network histories of both sides with differences, context, market and targets: 391 features."""
    m = R.add_market(A.matches(spark, sf_dir))
    events = event_rows(spark, sf_dir)
    event, event_features = H.entity_history(events, K.EVENT_METRICS, "event_")
    network = network_rows(spark, sf_dir)
    net, net_features = H.entity_history(network, K.NETWORK_METRICS, "net_")
    results = events.where("is_home = 1").select("match_id", C.outcome("goals_for", "goals_against").alias("outcome"), C.clipped_margin("goals_for", "goals_against").alias("goal_margin"))
    base = m.select(
        "match_id", "clean_date", "season_name", "market_prob_A", "market_prob_D", "market_prob_H", "bookie_margin",
        (F.dayofyear("clean_date") / 366.0).alias("season_progress"), *[v.alias(k) for k, v in C.calendar("clean_date").items()])
    out = results.join(H.pivot_home_away(event, event_features), "match_id").join(H.pivot_home_away(net, net_features), "match_id")
    return base.join(out, "match_id")


@query("prematch_whole")
def prematch_whole(spark, sf_dir):
    """The modeling table with all features; first matches of a team have NULL histories."""
    df = whole_table(spark, sf_dir)
    groups = H.feature_groups(df.columns)
    return final(df.select("match_id", "outcome", "goal_margin", *[F.col(x).cast("double").alias(x) for x in groups["combined"]]), 6)


@query("prematch_whole_fits")
def prematch_whole_fits(spark, sf_dir):
    """A model by feature group on the whole table: medians and scales of the training half, metrics of the other."""
    df = cut_lineage(whole_table(spark, sf_dir).withColumns({"y": F.when(F.col("outcome") == "A", 0).when(F.col("outcome") == "D", 1).otherwise(2), "actual": F.col("outcome")}))
    groups = H.feature_groups(df.columns)
    logistic = PR.prepared(lambda t, cols: LI.multinomial_logistic(t, cols, "y", 0.3, max_iter=50, classes=3))
    specs = [SW.Spec("logistic", logistic, groups[g], g) for g in ("market", "conventional", "network", "combined")]
    return final(SW.model_sweep(df.where(F.col("match_id") % 2 == 0), df.where(F.col("match_id") % 2 == 1), specs, ["match_id", "actual"])[0], 5)
