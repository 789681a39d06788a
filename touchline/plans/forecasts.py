"""Scoring of forecasts: the de-vigged market and a form-free prior model."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import columns as C
from ..operators import bootstrap as B, folds as FO, ordered as O, relate as R, scoring as SC
from ..sources import adapters as A
from .registry import final, query
from .scalars import MARKET_SQL, ROLE_SQL

# Two forecasts per match: the market, and the market pulled halfway to a fixed prior.
LOSS = {
    "k": MARKET_SQL,
    "fc": """SELECT match_id, clean_date, season_name, goal_margin, outcome AS actual, 'market' AS model, ia / total AS pa, idr / total AS pd, ih / total AS ph FROM k
UNION ALL SELECT match_id, clean_date, season_name, goal_margin, outcome, 'shrunk', 0.5 * ia / total + 0.15, 0.5 * idr / total + 0.125, 0.5 * ih / total + 0.225 FROM k""",
    "q": "SELECT * REPLACE (pa / (pa + pd + ph) AS pa, pd / (pa + pd + ph) AS pd, ph / (pa + pd + ph) AS ph) FROM fc",
    "ya": "SELECT *, CASE actual WHEN 'A' THEN 1.0::DOUBLE ELSE 0 END AS y1, CASE actual WHEN 'D' THEN 1.0::DOUBLE ELSE 0 END AS y2, CASE actual WHEN 'H' THEN 1.0::DOUBLE ELSE 0 END AS y3 FROM q",
    "ls": """SELECT *, ((pa - y1) * (pa - y1) + (pa + pd - y1 - y2) * (pa + pd - y1 - y2)) / 2 AS rps,
  (pa - y1) * (pa - y1) + (pd - y2) * (pd - y2) + (ph - y3) * (ph - y3) AS brier,
  -ln(CASE actual WHEN 'A' THEN pa WHEN 'D' THEN pd ELSE ph END) AS log_loss, greatest(pa, pd, ph) AS confidence,
  CASE WHEN pa >= pd AND pa >= ph THEN 'A' WHEN pd >= ph THEN 'D' ELSE 'H' END AS predicted FROM ya""",
    "lc": "SELECT *, CASE WHEN predicted = actual THEN 1.0::DOUBLE ELSE 0 END AS correct FROM ls",
}


def bin_sql(x):
    step = "CAST(0.1 AS DOUBLE)"
    whens = " ".join(f"WHEN {x} >= {i} * {step} THEN {i}" for i in range(9, -1, -1))
    return f"CASE {whens} END"


def forecasts(spark, sf_dir) -> DataFrame:
    m = R.add_market(A.matches(spark, sf_dir))
    base = m.select("match_id", "clean_date", "season_name", C.clipped_margin("home_score", "away_score").alias("goal_margin"),
                    C.outcome("home_score", "away_score").alias("actual"), "market_prob_A", "market_prob_D", "market_prob_H")
    def one(name, f):
        p = [f(F.col(f"market_prob_{k}"), prior) for k, prior in (("A", 0.15), ("D", 0.125), ("H", 0.225))]
        return F.struct(F.lit(name).alias("model"), p[0].alias("p_A"), p[1].alias("p_D"), p[2].alias("p_H"))
    both = F.array(one("market", lambda p, _: p), one("shrunk", lambda p, prior: p * 0.5 + prior))
    return base.select("match_id", "clean_date", "season_name", "goal_margin", "actual", F.inline(both))


def losses(spark, sf_dir) -> DataFrame:
    return SC.with_losses(forecasts(spark, sf_dir))


@query("row_losses", """
SELECT match_id, model, predicted, round(rps, 9) AS rps, round(brier, 9) AS brier, round(log_loss, 9) AS log_loss FROM ls""", "m", LOSS)
def row_losses(spark, sf_dir):
    return final(losses(spark, sf_dir).select("match_id", "model", "predicted", "rps", "brier", "log_loss"))


def _metrics_sql(keys, extra=""):
    on = ", ".join(keys)
    return f"""SELECT {on}, CAST(sum(n) AS BIGINT) AS rows, round(sum(s_rps) / sum(n), 9) AS rps, round(sum(s_ll) / sum(n), 9) AS log_loss,
  round(sum(s_br) / sum(n), 9) AS brier, round(sum(abs(s_c - s_conf)) / sum(n), 9) AS ece, round(sum(s_c) / sum(n), 9) AS accuracy {extra}
FROM (SELECT {on}, {bin_sql('confidence')} AS b, count(*) AS n, sum(rps) AS s_rps, sum(log_loss) AS s_ll, sum(brier) AS s_br, sum(correct) AS s_c,
  sum(confidence) AS s_conf FROM lc GROUP BY {on}, b) GROUP BY {on}"""


@query("market_scores", _metrics_sql(["model"]), "m", LOSS)
def market_scores(spark, sf_dir):
    return final(SC.metrics_by(losses(spark, sf_dir), ["model"]))


@query("metrics_by", f"SELECT x.*, y.n_matches FROM ({_metrics_sql(['model', 'season_name'])}) x JOIN (SELECT model, season_name, count(DISTINCT match_id) AS n_matches FROM lc GROUP BY 1, 2) y USING (model, season_name)", "m", LOSS)
def metrics_by(spark, sf_dir):
    return final(SC.metrics_by(losses(spark, sf_dir), ["model", "season_name"], "match_id"))


@query("reliability_table", f"""
SELECT g.series, g.bin, round(g.bin * CAST(0.1 AS DOUBLE), 9) AS lower, round((g.bin + 1) * CAST(0.1 AS DOUBLE), 9) AS upper,
  count(v.value) AS count, round(avg(v.value), 9) AS mean_confidence, round(avg(v.hit), 9) AS observed_frequency
FROM (SELECT series, bin FROM (SELECT unnest(['top_label', 'A', 'D', 'H']) AS series), (SELECT unnest(range(0, 10)) AS bin)) g
LEFT JOIN (SELECT series, value, hit, {bin_sql('value')} AS bin FROM (
  SELECT 'top_label' AS series, confidence AS value, correct AS hit FROM lc WHERE model = 'market'
  UNION ALL SELECT 'A', pa, y1 FROM lc WHERE model = 'market' UNION ALL SELECT 'D', pd, y2 FROM lc WHERE model = 'market'
  UNION ALL SELECT 'H', ph, y3 FROM lc WHERE model = 'market')) v ON g.series = v.series AND g.bin = v.bin
GROUP BY 1, 2""", "m", LOSS)
def reliability_table(spark, sf_dir):
    return final(SC.reliability_table(losses(spark, sf_dir).where(F.col("model") == "market")))


@query("confusion", "SELECT model, actual, predicted, count(*) AS n FROM lc GROUP BY 1, 2, 3", "m", LOSS)
def confusion(spark, sf_dir):
    return SC.confusion(losses(spark, sf_dir), ["model"])


REPORT_SQL = """
SELECT model, label, CAST(count(*) FILTER (WHERE actual = label) AS BIGINT) AS support,
  coalesce(count(*) FILTER (WHERE actual = label AND predicted = label) / nullif(count(*) FILTER (WHERE predicted = label), 0)::DOUBLE, 0) AS precision,
  coalesce(count(*) FILTER (WHERE actual = label AND predicted = label) / nullif(count(*) FILTER (WHERE actual = label), 0)::DOUBLE, 0) AS recall,
  coalesce(2 * count(*) FILTER (WHERE actual = label AND predicted = label) / nullif(count(*) FILTER (WHERE actual = label) + count(*) FILTER (WHERE predicted = label), 0)::DOUBLE, 0) AS f1
FROM lc, (SELECT unnest(['A', 'D', 'H']) AS label) GROUP BY 1, 2"""
REPORT = {**LOSS, "rep": REPORT_SQL}


@query("class_report", "SELECT model, label, support, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM rep", "m", REPORT)
def class_report(spark, sf_dir):
    return final(SC.class_report(losses(spark, sf_dir), ["model"]))


@query("class_summary", """
SELECT model, round(avg(recall) FILTER (WHERE support > 0), 9) AS balanced_accuracy, round(avg(f1), 9) AS macro_f1, CAST(sum(support) AS BIGINT) AS rows,
  round(sum(recall * support) / sum(support), 9) AS accuracy FROM rep GROUP BY 1""", "m", REPORT)
def class_summary(spark, sf_dir):
    return final(SC.class_summary(SC.class_report(losses(spark, sf_dir), ["model"]), ["model"]))


MARGIN_SQL = {**LOSS, "mg": "SELECT season_name, goal_margin AS target, greatest(least((ph - pa) * 8, 5), -5) AS prediction FROM lc WHERE model = 'market'"}


def margins(spark, sf_dir):
    df = losses(spark, sf_dir).where(F.col("model") == "market")
    return df.select("season_name", F.col("goal_margin").alias("target"), C.clip((F.col("p_H") - F.col("p_A")) * 8, -5.0, 5.0).alias("prediction"))


@query("regression_metrics", """
SELECT season_name, count(*) AS rows, round(avg(abs(target - prediction)), 9) AS mae, round(sqrt(avg((target - prediction) * (target - prediction))), 9) AS rmse,
  round(corr(target, prediction), 9) AS correlation FROM mg GROUP BY 1""", "m", MARGIN_SQL)
def regression_metrics(spark, sf_dir):
    return final(SC.regression_metrics(margins(spark, sf_dir), ["season_name"]))


PAIR_SQL = """
SELECT a.match_id, a.actual, a.goal_margin, a.rps AS rps_a, b.rps AS rps_b, a.predicted AS predicted_a, b.predicted AS predicted_b
FROM lc a JOIN lc b ON a.match_id = b.match_id AND a.model = 'shrunk' AND b.model = 'market'"""
PAIR = {**LOSS, "pr": PAIR_SQL}


def pairs(spark, sf_dir):
    return SC.compare_forecasts(losses(spark, sf_dir), "shrunk", "market", ["match_id", "actual", "goal_margin"], ["rps", "predicted"])


@query("compare_forecasts", "SELECT * REPLACE (CAST(goal_margin AS BIGINT) AS goal_margin, round(rps_a, 9) AS rps_a, round(rps_b, 9) AS rps_b) FROM pr", "m", PAIR)
def compare_forecasts(spark, sf_dir):
    return final(pairs(spark, sf_dir))


SLICES = {"draw": "actual = 'D'", "large_margin": "abs(goal_margin) >= 3", "market_upset": "predicted_b <> actual", "model_market_disagree": "predicted_a <> predicted_b"}


@query("error_slices", " UNION ALL ".join(
    f"SELECT '{n}' AS slice, {c} AS active, count(*) AS n, round(avg(rps_a), 9) AS mean_rps_a, round(avg(rps_b), 9) AS mean_rps_b FROM pr GROUP BY 2" for n, c in SLICES.items()), "m", PAIR)
def error_slices(spark, sf_dir):
    return final(SC.error_slices(pairs(spark, sf_dir), {n: F.expr(c) for n, c in SLICES.items()}, ["rps_a", "rps_b"]))


@query("worst_cases", """
SELECT match_id, model, rank, round(rps, 9) AS rps FROM (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(rps, 12) DESC, match_id) AS rank FROM lc) WHERE rank <= 10""", "m", LOSS)
def worst_cases(spark, sf_dir):
    df = losses(spark, sf_dir).select("match_id", "model", "rps")
    return final(O.top_per_group(df, ["model"], [F.round("rps", 12).desc(), F.col("match_id")], 10))


@query("topk_lookup", """
SELECT match_id, home_team, away_team, home_score, away_score FROM m WHERE match_id IN (
  SELECT match_id FROM lc WHERE model = 'market' ORDER BY round(rps, 12) DESC, match_id LIMIT 25)""", "m", LOSS)
def topk_lookup(spark, sf_dir):
    worst = R.top_rows(losses(spark, sf_dir).where(F.col("model") == "market").select("match_id", "rps"), [F.round("rps", 12).desc(), F.col("match_id")], 25)
    full = A.matches(spark, sf_dir).select("match_id", "home_team", "away_team", "home_score", "away_score")
    return R.topk_lookup(full, worst, ["match_id"])


# -- bootstrap -----------------------------------------------------------------

P = 2147483647
UNIFORM_SQL = f"""
SELECT *, ((x3 * x3) % {P}) / CAST({P} AS DOUBLE) AS u FROM (
 SELECT *, ((x2 * x2) % {P} + k * 15485863) % {P} AS x3 FROM (
  SELECT *, ((x1 * x1) % {P} + d * 104729) % {P} AS x2 FROM (
   SELECT *, (d * 1000003 + k * 7919 + 42) % {P} AS x1 FROM dr)))"""


def _weight_sql():
    from ..functions.hashing import POISSON_CDF

    return "CASE " + " ".join(f"WHEN u < CAST({e} AS DOUBLE) THEN {n}" for n, e in enumerate(POISSON_CDF)) + f" ELSE {len(POISSON_CDF)} END"


def boot(source, draws, group):
    return {
        **LOSS, "src": source,
        "dr": f"SELECT src.*, d, unit % {P} AS k FROM src, (SELECT unnest(range(1, {draws + 1})) AS d)",
        "un": UNIFORM_SQL,
        "st": f"SELECT {group}, d, sum(w * v) / sum(w * n) AS statistic FROM (SELECT *, {_weight_sql()} AS w FROM un) GROUP BY {group}, d",
    }


ROWS_SRC = "SELECT model, match_id AS unit, rps AS v, 1.0::DOUBLE AS n FROM lc"
CLUSTER_SRC = "SELECT model, date_diff('day', DATE '1970-01-01', CAST(clean_date AS DATE)) AS unit, sum(rps) AS v, count(*)::DOUBLE AS n FROM lc GROUP BY 1, 2"


@query("bootstrap_ci", f"""
SELECT x.model, x.rows, round(x.mean, 9) AS mean, y.draws, round(y.lo, 9) AS ci_lower, round(y.hi, 9) AS ci_upper
FROM (SELECT model, count(*) AS rows, avg(v) AS mean FROM src GROUP BY 1) x JOIN (
  SELECT model, count(statistic) AS draws, quantile_cont(statistic, 0.025) AS lo, quantile_cont(statistic, 0.975) AS hi FROM st GROUP BY 1) y USING (model)""",
       "m", boot(ROWS_SRC, 2000, "model"))
def bootstrap_ci(spark, sf_dir):
    return final(B.bootstrap_ci(losses(spark, sf_dir), "rps", "match_id", ["model"], draws=2000))


@query("bootstrap_ci_2000", f"""
SELECT x.model, x.rows, round(x.mean, 9) AS mean, y.draws, round(y.lo, 9) AS ci_lower, round(y.hi, 9) AS ci_upper
FROM (SELECT model, count(*) AS rows, avg(v) AS mean FROM src GROUP BY 1) x JOIN (
  SELECT model, count(statistic) AS draws, quantile_cont(statistic, 0.025) AS lo, quantile_cont(statistic, 0.975) AS hi FROM st GROUP BY 1) y USING (model)""",
       "m", boot(ROWS_SRC, 2000, "model"))
def bootstrap_ci_2000(spark, sf_dir):
    return final(B.bootstrap_ci(losses(spark, sf_dir), "rps", "match_id", ["model"], draws=2000))


@query("group_bootstrap_ci", f"""
SELECT x.model, x.clusters, round(x.mean, 9) AS mean, y.draws, round(y.lo, 9) AS ci_lower, round(y.hi, 9) AS ci_upper
FROM (SELECT model, count(*) AS clusters, sum(v) / sum(n) AS mean FROM src GROUP BY 1) x JOIN (
  SELECT model, count(statistic) AS draws, quantile_cont(statistic, 0.025) AS lo, quantile_cont(statistic, 0.975) AS hi FROM st GROUP BY 1) y USING (model)""",
       "m", boot(CLUSTER_SRC, 1000, "model"))
def group_bootstrap_ci(spark, sf_dir):
    df = losses(spark, sf_dir).withColumn("day", F.unix_date(F.to_date("clean_date")))
    return final(B.group_bootstrap_ci(df, "rps", "day", ["model"], draws=1000))


PAIRED_SRC = """
SELECT a.model, a.match_id AS unit, a.rps - b.rps AS v, 1.0::DOUBLE AS n FROM lc a JOIN lc b ON a.match_id = b.match_id AND b.model = 'market' WHERE a.model = 'shrunk'"""


@query("paired_loss_difference", f"""
SELECT x.model, x.rows, round(x.mean, 9) AS mean, y.draws, round(y.lo, 9) AS ci_lower, round(y.hi, 9) AS ci_upper
FROM (SELECT model, count(*) AS rows, avg(v) AS mean FROM src GROUP BY 1) x JOIN (
  SELECT model, count(statistic) AS draws, quantile_cont(statistic, 0.025) AS lo, quantile_cont(statistic, 0.975) AS hi FROM st GROUP BY 1) y USING (model)""",
       "m", boot(PAIRED_SRC, 2000, "model"))
def paired_loss_difference(spark, sf_dir):
    return _paired(spark, sf_dir, 2000)


@query("paired_loss_difference_2000", f"""
SELECT x.model, x.rows, round(x.mean, 9) AS mean, y.draws, round(y.lo, 9) AS ci_lower, round(y.hi, 9) AS ci_upper
FROM (SELECT model, count(*) AS rows, avg(v) AS mean FROM src GROUP BY 1) x JOIN (
  SELECT model, count(statistic) AS draws, quantile_cont(statistic, 0.025) AS lo, quantile_cont(statistic, 0.975) AS hi FROM st GROUP BY 1) y USING (model)""",
       "m", boot(PAIRED_SRC, 2000, "model"))
def paired_loss_difference_2000(spark, sf_dir):
    return _paired(spark, sf_dir, 2000)


def _paired(spark, sf_dir, draws):
    diff = SC.paired_loss_difference(losses(spark, sf_dir), "market", ["match_id"]).where(F.col("model") != "market")
    return final(B.bootstrap_ci(diff.select("model", "match_id", "difference"), "difference", "match_id", ["model"], draws=draws))


# -- folds and selection ---------------------------------------------------------

FOLDS = {
    **LOSS,
    "dd": "SELECT day, row_number() OVER (ORDER BY day) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT CAST(clean_date AS DATE) AS day FROM m)",
    "bl": "SELECT day, CASE WHEN r < n - 4 * (n // 5) THEN 0 ELSE 1 + (r - (n - 4 * (n // 5))) // (n // 5) END AS block FROM dd",
    "fm": """SELECT lc.*, bl.day, f.fold, CASE WHEN bl.block < f.fold THEN 'train' ELSE 'validation' END AS role
FROM lc JOIN bl ON CAST(lc.clean_date AS DATE) = bl.day, (SELECT unnest([1, 2, 3, 4]) AS fold) f WHERE bl.block <= f.fold""",
    "fs": "SELECT model, fold, avg(rps) AS rps FROM fm WHERE role = 'validation' GROUP BY 1, 2",
    "cs": "SELECT model, count(*) AS folds, avg(rps) AS mean, stddev_samp(rps) AS std, stddev_samp(rps) / sqrt(count(*)) AS sem FROM fs GROUP BY 1",
}


def members(spark, sf_dir):
    return FO.fold_members(FO.with_block(losses(spark, sf_dir), 4), 4)


@query("cv_folds", """
SELECT CAST(fold AS BIGINT) AS fold, role, count(*) AS rows, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day FROM fm GROUP BY 1, 2""", "m", FOLDS)
def cv_folds(spark, sf_dir):
    df = FO.fold_summary(members(spark, sf_dir))
    return final(df.withColumns({x: F.col(x).cast("string") for x in ("first_day", "last_day")}))


def _cv(spark, sf_dir):
    per_fold = members(spark, sf_dir).where(F.col("role") == "validation").groupBy("model", "fold").agg(F.avg("rps").alias("rps"))
    return SC.cv_summary(per_fold, ["model"], "rps")


@query("cv_summary", """
SELECT model, folds, round(mean, 9) AS mean, round(std, 9) AS std, round(sem, 9) AS sem, round(mean - b, 9) AS delta, round((mean - b) * 100 / b, 6) AS delta_pct
FROM cs, (SELECT mean AS b FROM cs WHERE model = 'market')""", "m", FOLDS)
def cv_summary(spark, sf_dir):
    df = SC.against_baseline(_cv(spark, sf_dir), "model", "market").withColumn("delta_pct", F.round("delta_pct", 6))
    return final(df)


@query("best_per_group", """
SELECT season_name, model, round(rps, 9) AS rps FROM (
  SELECT *, row_number() OVER (PARTITION BY season_name ORDER BY rps, model) AS rn FROM (
    SELECT season_name, model, round(avg(rps), 9) AS rps FROM lc GROUP BY 1, 2)) WHERE rn = 1""", "m", LOSS)
def best_per_group(spark, sf_dir):
    table = losses(spark, sf_dir).groupBy("season_name", "model").agg(F.round(F.avg("rps"), 9).alias("rps"))
    return final(SC.best_per_group(table, ["season_name"], "rps", ["model"]))


STABLE_SQL = """
SELECT p_type AS feature, p_size % 4 AS fold, p_retailprice AS importance FROM part WHERE p_size % 5 <> 0"""


@query("selection_stability", """
SELECT feature, count(*) AS folds_selected, round(avg(i), 6) AS mean_importance, round(count(*) / 4.0::DOUBLE, 9) AS selection_rate
FROM (SELECT feature, fold, sum(importance) AS i FROM s GROUP BY 1, 2) GROUP BY 1""", extra={"s": STABLE_SQL})
def selection_stability(spark, sf_dir):
    return final(_stability(spark, sf_dir)).withColumn("mean_importance", F.round("mean_importance", 6))


ALL_STABLE_SQL = "SELECT p_type AS feature, p_size % 4 AS fold, p_retailprice AS importance FROM part"


@query("selection_stability_all", """
SELECT feature, count(*) AS folds_selected, round(avg(i), 6) AS mean_importance, round(count(*) / 4.0::DOUBLE, 9) AS selection_rate
FROM (SELECT feature, fold, sum(importance) AS i FROM s GROUP BY 1, 2) GROUP BY 1""", extra={"s": ALL_STABLE_SQL})
def selection_stability_all(spark, sf_dir):
    """Every row of the table."""
    return final(_stable(A.table(spark, sf_dir, "part"))).withColumn("mean_importance", F.round("mean_importance", 6))


def _stability(spark, sf_dir):
    return _stable(A.table(spark, sf_dir, "part").where(F.col("p_size") % 5 != 0))


def _stable(t):
    return SC.selection_stability(t.select(F.col("p_type").alias("feature"), (F.col("p_size") % 4).alias("fold"), F.col("p_retailprice").alias("importance")), 4)


@query("concept_rollup", """
SELECT concept, count(*) AS features, round(sum(mi), 4) AS importance, round(avg(sr), 9) AS mean_selection_rate FROM (
  SELECT feature, CASE WHEN contains(lower(feature), 'promo') THEN 'offer' WHEN contains(lower(feature), 'standard') THEN 'plain' ELSE 'other' END AS concept,
    avg(i) AS mi, count(*) / 4.0::DOUBLE AS sr FROM (SELECT feature, fold, sum(importance) AS i FROM s GROUP BY 1, 2) GROUP BY 1) GROUP BY 1""", extra={"s": STABLE_SQL})
def concept_rollup(spark, sf_dir):
    df = SC.concept_rollup(_stability(spark, sf_dir), (("promo", "offer"), ("standard", "plain")))
    return final(df).withColumn("importance", F.round("importance", 4))


@query("concept_rollup_all", """
SELECT concept, count(*) AS features, round(sum(mi), 4) AS importance, round(avg(sr), 9) AS mean_selection_rate FROM (
  SELECT feature, CASE WHEN contains(lower(feature), 'promo') THEN 'offer' WHEN contains(lower(feature), 'standard') THEN 'plain' ELSE 'other' END AS concept,
    avg(i) AS mi, count(*) / 4.0::DOUBLE AS sr FROM (SELECT feature, fold, sum(importance) AS i FROM s GROUP BY 1, 2) GROUP BY 1) GROUP BY 1""", extra={"s": ALL_STABLE_SQL})
def concept_rollup_all(spark, sf_dir):
    df = SC.concept_rollup(_stable(A.table(spark, sf_dir, "part")), (("promo", "offer"), ("standard", "plain")))
    return final(df).withColumn("importance", F.round("importance", 4))


@query("attach_targets", """
SELECT match_id, split_role, outcome, CAST(goal_margin AS BIGINT) AS goal_margin FROM r WHERE split_role <> 'final_test'""", "m", {"k": MARKET_SQL, "r": ROLE_SQL})
def attach_targets(spark, sf_dir):
    from .scalars import ROLES

    m = A.matches(spark, sf_dir)
    features = m.select("match_id", C.split_role("season_name", "clean_date", **ROLES).alias("split_role"))
    return final(R.attach_targets(features, R.targets(m)))


@query("frozen_baselines", """
SELECT x.match_id, minute AS snapshot_minute, round(ia / total, 9) AS "p_A", round(idr / total, 9) AS "p_D", round(ih / total, 9) AS "p_H"
FROM (SELECT DISTINCT user_id AS match_id FROM events) x JOIN k ON k.match_id = x.match_id, (SELECT unnest(range(0, 91, 5)) AS minute)""", "m", {"k": MARKET_SQL})
def frozen_baselines(spark, sf_dir):
    """The market forecast repeated at every snapshot of the matches in play."""
    from ..operators import snapshots as SN

    grid = SN.snapshot_grid(A.table(spark, sf_dir, "events").select(F.col("user_id").alias("match_id")).distinct())
    market = R.add_market(A.matches(spark, sf_dir)).select("match_id", *[F.col(f"market_prob_{k}").alias(f"p_{k}") for k in "ADH"])
    return final(grid.select("match_id", "snapshot_minute").join(market, "match_id"))


@query("worst_group", """
SELECT season_name, round(mean_rps, 9) AS mean_rps FROM (SELECT season_name, avg(rps) AS mean_rps FROM lc GROUP BY 1) ORDER BY 2 DESC, 1 LIMIT 1""", "m", LOSS)
def worst_group(spark, sf_dir):
    """The group with the largest mean loss."""
    means = losses(spark, sf_dir).groupBy("season_name").agg(F.round(F.avg("rps"), 9).alias("mean_rps"))
    return R.top_rows(means, [F.col("mean_rps").desc(), F.col("season_name")], 1)
