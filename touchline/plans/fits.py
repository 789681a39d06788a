"""Fitted models over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..models import attribution as AT, calibrate as CA, ensembles as EN, figs as FG, hashed as HN, kernel as KE, linear as LI, neighbors as NB, prepare as PR, resample as RS, sweep as SW, trees as TR
from ..operators import folds as FO, ordered as O, scoring as SC
from ..sources import adapters as A
from .forecasts import LOSS, forecasts
from .registry import final, query

X = ["l_quantity", "l_discount", "l_tax"]


def items(spark, sf_dir):
    return A.table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), *X, "l_extendedprice",
        (F.col("l_extendedprice") / 10000.0).alias("price"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("y"))


# -- preparation -----------------------------------------------------------------

HOLES = ("SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 5 <> 0 THEN l_quantity END AS a, "
         "CASE WHEN l_linenumber % 3 <> 0 THEN l_extendedprice END AS b, CAST(NULL AS DOUBLE) AS c FROM lineitem")


def holes(spark, sf_dir):
    return A.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 5 != 0, F.col("l_quantity")).alias("a"),
        F.when(F.col("l_linenumber") % 3 != 0, F.col("l_extendedprice")).alias("b"), F.lit(None).cast("double").alias("c"))


@query("median_impute", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, coalesce(a, (SELECT median(a) FROM h)) AS a,
  round(coalesce(b, (SELECT median(b) FROM h)), 6) AS b, CAST(0 AS DOUBLE) AS c FROM h""", extra={"h": HOLES})
def median_impute(spark, sf_dir):
    df = holes(spark, sf_dir)
    return final(PR.median_impute(df, ["a", "b", "c"]).transform(df), 6)


@query("exact_quantiles", """
SELECT round(quantile_cont(l_extendedprice, 0.25), 6) AS q25, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50,
  round(quantile_cont(l_extendedprice, 0.975), 6) AS q975 FROM lineitem""")
def exact_quantiles(spark, sf_dir):
    df = A.table(spark, sf_dir, "lineitem").select("l_extendedprice")
    q = [O.exact_quantiles(df, ["l_extendedprice"], x, limit=2000)["l_extendedprice"] for x in (0.25, 0.5, 0.975)]
    return df.limit(1).select(*[F.round(F.lit(v), 6).alias(n) for v, n in zip(q, ("q25", "q50", "q975"))])


@query("standard_scale", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round((l_quantity - m1) / s1, 6) AS l_quantity, round((l_discount - m2) / s2, 6) AS l_discount
FROM lineitem, (SELECT avg(l_quantity) AS m1, stddev_pop(l_quantity) AS s1, avg(l_discount) AS m2, stddev_pop(l_discount) AS s2 FROM lineitem)""")
def standard_scale(spark, sf_dir):
    df = A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return final(PR.standard_scale(df, ["l_quantity", "l_discount"]).transform(df), 6)


@query("class_weight_balanced", """
SELECT doc_id, toxic AS toxic, round(w, 9) AS weight FROM (SELECT doc_id, CAST(toxic AS BIGINT) AS toxic FROM labels) JOIN (
  SELECT toxic AS k, (SELECT count(*) FROM labels) / (2.0::DOUBLE * count(*)) AS w FROM labels GROUP BY 1) ON toxic = k""")
def class_weight_balanced(spark, sf_dir):
    df = A.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return final(PR.class_weight_balanced(df, "toxic"))


@query("prior_classifier", """
SELECT match_id, round(avg(y1) OVER (), 9) AS "p_A", round(avg(y2) OVER (), 9) AS "p_D", round(avg(y3) OVER (), 9) AS "p_H" FROM lc WHERE model = 'market'""", "m", LOSS)
def prior_classifier(spark, sf_dir):
    df = forecasts(spark, sf_dir).where(F.col("model") == "market").select("match_id", "actual")
    return final(LI.prior_classifier(df, "actual", ("A", "D", "H")).transform(df).drop("actual"))


@query("mean_regressor", "SELECT match_id, round(avg(goal_margin) OVER (), 9) AS prediction FROM lc WHERE model = 'market'", "m", LOSS)
def mean_regressor(spark, sf_dir):
    df = forecasts(spark, sf_dir).where(F.col("model") == "market").select("match_id", "goal_margin")
    return final(LI.mean_regressor(df, "goal_margin").transform(df).drop("goal_margin"))


# -- linear ----------------------------------------------------------------------


@query("ridge", """
SELECT round((s22 * s1y - s12 * s2y) / det, 4) AS b_quantity, round((s11 * s2y - s12 * s1y) / det, 4) AS b_discount,
  round(my - (s22 * s1y - s12 * s2y) / det * m1 - (s11 * s2y - s12 * s1y) / det * m2, 4) AS intercept
FROM (SELECT *, s11 * s22 - s12 * s12 AS det FROM (
  SELECT avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my, var_pop(l_quantity) * count(*) + 10 AS s11,
    var_pop(l_discount) * count(*) + 10 AS s22, covar_pop(l_quantity, l_discount) * count(*) AS s12,
    covar_pop(l_quantity, l_extendedprice) * count(*) AS s1y, covar_pop(l_discount, l_extendedprice) * count(*) AS s2y FROM lineitem))""")
def ridge(spark, sf_dir):
    """Two-feature ridge; the oracle solves the penalized normal equations."""
    df = items(spark, sf_dir)
    m = LI.ridge(df, ["l_quantity", "l_discount"], "l_extendedprice", alpha=10.0).model
    b = m.coefficients.toArray().tolist()
    return df.limit(1).select(F.round(F.lit(b[0]), 4).alias("b_quantity"), F.round(F.lit(b[1]), 4).alias("b_discount"),
                              F.round(F.lit(m.intercept), 4).alias("intercept"))


@query("multinomial_logistic")
def multinomial_logistic(spark, sf_dir):
    df = items(spark, sf_dir)
    m = LI.multinomial_logistic(df, X, "y", c=0.3)
    return final(m.transform(df, ("p_A", "p_D", "p_H")).select("row_id", "p_A", "p_D", "p_H"), 4)


@query("margin_clip", "SELECT match_id, greatest(least(goal_margin * 1.5::DOUBLE, 5), -5) AS prediction FROM lc WHERE model = 'market'", "m", LOSS)
def margin_clip(spark, sf_dir):
    df = forecasts(spark, sf_dir).where(F.col("model") == "market")
    return df.select("match_id", LI.clip_margin(F.col("goal_margin") * 1.5).alias("prediction"))


# -- trees -------------------------------------------------------------------------


OUTCOMES = ("p_A", "p_D", "p_H")


def _probabilities(model, df):
    return final(model.transform(df, OUTCOMES).select("row_id", *OUTCOMES), 6)


@query("random_forest_classifier")
def random_forest_classifier(spark, sf_dir):
    df = items(spark, sf_dir)
    return _probabilities(TR.random_forest_classifier(df, X, "y", key="row_id", classes=3), df)


@query("random_forest_regressor")
def random_forest_regressor(spark, sf_dir):
    df = items(spark, sf_dir)
    return final(TR.random_forest_regressor(df, X, "price", key="row_id").transform(df).select("row_id", "prediction"), 6)


@query("gradient_boosting_regressor")
def gradient_boosting_regressor(spark, sf_dir):
    df = items(spark, sf_dir)
    return final(TR.gradient_boosting_regressor(df, X, "price", key="row_id").transform(df).select("row_id", "prediction"), 6)


@query("gradient_boosting_classifier")
def gradient_boosting_classifier(spark, sf_dir):
    df = items(spark, sf_dir)
    return _probabilities(TR.gradient_boosting_classifier(df, X, "y", 3, key="row_id"), df)


@query("histogram_boosting")
def histogram_boosting(spark, sf_dir):
    df = items(spark, sf_dir)
    return final(TR.histogram_boosting(df, X, "price", key="row_id").transform(df).select("row_id", "prediction"), 6)


@query("histogram_boosting_classifier")
def histogram_boosting_classifier(spark, sf_dir):
    df = items(spark, sf_dir)
    return _probabilities(TR.histogram_boosting(df, X, "y", 3, key="row_id"), df)


@query("random_forest_classifier_200")
def random_forest_classifier_200(spark, sf_dir):
    return random_forest_classifier(spark, sf_dir)


@query("random_forest_regressor_200")
def random_forest_regressor_200(spark, sf_dir):
    return random_forest_regressor(spark, sf_dir)


# Small fits that SQL can follow: trees of one split.

ITEMS_SQL = "SELECT l_orderkey * 8 + l_linenumber AS row_id, l_quantity, l_discount, l_tax, l_extendedprice / 10000.0 AS price FROM lineitem"


def _uniform_sql(draw: int, key: str, seed: int = 42) -> str:
    p = H.PRIME
    x = f"({draw} * 1000003::BIGINT + {key} % {p} * 7919 + {seed}) % {p}"
    x = f"(({x}) * ({x}) % {p} + {draw} * 104729::BIGINT) % {p}"
    return f"list_reduce([({x}), {key} % {p}], lambda a, k: (((a * a) % {p} + k * 15485863) % {p}) * (((a * a) % {p} + k * 15485863) % {p}) % {p}) / {float(p)}::DOUBLE"


def _poisson_sql(u: str) -> str:
    cases = " ".join(f"WHEN u < {c!r}::DOUBLE THEN {n}" for n, c in enumerate(H.POISSON_CDF))
    return f"(SELECT CASE {cases} ELSE {len(H.POISSON_CDF)} END FROM (SELECT {u} AS u))"


def _best_stump_sql(src: str, value: str, weight: str, least: int) -> str:
    """(i, threshold, lv, rv, n): the best split of ``src`` by weighted squared error; ties to the first feature and cut."""
    parts = [f"SELECT {i} AS i, {x} AS v, sum({weight}) AS n, sum({weight} * {value}) AS s FROM {src} GROUP BY {x}" for i, x in enumerate(X)]
    return f"""SELECT i, (v + nv) / 2 AS threshold, sl / nl AS lv, (s - sl) / (n - nl) AS rv, n FROM (
  SELECT i, v, lead(v) OVER (PARTITION BY i ORDER BY v) AS nv, sum(n) OVER (PARTITION BY i ORDER BY v) AS nl, sum(s) OVER (PARTITION BY i ORDER BY v) AS sl,
    sum(n) OVER (PARTITION BY i) AS n, sum(s) OVER (PARTITION BY i) AS s FROM ({' UNION ALL '.join(parts)}))
  WHERE nv IS NOT NULL AND nl >= {least} AND n - nl >= {least} ORDER BY sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n DESC, i, v LIMIT 1"""


def _stumps_frame(spark, model):
    """One row per tree of one split; the trees are few."""
    rows = [(t, model.columns[x.feature[0]], float(x.threshold[0]), float(x.value[1][0]), float(x.value[2][0]), int(x.cover[0])) for t, x in enumerate(model.trees)]
    return final(spark.createDataFrame(rows, "tree long, feature string, threshold double, left_value double, right_value double, rows long"), 6)


def _stump_row(t: int, src: str, n: str) -> str:
    return f"SELECT {t}::BIGINT AS tree, {X}[i + 1] AS feature, round(threshold, 6) AS threshold, round(lv, 6) AS left_value, round(rv, 6) AS right_value, {n} AS rows FROM {src}"


STUMPS = 5


@query("forest_stumps", " UNION ALL ".join(_stump_row(t, f"b{t}", "CAST(n AS BIGINT)") for t in range(STUMPS)), extra={
    "it": ITEMS_SQL,
    **{k: v for t in range(STUMPS) for k, v in ((f"w{t}", f"SELECT *, {_poisson_sql(_uniform_sql(t + 1, 'row_id'))} AS w FROM it"), (f"b{t}", _best_stump_sql(f"w{t}", "price", "w", 3)))}})
def forest_stumps(spark, sf_dir):
    """The first trees of a forest, cut to one split: bootstrap weights and splits as plain SQL."""
    return _stumps_frame(spark, TR.random_forest_regressor(items(spark, sf_dir), X, "price", trees=STUMPS, max_depth=1, key="row_id"))


def _boosting_sql():
    out = {"it": ITEMS_SQL, "s0": "SELECT *, price - (SELECT avg(price) FROM it) AS r FROM it"}
    for t in range(STUMPS):
        out[f"b{t}"] = _best_stump_sql(f"s{t}", "r", "1", 1)
        value = f"[{', '.join(X)}][i + 1] <= threshold"
        out[f"s{t + 1}"] = f"SELECT s{t}.* EXCLUDE (r), r - CAST(0.3 AS DOUBLE) * CASE WHEN {value} THEN lv ELSE rv END AS r FROM s{t}, b{t}"
    return out


@query("boosting_stumps", " UNION ALL ".join(_stump_row(t, f"b{t}", "CAST(n AS BIGINT)") for t in range(STUMPS)), extra=_boosting_sql())
def boosting_stumps(spark, sf_dir):
    """Rounds of boosted single splits with squared loss; the oracle follows the residuals."""
    return _stumps_frame(spark, TR.gradient_boosting_regressor(items(spark, sf_dir), X, "price", rounds=STUMPS, rate=0.3, max_depth=1, loss="squared", key="row_id"))


@query("rbf_ridge")
def rbf_ridge(spark, sf_dir):
    df = items(spark, sf_dir)
    df = PR.standard_scale(df, X).transform(df)
    return final(KE.rbf_ridge(df, X, "price", "row_id", landmarks=100, gamma=0.1).transform(df).select("row_id", "prediction"), 4)


@query("rbf_logistic")
def rbf_logistic(spark, sf_dir):
    df = items(spark, sf_dir)
    df = PR.standard_scale(df, X).transform(df)
    m = KE.rbf_logistic(df, X, "y", "row_id", landmarks=100, gamma=0.1)
    return final(m.transform(df, ("p_A", "p_D", "p_H")).select("row_id", "p_A", "p_D", "p_H"), 3)


# -- tree sums ---------------------------------------------------------------------


def _stump_sql(src):
    parts = []
    for i, x in enumerate(X):
        parts.append(f"""SELECT {i} AS feature, v, lead(v) OVER (ORDER BY v) AS nv, sum(n) OVER (ORDER BY v) AS nl, sum(s) OVER (ORDER BY v) AS sl,
  sum(n) OVER () AS n, sum(s) OVER () AS s FROM (SELECT {x} AS v, count(*) AS n, sum({src}) AS s FROM lineitem GROUP BY 1)""")
    return " UNION ALL ".join(parts)


@query("figs_first_split", """
SELECT ['l_quantity', 'l_discount', 'l_tax'][feature + 1] AS feature, round((v + nv) / 2, 9) AS threshold, round(gain, 4) AS gain FROM (
  SELECT *, sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n AS gain FROM st WHERE nv IS NOT NULL) ORDER BY gain DESC, feature, v LIMIT 1""",
       extra={"st": _stump_sql("l_extendedprice / 10000.0")})
def figs_first_split(spark, sf_dir):
    df = items(spark, sf_dir)
    h = FG.figs_regressor(df, X, "price", max_rules=1).history[0]
    return df.limit(1).select(F.lit(h["feature"]).alias("feature"), F.round(F.lit(h["threshold"]), 9).alias("threshold"), F.round(F.lit(h["gain"]), 4).alias("gain"))


@query("figs_fit")
def figs_fit(spark, sf_dir):
    df = items(spark, sf_dir)
    m = FG.figs_regressor(df, X, "price", max_rules=12, max_trees=5, backfit=True)
    return final(m.predict(df).select("row_id", "prediction"), 6)


@query("figs_classify")
def figs_classify(spark, sf_dir):
    df = items(spark, sf_dir)
    m = FG.figs_classifier(df, X, "y", max_rules=12, max_trees=5, class_weight="balanced", backfit=True)
    return final(m.predict_proba(df, ("p_A", "p_D", "p_H")).select("row_id", "p_A", "p_D", "p_H"), 6)


@query("figs_rules")
def figs_rules(spark, sf_dir):
    m = FG.figs_regressor(items(spark, sf_dir), X, "price", max_rules=12, max_trees=5)
    return final(m.rules_frame(spark), 6)


@query("cart_best_first")
def cart_best_first(spark, sf_dir):
    df = items(spark, sf_dir)
    m = FG.cart_best_first(df, X, "y", [0, 1, 2], max_rules=12)
    return final(m.leaf_shares(df, ("p_A", "p_D", "p_H")).select("row_id", "p_A", "p_D", "p_H"), 6)


WIDE = [f"e{i}" for i in range(64)]


@query("figs_wide")
def figs_wide(spark, sf_dir):
    """Twelve rules over 64 features whose values hardly repeat."""
    v = vectors(spark, sf_dir)
    df = v.select("id", F.col("label").cast("double").alias("target"), *[F.get("vector", F.lit(i)).alias(x) for i, x in enumerate(WIDE)])
    m = FG.figs_regressor(df, WIDE, "target", max_rules=12, max_trees=5, backfit=True)
    return final(m.predict(df).select("id", "prediction"), 6)


# -- calibration ---------------------------------------------------------------------


def market(spark, sf_dir):
    df = forecasts(spark, sf_dir).where(F.col("model") == "market")
    return df.select("match_id", "actual", "goal_margin", "p_A", "p_D", "p_H")


OUT = ("c_A", "c_D", "c_H")


@query("platt_calibrate")
def platt_calibrate(spark, sf_dir):
    df = market(spark, sf_dir)
    return final(CA.platt_calibrate(df).transform(df, names=OUT).select("match_id", *OUT), 4)


def _iso_sql(p, y):
    """Pool-adjacent-violators as max over starts of min over ends of block means."""
    return f"""SELECT v, max(lo) AS fit FROM (SELECT j.i AS j, k.v, min((e.cy - j.cy0) / (e.cn - j.cn0)) AS lo
FROM g_{y} j JOIN g_{y} k ON j.i <= k.i JOIN g_{y} e ON e.i >= k.i GROUP BY 1, 2) GROUP BY 1"""


def _iso_groups(p, y):
    return f"""SELECT v, row_number() OVER (ORDER BY v) AS i, sum(n) OVER (ORDER BY v) AS cn, sum(s) OVER (ORDER BY v) AS cy,
  sum(n) OVER (ORDER BY v) - n AS cn0, sum(s) OVER (ORDER BY v) - s AS cy0
FROM (SELECT round({p}, 12) AS v, count(*) AS n, sum({y}) AS s FROM lc WHERE model = 'market' GROUP BY 1)"""


ISO = {**LOSS, **{f"g_{y}": _iso_groups(p, y) for p, y in (("pa", "y1"), ("pd", "y2"), ("ph", "y3"))},
       **{f"f_{y}": _iso_sql(p, y) for p, y in (("pa", "y1"), ("pd", "y2"), ("ph", "y3"))}}


@query("isotonic_calibrate", """
SELECT match_id, round(a / (a + d + h), 6) AS "c_A", round(d / (a + d + h), 6) AS "c_D", round(h / (a + d + h), 6) AS "c_H" FROM (
  SELECT match_id, greatest(f1.fit, 1e-12) AS a, greatest(f2.fit, 1e-12) AS d, greatest(f3.fit, 1e-12) AS h
  FROM lc JOIN f_y1 f1 ON f1.v = round(pa, 12) JOIN f_y2 f2 ON f2.v = round(pd, 12) JOIN f_y3 f3 ON f3.v = round(ph, 12) WHERE model = 'market')""", "m", ISO)
def isotonic_calibrate(spark, sf_dir):
    df = market(spark, sf_dir)
    df = df.withColumns({x: F.round(x, 12) for x in ("p_A", "p_D", "p_H")})
    return final(CA.isotonic_calibrate(df).transform(df, names=OUT).select("match_id", *OUT), 6)


@query("phase_calibrate")
def phase_calibrate(spark, sf_dir):
    df = market(spark, sf_dir).withColumn("snapshot_minute", (F.col("match_id") % 19) * 5)
    return final(CA.phase_calibrate(df).transform(df, names=OUT).select("match_id", "snapshot_minute", *OUT), 4)


@query("margin_to_probs")
def margin_to_probs(spark, sf_dir):
    df = market(spark, sf_dir).withColumn("prediction", (F.col("p_H") - F.col("p_A")) * 5)
    return final(CA.margin_to_probs(df).transform(df, names=OUT).select("match_id", *OUT), 4)


# -- selection -------------------------------------------------------------------------


def _labelled(spark, sf_dir):
    df = market(spark, sf_dir)
    m = A.matches(spark, sf_dir).select("match_id", "clean_date", "season_name", "b365h", "b365d", "b365a")
    return df.join(m, "match_id").withColumn("y", CA.class_number("actual"))


def _logistic(train, columns, c):
    return LI.multinomial_logistic(train, columns, "y", c, max_iter=50, tol=1e-6)


def _figs(train, columns, max_rules):
    model = FG.figs_classifier(train, columns, "y", [0, 1, 2], max_rules=max_rules, max_trees=3)
    model.transform = model.predict_proba
    return model


ODDS = ["b365h", "b365d", "b365a"]


@query("model_sweep")
def model_sweep(spark, sf_dir):
    df = _labelled(spark, sf_dir).persist()
    train, test = df.where(F.col("season_name") < "1999"), df.where(F.col("season_name") == "1999")
    specs = [*SW.expand("logistic", _logistic, ODDS, {"c": [0.1, 1.0]}, "market"), *SW.expand("tree_sum", _figs, ODDS, {"max_rules": [2, 3]}, "market")]
    return final(SW.model_sweep(train, test, specs, ["match_id", "actual"])[1], 5)


@query("margin_sweep")
def margin_sweep(spark, sf_dir):
    df = _labelled(spark, sf_dir).persist()
    train, test = df.where(F.col("season_name") < "1999"), df.where(F.col("season_name") == "1999")
    fit = lambda t, cols, alpha: LI.ridge(t, cols, "goal_margin", alpha)
    specs = SW.expand("ridge", fit, ODDS, {"alpha": [3.0, 30.0]}, "market")
    return final(SW.margin_sweep(train, test, specs, ["match_id", "goal_margin"])[0], 5)


@query("grid_search")
def grid_search(spark, sf_dir):
    df = FO.fold_members(FO.with_block(_labelled(spark, sf_dir), 2), 2).persist()
    specs = SW.expand("logistic", _logistic, ODDS, {"c": [0.1, 1.0]}, "market")
    return final(SW.grid_search(df, 2, specs, ["match_id", "actual"]), 5)


# -- neighbors and resampling -------------------------------------------------------------


def vectors(spark, sf_dir):
    return A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


@query("exact_knn", """
SELECT id, neighbor, CAST(rank AS BIGINT) AS rank, round(d, 6) AS distance FROM (
  SELECT a.vec_id AS id, b.vec_id AS neighbor, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), b.vec_id) AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 3""")
def exact_knn(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return final(NB.exact_knn(v, v, 3), 6)


def _shape(df):
    """Checks of synthetic rows that hold for any run."""
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.min(F.size("vector")).alias("dimension"),
                                   F.count_if((F.col("share") < 0) | (F.col("share") >= 1)).alias("bad_share"),
                                   F.count_if(F.col("seed_id") == F.col("neighbor_id")).alias("self_pairs"))


def small_class(df):
    """The rarest label; ties go to the smaller one."""
    return df.groupBy("label").count().orderBy("count", "label").first()["label"]


SMOTE_SQL = """
SELECT label::BIGINT AS label, (SELECT max(n) FROM c) - n AS rows, 64 AS dimension, 0 AS bad_share, 0 AS self_pairs FROM c ORDER BY n, label LIMIT 1"""


@query("smote", SMOTE_SQL, extra={"c": "SELECT label, count(*) AS n FROM embeddings GROUP BY 1"})
def smote(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return final(_shape(RS.smote(v, "label", small_class(v))))


@query("borderline_smote", SMOTE_SQL, extra={"c": "SELECT label, count(*) AS n FROM embeddings GROUP BY 1"})
def borderline_smote(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return final(_shape(RS.borderline_smote(v, "label", small_class(v))))


@query("adasyn", SMOTE_SQL, extra={"c": "SELECT label, count(*) AS n FROM embeddings GROUP BY 1"})
def adasyn(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return final(_shape(RS.adasyn(v, "label", small_class(v))))


# All synthetic rows: neighbors, draws and interpolation as plain SQL.

NEAR_SQL = """SELECT a.vec_id AS id, b.vec_id AS neighbor, b.label AS other, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.label = (SELECT label FROM c ORDER BY n, label LIMIT 1)"""
SYNTHETIC = {
    "c": "SELECT label, count(*) AS n FROM embeddings GROUP BY 1",
    "z": "SELECT label, n, (SELECT max(n) FROM c) - n AS samples FROM c ORDER BY n, label LIMIT 1",
    "nr": NEAR_SQL,
    "nk": "SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, neighbor) AS rank FROM nr, z WHERE other = label QUALIFY rank <= 3",
}
EVEN = """SELECT *, sum(k) OVER (ORDER BY id) - k AS first FROM (SELECT id, samples // count(*) OVER () + CASE WHEN row_number() OVER (ORDER BY id) <= samples % count(*) OVER () THEN 1 ELSE 0 END AS k FROM {src}, z)"""
DRAWN = f"""SELECT sample, id, rank, {_uniform_sql(44, 'sample')} AS share FROM (
  SELECT id, CAST(unnest(range(CAST(first AS BIGINT), CAST(first + k AS BIGINT))) AS BIGINT) AS sample FROM sd) JOIN (SELECT id, max(rank) AS have FROM nk GROUP BY id) USING (id), LATERAL (SELECT floor({_uniform_sql(43, 'sample')} * have) + 1 AS rank)"""
SYNTHETIC_SQL = """SELECT sample, r.id AS seed_id, neighbor AS neighbor_id, round(share, 9) AS share, (SELECT label FROM z)::BIGINT AS label,
  round(a.embedding[1] + share * (b.embedding[1]::DOUBLE - a.embedding[1]), 6) AS first_value,
  round(list_sum([i * (a.embedding[i] + share * (b.embedding[i]::DOUBLE - a.embedding[i])) FOR i IN range(1, 65)]), 4) AS weighted_sum
FROM dr r JOIN nk ON nk.id = r.id AND nk.rank = r.rank JOIN embeddings a ON a.vec_id = r.id JOIN embeddings b ON b.vec_id = nk.neighbor"""


def _rows(df):
    """Synthetic rows with the first value and a weighted sum of their vectors."""
    places = F.sequence(F.lit(1), F.size("vector"))
    weighted = F.aggregate(F.zip_with("vector", places, lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    out = df.select("sample", "seed_id", "neighbor_id", "share", F.col("label").cast("long").alias("label"), F.round(F.get("vector", F.lit(0)), 6).alias("first_value"), F.round(weighted, 4).alias("weighted_sum"))
    return final(out)


@query("smote_rows", SYNTHETIC_SQL, extra={**SYNTHETIC, "mn": "SELECT vec_id AS id FROM embeddings JOIN z USING (label)", "sd": EVEN.format(src="mn"), "dr": DRAWN})
def smote_rows(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return _rows(RS.smote(v, "label", small_class(v)))


@query("borderline_smote_rows", SYNTHETIC_SQL, extra={
    **SYNTHETIC, "dg": """SELECT id FROM (SELECT id, other <> label AS differs FROM nr, z QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, neighbor) <= 10)
GROUP BY id HAVING 2 * count_if(differs) >= count(*) AND count_if(differs) < count(*)""", "sd": EVEN.format(src="dg"), "dr": DRAWN})
def borderline_smote_rows(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return _rows(RS.borderline_smote(v, "label", small_class(v)))


@query("adasyn_rows", SYNTHETIC_SQL, extra={
    **SYNTHETIC, "sh": """SELECT id, avg(CAST(differs AS INTEGER)) AS share FROM (SELECT id, other <> label AS differs FROM nr, z QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, neighbor) <= 3) GROUP BY id""",
    "sd": """SELECT id, round((upto - share) * f) AS first, round(upto * f) - round((upto - share) * f) AS k FROM (
  SELECT *, sum(share) OVER (ORDER BY id) AS upto, samples / sum(share) OVER () AS f FROM sh, z)""", "dr": DRAWN})
def adasyn_rows(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return _rows(RS.adasyn(v, "label", small_class(v)))


@query("hashed_knn", """
SELECT id, neighbor, CAST(rank AS BIGINT) AS rank, round(d, 6) AS distance FROM (
  SELECT a.vec_id AS id, b.vec_id AS neighbor, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), b.vec_id) AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 3""")
def hashed_knn(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return final(HN.hashed_knn(v, v, 3), 6)


# -- attribution ----------------------------------------------------------------------------


def _attribution(spark, sf_dir):
    df = _labelled(spark, sf_dir)
    model = TR.random_forest_regressor(df, ODDS, "goal_margin", key="match_id")
    return df, model, AT.tree_attribution(df, model, "match_id")


ODDS_STUMP = " UNION ALL ".join(f"SELECT {i} AS i, b365{x} AS v, count(*) AS n, CAST(sum(greatest(least(home_score - away_score, 5), -5)) AS DOUBLE) AS s FROM m GROUP BY 2" for i, x in enumerate("hda"))


@query("stump_attribution", """
SELECT match_id AS row_key, 0::BIGINT AS output, ['b365h', 'b365d', 'b365a'][f.i + 1] AS feature, round([b365h, b365d, b365a][f.i + 1], 6) AS feature_value,
  round(CASE WHEN f.i <> b.i THEN 0 WHEN [b365h, b365d, b365a][f.i + 1] <= threshold THEN lv - mean ELSE rv - mean END, 6) AS contribution, round(mean, 6) AS base
FROM m, bs b, (SELECT unnest([0, 1, 2]) AS i) f""", "m", {
    "st": ODDS_STUMP,
    "bs": """SELECT i, (v + nv) / 2 AS threshold, sl / nl AS lv, (s - sl) / (n - nl) AS rv, s / n AS mean FROM (
  SELECT i, v, lead(v) OVER (PARTITION BY i ORDER BY v) AS nv, sum(n) OVER (PARTITION BY i ORDER BY v) AS nl, sum(s) OVER (PARTITION BY i ORDER BY v) AS sl,
    sum(n) OVER (PARTITION BY i) AS n, sum(s) OVER (PARTITION BY i) AS s FROM st)
  WHERE nv IS NOT NULL AND nl >= 3 AND n - nl >= 3 ORDER BY sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n DESC, i, v LIMIT 1"""})
def stump_attribution(spark, sf_dir):
    """Shapley values of a single split: the split feature takes the leaf's difference from the mean."""
    df = _labelled(spark, sf_dir)
    model = EN.random_forest(df, ODDS, "goal_margin", "match_id", trees=1, max_depth=1, bootstrap=False)
    return final(AT.tree_attribution(df, model, "match_id"), 6)


@query("class_attribution", "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(0 AS DOUBLE) AS largest_gap FROM orders")
def class_attribution(spark, sf_dir):
    """Shapley values per class of a forest add up to its probabilities minus the base."""
    df = _labelled(spark, sf_dir)
    model = TR.random_forest_classifier(df, ODDS, "y", key="match_id", classes=3)
    attr = AT.tree_attribution(df, model, "match_id")
    total = attr.groupBy("row_key").pivot("output", [0, 1, 2]).agg((F.sum("contribution") + F.max("base")).alias("p"))
    both = total.join(model.transform(df, OUTCOMES).select(F.col("match_id").alias("row_key"), *OUTCOMES), "row_key")
    gap = F.greatest(*[F.abs(F.col(str(k)) - F.col(x)) for k, x in enumerate(OUTCOMES)])
    return final(both.agg(F.count(F.lit(1)).alias("rows"), F.max(gap).alias("largest_gap")), 6)


@query("tree_attribution", "SELECT count(*) AS rows, CAST(0 AS DOUBLE) AS largest_gap FROM orders")
def tree_attribution(spark, sf_dir):
    """Shapley values of each row must add up to its prediction minus the base."""
    df, model, attr = _attribution(spark, sf_dir)
    total = attr.groupBy("row_key").agg(F.sum("contribution").alias("c"), F.max("base").alias("base"))
    pred = model.transform(df).select(F.col("match_id").alias("row_key"), "prediction")
    gap = F.abs(F.col("prediction") - F.col("base") - F.col("c"))
    return final(total.join(pred, "row_key").agg(F.count(F.lit(1)).alias("rows"), F.max(gap).alias("largest_gap")), 6)


@query("global_attribution")
def global_attribution(spark, sf_dir):
    return final(AT.global_attribution(_attribution(spark, sf_dir)[2]), 6)


@query("local_attribution")
def local_attribution(spark, sf_dir):
    return final(AT.local_attribution(_attribution(spark, sf_dir)[2]).select("row_key", "feature", "contribution", "rank"), 6)


@query("attribution_timeline")
def attribution_timeline(spark, sf_dir):
    """Top feature per snapshot minute (minutes derived from the match id)."""
    attr = _attribution(spark, sf_dir)[2].withColumn("snapshot_minute", (F.col("row_key") % 19) * 5)
    return final(AT.top_feature_timeline(attr, "snapshot_minute"), 6)
