"""Projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from ..functions import columns as C, constants as K
from ..operators import events as E, history as H, relate as R
from ..sources import adapters as A, tables as TB
from .registry import final, query

PAIRS = (("location_x", "location_y"), ("pass_end_x", "pass_end_y"))
# Start points moved so that some lie just outside and some far outside the pitch.
SHIFTED_SQL = """
SELECT match_id, id, location_x + (id % 7) * 0.5 - 1 AS location_x, location_y - (id % 5) * 0.25 AS location_y,
  pass_end_x, pass_end_y FROM e"""


def zone_sql(x, y):
    return f"CAST(least(floor({x} / 30), 3) + 4 * least(floor({y} / 16), 4) AS INTEGER)"


ZONED_SQL = f"""
SELECT *, CASE WHEN location_x IS NOT NULL THEN {zone_sql('location_x', 'location_y')} END AS start_zone,
  CASE WHEN coalesce(pass_end_x, location_x) IS NOT NULL THEN
    {zone_sql('coalesce(pass_end_x, location_x)', 'coalesce(pass_end_y, location_y)')} END AS end_zone FROM e"""


def shifted(spark, sf_dir):
    k = F.col("id")
    return A.events(spark, sf_dir).withColumns({
        "location_x": F.col("location_x") + (k % 7) * F.lit(0.5) - 1,
        "location_y": F.col("location_y") - (k % 5) * F.lit(0.25),
    })


@query("extract_xy", """
SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 9) AS x, round(CAST(embedding[2] AS DOUBLE), 9) AS y,
  CAST(NULL AS DOUBLE) AS beyond FROM embeddings""")
def extract_xy(spark, sf_dir):
    t = A.table(spark, sf_dir, "embeddings")
    return final(t.select("vec_id", C.extract_xy("embedding", 0).alias("x"), C.extract_xy("embedding", 1).alias("y"),
                          C.extract_xy("embedding", 1000).alias("beyond")))


@query("exact_clock", """
SELECT id, CAST(60 * (floor(t / 60)) + floor(t) % 60 AS DOUBLE) AS event_seconds,
  round(floor(t) + CASE WHEN id % 10 = 0 THEN 0 ELSE (id % 3) * 0.001 END, 6) AS event_seconds_exact,
  round((floor(t) + CASE WHEN id % 10 = 0 THEN 0 ELSE (id % 3) * 0.001 END) / 60, 6) AS event_minute_decimal FROM e""", "e")
def exact_clock(spark, sf_dir):
    """Minute, second and clock text; every tenth clock text is unreadable."""
    whole = F.floor("t")
    clock = F.concat(F.lit("00:"), F.lpad((F.floor(whole / 60) % 60).cast("string"), 2, "0"), F.lit(":"),
                     F.lpad((whole % 60).cast("string"), 2, "0"), F.lit(".00"), (F.col("id") % 3).cast("string"))
    ev = A.events(spark, sf_dir).select(
        "id", F.floor(whole / 60).alias("minute"), (whole % 60).alias("second"),
        F.when(F.col("id") % 10 == 0, "unknown").otherwise(clock).alias("timestamp"))
    return final(ev.select("id", *[v.alias(k) for k, v in C.exact_clock("minute", "second", "timestamp").items()]), 6)


@query("align_schema", "SELECT o_orderkey AS match_id, CAST(NULL AS VARCHAR) AS kick_off, o_totalprice AS price FROM orders")
def align_schema(spark, sf_dir):
    t = A.table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("match_id"), "o_orderpriority")
    return TB.align_schema(t, T.StructType().add("match_id", "long").add("kick_off", "string").add("price", "double"))


@query("standardize_types", """
SELECT CAST(o_orderkey AS BIGINT) AS match_id, TRY_CAST(split_part(o_orderpriority, '-', 1) AS DOUBLE) AS level,
  TRY_CAST(CASE WHEN o_orderkey % 4 = 0 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS DOUBLE) AS team_number FROM orders""")
def standardize_types(spark, sf_dir):
    t = A.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("match_id"),
        F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).alias("level"),
        F.when(F.col("o_orderkey") % 4 == 0, "n/a").otherwise(F.col("o_custkey").cast("string")).alias("team_number"))
    return TB.standardize_types(t, {"match_id": "long"}, {"level": "double", "team_number": "double"})


def _report_sql(x, y):
    over = lambda m: f"({x} < -{m} OR {x} > 120 + {m} OR {y} < -{m} OR {y} > 80 + {m})"
    return f"""SELECT '{x}' AS x_column, '{y}' AS y_column, count(*) AS rows,
  count(*) FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL) AS present,
  count(*) FILTER (WHERE {over(0)}) AS overflow, count(*) FILTER (WHERE {over(1)}) AS beyond_tolerance FROM s"""


@query("validate_coordinates", " UNION ALL ".join(_report_sql(*p) for p in PAIRS), "e", {"s": SHIFTED_SQL})
def validate_coordinates(spark, sf_dir):
    return final(E.coordinate_report(shifted(spark, sf_dir), PAIRS))


@query("clip_coordinates", """
SELECT id, round(CASE WHEN location_x IS NOT NULL THEN greatest(least(location_x, 120), 0) END, 9) AS location_x,
  round(CASE WHEN location_y IS NOT NULL THEN greatest(least(location_y, 80), 0) END, 9) AS location_y,
  round(pass_end_x, 9) AS pass_end_x, round(pass_end_y, 9) AS pass_end_y FROM s""", "e", {"s": SHIFTED_SQL})
def clip_coordinates(spark, sf_dir):
    df = E.clip_coordinates(shifted(spark, sf_dir), PAIRS, strict=False)
    return final(df.select("id", "location_x", "location_y", "pass_end_x", "pass_end_y"))


@query("zones", "SELECT match_id, id, CAST(start_zone AS DOUBLE) AS start_zone, CAST(end_zone AS DOUBLE) AS end_zone FROM z", "e", {"z": ZONED_SQL})
def zones(spark, sf_dir):
    z = E.add_zones(A.events(spark, sf_dir))
    return z.select("match_id", "id", F.col("start_zone").cast("double").alias("start_zone"), F.col("end_zone").cast("double").alias("end_zone"))


@query("zones_lenient", f"""
SELECT id, CAST(CASE WHEN location_x BETWEEN 0 AND 120 AND location_y BETWEEN 0 AND 80
  THEN {zone_sql('location_x', 'location_y')} END AS DOUBLE) AS zone FROM s""", "e", {"s": SHIFTED_SQL})
def zones_lenient(spark, sf_dir):
    return shifted(spark, sf_dir).select("id", C.zone_id("location_x", "location_y", strict=False).cast("double").alias("zone"))


@query("targets", """
SELECT match_id, season_name, clean_date, home_score, away_score,
  CAST(greatest(least(home_score - away_score, 5), -5) AS BIGINT) AS goal_margin,
  CASE WHEN home_score > away_score THEN 'H' WHEN home_score < away_score THEN 'A' ELSE 'D' END AS outcome FROM m""", "m")
def targets(spark, sf_dir):
    return final(R.targets(A.matches(spark, sf_dir)))


MARKET_SQL = """
SELECT *, 1 / b365h AS ih, 1 / b365d AS idr, 1 / b365a AS ia, 1 / b365h + 1 / b365d + 1 / b365a AS total,
  CASE WHEN home_score > away_score THEN 'H' WHEN home_score < away_score THEN 'A' ELSE 'D' END AS outcome,
  greatest(least(home_score - away_score, 5), -5) AS goal_margin FROM m"""


@query("devig_odds", """
SELECT match_id, round(ih, 9) AS "implied_H", round(idr, 9) AS "implied_D", round(ia, 9) AS "implied_A",
  round(total, 9) AS bookie_margin, round(ih / total, 9) AS "market_prob_H", round(idr / total, 9) AS "market_prob_D",
  round(ia / total, 9) AS "market_prob_A" FROM k""", "m", {"k": MARKET_SQL})
def devig_odds(spark, sf_dir):
    df = R.add_market(A.matches(spark, sf_dir))
    return final(df.select("match_id", "implied_H", "implied_D", "implied_A", "bookie_margin",
                           "market_prob_H", "market_prob_D", "market_prob_A"))


@query("alias_lookup", """
SELECT n_nationkey, n_name, CASE n_nationkey % 3 WHEN 0 THEN 'Ath Bilbao' WHEN 1 THEN 'Celta' ELSE 'Sociedad' END AS odds_home_team
FROM nation""")
def alias_lookup(spark, sf_dir):
    source = F.element_at(F.array(F.lit("Athletic Club"), F.lit("Celta Vigo"), F.lit("Real Sociedad")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    t = A.table(spark, sf_dir, "nation").select(F.col("n_nationkey"), "n_name", source.alias("home_team"))
    return R.alias_lookup(t, R.alias_table(spark), {"home_team": "odds_home_team"}).drop("home_team")


@query("calendar_features", """
SELECT match_id, round(sin(2 * pi() * dayofyear(clean_date) / 365.25), 9) AS calendar_sin,
  round(cos(2 * pi() * dayofyear(clean_date) / 365.25), 9) AS calendar_cos,
  round(CAST(match_id % 38 + 1 AS DOUBLE) / 38, 9) AS season_progress FROM m""", "m")
def calendar_features(spark, sf_dir):
    df = A.matches(spark, sf_dir).withColumn("match_week", F.col("match_id") % 38 + 1)
    return final(df.select("match_id", *[v.alias(k) for k, v in C.calendar("clean_date", "match_week").items()]))


ROLES = dict(final_season="2001", train_end="1998-06-30", validation=("1998-07-01", "1998-12-31"),
             calibration=("1999-01-01", "1999-06-30"), pilot_start="1999-07-01")
ROLE_SQL = """
SELECT *, CASE WHEN season_name = '2001' THEN 'final_test' WHEN CAST(clean_date AS DATE) <= DATE '1998-06-30' THEN 'train'
  WHEN CAST(clean_date AS DATE) BETWEEN DATE '1998-07-01' AND DATE '1998-12-31' THEN 'validation'
  WHEN CAST(clean_date AS DATE) BETWEEN DATE '1999-01-01' AND DATE '1999-06-30' THEN 'calibration'
  ELSE 'pilot_holdout' END AS split_role FROM k"""


@query("split_roles", "SELECT match_id, split_role FROM r", "m", {"k": MARKET_SQL, "r": ROLE_SQL})
def split_roles(spark, sf_dir):
    return A.matches(spark, sf_dir).select("match_id", C.split_role("season_name", "clean_date", **ROLES).alias("split_role"))


@query("chronological_split", """
SELECT side, count(*) AS rows, CAST(min(d) AS VARCHAR) AS first_day, CAST(max(d) AS VARCHAR) AS last_day FROM (
  SELECT CAST(clean_date AS DATE) AS d, CASE WHEN CAST(clean_date AS DATE) < (SELECT CAST(clean_date AS DATE) FROM (
      SELECT clean_date, row_number() OVER (ORDER BY clean_date, match_id) AS rn, count(*) OVER () AS n FROM m)
    WHERE rn = floor(n * 0.8) + 1) THEN 'earlier' ELSE 'later' END AS side FROM m)
GROUP BY side""", "m")
def chronological_split(spark, sf_dir):
    df = H.chronological_split(A.matches(spark, sf_dir), 0.8).withColumn("d", F.to_date("clean_date"))
    return final(df.groupBy("side").agg(F.count(F.lit(1)).alias("rows"), F.min("d").cast("string").alias("first_day"), F.max("d").cast("string").alias("last_day")))


@query("season_filter", "SELECT match_id, season_name, home_team FROM m WHERE season_name IN ('1996', '1999')", "m")
def season_filter(spark, sf_dir):
    wanted = spark.createDataFrame([("1996",), ("1999",)], "season_name string")
    return R.season_filter(A.matches(spark, sf_dir), wanted, ["season_name"]).select("match_id", "season_name", "home_team")


CONCEPTS = (("steel", "metal"), ("brass", "metal"), ("copper", "metal"), ("tin", "metal"), ("nickel", "metal"),
            ("promo", "offer"), ("standard", "plain"))


@query("feature_concept", """
SELECT concept, count(*) AS features FROM (SELECT CASE
  WHEN contains(lower(p_type), 'steel') OR contains(lower(p_type), 'brass') OR contains(lower(p_type), 'copper')
    OR contains(lower(p_type), 'tin') OR contains(lower(p_type), 'nickel') THEN 'metal'
  WHEN contains(lower(p_type), 'promo') THEN 'offer' WHEN contains(lower(p_type), 'standard') THEN 'plain'
  ELSE 'other' END AS concept FROM part) GROUP BY concept""")
def feature_concept(spark, sf_dir):
    t = A.table(spark, sf_dir, "part").select(C.concept("p_type", CONCEPTS).alias("concept"))
    return t.groupBy("concept").agg(F.count(F.lit(1)).alias("features"))


@query("normalize_probs", """
SELECT l_orderkey, l_linenumber, round(l_quantity / s, 9) AS "p_A", round(l_tax / s, 9) AS "p_D", round(l_discount / s, 9) AS "p_H",
  round(greatest(least(l_quantity, 1), 1e-12) / s2, 9) AS "c_A", round(greatest(least(l_tax, 1), 1e-12) / s2, 9) AS "c_D",
  round(greatest(least(l_discount, 1), 1e-12) / s2, 9) AS "c_H"
FROM (SELECT *, l_quantity + l_tax + l_discount AS s,
  greatest(least(l_quantity, 1), 1e-12) + greatest(least(l_tax, 1), 1e-12) + greatest(least(l_discount, 1), 1e-12) AS s2 FROM lineitem)""")
def normalize_probs(spark, sf_dir):
    raw = ["l_quantity", "l_tax", "l_discount"]
    t = A.table(spark, sf_dir, "lineitem")
    p, q = C.checked_probabilities(raw), C.clipped_probabilities(raw)
    return final(t.select("l_orderkey", "l_linenumber", *[x.alias(f"p_{k}") for x, k in zip(p, K.CLASSES)],
                          *[x.alias(f"c_{k}") for x, k in zip(q, K.CLASSES)]))


@query("argmax_class", """
SELECT match_id, CASE WHEN ia >= idr AND ia >= ih THEN 'A' WHEN idr >= ih THEN 'D' ELSE 'H' END AS predicted FROM k""", "m", {"k": MARKET_SQL})
def argmax_class(spark, sf_dir):
    df = R.add_market(A.matches(spark, sf_dir))
    return df.select("match_id", C.argmax_class("implied_A", "implied_D", "implied_H").alias("predicted"))


@query("match_phase", """
SELECT id, CASE WHEN t / 60 <= 30 THEN 'early' WHEN t / 60 <= 60 THEN 'middle' ELSE 'late' END AS phase,
  round(t / 60 / 90, 9) AS match_fraction, CASE WHEN t / 60 < 45 THEN 1.0::DOUBLE ELSE 0 END AS phase_first_half,
  CASE WHEN t / 60 = 45 THEN 1.0::DOUBLE ELSE 0 END AS phase_halftime, CASE WHEN t / 60 >= 75 THEN 1.0::DOUBLE ELSE 0 END AS phase_late FROM e""", "e")
def match_phase(spark, sf_dir):
    ev = A.events(spark, sf_dir).withColumn("minute", F.col("t") / 60)
    return final(ev.select("id", C.match_phase("minute").alias("phase"), *[v.alias(k) for k, v in C.phase_flags("minute").items()]))


@query("safe_ratio", """
SELECT o_orderkey, round(CASE WHEN o_custkey % 5 > 0 THEN o_totalprice / (o_custkey % 5) END, 6) AS ratio FROM orders""")
def safe_ratio(spark, sf_dir):
    t = A.table(spark, sf_dir, "orders")
    return final(t.select("o_orderkey", C.safe_ratio("o_totalprice", F.col("o_custkey") % 5).alias("ratio")), 6)


CATALOGUE_SQL = """
SELECT match_id, clean_date, home_team, away_team, split_role FROM r
WHERE season_name = '1997' AND (contains(CAST(home_team AS VARCHAR), '1') OR contains(CAST(away_team AS VARCHAR), '1'))
  AND CAST(clean_date AS DATE) BETWEEN DATE '1997-03-01' AND DATE '1997-09-30' AND split_role = 'train'"""
CATALOGUE = {"k": MARKET_SQL, "r": ROLE_SQL, "cat": CATALOGUE_SQL}


def catalogue(spark, sf_dir):
    df = A.matches(spark, sf_dir).withColumn("split_role", C.split_role("season_name", "clean_date", **ROLES))
    return R.match_catalogue(df, season="1997", team="1", date_from="1997-03-01", date_to="1997-09-30", split="train").select(
        "match_id", "clean_date", "home_team", "away_team", "split_role")


@query("match_catalogue", "SELECT count(*) AS total FROM cat", "m", CATALOGUE)
def match_catalogue(spark, sf_dir):
    return catalogue(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"))


@query("catalogue_page", "SELECT * FROM cat ORDER BY clean_date, match_id LIMIT 20 OFFSET 40", "m", CATALOGUE)
def catalogue_page(spark, sf_dir):
    return R.page(catalogue(spark, sf_dir), 20, 40)
