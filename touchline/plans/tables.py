"""Scans, sinks, incremental loads, logs and quality checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import events as E, possession as PO, quality as Q, relate as R
from ..session import shared_folder
from ..sources import adapters as A, documents as D, tables as TB
from .histories import LONG, event_fixtures
from .registry import final, query
from .scalars import ZONED_SQL


def scratch(spark, name):
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("normalize_events", """
SELECT match_id, CAST(id AS VARCHAR) AS id, idx AS "index", CAST(period AS BIGINT) AS period, type, team, possession, possession_team,
  round(t, 6) AS event_seconds_exact, round(location_x, 9) AS location_x, round(location_y, 9) AS location_y,
  round(pass_end_x, 9) AS pass_end_x, pass_outcome, shot_outcome, round(shot_xg, 9) AS shot_xg FROM e""", "e")
def normalize_events(spark, sf_dir):
    """Events packed into nested documents as text, parsed and flattened again."""
    ev = A.events(spark, sf_dir)
    named = lambda x: F.when(F.col(x).isNotNull(), F.struct(F.lit(None).cast("long").alias("id"), F.col(x).alias("name")))
    whole = F.floor("t")
    clock = F.concat(F.lit("00:00:00.00"), (F.col("id") % 3).cast("string"))
    doc = F.struct(
        F.col("id").cast("string").alias("id"), F.col("idx").alias("index"), "period", clock.alias("timestamp"),
        F.floor(whole / 60).cast("int").alias("minute"), (whole % 60).cast("int").alias("second"),
        named("type").alias("type"), "possession", named("possession_team").alias("possession_team"), named("team").alias("team"),
        F.when(F.col("location_x").isNotNull(), F.array("location_x", "location_y")).alias("location"),
        F.when(F.col("type") == "Pass", F.struct(named("pass_outcome").alias("outcome"), F.array("pass_end_x", "pass_end_y").alias("end_location"))).alias("pass"),
        F.when(F.col("type") == "Shot", F.struct(F.col("shot_xg").alias("statsbomb_xg"), named("shot_outcome").alias("outcome"))).alias("shot"),
    )
    text = ev.select("match_id", F.to_json(doc).alias("doc"))
    parsed = text.select("match_id", F.from_json("doc", D.EVENT_DOCUMENT, {"mode": "FAILFAST"}).alias("d")).select("match_id", "d.*")
    flat = D.normalize_events(parsed, validate=False)
    flat = flat.withColumn("event_seconds_exact", F.round("event_seconds_exact", 6))
    return final(flat.select(
        "match_id", "id", "index", "period", "type", "team", "possession", "possession_team", "event_seconds_exact",
        "location_x", "location_y", "pass_end_x", "pass_outcome", "shot_outcome", "shot_xg"))


@query("normalize_lineups", """
SELECT c_custkey AS match_id, CAST(c_nationkey AS BIGINT) AS team_id, c_custkey * 2 + x.i AS player_id, c_name AS player,
  c_custkey % 99 AS jersey_number, c_mktsegment AS country, (c_custkey + x.i) % 3 = 0 AS starter
FROM customer, (VALUES (0), (1)) x(i)""")
def normalize_lineups(spark, sf_dir):
    """Each customer becomes a two-player lineup document."""
    c = A.table(spark, sf_dir, "customer")
    def player(i):
        reason = F.when((F.col("c_custkey") + i) % 3 == 0, "Starting XI").otherwise("Substitution")
        return F.struct(
            (F.col("c_custkey") * 2 + i).alias("player_id"), F.col("c_name").alias("player_name"), F.lit(None).cast("string").alias("player_nickname"),
            (F.col("c_custkey") % 99).cast("int").alias("jersey_number"),
            F.struct(F.lit(1).cast("long").alias("id"), F.col("c_mktsegment").alias("name")).alias("country"),
            F.array(F.struct(F.lit("Goalkeeper").alias("position"), reason.alias("start_reason"))).alias("positions"),
            F.array(F.struct(F.lit("Yellow Card").alias("card_type"))).alias("cards"))
    docs = c.select(F.col("c_custkey").alias("match_id"), F.col("c_nationkey").cast("long").alias("team_id"),
                    F.lit("t").alias("team_name"), F.array(player(0), player(1)).alias("lineup"))
    return final(D.normalize_lineups(docs).select("match_id", "team_id", "player_id", "player", "jersey_number", "country", "starter"))


@query("parse_odds", """
SELECT CAST(match_id AS VARCHAR) AS "HomeTeam", CAST(CAST(clean_date AS DATE) AS VARCHAR) AS clean_date, season_name, round(b365h, 9) AS "B365H" FROM m""", "m")
def parse_odds(spark, sf_dir):
    """Odds rows as text with two day-first date styles."""
    m = A.matches(spark, sf_dir)
    date = F.when(F.col("match_id") % 2 == 0, F.date_format("clean_date", "dd/MM/yy")).otherwise(F.date_format("clean_date", "dd/MM/yyyy"))
    raw = m.select(date.alias("Date"), F.col("match_id").cast("string").alias("HomeTeam"), F.col("away_team").cast("string").alias("AwayTeam"),
                   F.col("b365h").cast("string").alias("B365H"), F.col("b365d").cast("string").alias("B365D"),
                   F.col("b365a").cast("string").alias("B365A"), F.lit("x").alias("Referee"))
    odds = TB.parse_odds(raw, "all").withColumn("season_name", F.year("clean_date").cast("string"))
    return final(odds.select("HomeTeam", F.col("clean_date").cast("string").alias("clean_date"), "season_name", "B365H"))


@query("read_odds_csv", """
SELECT CAST(CAST(clean_date AS DATE) AS VARCHAR) AS clean_date, CAST(match_id AS VARCHAR) AS "HomeTeam", round(b365d, 9) AS "B365D" FROM m""", "m")
def read_odds_csv(spark, sf_dir):
    m = A.matches(spark, sf_dir)
    path = scratch(spark, "odds")
    TB.write_csv(m.select(F.date_format("clean_date", "dd/MM/yyyy").alias("Date"), F.col("match_id").alias("HomeTeam"),
                          F.col("away_team").alias("AwayTeam"), F.col("b365h").alias("B365H"), F.col("b365d").alias("B365D"),
                          F.col("b365a").alias("B365A")), path)
    return final(TB.read_odds_csv(spark, path, "all").select(F.col("clean_date").cast("string").alias("clean_date"), "HomeTeam", "B365D"))


@query("read_matches", """
SELECT match_id, CAST(CAST(clean_date AS DATE) AS VARCHAR) AS match_date, season_name, home_team, away_team, home_score FROM m""", "m")
def read_matches(spark, sf_dir):
    m = A.matches(spark, sf_dir).withColumn("match_date", F.col("clean_date"))
    df = TB.read_matches(m).withColumn("match_date", F.col("match_date").cast("string"))
    return final(df.select("match_id", "match_date", "season_name", "home_team", "away_team", "home_score"))


@query("table_roundtrip", "SELECT match_id, home_team, home_score FROM m WHERE season_name = '1998'", "m")
def table_roundtrip(spark, sf_dir):
    """Parquet sink partitioned by season; the read prunes to one partition."""
    path = scratch(spark, "matches")
    TB.write_table(A.matches(spark, sf_dir), path, ["season_name"])
    return TB.read_table(spark, path).where(F.col("season_name") == "1998").select("match_id", "home_team", "home_score")


@query("json_roundtrip", "SELECT season_name, count(*) AS matches, CAST(sum(home_score) AS BIGINT) AS goals FROM m GROUP BY 1", "m")
def json_roundtrip(spark, sf_dir):
    path = scratch(spark, "season")
    m = A.matches(spark, sf_dir)
    TB.write_json(m.groupBy("season_name").agg(F.count(F.lit(1)).alias("matches"), F.sum("home_score").alias("goals")), path)
    return spark.read.schema("season_name string, matches long, goals long").json(path)


@query("append_missing", "SELECT match_id, home_score FROM m", "m")
def append_missing(spark, sf_dir):
    """A store that holds two thirds of the matches, completed by an append."""
    path = scratch(spark, "store")
    m = A.matches(spark, sf_dir).select("match_id", "home_score")
    TB.write_table(m.where(F.col("match_id") % 3 != 0), path)
    TB.append_missing(m, TB.read_table(spark, path), path, ["match_id"])
    return TB.read_table(spark, path)


@query("union_seasons", """
SELECT match_id, CASE WHEN season_name = '1995' THEN CAST(home_score AS DOUBLE) END AS first_score,
  CASE WHEN season_name = '1996' THEN CAST(away_score AS DOUBLE) END AS second_score
FROM m WHERE season_name IN ('1995', '1996')""", "m")
def union_seasons(spark, sf_dir):
    m = A.matches(spark, sf_dir)
    one = m.where(F.col("season_name") == "1995").select("match_id", F.col("home_score").cast("double").alias("first_score"))
    two = m.where(F.col("season_name") == "1996").select("match_id", F.col("away_score").cast("double").alias("second_score"))
    return TB.union_seasons([one, two])


@query("union_all_seasons", """
SELECT match_id, CASE WHEN CAST(season_name AS BIGINT) % 2 = 1 THEN CAST(home_score AS DOUBLE) END AS first_score,
  CASE WHEN CAST(season_name AS BIGINT) % 2 = 0 THEN CAST(away_score AS DOUBLE) END AS second_score
FROM m""", "m")
def union_all_seasons(spark, sf_dir):
    """Every season, odd years with one set of columns and even years with the other."""
    m = A.matches(spark, sf_dir)
    odd = F.col("season_name").cast("long") % 2 == 1
    one = m.where(odd).select("match_id", F.col("home_score").cast("double").alias("first_score"))
    two = m.where(~odd).select("match_id", F.col("away_score").cast("double").alias("second_score"))
    return TB.union_seasons([one, two])


LOG_SQL = """
SELECT coalesce(a.match_id, b.match_id) AS match_id,
  CASE WHEN a.match_id IS NULL THEN 'unexpected' WHEN b.n IS NULL THEN 'failed' ELSE 'success' END AS status, coalesce(b.n, 0) AS events
FROM (SELECT o_orderkey AS match_id FROM orders) a FULL JOIN (SELECT match_id, count(*) AS n FROM e GROUP BY 1) b ON a.match_id = b.match_id"""


def _log(spark, sf_dir):
    need = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("match_id"))
    ev = A.table(spark, sf_dir, "events").select(F.col("user_id").alias("match_id"))
    return TB.ingestion_log(need, ev)


@query("ingestion_log", LOG_SQL, "e")
def ingestion_log(spark, sf_dir):
    return final(_log(spark, sf_dir))


@query("ingestion_coverage", """
SELECT count(*) FILTER (WHERE status <> 'unexpected') AS required, count(*) FILTER (WHERE status = 'success') AS covered,
  round(100.0 * count(*) FILTER (WHERE status = 'success') / count(*) FILTER (WHERE status <> 'unexpected'), 9) AS coverage_pct FROM lg""",
       "e", {"lg": LOG_SQL})
def ingestion_coverage(spark, sf_dir):
    return final(TB.coverage(_log(spark, sf_dir)))


# Columns of the shared tables: i whole numbers, s texts, d numbers with fractions, t times, f lists of numbers.
COLUMNS = {
    "benchmark": "item_id:i text:s",
    "conversations": "conv_id:i turn:i role:s text:s",
    "customer": "c_custkey:i c_name:s c_nationkey:i c_acctbal:d c_mktsegment:s",
    "documents": "doc_id:i text:s lang:s source:s n_chars:i",
    "embeddings": "vec_id:i embedding:f label:i",
    "events": "event_id:i ts:t user_id:i event_type:s value:d props:s",
    "labels": "doc_id:i quality:i toxic:i",
    "lineitem": "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:d l_extendedprice:d l_discount:d l_tax:d l_returnflag:s l_linestatus:s l_shipdate:t",
    "nation": "n_nationkey:i n_name:s n_regionkey:i",
    "orders": "o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:d o_orderdate:t o_orderpriority:s",
    "pages": "page_id:i url:s html:s",
    "part": "p_partkey:i p_name:s p_brand:s p_type:s p_size:i p_retailprice:d",
    "region": "r_regionkey:i r_name:s",
    "supplier": "s_suppkey:i s_name:s s_nationkey:i s_acctbal:d",
}
ALL_TABLES = tuple(COLUMNS)


def _manifest_sql():
    told = {
        "i": "CAST({} AS VARCHAR)", "s": "{}", "d": "CAST(CAST(round({} * 1000000) AS BIGINT) AS VARCHAR)", "t": "CAST(epoch_us({}) AS VARCHAR)",
        "f": "array_to_string([coalesce(CAST(CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT) AS VARCHAR), 'n') FOR x IN {}], ',')"}
    parts = []
    for table, columns in COLUMNS.items():
        texts = [f"coalesce('v' || {told[c.split(':')[1]].format(c.split(':')[0])}, 'n')" for c in columns.split()]
        digest = f"CAST('0x' || substr(md5(concat_ws(chr(31), {', '.join(texts)})), 1, 15) AS BIGINT)"
        parts.append(f"SELECT '{table}' AS table_name, count(*) AS rows, {len(texts)}::BIGINT AS columns, CAST(coalesce(sum(CAST({digest} AS HUGEINT)) % {TB.DIGEST_PRIME}, 0) AS BIGINT) AS digest FROM {table}")
    return " UNION ALL ".join(parts)


@query("table_manifest", _manifest_sql())
def table_manifest(spark, sf_dir):
    """Rows, columns and content digest of every table."""
    return TB.table_manifest({n: A.table(spark, sf_dir, n) for n in ALL_TABLES})


@query("table_manifest_all", _manifest_sql())
def table_manifest_all(spark, sf_dir):
    return table_manifest(spark, sf_dir)


# -- joins and set operations --------------------------------------------------

ODDS_SQL = "SELECT clean_date, home_team, away_team, b365h FROM m WHERE match_id % 7 <> 0"
JOINED_SQL = """
SELECT m.match_id, m.clean_date, m.home_team, m.away_team, CASE WHEN o.clean_date IS NULL THEN 'left_only' ELSE 'both' END AS join_state
FROM m LEFT JOIN o ON m.clean_date = o.clean_date AND m.home_team = o.home_team AND m.away_team = o.away_team"""


def _odds_join(spark, sf_dir):
    m = A.matches(spark, sf_dir)
    odds = m.where(F.col("match_id") % 7 != 0).select("clean_date", "home_team", "away_team", "b365h")
    left = m.select("match_id", "clean_date", "home_team", "away_team")
    return R.join_odds(left, odds, ["clean_date", "home_team", "away_team"], ["b365h"], strict=False)


@query("odds_join_diagnostics", "SELECT * FROM j", "m", {"o": ODDS_SQL, "j": JOINED_SQL})
def odds_join_diagnostics(spark, sf_dir):
    return _odds_join(spark, sf_dir)[1]


@query("odds_coverage", """
SELECT count(*) AS fixtures, count(*) FILTER (WHERE join_state = 'both') AS matched, count(*) FILTER (WHERE join_state <> 'both') AS unmatched,
  round(count(*) FILTER (WHERE join_state = 'both') / count(*)::DOUBLE, 9) AS coverage FROM j""", "m", {"o": ODDS_SQL, "j": JOINED_SQL})
def odds_coverage(spark, sf_dir):
    return final(R.odds_coverage(_odds_join(spark, sf_dir)[1]))


@query("checked_join", """
SELECT match_id, home_team, s_name AS sponsor FROM m JOIN (SELECT s_suppkey - 1 AS k, s_name FROM supplier) ON home_team = k""", "m")
def checked_join(spark, sf_dir):
    right = A.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") - 1).alias("home_team"), F.col("s_name").alias("sponsor"))
    return R.checked_join(A.matches(spark, sf_dir).select("match_id", "home_team"), right, ["home_team"])


@query("identity_check_join", """
SELECT count(*) FILTER (WHERE a.match_id IS NOT NULL AND b.match_id IS NOT NULL) AS in_both,
  count(*) FILTER (WHERE b.match_id IS NULL) AS only_left, count(*) FILTER (WHERE a.match_id IS NULL) AS only_right,
  count(*) FILTER (WHERE a.match_id IS NOT NULL AND b.match_id IS NOT NULL AND a.home_team IS DISTINCT FROM b.home_team) AS mismatch_home_team,
  count(*) FILTER (WHERE a.match_id IS NOT NULL AND b.match_id IS NOT NULL AND a.season_name IS DISTINCT FROM b.season_name) AS mismatch_season_name
FROM (SELECT * FROM m WHERE match_id % 5 <> 0) a FULL JOIN (
  SELECT match_id, season_name, CASE WHEN match_id % 11 = 0 THEN NULL ELSE home_team END AS home_team FROM m WHERE match_id % 4 <> 0) b
  ON a.match_id = b.match_id""", "m")
def identity_check_join(spark, sf_dir):
    m = A.matches(spark, sf_dir)
    right = m.where(F.col("match_id") % 4 != 0).withColumn("home_team", F.when(F.col("match_id") % 11 != 0, F.col("home_team")))
    return R.identity_check(m.where(F.col("match_id") % 5 != 0), right, "match_id", ["home_team", "season_name"])


@query("id_set_checks", """
SELECT (SELECT count(*) FROM (SELECT match_id FROM m INTERSECT SELECT user_id FROM events)) AS in_both,
  (SELECT count(*) FROM (SELECT match_id FROM m EXCEPT SELECT user_id FROM events)) AS only_left,
  (SELECT count(*) FROM (SELECT user_id FROM events EXCEPT SELECT match_id FROM m)) AS only_right""", "m")
def id_set_checks(spark, sf_dir):
    users = A.table(spark, sf_dir, "events").select(F.col("user_id").alias("match_id"))
    return Q.key_set_difference(A.matches(spark, sf_dir), users, ["match_id"])


@query("team_dimension", "SELECT DISTINCT team AS team_id, 'team ' || team AS team FROM l", "m", LONG)
def team_dimension(spark, sf_dir):
    name = lambda x: F.concat(F.lit("team "), F.col(x).cast("string"))
    m = A.matches(spark, sf_dir).select(F.col("home_team").alias("home_team_id"), F.col("away_team").alias("away_team_id"),
                                        name("home_team").alias("home_team"), name("away_team").alias("away_team"))
    return E.team_dimension(m)


@query("player_dimension", "SELECT DISTINCT user_id AS player_id, event_type AS player FROM events WHERE user_id % 9 <> 0")
def player_dimension(spark, sf_dir):
    ev = A.table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 9 != 0, F.col("user_id")).alias("player_id"), F.col("event_type").alias("player"))
    return E.player_dimension(ev)


# -- quality -------------------------------------------------------------------


@query("quality_rules", """
SELECT rule, (SELECT count(*) FROM e) AS rows, violations, violations = 0 AS passed FROM (
  SELECT 'location missing' AS rule, count(*) FILTER (WHERE location_x IS NULL) AS violations FROM e
  UNION ALL SELECT 'period unknown', count(*) FILTER (WHERE period NOT IN (1, 2)) FROM e
  UNION ALL SELECT 'xg negative', count(*) FILTER (WHERE shot_xg < 0) FROM e
  UNION ALL SELECT 'pass without end', count(*) FILTER (WHERE type = 'Pass' AND pass_end_x IS NULL) FROM e)""", "e")
def quality_rules(spark, sf_dir):
    return Q.check_rules(A.events(spark, sf_dir), {
        "location missing": F.col("location_x").isNull(), "period unknown": ~F.col("period").isin(1, 2),
        "xg negative": F.col("shot_xg") < 0, "pass without end": (F.col("type") == "Pass") & F.col("pass_end_x").isNull()})


@query("quality_unique", """
SELECT 'match_id,idx' AS rule, count(*) AS keys, count(*) FILTER (WHERE n > 1) AS duplicate_keys,
  CAST(coalesce(sum(n) FILTER (WHERE match_id IS NULL OR idx IS NULL), 0) AS BIGINT) AS null_key_rows,
  count(*) FILTER (WHERE n > 1) = 0 AS passed FROM (SELECT match_id, idx, count(*) AS n FROM e GROUP BY 1, 2)""", "e")
def quality_unique(spark, sf_dir):
    return Q.check_unique(A.events(spark, sf_dir), ["match_id", "idx"], "match_id,idx")


@query("quality_possession_team", """
SELECT count(*) AS groups, count(*) FILTER (WHERE a <> b) AS mixed_groups FROM (
  SELECT min(possession_team) AS a, max(possession_team) AS b FROM e GROUP BY match_id, period, possession)""", "e")
def quality_possession_team(spark, sf_dir):
    return Q.label_consistency(A.events(spark, sf_dir), ["match_id", "period", "possession"], "possession_team")


@query("quality_team_rows", """
SELECT count(*) AS groups, count(*) FILTER (WHERE n <> 2) AS wrong_size FROM (SELECT match_id, count(*) AS n FROM l GROUP BY 1)""", "m", LONG)
def quality_team_rows(spark, sf_dir):
    return Q.group_size_check(E.team_long(A.matches(spark, sf_dir)), ["match_id"], 2)


@query("quality_role_order", """
SELECT split_role, first_date, last_date, rows, position, coalesce(first_date > lag(last_date) OVER (ORDER BY position), TRUE) AS strictly_after
FROM (SELECT split_role, min(clean_date) AS first_date, max(clean_date) AS last_date, count(*) AS rows,
  CASE split_role WHEN 'train' THEN 1 WHEN 'validation' THEN 2 WHEN 'calibration' THEN 3 WHEN 'pilot_holdout' THEN 4 ELSE 5 END AS position FROM r GROUP BY 1)""",
       "m", {"r": "SELECT clean_date, CASE WHEN season_name = '2001' THEN 'final_test' WHEN CAST(clean_date AS DATE) <= DATE '1998-06-30' THEN 'train' WHEN CAST(clean_date AS DATE) <= DATE '1998-12-31' THEN 'validation' WHEN CAST(clean_date AS DATE) <= DATE '1999-06-30' THEN 'calibration' ELSE 'pilot_holdout' END AS split_role FROM m"})
def quality_role_order(spark, sf_dir):
    from ..functions import columns as C
    from .scalars import ROLES

    m = A.matches(spark, sf_dir).withColumn("split_role", C.split_role("season_name", "clean_date", **ROLES))
    return final(Q.partition_order_check(m, "split_role", "clean_date", ("train", "validation", "calibration", "pilot_holdout", "final_test")))


MISSING = ("location_x", "pass_end_x", "shot_xg")


@query("missing_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(*) FILTER (WHERE isnan({c})) AS nans, count(*) FILTER (WHERE isinf({c})) AS infinite FROM e"
    for c in MISSING), "e")
def missing_profile(spark, sf_dir):
    return Q.missing_profile(A.events(spark, sf_dir), MISSING)


# -- profiles ------------------------------------------------------------------


@query("event_type_profile", """
SELECT type, count(*) AS events, round(count(*) / (SELECT count(*) FROM e)::DOUBLE, 9) AS share FROM e GROUP BY type""", "e")
def event_type_profile(spark, sf_dir):
    return final(E.event_type_profile(A.events(spark, sf_dir)))


@query("events_per_match", """
SELECT CAST(count(*) AS BIGINT) AS matches, min(n) AS min_events, CAST(median(n) AS DOUBLE) AS median_events, max(n) AS max_events
FROM (SELECT match_id, count(*) AS n FROM e GROUP BY 1)""", "e")
def events_per_match(spark, sf_dir):
    return final(E.events_per_match(A.table(spark, sf_dir, "events").select(F.col("user_id").alias("match_id"))))


@query("attack_orientation", """
SELECT side, shot_count, round(mean_shot_x, 9) AS mean_shot_x, round(median_shot_x, 9) AS median_shot_x, pass_count,
  round(mean_pass_dx, 9) AS mean_pass_dx, mean_shot_x > 60 AND mean_pass_dx > 0 AS orientation_supported FROM (
  SELECT lower(team) AS side, count(*) FILTER (WHERE type = 'Shot' AND location_x IS NOT NULL) AS shot_count,
    avg(location_x) FILTER (WHERE type = 'Shot') AS mean_shot_x, median(location_x) FILTER (WHERE type = 'Shot') AS median_shot_x,
    count(*) FILTER (WHERE type = 'Pass' AND location_x IS NOT NULL AND pass_end_x IS NOT NULL) AS pass_count,
    avg(pass_end_x - location_x) FILTER (WHERE type = 'Pass') AS mean_pass_dx FROM e GROUP BY 1)""", "e")
def attack_orientation(spark, sf_dir):
    return final(E.attack_orientation(A.events(spark, sf_dir)))


@query("extreme_rows", """
(SELECT 'high' AS side, match_id, id, round(shot_xg, 9) AS shot_xg FROM e WHERE shot_xg IS NOT NULL ORDER BY shot_xg DESC, id LIMIT 10)
UNION ALL (SELECT 'low', match_id, id, round(shot_xg, 9) FROM e WHERE shot_xg IS NOT NULL ORDER BY shot_xg, id LIMIT 10)""", "e")
def extreme_rows(spark, sf_dir):
    ev = A.events(spark, sf_dir).where(F.col("shot_xg").isNotNull()).select("match_id", "id", "shot_xg")
    high = R.top_rows(ev, [F.col("shot_xg").desc(), F.col("id")], 10).withColumn("side", F.lit("high"))
    low = R.top_rows(ev, [F.col("shot_xg"), F.col("id")], 10).withColumn("side", F.lit("low"))
    return final(high.unionByName(low))


DESCRIBED = ("location_x", "shot_xg", "t")


@query("describe_columns", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS present, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS minimum, round(max({c}), 6) AS maximum FROM e"
    for c in DESCRIBED), "e")
def describe_columns(spark, sf_dir):
    return final(E.describe_columns(A.events(spark, sf_dir), DESCRIBED), 6)


@query("rows_with_missing", "SELECT count(*) AS rows, count(*) FILTER (WHERE location_x IS NULL OR pass_end_x IS NULL) AS rows_with_missing FROM e", "e")
def rows_with_missing(spark, sf_dir):
    return E.rows_with_missing(A.events(spark, sf_dir), ["location_x", "pass_end_x"])


@query("exactly_one", "SELECT match_id, home_team FROM m WHERE match_id = 7", "m")
def exactly_one(spark, sf_dir):
    return R.exactly_one(A.matches(spark, sf_dir).select("match_id", "home_team"), F.col("match_id") == 7)
