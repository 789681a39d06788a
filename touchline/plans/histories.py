"""Team rows, histories and their pivot."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import constants as K
from ..operators import events as E, history as H, ordered as O
from ..sources import adapters as A
from .registry import final, query

LONG_SQL = """
SELECT match_id, clean_date, season_name, home_team AS team, away_team AS opponent, 1 AS is_home,
  home_score AS goals_for, away_score AS goals_against FROM m
UNION ALL
SELECT match_id, clean_date, season_name, away_team, home_team, 0, away_score, home_score FROM m"""
POINTS_SQL = """
SELECT *, CASE WHEN goals_for > goals_against THEN 3 WHEN goals_for = goals_against THEN 1 ELSE 0 END AS points FROM l0"""
LONG = {"l0": LONG_SQL, "l": POINTS_SQL}
METRICS = ("goals_for", "goals_against", "points")


def long_rows(spark, sf_dir):
    return E.team_long(A.matches(spark, sf_dir))


@query("team_long", """
SELECT match_id, clean_date, season_name, team, opponent, CAST(is_home AS BIGINT) AS is_home,
  goals_for, goals_against, CAST(points AS BIGINT) AS points FROM l""", "m", LONG)
def team_long(spark, sf_dir):
    return final(long_rows(spark, sf_dir))


def _flags(metrics):
    ends = "CASE WHEN type = 'Pass' THEN pass_end_x END"
    sql = {
        "shots": "type = 'Shot'",
        "shots_on_target": "type = 'Shot' AND shot_outcome IN ('Goal', 'Saved', 'Saved to Post')",
        "passes": "type = 'Pass'",
        "completed_passes": "type = 'Pass' AND pass_outcome IS NULL",
        "final_third_entries": f"type IN ('Pass', 'Carry') AND location_x < 80 AND {ends} >= 80",
        "pressures": "type = 'Pressure'",
        "recoveries": "type = 'Ball Recovery'",
        "interceptions": "type = 'Interception'",
        "fouls": "type = 'Foul Committed'",
        "yellow_cards": "FALSE",
        "red_cards": "FALSE",
        "carries": "type = 'Carry'",
        "duels_won": "FALSE",
    }
    return {m: sql[m] for m in metrics if m != "xg"}


def flag_sums(metrics, alias="{m}", extra="TRUE"):
    out = []
    for m, cond in _flags(metrics).items():
        out.append(f"CAST(count(*) FILTER (WHERE ({cond}) AND ({extra})) AS BIGINT) AS {alias.format(m=m)}")
    if "xg" in metrics:
        out.append(f"round(coalesce(sum(shot_xg) FILTER (WHERE {extra}), 0), 9) AS {alias.format(m='xg')}")
    return ", ".join(out)


@query("event_indicators", f"SELECT match_id, id, {', '.join(f'CAST(coalesce({c}, FALSE) AS BIGINT) AS {m}' for m, c in _flags(K.EVENT_SUMS).items())}, round(coalesce(shot_xg, 0), 9) AS xg FROM e", "e")
def event_indicators(spark, sf_dir):
    ev = A.events(spark, sf_dir)
    return final(ev.select("match_id", "id", *[v.alias(k) for k, v in E.event_indicators(ev).items()]))


@query("team_match_stats", f"""
SELECT match_id, team, {flag_sums(K.EVENT_SUMS)}, count(DISTINCT possession) AS possessions
FROM e GROUP BY match_id, team""", "e")
def team_match_stats(spark, sf_dir):
    return final(E.team_match_stats(A.events(spark, sf_dir)))


def event_fixtures(ev: DataFrame) -> DataFrame:
    """One fixture row per match of the event view, scored by its shot goals."""
    goal = (F.col("type") == "Shot") & (F.col("shot_outcome") == "Goal")
    return ev.groupBy("match_id").agg(
        F.count_if(goal & (F.col("team") == "Home")).alias("home_score"),
        F.count_if(goal & (F.col("team") == "Away")).alias("away_score"),
    ).select("match_id", F.lit("Home").alias("home_team"), F.lit("Away").alias("away_team"), "home_score", "away_score")


@query("attach_aggregate", f"""
SELECT x.match_id, x.team, x.gf AS goals_for, coalesce(s.shots, 0) AS shots, coalesce(s.passes, 0) AS passes,
  coalesce(s.possessions, 0) AS possessions
FROM (SELECT match_id, CAST(home_team AS VARCHAR) AS team, home_score AS gf FROM m
      UNION ALL SELECT match_id, CAST(away_team AS VARCHAR), away_score FROM m) x
LEFT JOIN (SELECT match_id, CAST(id % 40 AS VARCHAR) AS team, count(*) FILTER (WHERE type = 'Shot') AS shots,
      count(*) FILTER (WHERE type = 'Pass') AS passes, count(DISTINCT possession) AS possessions
      FROM e GROUP BY 1, 2) s ON x.match_id = s.match_id AND x.team = s.team""", "me")
def attach_aggregate(spark, sf_dir):
    ev = A.events(spark, sf_dir).withColumn("team", (F.col("id") % 40).cast("string"))
    m = A.matches(spark, sf_dir).withColumns({
        "home_team": F.col("home_team").cast("string"), "away_team": F.col("away_team").cast("string")})
    rows = E.attach_aggregate(E.team_long(m), E.team_match_stats(ev), ["match_id", "team"], ["shots", "passes", "possessions"])
    return final(rows.select("match_id", "team", "goals_for", "shots", "passes", "possessions"))


def frame(w):
    return f"OVER (PARTITION BY team ORDER BY clean_date, match_id ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"


def history_sql(metrics, prefix):
    by_team = "OVER (PARTITION BY team ORDER BY clean_date, match_id)"
    gap = f"floor((epoch_us(clean_date) - epoch_us(lag(clean_date) {by_team})) / 86400000000.0)"
    parts = [
        f"lag(clean_date) {by_team} AS {prefix}source_match_time",
        f"CAST(row_number() {by_team} - 1 AS DOUBLE) AS {prefix}matches_played_prior",
        f"CAST(CASE WHEN lag(clean_date) {by_team} IS NOT NULL THEN greatest(least({gap}, 60), 0) END AS DOUBLE) AS {prefix}rest_days",
    ]
    for m in metrics:
        parts += [f"round(avg({m}) {frame(w)}, 9) AS {prefix}{m}_roll{w}" for w in (3, 5, 10)]
        parts.append(f"round(avg({m}) {frame('UNBOUNDED')}, 9) AS {prefix}{m}_expanding")
    return f"SELECT match_id, clean_date, team, is_home, {', '.join(parts)} FROM l"


HIST = {**LONG, "h": history_sql(METRICS, "event_")}


@query("entity_history", "SELECT * EXCLUDE (is_home), CAST(is_home AS BIGINT) AS is_home FROM h", "m", HIST)
def entity_history(spark, sf_dir):
    df, features = H.entity_history(long_rows(spark, sf_dir), METRICS, "event_")
    return final(df.select("match_id", "clean_date", "team", "is_home", *features))


@query("event_history", """
SELECT * EXCLUDE (is_home, clean_date), epoch_us(clean_date) AS kickoff FROM h""", "e", {
    "fx": "SELECT match_id, TIMESTAMP '2020-01-01' + to_days(CAST(match_id AS INTEGER)) AS clean_date, match_id % 7 AS pair FROM (SELECT DISTINCT match_id FROM e)",
    "st": f"SELECT match_id, team AS side, {flag_sums(('shots', 'xg', 'completed_passes'))} FROM e GROUP BY 1, 2",
    "l": "SELECT fx.match_id, clean_date, side || CAST(pair AS VARCHAR) AS team, CASE side WHEN 'Home' THEN 1 ELSE 0 END AS is_home, shots, xg, completed_passes FROM fx JOIN st ON fx.match_id = st.match_id",
    "h": history_sql(("shots", "xg", "completed_passes"), "event_"),
})
def event_history(spark, sf_dir):
    stats = E.team_match_stats(A.events(spark, sf_dir)).withColumn("xg", F.round("xg", 9))
    day0 = F.lit("2020-01-01").cast("timestamp_ntz")
    rows = stats.select(
        "match_id", F.timestamp_add("DAY", F.col("match_id"), day0).alias("clean_date"),
        F.concat("team", (F.col("match_id") % 7).cast("string")).alias("team"),
        F.when(F.col("team") == "Home", 1).otherwise(0).alias("is_home"), "shots", "xg", "completed_passes",
    )
    df, features = H.entity_history(rows, ("shots", "xg", "completed_passes"), "event_")
    kick = F.unix_micros(F.col("clean_date").cast("timestamp")).alias("kickoff")
    return final(df.select("match_id", "team", kick, *features))


def _pivot_sql(metrics, prefix):
    names = [f"{prefix}source_match_time", f"{prefix}matches_played_prior", f"{prefix}rest_days"]
    names += [f"{prefix}{m}_{s}" for m in metrics for s in ("roll3", "roll5", "roll10", "expanding")]
    cols = [f"a.{n} AS home_{n}, b.{n} AS away_{n}" for n in names]
    for n in names[1:]:
        d = f"a.{n} - b.{n}"
        cols.append(f"{d if n.endswith('rest_days') else f'round({d}, 9)'} AS diff_{n}")
    return f"SELECT a.match_id, {', '.join(cols)} FROM h a JOIN h b ON a.match_id = b.match_id AND a.is_home = 1 AND b.is_home = 0"


@query("prematch_pivot", _pivot_sql(METRICS, "event_"), "m", HIST)
def prematch_pivot(spark, sf_dir):
    df, features = H.entity_history(long_rows(spark, sf_dir), METRICS, "event_")
    df = rounded_features(df, features)
    return final(H.pivot_home_away(df, features))


def rounded_features(df, features):
    kinds = dict(df.dtypes)
    return df.withColumns({x: F.round(x, 9) for x in features if kinds[x] == "double"})


# All eighteen event metrics of the histories, on the fixtures of the event view.

WHOLE_EVENT = {
    "fx": """SELECT match_id, TIMESTAMP '2020-01-01' + to_days(CAST(match_id AS INTEGER)) AS clean_date, match_id % 7 AS pair,
  count(*) FILTER (WHERE type = 'Shot' AND shot_outcome = 'Goal' AND team = 'Home') AS hs, count(*) FILTER (WHERE type = 'Shot' AND shot_outcome = 'Goal' AND team = 'Away') AS aw FROM e GROUP BY match_id""",
    "st": f"SELECT match_id, team AS side, {flag_sums(K.EVENT_SUMS)}, count(DISTINCT possession) AS possessions FROM e GROUP BY 1, 2",
    "l": f"""SELECT fx.match_id, clean_date, side || CAST(pair AS VARCHAR) AS team, CASE side WHEN 'Home' THEN 1 ELSE 0 END AS is_home,
  CASE side WHEN 'Home' THEN hs ELSE aw END AS goals_for, CASE side WHEN 'Home' THEN aw ELSE hs END AS goals_against,
  CASE WHEN hs = aw THEN 1 WHEN (hs > aw) = (side = 'Home') THEN 3 ELSE 0 END AS points, {', '.join((*K.EVENT_SUMS, 'possessions'))} FROM fx JOIN st ON fx.match_id = st.match_id""",
    "h": history_sql(K.EVENT_METRICS, "event_"),
}


def event_rows(spark, sf_dir):
    """Two rows per match of the event view with all event metrics; one fixture a day, seven pairs of teams."""
    ev = A.events(spark, sf_dir)
    stats = E.team_match_stats(ev).withColumn("xg", F.round("xg", 9))
    goals = event_fixtures(ev).select("match_id", "home_score", "away_score")
    home, day0 = F.col("team") == "Home", F.lit("2020-01-01").cast("timestamp_ntz")
    own, other = F.when(home, F.col("home_score")).otherwise(F.col("away_score")), F.when(home, F.col("away_score")).otherwise(F.col("home_score"))
    return stats.join(goals, "match_id").select(
        "match_id", F.timestamp_add("DAY", F.col("match_id"), day0).alias("clean_date"), F.concat("team", (F.col("match_id") % 7).cast("string")).alias("team"),
        home.cast("int").alias("is_home"), own.alias("goals_for"), other.alias("goals_against"), F.when(own > other, 3).when(own == other, 1).otherwise(0).alias("points"),
        *K.EVENT_SUMS, "possessions")


@query("event_history_whole", "SELECT * EXCLUDE (is_home, clean_date), CAST(is_home AS BIGINT) AS is_home FROM h", "e", WHOLE_EVENT)
def event_history_whole(spark, sf_dir):
    df, features = H.entity_history(event_rows(spark, sf_dir), K.EVENT_METRICS, "event_")
    return final(df.select("match_id", "team", "is_home", *features))


@query("event_pivot_whole", _pivot_sql(K.EVENT_METRICS, "event_"), "e", WHOLE_EVENT)
def event_pivot_whole(spark, sf_dir):
    df, features = H.entity_history(event_rows(spark, sf_dir), K.EVENT_METRICS, "event_")
    return final(H.pivot_home_away(rounded_features(df, features), features))


@query("recent_form_5", f"""
SELECT match_id, team, round(coalesce(avg(goals_for) {frame(5)}, 0), 9) AS recent_goals_for,
  round(coalesce(avg(goals_against) {frame(5)}, 0), 9) AS recent_goals_against,
  least(row_number() OVER (PARTITION BY team ORDER BY clean_date, match_id) - 1, 5) AS history_matches FROM l""", "m", LONG)
def recent_form_5(spark, sf_dir):
    df = H.recent_form(long_rows(spark, sf_dir))
    return final(df.select("match_id", "team", "recent_goals_for", "recent_goals_against", "history_matches"))


@query("prior_matches_join", """
SELECT match_id, team, goals_before, CAST(n_before AS BIGINT) AS n_before FROM (
  SELECT a.match_id, a.team, a.clean_date,
    round(avg(b.goals_for), 9) AS goals_before, count(b.match_id) AS n_before
  FROM l a LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY team ORDER BY clean_date, match_id) AS rn FROM l) b
    ON a.team = b.team AND b.clean_date < a.clean_date
    AND b.rn >= (SELECT count(*) FROM l z WHERE z.team = a.team AND z.clean_date < a.clean_date) - 4
  GROUP BY 1, 2, 3)""", "m", LONG)
def prior_matches_join(spark, sf_dir):
    """Last five strictly earlier matches of a team: kickoffs are unique per team,
    so the row frame is the theta join without its quadratic pairs."""
    seq = O.sequence(long_rows(spark, sf_dir), ["team"], ["clean_date", "match_id"])
    df = seq.trailing_means(["goals_for"], [5], False, lambda m, w: "goals_before").row_number("rn").result()
    return final(df.select("match_id", "team", "goals_before", F.least(F.col("rn") - 1, F.lit(5)).alias("n_before")))


@query("chronology_check", """
SELECT count(*) AS rows, count(*) FILTER (WHERE p IS NULL) AS first_rows,
  count(*) FILTER (WHERE p > clean_date) AS backward, count(*) FILTER (WHERE p = clean_date) AS same_time
FROM (SELECT clean_date, lag(clean_date) OVER (PARTITION BY team ORDER BY clean_date, match_id) AS p FROM l)""", "m", LONG)
def chronology_check(spark, sf_dir):
    return final(H.chronology_check(long_rows(spark, sf_dir)))


@query("season_summary", """
SELECT season_name, team, count(*) AS matches, min(clean_date) AS first_date, max(clean_date) AS last_date
FROM l GROUP BY 1, 2""", "m", LONG)
def season_summary(spark, sf_dir):
    return final(E.season_summary(long_rows(spark, sf_dir)))


@query("feature_groups", """
SELECT 'conventional' AS group_name, count(*) AS columns, round(sum(total), 6) AS checksum FROM (
  SELECT sum(home_event_points_roll5) AS total FROM pv UNION ALL SELECT sum(away_event_points_roll5) FROM pv
  UNION ALL SELECT sum(diff_event_points_roll5) FROM pv)""", "m", {**HIST, "pv": _pivot_sql(METRICS, "event_")})
def feature_groups(spark, sf_dir):
    """Columns of the conventional group that belong to the points_roll5 family."""
    df, features = H.entity_history(long_rows(spark, sf_dir), METRICS, "event_")
    pivot = H.pivot_home_away(rounded_features(df, features), features)
    groups = H.feature_groups(pivot.columns)
    family = H.keyword_families(groups["conventional"], {"form": ["points_roll5"]})["form"]
    total = None
    for x in family:
        total = F.sum(F.col(x)) if total is None else total + F.sum(F.col(x))
    return pivot.select(*family).agg(
        F.lit("conventional").alias("group_name"), F.lit(len(family)).cast("long").alias("columns"), F.round(total, 6).alias("checksum"))


@query("first_match_check", """
SELECT count(*) FILTER (WHERE event_matches_played_prior = 0) AS first_matches,
  count(*) FILTER (WHERE event_matches_played_prior = 0 AND event_points_roll5 IS NOT NULL) AS first_with_history,
  count(*) FILTER (WHERE event_matches_played_prior > 0 AND event_points_roll5 IS NULL) AS later_without_history FROM h""", "m", HIST)
def first_match_check(spark, sf_dir):
    df, _ = H.entity_history(long_rows(spark, sf_dir), ("points",), "event_")
    return H.first_match_check(df, "event_", "event_points_roll5")
