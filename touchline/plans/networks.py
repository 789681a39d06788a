"""Possession sequences and zone networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import events as E, history as H, network as N, ordered as O, possession as PO, scoring as SC
from ..sources import adapters as A
from .histories import LONG, history_sql
from .registry import final, query
from .scalars import ZONED_SQL

POSS = {
    "z": ZONED_SQL,
    "b": """SELECT *, lead(first_idx) OVER (PARTITION BY match_id, period ORDER BY first_idx, possession) AS next_start
FROM (SELECT match_id, period, possession, min(idx) AS first_idx FROM z GROUP BY 1, 2, 3)""",
    "inside": """SELECT z.*, b.first_idx, b.next_start, b.next_start IS NULL OR z.idx < b.next_start AS ok
FROM z JOIN b USING (match_id, period, possession)""",
    "p": """SELECT match_id, period, possession, min(first_idx) AS first_idx, max(next_start) AS next_start,
  arg_min(possession_team, idx) FILTER (WHERE ok) AS first_team, arg_max(possession_team, idx) FILTER (WHERE ok) AS last_team,
  count(DISTINCT possession_team) > 1 AS mixed_team, max(idx) FILTER (WHERE ok) AS last_idx,
  count(*) FILTER (WHERE ok) AS events, count(*) FILTER (WHERE NOT ok) AS late_events,
  count(*) FILTER (WHERE ok AND start_zone IS NOT NULL) AS spatial_events,
  arg_min(type, idx) FILTER (WHERE ok AND start_zone IS NOT NULL) AS first_type,
  arg_max(type, idx) FILTER (WHERE ok AND start_zone IS NOT NULL) AS last_type,
  arg_min(start_zone, idx) FILTER (WHERE ok AND start_zone IS NOT NULL) AS first_zone,
  arg_max(start_zone, idx) FILTER (WHERE ok AND start_zone IS NOT NULL) AS last_zone,
  arg_max(location_x, idx) FILTER (WHERE ok AND start_zone IS NOT NULL) AS last_x
FROM inside GROUP BY 1, 2, 3""",
    "pairs": """SELECT *, lead(possession) OVER w AS next_possession, lead(first_team) OVER w AS next_team, lead(first_zone) OVER w AS next_zone
FROM p WINDOW w AS (PARTITION BY match_id, period ORDER BY first_idx, possession)""",
    "tr": """SELECT match_id, period, possession, next_possession, last_team AS from_team, next_team AS to_team,
  last_zone AS src_zone, next_zone AS dst_zone FROM pairs
WHERE next_possession IS NOT NULL AND last_team <> next_team AND last_zone IS NOT NULL AND next_zone IS NOT NULL""",
}
DONE = "type = 'Pass' AND pass_outcome IS NULL AND start_zone IS NOT NULL AND end_zone IS NOT NULL"
SUPRA = {
    **POSS,
    "raw": f"""SELECT match_id, start_zone + CASE team WHEN 'Away' THEN 20 ELSE 0 END AS src, end_zone + CASE team WHEN 'Away' THEN 20 ELSE 0 END AS dst
FROM z WHERE {DONE}
UNION ALL SELECT match_id, src_zone + CASE from_team WHEN 'Away' THEN 20 ELSE 0 END, dst_zone + CASE to_team WHEN 'Away' THEN 20 ELSE 0 END FROM tr""",
    "se": "SELECT match_id, src, dst, count(*) AS weight FROM raw GROUP BY 1, 2, 3",
    "nodes": "SELECT match_id, node FROM (SELECT DISTINCT match_id FROM se), (SELECT unnest(range(0, 40)) AS node)",
    "deg": """SELECT n.match_id, n.node,
  (SELECT coalesce(sum(weight), 0) FROM se WHERE se.match_id = n.match_id AND dst = n.node AND src // 20 = dst // 20) AS pass_in,
  (SELECT coalesce(sum(weight), 0) FROM se WHERE se.match_id = n.match_id AND src = n.node AND src // 20 = dst // 20) AS pass_out,
  (SELECT coalesce(sum(weight), 0) FROM se WHERE se.match_id = n.match_id AND dst = n.node AND src // 20 <> dst // 20) AS inter_in,
  (SELECT coalesce(sum(weight), 0) FROM se WHERE se.match_id = n.match_id AND src = n.node AND src // 20 <> dst // 20) AS inter_out
FROM nodes n""",
    "zm": """SELECT match_id, CASE WHEN node < 20 THEN 'home' ELSE 'away' END AS layer, node % 20 AS zone,
  CAST(pass_in AS DOUBLE) AS pass_in_degree, CAST(pass_out AS DOUBLE) AS pass_out_degree, CAST(inter_out AS DOUBLE) AS inter_out_degree,
  CAST(inter_in AS DOUBLE) AS inter_in_degree, CAST(pass_in + inter_in AS DOUBLE) AS total_in_degree,
  CASE WHEN pass_in + inter_in > 0 THEN inter_out::DOUBLE / (pass_in + inter_in)::DOUBLE END AS leakage,
  CASE WHEN pass_in + inter_in > 0 THEN inter_in::DOUBLE / (pass_in + inter_in)::DOUBLE END AS recovery,
  CASE WHEN pass_in > 0 THEN (inter_in + inter_out)::DOUBLE / pass_in::DOUBLE END AS switching_zone_ratio FROM deg""",
    "tm": """SELECT match_id, layer, avg(leakage) AS mean_zone_leakage, median(leakage) AS median_zone_leakage, max(leakage) AS maximum_zone_leakage,
  count(leakage) AS defined_leakage_zones, avg(recovery) AS mean_zone_recovery, median(recovery) AS median_zone_recovery,
  max(recovery) AS maximum_zone_recovery, count(recovery) AS defined_recovery_zones, CAST(sum(pass_in_degree) AS BIGINT) AS completed_passes,
  CAST(sum(inter_out_degree) AS BIGINT) AS possession_losses, CAST(sum(inter_in_degree) AS BIGINT) AS possession_recoveries,
  count(switching_zone_ratio) AS finite_switching_zones, 20 - count(switching_zone_ratio) AS undefined_switching_zones,
  coalesce(sum(switching_zone_ratio), 0) * 0.5 AS switching_factor FROM zm GROUP BY 1, 2""",
}


def zoned(spark, sf_dir):
    """(events with zones, proven bound on events per match)."""
    bound = A.event_bound(spark, sf_dir)
    return E.add_zones(A.events(spark, sf_dir, bound)), bound


def network_inputs(spark, sf_dir):
    ev, bound = zoned(spark, sf_dir)
    tr = PO.transitions_from_events(ev, bound)
    return ev, tr, N.supra_edges(ev, tr)


@query("possession_boundary", "SELECT match_id, CAST(period AS BIGINT) AS period, possession, first_idx, CAST(next_start AS DOUBLE) AS next_start FROM b", "e", POSS)
def possession_boundary(spark, sf_dir):
    bound = A.event_bound(spark, sf_dir)
    df = PO.possession_boundaries(A.events(spark, sf_dir, bound), bound)
    return final(df.withColumn("next_start", F.col("next_start").cast("double")))


@query("possession_summary", """
SELECT match_id, CAST(period AS BIGINT) AS period, possession, first_idx, CAST(next_start AS DOUBLE) AS next_start, first_team, last_team, mixed_team,
  last_idx, events, late_events, spatial_events, first_type, last_type, CAST(first_zone AS DOUBLE) AS first_zone, CAST(last_zone AS DOUBLE) AS last_zone,
  round(last_x, 9) AS last_x FROM p""", "e", POSS)
def possession_summary(spark, sf_dir):
    ev, bound = zoned(spark, sf_dir)
    df = PO.possession_summary(ev, bound).withColumns({x: F.col(x).cast("double") for x in ("next_start", "first_zone", "last_zone")})
    return final(df.select("match_id", "period", "possession", "first_idx", "next_start", "first_team", "last_team", "mixed_team", "last_idx",
                           "events", "late_events", "spatial_events", "first_type", "last_type", "first_zone", "last_zone", "last_x"))


@query("adjacent_possessions", """
SELECT match_id, CAST(period AS BIGINT) AS period, possession, CAST(next_possession AS DOUBLE) AS next_possession, next_team, CAST(next_zone AS DOUBLE) AS next_zone FROM pairs""", "e", POSS)
def adjacent_possessions(spark, sf_dir):
    ev, bound = zoned(spark, sf_dir)
    df = PO.adjacent_possessions(PO.possession_summary(ev, bound), bound)
    return final(df.select("match_id", "period", "possession", F.col("next_possession").cast("double").alias("next_possession"),
                           "next_team", F.col("next_zone").cast("double").alias("next_zone")))


@query("possession_transitions", """
SELECT match_id, CAST(period AS BIGINT) AS period, possession, next_possession, from_team, to_team, CAST(src_zone AS BIGINT) AS src_zone, CAST(dst_zone AS BIGINT) AS dst_zone FROM tr""", "e", POSS)
def possession_transitions(spark, sf_dir):
    ev, bound = zoned(spark, sf_dir)
    return final(PO.transitions_from_events(ev, bound).drop("home_team", "away_team"))


@query("transition_diagnostics", """
SELECT match_id, count(*) FILTER (WHERE next_possession IS NOT NULL) AS pairs,
  count(*) FILTER (WHERE last_team = next_team) AS same_team, CAST(0 AS BIGINT) AS unknown_team,
  count(*) FILTER (WHERE last_team <> next_team AND (last_zone IS NULL OR next_zone IS NULL)) AS no_location,
  count(*) FILTER (WHERE last_team <> next_team AND last_zone IS NOT NULL AND next_zone IS NOT NULL) AS transitions FROM pairs GROUP BY 1""", "e", POSS)
def transition_diagnostics(spark, sf_dir):
    ev, bound = zoned(spark, sf_dir)
    return final(PO.transition_diagnostics(PO.adjacent_possessions(PO.possession_summary(ev, bound), bound)))


@query("pass_edges", f"""
SELECT match_id, team, CAST(start_zone AS BIGINT) AS src_zone, CAST(end_zone AS BIGINT) AS dst_zone, count(*) AS weight FROM z WHERE {DONE} GROUP BY 1, 2, 3, 4""", "e", {"z": ZONED_SQL})
def pass_edges(spark, sf_dir):
    return final(N.pass_edges(zoned(spark, sf_dir)[0]))


@query("pass_diagnostics", """
SELECT match_id, team, count(*) FILTER (WHERE type = 'Pass') AS passes, count(*) FILTER (WHERE type = 'Pass' AND pass_outcome IS NULL) AS completed,
  count(*) FILTER (WHERE type = 'Pass' AND pass_outcome IS NULL AND (start_zone IS NULL OR end_zone IS NULL)) AS without_zone,
  count(*) FILTER (WHERE type = 'Pass' AND pass_outcome IS NULL AND start_zone IS NOT NULL AND end_zone IS NOT NULL) AS used FROM z GROUP BY 1, 2""", "e", {"z": ZONED_SQL})
def pass_diagnostics(spark, sf_dir):
    return final(N.pass_diagnostics(zoned(spark, sf_dir)[0]))


@query("interlayer_edges", """
SELECT match_id, from_team, to_team, CAST(src_zone AS BIGINT) AS src_zone, CAST(dst_zone AS BIGINT) AS dst_zone, count(*) AS weight FROM tr GROUP BY 1, 2, 3, 4, 5""", "e", POSS)
def interlayer_edges(spark, sf_dir):
    ev, bound = zoned(spark, sf_dir)
    return final(N.interlayer_edges(PO.transitions_from_events(ev, bound)))


@query("transition_directions", "SELECT match_id, from_team, to_team, count(*) AS weight FROM tr GROUP BY 1, 2, 3", "e", POSS)
def transition_directions(spark, sf_dir):
    ev, bound = zoned(spark, sf_dir)
    return final(N.transition_directions(PO.transitions_from_events(ev, bound)))


@query("supra_edges", "SELECT match_id, CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, weight FROM se", "e", SUPRA)
def supra_edges(spark, sf_dir):
    return final(network_inputs(spark, sf_dir)[2])


@query("weight_conservation", f"""
SELECT (SELECT CAST(sum(weight) AS BIGINT) FROM se) AS edge_weight, (SELECT count(*) FROM z WHERE {DONE}) AS passes,
  (SELECT count(*) FROM tr) AS transitions, TRUE AS conserved""", "e", SUPRA)
def weight_conservation(spark, sf_dir):
    ev, tr, edges = network_inputs(spark, sf_dir)
    return N.weight_conservation(edges, ev, tr)


@query("edges_to_matrix", """
SELECT n.match_id, n.node AS src, d.node AS dst, CAST(coalesce(se.weight, 0) AS DOUBLE) AS weight
FROM nodes n JOIN nodes d ON n.match_id = d.match_id LEFT JOIN se ON se.match_id = n.match_id AND se.src = n.node AND se.dst = d.node""", "e", SUPRA)
def edges_to_matrix(spark, sf_dir):
    """Dense matrices, unrolled to cells for comparison."""
    mat = N.edges_to_matrix(network_inputs(spark, sf_dir)[2])
    rows = mat.select("match_id", F.posexplode("matrix").alias("src", "row"))
    return final(rows.select("match_id", "src", F.posexplode("row").alias("dst", "weight")))


@query("zone_reference", """
SELECT zone, x_bin, y_bin, CAST(x_bin * 30 AS DOUBLE) AS x_min, CAST(x_bin * 30 + 30 AS DOUBLE) AS x_max, CAST(y_bin * 16 AS DOUBLE) AS y_min,
  CAST(y_bin * 16 + 16 AS DOUBLE) AS y_max, CAST(x_bin * 30 + 15 AS DOUBLE) AS x_center, CAST(y_bin * 16 + 8 AS DOUBLE) AS y_center, events
FROM (SELECT start_zone::BIGINT AS zone, (start_zone % 4)::BIGINT AS x_bin, (start_zone // 4)::BIGINT AS y_bin, count(*) AS events FROM z WHERE start_zone IS NOT NULL GROUP BY 1, 2, 3)""",
       "e", {"z": ZONED_SQL})
def zone_reference(spark, sf_dir):
    """Zone dimension (20 rows, broadcast) joined to event counts per zone."""
    counts = zoned(spark, sf_dir)[0].where(F.col("start_zone").isNotNull()).groupBy(F.col("start_zone").alias("zone")).agg(F.count(F.lit(1)).alias("events"))
    return final(counts.join(F.broadcast(N.zone_reference(spark)), "zone"))


ZM_COLUMNS = ("pass_in_degree", "pass_out_degree", "inter_out_degree", "inter_in_degree", "total_in_degree")
ZM_RATIOS = ("leakage", "recovery", "switching_zone_ratio")


@query("zone_metrics", f"SELECT match_id, layer, zone, {', '.join(ZM_COLUMNS)}, {', '.join(f'round({r}, 9) AS {r}' for r in ZM_RATIOS)} FROM zm", "e", SUPRA)
def zone_metrics(spark, sf_dir):
    return final(N.zone_metrics(network_inputs(spark, sf_dir)[2]))


TM_DOUBLES = ("mean_zone_leakage", "median_zone_leakage", "maximum_zone_leakage", "mean_zone_recovery", "median_zone_recovery", "maximum_zone_recovery", "switching_factor")


@query("network_team_metrics", f"SELECT * REPLACE ({', '.join(f'round({d}, 9) AS {d}' for d in TM_DOUBLES)}) FROM tm", "e", SUPRA)
def network_team_metrics(spark, sf_dir):
    return final(N.network_team_metrics(N.zone_metrics(network_inputs(spark, sf_dir)[2]), centrality=False))


@query("zone_zscore", """
SELECT match_id, layer, zone, round(CASE WHEN sd > 0 THEN (leakage - mu) / sd ELSE 0 END, 9) AS leakage_z FROM (
  SELECT *, avg(leakage) OVER (PARTITION BY match_id % 3, zone) AS mu, stddev_pop(leakage) OVER (PARTITION BY match_id % 3, zone) AS sd FROM zm)""", "e", SUPRA)
def zone_zscore(spark, sf_dir):
    z = N.zone_metrics(network_inputs(spark, sf_dir)[2]).withColumn("season", F.col("match_id") % 3)
    return final(N.group_zscore(z, ["season", "zone"], "leakage", "leakage_z").select("match_id", "layer", "zone", "leakage_z"))


@query("league_zone_averages", """
SELECT zone, round(avg(leakage), 9) AS mean_leakage, round(avg(recovery), 9) AS mean_recovery, round(avg(pass_in_degree), 9) AS mean_pass_in_degree FROM zm GROUP BY 1""", "e", SUPRA)
def league_zone_averages(spark, sf_dir):
    return final(N.league_zone_averages(N.zone_metrics(network_inputs(spark, sf_dir)[2]), ["leakage", "recovery", "pass_in_degree"]))


@query("average_edges", """
SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, round(sum(weight)::DOUBLE / (SELECT count(DISTINCT match_id) FROM se), 9) AS mean_weight FROM se GROUP BY 1, 2""", "e", SUPRA)
def average_edges(spark, sf_dir):
    return final(N.average_edges(network_inputs(spark, sf_dir)[2]))


@query("topk_per_group", """
SELECT match_id, layer, zone, total_in_degree, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY match_id, layer ORDER BY total_in_degree DESC, zone) AS rank FROM zm) WHERE rank <= 5""", "e", SUPRA)
def topk_per_group(spark, sf_dir):
    z = N.zone_metrics(network_inputs(spark, sf_dir)[2]).select("match_id", "layer", "zone", "total_in_degree")
    return final(O.top_per_group(z, ["match_id", "layer"], [F.col("total_in_degree").desc(), F.col("zone")], 5))


@query("centrality")
def centrality(spark, sf_dir):
    """Eigenvectors of every match graph; checked against NumPy and by residual in the tests."""
    return final(N.zone_metrics_with_centrality(network_inputs(spark, sf_dir)[2]).select(
        "match_id", "layer", "zone", "supra_centrality", "individual_layer_centrality", "supra_eigenvalue", "supra_eigen_residual"), 8)


@query("centrality_checks", """
SELECT count(DISTINCT match_id) AS matches, CAST(1 AS DOUBLE) AS smallest_sum, CAST(1 AS DOUBLE) AS largest_sum,
  CAST(0 AS DOUBLE) AS largest_residual, 0 AS negative FROM se""", "e", SUPRA)
def centrality_checks(spark, sf_dir):
    """Invariants of every graph: unit sum, eigen equation, no negative entry."""
    c = N.eigenvector_centrality(network_inputs(spark, sf_dir)[2])
    per = c.groupBy("match_id").agg(F.sum("supra_centrality").alias("s"), F.max("supra_eigen_residual").alias("r"),
                                    F.count_if(F.col("supra_centrality") < 0).alias("neg"))
    return final(per.agg(F.count(F.lit(1)).alias("matches"), F.min("s").alias("smallest_sum"), F.max("s").alias("largest_sum"),
                         F.max("r").alias("largest_residual"), F.sum("neg").alias("negative")), 6)


@query("power_centrality")
def power_centrality(spark, sf_dir):
    """The same vectors by distributed power iteration on the league-wide graph."""
    edges = network_inputs(spark, sf_dir)[2]
    league = edges.groupBy((F.col("match_id") % 2).alias("match_id"), "src", "dst").agg(F.sum("weight").alias("weight"))
    return final(N.power_centrality(league, tolerance=1e-9), 6)


TEAM_SQL = """
SELECT team, count(*) AS matches, avg(goals_for) AS mean_goals_for, avg(goals_against) AS mean_goals_against, CAST(sum(points) AS BIGINT) AS points FROM l GROUP BY 1"""


@query("team_comparison", """
SELECT team, matches, round(mean_goals_for, 9) AS mean_goals_for, round(mean_goals_against, 9) AS mean_goals_against, points,
  rank() OVER (ORDER BY points DESC) AS points_rank, rank() OVER (ORDER BY round(mean_goals_for, 9) DESC) AS goals_rank FROM t""", "m", {**LONG, "t": TEAM_SQL})
def team_comparison(spark, sf_dir):
    rows = E.team_long(A.matches(spark, sf_dir))
    t = rows.groupBy("team").agg(F.count(F.lit(1)).alias("matches"), F.round(F.avg("goals_for"), 9).alias("mean_goals_for"),
                                 F.round(F.avg("goals_against"), 9).alias("mean_goals_against"), F.sum("points").alias("points"))
    t = O.rank_min(t, [], "points", "points_rank")
    return final(O.rank_min(t, [], "mean_goals_for", "goals_rank"))


@query("pearson", """
SELECT season_name, round(corr(goals_for, points), 9) AS correlation, CAST(NULL AS DOUBLE) AS constant FROM l GROUP BY 1""", "m", LONG)
def pearson(spark, sf_dir):
    rows = E.team_long(A.matches(spark, sf_dir))
    return final(rows.groupBy("season_name").agg(SC.guarded_pearson("goals_for", "points").alias("correlation"),
                                                 SC.guarded_pearson("goals_for", F.lit(1.0)).alias("constant")))


NET = ("mean_zone_leakage", "completed_passes", "switching_factor")


@query("network_history", "SELECT * EXCLUDE (is_home, clean_date) FROM h", "e", {
    **SUPRA, "l": f"""SELECT match_id, TIMESTAMP '2020-01-01' + to_days(CAST(match_id AS INTEGER)) AS clean_date, layer || CAST(match_id % 7 AS VARCHAR) AS team,
  CASE layer WHEN 'home' THEN 1 ELSE 0 END AS is_home, {', '.join(f'round({m}, 6) AS {m}' for m in NET)} FROM tm""", "h": history_sql(NET, "net_")})
def network_history(spark, sf_dir):
    """Lagged histories of network metrics, one fixture per match of the event view."""
    rows = N.network_team_metrics(N.zone_metrics(network_inputs(spark, sf_dir)[2]), centrality=False)
    day0 = F.lit("2020-01-01").cast("timestamp_ntz")
    rows = rows.select("match_id", F.timestamp_add("DAY", F.col("match_id"), day0).alias("clean_date"),
                       F.concat("layer", (F.col("match_id") % 7).cast("string")).alias("team"), *[F.round(m, 6).alias(m) for m in NET])
    # A team plays at most once per match: matches bound the rows per team.
    bound = A.table(spark, sf_dir, "events").select("user_id").distinct().count()
    df, features = H.entity_history(rows, NET, "net_", bound=bound)
    return final(df.select("match_id", "team", *features))


@query("network_team_centrality")
def network_team_centrality(spark, sf_dir):
    """All thirteen network metrics of the history family per match and side."""
    z = N.zone_metrics_with_centrality(network_inputs(spark, sf_dir)[2])
    return final(N.network_team_metrics(z).select("match_id", "layer", *K.NETWORK_METRICS), 6)


def network_rows(spark, sf_dir):
    """All thirteen network metrics per match and side, as rows for histories; one fixture a day."""
    z = N.zone_metrics_with_centrality(network_inputs(spark, sf_dir)[2])
    day0 = F.lit("2020-01-01").cast("timestamp_ntz")
    return N.network_team_metrics(z).select(
        "match_id", F.timestamp_add("DAY", F.col("match_id"), day0).alias("clean_date"), F.concat("layer", (F.col("match_id") % 7).cast("string")).alias("team"),
        F.when(F.col("layer") == "home", 1).otherwise(0).alias("is_home"), *[F.round(x, 9).alias(x) for x in K.NETWORK_METRICS])


@query("network_history_whole")
def network_history_whole(spark, sf_dir):
    """Histories of all network metrics, centralities included."""
    df, features = H.entity_history(network_rows(spark, sf_dir), K.NETWORK_METRICS, "net_")
    return final(df.select("match_id", "team", "is_home", *features), 5)
