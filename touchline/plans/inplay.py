"""In-play snapshots. The oracles count events per cutoff by a direct range
join, a different method from the bucket windows of the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import history as H, snapshots as SN
from ..sources import adapters as A
from .histories import _flags
from .registry import final, query

METRICS = K.SNAPSHOT_METRICS
CUT = {"cut": "SELECT unnest(range(0, 91, 5)) AS minute", "mt": "SELECT DISTINCT match_id FROM e",
       "grid": "SELECT match_id, minute, minute * 60.0::DOUBLE AS cutoff FROM mt, cut"}


def _snapshot_parts(metrics):
    flags = _flags(metrics)
    values = {m: f"CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0 END" for m, c in flags.items()}
    if "xg" in metrics:
        values["xg"] = "coalesce(shot_xg, 0)"
    parts = []
    for side, team in (("home", "Home"), ("away", "Away")):
        for m in metrics:
            for timing, cond in (("cum", "TRUE"), ("recent5", "t > cutoff - 300"), ("recent10", "t > cutoff - 600")):
                parts.append(f"round(coalesce(sum({values[m]}) FILTER (WHERE team = '{team}' AND {cond}), 0), 9) AS {side}_{timing}_{m}")
        parts.append(f"CAST(count(*) FILTER (WHERE team = '{team}' AND type = 'Shot' AND shot_outcome = 'Goal') AS DOUBLE) AS {side}_score")
    return parts


SNAP_SQL = f"""
SELECT g.match_id, g.minute AS snapshot_minute, {', '.join(_snapshot_parts(METRICS))},
  max(t) AS feature_source_max_seconds,
  CASE WHEN arg_max(team, t * 1000000 + period * 100000 + idx) = 'Home' THEN 1.0::DOUBLE ELSE 0 END AS home_in_possession
FROM grid g LEFT JOIN e ON e.match_id = g.match_id AND e.t <= g.cutoff GROUP BY 1, 2"""
SNAP = {**CUT, "s": SNAP_SQL}


@query("snapshot_grid", "SELECT match_id, minute AS snapshot_minute, cutoff AS snapshot_seconds FROM grid", "e", CUT)
def snapshot_grid(spark, sf_dir):
    m = A.table(spark, sf_dir, "events").select(F.col("user_id").alias("match_id")).distinct()
    return final(SN.snapshot_grid(m))


@query("snapshots", "SELECT * EXCLUDE (feature_source_max_seconds, home_in_possession) FROM s", "e", SNAP)
def snapshots(spark, sf_dir):
    df = SN.build_snapshots(A.events(spark, sf_dir))
    cols = [f"{s}_{t}_{m}" for s in ("home", "away") for t in SN.TIMINGS for m in METRICS]
    return final(df.select("match_id", "snapshot_minute", *cols, "home_score", "away_score"))


@query("snapshot_asof", "SELECT match_id, snapshot_minute, round(feature_source_max_seconds, 6) AS feature_source_max_seconds, home_in_possession FROM s", "e", SNAP)
def snapshot_asof(spark, sf_dir):
    df = SN.build_snapshots(A.events(spark, sf_dir), metrics=("shots",))
    return final(df.select("match_id", "snapshot_minute", "feature_source_max_seconds", "home_in_possession"), 6)


@query("snapshot_diffs", "SELECT match_id, snapshot_minute, home_score - away_score AS score_diff, round(snapshot_minute / 90.0::DOUBLE, 9) AS match_fraction, "
       "CASE WHEN snapshot_minute < 45 THEN 1.0::DOUBLE ELSE 0 END AS phase_first_half, CASE WHEN snapshot_minute = 45 THEN 1.0::DOUBLE ELSE 0 END AS phase_halftime, "
       "CASE WHEN snapshot_minute >= 75 THEN 1.0::DOUBLE ELSE 0 END AS phase_late, "
       + ", ".join(f"round(home_{t}_{m} - away_{t}_{m}, 9) AS diff_{t}_{m}" for t in SN.TIMINGS for m in METRICS) + " FROM s", "e", SNAP)
def snapshot_diffs(spark, sf_dir):
    df = SN.build_snapshots(A.events(spark, sf_dir))
    cols = [f"diff_{t}_{m}" for t in SN.TIMINGS for m in METRICS]
    return final(df.select("match_id", "snapshot_minute", "score_diff", "match_fraction", "phase_first_half", "phase_halftime", "phase_late", *cols))


IRREGULAR = (100.0, 421.5, 960.0, 2000.25, 3333.0, 5400.0)


@query("interval_window_join", f"""
SELECT match_id, "window", cutoff, round(coalesce(sum(shots) FILTER (WHERE t <= cutoff AND t > cutoff - w), 0), 9) AS shots,
  round(coalesce(sum(xg) FILTER (WHERE t <= cutoff AND t > cutoff - w), 0), 9) AS xg
FROM (SELECT match_id, t, CASE WHEN type = 'Shot' THEN 1.0::DOUBLE ELSE 0 END AS shots, coalesce(shot_xg, 0) AS xg FROM e),
  (SELECT unnest([{', '.join(str(c) for c in IRREGULAR)}])::DOUBLE AS cutoff),
  (SELECT 'all' AS "window", 1e18 AS w UNION ALL SELECT 'last7', 420 UNION ALL SELECT 'last20', 1200)
GROUP BY 1, 2, 3""", "e")
def interval_window_join(spark, sf_dir):
    """Irregular cutoffs, where the five-minute grid does not apply."""
    ev = A.events(spark, sf_dir)
    values = {"shots": F.when(F.col("type") == "Shot", 1.0).otherwise(0.0), "xg": F.coalesce("shot_xg", F.lit(0.0))}
    df = SN.interval_window_sums(ev, IRREGULAR, {"all": None, "last7": 420.0, "last20": 1200.0}, values)
    return final(df.withColumns({"shots": F.round("shots", 9) + 0.0, "xg": F.round("xg", 9) + 0.0}))


@query("attach_frozen", """
SELECT s.match_id, snapshot_minute, home_cum_shots, round(b365h, 9) AS prematch_b365h, season_name
FROM s JOIN m ON s.match_id = m.match_id""", "me", SNAP)
def attach_frozen(spark, sf_dir):
    df = SN.attach_frozen(SN.build_snapshots(A.events(spark, sf_dir), metrics=("shots",)), A.matches(spark, sf_dir), ["b365h"], ["season_name"])
    return final(df.select("match_id", "snapshot_minute", "home_cum_shots", "prematch_b365h", "season_name"))
