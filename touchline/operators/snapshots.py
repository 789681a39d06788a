"""Exact-boundary in-play snapshots.

An event belongs to cutoff ``c`` when ``t <= c``; a recent window is
``(c - w, c]``. On the regular five-minute grid every event falls into bucket
``ceil(t / 300)``, so all windows are sums over buckets: events are reduced to at
most 19 rows per match before anything is ordered. ``interval_window_sums`` is
the general form for cutoffs that are not on a grid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import columns as C, constants as K
from .events import event_indicators

TIMINGS = ("cum", "recent5", "recent10")


def snapshot_grid(matches: DataFrame, minutes: Sequence[int] = K.SNAPSHOT_MINUTES) -> DataFrame:
    """Matches x cutoffs, generated per row without a join."""
    grid = F.explode(F.array(*[F.lit(m) for m in minutes]))
    return matches.withColumn("snapshot_minute", grid).withColumn(
        "snapshot_seconds", F.col("snapshot_minute") * F.lit(60.0)
    )


def bucketed(df: DataFrame, time: str = "t") -> DataFrame:
    """Bucket of the first grid cutoff at or after the event; later events drop out."""
    step = float(K.SNAPSHOT_STEP_MINUTES * 60)
    last = K.SNAPSHOT_LAST_MINUTE // K.SNAPSHOT_STEP_MINUTES
    bucket = F.greatest(F.ceil(F.col(time) / step), F.lit(0)).cast("int")
    return df.withColumn("_bucket", bucket).where(F.col("_bucket") <= last)


def build_snapshots(
    events: DataFrame,
    metrics: Sequence[str] = K.SNAPSHOT_METRICS,
    time: str = "t",
    order: Sequence[str] = ("period", "idx"),
    strict: bool = True,
) -> DataFrame:
    """Nineteen snapshots per match: counts, scores, last team, differences.

    ``events`` carries ``home_team`` and ``away_team``. The last event at or
    before a cutoff is found by (time, then source order) and kept as a struct,
    so an event without team stays the last event.
    """
    ind = event_indicators(events)
    home, away = F.col("team") == F.col("home_team"), F.col("team") == F.col("away_team")
    goal = (F.col("type") == "Shot") & (F.col("shot_outcome") == "Goal")
    own_goal = F.col("type") == "Own Goal Against"
    sides = {"home": (home, away), "away": (away, home)}
    sums = {}
    for side, (mine, theirs) in sides.items():
        for m in metrics:
            sums[f"{side}_{m}"] = F.sum(F.when(mine, ind[m].cast("double")).otherwise(0.0))
        sums[f"{side}_score"] = F.sum(F.when((goal & mine) | (own_goal & theirs), 1.0).otherwise(0.0))
    per_bucket = bucketed(events, time).groupBy("match_id", "_bucket").agg(
        *[v.alias(k) for k, v in sums.items()],
        F.max_by(
            F.struct(F.coalesce(home, F.lit(False)).alias("home")), F.struct(time, *order)
        ).alias("_last"),
        F.max(time).alias("_max_t"),
    )
    # At most 19 buckets per match: densify inside one row, then order.
    buckets = K.SNAPSHOT_LAST_MINUTE // K.SNAPSHOT_STEP_MINUTES
    names = list(sums)
    packed = per_bucket.groupBy("match_id").agg(F.map_from_entries(F.collect_list(F.struct(
        "_bucket", F.struct(*names, "_last", "_max_t")
    ))).alias("_cells"))
    dense = packed.select(
        "match_id", "_cells", F.explode(F.sequence(F.lit(0), F.lit(buckets))).alias("_bucket")
    ).select("match_id", "_bucket", F.try_element_at("_cells", F.col("_bucket")).alias("_cell"))
    dense = dense.select(
        "match_id", "_bucket", *[F.coalesce(f"_cell.{n}", F.lit(0.0)).alias(n) for n in names],
        F.col("_cell._last").alias("_last"), F.col("_cell._max_t").alias("_max_t"),
    )
    w = W.partitionBy("match_id").orderBy("_bucket")
    upto, last_two = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(-1, 0)
    cols = [
        F.col("match_id"),
        (F.col("_bucket") * K.SNAPSHOT_STEP_MINUTES).alias("snapshot_minute"),
    ]
    for side in sides:
        for m in metrics:
            n = f"{side}_{m}"
            cols += [
                F.sum(n).over(upto).alias(f"{side}_cum_{m}"),
                F.col(n).alias(f"{side}_recent5_{m}"),
                F.sum(n).over(last_two).alias(f"{side}_recent10_{m}"),
            ]
        cols.append(F.sum(f"{side}_score").over(upto).alias(f"{side}_score"))
    cols += [
        F.last("_last", ignorenulls=True).over(upto).alias("_last"),
        F.max("_max_t").over(upto).alias("feature_source_max_seconds"),
    ]
    out = dense.select(*cols)
    out = out.withColumns({
        "snapshot_seconds": F.col("snapshot_minute") * F.lit(60.0),
        "home_in_possession": F.when(F.col("_last.home"), 1.0).otherwise(0.0),
    }).drop("_last")
    if strict:
        late = F.col("feature_source_max_seconds") > F.col("snapshot_seconds")
        out = out.withColumn("feature_source_max_seconds", F.when(
            late, F.raise_error(F.lit("snapshot contains an event after its cutoff")).cast("double")
        ).otherwise(F.col("feature_source_max_seconds")))
    return snapshot_diffs(out, metrics)


def snapshot_diffs(df: DataFrame, metrics: Sequence[str] = K.SNAPSHOT_METRICS) -> DataFrame:
    derived = {"score_diff": F.col("home_score") - F.col("away_score"), **C.phase_flags("snapshot_minute")}
    for timing in TIMINGS:
        for m in metrics:
            derived[f"diff_{timing}_{m}"] = F.col(f"home_{timing}_{m}") - F.col(f"away_{timing}_{m}")
    return df.select("*", *[v.alias(k) for k, v in derived.items()])


def attach_frozen(snapshots: DataFrame, prematch: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Copy each match's pre-match columns to all its snapshots."""
    side = prematch.select("match_id", *keep, *[F.col(x).alias(f"prematch_{x}") for x in columns])
    return snapshots.join(side, "match_id")


def interval_window_sums(
    events: DataFrame, cutoffs: Sequence[float], windows: dict[str, float | None],
    values: dict[str, F.Column], keys: Sequence[str] = ("match_id",), time: str = "t",
) -> DataFrame:
    """Window sums for any list of cutoffs.

    Each event is turned into a step: it enters a window at the first cutoff at
    or after it and leaves at the first cutoff beyond ``t + w``. Steps are summed
    per cutoff and accumulated, so an event yields two rows per window, not one
    row per cutoff it belongs to, and nothing is range-joined.
    """
    cuts = sorted(float(x) for x in cutoffs)
    grid = F.array(*[F.lit(x) for x in cuts])
    n = len(cuts)
    first_at = lambda edge, strict: F.size(F.filter(grid, (lambda x: x <= edge) if strict else (lambda x: x < edge)))
    t = F.col(time)
    steps = [F.struct(F.lit(name).alias("window"), first_at(t, False).alias("pos"), F.lit(1.0).alias("sign")) for name in windows]
    for name, w in windows.items():
        if w is not None:
            # in (c - w, c]: still inside while c < t + w.
            steps.append(F.struct(F.lit(name).alias("window"), first_at(t + w, False).alias("pos"), F.lit(-1.0).alias("sign")))
    moved = events.select(*keys, *[v.cast("double").alias(k) for k, v in values.items()], F.inline(F.array(*steps)))
    # Zero rows at every cutoff keep windows without events.
    sums = moved.where(F.col("pos") < n).groupBy(*keys, "window", "pos").agg(
        *[F.sum(F.col(k) * F.col("sign")).alias(k) for k in values]
    )
    cells = sums.groupBy(*keys, "window").agg(
        F.map_from_entries(F.collect_list(F.struct("pos", F.struct(*values)))).alias("_cells")
    )
    dense = cells.select(*keys, "window", "_cells", F.posexplode(grid).alias("pos", "cutoff")).select(
        *keys, "window", "pos", "cutoff",
        *[F.coalesce(F.try_element_at("_cells", F.col("pos")).getField(k), F.lit(0.0)).alias(k) for k in values],
    )
    w = W.partitionBy(*keys, "window").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return dense.select(*keys, "window", "cutoff", *[F.sum(k).over(w).alias(k) for k in values])
