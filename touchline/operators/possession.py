"""Possession boundaries, summaries and transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .ordered import sequence

KEYS = ["match_id", "period", "possession"]


def usable(events: DataFrame) -> DataFrame:
    return events.dropna(subset=["period", "possession", "possession_team", "idx"])


def possession_boundaries(events: DataFrame, bound: int | None = None, max_rows: int | None = None) -> DataFrame:
    """First event of each possession and the start of the next in the period."""
    first = usable(events).groupBy(*KEYS).agg(F.min("idx").alias("first_idx"))
    seq = sequence(first, ["match_id", "period"], ["first_idx", "possession"], bound=bound, max_rows=max_rows)
    return seq.neighbor({"next_start": F.col("first_idx")}, +1).result()


def possession_summary(events: DataFrame, bound: int | None = None, max_rows: int | None = None) -> DataFrame:
    """One row per possession over events before the next possession starts.

    An event tagged to a possession that has already ended is counted as late and
    otherwise ignored. ``events`` needs ``start_zone`` (see ``add_zones``). The
    join and the grouping share the possession key, hence one shuffle of events.
    """
    ev = usable(events)
    cuts = possession_boundaries(events, bound, max_rows)
    joined = ev.join(cuts, KEYS)
    inside = F.col("next_start").isNull() | (F.col("idx") < F.col("next_start"))
    spatial = inside & F.col("start_zone").isNotNull()
    here = F.when(inside, F.col("idx"))
    there = F.when(spatial, F.col("idx"))
    point = F.struct("type", "location_x", "location_y", "start_zone")
    out = joined.groupBy(*KEYS).agg(
        F.min("first_idx").alias("first_idx"),
        F.max("next_start").alias("next_start"),
        F.min_by("possession_team", here).alias("first_team"),
        F.max_by("possession_team", here).alias("last_team"),
        F.min("possession_team").alias("_min_team"),
        F.max("possession_team").alias("_max_team"),
        F.max("home_team").alias("home_team"),
        F.max("away_team").alias("away_team"),
        F.max(here).alias("last_idx"),
        F.count_if(inside).alias("events"),
        F.count_if(~inside).alias("late_events"),
        F.count_if(spatial).alias("spatial_events"),
        F.min_by(point, there).alias("_first"),
        F.max_by(point, there).alias("_last"),
    )
    cols = [x for x in out.columns if x not in ("_first", "_last", "_min_team", "_max_team")]
    return out.select(
        *cols,
        (F.col("_min_team") != F.col("_max_team")).alias("mixed_team"),
        *[F.col(f"_{end}.{a}").alias(f"{end}_{b}") for end in ("first", "last")
          for a, b in (("type", "type"), ("location_x", "x"), ("location_y", "y"), ("start_zone", "zone"))],
    )


def adjacent_possessions(summary: DataFrame, bound: int | None = None, max_rows: int | None = None) -> DataFrame:
    """Each possession with the next one of its period (NULL at the end)."""
    seq = sequence(summary, ["match_id", "period"], ["first_idx", "possession"], bound=bound, max_rows=max_rows)
    return seq.neighbor({
        "next_possession": F.col("possession"), "next_team": F.col("first_team"), "next_zone": F.col("first_zone"),
    }, +1).result()


def _pair_conditions():
    exists = F.col("next_possession").isNotNull()
    switches = exists & (F.col("last_team") != F.col("next_team"))
    known = (
        F.col("last_team").isin(F.col("home_team"), F.col("away_team"))
        & F.col("next_team").isin(F.col("home_team"), F.col("away_team"))
    )
    spatial = F.col("last_zone").isNotNull() & F.col("next_zone").isNotNull()
    return exists, switches, known, spatial


def possession_transitions(pairs: DataFrame) -> DataFrame:
    """Ball losses: the start zone of the last spatial event of one team to the
    first start zone of the other."""
    _, switches, known, spatial = _pair_conditions()
    return pairs.where(switches & known & spatial).select(
        "match_id", "period", "possession", "next_possession",
        F.col("last_team").alias("from_team"), F.col("next_team").alias("to_team"),
        F.col("last_zone").alias("src_zone"), F.col("next_zone").alias("dst_zone"),
        "home_team", "away_team",
    )


def transition_diagnostics(pairs: DataFrame) -> DataFrame:
    """Per match: adjacent pairs and why pairs were left out."""
    exists, switches, known, spatial = _pair_conditions()
    return pairs.groupBy("match_id").agg(
        F.count_if(exists).alias("pairs"),
        F.count_if(exists & ~switches).alias("same_team"),
        F.count_if(switches & ~known).alias("unknown_team"),
        F.count_if(switches & known & ~spatial).alias("no_location"),
        F.count_if(switches & known & spatial).alias("transitions"),
    )


def transitions_from_events(events: DataFrame, bound: int | None = None, max_rows: int | None = None) -> DataFrame:
    summary = possession_summary(events, bound, max_rows)
    return possession_transitions(adjacent_possessions(summary, bound, max_rows))
