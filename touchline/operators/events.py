"""Event-level cleaning, indicators and team-match statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import columns as C, constants as K


def has(df: DataFrame, name: str, kind: str) -> Column:
    """The column, or a typed NULL when the source does not carry it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def coordinate_report(df: DataFrame, pairs: Sequence[tuple[str, str]], tolerance: float = 1.0) -> DataFrame:
    """Per coordinate pair: present rows, nominal overflow, overflow beyond tolerance.

    All pairs share one scan and one aggregate.
    """
    aggs, entries = [F.count(F.lit(1)).alias("rows")], []
    for i, (xn, yn) in enumerate(pairs):
        x, y = F.col(xn), F.col(yn)
        over = lambda m: (x < -m) | (x > K.PITCH_X + m) | (y < -m) | (y > K.PITCH_Y + m)
        aggs += [
            F.count_if(x.isNotNull() & y.isNotNull()).alias(f"_p{i}"),
            F.count_if(over(0.0)).alias(f"_o{i}"),
            F.count_if(over(tolerance)).alias(f"_b{i}"),
        ]
        entries.append(F.struct(
            F.lit(xn).alias("x_column"), F.lit(yn).alias("y_column"), F.col("rows"),
            F.col(f"_p{i}").alias("present"), F.col(f"_o{i}").alias("overflow"),
            F.col(f"_b{i}").alias("beyond_tolerance"),
        ))
    return df.agg(*aggs).select(F.inline(F.array(*entries)))


def clip_coordinates(
    df: DataFrame, pairs: Sequence[tuple[str, str]], tolerance: float = 1.0, strict: bool = True
) -> DataFrame:
    """Clip to the pitch; in strict mode a value beyond the tolerance raises."""
    out = {}
    for xn, yn in pairs:
        for name, top in ((xn, K.PITCH_X), (yn, K.PITCH_Y)):
            v = F.col(name)
            kept = C.clip(v, 0.0, top)
            if strict:
                bad = F.raise_error(F.concat_ws(" ", F.lit(f"{name} beyond tolerance:"), v)).cast("double")
                kept = F.when((v < -tolerance) | (v > top + tolerance), bad).otherwise(kept)
            out[name] = kept
    return df.withColumns(out)


def add_zones(df: DataFrame, strict: bool = True) -> DataFrame:
    """Start zone from the location, end zone from the last present end point.

    Later kinds win: location, pass, carry, shot, goalkeeper. A point counts only
    when both parts exist.
    """
    order = ("goalkeeper_end", "shot_end", "carry_end", "pass_end", "location")
    points = [C.both(f"{p}_x", f"{p}_y") for p in order if f"{p}_x" in df.columns and f"{p}_y" in df.columns]
    df = df.withColumn("_end", F.coalesce(*points))
    return df.withColumns({
        "start_zone": C.zone_id("location_x", "location_y", strict),
        "end_zone": C.zone_id("_end.x", "_end.y", strict),
    }).drop("_end")


def event_indicators(df: DataFrame) -> dict[str, Column]:
    """0/1 indicators (and xG) of one event; unknown conditions count as 0."""
    kind = F.col("type")
    is_pass, is_shot, is_carry = kind == "Pass", kind == "Shot", kind == "Carry"
    end_x = F.when(is_pass, has(df, "pass_end_x", "double")).otherwise(has(df, "carry_end_x", "double"))
    failed = F.coalesce(has(df, "ball_recovery_recovery_failure", "boolean"), F.lit(False))
    card = F.coalesce(has(df, "foul_committed_card", "string"), has(df, "bad_behaviour_card", "string"))
    f = C.flag
    return {
        "shots": f(is_shot),
        "shots_on_target": f(is_shot & F.col("shot_outcome").isin(*K.ON_TARGET)),
        "xg": F.coalesce(C.no_nan(F.col("shot_xg").cast("double")), F.lit(0.0)),
        "passes": f(is_pass),
        "completed_passes": f(is_pass & F.col("pass_outcome").isNull()),
        "final_third_entries": f((is_pass | is_carry) & (F.col("location_x") < K.FINAL_THIRD_X)
                                 & (end_x >= K.FINAL_THIRD_X)),
        "pressures": f(kind == "Pressure"),
        "recoveries": f((kind == "Ball Recovery") & ~failed),
        "interceptions": f(kind == "Interception"),
        "fouls": f(kind == "Foul Committed"),
        "yellow_cards": f(card.isin(*K.YELLOW)),
        "red_cards": f(card.isin(*K.RED)),
        "carries": f(is_carry),
        "duels_won": f(has(df, "duel_outcome", "string").isin(*K.DUEL_WON)),
    }


def team_match_stats(df: DataFrame) -> DataFrame:
    """Sums of the indicators and distinct possessions per match and team.

    Distinct possessions come from a first grouping by possession, so the sums
    and the distinct count share one shuffle of already reduced rows.
    """
    ind = event_indicators(df)
    base = df.where(F.col("team").isNotNull())
    per_possession = base.groupBy("match_id", "team", "possession").agg(
        *[F.sum(v).alias(k) for k, v in ind.items()]
    )
    return per_possession.groupBy("match_id", "team").agg(
        *[F.sum(k).alias(k) for k in ind], F.count("possession").alias("possessions")
    )


def team_long(matches: DataFrame, carry: Sequence[str] = ("clean_date", "season_name")) -> DataFrame:
    """Two rows per match, one from each side, out of a single scan."""
    def side(team, other, gf, ga, home):
        return F.struct(
            F.col(team).alias("team"), F.col(other).alias("opponent"), F.lit(home).alias("is_home"),
            F.col(gf).alias("goals_for"), F.col(ga).alias("goals_against"),
            C.match_points(gf, ga).alias("points"),
        )

    sides = F.array(
        side("home_team", "away_team", "home_score", "away_score", 1),
        side("away_team", "home_team", "away_score", "home_score", 0),
    )
    return matches.select("match_id", *carry, F.inline(sides))


def attach_aggregate(rows: DataFrame, aggregate: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Left join; a row without aggregate gets zeros."""
    return rows.join(aggregate.select(*keys, *metrics), list(keys), "left").fillna(0, subset=list(metrics))


def team_match_rows(events: DataFrame, matches: DataFrame, carry: Sequence[str] = ("clean_date", "season_name")) -> DataFrame:
    rows = team_long(matches, carry)
    return attach_aggregate(rows, team_match_stats(events), ["match_id", "team"], [*K.EVENT_SUMS, "possessions"])


def attack_orientation(df: DataFrame) -> DataFrame:
    """Per side: do shots start near the far goal and do passes run forward?

    The exact median needs the value distribution; shot counts per x value are
    reduced first so that no task sees all shots of a side.
    """
    side = F.when(F.col("team") == F.col("home_team"), "home").otherwise("away").alias("side")
    dx = F.col("pass_end_x") - F.col("location_x")
    is_shot = (F.col("type") == "Shot") & F.col("location_x").isNotNull()
    is_pass = (F.col("type") == "Pass") & dx.isNotNull()
    base = df.select(side, "type", "location_x", "pass_end_x")
    stats = base.groupBy("side").agg(
        F.count_if(is_shot).alias("shot_count"),
        F.avg(F.when(is_shot, F.col("location_x"))).alias("mean_shot_x"),
        F.count_if(is_pass).alias("pass_count"),
        F.avg(F.when(is_pass, dx)).alias("mean_pass_dx"),
    )
    per_value = base.where(is_shot).groupBy("side", "location_x").agg(F.count(F.lit(1)).alias("_n"))
    median = per_value.groupBy("side").agg(F.percentile("location_x", 0.5, F.col("_n")).alias("median_shot_x"))
    return stats.join(median, "side", "left").withColumn(
        "orientation_supported",
        F.coalesce((F.col("mean_shot_x") > K.PITCH_X / 2) & (F.col("mean_pass_dx") > 0), F.lit(False)),
    )


def event_type_profile(df: DataFrame, column: str = "type") -> DataFrame:
    """Counts and shares per label."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("events"))
    total = counts.agg(F.sum("events").alias("_total"))
    return counts.select(
        column, "events", F.try_divide(F.col("events").cast("double"), total.scalar()).alias("share")
    )


def events_per_match(df: DataFrame, key: str = "match_id") -> DataFrame:
    """Matches, and the minimum, median and maximum of events per match."""
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    # Counts per size first: the exact median then works on distinct sizes only.
    sizes = per.groupBy("n").agg(F.count(F.lit(1)).alias("matches"))
    return sizes.agg(
        F.sum("matches").alias("matches"), F.min("n").alias("min_events"),
        F.percentile("n", 0.5, F.col("matches")).alias("median_events"), F.max("n").alias("max_events"),
    )


def team_dimension(matches: DataFrame, id_home="home_team_id", home="home_team", id_away="away_team_id", away="away_team") -> DataFrame:
    pairs = F.array(
        F.struct(F.col(id_home).alias("team_id"), F.col(home).alias("team")),
        F.struct(F.col(id_away).alias("team_id"), F.col(away).alias("team")),
    )
    return matches.select(F.inline(pairs)).distinct()


def player_dimension(events: DataFrame) -> DataFrame:
    return events.select("player_id", "player").dropna().distinct()


def season_summary(rows: DataFrame, keys: Sequence[str] = ("season_name", "team"), date: str = "clean_date") -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("matches"), F.min(date).alias("first_date"), F.max(date).alias("last_date")
    )


def describe_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum and maximum per column, one scan."""
    aggs, entries = [], []
    for i, x in enumerate(columns):
        v = C.no_nan(F.col(x).cast("double"))
        parts = {"present": F.count(v), "mean": F.avg(v), "std": F.stddev_samp(v), "minimum": F.min(v), "maximum": F.max(v)}
        aggs += [e.alias(f"_{k}{i}") for k, e in parts.items()]
        entries.append(F.struct(F.lit(x).alias("column_name"), *[F.col(f"_{k}{i}").alias(k) for k in parts]))
    return df.agg(*aggs).select(F.inline(F.array(*entries)))


def rows_with_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: rows, rows with any listed column missing."""
    gap = None
    for x in columns:
        gap = F.col(x).isNull() if gap is None else gap | F.col(x).isNull()
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(gap).alias("rows_with_missing"))
