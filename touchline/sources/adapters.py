"""Match and event views over the shared test tables.

Only integer arithmetic, CASE, row_number and timestamp offsets are used, so any
SQL engine gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ordered import largest_group, sequence


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    home = F.pmod(cust, F.lit(40))
    away = (home + 1 + (k * 7 + cust) % 39) % 40
    seconds = (k.cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")  # keys may exceed 32 bits
    kickoff = F.col("o_orderdate") + F.make_dt_interval(secs=seconds)
    return table(spark, sf_dir, "orders").select(
        k.alias("match_id"),
        kickoff.alias("clean_date"),
        F.year("o_orderdate").cast("string").alias("season_name"),
        home.alias("home_team"),
        away.alias("away_team"),
        ((k * 31 + cust) % 9).alias("home_score"),
        ((k * 17 + 3) % 8).alias("away_score"),
        (F.lit(1.2).cast("double") + ((k * 11) % 50) / F.lit(10.0)).alias("b365h"),
        (F.lit(2.5).cast("double") + ((k * 13) % 30) / F.lit(10.0)).alias("b365d"),
        (F.lit(1.4).cast("double") + ((k * 19) % 60) / F.lit(10.0)).alias("b365a"),
    )


def event_bound(spark: SparkSession, sf_dir: str) -> int:
    """Events of the largest match; bounds every per-match group below it."""
    return largest_group(table(spark, sf_dir, "events"), ["user_id"])


def events(spark: SparkSession, sf_dir: str, bound: int | None = None, max_rows: int | None = None) -> DataFrame:
    raw = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    seq = sequence(raw, ["user_id"], ["ts", "event_id"], bound=bound, max_rows=max_rows)
    return event_columns(seq.row_number("idx").result())


def event_columns(df: DataFrame) -> DataFrame:
    """Event columns from ``event_id, user_id, event_type, value, idx``."""
    e, idx, user = F.col("event_id"), F.col("idx"), F.col("user_id")
    kind = (
        F.when(F.col("event_type") == "view", "Pass")
        .when(F.col("event_type") == "click", "Carry")
        .when(F.col("event_type") == "purchase", "Shot")
        .when(F.col("event_type") == "error", "Pressure")
        .when(F.col("event_type") == "signup", "Ball Recovery")
    )
    late = F.when((e % 11 == 0) & (idx > 5), 1).otherwise(0)
    possession = F.greatest(F.floor((idx - 1) / 4) + 1 - late, F.lit(1))
    df = df.select(
        user.alias("match_id"), e.alias("id"), idx.cast("long").alias("idx"), "value",
        F.when(idx <= 33, 1).otherwise(2).alias("period"),
        ((idx - 1) * F.lit(80.0).cast("double") + (e % 3) * F.lit(0.001).cast("double")).alias("t"),
        kind.alias("type"),
        F.when(e % 2 == 0, "Home").otherwise("Away").alias("team"),
        possession.cast("long").alias("possession"),
    )
    e = F.col("id")
    tenth = lambda m, n: ((e * m) % n) / F.lit(10.0).cast("double")
    spatial = e % 13 != 0
    is_pass, is_shot = F.col("type") == "Pass", F.col("type") == "Shot"
    return df.select(
        "match_id", "id", "idx", "period", "t", "type", "team", "possession",
        F.when((F.col("possession") + F.col("match_id")) % 3 == 0, "Home").otherwise("Away").alias("possession_team"),
        F.when(spatial, tenth(37, 1201)).alias("location_x"),
        F.when(spatial, tenth(53, 801)).alias("location_y"),
        F.when(is_pass, tenth(71, 1201)).alias("pass_end_x"),
        F.when(is_pass, tenth(29, 801)).alias("pass_end_y"),
        F.when(is_pass & (e % 4 == 0), "Incomplete").alias("pass_outcome"),
        F.when(is_shot, F.when(e % 5 == 0, "Goal").when(e % 5 == 1, "Saved").otherwise("Off T")).alias("shot_outcome"),
        F.when(is_shot, F.col("value") / F.lit(1000.0).cast("double")).alias("shot_xg"),
        F.lit("Home").alias("home_team"),
        F.lit("Away").alias("away_team"),
    )
