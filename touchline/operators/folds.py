"""Expanding, date-blocked folds as a table, not as index lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def date_blocks(rows: DataFrame, splits: int, date: str = "clean_date") -> DataFrame:
    """Block 0..splits of every calendar day, by equal numbers of unique days.

    As in an expanding time-series split over n days, the last ``splits`` blocks
    hold floor(n / (splits + 1)) days each and the first block takes the rest.
    The table has one row per calendar day, which bounds the window.
    """
    days = rows.select(F.to_date(date).alias("day")).distinct()
    ranked = days.withColumn("_r", F.row_number().over(W.orderBy("day"))).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy()))
    size = F.floor(F.col("_n") / (splits + 1))
    from_end = F.col("_n") - F.col("_r")  # 0 for the last day
    block = F.greatest(F.lit(splits) - F.floor(F.try_divide(from_end, size)), F.lit(0)).cast("int")
    return ranked.select("day", block.alias("block"))


def with_block(rows: DataFrame, splits: int, date: str = "clean_date") -> DataFrame:
    blocks = date_blocks(rows, splits, date)
    return rows.withColumn("day", F.to_date(date)).join(blocks, "day").drop("day")


def fold_members(blocked: DataFrame, splits: int) -> DataFrame:
    """(row, fold, role): fold f trains on blocks < f and validates on block f."""
    folds = F.explode(F.sequence(F.lit(1), F.lit(splits))).alias("fold")
    out = blocked.select("*", folds).where(F.col("block") <= F.col("fold"))
    return out.withColumn("role", F.when(F.col("block") < F.col("fold"), "train").otherwise("validation"))


def fold_summary(members: DataFrame, date: str = "clean_date") -> DataFrame:
    return members.groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("rows"), F.min(F.to_date(date)).alias("first_day"), F.max(F.to_date(date)).alias("last_day")
    )
