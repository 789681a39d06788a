"""Data-quality rules: one aggregate per table, results as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


class QualityError(ValueError):
    pass


def check_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Count the rows that break each rule (a rule is the *bad* condition).

    All rules share one scan and one aggregate.
    """
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(bad).alias(f"_r{i}") for i, bad in enumerate(rules.values())],
    )
    entries = [
        F.struct(F.lit(name).alias("rule"), F.col("rows"), F.col(f"_r{i}").alias("violations"))
        for i, name in enumerate(rules)
    ]
    return counts.select(F.inline(F.array(*entries))).withColumn("passed", F.col("violations") == 0)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def check_unique(df: DataFrame, keys: Sequence[str], name: str = "unique_key") -> DataFrame:
    """One row: number of keys, duplicated keys, rows with a NULL key part."""
    null_key = None
    for k in keys:
        null_key = F.col(k).isNull() if null_key is None else null_key | F.col(k).isNull()
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.lit(name).alias("rule"),
        F.count(F.lit(1)).alias("keys"),
        F.count_if(F.col("_n") > 1).alias("duplicate_keys"),
        F.coalesce(F.sum(F.when(null_key, F.col("_n"))), F.lit(0)).alias("null_key_rows"),
    ).withColumn("passed", (F.col("duplicate_keys") == 0) & (F.col("null_key_rows") == 0))


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raise when a key repeats or is NULL; return the frame unchanged."""
    row = check_unique(df, keys).first()
    if not row["passed"]:
        raise QualityError(
            f"key {list(keys)}: {row['duplicate_keys']} duplicates, {row['null_key_rows']} NULL"
        )
    return df


def require(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Raise with the names of broken rules; return the frame unchanged."""
    broken = [r["rule"] for r in check_rules(df, rules).where(~F.col("passed")).collect()]
    if broken:
        raise QualityError(f"broken rules: {', '.join(broken)}")
    return df


def key_set_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: keys in both, only left, only right (full join on distinct keys)."""
    a = left.select(*keys).distinct().withColumn("_l", F.lit(1))
    b = right.select(*keys).distinct().withColumn("_r", F.lit(1))
    both = a.join(b, list(keys), "full")
    return both.agg(
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("in_both"),
        F.count_if(F.col("_r").isNull()).alias("only_left"),
        F.count_if(F.col("_l").isNull()).alias("only_right"),
    )


def group_size_check(df: DataFrame, keys: Sequence[str], expected: int) -> DataFrame:
    """One row: groups, groups whose size differs from the expected one."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per.agg(
        F.count(F.lit(1)).alias("groups"),
        F.count_if(F.col("_n") != expected).alias("wrong_size"),
    )


def label_consistency(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """One row: groups, groups carrying more than one distinct label.

    min <> max says the same as a distinct count above one, without a second
    shuffle.
    """
    per = df.groupBy(*keys).agg(F.min(label).alias("_a"), F.max(label).alias("_b"))
    return per.agg(
        F.count(F.lit(1)).alias("groups"),
        F.count_if(F.col("_a") != F.col("_b")).alias("mixed_groups"),
    )


def partition_order_check(df: DataFrame, role: str, date: str, roles: Sequence[str]) -> DataFrame:
    """Roles with their date ranges, and whether each starts after the last ended."""
    span = df.groupBy(role).agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"),
                                F.count(F.lit(1)).alias("rows"))
    position = F.array_position(F.array(*[F.lit(r) for r in roles]), F.col(role))
    # At most one row per role.
    from pyspark.sql import Window as W

    w = W.partitionBy(F.lit(0)).orderBy("position")
    return (
        span.where(F.col(role).isin(*roles)).withColumn("position", position)
        .withColumn("strictly_after", F.coalesce(F.col("first_date") > F.lag("last_date").over(w), F.lit(True)))
    )


def predictor_rules(
    columns: Sequence[str], forbidden: Sequence[str], history_suffixes: Sequence[str], dtypes: dict[str, str]
) -> list[tuple[str, str]]:
    """Name and type rules of predictor columns; returns (column, problem)."""
    numeric = ("int", "bigint", "double", "float", "smallint", "tinyint", "long")
    out = []
    for x in columns:
        if x in forbidden:
            out.append((x, "forbidden"))
        if history_suffixes and not any(s in x for s in history_suffixes):
            out.append((x, "not historical"))
        if dtypes[x] not in numeric and not dtypes[x].startswith("decimal"):
            out.append((x, "not numeric"))
    return out


def missing_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: NULL, NaN and infinite counts."""
    aggs = []
    for i, x in enumerate(columns):
        v = F.col(x)
        aggs.append(F.count_if(v.isNull()).alias(f"_n{i}"))
        d = v.cast("double")
        aggs.append(F.count_if(F.isnan(d)).alias(f"_a{i}"))
        aggs.append(F.count_if(F.abs(d) == float("inf")).alias(f"_i{i}"))
    entries = [
        F.struct(F.lit(x).alias("column_name"), F.col(f"_n{i}").alias("nulls"), F.col(f"_a{i}").alias("nans"),
                 F.col(f"_i{i}").alias("infinite"))
        for i, x in enumerate(columns)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*entries)))
