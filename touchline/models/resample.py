"""Synthetic minority rows (SMOTE, borderline SMOTE, ADASYN), training rows only.

Neighbors come from projection hashing (exact up to a bucket of rows, see
``hashed``). Every random choice is a hash of the sample number, so the synthetic
rows do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.hashing import uniform_hash
from ..operators.ordered import sequence
from ..session import cut_lineage
from .hashed import hashed_knn


def _interpolate(a: str, b: str, share: str):
    return F.zip_with(F.col(a), F.col(b), lambda x, y: x + F.col(share) * (y - x))


def _draw(seeds: DataFrame, samples: int, minority: DataFrame, k: int, key: str, vector: str, label: str, value, seed: int) -> DataFrame:
    """``samples`` rows on segments between a seed row and one of its k neighbors.

    ``seeds`` has ``key``, ``vector`` and cumulative sample numbers ``first`` and
    ``last``: sample s starts from the row with first <= s < last.
    """
    near = hashed_knn(seeds, minority, k, key, vector).select(F.col(key), F.col("rank"), "neighbor")
    have = near.groupBy(key).agg(F.max("rank").alias("_have"))
    chosen = seeds.join(have, key).withColumn("sample", F.explode(F.sequence("first", F.col("last") - 1)))
    u, v = uniform_hash(F.lit(seed + 1), F.col("sample")), uniform_hash(F.lit(seed + 2), F.col("sample"))
    chosen = chosen.withColumns({"rank": (F.floor(u * F.col("_have")) + 1).cast("int"), "_share": v})
    ends = minority.select(F.col(key).alias("neighbor"), F.col(vector).alias("_end"))
    rows = chosen.join(near, [key, "rank"]).join(ends, "neighbor")
    return rows.select(
        "sample", F.col(key).alias("seed_id"), F.col("neighbor").alias("neighbor_id"), F.col("_share").alias("share"),
        _interpolate(vector, "_end", "_share").alias(vector), F.lit(value).alias(label))


def _numbered(rows: DataFrame, counts: str, key: str) -> DataFrame:
    """Cumulative sample ranges from per-row counts, without one global task."""
    seq = sequence(rows, [], [key]).running_sum(counts, "last")
    return seq.result().withColumn("first", F.col("last") - F.col(counts)).where(F.col(counts) > 0)


def _even_counts(rows: DataFrame, samples: int, n: int, key: str) -> DataFrame:
    """Spread ``samples`` over ``n`` rows as evenly as possible, in key order."""
    numbered = sequence(rows, [], [key], bound=n).row_number("_i").result()
    base, extra = divmod(samples, n)
    return numbered.withColumn("_count", F.lit(base) + F.when(F.col("_i") <= extra, 1).otherwise(0)).drop("_i")


def _sizes(df: DataFrame, label: str, value) -> tuple[int, int]:
    """(rows of the class, rows of the largest class)."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    return counts[value], max(counts.values())


def _plain(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias(vector))


def smote(df: DataFrame, label: str, value, key: str = "id", vector: str = "vector", k: int = 3, seed: int = 42) -> DataFrame:
    """Synthetic rows that bring class ``value`` up to the largest class."""
    n, top = _sizes(df, label, value)
    minority = cut_lineage(_plain(df.where(F.col(label) == value), key, vector))
    seeds = _numbered(_even_counts(minority, top - n, n, key), "_count", key)
    return _draw(seeds, top - n, minority, k, key, vector, label, value, seed)


def danger_rows(df: DataFrame, label: str, value, key: str = "id", vector: str = "vector", m: int = 10) -> DataFrame:
    """Minority rows whose m nearest rows are mostly, but not all, of other classes."""
    minority = df.where(F.col(label) == value)
    other = df.select(F.col(key).cast("long").alias("neighbor"), (F.col(label) != value).cast("int").alias("_other"))
    near = hashed_knn(minority, df, m, key, vector).join(other, "neighbor")
    counts = near.groupBy(key).agg(F.sum("_other").alias("others"), F.count(F.lit(1)).alias("seen"))
    return counts.where((F.col("others") * 2 >= F.col("seen")) & (F.col("others") < F.col("seen"))).select(key)


def borderline_smote(df: DataFrame, label: str, value, key: str = "id", vector: str = "vector", k: int = 3, m: int = 10, seed: int = 42) -> DataFrame:
    """SMOTE seeded only from danger rows."""
    n, top = _sizes(df, label, value)
    minority = cut_lineage(_plain(df.where(F.col(label) == value), key, vector))
    danger = cut_lineage(minority.join(danger_rows(df, label, value, key, vector, m), key, "left_semi"))
    found = danger.count()
    if found == 0:
        return _draw(danger.withColumns({"first": F.lit(0).cast("long"), "last": F.lit(0).cast("long")}).where(F.lit(False)), 0, minority, k, key, vector, label, value, seed)
    seeds = _numbered(_even_counts(danger, top - n, found, key), "_count", key)
    return _draw(seeds, top - n, minority, k, key, vector, label, value, seed)


def adasyn(df: DataFrame, label: str, value, key: str = "id", vector: str = "vector", k: int = 3, seed: int = 42) -> DataFrame:
    """Synthetic counts proportional to the share of other classes nearby."""
    n, top = _sizes(df, label, value)
    minority = cut_lineage(_plain(df.where(F.col(label) == value), key, vector))
    other = df.select(F.col(key).cast("long").alias("neighbor"), (F.col(label) != value).cast("int").alias("_other"))
    shares = hashed_knn(minority, df, k, key, vector).join(other, "neighbor").groupBy(key).agg(F.avg("_other").alias("_ratio"))
    total = shares.agg(F.sum("_ratio")).first()[0] or 0.0
    if total == 0:
        raise ValueError("no row of another class among the neighbors")
    # Rounding the running total, not each share, keeps the exact number of rows.
    running = sequence(minority.join(shares, key), [], [key], bound=n).running_sum("_ratio", "_upto").result()
    scale = (top - n) / float(total)
    seeds = running.withColumns({
        "first": F.round((F.col("_upto") - F.col("_ratio")) * scale).cast("long"), "last": F.round(F.col("_upto") * scale).cast("long"),
    }).where(F.col("last") > F.col("first"))
    return _draw(seeds, top - n, minority, k, key, vector, label, value, seed)
