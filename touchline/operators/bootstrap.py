"""Percentile bootstrap intervals with Poisson(1) weights.

A draw gives every row a Poisson(1) count, the large-sample form of drawing n
rows with replacement, which needs no knowledge of n and no row shipping. Counts
come from arithmetic on (draw, row key). A task keeps one vector of weighted sums
per group, with a place per draw; only these vectors are shuffled, and they add up
in any number of steps.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from ..functions.hashing import PRIME, poisson_ones, uniforms

ROWS_AT_ONCE = 256  # rows by draws are worked on in blocks
VECTOR_BYTES = 1 << 26  # of a task's vectors before it hands them on


def _vectors(batches: Iterator[pa.RecordBatch], groups: int, draws: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Per group the sums of weight * total and weight * size of every draw."""
    held: dict[tuple, np.ndarray] = {}
    numbers = np.arange(1, draws + 1, dtype=np.int64)

    def hand_on() -> pa.RecordBatch:
        columns = [pa.array([key[i] for key in held], schema.field(i).type) for i in range(groups)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([v.tobytes() for v in held.values()], pa.binary())], schema=schema)

    for b in batches:
        keys = list(zip(*[b.column(i).to_pylist() for i in range(groups)], strict=True)) if groups else [()] * len(b)
        places: dict[tuple, list[int]] = {}
        for i, key in enumerate(keys):
            places.setdefault(key, []).append(i)
        unit, both = b.column(groups).to_numpy(), np.stack([b.column(groups + j).to_numpy(zero_copy_only=False) for j in (1, 2)], axis=1) if len(b) else np.zeros((0, 2))
        for key, rows in places.items():
            sums = held.setdefault(key, np.zeros((draws, 2)))
            for at in range(0, len(rows), ROWS_AT_ONCE):
                part = rows[at : at + ROWS_AT_ONCE]
                sums += poisson_ones(uniforms(numbers[:, None], unit[part][None, :])) @ both[part]
        if len(held) * draws * 16 > VECTOR_BYTES:
            yield hand_on()
            held.clear()
    if held:
        yield hand_on()


def _draw_means(df: DataFrame, groups: Sequence[str], unit: str, total: str, weight: str, draws: int) -> DataFrame:
    """(groups, draw, statistic): the weighted mean of every draw; NULL if a draw has no weight."""
    kept = [df.schema[g] for g in groups]
    rows = df.select(*groups, F.pmod(F.col(unit).cast("long"), F.lit(PRIME)).alias("_unit"), F.col(total).cast("double").alias("_total"), F.col(weight).cast("double").alias("_weight"))
    rows = rows.where("_unit IS NOT NULL AND _total IS NOT NULL AND _weight IS NOT NULL")
    sums = StructType([*kept, StructField("_sums", BinaryType())])
    out = StructType([*kept, StructField("draw", LongType()), StructField("statistic", DoubleType())])
    n = len(groups)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        yield from _vectors(batches, n, draws, to_arrow_schema(sums))

    def means(table: pa.Table) -> pa.Table:
        parts = sorted(x.as_py() for x in table.column("_sums"))  # one order of adding, whatever arrived first
        whole = sum(np.frombuffer(x).reshape(draws, 2) for x in parts)
        statistic = [t / w if w else None for t, w in whole.tolist()]
        columns = [table.column(g).combine_chunks().take(pa.array(np.zeros(draws, np.int64))) for g in groups]
        return pa.Table.from_arrays([*columns, pa.array(np.arange(1, draws + 1)), pa.array(statistic, pa.float64())], names=[*groups, "draw", "statistic"])

    return rows.mapInArrow(partial, sums).groupBy(*(groups or [F.lit(0).alias("_all")])).applyInArrow(means, out)


def _interval(per_draw: DataFrame, groups: Sequence[str], level: float) -> DataFrame:
    tail = (1.0 - level) / 2.0
    # At most `draws` values per group.
    return per_draw.groupBy(*groups).agg(
        F.count("statistic").alias("draws"),
        F.percentile("statistic", tail).alias("ci_lower"),
        F.percentile("statistic", 1.0 - tail).alias("ci_upper"),
    )


def bootstrap_ci(
    df: DataFrame, value: str, unit: str, groups: Sequence[str] = (), draws: int = 2000, level: float = 0.95
) -> DataFrame:
    """Interval of the mean of ``value``; ``unit`` is a unique integer row key."""
    base = df.select(*groups, unit, F.col(value).cast("double").alias("_v"), F.lit(1.0).alias("_one")).where(F.col("_v").isNotNull())
    mean = base.groupBy(*groups).agg(F.count(F.lit(1)).alias("rows"), F.avg("_v").alias("mean"))
    ci = _interval(_draw_means(base, groups, unit, "_v", "_one", draws), groups, level)
    return mean.join(ci, list(groups)) if groups else _one_row(mean, ci)


def group_bootstrap_ci(
    df: DataFrame, value: str, cluster: str, groups: Sequence[str] = (), draws: int = 1000, level: float = 0.95
) -> DataFrame:
    """Interval of the row mean when whole clusters (matches) are resampled.

    Rows are reduced to one (sum, count) per cluster first.
    """
    per = df.groupBy(*groups, cluster).agg(F.sum(F.col(value).cast("double")).alias("_v"), F.count(value).cast("double").alias("_n"))
    mean = per.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("clusters"), F.try_divide(F.sum("_v"), F.sum("_n")).alias("mean")
    )
    ci = _interval(_draw_means(per, groups, cluster, "_v", "_n", draws), groups, level)
    return mean.join(ci, list(groups)) if groups else _one_row(mean, ci)


def _one_row(mean: DataFrame, ci: DataFrame) -> DataFrame:
    """Both sides are single-row aggregates; join them on a constant."""
    return mean.withColumn("_k", F.lit(1)).join(ci.withColumn("_k", F.lit(1)), "_k").drop("_k")
