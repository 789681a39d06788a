"""Isotonic regression by pooling adjacent violators in ranges.

Rows with equal x become one block (sum of weights and of weighted y). Blocks are
cut into ranges of x of a bounded number of rows, every range is pooled by one
task, and as pooling is associative the pooled blocks are pooled again with other
borders, half a range further, until no two neighbors violate the order. Labels
pool into few blocks, so the rounds are few; no task ever holds more than a range.
The model is two knots per block, interpolated linearly and constant outside.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from ..session import shared_folder

RANGE_ROWS = 200_000
MOST_KNOTS = 1 << 22  # the model is sent to all tasks


@dataclass
class Knots:
    x: np.ndarray
    y: np.ndarray

    def transform(self, df: DataFrame, column: str, name: str) -> DataFrame:
        xs, ys = self.x, self.y

        @pandas_udf("double")
        def read(v: pd.Series) -> pd.Series:
            return pd.Series(np.where(v.isna(), np.nan, np.interp(v.fillna(0.0), xs, ys)))

        return df.withColumn(name, F.nanvl(read(F.col(column)), F.lit(None).cast("double")))


def pooled(low: list, high: list, s: list, w: list) -> tuple[list, list, list, list]:
    """Blocks in order of x without violations."""
    out: list[list[float]] = []
    for block in zip(low, high, s, w, strict=True):
        now = list(block)
        while out and out[-1][2] * now[3] >= now[2] * out[-1][3]:
            last = out.pop()
            now = [last[0], now[1], last[2] + now[2], last[3] + now[3]]
        out.append(now)
    return tuple(list(c) for c in zip(*out, strict=True)) if out else ([], [], [], [])


def _pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pools the runs of one range number; rows come sorted by (part, low)."""
    held: dict[int, list[list]] = {}
    for b in batches:
        columns = [b.column(i).to_pylist() for i in range(5)]
        for part in dict.fromkeys(columns[0]):
            rows = [i for i, p in enumerate(columns[0]) if p == part]
            mine = held.setdefault(part, [[], [], [], []])
            for j in range(4):
                mine[j] += [columns[j + 1][i] for i in rows]
            held[part] = list(pooled(*mine))
    for part, blocks in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(blocks[0]), pa.int32()), *[pa.array(c, pa.float64()) for c in blocks]], names=["part", "low", "high", "s", "w"])


def _saved(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/blocks-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fit(df: DataFrame, x: str, y: str, w: str, range_rows: int = RANGE_ROWS) -> Knots:
    """Least squares under y not falling in x; rows with a null are left out."""
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(w).cast("double").alias("w")).where("x IS NOT NULL AND y IS NOT NULL AND w > 0")
    blocks = _saved(rows.groupBy("x").agg(F.sum(F.col("y") * F.col("w")).alias("s"), F.sum("w").alias("w")).select(F.col("x").alias("low"), F.col("x").alias("high"), "s", "w"))
    turn = 0
    while True:
        parts = max(1, ceil(blocks.count() / range_rows))
        part = F.lit(0)
        if parts > 1:
            shares = [(j + 0.5 * (turn % 2)) / parts for j in range(1 - turn % 2, parts)]
            edges = sorted(set(blocks.approxQuantile("low", shares, 0.1 / parts)))
            part = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col("low")))
        dealt = blocks.select(part.cast("int").alias("part"), "low", "high", "s", "w")
        dealt = (dealt.repartition(parts, "part") if parts > 1 else dealt.coalesce(1)).sortWithinPartitions("part", "low")
        blocks = _saved(dealt.mapInArrow(_pool, "part int, low double, high double, s double, w double"))
        ends = blocks.groupBy("part").agg(
            F.min_by(F.struct("s", "w"), "low").alias("first"), F.max_by(F.struct("s", "w"), "low").alias("last")).orderBy("part").collect()  # a row per range
        mean = lambda r: r["s"] / r["w"]
        if all(mean(a["last"]) < mean(b["first"]) for a, b in zip(ends[:-1], ends[1:], strict=True)):
            break
        blocks, turn = blocks.drop("part"), turn + 1
    if blocks.count() > MOST_KNOTS // 2:
        raise ValueError(f"more than {MOST_KNOTS // 2} different levels: round x or y first")
    found = blocks.orderBy("low").toPandas()
    level = (found["s"] / found["w"]).to_numpy()
    if not len(found):
        return Knots(np.zeros(1), np.zeros(1))
    return Knots(np.stack([found["low"], found["high"]], axis=1).reshape(-1), np.repeat(level, 2))
