"""Ordered (window) operators that stay bounded when one group is huge.

A window puts a whole group into one task. That is fine while every group is
known to be small; it is not when one team or match owns a third of the rows.
``sequence`` therefore measures the largest group first. If it fits, plain
windows are used. If not, rows are range-partitioned on (keys, order) into
blocks, written once so that block numbers cannot change on a retry, and every
window runs inside a block. What a block needs from earlier blocks (row counts,
sums, the last few rows) is carried over through a table with at most one row
per block.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage

MAX_GROUP_ROWS = 2_000_000
BLOCK = "_block"


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows in the largest group. Reads only the key columns."""
    if not keys:
        return df.count()
    row = df.groupBy(*keys).count().agg(F.max("count").alias("n")).first()
    return int(row["n"] or 0)


@dataclass
class Sequence_:
    """Rows grouped by ``keys`` in the total order ``order`` (ascending)."""

    df: DataFrame
    keys: list[str]
    order: list[str]
    blocked: bool

    @property
    def part(self) -> list[str]:
        return [*self.keys, BLOCK] if self.blocked else list(self.keys)

    @property
    def window(self):
        w = W.partitionBy(*self.part) if self.part else W.partitionBy()
        return w.orderBy(*self.order)

    def with_df(self, df: DataFrame) -> "Sequence_":
        return Sequence_(df, self.keys, self.order, self.blocked)

    def result(self) -> DataFrame:
        return self.df.drop(BLOCK)

    # -- carry tables: one row per block that continues a group ---------------

    def _across(self):
        """Window over the blocks of a group; rows are blocks, not data rows."""
        w = W.partitionBy(*self.keys) if self.keys else W.partitionBy()
        return w.orderBy(BLOCK)

    def _join(self, carried: DataFrame) -> DataFrame:
        # a row per block: Spark sends it to all tasks while it is small and joins on (keys, block) beyond
        return self.df.join(carried, self.part, "left")

    # -- operators -----------------------------------------------------------

    def row_number(self, name: str) -> "Sequence_":
        if not self.blocked:
            return self.with_df(self.df.withColumn(name, F.row_number().over(self.window).cast("long")))
        counts = self.df.groupBy(*self.part).agg(F.count(F.lit(1)).alias("_n"))
        before = counts.withColumn(
            "_before", F.sum("_n").over(self._across().rowsBetween(W.unboundedPreceding, -1))
        ).where(F.col("_before").isNotNull()).drop("_n")
        local = self.df.withColumn(name, F.row_number().over(self.window).cast("long"))
        joined = self.with_df(local)._join(before)
        return self.with_df(
            joined.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_before")
        )

    def neighbor(self, columns: dict[str, Column], step: int) -> "Sequence_":
        """Values of the previous (step -1) or next (step +1) row of the group.

        The values arrive as a struct, so a missing neighbor (NULL struct) and a
        neighbor whose value is NULL stay apart.
        """
        if step not in (-1, 1):
            raise ValueError("step must be -1 or 1")
        packed = F.struct(*[v.alias(k) for k, v in columns.items()])
        df = self.df.withColumn("_self", packed)
        shift = F.lag if step == -1 else F.lead
        df = df.withColumn("_other", shift("_self", 1).over(self.window))
        if self.blocked:
            pick = F.max_by if step == -1 else F.min_by
            edge = self.df.withColumn("_self", packed).groupBy(*self.part).agg(
                pick(F.struct("_self"), F.struct(*self.order)).alias("_edge")
            )
            edge = edge.withColumn("_carried", shift("_edge", 1).over(self._across()))
            edge = edge.where(F.col("_carried").isNotNull()).select(
                *self.part, F.col("_carried._self").alias("_carried")
            )
            df = self.with_df(df)._join(edge)
            df = df.withColumn("_other", F.coalesce("_other", "_carried")).drop("_carried")
        out = df.select(
            *[x for x in self.df.columns if x not in columns],
            *[F.col(f"_other.{k}").alias(k) for k in columns],
        )
        return self.with_df(out)

    def trailing_means(
        self, metrics: Sequence[str], windows: Sequence[int], expanding: bool = True,
        name=lambda metric, w: f"{metric}_roll{w}" if w else f"{metric}_expanding",
    ) -> "Sequence_":
        """Means of the previous w rows, and of all previous rows.

        The current row is never included; missing values are skipped; with no
        earlier value the mean is NULL.
        """
        frames = [*windows, *([None] if expanding else [])]
        if not self.blocked:
            cols = []
            for m in metrics:
                for w in frames:
                    frame = self.window.rowsBetween(W.unboundedPreceding if w is None else -w, -1)
                    cols.append(F.avg(m).over(frame).alias(name(m, w)))
            return self.with_df(self.df.select("*", *cols))
        return self._blocked_means(list(metrics), list(windows), expanding, name)

    def _blocked_means(self, metrics, windows, expanding, name) -> "Sequence_":
        deepest = max(windows) if windows else 1
        last = W.partitionBy(*self.part).orderBy(*[F.col(o).desc() for o in self.order])
        tails = (
            self.df.select(*self.part, *self.order, *metrics)
            .withColumn("_back", F.row_number().over(last))
            .where(F.col("_back") <= deepest)
            .groupBy(*self.part)
            .agg(F.array_sort(F.collect_list(
                F.struct((-F.col("_back")).alias("_pos"), *[F.col(m).cast("double").alias(m) for m in metrics])
            )).alias("_tail"))
        )
        sums = self.df.groupBy(*self.part).agg(
            *[F.sum(F.col(m).cast("double")).alias(f"_s_{m}") for m in metrics],
            *[F.count(m).alias(f"_c_{m}") for m in metrics],
        )
        across = self._across()
        earlier = across.rowsBetween(W.unboundedPreceding, -1)
        # Every earlier block holds at least one row of the group, so the last
        # `deepest` blocks hold the last `deepest` rows.
        near = across.rowsBetween(-deepest, -1)
        carried = tails.join(sums, self.part).select(
            *self.part,
            F.flatten(F.collect_list("_tail").over(near)).alias("_tail"),
            *[F.coalesce(F.sum(f"_s_{m}").over(earlier), F.lit(0.0)).alias(f"_s_{m}") for m in metrics],
            *[F.coalesce(F.sum(f"_c_{m}").over(earlier), F.lit(0)).alias(f"_c_{m}") for m in metrics],
        ).where(F.size("_tail") > 0)
        carried = carried.withColumn(
            "_tail", F.slice("_tail", F.greatest(F.size("_tail") - deepest + 1, F.lit(1)), F.lit(deepest))
        )
        df = self._join(carried).withColumn("_rn", F.row_number().over(self.window))
        cols = []
        for m in metrics:
            values = F.col(f"_tail.{m}")
            for w in windows:
                frame = self.window.rowsBetween(-w, -1)
                missing = F.lit(w + 1) - F.col("_rn")  # rows the block itself cannot give
                held = F.least(missing, F.size("_tail"))
                reach = F.slice(values, F.size("_tail") - held + 1, held)
                use = (F.col("_rn") <= w) & F.col("_tail").isNotNull() & (held > 0)
                more = F.when(use, F.aggregate(reach, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))))
                seen = F.when(use, F.size(F.filter(reach, lambda x: x.isNotNull())))
                total = F.coalesce(F.sum(F.col(m).cast("double")).over(frame), F.lit(0.0)) + F.coalesce(more, F.lit(0.0))
                count = F.count(m).over(frame) + F.coalesce(seen, F.lit(0))
                cols.append(F.when(count > 0, F.try_divide(total, count)).alias(name(m, w)))
            if expanding:
                frame = self.window.rowsBetween(W.unboundedPreceding, -1)
                total = F.coalesce(F.sum(F.col(m).cast("double")).over(frame), F.lit(0.0)) + F.coalesce(f"_s_{m}", F.lit(0.0))
                count = F.count(m).over(frame) + F.coalesce(f"_c_{m}", F.lit(0))
                cols.append(F.when(count > 0, F.try_divide(total, count)).alias(name(m, None)))
        keep = self.df.columns
        return self.with_df(df.select(*keep, *cols))

    def running_sum(self, column: str | Column, name: str) -> "Sequence_":
        """Sum of the group up to and including the current row."""
        value = F.col(column) if isinstance(column, str) else column
        df = self.df.withColumn("_v", value)
        frame = self.window.rowsBetween(W.unboundedPreceding, 0)
        if not self.blocked:
            return self.with_df(df.withColumn(name, F.sum("_v").over(frame)).drop("_v"))
        before = df.groupBy(*self.part).agg(F.sum("_v").alias("_s"))
        before = before.withColumn(
            "_before", F.sum("_s").over(self._across().rowsBetween(W.unboundedPreceding, -1))
        ).where(F.col("_before").isNotNull()).drop("_s")
        joined = self.with_df(df)._join(before)
        total = F.sum("_v").over(frame) + F.coalesce("_before", F.lit(0))
        return self.with_df(joined.withColumn(name, total).drop("_v", "_before"))


def sequence(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bound: int | None = None,
    max_rows: int | None = None,
) -> Sequence_:
    """Prepare ordered work on ``df``.

    ``bound`` is a proven upper bound on the group size, if the caller has one;
    otherwise the largest group is counted. ``order`` must be a total order
    within a group.
    """
    limit = MAX_GROUP_ROWS if max_rows is None else max_rows
    keys, order = list(keys), list(order)
    if bound is None or bound > limit:
        bound = largest_group(df, keys)
    if bound <= limit:
        return Sequence_(df, keys, order, False)
    blocks = max(2, ceil(df.count() / max(1, limit // 2)))
    ranged = df.repartitionByRange(blocks, *keys, *order).withColumn(BLOCK, F.spark_partition_id())
    return Sequence_(cut_lineage(ranged), keys, order, True)


def rank_min(df: DataFrame, keys: Sequence[str], value: str, name: str, max_rows: int | None = None) -> DataFrame:
    """Descending competition rank: ties share the smallest rank."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_neg", -F.col(value))
    seq = sequence(counts, keys, ["_neg"], max_rows=max_rows).running_sum("_n", "_upto")
    ranks = seq.result().select(*keys, F.col(value).alias("_v"), (F.col("_upto") - F.col("_n") + 1).alias(name))
    on = [df[k] == ranks[k] for k in keys] + [df[value].eqNullSafe(ranks["_v"])]
    out = df.join(ranks, on)
    for k in keys:
        out = out.drop(ranks[k])
    return out.drop("_v")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per group. Spark cuts each group to k rows before the
    shuffle (WindowGroupLimit), so a hot group is never collected."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], q: float = 0.5, limit: int = 200_000
) -> dict[str, float | None]:
    """Exact linear-interpolated quantiles without holding a column in one task.

    A column with few distinct values is settled by counting values. Otherwise an
    approximate quantile brackets the answer, everything below the bracket is
    counted, and the bracket is narrowed until it holds at most ``limit`` rows or
    a single value.
    """
    columns = list(columns)
    counts = df.agg(*[F.count(x).alias(f"n{i}") for i, x in enumerate(columns)]).first()
    out: dict[str, float | None] = {}
    for i, x in enumerate(columns):
        n = int(counts[f"n{i}"])
        if n == 0:
            out[x] = None
            continue
        position = q * (n - 1)
        low_rank = int(position)
        high_rank = min(low_rank + 1, n - 1)
        low, high = _kth_values(df.select(F.col(x).cast("double").alias("v")).where(F.col("v").isNotNull()),
                                n, [low_rank, high_rank], limit)
        out[x] = low + (high - low) * (position - low_rank)
    return out


def _kth_values(df: DataFrame, n: int, ranks: list[int], limit: int) -> list[float]:
    """Values at the given 0-based ranks of column ``v``."""
    below, rows, lo, hi = 0, df, None, None
    size = n
    while size > limit:
        eps = 0.001
        low_p = max(0.0, (ranks[0] - below) / size - 2 * eps)
        high_p = min(1.0, (ranks[-1] - below + 1) / size + 2 * eps)
        a, b = rows.approxQuantile("v", [low_p, high_p], eps)
        stat = rows.agg(
            F.count_if(F.col("v") < a).alias("lt"),
            F.count_if(F.col("v").between(a, b)).alias("mid"),
        ).first()
        if not (below + stat["lt"] <= ranks[0] and ranks[-1] < below + stat["lt"] + stat["mid"]):
            break
        if stat["mid"] == size:
            break
        below += int(stat["lt"])
        size = int(stat["mid"])
        lo, hi = a, b
        rows = df.where(F.col("v").between(lo, hi))
        if a == b:
            return [a] * len(ranks)
    seq = sequence(rows.groupBy("v").agg(F.count(F.lit(1)).alias("_n")), [], ["v"]).running_sum("_n", "_upto")
    table = seq.result()
    picked = []
    for r in ranks:
        hit = table.where(F.col("_upto") > r - below).orderBy("v").select("v").first()
        picked.append(float(hit["v"]))
    return picked
