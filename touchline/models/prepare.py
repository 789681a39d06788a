"""Training-only preparation: median imputation, scaling, class weights."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from ..operators.ordered import exact_quantiles

EXACT_DISTINCT = 50_000


@dataclass
class MedianModel:
    medians: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            x: F.coalesce(F.nanvl(F.col(x).cast("double"), F.lit(None).cast("double")), F.lit(m))
            for x, m in self.medians.items()
        })


def median_impute(df: DataFrame, columns: Sequence[str]) -> MedianModel:
    """Exact medians; a column without any value is kept and filled with 0.

    Columns with few distinct values take one shared aggregate, whose state grows
    with distinct values only. The others go through bracketing.
    """
    clean = df.select(*[F.nanvl(F.col(x).cast("double"), F.lit(None).cast("double")).alias(x) for x in columns])
    sizes = clean.agg(*[F.approx_count_distinct(x).alias(x) for x in columns]).first()
    small = [x for x in columns if sizes[x] <= EXACT_DISTINCT]
    large = [x for x in columns if sizes[x] > EXACT_DISTINCT]
    out: dict[str, float | None] = {}
    if small:
        row = clean.agg(*[F.percentile(x, 0.5).alias(x) for x in small]).first()
        out.update({x: row[x] for x in small})
    if large:
        out.update(exact_quantiles(clean, large, 0.5))
    return MedianModel({x: float(out[x]) if out[x] is not None else 0.0 for x in columns})


@dataclass
class ScaleModel:
    mean: dict[str, float]
    std: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            x: (F.col(x).cast("double") - F.lit(self.mean[x])) / F.lit(self.std[x]) for x in self.mean
        })


def standard_scale(df: DataFrame, columns: Sequence[str]) -> ScaleModel:
    """Mean and population deviation of each column; a constant column keeps scale 1."""
    row = df.agg(
        *[F.avg(x).alias(f"m{i}") for i, x in enumerate(columns)],
        *[F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(columns)],
    ).first()
    mean = {x: float(row[f"m{i}"] or 0.0) for i, x in enumerate(columns)}
    std = {x: float(row[f"s{i}"] or 0.0) or 1.0 for i, x in enumerate(columns)}
    return ScaleModel(mean, std)


def assemble(df: DataFrame, columns: Sequence[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=name).transform(df)


def class_weight_balanced(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """n / (K * n_k) per row, as one expression over the classes, which are few; rows without a label get none."""
    counts = {r[label]: r["count"] for r in df.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    total, weight = sum(counts.values()), F.lit(None).cast("double")
    for value, n in counts.items():
        weight = F.when(F.col(label) == value, F.lit(total / (len(counts) * n))).otherwise(weight)
    return df.withColumn(name, weight).where(F.col(label).isNotNull())


class Prepared:
    """A model behind the medians, and if wanted the scales, of its training rows."""

    def __init__(self, steps: Sequence, model) -> None:  # noqa: ANN001
        self.steps, self.model = list(steps), model

    def transform(self, df: DataFrame, *names) -> DataFrame:  # noqa: ANN002
        for step in self.steps:
            df = step.transform(df)
        return self.model.transform(df, *names)


def prepared(fit: Callable, scale: bool = True) -> Callable:
    """``fit(train, columns, ...)`` on imputed, and if wanted scaled, columns."""

    def run(train: DataFrame, columns: Sequence[str], **params) -> Prepared:
        steps = [median_impute(train, columns)]
        train = steps[0].transform(train)
        if scale:
            steps.append(standard_scale(train, columns))
            train = steps[1].transform(train)
        return Prepared(steps, fit(train, columns, **params))

    return run
