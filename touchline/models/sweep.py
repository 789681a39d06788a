"""Model selection: candidates x feature groups, and grid search over folds.

The driver only loops over specifications. Each fit is distributed, forecasts of
all candidates form one long table, and all metrics come from one grouping.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame, functions as F

from ..operators import scoring as SC

P = ("p_A", "p_D", "p_H")


@dataclass
class Spec:
    """``fit(train, columns, **params)`` returns an object with ``transform``."""

    model: str
    fit: Callable
    columns: Sequence[str]
    feature_group: str = "combined"
    params: dict | None = None


def expand(model: str, fit: Callable, columns: Sequence[str], grid: dict[str, Sequence], feature_group: str = "combined") -> list[Spec]:
    names = list(grid)
    return [Spec(model, fit, columns, feature_group, dict(zip(names, v))) for v in product(*grid.values())]


def _stack(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _predict(spec: Spec, number: int, train: DataFrame, test: DataFrame, keep: Sequence[str], margin: bool) -> DataFrame:
    fitted = spec.fit(train, list(spec.columns), **(spec.params or {}))
    out = fitted.transform(test) if margin else fitted.transform(test, P)
    text = ",".join(f"{k}={v}" for k, v in (spec.params or {}).items())
    return out.select(
        *keep, F.lit(spec.model).alias("model"), F.lit(number).alias("candidate"), F.lit(spec.feature_group).alias("feature_group"),
        F.lit(text).alias("params"), *(["prediction"] if margin else P))


def model_sweep(train: DataFrame, validation: DataFrame, specs: Sequence[Spec], keep: Sequence[str], actual: str = "actual") -> tuple[DataFrame, DataFrame]:
    """(metrics per candidate, best candidate per model by RPS)."""
    table = _stack([_predict(s, i, train, validation, keep, False) for i, s in enumerate(specs)])
    metrics = SC.metrics_by(SC.with_losses(table, actual), ["model", "candidate", "feature_group", "params"])
    return metrics, SC.best_per_group(metrics, ["model"], "rps", ["candidate"])


def margin_sweep(train: DataFrame, validation: DataFrame, specs: Sequence[Spec], keep: Sequence[str], target: str = "goal_margin") -> tuple[DataFrame, DataFrame]:
    """The same for margin models: clipped predictions, best by MAE."""
    from .linear import clip_margin

    table = _stack([_predict(s, i, train, validation, keep, True) for i, s in enumerate(specs)]).withColumn("prediction", clip_margin("prediction"))
    metrics = SC.regression_metrics(table, ["model", "candidate", "feature_group", "params"], target)
    return metrics, SC.best_per_group(metrics, ["model"], "mae", ["candidate"])


def grid_search(members: DataFrame, folds: int, specs: Sequence[Spec], keep: Sequence[str], actual: str = "actual") -> DataFrame:
    """Mean RPS over date-blocked folds per candidate, best first."""
    parts = []
    for f in range(1, folds + 1):
        fold = members.where(F.col("fold") == f)
        train, test = fold.where(F.col("role") == "train"), fold.where(F.col("role") == "validation")
        for i, s in enumerate(specs):
            parts.append(_predict(s, i, train, test, keep, False).withColumn("fold", F.lit(f)))
    losses = SC.with_losses(_stack(parts), actual)
    per = losses.groupBy("model", "candidate", "params", "fold").agg(F.avg("rps").alias("rps"))
    return SC.cv_summary(per, ["model", "candidate", "params"], "rps").orderBy("mean", "candidate")
