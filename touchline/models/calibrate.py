"""Probability calibration on held-out rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import columns as C, constants as K
from . import isotonic
from .linear import apply_softmax, multinomial_logistic

P = ("p_A", "p_D", "p_H")
PHASES = ("early", "middle", "late")


class PlattModel:
    """Multinomial logistic on log probabilities, applied as column arithmetic."""

    def __init__(self, weights: Sequence[Sequence[float]], intercepts: Sequence[float]):
        self.weights, self.intercepts = weights, intercepts

    def transform(self, df: DataFrame, p: Sequence[str] = P, names: Sequence[str] = P) -> DataFrame:
        logs = [F.log(x) for x in C.clipped_probabilities(p)]
        return apply_softmax(df, logs, self.weights, self.intercepts, names, True)


def class_number(actual: str) -> Column:
    return F.when(F.col(actual) == "A", 0).when(F.col(actual) == "D", 1).when(F.col(actual) == "H", 2)


def platt_calibrate(df: DataFrame, actual: str = "actual", p: Sequence[str] = P, c: float = 1.0) -> PlattModel:
    logs = df.select(class_number(actual).alias("y"), *[F.log(x).alias(f"l{i}") for i, x in enumerate(C.clipped_probabilities(p))])
    m = multinomial_logistic(logs, [f"l{i}" for i in range(len(p))], "y", c, classes=len(p))
    return PlattModel(m.weights, m.intercepts)


class IsotonicModel:
    def __init__(self, models):
        self.models = models

    def transform(self, df: DataFrame, p: Sequence[str] = P, names: Sequence[str] = P) -> DataFrame:
        out = df.withColumns({f"_q{i}": x for i, x in enumerate(C.clipped_probabilities(p))})
        for i, m in enumerate(self.models):
            out = m.transform(out, f"_q{i}", f"_i{i}")
        raw = [F.col(f"_i{i}") for i in range(len(self.models))]
        empty = sum(raw[1:], raw[0]) <= 1e-15
        kept = [F.when(empty, F.col(f"_q{i}")).otherwise(r) for i, r in enumerate(raw)]
        out = out.withColumns(dict(zip(names, C.clipped_probabilities(kept))))
        return out.drop(*[f"_q{i}" for i in range(len(raw))], *[f"_i{i}" for i in range(len(raw))])


def isotonic_calibrate(df: DataFrame, actual: str = "actual", p: Sequence[str] = P) -> IsotonicModel:
    """One monotone fit per class; rows with equal probability are merged first,
    so the fit works on distinct probabilities with weights."""
    base = df.select(actual, *[x.alias(f"q{i}") for i, x in enumerate(C.clipped_probabilities(p))])
    models = []
    for i, k in enumerate(K.CLASSES[: len(p)]):
        merged = base.groupBy(F.col(f"q{i}").alias("_x")).agg(
            F.avg(F.when(F.col(actual) == k, 1.0).otherwise(0.0)).alias("_y"), F.count(F.lit(1)).cast("double").alias("_w"))
        models.append(isotonic.fit(merged, "_x", "_y", "_w"))
    return IsotonicModel(models)


class PhasePlatt:
    """A Platt model per match phase: CASE picks the coefficients of the row's
    phase, so there is no union and no reordering."""

    def __init__(self, models: dict[str, PlattModel]):
        self.models = models

    def transform(self, df: DataFrame, minute: str = "snapshot_minute", p: Sequence[str] = P, names: Sequence[str] = P) -> DataFrame:
        k, d = len(names), len(p)
        flat = {ph: F.array(*[F.lit(float(v)) for row, b in zip(m.weights, m.intercepts) for v in [*row, b]]) for ph, m in self.models.items()}
        col = None
        for ph, values in flat.items():
            hit = C.match_phase(minute) == ph
            col = F.when(hit, values) if col is None else col.when(hit, values)
        out = df.withColumn("_coef", col)
        at = lambda j, i: F.col("_coef")[j * (d + 1) + i]
        logs = [F.log(x) for x in C.clipped_probabilities(p)]
        weights = [[at(j, i) for i in range(d)] for j in range(k)]
        return apply_softmax(out, logs, weights, [at(j, d) for j in range(k)], names, True).drop("_coef")


class PhaseIsotonic:
    """An isotonic model per phase in one pass; rows without a minute keep their probabilities."""

    def __init__(self, models: dict[str, IsotonicModel]):
        self.models = models

    def transform(self, df: DataFrame, minute: str = "snapshot_minute", p: Sequence[str] = P, names: Sequence[str] = P) -> DataFrame:
        phase = C.match_phase(minute)
        out = df.withColumn("_phase", F.when(F.col(minute).isNotNull(), phase)).withColumns({f"_raw{i}": F.col(x) for i, x in enumerate(p)})
        raw, made = [f"_raw{i}" for i in range(len(p))], {}
        for k, m in self.models.items():
            made[k] = [f"_{k}{i}" for i in range(len(p))]
            out = m.transform(out, raw, made[k])
        kept = C.clipped_probabilities(raw)
        for i, name in enumerate(names):
            value = kept[i]
            for k in self.models:
                value = F.when(F.col("_phase") == k, F.col(made[k][i])).otherwise(value)
            out = out.withColumn(f"_out{i}", value)
        out = out.drop(*[n for n in names if n in out.columns])
        return out.withColumnsRenamed({f"_out{i}": n for i, n in enumerate(names)}).drop("_phase", *raw, *[x for xs in made.values() for x in xs])


def phase_calibrate(df: DataFrame, minute: str = "snapshot_minute", actual: str = "actual", p: Sequence[str] = P, method: str = "platt"):
    phase = C.match_phase(minute)
    if method == "platt":
        return PhasePlatt({k: platt_calibrate(df.where(phase == k), actual, p) for k in PHASES})
    if method == "isotonic":
        return PhaseIsotonic({k: isotonic_calibrate(df.where(phase == k), actual, p) for k in PHASES})
    raise ValueError(f"unknown calibration {method!r}")


class MarginMapper:
    def __init__(self, weights: Sequence[float], intercepts: Sequence[float]):
        self.weights, self.intercepts = weights, intercepts

    def transform(self, df: DataFrame, prediction: str = "prediction", names: Sequence[str] = P) -> DataFrame:
        return apply_softmax(df, [F.col(prediction)], [[w] for w in self.weights], self.intercepts, names, False)


def margin_to_probs(df: DataFrame, prediction: str = "prediction", actual: str = "actual", c: float = 1.0) -> MarginMapper:
    """Outcome probabilities from one predicted margin."""
    data = df.select(F.col(prediction).cast("double").alias("x"), class_number(actual).alias("y"))
    m = multinomial_logistic(data, ["x"], "y", c, classes=3)
    return MarginMapper([r[0] for r in m.weights], m.intercepts)
