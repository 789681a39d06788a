"""Batch scoring tables and nested documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import columns as C
from ..models.linear import clip_margin

RAW, CAL, DER = ("p_A", "p_D", "p_H"), ("calibrated_A", "calibrated_D", "calibrated_H"), ("margin_A", "margin_D", "margin_H")


def score_prematch(features: DataFrame, classifier, calibrator, regressor, mapper, keep: Sequence[str] = ("match_id",)) -> DataFrame:
    """Raw and calibrated triple, class, clipped margin and its derived triple."""
    df = classifier.transform(features, RAW)
    df = df.withColumns(dict(zip(RAW, C.checked_probabilities(RAW))))
    df = calibrator.transform(df, names=CAL)
    df = regressor.transform(df).withColumn("predicted_margin", clip_margin("prediction")).drop("prediction")
    df = mapper.transform(df, "predicted_margin", DER)
    return df.select(*keep, *RAW, *CAL, C.argmax_class(*CAL).alias("predicted"), "predicted_margin", *DER)


def score_inplay(
    snapshots: DataFrame, classifier, phase_calibrator, regressor, mapper,
    keep: Sequence[str] = ("match_id", "snapshot_minute", "home_score", "away_score"),
) -> DataFrame:
    """As above per snapshot, with phase-wise calibration and the score so far."""
    df = classifier.transform(snapshots, RAW)
    df = df.withColumns(dict(zip(RAW, C.checked_probabilities(RAW))))
    df = phase_calibrator.transform(df, names=CAL)
    df = regressor.transform(df).withColumn("predicted_margin", clip_margin("prediction")).drop("prediction")
    df = mapper.transform(df, "predicted_margin", DER)
    return df.select(*keep, *RAW, *CAL, C.argmax_class(*CAL).alias("predicted"), "predicted_margin", *DER)


def match_timeline(frames: Sequence[DataFrame], keys: Sequence[str] = ("match_id",), minute: str = "snapshot_minute") -> DataFrame:
    """Frames joined on (match, minute), one ordered array of points per match.

    A match has one point per cutoff, so the collected array is bounded.
    """
    df = frames[0]
    for f in frames[1:]:
        df = df.join(f, [*keys, minute])
    point = F.struct(minute, *[x for x in df.columns if x not in (*keys, minute)])
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("points"))


def timeline_documents(timeline: DataFrame) -> DataFrame:
    return timeline.select("match_id", F.to_json("points").alias("document"))


def match_detail(matches: DataFrame, prematch: DataFrame, snapshots: DataFrame, minute: str = "snapshot_minute") -> DataFrame:
    """Per match: is a pre-match forecast there, are snapshots there, which minutes."""
    pre = prematch.select("match_id").distinct().withColumn("_pre", F.lit(True))
    minutes = snapshots.groupBy("match_id").agg(F.sort_array(F.collect_set(minute)).alias("_minutes"))
    return matches.join(pre, "match_id", "left").join(minutes, "match_id", "left").select(
        "match_id", F.coalesce("_pre", F.lit(False)).alias("has_prematch"),
        F.col("_minutes").isNotNull().alias("has_snapshots"),
        F.coalesce("_minutes", F.array().cast("array<int>")).alias("minutes"))


def results_summary(metrics: DataFrame, baseline: str, metric: str = "rps") -> DataFrame:
    """One row: best model, its metric, the baseline's metric and their difference."""
    best = F.min_by(F.struct("model", metric), F.struct(metric, "model"))
    base = F.max(F.when(F.col("model") == baseline, F.col(metric)))
    out = metrics.agg(best.alias("_b"), base.alias(f"baseline_{metric}"), F.max("rows").alias("rows"))
    return out.select(F.col("_b.model").alias("best_model"), F.col(f"_b.{metric}").alias(f"best_{metric}"), f"baseline_{metric}", "rows",
                      (F.col(f"_b.{metric}") - F.col(f"baseline_{metric}")).alias("difference"))
