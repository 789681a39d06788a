"""Forests and boosting in the forms that the experiments use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .ensembles import BINS, TreeEnsemble, boosted_trees, random_forest


def _keyed(df: DataFrame, columns: Sequence[str], label: str, key: str | None) -> tuple[DataFrame, str]:
    """Rows without a key of their own draw by their values, so equal rows draw alike."""
    return (df, key) if key else (df.withColumn("_key", F.xxhash64(*columns, label)), "_key")


def _classes(df: DataFrame, label: str) -> int:
    top = df.agg(F.max(label)).first()[0]
    return 1 if top is None else int(top) + 1


def random_forest_classifier(df: DataFrame, columns: Sequence[str], label: str, trees: int = 200, max_depth: int = 5, min_leaf: int = 3, seed: int = 42, key: str | None = None, classes: int | None = None) -> TreeEnsemble:
    df, key = _keyed(df, columns, label, key)
    return random_forest(df, columns, label, key, classes or _classes(df, label), trees, max_depth, min_leaf, seed=seed)


def random_forest_regressor(df: DataFrame, columns: Sequence[str], target: str, trees: int = 200, max_depth: int = 5, min_leaf: int = 3, seed: int = 42, key: str | None = None) -> TreeEnsemble:
    df, key = _keyed(df, columns, target, key)
    return random_forest(df, columns, target, key, 0, trees, max_depth, min_leaf, seed=seed)


def gradient_boosting_regressor(
    df: DataFrame, columns: Sequence[str], target: str, rounds: int = 100, rate: float = 0.04, max_depth: int = 2, loss: str = "huber",
    row_share: float = 1.0, bins: int = BINS, seed: int = 42, key: str | None = None, history: list[float] | None = None,
) -> TreeEnsemble:
    df, key = _keyed(df, columns, target, key)
    return boosted_trees(df, columns, target, key, 0, rounds, rate, max_depth, loss, row_share=row_share, bins=bins, seed=seed, history=history)


def gradient_boosting_classifier(
    df: DataFrame, columns: Sequence[str], label: str, classes: int | None = None, rounds: int = 100, rate: float = 0.04, max_depth: int = 2,
    row_share: float = 1.0, bins: int = BINS, seed: int = 42, key: str | None = None, history: list[float] | None = None,
) -> TreeEnsemble:
    """Multinomial deviance; every round grows one tree per class."""
    df, key = _keyed(df, columns, label, key)
    return boosted_trees(df, columns, label, key, classes or _classes(df, label), rounds, rate, max_depth, row_share=row_share, bins=bins, seed=seed, history=history)


def histogram_boosting(
    df: DataFrame, columns: Sequence[str], label: str, classes: int = 0, rounds: int = 150, rate: float = 0.04, max_depth: int = 3, ridge: float = 1.0,
    row_share: float = 0.85, column_share: float = 0.8, bins: int = BINS, seed: int = 42, key: str | None = None, history: list[float] | None = None,
) -> TreeEnsemble:
    """Second-order boosting with sampled rows and columns; numbers without ``classes``."""
    df, key = _keyed(df, columns, label, key)
    return boosted_trees(
        df, columns, label, key, classes, rounds, rate, max_depth, newton=True, ridge=ridge, row_share=row_share, column_share=column_share, bins=bins, seed=seed, history=history,
    )
