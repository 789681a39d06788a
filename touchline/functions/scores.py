"""Row-level losses of a probability triple in the order A, D, H."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from . import constants as K
from .columns import argmax_class, c

EPSILON = 2.220446049250313e-16


def is_class(actual: str | Column, label: str) -> Column:
    return F.when(c(actual) == label, 1.0).otherwise(0.0)


def checked_label(actual: str | Column) -> Column:
    bad = F.raise_error(F.concat_ws(" ", F.lit("unknown outcome label:"), c(actual))).cast("string")
    return F.when(c(actual).isin(*K.CLASSES), c(actual)).otherwise(bad)


def rps(actual, p: Sequence[Column]) -> Column:
    a, d = is_class(actual, "A"), is_class(actual, "D")
    first = p[0] - a
    second = p[0] + p[1] - a - d
    return (first * first + second * second) / 2.0


def brier(actual, p: Sequence[Column]) -> Column:
    parts = [q - is_class(actual, k) for q, k in zip(p, K.CLASSES)]
    return parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2]


def log_loss(actual, p: Sequence[Column]) -> Column:
    hit = F.when(c(actual) == "A", p[0]).when(c(actual) == "D", p[1]).otherwise(p[2])
    return -F.log(F.least(F.greatest(hit, F.lit(EPSILON)), F.lit(1.0)))


def confidence(p: Sequence[Column]) -> Column:
    return F.greatest(*p)


def correct(actual, p: Sequence[Column]) -> Column:
    return F.when(argmax_class(*p) == c(actual), 1.0).otherwise(0.0)


def equal_width_bin(value: Column, bins: int = 10) -> Column:
    """Bin of a value in [0, 1] against the edge list i * (1 / bins).

    Written as comparisons, not as floor(value * bins), which differs at edges
    such as 0.3. The last bin is closed on the right.
    """
    step = 1.0 / bins
    out = F.when(value >= (bins - 1) * step, bins - 1)
    for i in range(bins - 2, -1, -1):
        out = out.when(value >= i * step, i)
    return out
