"""Scalar column functions of the cleaning and feature steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from . import constants as K


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def no_nan(x: str | Column) -> Column:
    """NaN and NULL both mean missing; keep only NULL."""
    return F.nanvl(c(x), F.lit(None).cast("double"))


def clip(x: str | Column, low, high) -> Column:
    """Clip that keeps NULL (``least`` and ``greatest`` skip NULL)."""
    x = c(x)
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def extract_xy(coordinates: str | Column, index: int) -> Column:
    """Element ``index`` (from 0) of a coordinate array as double, else NULL."""
    return F.try_element_at(c(coordinates), F.lit(index + 1)).try_cast("double")


def clock_fraction(clock: str | Column) -> Column:
    """Fraction of a second in ``HH:mm:ss.SSS``; 0 when it cannot be parsed."""
    seconds = F.try_element_at(F.split(c(clock), ":"), F.lit(3)).try_cast("double")
    valid = c(clock).rlike(r"^\d+:\d{1,2}:\d{1,2}(\.\d+)?$")
    return F.coalesce(F.when(valid, seconds - F.floor(seconds)), F.lit(0.0))


def exact_clock(minute, second, clock) -> dict[str, Column]:
    whole = c(minute) * 60.0 + c(second)
    exact = whole + clock_fraction(clock)
    return {
        "event_seconds": whole,
        "event_seconds_exact": exact,
        "event_minute_decimal": exact / 60.0,
    }


def zone_id(x: str | Column, y: str | Column, strict: bool = True) -> Column:
    """Zone 0..19 on the 4 x 5 grid. Strict mode raises outside the pitch."""
    x, y = c(x), c(y)
    zone = (
        F.least(F.floor(x / (K.PITCH_X / K.GRID_X)), F.lit(K.GRID_X - 1))
        + F.least(F.floor(y / (K.PITCH_Y / K.GRID_Y)), F.lit(K.GRID_Y - 1)) * K.GRID_X
    ).cast("int")
    known = x.isNotNull() & y.isNotNull()
    inside = x.between(0, K.PITCH_X) & y.between(0, K.PITCH_Y)
    if strict:
        bad = F.raise_error(F.concat_ws(" ", F.lit("coordinate outside the pitch:"), x, y))
        return F.when(known & inside, zone).when(known, bad.cast("int"))
    return F.when(known & inside, zone)


def both(x: str | Column, y: str | Column) -> Column:
    """Struct (x, y) that exists only when both parts do."""
    x, y = c(x), c(y)
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is unknown."""
    return F.when(condition, 1).otherwise(0)


def safe_ratio(numerator, denominator) -> Column:
    n, d = c(numerator), c(denominator)
    return F.when(d > 0, F.try_divide(n.cast("double"), d.cast("double")))


def outcome(home_score, away_score) -> Column:
    m = c(home_score) - c(away_score)
    return F.when(m > 0, "H").when(m < 0, "A").when(m == 0, "D")


def clipped_margin(home_score, away_score) -> Column:
    return clip(c(home_score) - c(away_score), K.MARGIN_LOW, K.MARGIN_HIGH).cast("int")


def match_points(goals_for, goals_against) -> Column:
    f, a = c(goals_for), c(goals_against)
    return F.when(f > a, 3).when(f == a, 1).when(f < a, 0)


def devig(home, draw, away) -> dict[str, Column]:
    """Implied shares, overround and normalized market probabilities."""
    raw = {"H": c(home), "D": c(draw), "A": c(away)}
    implied = {k: F.try_divide(F.lit(1.0), F.when(v > 0, v)) for k, v in raw.items()}
    total = implied["H"] + implied["D"] + implied["A"]
    out = {f"implied_{k}": v for k, v in implied.items()}
    out["bookie_margin"] = total
    out.update({f"market_prob_{k}": F.try_divide(v, total) for k, v in implied.items()})
    return out


def calendar(date: str | Column, match_week: str | Column | None = None, weeks: int = 38) -> dict[str, Column]:
    angle = F.dayofyear(c(date)) * F.lit(2.0) * F.pi() / 365.25
    out = {"calendar_sin": F.sin(angle), "calendar_cos": F.cos(angle)}
    if match_week is not None:
        out["season_progress"] = c(match_week).try_cast("double") / weeks
    return out


def split_role(
    season: str | Column,
    date: str | Column,
    final_season: str = K.FINAL_SEASON,
    train_end: str = K.TRAIN_END,
    validation: tuple[str, str] = (K.VALIDATION_START, K.VALIDATION_END),
    calibration: tuple[str, str] = (K.CALIBRATION_START, K.CALIBRATION_END),
    pilot_start: str = K.PILOT_START,
    strict: bool = True,
) -> Column:
    """Chronological role of a match. A date outside every range is an error.

    Ranges compare full timestamps to midnight of the named dates, so they hold
    for plain dates, which is what match dates are.
    """
    d = F.to_date(c(date))
    day = lambda s: F.lit(s).cast("date")
    role = (
        F.when(c(season) == final_season, "final_test")
        .when(d <= day(train_end), "train")
        .when(d.between(day(validation[0]), day(validation[1])), "validation")
        .when(d.between(day(calibration[0]), day(calibration[1])), "calibration")
        .when(d >= day(pilot_start), "pilot_holdout")
    )
    if strict:
        role = role.otherwise(F.raise_error(F.concat_ws(" ", F.lit("match without role on"), d)).cast("string"))
    return role


def match_phase(minute: str | Column) -> Column:
    m = c(minute)
    return F.when(m <= 30, "early").when(m <= 60, "middle").when(m.isNotNull(), "late")


def phase_flags(minute: str | Column) -> dict[str, Column]:
    m = c(minute)
    one = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    return {
        "match_fraction": m / 90.0,
        "phase_first_half": one(m < 45),
        "phase_halftime": one(m == 45),
        "phase_late": one(m >= 75),
    }


def checked_probabilities(p: Sequence[str | Column]) -> list[Column]:
    """Finite, not below -1e-12, positive sum; divided by their sum."""
    cols = [c(x) for x in p]
    total = sum(cols[1:], cols[0])
    ok = total > 0
    for x in cols:
        ok = ok & x.isNotNull() & ~F.isnan(x) & (x >= -1e-12) & (x < float("inf"))
    message = F.lit("probabilities must be finite, nonnegative and have positive mass")
    return [F.when(ok, F.try_divide(x, total)).otherwise(F.raise_error(message).cast("double")) for x in cols]


def clipped_probabilities(p: Sequence[str | Column], floor: float = 1e-12) -> list[Column]:
    """Each clipped to [floor, 1], then divided by their sum."""
    cols = [clip(x, floor, 1.0) for x in p]
    total = sum(cols[1:], cols[0])
    return [x / total for x in cols]


def argmax_class(p_a, p_d, p_h) -> Column:
    """First maximum in the order A, D, H."""
    a, d, h = c(p_a), c(p_d), c(p_h)
    return F.when((a >= d) & (a >= h), "A").when(d >= h, "D").otherwise("H")


def concept(feature: str | Column, rules: Sequence[tuple[str, str]], default: str = "other") -> Column:
    """First (substring, concept) rule that the lower-cased name contains."""
    name = F.lower(c(feature))
    out = None
    for part, label in rules:
        hit = F.contains(name, F.lit(part.lower()))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.lit(default) if out is None else out.otherwise(default)


def softmax(scores: Sequence[Column]) -> list[Column]:
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    parts = [F.exp(s - top) for s in scores]
    total = sum(parts[1:], parts[0])
    return [p / total for p in parts]
