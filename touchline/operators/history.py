"""Leakage-safe lagged histories per team and their home/away pivot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import columns as C, constants as K
from .ordered import sequence

WINDOWS = (3, 5, 10)


def entity_history(
    rows: DataFrame,
    metrics: Sequence[str],
    prefix: str,
    entity: str = "team",
    order: Sequence[str] = ("clean_date", "match_id"),
    windows: Sequence[int] = WINDOWS,
    expanding: bool = True,
    strict: bool = True,
    max_rows: int | None = None,
    bound: int | None = None,
) -> tuple[DataFrame, list[str]]:
    """Previous match time, matches played, rest days, rolling and expanding means.

    All frames share one window specification, so one sort serves them all.
    Histories run across seasons. In strict mode a previous match that is not
    strictly earlier raises.
    ``bound`` is a proven bound on rows per entity, which saves counting them.
    """
    date = order[0]
    name = lambda m, w: f"{prefix}{m}_roll{w}" if w else f"{prefix}{m}_expanding"
    source, played, rest = f"{prefix}source_match_time", f"{prefix}matches_played_prior", f"{prefix}rest_days"
    seq = sequence(rows, [entity], list(order), bound=bound, max_rows=max_rows)
    seq = seq.trailing_means(metrics, windows, expanding, name)
    seq = seq.row_number("_row").neighbor({source: F.col(date)}, -1)
    df = seq.result()
    if strict:
        message = F.lit(f"{prefix}history is not strictly earlier")
        df = df.withColumn(source, F.when(F.col(source) >= F.col(date), F.raise_error(message).cast(rows.schema[date].dataType))
                           .otherwise(F.col(source)))
    gap = F.floor((F.unix_micros(F.col(date).cast("timestamp")) - F.unix_micros(F.col(source).cast("timestamp"))) / 86_400_000_000)
    df = df.withColumns({
        played: (F.col("_row") - 1).cast("double"),
        rest: C.clip(gap.cast("double"), 0.0, 60.0),
    }).drop("_row")
    frames = [*windows, *([None] if expanding else [])]
    features = [source, played, rest, *[name(m, w) for m in metrics for w in frames]]
    return df, features


def recent_form(rows: DataFrame, window: int = 5, entity: str = "team", order=("clean_date", "match_id"), max_rows: int | None = None) -> DataFrame:
    """Mean goals of the last matches (0.0 without history) and history size."""
    name = lambda m, w: f"recent_{m}"
    seq = sequence(rows, [entity], list(order), max_rows=max_rows)
    df = seq.trailing_means(["goals_for", "goals_against"], [window], False, name).row_number("_row").result()
    return df.withColumns({
        "recent_goals_for": F.coalesce("recent_goals_for", F.lit(0.0)),
        "recent_goals_against": F.coalesce("recent_goals_against", F.lit(0.0)),
        "history_matches": F.least(F.col("_row") - 1, F.lit(window)),
    }).drop("_row")


def pivot_home_away(rows: DataFrame, features: Sequence[str], key: str = "match_id") -> DataFrame:
    """Home and away values side by side plus differences.

    One grouping by match with conditional maxima: one shuffle, no self-join.
    Each side has exactly one row, so ``max`` only picks it.
    """
    pick = lambda side, x: F.max(F.when(F.col("is_home") == side, F.col(x)))
    out = rows.groupBy(key).agg(
        *[pick(1, x).alias(f"home_{x}") for x in features],
        *[pick(0, x).alias(f"away_{x}") for x in features],
        F.count_if(F.col("is_home") == 1).alias("_home"),
        F.count_if(F.col("is_home") == 0).alias("_away"),
    ).where((F.col("_home") > 0) & (F.col("_away") > 0))
    twice = (F.col("_home") > 1) | (F.col("_away") > 1)
    out = out.withColumn(key, F.when(twice, F.raise_error(F.lit("more than one row per side"))
                                     .cast(rows.schema[key].dataType)).otherwise(F.col(key)))
    diffs = [x for x in features if not x.endswith("source_match_time")]
    return out.drop("_home", "_away").select(
        "*", *[(F.col(f"home_{x}") - F.col(f"away_{x}")).alias(f"diff_{x}") for x in diffs]
    )


def feature_groups(columns: Sequence[str], event_tag: str = "event_", network_tag: str = "net_") -> dict[str, list[str]]:
    """Named, ordered column lists; a repeated column is an error."""
    usable = [x for x in columns if not x.endswith("source_match_time")]
    market = ["market_prob_A", "market_prob_D", "market_prob_H"]
    context = ["season_progress", "calendar_sin", "calendar_cos", "bookie_margin"]
    conventional = [x for x in usable if event_tag in x] + [x for x in context if x in columns]
    network = [x for x in usable if network_tag in x]
    market = [x for x in market if x in columns]
    groups = {
        "market": market,
        "conventional": conventional,
        "network": network,
        "conventional_market": conventional + market,
        "conventional_network": conventional + network,
        "combined": conventional + network + market,
    }
    for name, members in groups.items():
        if len(set(members)) != len(members):
            raise ValueError(f"duplicate columns in feature group {name}")
    return groups


def keyword_families(columns: Sequence[str], keywords: dict[str, Sequence[str]]) -> dict[str, list[str]]:
    """Columns per family, by any keyword in the lower-cased name."""
    return {f: [x for x in columns if any(w in x.lower() for w in words)] for f, words in keywords.items()}


def chronology_check(rows: DataFrame, entity: str = "team", order=("clean_date", "match_id"), max_rows: int | None = None) -> DataFrame:
    """One row: rows, first rows of an entity, rows not after their predecessor."""
    seq = sequence(rows, [entity], list(order), max_rows=max_rows).neighbor({"_previous": F.col(order[0])}, -1)
    return seq.result().agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("_previous").isNull()).alias("first_rows"),
        F.count_if(F.col("_previous") > F.col(order[0])).alias("backward"),
        F.count_if(F.col("_previous") == F.col(order[0])).alias("same_time"),
    )


def chronological_split(rows: DataFrame, fraction: float, date: str = "clean_date") -> DataFrame:
    """'earlier' / 'later' by the date of row floor(n * fraction).

    The whole cut date goes to the later side. Rows are counted per calendar day
    first, so the cut is found on at most one row per day.
    """
    from pyspark.sql import Window as W

    day = F.to_date(date)
    per_day = rows.groupBy(day.alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    upto = per_day.withColumn("_upto", F.sum("_n").over(W.orderBy("_day"))).withColumn("_all", F.sum("_n").over(W.partitionBy()))
    cut = upto.where(F.col("_upto") > F.floor(F.col("_all") * F.lit(fraction))).agg(F.min("_day").alias("_cut"))
    return rows.withColumn("side", F.when(day < cut.scalar(), "earlier").otherwise("later"))


def first_match_check(history: DataFrame, prefix: str, feature: str) -> DataFrame:
    """One row: first matches with history, later matches without any."""
    played = F.col(f"{prefix}matches_played_prior")
    return history.agg(
        F.count_if(played == 0).alias("first_matches"),
        F.count_if((played == 0) & F.col(feature).isNotNull()).alias("first_with_history"),
        F.count_if((played > 0) & F.col(feature).isNull()).alias("later_without_history"),
    )
