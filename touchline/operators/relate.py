"""Joins with declared cardinality and diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import columns as C, constants as K
from .quality import QualityError, require, require_unique


def checked_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", cardinality: str = "many_to_one"
) -> DataFrame:
    """Join whose declared unique sides are verified first."""
    if cardinality not in ("one_to_one", "many_to_one", "one_to_many"):
        raise ValueError(f"unknown cardinality {cardinality}")
    if cardinality in ("one_to_one", "one_to_many"):
        require_unique(left, on)
    if cardinality in ("one_to_one", "many_to_one"):
        require_unique(right, on)
    return left.join(right, list(on), how)


def alias_table(spark: SparkSession) -> DataFrame:
    """The 24 fixed team aliases."""
    return spark.createDataFrame(list(K.TEAM_ALIASES), "source_team string, odds_team string")


def without_alias(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(team, n): every name whose mapped column is missing, with its rows; names are pre-aggregated."""
    misses = F.array(*[F.when(F.col(out).isNull(), F.struct(F.col(name).alias("team"))) for name, out in columns.items()])
    found = df.select(F.explode(misses).alias("m")).where("m IS NOT NULL")
    return found.groupBy(F.col("m.team").alias("team")).agg(F.count(F.lit(1)).alias("n"))


def alias_lookup(df: DataFrame, aliases: DataFrame, columns: dict[str, str], source="source_team", target="odds_team",
                 strict: bool = True) -> DataFrame:
    """Map team names; in strict mode any miss is an error. ``without_alias`` lists all names that miss."""
    for name, out in columns.items():
        side = aliases.select(F.col(source).alias(name), F.col(target).alias(out))
        df = df.join(side, name, "left")
    if strict:
        lost = without_alias(df, columns).agg(F.count(F.lit(1)).alias("teams"), F.min("team").alias("first")).first()
        if lost["teams"]:
            raise QualityError(f"{lost['teams']} teams without alias, the first is {lost['first']}")
    return df


def join_odds(
    matches: DataFrame, odds: DataFrame, keys: Sequence[str], odds_columns: Sequence[str], strict: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Left join of odds with a match indicator; returns (joined, diagnostics).

    Strict mode raises on duplicate odds keys and on unmatched fixtures.
    """
    if strict:
        require_unique(odds, keys)
    right = odds.select(*keys, *odds_columns).withColumn("_hit", F.lit(True))
    joined = matches.join(right, list(keys), "left").withColumn(
        "join_state", F.when(F.col("_hit"), "both").otherwise("left_only")
    ).drop("_hit")
    if strict:
        require(joined, {"fixture without odds": F.col("join_state") != "both"})
    return joined, joined.select("match_id", *keys, "join_state")


def odds_coverage(diagnostics: DataFrame) -> DataFrame:
    """One row: fixtures, matched, unmatched, coverage rate."""
    hit = F.count_if(F.col("join_state") == "both")
    return diagnostics.agg(
        F.count(F.lit(1)).alias("fixtures"), hit.alias("matched"),
        F.count_if(F.col("join_state") != "both").alias("unmatched"),
    ).withColumn("coverage", F.try_divide(F.col("matched").cast("double"), F.col("fixtures")))


def add_market(df: DataFrame, home="b365h", draw="b365d", away="b365a") -> DataFrame:
    return df.select("*", *[v.alias(k) for k, v in C.devig(home, draw, away).items()])


def targets(matches: DataFrame) -> DataFrame:
    return matches.select(
        "match_id", "season_name", "clean_date", "home_score", "away_score",
        C.clipped_margin("home_score", "away_score").alias("goal_margin"),
        C.outcome("home_score", "away_score").alias("outcome"),
    )


def attach_targets(features: DataFrame, labels: DataFrame, role: str = "split_role") -> DataFrame:
    """Development features with outcome and margin; final rows never enter."""
    dev = features.where(F.col(role) != "final_test") if role in features.columns else features
    return dev.join(labels.select("match_id", "outcome", "goal_margin"), "match_id")


def season_filter(df: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(wanted.select(*keys).distinct(), list(keys), "left_semi")


def exactly_one(df: DataFrame, condition) -> DataFrame:
    """The single row that matches; none or several is an error."""
    hits = df.where(condition)
    n = hits.limit(2).count()
    if n != 1:
        raise QualityError(f"expected one row, found {'none' if n == 0 else 'several'}")
    return hits


def identity_check(left: DataFrame, right: DataFrame, key: str, compare: Sequence[str]) -> DataFrame:
    """One row: full-join indicator counts and mismatches per compared column."""
    a = left.select(key, *[F.col(x).alias(f"_l_{x}") for x in compare]).withColumn("_l", F.lit(True))
    b = right.select(key, *[F.col(x).alias(f"_r_{x}") for x in compare]).withColumn("_r", F.lit(True))
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return a.join(b, key, "full").agg(
        F.count_if(both).alias("in_both"),
        F.count_if(F.col("_r").isNull()).alias("only_left"),
        F.count_if(F.col("_l").isNull()).alias("only_right"),
        *[F.count_if(both & ~F.col(f"_l_{x}").eqNullSafe(F.col(f"_r_{x}"))).alias(f"mismatch_{x}") for x in compare],
    )


def top_rows(df: DataFrame, order: Sequence[F.Column], k: int) -> DataFrame:
    """k extreme rows (TakeOrderedAndProject: k rows per task reach the driver)."""
    return df.orderBy(*order).limit(k)


def topk_lookup(full: DataFrame, worst: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of the selected keys."""
    return full.join(worst.select(*keys).distinct(), list(keys), "left_semi")


def match_catalogue(
    matches: DataFrame, competition: str | None = None, season: str | None = None, team: str | None = None,
    date_from: str | None = None, date_to: str | None = None, split: str | None = None,
    synonyms: dict[str, str] | None = None,
) -> DataFrame:
    """Filtered catalogue; all text tests are literal and case-insensitive."""
    if date_from and date_to and date_from > date_to:
        raise ValueError("date_from is after date_to")
    df = matches
    low = lambda x: F.lower(F.col(x).cast("string"))
    if competition:
        wanted = (synonyms or {}).get(competition.lower(), competition)
        df = df.where(low("competition") == wanted.lower())
    if season:
        df = df.where(low("season_name") == season.lower())
    if team:
        part = F.lit(team.lower())
        df = df.where(F.contains(low("home_team"), part) | F.contains(low("away_team"), part))
    if date_from:
        df = df.where(F.to_date("clean_date") >= F.lit(date_from).cast("date"))
    if date_to:
        df = df.where(F.to_date("clean_date") <= F.lit(date_to).cast("date"))
    if split:
        df = df.where(F.col("split_role") == split)
    return df


def page(df: DataFrame, limit: int, offset: int = 0, order: Sequence[str] = ("clean_date", "match_id")) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)
