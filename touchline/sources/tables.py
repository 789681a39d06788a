"""Parquet, CSV and JSON tables, incremental append, logs and manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.quality import require, require_unique

# Stable columns of the match table.
MATCH_COLUMNS = (
    "match_id", "match_date", "kick_off", "home_score", "away_score", "match_status",
    "match_status_360", "last_updated", "last_updated_360", "match_week",
    "competition_id", "competition_country_name", "competition_name", "competition",
    "season_id", "season", "season_name", "home_team_id", "home_team",
    "home_team_gender", "home_team_country_id", "home_team_country_name",
    "away_team_id", "away_team", "away_team_gender", "away_team_country_id",
    "away_team_country_name", "competition_stage_id", "competition_stage", "stadium_id",
    "stadium", "stadium_country_id", "stadium_country_name", "referee_id", "referee",
    "referee_country_id", "referee_country_name", "data_version", "shot_fidelity_version",
    "xy_fidelity_version",
)

ODDS_REQUIRED = ("Date", "HomeTeam", "AwayTeam", "B365H", "B365D", "B365A")


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).option("compression", "snappy")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_matches(source: DataFrame, season_name: str | None = None) -> DataFrame:
    """Stable subset of match columns, with a unique, non-NULL ``match_id``."""
    df = source if season_name is None else source.withColumn("season_name", F.lit(season_name))
    df = df.select(*[x for x in MATCH_COLUMNS if x in df.columns])
    if "match_date" in df.columns:
        df = df.withColumn("match_date", F.to_date("match_date"))
    return require_unique(df, ["match_id"])


def day_first_date(text: str) -> F.Column:
    """Day-first date with a two- or four-digit year; 69..99 mean 19xx."""
    value = F.col(text)
    short = F.to_date(F.try_to_timestamp(value, F.lit("dd/MM/yy")))
    short = F.when(F.year(short) >= 2069, F.add_months(short, -1200)).otherwise(short)
    return F.coalesce(short, F.to_date(F.try_to_timestamp(value, F.lit("dd/MM/yyyy"))))


def parse_odds(raw: DataFrame, season_name: str) -> DataFrame:
    """Required columns, day-first date, season tag. A bad date is an error."""
    missing = [x for x in ODDS_REQUIRED if x not in raw.columns]
    if missing:
        raise ValueError(f"odds source lacks {missing}")
    df = raw.select(
        *ODDS_REQUIRED[:3], *[F.col(x).cast("double").alias(x) for x in ODDS_REQUIRED[3:]],
        day_first_date("Date").alias("clean_date"), F.lit(season_name).alias("season_name"),
    )
    return require(df, {"odds date": F.col("clean_date").isNull()})


def read_odds_csv(spark: SparkSession, path: str, season_name: str) -> DataFrame:
    return parse_odds(spark.read.option("header", True).csv(path), season_name)


def align_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Declared columns in declared order; missing ones become typed NULLs."""
    have = set(df.columns)
    return df.select(*[
        F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in have
        else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def standardize_types(
    df: DataFrame, keys: dict[str, str], nullable: dict[str, str]
) -> DataFrame:
    """Strict cast for keys (a bad value raises), coercing cast for the rest."""
    out = {}
    for name, kind in keys.items():
        out[name] = F.col(name).cast(kind)
    for name, kind in nullable.items():
        value = F.col(name).try_cast(kind)
        out[name] = F.nanvl(value, F.lit(None).cast("double")) if kind == "double" else value
    return df.withColumns(out)


def union_seasons(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def missing_ids(required: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    return required.select(*keys).distinct().join(stored.select(*keys).distinct(), list(keys), "left_anti")


def append_missing(source: DataFrame, stored: DataFrame | None, path: str, keys: Sequence[str]) -> DataFrame:
    """Append only the rows whose key is not stored yet; returns those rows' keys."""
    if stored is None:
        source.write.mode("append").parquet(path)
        return source.select(*keys).distinct()
    todo = missing_ids(source, stored, keys)
    source.join(todo, list(keys), "left_semi").write.mode("append").parquet(path)
    return todo


def ingestion_log(required: DataFrame, events: DataFrame, key: str = "match_id") -> DataFrame:
    """Per required key: status and number of stored rows."""
    counts = events.groupBy(key).agg(F.count(F.lit(1)).alias("events"))
    full = required.select(key).withColumn("_required", F.lit(True)).join(counts, key, "full")
    return full.select(
        key,
        F.when(F.col("_required").isNull(), "unexpected").when(F.col("events").isNull(), "failed")
        .otherwise("success").alias("status"),
        F.coalesce("events", F.lit(0)).alias("events"),
    )


def coverage(log: DataFrame) -> DataFrame:
    """One row: required keys, covered keys, coverage in percent."""
    need = F.count_if(F.col("status") != "unexpected")
    good = F.count_if(F.col("status") == "success")
    return log.agg(need.alias("required"), good.alias("covered")).withColumn(
        "coverage_pct", F.try_divide(F.col("covered") * 100.0, F.col("required"))
    )


DIGEST_PRIME = (1 << 61) - 1
BETWEEN = "\x1f"


def _told(value: Column, kind: str) -> Column:
    """A value as text that other engines can write too: numbers with fractions in millionths, times in microseconds."""
    if kind in ("double", "float") or kind.startswith("decimal"):
        number = value.cast("double")
        return F.when(F.isnan(number) | (F.abs(number) == float("inf")), number.cast("string")).otherwise(F.round(number * 1000000).cast("long").cast("string"))
    if kind.startswith("timestamp"):
        return F.unix_micros(value.cast("timestamp")).cast("string")
    if kind.startswith("array<"):
        inner = kind[6:-1]
        return F.array_join(F.transform(value, lambda x: F.coalesce(_told(x, inner), F.lit("n"))), ",")
    if kind.startswith(("map<", "struct<")):
        return F.to_json(value)
    return value.cast("string")


def row_text(df: DataFrame) -> Column:
    """All columns of a row as one text; a NULL differs from every value."""
    return F.concat_ws(BETWEEN, *[F.coalesce(F.concat(F.lit("v"), _told(F.col(f"`{n}`"), kind)), F.lit("n")) for n, kind in df.dtypes])


def table_manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, columns and a digest of the content per table.

    The digest adds up a hash of every row's text, so the order of rows does not
    matter while repeated rows, which would cancel under exclusive or, count.
    """
    out = None
    for name, df in tables.items():
        hashed = F.conv(F.substring(F.md5(row_text(df).cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
        row = df.agg(
            F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns"),
            F.coalesce(F.sum(hashed) % F.lit(DIGEST_PRIME).cast("decimal(38,0)"), F.lit(0)).cast("long").alias("digest"),
        )
        out = row if out is None else out.unionByName(row)
    return out
