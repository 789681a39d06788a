"""Registered queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# SQL twins of the adapter views.
VIEWS = {
    "m": """
SELECT o_orderkey AS match_id,
  o_orderdate + to_microseconds(o_orderkey) AS clean_date,
  CAST(year(o_orderdate) AS VARCHAR) AS season_name,
  o_custkey % 40 AS home_team,
  (o_custkey % 40 + 1 + (o_orderkey * 7 + o_custkey) % 39) % 40 AS away_team,
  (o_orderkey * 31 + o_custkey) % 9 AS home_score,
  (o_orderkey * 17 + 3) % 8 AS away_score,
  CAST(1.2 AS DOUBLE) + CAST((o_orderkey * 11) % 50 AS DOUBLE) / 10 AS b365h,
  CAST(2.5 AS DOUBLE) + CAST((o_orderkey * 13) % 30 AS DOUBLE) / 10 AS b365d,
  CAST(1.4 AS DOUBLE) + CAST((o_orderkey * 19) % 60 AS DOUBLE) / 10 AS b365a
FROM orders""",
    "e0": """
SELECT event_id AS e, user_id AS match_id, event_type, value,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx
FROM events""",
    "e1": """
SELECT *, greatest((idx - 1) // 4 + 1 - CASE WHEN e % 11 = 0 AND idx > 5 THEN 1 ELSE 0 END, 1) AS possession,
  CASE event_type WHEN 'view' THEN 'Pass' WHEN 'click' THEN 'Carry' WHEN 'purchase' THEN 'Shot'
    WHEN 'error' THEN 'Pressure' WHEN 'signup' THEN 'Ball Recovery' END AS type
FROM e0""",
    "e": """
SELECT match_id, e AS id, idx, CASE WHEN idx <= 33 THEN 1 ELSE 2 END AS period,
  (idx - 1) * CAST(80 AS DOUBLE) + (e % 3) * CAST(0.001 AS DOUBLE) AS t, type,
  CASE WHEN e % 2 = 0 THEN 'Home' ELSE 'Away' END AS team, possession,
  CASE WHEN (possession + match_id) % 3 = 0 THEN 'Home' ELSE 'Away' END AS possession_team,
  CASE WHEN e % 13 <> 0 THEN CAST((e * 37) % 1201 AS DOUBLE) / 10 END AS location_x,
  CASE WHEN e % 13 <> 0 THEN CAST((e * 53) % 801 AS DOUBLE) / 10 END AS location_y,
  CASE WHEN type = 'Pass' THEN CAST((e * 71) % 1201 AS DOUBLE) / 10 END AS pass_end_x,
  CASE WHEN type = 'Pass' THEN CAST((e * 29) % 801 AS DOUBLE) / 10 END AS pass_end_y,
  CASE WHEN type = 'Pass' AND e % 4 = 0 THEN 'Incomplete' END AS pass_outcome,
  CASE WHEN type = 'Shot' THEN CASE e % 5 WHEN 0 THEN 'Goal' WHEN 1 THEN 'Saved' ELSE 'Off T' END END AS shot_outcome,
  CASE WHEN type = 'Shot' THEN value / CAST(1000 AS DOUBLE) END AS shot_xg
FROM e1""",
}
NEEDS = {"m": ["m"], "e": ["e0", "e1", "e"]}


def with_views(sql: str, views: str = "", extra: dict[str, str] | None = None) -> str:
    """Prefix a query with the CTEs it names ('m', 'e' or both)."""
    parts = [f"{v} AS ({VIEWS[v]})" for key in views for v in NEEDS[key]]
    parts += [f"{k} AS ({v})" for k, v in (extra or {}).items()]
    return f"WITH {', '.join(parts)} {sql}" if parts else sql


def query(name: str, sql: str | None = None, views: str = "", extra: dict[str, str] | None = None):
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql, views, extra)
        return fn

    return register


DIGITS = 9


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round double columns, so float noise does not decide a comparison."""
    return df.select(*[
        F.round(F.col(f"`{n}`"), digits).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes
    ])


def longs(df: DataFrame) -> DataFrame:
    """Integers as 64-bit, so both engines report the same type."""
    return df.select(*[
        F.col(f"`{n}`").cast("long").alias(n) if t in ("int", "smallint", "tinyint") else F.col(f"`{n}`") for n, t in df.dtypes
    ])


def final(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return longs(rounded(df, digits))
