"""Queries by name, each with the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from loadloom.functions.scalars import epoch_seconds
from loadloom.operators.grid import count_on_grid, regularize
from loadloom.session import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
HOUR, DAY = 3600, 86400
#: 2024-01-01, the first day of the event log.
START = 1704067200


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request log as points: series_id, t, ord, value, user_id."""
    return read_table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), epoch_seconds(F.col("ts")).alias("t"), F.col("event_id").alias("ord"), "value", "user_id")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests an hour; hours without any are absent."""
    return count_on_grid(events(spark, sf_dir), HOUR)


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regularize(hourly(spark, sf_dir), HOUR)


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) + 0.0 for c in columns})


#: The same tables in SQL: e events, h hourly counts, g the hourly grid with NULLs.
E = "e AS (SELECT event_type AS series_id, epoch_us(ts) // 1000000 AS t, event_id AS ord, value, user_id FROM events)"
H = E + ", h AS (SELECT series_id, t // 3600 * 3600 AS t, count(*)::DOUBLE AS value FROM e GROUP BY 1, 2)"
G = H + """, hb AS (SELECT series_id, min(t) AS a, max(t) AS z FROM h GROUP BY 1),
 hs AS (SELECT series_id, unnest(range(a, z + 1, 3600)) AS t FROM hb),
 g AS (SELECT hs.series_id, hs.t, h.value FROM hs LEFT JOIN h ON h.series_id = hs.series_id AND h.t = hs.t)"""
