"""Queries on scores of issued forecasts beside their baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loadloom.operators import forecasts, scoring
from loadloom.plans.registry import DAY, HOUR, START, grid, hourly, query, rounded
from loadloom.plans.scoring import TREND, UP

AS_OF = START + 28 * DAY
#: Forecasts of every hour but those of each seventh; artifacts change by the week, one is not named.
_ISSUED = f"""iss AS (SELECT series_id, origin, CASE WHEN origin // 604800 % 3 = 0 THEN 'unknown' ELSE 'fit-' || (origin // 604800 % 3) END AS artifact, step, target, round(predicted + {UP!r}, 6) AS forecast FROM tr WHERE predicted IS NOT NULL AND origin // 3600 % 7 <> 0),
 rows AS (SELECT i.*, CASE WHEN target > {AS_OF} THEN 'outstanding' WHEN y.value IS NULL THEN 'gap' ELSE 'scored' END AS state, CASE WHEN target <= {AS_OF} THEN y.value END AS actual, p.value AS persistence, d.value AS prevday
  FROM iss i LEFT JOIN h y ON y.series_id = i.series_id AND y.t = i.target LEFT JOIN h p ON p.series_id = i.series_id AND p.t = i.origin LEFT JOIN h d ON d.series_id = i.series_id AND d.t = i.target - 86400)"""
_ERRORS = ", ".join(f"round(avg(abs({m} - actual)), 6) AS {m}_mae, round(100 * avg(CASE WHEN actual > 0 THEN abs({m} - actual) / actual END), 6) AS {m}_mape" for m in scoring.METHODS)
_SUMMARY = f"""count(*) AS steps_issued, count(*) FILTER (WHERE state = 'scored') AS steps_scored, count(*) FILTER (WHERE state = 'gap') AS gaps, count(*) FILTER (WHERE state = 'outstanding') AS outstanding,
 round(coalesce(count(*) FILTER (WHERE state = 'scored') / nullif(count(*) FILTER (WHERE state <> 'outstanding'), 0), 0), 6) AS step_coverage, count(*) FILTER (WHERE state = 'outstanding') = 0 AS matured,
 count(*) FILTER (WHERE actual <= 0) AS zero_observations, round(count(*) FILTER (WHERE forecast < actual) / nullif(count(*) FILTER (WHERE state = 'scored'), 0), 6) AS under_share, {_ERRORS}"""
_MEANS = ("step_coverage", "under_share", *(f"{m}_{k}" for m in scoring.METHODS for k in ("mae", "mape")))


def issuances(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = forecasts.trend_adaptive(grid(spark, sf_dir), DAY, 6, HOUR).where(F.col("predicted").isNotNull() & (F.floor(F.col("origin") / HOUR) % 7 != 0))
    step = F.struct("step", "target", F.round(F.col("predicted") + UP, 6).alias("value"))
    week = F.floor(F.col("origin") / (7 * DAY)) % 3
    return f.groupBy("series_id", F.col("origin").alias("issued")).agg(F.collect_list(step).alias("steps"), F.first(F.when(week != 0, F.concat(F.lit("fit-"), week.cast("string")))).alias("artifact"))


@query("l01_forecast_score", f"WITH {TREND}, {_ISSUED} SELECT series_id, step::INTEGER AS step, {_SUMMARY} FROM rows GROUP BY 1, 2")
def l01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By series and step."""
    return rounded(scoring.score_summary(scoring.scored_steps(issuances(spark, sf_dir), hourly(spark, sf_dir), AS_OF), "series_id", "step"), *_MEANS)


@query("l01_artifact_score", f"WITH {TREND}, {_ISSUED} SELECT series_id, artifact, {_SUMMARY} FROM rows GROUP BY 1, 2")
def l01a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By series and the artifact that made the forecast."""
    return rounded(scoring.score_summary(scoring.scored_steps(issuances(spark, sf_dir), hourly(spark, sf_dir), AS_OF), "series_id", "artifact"), *_MEANS)


@query(
    "l01_issuance_coverage",
    f"WITH {TREND}, {_ISSUED} SELECT series_id, count(DISTINCT origin) AS accepted, {20 * 24} AS expected, round(count(DISTINCT origin) / {20 * 24}, 6) AS coverage FROM iss WHERE origin >= {START + 5 * DAY} AND origin < {START + 25 * DAY} GROUP BY 1",
)
def l01c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.issuance_coverage(issuances(spark, sf_dir), START + 5 * DAY, START + 25 * DAY, HOUR), "coverage")
