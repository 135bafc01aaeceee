"""Queries on forecasts scaled by recent outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loadloom.operators import corrections as ops
from loadloom.plans.registry import DAY, HOUR, grid, query, rounded
from loadloom.plans.scoring import NAIVE, PROFILE, naive

_W = ops.weights(6, 3.0)


def _ratio_sql(reference: str, low: float, high: float) -> str:
    top = " + ".join(f"coalesce(lag(x, {j}) OVER w * {w!r}::DOUBLE, 0)" for j, w in enumerate(_W))
    bottom = " + ".join(f"CASE WHEN lag(x, {j}) OVER w IS NOT NULL THEN {w!r}::DOUBLE ELSE 0 END" for j, w in enumerate(_W))
    return f""", fl AS (SELECT series_id, t, last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS f FROM g), rf AS ({reference}),
 rx AS (SELECT fl.series_id, fl.t, CASE WHEN rf.p > 0 THEN f / rf.p END AS x FROM fl LEFT JOIN rf ON rf.series_id = fl.series_id AND rf.t = fl.t), ry AS (SELECT series_id, t, {top} AS a, {bottom} AS b FROM rx WINDOW w AS (PARTITION BY series_id ORDER BY t)),
 rt AS (SELECT series_id, t, CASE WHEN b > 0 THEN least(greatest(a / b, {low}::DOUBLE), {high}::DOUBLE) ELSE 1 END AS ratio FROM ry)"""


@query(
    "f10_faded_profile_ratio",
    f"""WITH {PROFILE}{_ratio_sql("SELECT series_id, t + d * 86400 AS t, avg(value) AS p FROM g, (SELECT unnest(range(1, 8)) AS d) WHERE value IS NOT NULL GROUP BY 1, 2", 0.6, 1.6)}
 SELECT pf.series_id, origin, step::INTEGER AS step, target, round(ratio, 5) AS ratio, round(p * ratio, 5) AS predicted FROM pf JOIN rt ON rt.series_id = pf.series_id AND rt.t = pf.origin""",
)
def f10_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.profile_ratio(grid(spark, sf_dir), DAY, 6, HOUR), "ratio", "predicted", places=5)


@query(
    "f10_bias_corrected",
    f"""WITH {NAIVE}{_ratio_sql("SELECT series_id, target AS t, predicted AS p FROM n WHERE step = 1", 0.85, 1.2)}
 SELECT n.series_id, origin, step::INTEGER AS step, target, round(ratio, 5) AS ratio, round(greatest(0, predicted * ratio), 5) AS predicted FROM n JOIN rt ON rt.series_id = n.series_id AND rt.t = n.origin""".replace("greatest(0, predicted * ratio)", "CASE WHEN predicted IS NOT NULL THEN greatest(0, predicted * ratio) END"),
)
def f10_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seasonal naive forecast, corrected by its own first steps."""
    return rounded(ops.bias_corrected(naive(spark, sf_dir), grid(spark, sf_dir)), "ratio", "predicted", places=5)
