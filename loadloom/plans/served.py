"""Queries on fits in generations and on the components behind recorded issuances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loadloom.operators import forecasts, generations, served
from loadloom.plans.registry import DAY, HOUR, grid, query, rounded
from loadloom.plans.scoring import PROFILE, _profile_ar_sql, naive

SIX = 6 * HOUR


def _generation_sql(left: str, fit: str, good: str, back: str, lasting: bool) -> str:
    """``_profile_ar_sql`` with fits at boundaries alone, served by own or last boundary."""
    base = _profile_ar_sql(left, fit, good, back)
    head, tail = base.split("u AS (SELECT", 1)
    forecast = tail[tail.index("f1 AS (") :]
    head = head.replace("e0 AS (SELECT *, ", "sb AS (SELECT * FROM s0 WHERE t % 21600 = 0), e0 AS (SELECT *, ").replace("AS m0_32 FROM s0)", "AS m0_32 FROM sb)")
    enough = good if "span" in good else f"{good} AND span >= 0"
    stable = "abs(j3) < 1 AND 1 + j1 + j2 + j3 > 0 AND 1 - j1 + j2 - j3 > 0 AND abs(j2 - j1 * j3) < 1 - j3 * j3" if lasting else "true"
    fits = f"""sv AS (SELECT series_id, t AS b, c0, c1, c2, c3, n, CASE WHEN NOT coalesce({enough}, false) THEN 'few_rows' WHEN c0 IS NULL OR c1 IS NULL OR c2 IS NULL OR c3 IS NULL THEN 'singular' WHEN NOT ({stable}) THEN 'unstable' ELSE 'ok' END AS status FROM j)"""
    u = """, ua AS (SELECT a0.series_id, a0.t, a0.q AS h1, lag(a0.q, 1) OVER v AS h2, lag(a0.q, 2) OVER v AS h3, a0.t // 21600 * 21600 AS b FROM a0 WINDOW v AS (PARTITION BY a0.series_id ORDER BY a0.t)),
 ub AS (SELECT ua.*, CASE WHEN x.status = 'ok' THEN x.b WHEN y.status = 'ok' THEN y.b END AS generation, CASE WHEN x.status = 'ok' THEN false WHEN y.status = 'ok' THEN true END AS stale, coalesce(x.status, y.status, 'no_fit') AS why
  FROM ua LEFT JOIN sv x ON x.series_id = ua.series_id AND x.b = ua.b LEFT JOIN sv y ON y.series_id = ua.series_id AND y.b = ua.b - 21600),
 u AS (SELECT ub.*, g2.c0 AS d0, g2.c1, g2.c2, g2.c3 FROM ub LEFT JOIN sv g2 ON g2.series_id = ub.series_id AND g2.b = ub.generation), """
    forecast = forecast.replace("unnest([y1, y2, y3, y4, y5, y6]) AS f FROM f6", "unnest([y1, y2, y3, y4, y5, y6]) AS f, generation, stale, why FROM f6")
    out = """, generation, stale, CASE WHEN f IS NOT NULL AND p IS NOT NULL THEN 'ok' ELSE 'unavailable' END AS status, CASE WHEN generation IS NULL THEN why WHEN f IS NULL THEN 'no_lags' WHEN p IS NULL THEN 'no_profile' END AS reason FROM o LEFT JOIN pr"""
    return head + fits + u + forecast.replace(" FROM o LEFT JOIN pr", out)


FITS = {
    "f05": ("value - p", "q", "n >= 36 AND span >= 21600", "p + f"),
    "f06": ("CASE WHEN p > 0 THEN value / p - 1 END", "CASE WHEN q IS NOT NULL THEN least(greatest(q, -0.5), 0.5) END", "n >= 36", "p * (1 + f)"),
}


@query("f05_generations", _generation_sql(*FITS["f05"], True))
def f05g(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(generations.generation_forecast(grid(spark, sf_dir), DAY, 6, HOUR, SIX, 7 * DAY, 36, SIX), "predicted", places=4)


@query("f06_generations", _generation_sql(*FITS["f06"], False))
def f06g(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(generations.generation_forecast(grid(spark, sf_dir), DAY, 6, HOUR, SIX, 7 * DAY, 36, 0, relative=True), "predicted", places=4)


def recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issuances of every three hours as a controller logged them; some without values, off the grid, or with a target moved."""
    n = naive(spark, sf_dir).where(F.col("origin") % (3 * HOUR) == 0)
    number = F.floor(F.col("origin") / (3 * HOUR))
    rpm = F.when((number + F.col("step")) % 23 == 0, F.lit(float("nan"))).otherwise(F.col("predicted") * 60)
    moved = F.col("target") + F.when((number % 17 == 0) & (F.col("step") == 4), 60).otherwise(0)
    steps = F.array_sort(F.collect_list(F.struct("step", moved.alias("target"), rpm.alias("rpm"))))
    out = n.groupBy("series_id", "origin").agg(steps.alias("forecasts"))
    return out.withColumn("sequence_length", F.when(F.floor(F.col("origin") / (3 * HOUR)) % 29 == 0, 0).otherwise(4))


@query(
    "f17_served_components",
    f"""WITH {PROFILE}, nv AS (SELECT a.*, CASE WHEN count(g.value) OVER (PARTITION BY a.series_id, a.origin) = 6 THEN g.value END AS predicted FROM a LEFT JOIN g ON g.series_id = a.series_id AND g.t = a.target - 86400),
 i AS (SELECT series_id, origin, step, target + CASE WHEN origin // 10800 % 17 = 0 AND step = 4 THEN 60 ELSE 0 END AS target, CASE WHEN (origin // 10800 + step) % 23 = 0 THEN 'NaN'::DOUBLE ELSE predicted * 60 END AS rpm, origin // 10800 % 17 = 0 AS off FROM nv WHERE origin % 10800 = 0 AND origin // 10800 % 29 <> 0),
 w AS (SELECT series_id, t, value, count(value) OVER (PARTITION BY series_id ORDER BY t RANGE BETWEEN 10800 PRECEDING AND CURRENT ROW) = 4 AS whole FROM g),
 x AS (SELECT i.*, w.whole, w.value AS held, pf.p * 60 AS pattern, y.value AS day_before FROM i JOIN w ON w.series_id = i.series_id AND w.t = i.origin LEFT JOIN pf ON pf.series_id = i.series_id AND pf.origin = i.origin AND pf.step = i.step LEFT JOIN g y ON y.series_id = i.series_id AND y.t = i.target - 86400),
 r AS (SELECT series_id, origin, step, target, off, 'served' AS predictor, rpm AS v, CASE WHEN rpm IS NULL THEN 'recorded value absent' END AS absent FROM x
  UNION ALL SELECT series_id, origin, step, target, off, 'seasonal', CASE WHEN whole THEN pattern END, CASE WHEN NOT whole THEN 'invalid input window' WHEN pattern IS NULL THEN 'no support' END FROM x
  UNION ALL SELECT series_id, origin, step, target, off, 'previous_day', day_before * 60, CASE WHEN day_before IS NULL THEN 'no observation a day before' END FROM x
  UNION ALL SELECT series_id, origin, step, target, off, 'persistence', held * 60, CASE WHEN held IS NULL THEN 'no observation at the origin' END FROM x)
 SELECT series_id, origin, step::INTEGER AS step, target, predictor, round(CASE WHEN NOT isnan(v) AND (NOT off OR predictor = 'served') THEN v END, 4) AS value,
  CASE WHEN off THEN 'failed' WHEN absent IS NOT NULL THEN 'unavailable' WHEN isnan(v) THEN 'non_finite' ELSE 'ok' END AS status, CASE WHEN off THEN 'invalid issuance target grid' ELSE absent END AS detail FROM r""",
)
def f17(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir).withColumn("value", F.col("value") * 60)
    seasonal = forecasts.profile_forecast(g, DAY, 7, 1, 6, HOUR)
    return rounded(served.served_components(recorded(spark, sf_dir), g, seasonal, DAY, HOUR), "value", places=4)
