"""User extensions: named transforms, per-series forecasters in pandas, and a table function of forecast steps."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import udtf

from loadloom.plans.registry import DAY, G, HOUR, START, grid, hourly, query
from loadloom.sources.journal import retained

TRANSFORMS: dict[str, Callable[[DataFrame], DataFrame]] = {}
FORECAST = "series_id string, origin long, step int, predicted double"


def transform(name: str) -> Callable:
    """Registers a DataFrame transform by name."""

    def keep(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        TRANSFORMS[name] = f
        return f

    return keep


def per_series(points: DataFrame, forecaster: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Rows of a user's forecaster for each series; it gets one series' points in order of time. A series has to fit a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return forecaster(pdf.sort_values("t"))

    return points.groupBy("series_id").applyInPandas(run, FORECAST)


class _Steps:
    def eval(self, origin: int, steps: int, seconds: int):
        for k in range(1, steps + 1):
            yield k, origin + k * seconds


forecast_steps = udtf(_Steps, returnType="step int, target long", useArrow=False)


@query("y02_pandas_forecaster", f"WITH {G}, m AS (SELECT series_id, max(t) AS origin, arg_max(value, t) AS v FROM g WHERE value IS NOT NULL GROUP BY 1) SELECT series_id, origin, s::INTEGER AS step, v AS predicted FROM m, (SELECT unnest(range(1, 7)) AS s)")
def y02(spark: SparkSession, sf_dir: str) -> DataFrame:
    def last_value(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[-1]
        return pd.DataFrame({"series_id": row.series_id, "origin": int(row.t), "step": range(1, 7), "predicted": row.value})

    return per_series(hourly(spark, sf_dir), last_value)


@query("y03_forecast_steps", f"WITH {G} SELECT series_id, t AS origin, s::INTEGER AS step, t + s * 3600 AS target FROM g, (SELECT unnest(range(1, 7)) AS s) WHERE t % 21600 = 0")
def y03(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.udtf.register("forecast_steps", forecast_steps)
    grid(spark, sf_dir).where(F.col("t") % (6 * HOUR) == 0).select("series_id", F.col("t").alias("origin")).createOrReplaceTempView("loadloom_origins")
    return spark.sql("SELECT series_id, origin, step, target FROM loadloom_origins, LATERAL forecast_steps(origin, 6, 3600)")


@query(
    "s10_retention",
    f"""WITH {G}, i AS (SELECT series_id, t AS origin FROM g), o AS (SELECT series_id, t AS origin, m AS model, CASE WHEN value IS NULL AND m = 1 THEN 'pending' ELSE 'scored' END AS status FROM g, (SELECT unnest(range(0, 2)) AS m)),
 d AS (SELECT series_id, origin FROM o WHERE status = 'scored' AND origin < {START + 20 * DAY} GROUP BY 1, 2 HAVING count(DISTINCT model) >= 2) SELECT i.* FROM i WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.series_id = i.series_id AND d.origin = i.origin)""",
)
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    outcomes = g.select("series_id", F.col("t").alias("origin"), "value", F.explode(F.array(F.lit(0), F.lit(1))).alias("model"))
    outcomes = outcomes.withColumn("status", F.when(F.col("value").isNull() & (F.col("model") == 1), "pending").otherwise("scored"))
    return retained(g.select("series_id", F.col("t").alias("origin")), outcomes, 2, START + 20 * DAY)
