"""Forecasts scaled by how the last slots came out against a reference."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from loadloom.operators.forecasts import profile, profile_forecast
from loadloom.operators.grid import by_series, forward_fill


def weights(support: int, half_life: float) -> list[float]:
    """Of the last ``support`` slots, the newest first."""
    return [math.exp(-math.log(2) / half_life * j) for j in range(support)]


def level_ratio(grid: DataFrame, reference: DataFrame, low: float, high: float, support: int = 6, half_life: float = 3.0) -> DataFrame:
    """(series_id, origin, ratio): fading mean of value / reference over the last ``support`` slots of a whole grid, kept in [low, high].

    Values are filled forward; slots without one, or without a reference above 0, have no weight; where none has, the ratio is 1.
    """
    x = forward_fill(grid).select("series_id", "t", "filled").join(reference.select("series_id", "t", "reference"), ["series_id", "t"], "left")
    x = x.withColumn("x", F.when(F.col("reference") > 0, F.col("filled") / F.col("reference")))
    lags = [F.lag("x", j).over(by_series()) for j in range(support)]
    zero = F.lit(0.0)
    top: Column = sum((F.coalesce(v * w, zero) for v, w in zip(lags, weights(support, half_life), strict=True)), zero)
    bottom: Column = sum((F.when(v.isNotNull(), w).otherwise(0.0) for v, w in zip(lags, weights(support, half_life), strict=True)), zero)
    return x.select("series_id", F.col("t").alias("origin"), F.when(bottom > 0, F.least(F.greatest(top / bottom, F.lit(low)), F.lit(high))).otherwise(1.0).alias("ratio"))


def profile_ratio(grid: DataFrame, season: int, steps: int, step: int, low: float = 0.6, high: float = 1.6) -> DataFrame:
    """The seven-season profile of each target, scaled by how the last slots came out against theirs."""
    reference = profile(grid, season, 7, 1).select("series_id", "t", F.col("profile").alias("reference"))
    made = profile_forecast(grid, season, 7, 1, steps, step).join(level_ratio(grid, reference, low, high), ["series_id", "origin"])
    return made.select("series_id", "origin", "step", "target", "ratio", (F.col("predicted") * F.col("ratio")).alias("predicted"))


def bias_corrected(forecast: DataFrame, grid: DataFrame, low: float = 0.85, high: float = 1.2) -> DataFrame:
    """A forecaster's rows, scaled by how the last slots came out against its own first steps; never below 0.

    A slot's reference is what was said for it one slot before, so nothing is used that was not known at the origin. An origin
    with any step missing has none.
    """
    reference = forecast.where("step = 1").select("series_id", F.col("target").alias("t"), F.col("predicted").alias("reference"))
    whole = forecast.groupBy("series_id", "origin").agg(F.count_if(F.col("predicted").isNull()).alias("missing"))
    x = forecast.join(whole, ["series_id", "origin"]).join(level_ratio(grid, reference, low, high), ["series_id", "origin"])
    return x.select("series_id", "origin", "step", "target", "ratio", F.when(F.col("missing") == 0, F.greatest(F.col("predicted") * F.col("ratio"), F.lit(0.0))).alias("predicted"))
