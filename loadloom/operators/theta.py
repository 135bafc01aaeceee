"""The theta forecaster: smoothing with drift on what is left when the slots of the season are taken out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

LEAST_INDEX = 1e-6


def _smoothed(values: Column, n: Column, alpha: Column) -> Column:
    """(squared one-step error, alpha, last level) of simple exponential smoothing from the first value on."""
    begin = F.struct(F.lit(0.0).alias("sse"), F.get(values, F.lit(0)).alias("level"))
    turn = lambda s, v: F.struct((s["sse"] + (v - s["level"]) * (v - s["level"])).alias("sse"), (alpha * v + (1 - alpha) * s["level"]).alias("level"))
    return F.aggregate(F.slice(values, F.lit(2), n - 1), begin, turn, lambda s: F.struct(F.round(s["sse"], 6).alias("sse"), alpha.alias("alpha"), s["level"].alias("level")))


def theta(grid: DataFrame, season: int, steps: int, step: int, window: int, every: int, alphas: list[float]) -> DataFrame:
    """Forecasts at every origin that ``every`` seconds divide, from the ``window`` seconds up to it: series_id, origin, step, target, alpha, predicted.

    ``grid``: series_id, t, value, a row for every slot. A slot's index is its mean over the window's mean; the rest is smoothed with the alpha
    of least squared one-step error (the smaller of equal ones), its drift is half the slope of its line. NULL where the window has
    under two seasons, a gap, or a mean that is not above 0. Each origin is a group of at most window / step rows, spread by
    (series, origin): a hot series is many groups.
    """
    if steps * step > season or window < 2 * season:
        raise ValueError("forecasts reach one season at most, from a window of at least two")
    first = F.ceil(F.col("t") / every) * every
    rows = grid.select("series_id", "t", "value", F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.lit((window - step) // every)), lambda k: first + k * every), lambda o: o - F.col("t") <= window - step)).alias("origin"))
    rows = rows.repartition("series_id", "origin")  # one exchange; the windows below and the group find their rows together
    slot = Window.partitionBy("series_id", "origin", F.pmod(F.col("t"), F.lit(season)))
    whole = Window.partitionBy("series_id", "origin")
    mean = F.avg("value").over(whole)
    rows = rows.withColumn("mean", mean).withColumn("index", F.when(F.col("mean") > 0, F.greatest(F.lit(LEAST_INDEX), F.avg("value").over(slot) / F.col("mean"))))
    rows = rows.withColumn("left", F.col("value") / F.col("index"))
    place = (F.col("t") - F.col("origin")) / step
    one = [F.max(F.when(F.col("t") == F.col("origin") + (k + 1) * step - season, F.col("index"))).alias(f"i{k}") for k in range(steps)]
    found = rows.groupBy("series_id", "origin").agg(
        F.regr_slope("left", place).alias("slope"), F.transform(F.array_sort(F.collect_list(F.struct("t", "left"))), lambda x: x["left"]).alias("values"),
        F.count("*").alias("n"), F.count("left").alias("known"), F.max("t").alias("latest"), *one,
    ).where(F.col("latest") == F.col("origin"))
    good = (F.col("n") == F.col("known")) & (F.col("n") >= 2 * season // step)
    best = F.array_min(F.array(*[_smoothed(F.col("values"), F.col("n").cast("int"), F.lit(a)) for a in alphas]))
    found = found.withColumn("fit", F.when(good, best))
    alpha = F.col("fit.alpha")
    found = found.select("series_id", "origin", "slope", "n", "fit", F.posexplode(F.array(*[f"i{k}" for k in range(steps)])).alias("k", "index"))
    drift = 0.5 * F.col("slope") * (F.col("k") + 1 / alpha - F.pow(1 - alpha, F.col("n")) / alpha)
    predicted = F.when(F.col("fit").isNotNull(), F.greatest(F.lit(0.0), (F.col("fit.level") + drift) * F.col("index")))
    return found.select("series_id", "origin", (F.col("k") + 1).alias("step"), (F.col("origin") + (F.col("k") + 1) * step).alias("target"), alpha.alias("alpha"), predicted.alias("predicted"))
