"""What each component would have said for a recorded issuance, with a status for every step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PREDICTORS = ("served", "seasonal", "previous_day", "persistence")


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def issuance_notes(issuances: DataFrame, step: int, most: int = 6) -> DataFrame:
    """Adds ``note``: unusable (no forecasts, no input end or no sequence length), invalid_grid (too many steps, an origin off the grid, or
    steps and targets other than 1, 2, ... after it), else NULL."""
    n = F.size("forecasts")
    expected = F.forall(F.transform("forecasts", lambda f, i: F.coalesce((f["step"] == i + 1) & (f["target"] == F.col("origin") + (i + 1) * step), F.lit(False))), lambda ok: ok)
    unusable = F.col("origin").isNull() | F.col("forecasts").isNull() | (n < 1) | (F.coalesce("sequence_length", F.lit(0)) <= 0)
    return issuances.withColumn("note", F.when(unusable, "unusable").when((n > most) | (F.col("origin") % step != 0) | ~expected, "invalid_grid"))


def served_components(issuances: DataFrame, grid: DataFrame, seasonal: DataFrame, season: int, step: int) -> DataFrame:
    """For each issuance, predictor and step: value, status (ok, unavailable, non_finite, failed) and detail.

    ``issuances``: series_id, origin (input end), sequence_length, forecasts (array of step, target, rpm). ``grid``: the observed slots, NULL
    where there is none. ``seasonal``: the component's own forecasts (series_id, origin, step, predicted). ``served`` is what was recorded,
    even where the rest cannot be rebuilt. Persistence takes the value observed at the origin alone, the previous day that of the
    slot a season before the target. The seasonal component needs the whole input window, ``sequence_length`` slots up to the
    origin. An issuance with an invalid grid fails in every predictor; an unusable one has no rows.
    """
    noted = issuance_notes(issuances, step).where("note is null or note <> 'unusable'")
    w = "partition by series_id order by t rows between unbounded preceding and current row"
    known = grid.select("series_id", F.col("t").alias("origin"), F.col("value").alias("held"), F.expr(f"coalesce(max(case when value is null then t end) over ({w}), min(t) over ({w}) - {step})").alias("last_gap"))
    whole = F.coalesce(F.col("origin") - (F.col("sequence_length") - 1) * step > F.col("last_gap"), F.lit(False))
    at = noted.join(known, ["series_id", "origin"], "left").withColumn("whole", whole)
    steps = at.select("series_id", "origin", "note", "held", "whole", F.posexplode("forecasts").alias("k", "f"))
    steps = steps.select("series_id", "origin", "note", "held", "whole", (F.col("k") + 1).alias("step"), F.col("f.target").alias("target"), F.col("f.rpm").alias("rpm"))
    steps = steps.join(seasonal.select("series_id", "origin", "step", F.col("predicted").alias("pattern")), ["series_id", "origin", "step"], "left")
    steps = steps.join(grid.select("series_id", (F.col("t") + season).alias("target"), F.col("value").alias("day_before")), ["series_id", "target"], "left")
    no_window = F.when(~F.col("whole"), "invalid input window")
    told = {
        "served": (F.col("rpm"), F.when(F.col("rpm").isNull(), "recorded value absent")),
        "seasonal": (F.when(F.col("whole"), F.col("pattern")), F.coalesce(no_window, F.when(F.col("pattern").isNull(), "no support"))),
        "previous_day": (F.col("day_before"), F.when(F.col("day_before").isNull(), "no observation a day before")),
        "persistence": (F.col("held"), F.when(F.col("held").isNull(), "no observation at the origin")),
    }
    rows = [F.struct(F.lit(p).alias("predictor"), told[p][0].alias("value"), told[p][1].alias("absent")) for p in PREDICTORS]
    out = steps.select("series_id", "origin", "step", "target", "note", F.explode(F.array(*rows)).alias("p")).select("series_id", "origin", "step", "target", "note", "p.*")
    bad_grid, recorded = F.col("note").isNotNull(), F.col("predictor") == "served"
    status = F.when(bad_grid, "failed").when(F.col("absent").isNotNull(), "unavailable").when(~_finite(F.col("value")), "non_finite").otherwise("ok")
    detail = F.when(bad_grid, "invalid issuance target grid").otherwise(F.col("absent"))
    value = F.when(_finite(F.col("value")) & (~bad_grid | recorded), F.col("value"))
    return out.select("series_id", "origin", "step", "target", "predictor", value.alias("value"), status.alias("status"), detail.alias("detail"))
