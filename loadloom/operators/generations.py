"""Fits in generations: one fit of the profile-AR model for each series and boundary, served to the origins after it.

The sums of a fit's rows are added up by blocks between boundaries first, so a fit adds blocks, not rows, and each row
is multiplied out once. Origins find their generation by the boundary before them, and fall back on the one before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loadloom.operators.forecasts import profile, solved, stable
from loadloom.operators.grid import by_series

LAGS = 3


def residuals(grid: DataFrame, season: int, relative: bool) -> DataFrame:
    """(series_id, t, raw): y - profile of seven seasons, or y / profile - 1."""
    both = grid.join(profile(grid, season, 7, 1).select("series_id", "t", "profile"), ["series_id", "t"], "left")
    raw = F.col("value") / F.when(F.col("profile") > 0, F.col("profile")) - 1 if relative else F.col("value") - F.col("profile")
    return both.select("series_id", "t", raw.alias("raw"))


def ar_generations(left: DataFrame, step: int, every: int, seconds: int, rows: int, span: int, clip: float | None = None) -> DataFrame:
    """One row for each series and boundary (a multiple of ``every``): c0 .. c3 of the AR(3) fit to the last ``seconds``, n, status.

    ``left``: every slot's residual (``raw``, NULL where unknown); the fit sees it cut to ``clip`` either way. Status: ok, few_rows
    (under ``rows`` whole rows, or not spanning ``span``), singular, or unstable (a root of 0.999 or more; not asked of clipped fits). ``seconds`` is
    a multiple of ``every``; the first row of the trailing time has its lags within it, so rows start four steps later.
    """
    w = by_series()
    r = F.when(F.col("raw").isNotNull(), F.least(F.greatest(F.col("raw"), F.lit(-clip)), F.lit(clip))) if clip else F.col("raw")
    x = left.withColumn("r", r).withColumns({f"x{k}": F.lag("r", k).over(w) for k in range(1, LAGS + 1)}).withColumn("x0", F.lit(1.0))
    whole = F.col("r").isNotNull()
    for k in range(1, LAGS + 1):
        whole = whole & F.col(f"x{k}").isNotNull()
    x = x.withColumns({"t_": F.when(whole, F.col("t")), "b": F.ceil(F.col("t") / every).cast("bigint") * every})
    products = {f"b{i}": F.col(f"x{i}") * F.col("r") for i in range(LAGS + 1)} | {f"a{i}{j}": F.col(f"x{i}") * F.col(f"x{j}") for i in range(LAGS + 1) for j in range(i, LAGS + 1)}
    late = F.col("t") - (F.col("b") - every) >= 4 * step  # what the oldest block of a fit still gives
    sums: list[Column] = []
    for part, taken in (("all", whole), ("end", whole & late)):
        sums += [F.sum(F.when(taken, p)).alias(f"{part}_{c}") for c, p in products.items()]
        sums += [F.count_if(taken).alias(f"{part}_n"), F.min(F.when(taken, F.col("t"))).alias(f"{part}_lo"), F.max(F.when(taken, F.col("t"))).alias(f"{part}_hi")]
    blocks = x.groupBy("series_id", "b").agg(*sums, F.max("t").alias("last_t"))
    order = Window.partitionBy("series_id").orderBy("b")
    full, oldest = order.rangeBetween(-(seconds - 2 * every), 0), order.rangeBetween(-(seconds - every), -(seconds - every))

    def total(c: str) -> Column:
        return F.coalesce(F.sum(f"all_{c}").over(full), F.lit(0)) + F.coalesce(F.sum(f"end_{c}").over(oldest), F.lit(0))

    lo = F.least(F.min("all_lo").over(full), F.min("end_lo").over(oldest))
    hi = F.greatest(F.max("all_hi").over(full), F.max("end_hi").over(oldest))
    s = blocks.select("series_id", F.col("b").alias("boundary"), "last_t", total("n").alias("n"), (hi - lo).alias("span"), *[total(c).alias(c) for c in products])
    s = s.where(F.col("last_t") == F.col("boundary")).withColumn("enough", (F.col("n") >= rows) & F.coalesce(F.col("span") >= span, F.lit(False)))  # the boundary itself is a slot
    fit = solved(s, LAGS, F.col("enough"))
    known = F.col("c0").isNotNull() & F.col("c1").isNotNull() & F.col("c2").isNotNull() & F.col("c3").isNotNull()
    status = F.when(~F.col("enough"), "few_rows").when(~known, "singular").when(F.lit(clip is None) & ~stable(), "unstable").otherwise("ok")
    fit = fit.withColumn("status", status)
    return fit.select("series_id", "boundary", "n", "status", *[F.when(F.col("status") == "ok", F.col(f"c{k}")).alias(f"c{k}") for k in range(LAGS + 1)])


def serving(generations: DataFrame, every: int) -> DataFrame:
    """For each boundary the generation that serves the time after it: its own, else the one before (``stale``), else none.

    A row for each boundary of a generation and the one after it: series_id, boundary, generation, stale, reason, c0 .. c3.
    """
    coefficients = F.struct(*[f"c{k}" for k in range(LAGS + 1)])
    offered = generations.select("series_id", "boundary", F.col("boundary").alias("generation"), "status", coefficients.alias("c"), F.explode(F.array(F.lit(0), F.lit(1))).alias("back"))
    offered = offered.withColumn("boundary", F.col("boundary") + F.col("back") * every)
    good = F.when(F.col("status") == "ok", F.struct("back", "generation", "c"))
    found = offered.groupBy("series_id", "boundary").agg(F.min(good).alias("g"), F.min_by("status", "back").alias("reason"))
    return found.select("series_id", "boundary", F.col("g.generation").alias("generation"), (F.col("g.back") == 1).alias("stale"), F.when(F.col("g").isNull(), F.col("reason")).alias("reason"), "g.c.*")


def generation_forecast(grid: DataFrame, season: int, steps: int, step: int, every: int, seconds: int, rows: int, span: int, relative: bool = False, clip: float = 0.5) -> DataFrame:
    """Profile of each target plus the recursion of the generation in force, never below 0, at every origin.

    Returns series_id, origin, step, target, predicted, generation (boundary of the fit), stale, status: ok, or unavailable
    (no valid generation, a lag missing at the origin, or no profile at the target) with the reason in ``reason``.
    """
    left = residuals(grid, season, relative)
    fits = serving(ar_generations(left, step, every, seconds, rows, span, clip if relative else None), every)
    w = by_series()
    lags = left.select("series_id", F.col("t").alias("origin"), F.expr(f"t div {every} * {every}").alias("boundary"), F.col("raw").alias("h1"), F.lag("raw", 1).over(w).alias("h2"), F.lag("raw", 2).over(w).alias("h3"))
    lags = lags.join(fits, ["series_id", "boundary"], "left")
    made = [F.col("h3"), F.col("h2"), F.col("h1")]
    for k in range(steps):
        lags = lags.withColumn(f"f{k + 1}", F.col("c0") + F.col("c1") * made[-1] + F.col("c2") * made[-2] + F.col("c3") * made[-3])
        made.append(F.col(f"f{k + 1}"))
    told = lags.select("series_id", "origin", "generation", "stale", F.coalesce("reason", F.when(F.col("generation").isNull(), "no_fit")).alias("reason"), F.posexplode(F.array(*[f"f{k + 1}" for k in range(steps)])).alias("k", "left"))
    told = told.select("*", (F.col("k") + 1).alias("step"), (F.col("origin") + (F.col("k") + 1) * step).alias("target")).drop("k")
    told = told.join(profile(grid, season, 7, 1).select("series_id", F.col("t").alias("target"), "profile"), ["series_id", "target"], "left")
    raw = F.col("profile") * (1 + F.col("left")) if relative else F.col("profile") + F.col("left")
    predicted = F.when(raw.isNotNull(), F.greatest(raw, F.lit(0.0)))
    reason = F.coalesce("reason", F.when(F.col("left").isNull(), "no_lags"), F.when(F.col("profile").isNull(), "no_profile"))
    return told.select("series_id", "origin", "step", "target", predicted.alias("predicted"), "generation", "stale", F.when(predicted.isNotNull(), "ok").otherwise("unavailable").alias("status"), reason.alias("reason"))
