"""Window operators over series; rows are slots of a whole grid unless said otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from loadloom.operators.folds import fold_rows
from loadloom.operators.grid import by_series


def trailing_margin(leads: DataFrame, q: float, first: int, last: int, least: int) -> DataFrame:
    """The ``q`` quantile of recent misses (actual - lead) over rows -first to -last, kept within 0 and 0.8 of the lead; 0 with under
    ``least`` of them."""
    w = by_series().rowsBetween(-first, -last)
    miss = F.col("actual") - F.col("lead")
    n, quantile = F.count(miss).over(w), F.percentile(miss, F.lit(q)).over(w)
    margin = F.when(n >= least, F.least(F.greatest(quantile, F.lit(0.0)), F.greatest(0.8 * F.col("lead"), F.lit(0.0)))).otherwise(0.0)
    return leads.withColumn("margin", F.when(F.col("lead").isNotNull(), margin))


def trailing_hours(buckets: DataFrame, hours: int, *values: str) -> DataFrame:
    """Sums over the last ``hours`` whole hours; ``buckets`` has one row for an hour that has any."""
    w = by_series("hour").rangeBetween(-(hours - 1), 0)
    return buckets.select("series_id", "hour", *[F.sum(v).over(w).alias(v) for v in values])


def trailing_sums(rows: DataFrame, seconds: int, **sums: Column) -> DataFrame:
    """At every time of a series that has rows: ``sums`` over the rows of the window that ends there, and ``first``, its earliest time.

    The window goes from the first whole hour at or after t - seconds up to t. Whole hours are summed first, and the rows of one hour
    among themselves, so no task sorts more of a series than its hours.
    """
    hourly = rows.withColumn("hour", F.floor(F.col("t") / 3600))
    hours = hourly.groupBy("series_id", "hour").agg(*[F.sum(c).alias(k) for k, c in sums.items()], F.min("t").alias("first"))
    # t - seconds lies on a whole hour only if t does: else the oldest hour is one later
    wide = [Window.partitionBy("series_id").orderBy("hour").rangeBetween(-seconds // 3600 + k, -1) for k in (0, 1)]
    hours = hours.select("series_id", "hour", *[F.struct(*[F.coalesce(F.sum(k).over(w), F.lit(0)).alias(k) for k in sums], F.min("first").over(w).alias("first")).alias(f"before_{n}") for n, w in enumerate(wide)])
    own = hourly.groupBy("series_id", "hour", "t").agg(*[F.sum(c).alias(f"own_{k}") for k, c in sums.items()])
    within = Window.partitionBy("series_id", "hour").orderBy("t")
    own = own.select("series_id", "t", "hour", *[F.sum(f"own_{k}").over(within).alias(f"own_{k}") for k in sums], F.min("t").over(within).alias("own_first"))
    both = own.join(hours, ["series_id", "hour"]).withColumn("before", F.when(F.col("t") % 3600 == 0, F.col("before_0")).otherwise(F.col("before_1")))
    return both.select("series_id", "t", *[(F.col(f"own_{k}") + F.col(f"before.{k}")).alias(k) for k in sums], F.coalesce("before.first", "own_first").alias("first"))


def misses(outcomes: DataFrame, n: int) -> DataFrame:
    """Of the last ``n`` outcomes (seq, covered) the missed ones, and how many were missed in a row up to now."""
    w = by_series("seq")
    marked = outcomes.withColumn("m", (~F.col("covered")).cast("int"))
    marked = marked.withColumn("block", F.sum(1 - F.col("m")).over(w))
    return marked.select("series_id", "seq", F.sum("m").over(w.rowsBetween(-(n - 1), 0)).alias("missed"), F.sum("m").over(Window.partitionBy("series_id", "block").orderBy("seq")).alias("in_a_row"))


def onsets(looks: DataFrame) -> DataFrame:
    """Looks at which a rule turned from false to true."""
    return looks.withColumn("was", F.coalesce(F.lag("rule").over(by_series()), F.lit(False))).where("rule and not was").select("series_id", "t")


def level_ratio(grid: DataFrame, season: int, n: int) -> DataFrame:
    """Recent level against the same slots a season before, kept within 0.5 and 2."""
    w = by_series()
    own, before = F.avg("value").over(w.rowsBetween(-(n - 1), 0)), F.avg("value").over(w.rowsBetween(-(season + n - 1), -season))
    return grid.withColumn("ratio", F.when(before > 0, F.least(F.greatest(own / before, F.lit(0.5)), F.lit(2.0))))


def changes(states: DataFrame) -> DataFrame:
    """Number of changes of a held value, and its integral over time in minutes, gaps over ``most`` left out."""
    w = by_series()
    held = states.withColumns({"was": F.lag("value").over(w), "dt": F.lead("t").over(w) - F.col("t")})
    return held.groupBy("series_id").agg(F.count_if(F.col("was").isNotNull() & (F.col("was") != F.col("value"))).alias("changes"), F.sum(F.when(F.col("dt") <= 7200, F.col("value") * F.col("dt") / 60)).alias("minutes"))


def increments(counters: DataFrame) -> DataFrame:
    """What a counter grew by since its last sample; after a decrease it counts as started at 0."""
    was = F.lag("value").over(by_series())
    grown = F.when(was.isNull(), F.lit(None)).when(F.col("value") < was, F.col("value")).otherwise(F.col("value") - was)
    return counters.withColumns({"grown": grown, "reset": F.coalesce(F.col("value") < was, F.lit(False))})


def sequence_gaps(log: DataFrame) -> DataFrame:
    """Missing sequence numbers between neighbours: (series_id, first, last)."""
    pairs = log.select("series_id", F.col("seq"), F.lead("seq").over(by_series("seq")).alias("next"))
    return pairs.where(F.col("next") - F.col("seq") > 1).select("series_id", (F.col("seq") + 1).alias("first"), (F.col("next") - 1).alias("last"))


def out_of_order(log: DataFrame) -> DataFrame:
    """Rows whose sequence number is under one that came before in the log's own order (pos)."""
    top = F.max("seq").over(by_series("pos").rowsBetween(Window.unboundedPreceding, -1))
    return log.withColumn("top", top).where(F.col("seq") < F.col("top")).groupBy("series_id").agg(F.count("*").alias("late"))


def latest(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("series_id").orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def resetting_balance(steps: DataFrame, allowance: float) -> DataFrame:
    """Running sum of ``delta`` that starts again at 0 after it leaves [-allowance, allowance] or meets a NULL."""

    def turn(balance: float, row: tuple) -> tuple[float, tuple]:
        series, t, delta = row
        reset = delta is None or abs(balance + delta) > allowance
        balance = 0.0 if reset else balance + delta
        return balance, (series, t, balance, reset)

    return fold_rows(steps.select("series_id", "t", "delta"), ["t"], float, turn, "series_id string, t long, balance double, reset boolean")
