"""Running values over one line of time, cut into ranges so that a hot series is spread over tasks.

Each range works by itself; what a range ends with is one row, and those few rows are carried over the ranges before the
ranges take them up. Rows are shuffled once, by series and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

RANGE = "_range"


def _with_prior(line: DataFrame, ends: DataFrame, prior: Column, name: str) -> DataFrame:
    return line.join(ends.select("series_id", RANGE, prior.alias(name)), ["series_id", RANGE])


def carry_forward(line: DataFrame, value: str, order: list[str], width: int, into: str, strict: bool = False) -> DataFrame:
    """Adds ``into``: the last ``value`` that is not NULL among the rows up to this one (``strict``: before it), by ``order``; times are in ``t``.

    ``width`` seconds make a range.
    """
    cut = line.withColumn(RANGE, F.floor(F.col("t") / width))
    inside = Window.partitionBy("series_id", RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    before = Window.partitionBy("series_id").orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    ends = cut.groupBy("series_id", RANGE).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_end"))
    ends = ends.withColumn("_prior", F.last("_end", ignorenulls=True).over(before))
    out = _with_prior(cut.withColumn("_own", F.last(value, ignorenulls=True).over(inside)), ends, F.col("_prior"), "_prior")
    return out.withColumn(into, F.coalesce("_own", "_prior")).drop("_own", "_prior", RANGE)


def running_total(line: DataFrame, value: str, order: list[str], width: int, into: str) -> DataFrame:
    """Adds ``into``: the sum of ``value`` over the rows up to this one, by ``order``."""
    cut = line.withColumn(RANGE, F.floor(F.col("t") / width))
    inside = Window.partitionBy("series_id", RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("series_id").orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    ends = cut.groupBy("series_id", RANGE).agg(F.sum(value).alias("_end")).withColumn("_prior", F.coalesce(F.sum("_end").over(before), F.lit(0)))
    out = _with_prior(cut.withColumn("_own", F.sum(value).over(inside)), ends, F.col("_prior"), "_prior")
    return out.withColumn(into, F.coalesce("_own", F.lit(0)) + F.col("_prior")).drop("_own", "_prior", RANGE)
