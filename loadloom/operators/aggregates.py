"""Error, coverage, quantile and evidence aggregates. What was not scored gives NULL, never 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loadloom.functions.scalars import ratio


def error_columns(actual: str = "actual", predicted: str = "predicted") -> list[Column]:
    a, p = F.col(actual), F.col(predicted)
    return [
        F.count(p - a).alias("scored"),
        F.avg(F.abs(p - a)).alias("mae"),
        F.avg(p - a).alias("bias"),
        F.sqrt(F.avg((p - a) * (p - a))).alias("rmse"),
        (100 * F.avg(F.when(a > 0, F.abs(p - a) / a))).alias("mape"),
        F.avg((p < a).cast("double")).alias("under_share"),
    ]


def error_sets(scored: DataFrame, *keys: str) -> DataFrame:
    """The errors overall and for each value of each key, pooled over rows, in one pass; ``part`` and ``of`` name the group."""
    sets = F.explode(F.array(F.struct(F.lit("all").alias("part"), F.lit("").alias("of")), *[F.struct(F.lit(k).alias("part"), F.col(k).cast("string").alias("of")) for k in keys]))
    return scored.withColumn("g", sets).groupBy(F.col("g.part").alias("part"), F.col("g.of").alias("of")).agg(*error_columns())


def weighted_mape(scored: DataFrame, least: float, *keys: str) -> DataFrame:
    """Summed error over summed actual, of points with an actual of ``least`` or more; availability is scored over recorded."""
    measured = F.col("actual").isNotNull() & F.col("predicted").isNotNull() & (F.col("actual") >= least)
    return scored.groupBy(*keys).agg(
        F.count("*").alias("recorded"),
        F.count_if(measured).alias("scored"),
        (100 * ratio(F.sum(F.when(measured, F.abs(F.col("actual") - F.col("predicted")))), F.sum(F.when(measured, F.col("actual"))))).alias("wmape"),
        ratio(F.count_if(measured), F.count("*")).alias("availability"),
    )


def histogram_quantile(buckets: DataFrame, q: float, *keys: str) -> DataFrame:
    """Quantile of cumulative buckets (le, cum) summed over their other columns: linear inside a bucket, the bound below where
    the bucket has no end, NULL where nothing was counted. Counts are merged first; quantiles are never averaged."""
    merged = buckets.groupBy(*keys, "le").agg(F.sum("cum").alias("cum"))
    w = Window.partitionBy(*keys).orderBy("le")
    total = F.max("cum").over(Window.partitionBy(*keys))
    placed = merged.withColumns({"rank": total * q, "total": total, "lo": F.coalesce(F.lag("le").over(w), F.lit(0.0)), "below": F.coalesce(F.lag("cum").over(w), F.lit(0.0))})
    hit = placed.where((F.col("cum") >= F.col("rank")) & (F.col("below") < F.col("rank")))
    value = F.when(F.col("le") == float("inf"), F.col("lo")).otherwise(F.col("lo") + (F.col("le") - F.col("lo")) * (F.col("rank") - F.col("below")) / (F.col("cum") - F.col("below")))
    return placed.select(*keys).distinct().join(hit.select(*keys, value.alias("quantile")), list(keys), "left")


def nearest_rank(points: DataFrame, q: float, *keys: str) -> DataFrame:
    """The value of rank ceil(q * n)."""
    w = Window.partitionBy(*keys)
    ranked = points.where("value is not null").withColumns({"r": F.row_number().over(w.orderBy("value")), "n": F.count("*").over(w)})
    return ranked.where(F.col("r") == F.ceil(F.col("n") * F.lit(q))).select(*keys, "value")


def weighted_percentile(points: DataFrame, q: float, *keys: str) -> DataFrame:
    """Linear between the middles of the weights' steps, clamped at the ends; a single value is itself."""
    w = Window.partitionBy(*keys).orderBy("value", "t")
    total = F.sum("weight").over(Window.partitionBy(*keys))
    placed = points.withColumn("at", (F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("weight") / 2) / total)
    lo, hi = F.when(F.col("at") <= q, F.struct("at", "value")), F.when(F.col("at") >= q, F.struct("at", "value"))
    ends = placed.groupBy(*keys).agg(F.max(lo).alias("lo"), F.min(hi).alias("hi"))
    between = F.col("lo.value") + (F.col("hi.value") - F.col("lo.value")) * (q - F.col("lo.at")) / (F.col("hi.at") - F.col("lo.at"))
    value = F.when(F.col("lo").isNull(), F.col("hi.value")).when(F.col("hi").isNull(), F.col("lo.value")).when(F.col("hi.at") == F.col("lo.at"), F.col("lo.value")).otherwise(between)
    return ends.select(*keys, value.alias("value"))


def robust_scale(points: DataFrame, *keys: str) -> DataFrame:
    """Median and 1.4826 times the median deviation from it; 1.2533 times the mean deviation where that is 0."""
    middle = points.groupBy(*keys).agg(F.median("value").alias("median"))
    apart = points.join(middle, list(keys)).withColumn("d", F.abs(F.col("value") - F.col("median")))
    out = apart.groupBy(*keys, "median").agg(F.median("d").alias("mad"), F.avg("d").alias("mean_d"))
    return out.select(*keys, "median", F.when(F.col("mad") > 0, 1.4826 * F.col("mad")).otherwise(1.2533 * F.col("mean_d")).alias("scale"))


def equal_count_bins(pairs: DataFrame, bins: int, *keys: str) -> DataFrame:
    """Rows in ``bins`` bins of equal count by (level, t): median level and scaled median size of residual of each."""
    w = Window.partitionBy(*keys)
    placed = pairs.withColumn("bin", F.floor((F.row_number().over(w.orderBy("level", "t")) - 1) * bins / F.count("*").over(w)).cast("int"))
    return placed.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.median("level").alias("level"), (1.4826 * F.median(F.abs("residual"))).alias("spread"))


def conflicts(rows: DataFrame, *keys: str) -> DataFrame:
    """For each key: rows, and whether all that it says is the same."""
    said = F.sha2(F.to_json(F.struct(*[c for c in rows.columns if c not in keys])), 256)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), (F.count_distinct(said) == 1).alias("identical"))


def mean_interval(values: DataFrame, t: float, *keys: str) -> DataFrame:
    """Mean over replications with ``t`` standard errors on both sides."""
    half = t * F.stddev_samp("value") / F.sqrt(F.count("value"))
    return values.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), (F.avg("value") - half).alias("low"), (F.avg("value") + half).alias("high"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Interval of a share, within [0, 1]; nothing counted says nothing, so it is all of that."""
    n = F.nullif(n, F.lit(0.0))
    p = hits / n
    middle, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low, high = (middle - half) / (1 + z * z / n), (middle + half) / (1 + z * z / n)
    return F.when(n.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), low)), F.when(n.isNull(), 1.0).otherwise(F.least(F.lit(1.0), high))
