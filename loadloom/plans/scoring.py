"""Queries on joins, errors, quantiles, windows and forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loadloom.functions.scalars import asymmetric_cost, pinball, ratio
from loadloom.operators import aggregates as agg, forecasts, joins, windows
from loadloom.plans.registry import DAY, E, G, H, HOUR, START, events, grid, hourly, query, rounded
from loadloom.session import read_table

ERRORS_SQL = """count(predicted - actual) AS scored, round(avg(abs(predicted - actual)), 6) AS mae, round(avg(predicted - actual), 6) AS bias,
 round(sqrt(avg((predicted - actual) * (predicted - actual))), 6) AS rmse, round(100 * avg(CASE WHEN actual > 0 THEN abs(predicted - actual) / actual END), 6) AS mape,
 round(avg(CASE WHEN predicted < actual THEN 1.0 WHEN predicted >= actual THEN 0.0 END), 6) AS under_share"""
AHEAD = G + ", o AS (SELECT series_id, t AS origin, unnest(range(1, 7)) AS step FROM g), a AS (SELECT *, origin + step * 3600 AS target FROM o)"
NAIVE = AHEAD + """, n0 AS (SELECT a.*, g.value AS p FROM a LEFT JOIN g ON g.series_id = a.series_id AND g.t = a.target - 86400),
 n AS (SELECT series_id, origin, step, target, CASE WHEN count(p) OVER (PARTITION BY series_id, origin) = 6 THEN p END AS predicted FROM n0)"""
SCORED = NAIVE + ", sc AS (SELECT n.*, g.value AS actual FROM n JOIN g ON g.series_id = n.series_id AND g.t = n.target)"


def naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecasts.seasonal_naive(grid(spark, sf_dir), DAY, 6, HOUR)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seasonal-naive forecasts beside what came."""
    actual = grid(spark, sf_dir).select("series_id", F.col("t").alias("target"), F.col("value").alias("actual"))
    return naive(spark, sf_dir).join(actual, ["series_id", "target"])


ERRORS = ("mae", "bias", "rmse", "mape", "under_share")


@query("a01_errors_by_step", f"WITH {SCORED} SELECT series_id, step::INTEGER AS step, {ERRORS_SQL} FROM sc GROUP BY 1, 2")
def a01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scored(spark, sf_dir).groupBy("series_id", "step").agg(*agg.error_columns()), *ERRORS)


@query("a02_error_sets", f"WITH {SCORED}, x AS (SELECT *, series_id AS s FROM sc) SELECT CASE WHEN grouping(step) = 0 THEN 'step' WHEN grouping(s) = 0 THEN 'series_id' ELSE 'all' END AS part, coalesce(step::VARCHAR, s, '') AS \"of\", {ERRORS_SQL} FROM x GROUP BY GROUPING SETS ((), (step), (s))")
def a02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(agg.error_sets(scored(spark, sf_dir), "step", "series_id"), *ERRORS)


@query(
    "a03_weighted_mape",
    f"""WITH {SCORED}, x AS (SELECT *, actual IS NOT NULL AND predicted IS NOT NULL AND actual >= 3 AS m FROM sc)
 SELECT series_id, count(*) AS recorded, count(*) FILTER (WHERE m) AS scored, round(100 * sum(CASE WHEN m THEN abs(actual - predicted) END) / nullif(sum(CASE WHEN m THEN actual END), 0), 6) AS wmape,
  round(count(*) FILTER (WHERE m) / count(*), 6) AS availability FROM x GROUP BY 1""",
)
def a03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(agg.weighted_mape(scored(spark, sf_dir), 3.0, "series_id"), "wmape", "availability")


@query(
    "a04_day_coverage",
    f"""WITH {SCORED}, d AS (SELECT series_id, origin // 86400 AS day, count(*) AS expected, count(predicted) AS answered, avg(abs(predicted - actual)) AS mae FROM sc GROUP BY 1, 2)
 SELECT series_id, day, expected, answered, expected - answered AS missing, answered / expected >= 0.9 AS covered, round(mae, 6) AS mae FROM d""",
)
def a04(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scored(spark, sf_dir).groupBy("series_id", F.floor(F.col("origin") / DAY).alias("day")).agg(F.count("*").alias("expected"), F.count("predicted").alias("answered"), F.avg(F.abs(F.col("predicted") - F.col("actual"))).alias("mae"))
    return rounded(d.withColumns({"missing": F.col("expected") - F.col("answered"), "covered": F.col("answered") / F.col("expected") >= 0.9}), "mae")


@query("a05_pinball", f"WITH {SCORED} SELECT step::INTEGER AS step, round(avg(CASE WHEN actual >= predicted THEN 0.9 * (actual - predicted) ELSE (1 - 0.9) * (predicted - actual) END), 6) AS pinball FROM sc GROUP BY 1")
def a05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("step").agg(F.round(F.avg(pinball(F.col("actual"), F.col("predicted"), 0.9)), 6).alias("pinball"))


@query("a06_weighted_cost", f"WITH {SCORED} SELECT series_id, round(sum((7 - step) * CASE WHEN actual > predicted THEN 2 * (actual - predicted) ELSE predicted - actual END) / nullif(sum(CASE WHEN actual IS NOT NULL AND predicted IS NOT NULL THEN 7 - step END), 0), 6) AS cost FROM sc GROUP BY 1")
def a06(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, cost = 7 - F.col("step"), asymmetric_cost(F.col("actual"), F.col("predicted"))
    return scored(spark, sf_dir).groupBy("series_id").agg(F.round(ratio(F.sum(w * cost), F.sum(F.when(cost.isNotNull(), w))), 6).alias("cost"))


@query(
    "a08_histogram_quantile",
    f"""WITH {E}, l(le) AS (VALUES (25.0::DOUBLE), (50.0), (100.0), (200.0), (300.0), (400.0), ('inf'::DOUBLE)), k AS (SELECT series_id, le, count(*) FILTER (WHERE value <= le)::DOUBLE AS cum FROM e, l GROUP BY 1, 2),
 p AS (SELECT *, max(cum) OVER (PARTITION BY series_id) * 0.95 AS r, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(cum) OVER w, 0) AS below FROM k WINDOW w AS (PARTITION BY series_id ORDER BY le))
 SELECT series_id, round(CASE WHEN le = 'inf'::DOUBLE THEN lo ELSE lo + (le - lo) * (r - below) / (cum - below) END, 6) AS quantile FROM p WHERE cum >= r AND below < r""",
)
def a08(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = F.array(*[F.lit(b) for b in (25.0, 50.0, 100.0, 200.0, 300.0, 400.0, float("inf"))])
    under = events(spark, sf_dir).select("series_id", F.explode(F.filter(bounds, lambda b: b >= F.col("value"))).alias("le"))
    buckets = under.groupBy("series_id", "le").agg(F.count("*").cast("double").alias("cum"))
    return rounded(agg.histogram_quantile(buckets, 0.95, "series_id"), "quantile")


@query("a09_nearest_rank", f"WITH {H} SELECT series_id, quantile_disc(value, 0.9) AS value FROM h GROUP BY 1")
def a09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.nearest_rank(hourly(spark, sf_dir), 0.9, "series_id")


@query("a10_quantiles", f"WITH {E} SELECT series_id, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM e GROUP BY 1")
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("series_id").agg(F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"))


@query(
    "a11_weighted_percentile",
    f"""WITH {H}, x AS (SELECT *, 1.0 + t // 3600 % 3 AS w FROM h), p AS (SELECT *, (sum(w) OVER (PARTITION BY series_id ORDER BY value, t ROWS UNBOUNDED PRECEDING) - w / 2) / sum(w) OVER (PARTITION BY series_id) AS c FROM x),
 z AS (SELECT series_id, max(c) FILTER (WHERE c <= 0.75) AS cl, arg_max(value, c) FILTER (WHERE c <= 0.75) AS vl, min(c) FILTER (WHERE c >= 0.75) AS ch, arg_min(value, c) FILTER (WHERE c >= 0.75) AS vh FROM p GROUP BY 1)
 SELECT series_id, round(CASE WHEN cl IS NULL THEN vh WHEN ch IS NULL OR ch = cl THEN vl ELSE vl + (vh - vl) * (0.75 - cl) / (ch - cl) END, 6) AS value FROM z""",
)
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(agg.weighted_percentile(hourly(spark, sf_dir).withColumn("weight", 1.0 + F.floor(F.col("t") / HOUR) % 3), 0.75, "series_id"), "value")


@query("a12_robust_scale", f"WITH {E}, m AS (SELECT series_id, median(value) AS m FROM e GROUP BY 1) SELECT e.series_id, round(any_value(m), 6) AS median, round(CASE WHEN median(abs(value - m)) > 0 THEN 1.4826 * median(abs(value - m)) ELSE 1.2533 * avg(abs(value - m)) END, 6) AS scale FROM e JOIN m ON m.series_id = e.series_id GROUP BY 1")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(agg.robust_scale(events(spark, sf_dir), "series_id"), "median", "scale")


PAIRS = G + ", jp AS (SELECT x.series_id, x.t, (x.value + y.value) / 2 AS level, x.value - y.value AS residual FROM g x JOIN g y ON y.series_id = x.series_id AND y.t = x.t - 86400 WHERE x.value IS NOT NULL AND y.value IS NOT NULL)"


@query("j14_day_lag_pairs", f"WITH {PAIRS} SELECT * FROM jp")
def j14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.day_lag_pairs(hourly(spark, sf_dir), DAY)


@query(
    "a13_equal_count_bins",
    f"""WITH {PAIRS}, b AS (SELECT *, ((row_number() OVER (PARTITION BY series_id ORDER BY level, t) - 1) * 8 // count(*) OVER (PARTITION BY series_id))::INTEGER AS bin FROM jp)
 SELECT series_id, bin, count(*) AS n, round(median(level), 6) AS level, round(1.4826 * median(abs(residual)), 6) AS spread FROM b GROUP BY 1, 2""",
)
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(agg.equal_count_bins(joins.day_lag_pairs(hourly(spark, sf_dir), DAY), 8, "series_id"), "level", "spread")


@query(
    "a14_hourly_evidence",
    f"""WITH {SCORED} SELECT series_id, origin // 3600 AS hour, count(*) AS issued, count(predicted - actual) AS scored, count(*) - count(predicted - actual) AS unscorable,
 count(*) FILTER (WHERE actual <= predicted) AS covered, round(coalesce(sum(abs(predicted - actual)), 0), 6) AS abs_error, round(coalesce(sum(predicted - actual), 0), 6) AS bias FROM sc GROUP BY 1, 2""",
)
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("predicted") - F.col("actual")
    return scored(spark, sf_dir).groupBy("series_id", F.floor(F.col("origin") / HOUR).alias("hour")).agg(
        F.count("*").alias("issued"), F.count(e).alias("scored"), (F.count("*") - F.count(e)).alias("unscorable"), F.count_if(F.coalesce(e >= 0, F.lit(False))).alias("covered"),
        F.round(F.coalesce(F.sum(F.abs(e)), F.lit(0.0)), 6).alias("abs_error"), (F.round(F.coalesce(F.sum(e), F.lit(0.0)), 6) + 0.0).alias("bias"),
    )


@query("a15_status_counts", f"WITH {SCORED} SELECT series_id, count(*) FILTER (WHERE predicted IS NULL) AS unavailable, count(*) FILTER (WHERE predicted IS NOT NULL AND actual IS NULL) AS unscorable, count(*) FILTER (WHERE predicted IS NOT NULL AND actual IS NOT NULL) AS scored FROM sc GROUP BY 1")
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("predicted").isNull(), "unavailable").when(F.col("actual").isNull(), "unscorable").otherwise("scored")
    return scored(spark, sf_dir).withColumn("status", status).groupBy("series_id").pivot("status", ["unavailable", "unscorable", "scored"]).count().fillna(0)


@query("a16_availability", f"WITH {SCORED} SELECT series_id, round(count(predicted - actual) / nullif(count(predicted), 0), 6) AS availability, round(count(predicted) / count(*), 6) AS issued_share FROM sc GROUP BY 1")
def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scored(spark, sf_dir).groupBy("series_id").agg(ratio(F.count(F.col("predicted") - F.col("actual")), F.count("predicted")).alias("availability"), ratio(F.count("predicted"), F.count("*")).alias("issued_share"))
    return rounded(d, "availability", "issued_share")


@query(
    "a17_intervals",
    f"""WITH {H}, d AS (SELECT series_id, t // 86400 AS day, sum(value) AS value FROM h GROUP BY 1, 2)
 SELECT series_id, count(value) AS n, round(avg(value), 6) AS mean, round(avg(value) - 2.045 * stddev_samp(value) / sqrt(count(value)), 6) AS low, round(avg(value) + 2.045 * stddev_samp(value) / sqrt(count(value)), 6) AS high FROM d GROUP BY 1""",
)
def a17(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = hourly(spark, sf_dir).groupBy("series_id", F.floor(F.col("t") / DAY).alias("day")).agg(F.sum("value").alias("value"))
    return rounded(agg.mean_interval(d, 2.045, "series_id"), "mean", "low", "high")


@query("a17_wilson", f"""WITH {SCORED}, c AS (SELECT series_id, count(*) FILTER (WHERE actual <= predicted)::DOUBLE AS k, nullif(count(predicted - actual)::DOUBLE, 0) AS n FROM sc GROUP BY 1)
 SELECT series_id, coalesce(round(greatest(0, (k / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 6), 0) AS low,
  coalesce(round(least(1, (k / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 6), 1) AS high FROM c""")
def a17w(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("predicted") - F.col("actual")
    c = scored(spark, sf_dir).groupBy("series_id").agg(F.count_if(F.coalesce(e >= 0, F.lit(False))).cast("double").alias("k"), F.count(e).cast("double").alias("n"))
    low, high = agg.wilson(F.col("k"), F.col("n"))
    return rounded(c.select("series_id", low.alias("low"), high.alias("high")), "low", "high")


@query("a18_distinct_counts", f"WITH {SCORED} SELECT series_id, count(DISTINCT target) AS targets, count(DISTINCT origin) AS origins FROM sc GROUP BY 1")
def a18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("series_id").agg(F.count_distinct("target").alias("targets"), F.count_distinct("origin").alias("origins"))


@query("a19_slope", f"WITH {H} SELECT series_id, round(regr_slope(value, (t - {START}) / 3600.0), 8) AS slope FROM h GROUP BY 1")
def a19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(spark, sf_dir).groupBy("series_id").agg(F.round(F.regr_slope("value", (F.col("t") - START) / 3600), 8).alias("slope"))


@query("j01_seasonal_lags", f"WITH {H}, d AS (SELECT unnest(range(1, 8)) AS lag) SELECT h.series_id, h.t, d.lag::INTEGER AS lag, y.value AS lagged FROM h, d JOIN h y ON true WHERE y.series_id = h.series_id AND y.t = h.t - d.lag * 86400")
def j01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.seasonal_lags(hourly(spark, sf_dir), DAY, 7)


@query(
    "j02_nearest",
    f"""WITH {E}, q AS (SELECT series_id, ord, t - 86400 AS want FROM e), x AS (SELECT q.*, e.t AS found, e.value AS v, row_number() OVER (PARTITION BY q.series_id, q.ord ORDER BY abs(e.t - want), e.t, e.value) AS r FROM q JOIN e ON e.series_id = q.series_id AND abs(e.t - want) <= 300)
 SELECT series_id, ord, want, found, round(v, 6) AS found_value FROM x WHERE r = 1""",
)
def j02(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return rounded(joins.nearest(e.select("series_id", "ord", (F.col("t") - DAY).alias("want")), e, 300), "found_value")


@query("j03_step_actual", f"WITH {SCORED} SELECT series_id, origin, step::INTEGER AS step, target, predicted, actual FROM sc")
def j03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir)


@query(
    "j04_as_of",
    f"""WITH {E}, s AS (SELECT series_id, t, arg_max(CASE WHEN ord % 11 = 0 THEN NULL ELSE value END, ord) FILTER (WHERE true) AS v0, max(ord) AS o FROM e GROUP BY 1, 2),
 z AS (SELECT s.series_id, s.t, CASE WHEN s.o % 11 = 0 THEN NULL ELSE e.value END AS v FROM s JOIN e ON e.ord = s.o), a AS (SELECT DISTINCT series_id, t // 1800 * 1800 + 1800 AS t FROM e)
 SELECT a.series_id, a.t, CASE WHEN a.t - z.t < 900 THEN z.t END AS sample_t, CASE WHEN a.t - z.t < 900 THEN round(z.v, 6) END AS value FROM a ASOF LEFT JOIN z ON z.series_id = a.series_id AND a.t >= z.t""",
)
def j04(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    last = e.groupBy("series_id", "t").agg(F.max(F.struct("ord", "value")).alias("m"))
    samples = last.select("series_id", "t", F.when(F.col("m.ord") % 11 != 0, F.col("m.value")).alias("value"))
    asked = e.select("series_id", (F.floor(F.col("t") / 1800) * 1800 + 1800).alias("t")).distinct()
    return rounded(joins.as_of(asked, samples, 900), "value")


@query(
    "j06_overlaps",
    f"""WITH {E}, l AS (SELECT series_id, ord AS l, t AS a, t + 240 AS b FROM e), r AS (SELECT series_id, ord AS r, t AS c, t + (ord % 4) * 600 AS d FROM e)
 SELECT l.series_id, l, a, b, r, c, d FROM l JOIN r ON r.series_id = l.series_id AND a <= d AND b >= c""",
)
def j06(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    left = e.select("series_id", F.col("ord").alias("l"), F.col("t").alias("a"), (F.col("t") + 240).alias("b"))
    right = e.select("series_id", F.col("ord").alias("r"), F.col("t").alias("c"), (F.col("t") + F.col("ord") % 4 * 600).alias("d"))
    return joins.overlaps(left, right, 3600)


@query("j10_unmatched", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "customer").join(read_table(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("j11_joint_instants", f"WITH {H} SELECT t, sum(value) AS total FROM h GROUP BY 1 HAVING count(DISTINCT series_id) = 5")
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.joint_instants(hourly(spark, sf_dir), 5)


@query(
    "j12_brackets",
    f"""WITH {H}, b(no, z) AS (VALUES (0, {START + 3 * DAY + 100}::BIGINT), (1, {START + 11 * DAY}::BIGINT))
 SELECT series_id, no, z AS "at", max(t) FILTER (WHERE t < z) AS before_t, arg_max(value, t) FILTER (WHERE t < z) AS before_value, min(t) FILTER (WHERE t >= z) AS after_t, arg_min(value, t) FILTER (WHERE t >= z) AS after_value FROM h, b GROUP BY 1, 2, 3""",
)
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.brackets(hourly(spark, sf_dir), [START + 3 * DAY + 100, START + 11 * DAY])


@query("j15_expected_cells", f"WITH {AHEAD} SELECT series_id, origin, step::INTEGER AS step, target FROM a WHERE target < {START + 20 * DAY}")
def j15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.steps_of(grid(spark, sf_dir), 6, HOUR, F.lit(START + 20 * DAY))


@query(
    "w01_trailing_margin",
    f"""WITH {G}, x AS (SELECT series_id, t, value AS actual, lag(value, 24) OVER (PARTITION BY series_id ORDER BY t) AS lead FROM g),
 m AS (SELECT *, count(actual - lead) OVER w AS n, quantile_cont(actual - lead, 0.9) OVER w AS q FROM x WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 143 PRECEDING AND 2 PRECEDING))
 SELECT series_id, t, actual, lead, CASE WHEN lead IS NULL THEN NULL WHEN n >= 30 THEN round(least(greatest(q, 0), greatest(0.8 * lead, 0)), 6) ELSE 0 END AS margin FROM m""",
)
def w01(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loadloom.operators.grid import by_series

    leads = grid(spark, sf_dir).select("series_id", "t", F.col("value").alias("actual"), F.lag("value", 24).over(by_series()).alias("lead"))
    return rounded(windows.trailing_margin(leads, 0.9, 143, 2, 30), "margin")


@query("w02_trailing_hours", f"WITH {H} SELECT series_id, t // 3600 AS hour, sum(value) OVER (PARTITION BY series_id ORDER BY t // 3600 RANGE BETWEEN 167 PRECEDING AND CURRENT ROW) AS value FROM h")
def w02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.trailing_hours(hourly(spark, sf_dir).select("series_id", F.floor(F.col("t") / HOUR).alias("hour"), "value"), 168, "value")


@query(
    "w03_misses",
    f"""WITH {H}, x AS (SELECT series_id, t AS seq, (value > 3)::INTEGER AS m FROM h), y AS (SELECT *, sum(1 - m) OVER (PARTITION BY series_id ORDER BY seq) AS block FROM x)
 SELECT series_id, seq, sum(m) OVER (PARTITION BY series_id ORDER BY seq ROWS 63 PRECEDING)::BIGINT AS missed, sum(m) OVER (PARTITION BY series_id, block ORDER BY seq)::BIGINT AS in_a_row FROM y""",
)
def w03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.misses(hourly(spark, sf_dir).select("series_id", F.col("t").alias("seq"), (F.col("value") <= 3).alias("covered")), 64)


@query("w04_onsets", f"WITH {H}, x AS (SELECT series_id, t, value > 4 AS r, lag(value > 4) OVER (PARTITION BY series_id ORDER BY t) AS was FROM h) SELECT series_id, t FROM x WHERE r AND NOT coalesce(was, false)")
def w04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.onsets(hourly(spark, sf_dir).select("series_id", "t", (F.col("value") > 4).alias("rule")))


@query(
    "w06_level_ratio",
    f"""WITH {G}, x AS (SELECT series_id, t, value, avg(value) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS own, avg(value) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 29 PRECEDING AND 24 PRECEDING) AS was FROM g)
 SELECT series_id, t, value, CASE WHEN was > 0 THEN round(least(greatest(own / was, 0.5), 2), 6) END AS ratio FROM x""",
)
def w06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.level_ratio(grid(spark, sf_dir), 24, 6), "ratio")


@query(
    "w09_changes_and_minutes",
    f"""WITH {H}, x AS (SELECT series_id, ceil(value / 3) AS v, lag(ceil(value / 3)) OVER w AS was, lead(t) OVER w - t AS dt FROM h WINDOW w AS (PARTITION BY series_id ORDER BY t))
 SELECT series_id, count(*) FILTER (WHERE was <> v) AS changes, round(sum(CASE WHEN dt <= 7200 THEN v * dt / 60 END), 6) AS minutes FROM x GROUP BY 1""",
)
def w09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.changes(hourly(spark, sf_dir).select("series_id", "t", F.ceil(F.col("value") / 3).alias("value"))), "minutes")


@query(
    "w10_counter_increments",
    f"""WITH {H}, c AS (SELECT series_id, t, sum(value) OVER (PARTITION BY series_id, t // 86400 ORDER BY t) AS value FROM h), x AS (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY t) AS was FROM c)
 SELECT series_id, t, value, CASE WHEN was IS NULL THEN NULL WHEN value < was THEN value ELSE value - was END AS grown, coalesce(value < was, false) AS reset FROM x""",
)
def w10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    day = Window.partitionBy("series_id", F.floor(F.col("t") / DAY)).orderBy("t")
    return windows.increments(hourly(spark, sf_dir).withColumn("value", F.sum("value").over(day)))


@query("w11_sequence_gaps", f"WITH {E}, x AS (SELECT series_id, ord AS seq, lead(ord) OVER (PARTITION BY series_id ORDER BY ord) AS n FROM e) SELECT series_id, seq + 1 AS first, n - 1 AS last FROM x WHERE n - seq > 1")
def w11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sequence_gaps(events(spark, sf_dir).select("series_id", F.col("ord").alias("seq")))


@query("w11_out_of_order", f"WITH {E}, x AS (SELECT series_id, user_id, max(user_id) OVER (PARTITION BY series_id, t // 86400 ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM e) SELECT series_id, count(*) AS late FROM x WHERE user_id < top GROUP BY 1")
def w11o(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = events(spark, sf_dir).select(F.concat_ws("/", "series_id", F.floor(F.col("t") / DAY)).alias("series_id"), F.col("user_id").alias("seq"), F.col("ord").alias("pos"))
    return windows.out_of_order(runs).groupBy(F.substring_index("series_id", "/", 1).alias("series_id")).agg(F.sum("late").alias("late"))


@query("w14_completed_days", f"WITH {H} SELECT series_id, t // 86400 AS day, count(*) AS hours, sum(value) AS requests FROM h WHERE (t // 86400 + 1) * 86400 + 720 <= {START + 20 * DAY} GROUP BY 1, 2")
def w14(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.floor(F.col("t") / DAY)
    return hourly(spark, sf_dir).where((day + 1) * DAY + 720 <= START + 20 * DAY).groupBy("series_id", day.alias("day")).agg(F.count("*").alias("hours"), F.sum("value").alias("requests"))


@query(
    "w05_resetting_balance",
    f"""WITH RECURSIVE {H}, r AS MATERIALIZED (SELECT series_id, t, value - 2 AS delta, row_number() OVER (PARTITION BY series_id ORDER BY t) AS n FROM h),
 b AS (SELECT series_id, n, t, CASE WHEN abs(delta) > 10 THEN 0.0::DOUBLE ELSE delta END AS balance, abs(delta) > 10 AS reset FROM r WHERE n = 1
  UNION ALL SELECT r.series_id, r.n, r.t, CASE WHEN abs(b.balance + r.delta) > 10 THEN 0.0::DOUBLE ELSE b.balance + r.delta END, abs(b.balance + r.delta) > 10 FROM b JOIN r ON r.series_id = b.series_id AND r.n = b.n + 1)
 SELECT series_id, t, balance, reset FROM b""",
)
def w05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.resetting_balance(hourly(spark, sf_dir).select("series_id", "t", (F.col("value") - 2.0).alias("delta")), 10.0)


@query("f01_persistence", f"WITH {AHEAD}, p AS (SELECT series_id, t, last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS v FROM g) SELECT a.series_id, origin, step::INTEGER AS step, target, p.v AS predicted FROM a JOIN p ON p.series_id = a.series_id AND p.t = a.origin")
def f01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecasts.persistence(grid(spark, sf_dir), 6, HOUR)


@query("f02_seasonal_naive", f"WITH {NAIVE} SELECT series_id, origin, step::INTEGER AS step, target, predicted FROM n")
def f02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naive(spark, sf_dir)


PROFILE = AHEAD + ", pf AS (SELECT a.series_id, a.origin, a.step, a.target, avg(y.value) AS p, count(y.value) AS k FROM a LEFT JOIN g y ON y.series_id = a.series_id AND y.value IS NOT NULL AND y.t IN (a.target - 86400, a.target - 172800, a.target - 259200, a.target - 345600, a.target - 432000, a.target - 518400, a.target - 604800) GROUP BY 1, 2, 3, 4)"


@query("f03_profile", f"WITH {PROFILE} SELECT series_id, origin, step::INTEGER AS step, target, CASE WHEN k >= 3 THEN round(p, 6) END AS predicted, CASE WHEN k >= 3 THEN k END AS support FROM pf")
def f03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(forecasts.profile_forecast(grid(spark, sf_dir), DAY, 7, 3, 6, HOUR), "predicted")


#: Ratios of small whole numbers make exact ties at the sixth place; they go up, in SQL too, whatever the last bit of a product is.
UP = 1e-9
TREND = AHEAD + """, r0 AS (SELECT series_id, t, sum(value) OVER x AS own, count(value) OVER x AS n, sum(value) OVER y AS was, count(value) OVER y AS m FROM g
  WINDOW x AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), y AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 29 PRECEDING AND 24 PRECEDING)),
 r AS (SELECT series_id, t, CASE WHEN was > 0 THEN least(greatest((own * m) / (was * n), 0.5), 2) END AS ratio FROM r0),
 tr AS (SELECT a.series_id, a.origin, a.step, a.target, y.value * (1 + (ratio - 1) * [0.9::DOUBLE, 0.81, 0.729, 0.6561, 0.59049, 0.531441][a.step]) AS predicted FROM a JOIN r ON r.series_id = a.series_id AND r.t = a.origin LEFT JOIN g y ON y.series_id = a.series_id AND y.t = a.target - 86400)"""


@query("f09_trend_adaptive", f"WITH {TREND} SELECT series_id, origin, step::INTEGER AS step, target, round(predicted + 1e-9, 6) AS predicted FROM tr")
def f09(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = forecasts.trend_adaptive(grid(spark, sf_dir), DAY, 6, HOUR)
    return rounded(found.withColumn("predicted", F.col("predicted") + UP), "predicted")


@query(
    "f13_member_median",
    f"""WITH {TREND}, n0 AS (SELECT a.*, g.value AS p FROM a LEFT JOIN g ON g.series_id = a.series_id AND g.t = a.target - 86400),
 n AS (SELECT series_id, origin, step, CASE WHEN count(p) OVER (PARTITION BY series_id, origin) = 6 THEN p END AS predicted FROM n0),
 ps AS (SELECT series_id, t, last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS v FROM g),
 u AS (SELECT series_id, origin, step, predicted FROM tr UNION ALL SELECT * FROM n UNION ALL SELECT a.series_id, origin, step, v FROM a JOIN ps ON ps.series_id = a.series_id AND ps.t = a.origin)
 SELECT series_id, origin, step::INTEGER AS step, count(predicted) AS members, CASE WHEN count(predicted) >= 2 THEN round(median(predicted) + 1e-9, 6) END AS median, CASE WHEN count(predicted) >= 2 THEN round(avg(predicted) + 1e-9, 6) END AS mean FROM u GROUP BY 1, 2, 3""",
)
def f13(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    members = [forecasts.trend_adaptive(g, DAY, 6, HOUR), forecasts.seasonal_naive(g, DAY, 6, HOUR), forecasts.persistence(g, 6, HOUR)]
    rows = [m.select("series_id", "origin", "step", "predicted") for m in members]
    found = forecasts.member_median(rows[0].unionByName(rows[1]).unionByName(rows[2]))
    return rounded(found.withColumns({c: F.col(c) + UP for c in ("median", "mean")}), "median", "mean")


@query(
    "f14_blend",
    f"""WITH {PROFILE}, ps AS (SELECT series_id, t, last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS v FROM g)
 SELECT pf.series_id, origin, step::INTEGER AS step, round(coalesce(least(0.95, 0.7 + step / 6 * 0.25) * CASE WHEN k >= 3 THEN p END + (1 - least(0.95, 0.7 + step / 6 * 0.25)) * v, CASE WHEN k >= 3 THEN p END, v), 6) AS predicted
 FROM pf JOIN ps ON ps.series_id = pf.series_id AND ps.t = pf.origin""",
)
def f14(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    return rounded(forecasts.blend(forecasts.profile_forecast(g, DAY, 7, 3, 6, HOUR), forecasts.persistence(g, 6, HOUR)), "predicted")


@query(
    "f05_ar_fit",
    f"""WITH {G}, r AS (SELECT series_id, t, value - lag(value, 24) OVER (PARTITION BY series_id ORDER BY t) AS r FROM g), x AS (SELECT *, lag(r) OVER (PARTITION BY series_id ORDER BY t) AS x1 FROM r),
 s AS (SELECT *, coalesce(count(r * x1) OVER w, 0) AS n, coalesce(sum(CASE WHEN x1 IS NOT NULL THEN r END) OVER w, 0) AS b0, coalesce(sum(r * x1) OVER w, 0) AS b1, coalesce(sum(CASE WHEN r IS NOT NULL THEN x1 END) OVER w, 0) AS a01, coalesce(sum(CASE WHEN r IS NOT NULL THEN x1 * x1 END) OVER w, 0) AS a11
  FROM x WINDOW w AS (PARTITION BY series_id ORDER BY t RANGE BETWEEN 604800 PRECEDING AND CURRENT ROW)),
 f AS (SELECT *, CASE WHEN n >= 36 AND abs(n * a11 - a01 * a01) > 1e-9 THEN (n * b1 - a01 * b0) / (n * a11 - a01 * a01) END AS phi FROM s)
 SELECT series_id, t, r, n, CASE WHEN abs(phi) < 0.999 THEN round(phi, 6) END AS phi, CASE WHEN abs(phi) < 0.999 THEN round((b0 - phi * a01) / n, 6) END AS c FROM f""",
)
def f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loadloom.operators.grid import by_series

    residuals = grid(spark, sf_dir).select("series_id", "t", (F.col("value") - F.lag("value", 24).over(by_series())).alias("r"))
    return rounded(forecasts.ar_fit(residuals, 7 * DAY, 36), "phi", "c")


@query(
    "f11_smoothing_grid",
    f"""WITH RECURSIVE {H}, r AS MATERIALIZED (SELECT series_id, value AS v, row_number() OVER (PARTITION BY series_id ORDER BY t) AS n FROM h), z AS MATERIALIZED (SELECT series_id, max(n) AS n FROM r GROUP BY 1),
 f AS (SELECT series_id, n, k / 20.0::DOUBLE AS alpha, v AS level, 0.0::DOUBLE AS sse FROM r, range(1, 20) x(k) WHERE n = 1
  UNION ALL SELECT r.series_id, r.n, alpha, level + alpha * (v - level), sse + (v - level) * (v - level) FROM f JOIN r ON r.series_id = f.series_id AND r.n = f.n + 1),
 o AS (SELECT f.*, row_number() OVER (PARTITION BY f.series_id ORDER BY sse, alpha) AS k FROM f JOIN z ON z.series_id = f.series_id AND z.n = f.n)
 SELECT series_id, alpha, round(sse, 6) AS sse, round(level, 6) AS level FROM o WHERE k = 1""",
)
def f11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(forecasts.smoothing_grid(grid(spark, sf_dir), [k / 20 for k in range(1, 20)]), "sse", "level")


def _profile_ar_sql(left: str, fit: str, good: str, back: str) -> str:
    """The same fit and recursion in SQL: ``left`` the residual of value and p, ``fit`` what the fit sees of it, ``good`` when the fit
    counts, ``back`` the forecast from profile p and residual f."""
    sums = ", ".join(f"sum(CASE WHEN ok THEN x{i} * x{j} END) OVER w AS m0_{i}{j}" for i in range(4) for j in range(i, 4))
    sums += ", " + ", ".join(f"sum(CASE WHEN ok THEN x{i} * r END) OVER w AS m0_{i}4" for i in range(4))
    steps, last = [], "s0"
    mirrored = ", ".join(f"m0_{j}{i} AS m0_{i}{j}" for i in range(4) for j in range(i))
    steps.append(f"e0 AS (SELECT *, {mirrored} FROM {last})")
    for p in range(3):
        told = ", ".join(f"m{p}_{i}{j} - m{p}_{i}{p} / nullif(m{p}_{p}{p}, 0) * m{p}_{p}{j} AS m{p + 1}_{i}{j}" for i in range(p + 1, 4) for j in range(p + 1, 5))
        steps.append(f"e{p + 1} AS (SELECT *, {told} FROM e{p})")
    last = "e3"
    for i in (3, 2, 1, 0):
        rest = f"m{i}_{i}4" + "".join(f" - m{i}_{i}{j} * c{j}" for j in range(i + 1, 4))
        steps.append(f"k{i} AS (SELECT *, CASE WHEN {good} AND m{i}_{i}{i} > 1e-9 THEN ({rest}) / m{i}_{i}{i} END AS c{i} FROM {last})")
        last = f"k{i}"
    roots = "(SELECT *, -c1 / 0.999 AS j1, -c2 / (0.999 * 0.999) AS j2, -c3 / (0.999 * 0.999 * 0.999) AS j3 FROM k0)"
    steps.append(f"j AS {roots}")
    made = ["h3", "h2", "h1"]
    for f in range(1, 7):
        steps.append(f"f{f} AS (SELECT *, d0 + c1 * {made[-1]} + c2 * {made[-2]} + c3 * {made[-3]} AS y{f} FROM {'u' if f == 1 else f'f{f - 1}'})")
        made.append(f"y{f}")
    stable = "abs(j3) < 1 AND 1 + j1 + j2 + j3 > 0 AND 1 - j1 + j2 - j3 > 0 AND abs(j2 - j1 * j3) < 1 - j3 * j3" if "span" in good else "true"
    where = next(k for k, step in enumerate(steps) if step.startswith("f1 "))
    steps.insert(where, f"u AS (SELECT series_id, t, CASE WHEN {stable} THEN c0 END AS d0, c1, c2, c3, q AS h1, lag(q, 1) OVER v AS h2, lag(q, 2) OVER v AS h3 FROM j WINDOW v AS (PARTITION BY series_id ORDER BY t))")
    return f"""WITH {G}, pr AS (SELECT series_id, t + d * 86400 AS t, avg(value) AS p FROM g, (SELECT unnest(range(1, 8)) AS d) WHERE value IS NOT NULL GROUP BY 1, 2),
 a0 AS (SELECT g.series_id, g.t, {left} AS q FROM g LEFT JOIN pr ON pr.series_id = g.series_id AND pr.t = g.t), a1 AS (SELECT *, {fit} AS r FROM a0),
 a2 AS (SELECT *, 1.0::DOUBLE AS x0, lag(r, 1) OVER v AS x1, lag(r, 2) OVER v AS x2, lag(r, 3) OVER v AS x3 FROM a1 WINDOW v AS (PARTITION BY series_id ORDER BY t)), a3 AS (SELECT *, r IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL AS ok FROM a2),
 s0 AS (SELECT series_id, t, q, count(*) FILTER (WHERE ok) OVER w AS n, max(CASE WHEN ok THEN t END) OVER w - min(CASE WHEN ok THEN t END) OVER w AS span, {sums} FROM a3 WINDOW w AS (PARTITION BY series_id ORDER BY t RANGE BETWEEN {7 * DAY - 4 * HOUR} PRECEDING AND CURRENT ROW)),
 {", ".join(steps)}, o AS (SELECT series_id, t AS origin, unnest(range(1, 7)) AS step, unnest([y1, y2, y3, y4, y5, y6]) AS f FROM f6)
 SELECT o.series_id, origin, step::INTEGER AS step, origin + step * 3600 AS target, round(CASE WHEN f IS NOT NULL AND p IS NOT NULL THEN greatest(0, {back}) END, 4) AS predicted FROM o LEFT JOIN pr ON pr.series_id = o.series_id AND pr.t = origin + step * 3600"""


@query("f05_profile_ar", _profile_ar_sql("value - p", "q", "n >= 36 AND span >= 21600", "p + f"))
def f05f(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also held against least squares in the tests."""
    return rounded(forecasts.profile_ar(grid(spark, sf_dir), DAY, 6, HOUR, 7 * DAY, 36, 6 * HOUR), "predicted", places=4)


@query("f06_relative_profile_ar", _profile_ar_sql("CASE WHEN p > 0 THEN value / p - 1 END", "CASE WHEN q IS NOT NULL THEN least(greatest(q, -0.5), 0.5) END", "n >= 36", "p * (1 + f)"))
def f06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also held against least squares in the tests."""
    return rounded(forecasts.profile_ar(grid(spark, sf_dir), DAY, 6, HOUR, 7 * DAY, 36, 0, relative=True), "predicted", places=4)
