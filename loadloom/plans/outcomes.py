"""Queries on maturation, calibration, scoring statistics, capacity, evidence and training tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loadloom.functions.scalars import capped_prediction, headroom_replicas, lead_seconds
from loadloom.operators import forecasts, outcomes as ops
from loadloom.plans.registry import DAY, E, G, H, HOUR, START, events, grid, hourly, query, rounded
from loadloom.plans.scoring import AHEAD, NAIVE, naive
from loadloom.session import read_table

NOW = START + 25 * DAY
#: Receipts: an hour's count is known 120 s after it ends, and up to 900 s later for some hours.
RECEIPTS = ", rc AS (SELECT series_id, t, value, t + 120 + t // 3600 % 4 * 300 AS received FROM h)"


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(spark, sf_dir).withColumn("received", F.col("t") + 120 + F.floor(F.col("t") / HOUR) % 4 * 300)


def issued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One window of six targets every six hours, bounded by its highest naive step."""
    n = naive(spark, sf_dir).where(F.col("origin") % (6 * HOUR) == 0)
    return n.groupBy("series_id", "origin").agg(F.collect_list("target").alias("targets"), F.max("predicted").alias("bound"))


ISSUED = NAIVE + RECEIPTS + ", iss AS (SELECT series_id, origin, max(predicted) AS bound, max(target) AS e FROM n WHERE origin % 21600 = 0 GROUP BY 1, 2)"
OUTCOMES = ISSUED + f""", k AS (SELECT i.series_id, i.origin, i.bound, i.e, count(*) FILTER (WHERE rc.received <= i.e + 720) AS got, max(rc.value) FILTER (WHERE rc.received <= i.e + 720) AS hi
  FROM iss i LEFT JOIN rc ON rc.series_id = i.series_id AND rc.t > i.origin AND rc.t <= i.e GROUP BY 1, 2, 3, 4),
 ks AS (SELECT *, CASE WHEN {NOW} < e + 120 THEN 'pending' WHEN got = 6 THEN 'scored' WHEN {NOW} < e + 720 THEN 'pending' ELSE 'unscorable' END AS status FROM k),
 oc AS (SELECT series_id, origin, e AS "end", status, CASE WHEN status = 'scored' THEN hi END AS highest, CASE WHEN status = 'scored' THEN hi <= bound END AS covered, CASE WHEN status = 'scored' THEN hi - bound END AS residual FROM ks)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.window_outcomes(issued(spark, sf_dir), receipts(spark, sf_dir), NOW, 120, 600)


@query("k01_window_outcomes", f'WITH {OUTCOMES} SELECT series_id, origin, "end", status, highest, covered, residual FROM oc')
def k01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir)


@query(
    "k02_queue_status",
    f"""WITH {E}, q AS (SELECT series_id, ord AS key, t + 3600 AS target FROM e), x AS (SELECT q.*, (SELECT min(t) FROM e WHERE e.series_id = q.series_id AND e.t >= q.target) AS seen FROM q)
 SELECT series_id, key, CASE WHEN seen IS NULL THEN 'early' WHEN seen - target <= 300 THEN 'matched' ELSE 'dropped' END AS status FROM x""",
)
def k02(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return ops.queue_status(e.select("series_id", F.col("ord").alias("key"), (F.col("t") + HOUR).alias("target")), e.select("series_id", "t"), 300)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir).select("series_id", "t", F.col("value").alias("base"), F.lit(1.5).alias("sigma"), ((F.col("value") - F.lag("value", 24).over(Window.partitionBy("series_id").orderBy("t"))) / 1.5).alias("score"))


@query(
    "k05_upper_bounds",
    f"""WITH {G}, s AS (SELECT series_id, t, value AS base, (value - lag(value, 24) OVER (PARTITION BY series_id ORDER BY t)) / 1.5 AS score FROM g),
 l AS (SELECT *, list(score) FILTER (WHERE score IS NOT NULL) OVER (PARTITION BY series_id ORDER BY t RANGE BETWEEN 259200 PRECEDING AND 1 PRECEDING) AS a FROM s),
 o AS (SELECT *, list_sort(list_reverse(list_reverse(coalesce(a, []))[1:64])) AS b FROM l), k AS (SELECT *, len(b) AS n, ceil((len(b) + 1) * 0.9 - 1e-9)::INTEGER AS k FROM o)
 SELECT series_id, t, n::INTEGER AS n, k, CASE WHEN n < 32 THEN 'too_few' WHEN k > n THEN 'beyond' ELSE 'ok' END AS reason, CASE WHEN n >= 32 AND k <= n THEN round(greatest(0, base + b[k] * 1.5), 6) END AS bound FROM k""",
)
def k05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.upper_bounds(scores(spark, sf_dir), 0.1, 3 * DAY, 64, 32), "bound")


@query(
    "k06_adaptive_level",
    f"""WITH RECURSIVE {OUTCOMES}, x AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY origin) AS i, NOT covered AS missed FROM oc WHERE covered IS NOT NULL),
 r AS (SELECT DISTINCT series_id, 0::BIGINT AS i, 10000000::BIGINT AS a FROM x UNION ALL
  SELECT r.series_id, x.i, greatest(0, least(100000000, r.a + floor(500000::BIGINT * (10000000 - CASE WHEN x.missed THEN 100000000 ELSE 0 END)::BIGINT / 100000000.0)))::BIGINT FROM r JOIN x ON x.series_id = r.series_id AND x.i = r.i + 1)
 SELECT series_id, arg_max(a, i) AS level, max(i) AS outcomes FROM r GROUP BY 1""",
)
def k06(spark: SparkSession, sf_dir: str) -> DataFrame:
    missed = judged(spark, sf_dir).where("covered is not null").select("series_id", F.col("origin").alias("seq"), (~F.col("covered")).alias("missed"))
    return ops.adaptive_level(missed, 10_000_000, 500_000)


TWO = NAIVE + """, p AS (SELECT series_id, t, last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS v FROM g),
 two AS (SELECT n.series_id, n.origin // 86400 AS day, n.predicted AS one, p.v AS other, g.value AS actual FROM n JOIN p ON p.series_id = n.series_id AND p.t = n.origin JOIN g ON g.series_id = n.series_id AND g.t = n.target),
 pd AS (SELECT series_id, day, count(*) AS cells, sum(abs(one - actual)) AS one, sum(abs(other - actual)) AS other FROM two WHERE one IS NOT NULL AND other IS NOT NULL AND actual IS NOT NULL GROUP BY 1, 2)"""


def day_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    one = forecasts.seasonal_naive(g, DAY, 6, HOUR).withColumnRenamed("predicted", "one")
    other = forecasts.persistence(g, 6, HOUR).select("series_id", "origin", "step", F.col("predicted").alias("other"))
    actual = g.select("series_id", F.col("t").alias("target"), F.col("value").alias("actual"))
    return ops.paired_days(one.join(other, ["series_id", "origin", "step"]).join(actual, ["series_id", "target"]).withColumn("day", F.floor(F.col("origin") / DAY)), "one", "other")


@query("j09_paired_days", f"WITH {TWO} SELECT series_id, day, cells, round(one, 6) AS one, round(other, 6) AS other FROM pd")
def j09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(day_sums(spark, sf_dir), "one", "other")


@query(
    "l03_day_bootstrap",
    f"""WITH {TWO}, pl AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM pd),
 q0 AS (SELECT series_id, n, d.draw, ((d.draw * 668265263 + i * 374761393 + 7::BIGINT * 974711) % 4294967296)::BIGINT AS x FROM pl, (SELECT unnest(range(0, 500)) AS draw) d),
 q1 AS (SELECT *, (xor(x, x >> 15) * 40503) % 4294967296 AS y FROM q0), q2 AS (SELECT *, (xor(y, y >> 13) * 60493) % 4294967296 AS z FROM q1),
 q AS (SELECT series_id, draw, (xor(z, z >> 16) & 4294967295) % n AS i FROM q2),
 s AS (SELECT q.series_id, q.draw, (sum(other) - sum(one)) / nullif(sum(other), 0) AS gain FROM q JOIN pl ON pl.series_id = q.series_id AND pl.i = q.i GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY gain, draw) - 1 AS r, count(*) OVER (PARTITION BY series_id) AS m FROM s WHERE gain IS NOT NULL),
 b AS (SELECT series_id, count(*) AS draws, max(CASE WHEN r = floor(m * 0.025) THEN gain END) AS low, max(CASE WHEN r = floor(m * 0.975) THEN gain END) AS high FROM r GROUP BY 1),
 pt AS (SELECT series_id, (sum(other) - sum(one)) / nullif(sum(other), 0) AS gain FROM pd GROUP BY 1)
 SELECT pt.series_id, round(pt.gain, 6) AS gain, draws, round(low, 6) AS low, round(high, 6) AS high FROM pt JOIN b ON b.series_id = pt.series_id""",
)
def l03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.day_bootstrap(day_sums(spark, sf_dir), 500, 7), "gain", "low", "high")


@query(
    "l05_holm",
    f"""WITH {H}, t AS (SELECT series_id AS family, t // 86400 AS name, least(1.0, (1.0 + sum(value)) / 2000) AS p FROM h GROUP BY 1, 2),
 x AS (SELECT *, p * (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, name) + 1) AS x FROM t),
 a AS (SELECT *, least(1.0, max(x) OVER (PARTITION BY family ORDER BY p, name ROWS UNBOUNDED PRECEDING)) AS a FROM x)
 SELECT family, name, round(p, 9) AS p, round(a, 9) AS adjusted, a <= 0.9 AS rejected FROM a""",
)
def l05(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = hourly(spark, sf_dir).groupBy(F.col("series_id").alias("family"), F.floor(F.col("t") / DAY).alias("name")).agg(F.least(F.lit(1.0), (1.0 + F.sum("value")) / 2000).alias("p"))
    return rounded(ops.holm(t, 0.9), "p", "adjusted", places=9)


SAMPLES = H + ", sm AS (SELECT series_id, t, value * 400 AS rpm, ceil(coalesce(lag(value) OVER (PARTITION BY series_id ORDER BY t), 1) * 400 / 600)::INTEGER AS ready FROM h), sh AS (SELECT *, greatest(1, ceil(rpm / 600 - 1e-9)::INTEGER) AS need FROM sm)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demand, and replicas that follow the sample before."""
    before = F.coalesce(F.lag("value").over(Window.partitionBy("series_id").orderBy("t")), F.lit(1.0))
    return hourly(spark, sf_dir).select("series_id", "t", (F.col("value") * 400).alias("rpm"), F.ceil(before * 400 / 600).cast("int").alias("ready"))


@query("r01_shortage", f"WITH {SAMPLES} SELECT series_id, t, rpm, ready, need, greatest(need - ready, 0) * 60.0::DOUBLE AS short, greatest(ready - need, 0) * 60.0::DOUBLE AS \"over\" FROM sh")
def r01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.shortage(samples(spark, sf_dir), HOUR)


@query("r02_arm_days", f"WITH {SAMPLES} SELECT series_id, t // 86400 AS day, count(*) AS samples, count(*) / 24 >= 0.9 AS complete, sum(greatest(need - ready, 0) * 60.0::DOUBLE) AS short, sum(greatest(ready - need, 0) * 60.0::DOUBLE) AS \"over\" FROM sh GROUP BY 1, 2")
def r02(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ops.shortage(samples(spark, sf_dir), HOUR)
    return s.groupBy("series_id", F.floor(F.col("t") / DAY).alias("day")).agg(F.count("*").alias("samples"), (F.count("*") / 24 >= 0.9).alias("complete"), F.sum("short").alias("short"), F.sum("over").alias("over"))


@query(
    "r05_shortage_events",
    f"""WITH {SAMPLES}, x AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) - row_number() OVER (PARTITION BY series_id, need > ready ORDER BY t) AS k FROM sh)
 SELECT series_id, min(t) AS "start", max(t) AS "end", max(need - ready) AS deficit, count(*) AS samples, min(t) = {START} AS left_cut, max(t) = {START + 30 * DAY - HOUR} AS right_cut FROM x WHERE need > ready GROUP BY series_id, k""",
)
def r05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.shortage_events(ops.shortage(samples(spark, sf_dir), HOUR), START, START + 30 * DAY - HOUR)


@query(
    "r07_minute_objectives",
    f"""WITH {E}, m AS (SELECT series_id, t // 3600 * 3600 AS t, count(*) AS requests, count(*) FILTER (WHERE ord % 50 = 0) AS failed, CASE WHEN count(*) >= 2 THEN quantile_cont(value, 0.95) END AS p95, CASE WHEN count(*) >= 2 THEN quantile_cont(value, 0.99) END AS p99 FROM e GROUP BY 1, 2)
 SELECT series_id, t, requests, failed, round(p95, 6) AS p95, round(p99, 6) AS p99, CASE WHEN p95 IS NULL THEN 'unknown' WHEN p95 > 300 OR p99 > 400 OR failed / requests > 0.001 THEN 'violated' ELSE 'kept' END AS state FROM m""",
)
def r07(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda q: F.when(F.count("*") >= 2, F.percentile("value", F.lit(q)))
    m = events(spark, sf_dir).groupBy("series_id", (F.floor(F.col("t") / HOUR) * HOUR).alias("t")).agg(F.count("*").alias("requests"), F.count_if(F.col("ord") % 50 == 0).alias("failed"), p(0.95).alias("p95"), p(0.99).alias("p99"))
    return rounded(ops.minute_objectives(m, 300.0, 400.0, 0.001), "p95", "p99")


@query(
    "r09_replica_time",
    f"""WITH {G}, x AS (SELECT series_id, t, ceil(value / 2) AS v, coalesce(lead(t) OVER (PARTITION BY series_id ORDER BY t), {START + 30 * DAY}) - t AS w FROM g)
 SELECT series_id, round(sum(CASE WHEN v IS NOT NULL THEN v * w END) / 60, 6) AS minutes, coalesce(sum(CASE WHEN v IS NULL THEN w END), 0)::BIGINT AS unknown_seconds FROM x GROUP BY 1""",
)
def r09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.piecewise_integral(grid(spark, sf_dir).select("series_id", "t", F.ceil(F.col("value") / 2).alias("value")), START + 30 * DAY), "minutes")


@query(
    "r10_startup_percentile",
    """WITH s AS (SELECT o_orderpriority AS owner, date_diff('second', o_orderdate, l_shipdate) AS v FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1),
 r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY v) AS r, count(*) OVER (PARTITION BY owner) AS n FROM s WHERE v > 0) SELECT owner, n AS samples, v AS p90 FROM r WHERE r = ceil(n * 0.9) AND n >= 20""",
)
def r10(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, l = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "lineitem").where("l_linenumber = 1")  # noqa: E741
    s = o.join(l, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderpriority").alias("owner"), F.timestamp_diff("SECOND", "o_orderdate", "l_shipdate").alias("v")).where("v > 0")
    w = Window.partitionBy("owner")
    return s.withColumns({"r": F.row_number().over(w.orderBy("v")), "samples": F.count("*").over(w)}).where((F.col("r") == F.ceil(F.col("samples") * F.lit(0.9))) & (F.col("samples") >= 20)).select("owner", "samples", F.col("v").alias("p90"))


@query(
    "v01_increment_bounds",
    f"""WITH {H}, c AS (SELECT series_id, t, sum(value) OVER (PARTITION BY series_id ORDER BY t) AS v FROM h), b(i, a, z) AS (VALUES (0, {START + DAY + 1800}::BIGINT, {START + DAY + 9000}::BIGINT), (1, {START + 5 * DAY + 1800}::BIGINT, {START + 5 * DAY + 9000}::BIGINT)),
 x AS (SELECT series_id, i, max(v) FILTER (WHERE t <= a) AS a0, min(v) FILTER (WHERE t >= a) AS a1, max(v) FILTER (WHERE t <= z) AS z0, min(v) FILTER (WHERE t >= z) AS z1 FROM c, b GROUP BY 1, 2)
 SELECT series_id, i, greatest(z0 - a1, 0) AS least, z1 - a0 AS most FROM x""",
)
def v01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds on what a counter grew by between two times that lie between samples."""
    c = hourly(spark, sf_dir).select("series_id", "t", F.sum("value").over(Window.partitionBy("series_id").orderBy("t")).alias("v"))
    spans = F.posexplode(F.array(*[F.struct(F.lit(START + d * DAY + 1800).alias("a"), F.lit(START + d * DAY + 9000).alias("z")) for d in (1, 5)])).alias("i", "s")
    x = c.select("*", spans)
    hi, lo = lambda e: F.max(F.when(F.col("t") <= F.col(e), F.col("v"))), lambda e: F.min(F.when(F.col("t") >= F.col(e), F.col("v")))
    ends = x.groupBy("series_id", "i").agg(hi("s.a").alias("a0"), lo("s.a").alias("a1"), hi("s.z").alias("z0"), lo("s.z").alias("z1"))
    return ends.select("series_id", "i", F.greatest(F.col("z0") - F.col("a1"), F.lit(0.0)).alias("least"), (F.col("z1") - F.col("a0")).alias("most"))


@query("v03_load_gate", f"WITH {H}, d AS (SELECT series_id, t // 86400 AS day, sum(value) AS n FROM h GROUP BY 1, 2) SELECT series_id, day, n, CASE WHEN n < 10 THEN 'INCOMPLETE' WHEN abs(n - 66) / 66 <= 0.05 THEN 'PASS' ELSE 'FAIL' END AS gate FROM d")
def v03(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = hourly(spark, sf_dir).groupBy("series_id", F.floor(F.col("t") / DAY).alias("day")).agg(F.sum("value").alias("n"))
    return d.withColumn("gate", F.when(F.col("n") < 10, "INCOMPLETE").when(F.abs(F.col("n") - 66) / 66 <= 0.05, "PASS").otherwise("FAIL"))


@query(
    "v07_counter_resets",
    f"""WITH {H}, c AS (SELECT series_id, t, sum(value) OVER (PARTITION BY series_id, t // 172800 ORDER BY t) AS v FROM h), x AS (SELECT *, lag(v) OVER w AS was, lag(t) OVER w AS t0 FROM c WINDOW w AS (PARTITION BY series_id ORDER BY t))
 SELECT series_id, count(*) FILTER (WHERE v < was) AS restarts, count(*) FILTER (WHERE t - t0 > 7200) AS silent, max(t - t0) AS longest FROM x GROUP BY 1""",
)
def v07(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = hourly(spark, sf_dir).withColumn("v", F.sum("value").over(Window.partitionBy("series_id", F.floor(F.col("t") / (2 * DAY))).orderBy("t")))
    w = Window.partitionBy("series_id").orderBy("t")
    x = c.withColumns({"was": F.lag("v").over(w), "apart": F.col("t") - F.lag("t").over(w)})
    return x.groupBy("series_id").agg(F.count_if(F.coalesce(F.col("v") < F.col("was"), F.lit(False))).alias("restarts"), F.count_if(F.coalesce(F.col("apart") > 7200, F.lit(False))).alias("silent"), F.max("apart").alias("longest"))


@query(
    "v10_trace_to_demand",
    f"""WITH {H}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY value, t) AS r, count(*) OVER (PARTITION BY series_id) AS n FROM h), p AS (SELECT series_id, max(CASE WHEN r = ceil(n * 0.995) THEN value END) AS peak FROM r GROUP BY 1)
 SELECT h.series_id, h.t, h.value, p.peak, round(least(9 * value / peak, 10), 6) AS share, round_even(60 * 2.5 * least(9 * value / peak, 10), 0)::BIGINT AS intended, 9 * value / peak > 10 AS clipped FROM h JOIN p ON p.series_id = h.series_id""",
)
def v10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.demand_from_trace(hourly(spark, sf_dir), 10.0, 2.5), "share")


ATTEMPTS = "att AS (SELECT o_orderdate AS hour, o_orderkey AS attempt, l_linenumber AS arm, (l_linestatus = 'F')::INTEGER AS final FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey)"


@query(
    "v17_final_attempts",
    f"""WITH {ATTEMPTS}, w AS (SELECT hour, attempt, count(*) AS n, count(DISTINCT arm) AS a, min(final) AS lo, max(final) AS hi FROM att GROUP BY 1, 2),
 f AS (SELECT hour, count(*) FILTER (WHERE n = 4 AND a = 4 AND lo = hi AND hi = 1) AS k, min(CASE WHEN n = 4 AND a = 4 AND lo = hi AND hi = 1 THEN attempt END) AS x FROM w GROUP BY 1)
 SELECT hour, CASE WHEN k = 1 THEN 'final' WHEN k > 1 THEN 'conflict' ELSE 'unfinalized' END AS status, CASE WHEN k = 1 THEN x END AS attempt FROM f""",
)
def v17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's date is an hour, the order an attempt at it, its lines the arms, final where they are."""
    o, l = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "lineitem")
    attempts = o.select(F.col("o_orderdate").alias("hour"), F.col("o_orderkey").alias("attempt"))
    lines = l.select(F.col("l_orderkey").alias("attempt"), F.col("l_linenumber").alias("arm"), (F.col("l_linestatus") == "F").cast("int").alias("final"))
    return ops.final_attempts(attempts, lines, 4)


@query("d01_sliding_examples", f"""WITH {G}, x AS (SELECT series_id, t, list(value) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS x, list(value) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS y FROM g)
 SELECT series_id, t, array_to_string(list_transform(list_filter(x, lambda v: v IS NOT NULL), lambda v: v::INTEGER), ',') AS x, array_to_string(list_transform(list_filter(y, lambda v: v IS NOT NULL), lambda v: v::INTEGER), ',') AS y FROM x WHERE len(list_filter(x, lambda v: v IS NOT NULL)) = 12 AND len(list_filter(y, lambda v: v IS NOT NULL)) = 6""")
def d01(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = lambda c: F.array_join(F.transform(c, lambda v: v.cast("int").cast("string")), ",")
    return ops.sliding_examples(grid(spark, sf_dir), 12, 6).select("series_id", "t", told("x").alias("x"), told("y").alias("y"))


@query("d02_purged_split", f"WITH {H} SELECT series_id, count(*) FILTER (WHERE t + 21600 <= {START + 20 * DAY}) AS train, count(*) FILTER (WHERE t >= {START + 20 * DAY}) AS valid, count(*) FILTER (WHERE t + 21600 > {START + 20 * DAY} AND t < {START + 20 * DAY}) AS purged FROM h GROUP BY 1")
def d02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.purged_split(hourly(spark, sf_dir), START + 20 * DAY, 6 * HOUR).groupBy("series_id").pivot("part", ["train", "valid", "purged"]).count().fillna(0)


@query("d03_robust_scaling", f"WITH {H}, f AS (SELECT series_id, median(value) AS m, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS q FROM h WHERE t < {START + 20 * DAY} GROUP BY 1) SELECT h.series_id, h.t, round(CASE WHEN q > 0 THEN (value - m) / q ELSE value - m END, 6) AS scaled FROM h JOIN f ON f.series_id = h.series_id")
def d03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.robust_scaled(hourly(spark, sf_dir), START + 20 * DAY), "scaled")


@query("p01_replica_conversion", f"WITH {H}, x AS (SELECT series_id, t, ceil(value / 2)::INTEGER AS reactive, ceil(value * 1.7)::INTEGER AS predicted FROM h) SELECT series_id, t, reactive, least(predicted, reactive + least(2, ceil(reactive * 50 / 100)::INTEGER)) AS capped FROM x")
def p01(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = hourly(spark, sf_dir).select("series_id", "t", F.ceil(F.col("value") / 2).cast("int").alias("reactive"), F.ceil(F.col("value") * 1.7).cast("int").alias("predicted"))
    return x.select("series_id", "t", "reactive", capped_prediction(F.col("predicted"), F.col("reactive"), 2, 50).alias("capped"))


@query("p01_headroom", f"WITH {H} SELECT series_id, t, ceil(value * 400 / (600 * (1 - 15 / 100)))::INTEGER AS replicas FROM h")
def p01h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(spark, sf_dir).select("series_id", "t", headroom_replicas(F.col("value") * 400, 600, 15).alias("replicas"))


@query("p02_lead_peak", f"WITH {AHEAD}, x AS (SELECT a.series_id, a.origin, a.step, g.value AS v FROM a LEFT JOIN g ON g.series_id = a.series_id AND g.t = a.target) SELECT series_id, origin, coalesce(max(v) FILTER (WHERE step <= 2), arg_min(v, step)) AS peak FROM x GROUP BY 1, 2")
def p02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highest step within the lead, else the first step that has a value."""
    g = grid(spark, sf_dir)
    x = forecasts.ahead(g, 6, HOUR).join(g.select("series_id", F.col("t").alias("target"), "value"), ["series_id", "target"], "left")
    return x.groupBy("series_id", "origin").agg(F.coalesce(F.max(F.when(F.col("step") <= 2, F.col("value"))), F.min_by("value", F.when(F.col("value").isNotNull(), F.col("step")))).alias("peak"))


@query("p03_lead_selection", "SELECT o_orderkey, greatest(ceil((o_orderkey % 300 + 30 + 15 + 60) / 60), ceil(o_custkey % 500 / 60))::BIGINT * 60 AS lead FROM orders")
def p03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").select("o_orderkey", lead_seconds(F.col("o_orderkey") % 300, 30, 15, 60, F.col("o_custkey") % 500).alias("lead"))
