"""Queries on load evidence, ledgers and minute records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loadloom.operators.grid import by_series
from loadloom.plans.registry import DAY, E, H, HOUR, START, events, hourly, query, rounded
from loadloom.session import read_table


@query(
    "v02_snapshot_bounds",
    f"""WITH {H}, c AS (SELECT series_id, t, t // 86400 AS day, sum(value) OVER (PARTITION BY series_id, t // 86400 ORDER BY t) AS v FROM h), f AS (SELECT series_id, t // 86400 AS day, sum(value) AS final FROM h GROUP BY 1, 2)
 SELECT c.series_id, c.day, any_value(f.final) - coalesce(max(c.v) FILTER (WHERE c.t % 86400 < 43200), 0) AS most, any_value(f.final) - min(c.v) FILTER (WHERE c.t % 86400 >= 43200) AS least FROM c JOIN f ON f.series_id = c.series_id AND f.day = c.day GROUP BY 1, 2""",
)
def v02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds on a day's second half from scrapes around noon and the final count."""
    day = F.floor(F.col("t") / DAY)
    c = hourly(spark, sf_dir).withColumn("day", day).withColumn("v", F.sum("value").over(Window.partitionBy("series_id", "day").orderBy("t")))
    noon = F.col("t") % DAY < DAY // 2
    return c.groupBy("series_id", "day").agg((F.max("v") - F.coalesce(F.max(F.when(noon, F.col("v"))), F.lit(0.0))).alias("most"), (F.max("v") - F.min(F.when(~noon, F.col("v")))).alias("least"))


@query(
    "v09_ledger_issues",
    """WITH a AS (SELECT o_orderkey AS attempt, count(l_orderkey) AS n, count(l_orderkey) FILTER (WHERE l_linenumber = 1) AS starts, count(l_orderkey) FILTER (WHERE l_linestatus = 'F') AS done, count(DISTINCT l_returnflag) AS flags FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
 i AS (SELECT attempt, 'no_events' AS issue, 3 AS severity FROM a WHERE n = 0 UNION ALL SELECT attempt, 'missing_start', 2 FROM a WHERE n > 0 AND starts = 0 UNION ALL SELECT attempt, 'missing_completion', 2 FROM a WHERE n > 0 AND done = 0 UNION ALL SELECT attempt, 'partly_done', 1 FROM a WHERE done > 0 AND done < n)
 SELECT issue, max(severity) AS severity, count(*) AS attempts FROM i GROUP BY 1""",
)
def v09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed issues of attempts (orders) and their events (line items), with the severity of each type."""
    o, l = read_table(spark, sf_dir, "orders").select("o_orderkey"), read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus")  # noqa: E741
    told = l.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_linenumber") == 1).alias("starts"), F.count_if(F.col("l_linestatus") == "F").alias("done"))
    a = o.join(told, F.col("o_orderkey") == F.col("l_orderkey"), "left").fillna(0, ["n", "starts", "done"])
    rules = (("no_events", 3, F.col("n") == 0), ("missing_start", 2, (F.col("n") > 0) & (F.col("starts") == 0)), ("missing_completion", 2, (F.col("n") > 0) & (F.col("done") == 0)), ("partly_done", 1, (F.col("done") > 0) & (F.col("done") < F.col("n"))))
    issues = F.filter(F.array(*[F.when(rule, F.struct(F.lit(name).alias("issue"), F.lit(severity).alias("severity"))) for name, severity, rule in rules]), lambda x: x.isNotNull())
    return a.select(F.explode(issues).alias("i")).groupBy(F.col("i.issue").alias("issue")).agg(F.max("i.severity").alias("severity"), F.count("*").alias("attempts"))


@query(
    "v12_minute_states",
    f"""WITH {E}, s AS (SELECT series_id, user_id % 3 AS gen, min(t) AS a, max(t) AS z FROM e GROUP BY series_id, user_id % 3, t // 43200), k AS (SELECT series_id, unnest(range({START}, {START + 5 * DAY}, 3600)) AS b FROM (SELECT DISTINCT series_id FROM e)),
 o AS (SELECT k.series_id, k.b, CASE WHEN s.a IS NOT NULL THEN least(s.z, k.b + 3599) - greatest(s.a, k.b) + 1 END AS w FROM k LEFT JOIN s ON s.series_id = k.series_id AND s.a <= k.b + 3599 AND s.z >= k.b)
 SELECT series_id, b, coalesce(max(w), 0)::BIGINT AS covered, count(w) AS generators, CASE WHEN max(w) IS NULL THEN 'gap' WHEN max(w) = 3600 THEN 'complete' ELSE 'partial' END AS state FROM o GROUP BY 1, 2""",
)
def v12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether generators' active spans cover each hour. Spans are cut at the hours and meet them by equality."""
    e = events(spark, sf_dir)
    spans = e.groupBy("series_id", (F.col("user_id") % 3).alias("gen"), F.floor(F.col("t") / (DAY // 2)).alias("half")).agg(F.min("t").alias("a"), F.max("t").alias("z"))
    cut = spans.select("series_id", "a", "z", F.explode(F.sequence(F.floor(F.col("a") / HOUR), F.floor(F.col("z") / HOUR))).alias("h"))
    cut = cut.select("series_id", (F.col("h") * HOUR).alias("b"), (F.least(F.col("z"), F.col("h") * HOUR + HOUR - 1) - F.greatest(F.col("a"), F.col("h") * HOUR) + 1).alias("w"))
    hours = e.select("series_id").distinct().select("series_id", F.explode(F.sequence(F.lit(START).cast("bigint"), F.lit(START + 5 * DAY - HOUR).cast("bigint"), F.lit(HOUR).cast("bigint"))).alias("b"))
    told = hours.join(cut, ["series_id", "b"], "left").groupBy("series_id", "b").agg(F.max("w").alias("m"), F.count("w").alias("generators"))
    return told.select("series_id", "b", F.coalesce("m", F.lit(0)).alias("covered"), "generators", F.when(F.col("m").isNull(), "gap").when(F.col("m") == HOUR, "complete").otherwise("partial").alias("state"))


@query(
    "v14_history_acceptance",
    f"""WITH {H}, x AS (SELECT series_id, t, t - lag(t) OVER (PARTITION BY series_id ORDER BY t) AS apart FROM h WHERE t < {START + 7 * DAY})
 SELECT series_id, count(*) AS slots, coalesce(max(apart), 0) AS widest, min(t) - {START} AS late_start, CASE WHEN min(t) - {START} > 7200 THEN 'starts_late' WHEN coalesce(max(apart), 0) > 10800 THEN 'hole' WHEN count(*) < 151 THEN 'sparse' ELSE 'accepted' END AS verdict FROM x GROUP BY 1""",
)
def v14(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = hourly(spark, sf_dir).where(F.col("t") < START + 7 * DAY).withColumn("apart", F.col("t") - F.lag("t").over(by_series()))
    a = x.groupBy("series_id").agg(F.count("*").alias("slots"), F.coalesce(F.max("apart"), F.lit(0)).alias("widest"), (F.min("t") - START).alias("late_start"))
    return a.withColumn("verdict", F.when(F.col("late_start") > 7200, "starts_late").when(F.col("widest") > 10800, "hole").when(F.col("slots") < 151, "sparse").otherwise("accepted"))


@query(
    "v16_hourly_evidence",
    f"""WITH {E}, c AS (SELECT series_id, user_id % 4 AS pod, t // 21600 AS win, count(*) AS n FROM e GROUP BY 1, 2, 3)
 SELECT series_id, win, count(*) AS pods, sum(greatest(n - 1, 0))::BIGINT AS least, sum(n + 1)::BIGINT AS most, CASE WHEN count(*) < 4 THEN 'INCOMPLETE' WHEN sum(greatest(n - 1, 0)) >= 12 THEN 'PASS' WHEN sum(n + 1) < 12 THEN 'FAIL' ELSE 'INCONCLUSIVE' END AS verdict FROM c GROUP BY 1, 2""",
)
def v16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of each pod's count summed over pods, and what they allow to say; a missing pod makes the window incomplete."""
    c = events(spark, sf_dir).groupBy("series_id", (F.col("user_id") % 4).alias("pod"), F.floor(F.col("t") / (6 * HOUR)).alias("win")).agg(F.count("*").alias("n"))
    s = c.groupBy("series_id", "win").agg(F.count("*").alias("pods"), F.sum(F.greatest(F.col("n") - 1, F.lit(0))).alias("least"), F.sum(F.col("n") + 1).alias("most"))
    return s.withColumn("verdict", F.when(F.col("pods") < 4, "INCOMPLETE").when(F.col("least") >= 12, "PASS").when(F.col("most") < 12, "FAIL").otherwise("INCONCLUSIVE"))


@query(
    "k03_scale_by_day",
    f"""WITH {H}, p AS (SELECT x.series_id, x.t // 86400 AS day, (x.value + y.value) / 2 AS l, abs(x.value - y.value) AS r FROM h x JOIN h y ON y.series_id = x.series_id AND y.t = x.t - 86400),
 d AS (SELECT series_id, day, count(*) AS n, sum(l) AS sl, sum(l * l) AS sll, sum(r) AS sr, sum(l * r) AS slr FROM p GROUP BY 1, 2), c AS (SELECT series_id, day, sum(n) OVER w AS n, sum(sl) OVER w AS sl, sum(sll) OVER w AS sll, sum(sr) OVER w AS sr, sum(slr) OVER w AS slr FROM d WINDOW w AS (PARTITION BY series_id ORDER BY day ROWS UNBOUNDED PRECEDING)),
 f AS (SELECT series_id, day, n, CASE WHEN n * sll - sl * sl > 1e-9 THEN greatest(0, (n * slr - sl * sr) / (n * sll - sl * sl)) ELSE 0 END AS beta, sl, sr FROM c)
 SELECT series_id, day, n::BIGINT AS n, round(beta, 6) AS beta, round(greatest(0, (sr - beta * sl) / n), 6) AS a FROM f""",
)
def k03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread as a + beta * level with both at least 0, fitted each day to all pairs so far; days are summed before they are added up."""
    from loadloom.operators.joins import day_lag_pairs

    p = day_lag_pairs(hourly(spark, sf_dir), DAY).select("series_id", F.floor(F.col("t") / DAY).alias("day"), F.col("level").alias("l"), F.abs("residual").alias("r"))
    sums = {"n": F.count("*"), "sl": F.sum("l"), "sll": F.sum(F.col("l") * F.col("l")), "sr": F.sum("r"), "slr": F.sum(F.col("l") * F.col("r"))}
    d = p.groupBy("series_id", "day").agg(*[c.alias(k) for k, c in sums.items()])
    w = Window.partitionBy("series_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    c = d.select("series_id", "day", *[F.sum(k).over(w).alias(k) for k in sums])
    det = F.col("n") * F.col("sll") - F.col("sl") * F.col("sl")
    f = c.withColumn("beta", F.when(det > 1e-9, F.greatest(F.lit(0.0), (F.col("n") * F.col("slr") - F.col("sl") * F.col("sr")) / det)).otherwise(0.0))
    return rounded(f.select("series_id", "day", "n", "beta", F.greatest(F.lit(0.0), (F.col("sr") - F.col("beta") * F.col("sl")) / F.col("n")).alias("a")), "beta", "a")


@query(
    "l04_sign_p_value",
    f"""WITH {H}, d AS (SELECT x.series_id, x.t // 86400 AS day, sum(x.value - y.value) AS diff FROM h x JOIN h y ON y.series_id = x.series_id AND y.t = x.t - 86400 GROUP BY 1, 2)
 SELECT series_id, count(*) AS days, least(1.0, 2 * least((count(*) FILTER (WHERE diff <= 0) + 1) / (count(*) + 1), (count(*) FILTER (WHERE diff >= 0) + 1) / (count(*) + 1))) AS p FROM d GROUP BY 1""",
)
def l04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided share of daily differences on one side of 0."""
    from loadloom.operators.joins import day_lag_pairs

    d = day_lag_pairs(hourly(spark, sf_dir), DAY).groupBy("series_id", F.floor(F.col("t") / DAY).alias("day")).agg(F.sum("residual").alias("diff"))
    side = lambda c: (F.count_if(c) + 1) / (F.count("*") + 1)
    return d.groupBy("series_id").agg(F.count("*").alias("days"), F.least(F.lit(1.0), 2 * F.least(side(F.col("diff") <= 0), side(F.col("diff") >= 0))).alias("p"))


@query(
    "l10_participation",
    f"""WITH {E}, p AS (SELECT series_id, t // 86400 AS day, CASE WHEN t // 3600 % 24 BETWEEN 6 AND 14 THEN 'rising' WHEN t // 3600 % 24 = 15 THEN 'peak' WHEN t // 3600 % 24 BETWEEN 16 AND 20 THEN 'falling' ELSE 'trough' END AS phase, ord % 4 = 0 AS used FROM e)
 SELECT series_id, phase, count(DISTINCT day) AS instances, count(*) AS decisions, count(*) FILTER (WHERE used) AS used, round(count(*) FILTER (WHERE used) / count(*), 6) AS share FROM p GROUP BY 1, 2""",
)
def l10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loadloom.functions.scalars import day_phase

    used = F.count_if(F.col("ord") % 4 == 0)
    p = events(spark, sf_dir).withColumn("phase", day_phase(F.floor(F.col("t") / HOUR) % 24))
    return rounded(p.groupBy("series_id", "phase").agg(F.count_distinct(F.floor(F.col("t") / DAY)).alias("instances"), F.count("*").alias("decisions"), used.alias("used"), (used / F.count("*")).alias("share")), "share")
