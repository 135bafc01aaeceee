"""Queries on log acceptance, trust, comparisons and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loadloom.operators import aggregates, evaluation as ops, forecasts, joins, outcomes, windows
from loadloom.operators.grid import by_series, runs
from loadloom.plans.grids import CUTOFF, MASK, MASK_SQL
from loadloom.plans.outcomes import OUTCOMES, TWO, day_sums, judged
from loadloom.plans.registry import DAY, E, G, H, HOUR, START, events, grid, hourly, query, rounded
from loadloom.plans.scoring import AHEAD, SCORED, scored
from loadloom.session import read_table


@query(
    "s02_raw_sample_lines",
    f"""WITH {E}, l AS (SELECT series_id, t // 86400 AS day, count(*) AS n FROM e GROUP BY 1, 2)
 SELECT e.series_id AS labels, e.t, CASE WHEN ord % 13 = 0 THEN NULL ELSE round(value, 6) END AS value FROM e JOIN l ON l.series_id = e.series_id AND l.day = e.t // 86400 WHERE e.t // 86400 % 5 <> 0""",
)
def s02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a day's samples, every fifth day's with a value too many: ragged, so rejected whole."""
    s = F.struct("t", "ord", F.when(F.col("ord") % 13 != 0, F.col("value")).alias("v"))
    lines = events(spark, sf_dir).groupBy(F.col("series_id").alias("labels"), F.floor(F.col("t") / DAY).alias("day")).agg(F.array_sort(F.collect_list(s)).alias("a"))
    v = F.transform("a", lambda x: x["v"])
    lines = lines.select("labels", F.transform("a", lambda x: x["t"]).alias("ts"), F.when(F.col("day") % 5 == 0, F.concat(v, F.array(F.lit(0.0)))).otherwise(v).alias("v"))
    return rounded(ops.raw_samples(lines)[0], "value")


@query(
    "s04_replay_violations",
    f"""WITH {E}, r AS (SELECT series_id, ord AS pos, t // 60 * 60 + CASE WHEN ord % 97 = 0 THEN 1 ELSE 0 END AS t, CASE WHEN ord % 89 = 0 THEN -value ELSE value END AS value, t + 120 - ord % 200 AS available FROM e),
 x AS (SELECT *, lag(t) OVER (PARTITION BY series_id ORDER BY pos) AS b FROM r)
 SELECT series_id, pos, CASE WHEN t % 60 <> 0 THEN 'off_grid' WHEN t <= b THEN 'not_increasing' WHEN value < 0 THEN 'bad_value' ELSE 'early' END AS reason FROM x WHERE t % 60 <> 0 OR t <= b OR value < 0 OR available < t""",
)
def s04(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, t = F.col("ord"), F.col("t")
    rows = events(spark, sf_dir).select("series_id", o.alias("pos"), (F.floor(t / 60) * 60 + (o % 97 == 0).cast("int")).alias("t"), F.when(o % 89 == 0, -F.col("value")).otherwise(F.col("value")).alias("value"), (t + 120 - o % 200).alias("available"))
    return ops.replay_violations(rows, 60).select("series_id", "pos", "reason")


@query(
    "s05_wide_trace",
    f"""WITH {E}, c AS (SELECT user_id, (t // 86400)::BIGINT AS day, (t // 3600 % 24 + 1)::INTEGER AS minute, count(*) AS n FROM e GROUP BY 1, 2, 3), k AS (SELECT DISTINCT user_id, day FROM c), m AS (SELECT unnest(range(1, 25))::INTEGER AS minute)
 SELECT k.user_id, k.day, m.minute, coalesce(c.n, 0) AS "count" FROM k CROSS JOIN m LEFT JOIN c ON c.user_id = k.user_id AND c.day = k.day AND c.minute = m.minute""",
)
def s05(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = [str(k) for k in range(1, 25)]
    slot = (F.floor(F.col("t") / HOUR) % 24 + 1).cast("string")
    wide = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("t") / DAY).alias("day")).agg(*[F.count_if(slot == s).alias(s) for s in slots])
    return ops.wide_to_long(wide, ["user_id", "day"], slots)


@query(
    "s12_extract_receipt",
    "SELECT event_type, count(*) AS lines, count(*) FILTER (WHERE NOT json_valid(props)) AS malformed, count(*) FILTER (WHERE json_valid(props)) AS kept FROM events GROUP BY 1",
)
def s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.from_json("props", "map<string,string>").isNotNull()
    return read_table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("lines"), F.count_if(~ok).alias("malformed"), F.count_if(ok).alias("kept"))


@query(
    "g06_inference_gate",
    f"""WITH {H}, i AS (SELECT *, t - 3600 * row_number() OVER (PARTITION BY series_id ORDER BY t) AS k FROM h WHERE t <= {CUTOFF}), r AS (SELECT series_id, max(t) AS e, count(*) AS n FROM i GROUP BY series_id, k), l AS (SELECT series_id, max(e) AS newest, arg_max(n, e) AS slots FROM r GROUP BY 1)
 SELECT series_id, newest, slots, CASE WHEN {CUTOFF} - newest > 7200 THEN 'stale' WHEN slots < 12 THEN 'short' ELSE 'ready' END AS status FROM l""",
)
def g06(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = runs(hourly(spark, sf_dir).where(F.col("t") <= CUTOFF), HOUR).groupBy("series_id").agg(F.max(F.struct("end", "slots")).alias("m"))
    return last.select("series_id", F.col("m.end").alias("newest"), "m.slots").withColumn("status", F.when(CUTOFF - F.col("newest") > 7200, "stale").when(F.col("slots") < 12, "short").otherwise("ready"))


@query(
    "g09_covered_hours",
    f"""WITH {E}, x AS (SELECT series_id, t // 86400 AS day, t, t - lag(t) OVER (PARTITION BY series_id, t // 86400 ORDER BY t) AS apart FROM e)
 SELECT series_id, day, min(t) % 86400 <= 3600 AND max(t) % 86400 >= 82800 AND coalesce(max(apart), 0) <= 7200 AS covered FROM x GROUP BY 1, 2""",
)
def g09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days whose samples reach both ends and lie at most two hours apart."""
    day = F.floor(F.col("t") / DAY)
    x = events(spark, sf_dir).withColumn("day", day).withColumn("apart", F.col("t") - F.lag("t").over(Window.partitionBy("series_id", "day").orderBy("t")))
    return x.groupBy("series_id", "day").agg(((F.min("t") % DAY <= HOUR) & (F.max("t") % DAY >= DAY - HOUR) & (F.coalesce(F.max("apart"), F.lit(0)) <= 2 * HOUR)).alias("covered"))


@query("g13_census_gate", f"WITH {H}, d AS (SELECT series_id, count(DISTINCT t // 86400) AS days, count(*) // 6 AS blocks FROM h GROUP BY 1) SELECT series_id, days, blocks, CASE WHEN days < 3 THEN 'NOT SCORED' WHEN blocks < 72 THEN 'CENSUS' ELSE 'SCORED' END AS verdict FROM d")
def g13(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = hourly(spark, sf_dir).groupBy("series_id").agg(F.count_distinct(F.floor(F.col("t") / DAY)).alias("days"), F.floor(F.count("*") / 6).alias("blocks"))
    return d.withColumn("verdict", F.when(F.col("days") < 3, "NOT SCORED").when(F.col("blocks") < 72, "CENSUS").otherwise("SCORED"))


@query(
    "j08_attach_raw",
    """SELECT o_orderkey, CASE WHEN count(l_orderkey) = 0 THEN 'unavailable' WHEN count(DISTINCT l_quantity) > 1 THEN 'ambiguous' ELSE 'matched' END AS status
 FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linestatus = o_orderstatus GROUP BY 1""",
)
def j08(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linestatus").agg(F.count_distinct("l_quantity").alias("n"))
    both = read_table(spark, sf_dir, "orders").join(said, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_linestatus") == F.col("o_orderstatus")), "left")
    return both.select("o_orderkey", F.when(F.col("n").isNull(), "unavailable").when(F.col("n") > 1, "ambiguous").otherwise("matched").alias("status"))


STATUS = f"CASE WHEN r.issued - r.trained > {DAY} THEN 'stale' WHEN r.issued < a.issued THEN 'out_of_order' WHEN r.trained < a.trained THEN 'older_model' ELSE 'ok' END"


@query(
    "w12_accepted",
    f"""WITH RECURSIVE {E}, r AS MATERIALIZED (SELECT series_id, ord AS pos, t - ord % 17 * 900 AS issued, t - user_id * 600 AS trained, row_number() OVER (PARTITION BY series_id ORDER BY ord) AS n FROM e),
 a AS (SELECT DISTINCT series_id, 0::BIGINT AS n, 0::BIGINT AS pos, -4611686018427387904 AS issued, -4611686018427387904 AS trained, '' AS status FROM r
  UNION ALL SELECT r.series_id, r.n, r.pos, CASE WHEN {STATUS} = 'ok' THEN r.issued ELSE a.issued END, CASE WHEN {STATUS} = 'ok' THEN r.trained ELSE a.trained END, {STATUS} FROM a JOIN r ON r.series_id = a.series_id AND r.n = a.n + 1)
 SELECT series_id, pos, status FROM a WHERE n > 0""",
)
def w12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.accepted(events(spark, sf_dir).select("series_id", F.col("ord").alias("pos"), (F.col("t") - F.col("ord") % 17 * 900).alias("issued"), (F.col("t") - F.col("user_id") * 600).alias("trained")), DAY)


@query("w13_first_accepted", f"WITH {E}, r AS (SELECT series_id, t // 21600 AS origin, ord, user_id, row_number() OVER (PARTITION BY series_id, t // 21600 ORDER BY ord) AS r FROM e) SELECT series_id, origin, ord, user_id FROM r WHERE r = 1")
def w13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("series_id", F.floor(F.col("t") / (6 * HOUR)).alias("origin"), "ord", "user_id")
    return ops.first_per(rows, ["series_id", "origin"], "ord")


@query(
    "w07_weighted_level",
    f"""WITH {G}, p AS (SELECT series_id, t, value, avg(y) AS pr FROM (SELECT g.series_id, g.t, g.value, b.value AS y FROM g LEFT JOIN g b ON b.series_id = g.series_id AND b.value IS NOT NULL AND b.t IN (g.t - 86400, g.t - 172800, g.t - 259200)) GROUP BY 1, 2, 3),
 r AS (SELECT series_id, t, CASE WHEN pr > 0 THEN value / pr END AS q FROM p), l AS (SELECT *, {", ".join(f"lag(q, {k}) OVER w AS q{k}" for k in range(6))} FROM r WINDOW w AS (PARTITION BY series_id ORDER BY t))
 SELECT series_id, t, CASE WHEN coalesce(q0, q1, q2, q3, q4, q5) IS NOT NULL THEN round(least(greatest(({" + ".join(f"coalesce(q{k} * pow(0.5, {k} / 3.0), 0)" for k in range(6))}) / nullif({" + ".join(f"CASE WHEN q{k} IS NULL THEN 0 ELSE pow(0.5, {k} / 3.0) END" for k in range(6))}, 0), 0.6), 1.6), 6) END AS level FROM l""",
)
def w07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recent level over the profile, newer slots weighing more (half-life of three slots)."""
    g = grid(spark, sf_dir)
    q = g.join(forecasts.profile(g, DAY, 3, 1), ["series_id", "t"], "left").withColumn("q", F.when(F.col("profile") > 0, F.col("value") / F.col("profile")))
    lags = [F.lag("q", k).over(by_series()) for k in range(6)]
    top = sum((F.coalesce(x * 0.5 ** (k / 3), F.lit(0.0)) for k, x in enumerate(lags)), F.lit(0.0))
    bottom = sum((F.when(x.isNull(), 0.0).otherwise(0.5 ** (k / 3)) for k, x in enumerate(lags)), F.lit(0.0))
    level = top / F.nullif(bottom, F.lit(0.0))
    return rounded(q.select("series_id", "t", F.when(level.isNotNull(), F.least(F.greatest(level, F.lit(0.6)), F.lit(1.6))).alias("level")), "level")


@query(
    "w08_directional_percentile",
    f"""WITH {G}, x AS (SELECT series_id, t, avg(value) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS a, avg(value) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 11 PRECEDING AND 6 PRECEDING) AS b FROM g)
 SELECT series_id, t, CASE WHEN a < b THEN 70 ELSE 75 END AS pct FROM x""",
)
def w08(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = by_series()
    now, before = F.avg("value").over(w.rowsBetween(-5, 0)), F.avg("value").over(w.rowsBetween(-11, -6))
    return grid(spark, sf_dir).select("series_id", "t", F.when(now < before, 70).otherwise(75).alias("pct"))


@query(
    "a07_coverage_by_group",
    f"""WITH {OUTCOMES}, s AS (SELECT *, ntile(3) OVER (PARTITION BY series_id ORDER BY bound, origin) AS tercile FROM oc JOIN iss USING (series_id, origin) WHERE covered IS NOT NULL)
 SELECT series_id, tercile, count(*) AS n, count(*) FILTER (WHERE covered) AS covered, round(avg(residual), 6) AS residual FROM s GROUP BY 1, 2""",
)
def a07(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loadloom.plans.outcomes import issued

    s = judged(spark, sf_dir).join(issued(spark, sf_dir).select("series_id", "origin", "bound"), ["series_id", "origin"]).where("covered is not null")
    s = s.withColumn("tercile", F.ntile(3).over(Window.partitionBy("series_id").orderBy("bound", "origin")))
    return rounded(s.groupBy("series_id", "tercile").agg(F.count("*").alias("n"), F.count_if("covered").alias("covered"), F.avg("residual").alias("residual")), "residual")


@query("t02_best_arm", f"WITH {E}, c AS (SELECT series_id, 'u' || user_id % 7 AS arm, round(avg(value), 0) AS cost FROM e GROUP BY 1, 2), b AS (SELECT *, first_value(arm) OVER (PARTITION BY series_id ORDER BY cost, arm) AS best, min(cost) OVER (PARTITION BY series_id) AS m FROM c) SELECT series_id, arm, cost, best, round(cost / nullif(m, 0), 6) AS times FROM b")
def t02(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = events(spark, sf_dir).groupBy("series_id", F.concat(F.lit("u"), F.col("user_id") % 7).alias("arm")).agg(F.round(F.avg("value"), 0).alias("cost"))
    return rounded(ops.relative_cost(costs), "times")


@query(
    "f04_weighted_pattern",
    f"""WITH {AHEAD}, d AS (SELECT unnest(range(1, 8)) AS d), x AS (SELECT a.series_id, a.origin, a.step, y.value AS v, pow(0.3, d - 1) AS w, y.t FROM a, d, g y WHERE y.series_id = a.series_id AND y.t = a.target - d * 86400 AND y.value IS NOT NULL),
 c AS (SELECT *, (sum(w) OVER (PARTITION BY series_id, origin, step ORDER BY v, t ROWS UNBOUNDED PRECEDING) - w / 2) / sum(w) OVER (PARTITION BY series_id, origin, step) AS c FROM x),
 z AS (SELECT series_id, origin, step, max(c) FILTER (WHERE c <= 0.7) AS cl, arg_max(v, c) FILTER (WHERE c <= 0.7) AS vl, min(c) FILTER (WHERE c >= 0.7) AS ch, arg_min(v, c) FILTER (WHERE c >= 0.7) AS vh FROM c GROUP BY 1, 2, 3)
 SELECT series_id, origin, step::INTEGER AS step, round(CASE WHEN cl IS NULL THEN vh WHEN ch IS NULL OR ch = cl THEN vl ELSE vl + (vh - vl) * (0.7 - cl) / (ch - cl) END, 4) AS value FROM z""",
)
def f04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 70th weighted percentile of the same slot on the seven days before, nearer days weighing more."""
    g = grid(spark, sf_dir)
    sent = g.where("value is not null").select("series_id", "t", "value", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("d")).withColumn("target", F.col("t") + F.col("d") * DAY)
    rows = forecasts.ahead(g, 6, HOUR).join(sent, ["series_id", "target"]).withColumn("weight", F.pow(F.lit(0.3), F.col("d") - 1))
    return rounded(aggregates.weighted_percentile(rows, 0.7, "series_id", "origin", "step"), "value", places=4)


@query(
    "k04_cohort_scores",
    f"WITH {OUTCOMES} SELECT series_id, origin, round(residual / greatest(0.5, 0.2 + 0.1 * bound), 6) AS score FROM oc JOIN iss USING (series_id, origin) WHERE residual IS NOT NULL AND origin % 43200 = 0",
)
def k04(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loadloom.plans.outcomes import issued

    both = judged(spark, sf_dir).join(issued(spark, sf_dir).select("series_id", "origin", "bound"), ["series_id", "origin"]).where((F.col("origin") % (12 * HOUR) == 0) & F.col("residual").isNotNull())
    return rounded(both.select("series_id", "origin", (F.col("residual") / F.greatest(F.lit(0.5), 0.2 + 0.1 * F.col("bound"))).alias("score")), "score")


@query(
    "k09_trust_hysteresis",
    f"""WITH RECURSIVE {H}, r AS MATERIALIZED (SELECT series_id, t, value < 7 AS healthy, row_number() OVER (PARTITION BY series_id ORDER BY t) AS n FROM h),
 k AS (SELECT DISTINCT series_id, 0::BIGINT AS n, 0::BIGINT AS t, true AS trusted, NULL::BIGINT AS since, 0::BIGINT AS c FROM r
  UNION ALL SELECT r.series_id, r.n, r.t, r.healthy AND (k.trusted OR (r.t - coalesce(k.since, r.t) >= {DAY} AND k.c + 4 >= 32)), CASE WHEN r.healthy THEN coalesce(k.since, r.t) END, CASE WHEN r.healthy THEN k.c + 4 ELSE 0 END FROM k JOIN r ON r.series_id = k.series_id AND r.n = k.n + 1)
 SELECT series_id, t, trusted FROM k WHERE n > 0""",
)
def k09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.hysteresis(hourly(spark, sf_dir).select("series_id", "t", (F.col("value") < 7).alias("healthy"), F.lit(4).cast("bigint").alias("issued")), DAY, 32)


@query(
    "k10_paired_challenger",
    f"""WITH {TWO} SELECT series_id, sum(cells)::BIGINT AS cells, count(*) AS days, round(sum(one) / nullif(sum(other), 0), 6) AS ratio, coalesce(sum(one) / nullif(sum(other), 0) <= 0.95, false) AS enter FROM pd GROUP BY 1""",
)
def k10(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.sum("one") / F.nullif(F.sum("other"), F.lit(0.0))
    return rounded(day_sums(spark, sf_dir).groupBy("series_id").agg(F.sum("cells").alias("cells"), F.count("*").alias("days"), r.alias("ratio"), F.coalesce(r <= 0.95, F.lit(False)).alias("enter")), "ratio")


@query("k13_error_floor", f"WITH {SCORED}, s AS (SELECT series_id, step, avg(CASE WHEN actual > 4 THEN abs(predicted - actual) / actual END) AS own FROM sc GROUP BY 1, 2), ov AS (SELECT series_id, avg(CASE WHEN actual > 0 THEN abs(predicted - actual) / actual END) AS overall FROM sc GROUP BY 1) SELECT s.series_id, s.step::INTEGER AS step, round(coalesce(own, overall, 0), 6) AS floor FROM s JOIN ov ON ov.series_id = s.series_id")
def k13(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.abs(F.col("predicted") - F.col("actual")) / F.nullif("actual", F.lit(0.0))
    sc = scored(spark, sf_dir)
    own = sc.groupBy("series_id", "step").agg(F.avg(F.when(F.col("actual") > 4, e)).alias("own"))
    overall = sc.groupBy("series_id").agg(F.avg(F.when(F.col("actual") > 0, e)).alias("overall"))
    return rounded(own.join(overall, "series_id").select("series_id", "step", F.coalesce("own", "overall", F.lit(0.0)).alias("floor")), "floor")


@query(
    "l02_clean_view",
    f"""WITH {SCORED}, m(no, a, b, reason) AS (VALUES {MASK_SQL}) SELECT series_id, count(*) AS cells, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM m WHERE target BETWEEN a AND b)) AS operational,
 count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM m WHERE target BETWEEN a AND b) AND NOT EXISTS (SELECT 1 FROM m WHERE target - 86400 BETWEEN a AND b)) AS clean FROM sc GROUP BY 1""",
)
def l02(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loadloom.operators.grid import first_interval

    ok, clean = first_interval(F.col("target"), MASK).isNull(), first_interval(F.col("target") - DAY, MASK).isNull()
    return scored(spark, sf_dir).groupBy("series_id").agg(F.count("*").alias("cells"), F.count_if(ok).alias("operational"), F.count_if(ok & clean).alias("clean"))


@query("l06_margin_verdict", f"WITH {TWO}, v AS (SELECT series_id, avg(one - other) AS m, 2.045 * stddev_samp(one - other) / sqrt(count(*)) AS h FROM pd GROUP BY 1) SELECT series_id, round(m - h, 6) AS low, round(m + h, 6) AS high, CASE WHEN m + h < 0 THEN 'pass' WHEN m - h > 0 THEN 'fail' ELSE 'inconclusive' END AS verdict FROM v")
def l06(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = aggregates.mean_interval(day_sums(spark, sf_dir).select("series_id", (F.col("one") - F.col("other")).alias("value")), 2.045, "series_id")
    return rounded(d.select("series_id", "low", "high", F.when(F.col("high") < 0, "pass").when(F.col("low") > 0, "fail").otherwise("inconclusive").alias("verdict")), "low", "high")


@query("l12_origins_all_finite", f"WITH {TWO} SELECT series_id, day, count(*) AS cells, count(*) FILTER (WHERE one IS NOT NULL AND other IS NOT NULL AND actual IS NOT NULL) AS kept, count(*) FILTER (WHERE actual IS NULL) AS no_truth, count(*) FILTER (WHERE actual IS NOT NULL AND (one IS NULL OR other IS NULL)) AS no_answer FROM two GROUP BY 1, 2")
def l12(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = forecasts.persistence(grid(spark, sf_dir), 6, HOUR).select("series_id", "origin", "step", F.col("predicted").alias("other"))
    both = scored(spark, sf_dir).join(other, ["series_id", "origin", "step"])
    truth, answer = F.col("actual").isNotNull(), F.col("predicted").isNotNull() & F.col("other").isNotNull()
    return both.groupBy("series_id", F.floor(F.col("origin") / DAY).alias("day")).agg(F.count("*").alias("cells"), F.count_if(truth & answer).alias("kept"), F.count_if(~truth).alias("no_truth"), F.count_if(truth & ~answer).alias("no_answer"))


@query(
    "v04_planned_requests",
    f"""WITH {H}, s AS (SELECT {START} + k * 5400 AS a, 100.0 + k % 7 * 10 AS rpm FROM (SELECT unnest(range(0, 480)) AS k)), hr AS (SELECT DISTINCT t AS hour FROM h)
 SELECT hour, round(sum(rpm * (least(a + 5400, hour + 3600) - greatest(a, hour)) / 60), 6) AS planned FROM hr LEFT JOIN s ON a < hour + 3600 AND a + 5400 > hour GROUP BY 1""",
)
def v04(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = hourly(spark, sf_dir).select(F.col("t").alias("hour")).distinct()
    slots = spark.range(480).select((F.col("id") * 5400 + START).alias("start"), (100.0 + F.col("id") % 7 * 10).alias("rpm"))
    return rounded(ops.planned_requests(slots, hours, 5400), "planned")


@query(
    "v08_worst_status",
    f"""WITH {H}, tg AS (SELECT series_id || '/' || t AS key, series_id, t FROM h), r AS (SELECT series_id, t AS a, t + 3 * 3600 AS b, CASE WHEN value >= 7 THEN 'invalid' WHEN value = 1 THEN 'unknown' ELSE 'gate_fail' END AS status FROM h WHERE value >= 6 OR value = 1),
 w AS (SELECT key, min(CASE status WHEN 'invalid' THEN 0 WHEN 'unknown' THEN 1 ELSE 2 END) AS k FROM tg JOIN r ON r.series_id = tg.series_id AND tg.t BETWEEN a AND b GROUP BY 1)
 SELECT tg.key, CASE k WHEN 0 THEN 'invalid' WHEN 1 THEN 'unknown' WHEN 2 THEN 'gate_fail' ELSE 'verified_clean' END AS status FROM tg LEFT JOIN w ON w.key = tg.key""",
)
def v08(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hourly(spark, sf_dir)
    targets = h.select(F.concat_ws("/", "series_id", "t").alias("key"), "series_id", F.col("t").alias("a"), F.col("t").alias("b"))
    status = F.when(F.col("value") >= 7, "invalid").when(F.col("value") == 1, "unknown").otherwise("gate_fail")
    bad = h.where("value >= 6 or value = 1").select("series_id", F.col("t").alias("c"), (F.col("t") + 3 * HOUR).alias("d"), status.alias("status"))
    return ops.worst_status(targets.select("key"), joins.overlaps(targets, bad, 3 * HOUR), ["invalid", "unknown", "gate_fail"], "verified_clean")


@query("v13_offset_bounds", f"WITH {E} SELECT series_id, max(ord % 50 - 100) AS lo, min(ord % 70 - 40) AS hi, max(ord % 50 - 100) > min(ord % 70 - 40) AS empty FROM e GROUP BY 1")
def v13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.offset_bounds(events(spark, sf_dir).select("series_id", (F.col("ord") % 50 - 100).alias("lo"), (F.col("ord") % 70 - 40).alias("hi")))


@query("v15_constant_identity", f"WITH {E} SELECT series_id, t // 3600 AS hour, count(DISTINCT user_id) AS owners, count(DISTINCT user_id) = 1 AND count(*) >= 2 AS constant FROM e GROUP BY 1, 2")
def v15(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = F.count_distinct("user_id")
    return events(spark, sf_dir).groupBy("series_id", F.floor(F.col("t") / HOUR).alias("hour")).agg(owners.alias("owners"), ((owners == 1) & (F.count("*") >= 2)).alias("constant"))


@query(
    "v11_missing_days_as_zero",
    f"""WITH {E}, c AS (SELECT user_id, t // 86400 AS day, count(*) AS n FROM e GROUP BY 1, 2), u AS (SELECT DISTINCT user_id FROM e), d AS (SELECT unnest(range({START // DAY}, {START // DAY + 30})) AS day)
 SELECT u.user_id, d.day, coalesce(n, 0) AS n, n IS NULL AS imputed FROM u CROSS JOIN d LEFT JOIN c ON c.user_id = u.user_id AND c.day = d.day""",
)
def v11(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("t") / DAY).alias("day")).agg(F.count("*").alias("n"))
    days = c.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(START // DAY).cast("bigint"), F.lit(START // DAY + 29).cast("bigint"))).alias("day"))
    return days.join(c, ["user_id", "day"], "left").select("user_id", "day", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("imputed"))


@query("r08_window_reduction", f"WITH {E}, m AS (SELECT series_id, t // 21600 AS win, t // 3600 AS hour, count(*) AS requests, count(*) FILTER (WHERE ord % 50 = 0) AS failed FROM e GROUP BY 1, 2, 3) SELECT series_id, win, count(*) AS observed, count(*) FILTER (WHERE failed > 0) AS violated, sum(requests)::BIGINT AS requests, sum(failed)::BIGINT AS failed, 6 - count(*) AS unobserved FROM m GROUP BY 1, 2")
def r08(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = events(spark, sf_dir).groupBy("series_id", F.floor(F.col("t") / (6 * HOUR)).alias("win"), F.floor(F.col("t") / HOUR).alias("hour")).agg(F.count("*").alias("requests"), F.count_if(F.col("ord") % 50 == 0).alias("failed"))
    return m.groupBy("series_id", "win").agg(F.count("*").alias("observed"), F.count_if(F.col("failed") > 0).alias("violated"), F.sum("requests").alias("requests"), F.sum("failed").alias("failed"), (6 - F.count("*")).alias("unobserved"))


@query("w02_seven_day_evidence", f"WITH {OUTCOMES}, b AS (SELECT series_id, origin // 3600 AS hour, count(*) AS issued, count(*) FILTER (WHERE covered) AS covered FROM oc GROUP BY 1, 2) SELECT series_id, hour, sum(issued) OVER w::BIGINT AS issued, sum(covered) OVER w::BIGINT AS covered FROM b WINDOW w AS (PARTITION BY series_id ORDER BY hour RANGE BETWEEN 167 PRECEDING AND CURRENT ROW)".replace("sum(issued) OVER w::BIGINT", "(sum(issued) OVER w)::BIGINT").replace("sum(covered) OVER w::BIGINT", "(sum(covered) OVER w)::BIGINT"))
def w02s(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = judged(spark, sf_dir).groupBy("series_id", F.floor(F.col("origin") / HOUR).alias("hour")).agg(F.count("*").alias("issued"), F.count_if(F.coalesce("covered", F.lit(False))).alias("covered"))
    return windows.trailing_hours(b, 168, "issued", "covered")


#: Gates of the looks that follow, each from the hour's requests: column and SQL alike.
GATES = {"identity": "value % 11 <> 0", "state": "value % 7 <> 6", "data": "value > 1", "history": "t % 172800 >= 43200", "calibration": "value % 5 <> 4", "prospective": "t % 86400 >= 7200", "coverage": "value < 9", "availability": "value <> 3"}


@query(
    "k08_gate_reason",
    f"""WITH {H}, x AS (SELECT series_id, t, {", ".join(f'{c} AS "{k}"' for k, c in GATES.items())}, value % 3 = 0 AS trusted, t >= {START + 3 * DAY} AS ever FROM h)
 SELECT series_id, t, CASE WHEN NOT "identity" THEN 'IdentityMismatch' WHEN NOT "state" THEN 'StateUnavailable' WHEN NOT "data" THEN 'DataUnavailable' WHEN NOT "history" THEN 'HistoryInsufficient'
  WHEN NOT "calibration" THEN 'CalibrationInsufficient' WHEN NOT "prospective" THEN 'ShadowInsufficient' WHEN NOT "coverage" THEN 'CoverageLow' WHEN NOT "availability" THEN 'DataUnavailable' WHEN NOT trusted THEN 'ShadowInsufficient' ELSE 'Ready' END AS reason,
  CASE WHEN trusted THEN 'Trusted' WHEN ever THEN 'Degraded' WHEN NOT "history" THEN 'Collecting' WHEN NOT "calibration" THEN 'Calibrating' ELSE 'Shadow' END AS phase FROM x""",
)
def k08(spark: SparkSession, sf_dir: str) -> DataFrame:
    looks = hourly(spark, sf_dir).select("series_id", "t", *[F.expr(c).alias(k) for k, c in GATES.items()], (F.col("value") % 3 == 0).alias("trusted"), (F.col("t") >= START + 3 * DAY).alias("ever"))
    reason, phase = ops.gate_reason(F.col("trusted"), F.col("ever"))
    return looks.select("series_id", "t", reason.alias("reason"), phase.alias("phase"))


#: What is known of each candidate at a look, from the hour's requests: column and SQL alike.
LOOKS = {"naive_trusted": "value < 8", "lstm_trusted": "value % 6 <> 5", "lstm_enters": "value <> 4", "lstm_stays": "value < 7", "statistical_trusted": "value % 5 <> 4", "statistical_enters": "value < 7", "statistical_stays": "value < 6"}
_SINCE = {m: f"CASE WHEN r.naive_trusted AND r.{m}_enters THEN coalesce(k.{m}_since, r.t) END" for m in ("lstm", "statistical")}
_HELD = {m: f"r.{m}_trusted AND ((coalesce(k.used, '') = '{m}' AND r.naive_trusted AND r.{m}_stays) OR coalesce(r.t - ({_SINCE[m]}) >= 14400, false))" for m in _SINCE}
_NOW = f"CASE WHEN {_HELD['lstm']} THEN 'lstm' WHEN {_HELD['statistical']} THEN 'statistical' WHEN r.naive_trusted THEN 'naive' END"


@query(
    "k11_fallback",
    f"""WITH RECURSIVE {H}, r AS MATERIALIZED (SELECT series_id, t, {", ".join(f"{c} AS {k}" for k, c in LOOKS.items())}, row_number() OVER (PARTITION BY series_id ORDER BY t) AS n FROM h),
 k AS (SELECT DISTINCT series_id, 0::BIGINT AS n, 0::BIGINT AS t, NULL::VARCHAR AS used, NULL::BIGINT AS lstm_since, NULL::BIGINT AS statistical_since, 0::INTEGER AS switches FROM r
  UNION ALL SELECT r.series_id, r.n, r.t, {_NOW}, {_SINCE["lstm"]}, {_SINCE["statistical"]}, k.switches + (({_NOW}) IS DISTINCT FROM k.used)::INTEGER FROM k JOIN r ON r.series_id = k.series_id AND r.n = k.n + 1)
 SELECT series_id, t, used, switches FROM k WHERE n > 0""",
)
def k11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.fallback(hourly(spark, sf_dir).select("series_id", "t", *[F.expr(c).alias(k) for k, c in LOOKS.items()]), 4 * HOUR)
