"""Queries on smoothing, selection, telemetry reports and incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loadloom.operators import evaluation, forecasts, outcomes
from loadloom.operators.grid import by_series, first_interval, forward_fill, runs, state_runs
from loadloom.plans.grids import MASK, MASK_SQL
from loadloom.plans.outcomes import SAMPLES, samples
from loadloom.plans.registry import DAY, E, G, H, HOUR, START, events, grid, hourly, query, rounded
from loadloom.plans.scoring import NAIVE, PROFILE, SCORED, TREND, naive, scored

PARAMS = [(a, b, g) for a in (0.1, 0.3, 0.6) for b in (0.0, 0.1) for g in (0.05, 0.2)]
ARMS = ["seasonal", "persistence", "trend"]


@query("f07_seasonal_smoothing")
def f07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held against a plain loop in the tests."""
    return rounded(forecasts.seasonal_smoothing(grid(spark, sf_dir), 24, PARAMS, 6), "sse", "predicted", places=4)


@query("f08_ensemble")
def f08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The equal-weight ensemble of seasonal smoothing and the profile with AR(3), at each series' last slot; held against its members
    in the tests."""
    smooth = forecasts.seasonal_smoothing(grid(spark, sf_dir), 24, PARAMS, 6)
    profile = forecasts.profile_ar(grid(spark, sf_dir), DAY, 6, HOUR, 7 * DAY, 36, 6 * HOUR)
    whole, some = (forecasts.ensemble(smooth, profile, partial=rule).withColumn("rule", F.lit(rule)) for rule in ("refuse", "finite"))
    return rounded(whole.unionByName(some), "predicted", places=4)


@query("f12_lagged_ridge")
def f12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On the grid filled forward; held against numpy in the tests."""
    whole = forward_fill(grid(spark, sf_dir)).select("series_id", "t", F.col("filled").alias("value"))
    return rounded(forecasts.lagged_ridge(whole, (1, 2, 3, 6, 24), DAY, 6, HOUR, 7 * DAY, 100), "predicted", places=4)


def arm_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute error of each arm's six steps, known six hours after the origin."""
    g = grid(spark, sf_dir)
    rows = [f.select("series_id", "origin", "target", "predicted", F.lit(a).alias("arm")) for a, f in zip(ARMS, (forecasts.seasonal_naive(g, DAY, 6, HOUR), forecasts.persistence(g, 6, HOUR), forecasts.trend_adaptive(g, DAY, 6, HOUR)), strict=True)]
    actual = g.select("series_id", F.col("t").alias("target"), F.col("value").alias("actual"))
    cost = rows[0].unionByName(rows[1]).unionByName(rows[2]).join(actual, ["series_id", "target"])
    wide = cost.groupBy("series_id", (F.col("origin") + 6 * HOUR).alias("t")).pivot("arm", ARMS).agg(F.avg(F.abs(F.col("predicted") - F.col("actual"))))
    return wide.select("series_id", "t", F.array(*[F.round(a, 9) for a in ARMS]).alias("c"))


_KEEP = 0.5 ** (1 / 24)
_MEANS = ", ".join(f"CASE WHEN r.c{i} IS NULL THEN k.m{i} WHEN k.m{i} IS NULL THEN r.c{i} ELSE {1 - _KEEP!r}::DOUBLE * r.c{i} + {_KEEP!r}::DOUBLE * k.m{i} END AS m{i}, k.k{i} + (r.c{i} IS NOT NULL)::INTEGER AS k{i}" for i in (1, 2, 3))
SELECTOR = f"""WITH RECURSIVE {TREND}, n0 AS (SELECT a.*, g.value AS p FROM a LEFT JOIN g ON g.series_id = a.series_id AND g.t = a.target - 86400),
 n AS (SELECT series_id, origin, target, CASE WHEN count(p) OVER (PARTITION BY series_id, origin) = 6 THEN p END AS predicted FROM n0),
 ps AS (SELECT series_id, t, last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS v FROM g),
 u AS (SELECT 1 AS arm, series_id, origin, target, predicted FROM n UNION ALL SELECT 2, a.series_id, origin, target, v FROM a JOIN ps ON ps.series_id = a.series_id AND ps.t = a.origin UNION ALL SELECT 3, series_id, origin, target, predicted FROM tr),
 cs AS (SELECT u.series_id, u.origin + 21600 AS t, {", ".join(f"round(avg(abs(predicted - g.value)) FILTER (WHERE arm = {i}), 9) AS c{i}" for i in (1, 2, 3))} FROM u JOIN g ON g.series_id = u.series_id AND g.t = u.target GROUP BY 1, 2),
 rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) AS n FROM cs),
 k AS (SELECT DISTINCT series_id, 0::BIGINT AS n, 0::BIGINT AS t, NULL::DOUBLE AS m1, 0 AS k1, NULL::DOUBLE AS m2, 0 AS k2, NULL::DOUBLE AS m3, 0 AS k3, 1 AS use FROM rk
  UNION ALL SELECT series_id, n, t, m1, k1, m2, k2, m3, k3, CASE WHEN least(k1, k2, k3) < 12 THEN 1 WHEN [q1, q2, q3][use] <= best THEN use WHEN q1 <= best THEN 1 WHEN q2 <= best THEN 2 ELSE 3 END
  FROM (SELECT *, least(q1, q2, q3) + 1e-9::DOUBLE * greatest(1.0::DOUBLE, abs(least(q1, q2, q3))) AS best FROM (SELECT *, {", ".join(f"m{i} + CASE WHEN use = {i} THEN 0.0::DOUBLE ELSE 0.05::DOUBLE END AS q{i}" for i in (1, 2, 3))}
   FROM (SELECT r.series_id, r.n, r.t, {_MEANS}, k.use FROM k JOIN rk r ON r.series_id = k.series_id AND r.n = k.n + 1))))
 SELECT series_id, t, ['seasonal', 'persistence', 'trend'][use] AS arm FROM k WHERE n > 0"""


@query("f16_online_selector", SELECTOR)
def f16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also held against a plain loop in the tests."""
    return forecasts.online_selector(arm_costs(spark, sf_dir), ARMS, 24.0, 12, 0.05)


@query(
    "f15_candidates",
    f"""WITH {NAIVE}, p AS (SELECT series_id, t, last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS v FROM g)
 SELECT series_id, origin, 'seasonal' AS recipe, count(predicted) = 6 AS available, CASE WHEN count(predicted) < 6 THEN 'season_not_observed' END AS reason FROM n WHERE origin % 21600 = 0 GROUP BY 1, 2
 UNION ALL SELECT series_id, t, 'persistence', v IS NOT NULL, CASE WHEN v IS NULL THEN 'nothing_observed' END FROM p WHERE t % 21600 = 0""",
)
def f15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each recipe at each origin, or why it has nothing to say."""
    g = grid(spark, sf_dir)
    table = None
    for recipe, rows, reason in (("seasonal", naive(spark, sf_dir), "season_not_observed"), ("persistence", forecasts.persistence(g, 6, HOUR), "nothing_observed")):
        own = rows.where(F.col("origin") % (6 * HOUR) == 0).groupBy("series_id", "origin").agg((F.count("predicted") == F.count("*")).alias("available"))
        own = own.select("series_id", "origin", F.lit(recipe).alias("recipe"), "available", F.when(~F.col("available"), reason).alias("reason"))
        table = own if table is None else table.unionByName(own)
    return table


@query(
    "f10_profile_ratio",
    f"""WITH {G}, p AS (SELECT g.series_id, g.t, g.value, avg(b.value) AS pr FROM g LEFT JOIN g b ON b.series_id = g.series_id AND b.value IS NOT NULL AND b.t IN (g.t - 86400, g.t - 172800, g.t - 259200) GROUP BY 1, 2, 3),
 r AS (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY t) AS v1, lag(pr) OVER (PARTITION BY series_id ORDER BY t) AS p1 FROM p)
 SELECT series_id, t, round(pr * CASE WHEN p1 > 0 AND v1 IS NOT NULL THEN least(greatest(v1 / p1, 0.6), 1.6) ELSE 1 END, 6) AS predicted FROM r WHERE pr IS NOT NULL""",
)
def f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile times how far the last slot was from its own profile, kept within 0.6 and 1.6."""
    g = grid(spark, sf_dir)
    w = by_series()
    r = g.join(forecasts.profile(g, DAY, 3, 1), ["series_id", "t"], "left").withColumns({"v1": F.lag("value").over(w), "p1": F.lag("profile").over(w)})
    ratio = F.when((F.col("p1") > 0) & F.col("v1").isNotNull(), F.least(F.greatest(F.col("v1") / F.col("p1"), F.lit(0.6)), F.lit(1.6))).otherwise(1.0)
    return rounded(r.where("profile is not null").select("series_id", "t", (F.col("profile") * ratio).alias("predicted")), "predicted")


@query(
    "a21_export_by_model",
    f"""WITH {SCORED} SELECT series_id, round(count(*) FILTER (WHERE actual <= predicted) / nullif(count(predicted - actual), 0), 6) AS coverage, round(avg(abs(predicted - actual)), 6) AS mae, round(avg(predicted - actual), 6) AS bias,
 {START + 30 * DAY} - max(CASE WHEN predicted - actual IS NOT NULL THEN origin END) AS age FROM sc WHERE origin > {START + 30 * DAY} - 604800 GROUP BY 1""",
)
def a21(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("predicted") - F.col("actual")
    recent = scored(spark, sf_dir).where(F.col("origin") > START + 30 * DAY - 7 * DAY)
    out = recent.groupBy("series_id").agg((F.count_if(F.coalesce(e >= 0, F.lit(False))) / F.nullif(F.count(e), F.lit(0))).alias("coverage"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), (F.lit(START + 30 * DAY) - F.max(F.when(e.isNotNull(), F.col("origin")))).alias("age"))
    return rounded(out, "coverage", "mae", "bias")


@query("j13_explained_by_mask", f"WITH {E}, m(no, a, b, reason) AS (VALUES {MASK_SQL}) SELECT series_id, ord, (SELECT reason FROM m WHERE t BETWEEN a - 30 AND b + 30 ORDER BY no LIMIT 1) AS explained FROM e")
def j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = [(a - 30, b + 30, r) for a, b, r in MASK]
    return events(spark, sf_dir).select("series_id", "ord", F.get(F.array(*[F.lit(r) for _, _, r in wide]), first_interval(F.col("t"), wide)).alias("explained"))


@query("l11_earliest_rejection", "SELECT o_custkey, min(o_orderdate) AS first_at, count(*) AS rejections FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def l11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loadloom.session import read_table

    return read_table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_at"), F.count("*").alias("rejections"))


@query(
    "l13_origins_around_events",
    f"""WITH {H}, ev(no, z) AS (VALUES (0, {START + 6 * DAY}::BIGINT), (1, {START + 18 * DAY}::BIGINT))
 SELECT series_id, no, count(*) FILTER (WHERE t + 21600 < z) AS before, count(*) FILTER (WHERE t < z AND t + 21600 >= z) AS spanning, count(*) FILTER (WHERE t >= z) AS after FROM h, ev GROUP BY 1, 2""",
)
def l13(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = hourly(spark, sf_dir).select("*", F.posexplode(F.array(F.lit(START + 6 * DAY), F.lit(START + 18 * DAY))).alias("no", "z"))
    end = F.col("t") + 6 * HOUR
    return x.groupBy("series_id", "no").agg(F.count_if(end < F.col("z")).alias("before"), F.count_if((F.col("t") < F.col("z")) & (end >= F.col("z"))).alias("spanning"), F.count_if(F.col("t") >= F.col("z")).alias("after"))


@query(
    "r04_capacity_report",
    f"""WITH {SAMPLES}, x AS (SELECT *, lag(ready) OVER (PARTITION BY series_id ORDER BY t) AS was FROM sh)
 SELECT series_id, count(*) FILTER (WHERE need > ready) * 60 AS short_minutes, round(avg(ready), 6) AS mean_ready, count(*) FILTER (WHERE was <> ready) AS changes, count(*) FILTER (WHERE ready >= 5) * 60 AS ceiling_minutes, round(count(*) / 720, 6) AS coverage FROM x GROUP BY 1""",
)
def r04(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loadloom.functions.scalars import required_replicas

    x = samples(spark, sf_dir).withColumns({"need": required_replicas(F.col("rpm")), "was": F.lag("ready").over(by_series())})
    out = x.groupBy("series_id").agg(
        (F.count_if(F.col("need") > F.col("ready")) * 60).alias("short_minutes"), F.avg("ready").alias("mean_ready"), F.count_if(F.coalesce(F.col("was") != F.col("ready"), F.lit(False))).alias("changes"),
        (F.count_if(F.col("ready") >= 5) * 60).alias("ceiling_minutes"), (F.count("*") / 720).alias("coverage"),
    )
    return rounded(out, "mean_ready", "coverage")


@query(
    "v05_incident_candidates",
    f"""WITH {H}, m(no, a, b, reason) AS (VALUES {MASK_SQL}), s AS (SELECT series_id, t, value >= 6 AS bad, lag(t) OVER w AS before, lead(t) OVER w AS after, row_number() OVER w - row_number() OVER (PARTITION BY series_id, value >= 6 ORDER BY t) AS k FROM h WINDOW w AS (PARTITION BY series_id ORDER BY t)),
 i AS (SELECT series_id, min(t) AS f, max(t) AS l, arg_min(coalesce(before, -1), t) AS hb, arg_max(coalesce(after, -1), t) AS ha FROM s WHERE bad GROUP BY series_id, k)
 SELECT series_id, f AS first_bad, l AS last_bad, CASE WHEN hb = -1 OR ha = -1 THEN 'open' WHEN EXISTS (SELECT 1 FROM m WHERE f BETWEEN m.a AND m.b) THEN 'attributed' ELSE 'unattributed' END AS status FROM i""",
)
def v05(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = state_runs(hourly(spark, sf_dir).select("series_id", "t", (F.col("value") >= 6).alias("bad")))
    status = F.when(F.col("healthy_before").isNull() | F.col("healthy_after").isNull(), "open").when(first_interval(F.col("first_bad"), MASK).isNotNull(), "attributed").otherwise("unattributed")
    return found.select("series_id", "first_bad", "last_bad", status.alias("status"))


@query(
    "v06_lifetimes",
    f"""WITH {E}, u AS (SELECT series_id, user_id, min(t) AS created, max(t) AS seen FROM e GROUP BY 1, 2), l AS (SELECT series_id, max(t) AS newest FROM e GROUP BY 1)
 SELECT u.series_id, user_id, created, CASE WHEN newest - seen > 86400 THEN seen END AS ended, newest - seen AS unknown_tail FROM u JOIN l ON l.series_id = u.series_id""",
)
def v06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last sight of each member; it ended if its exporter went on for a day without it."""
    e = events(spark, sf_dir)
    u = e.groupBy("series_id", "user_id").agg(F.min("t").alias("created"), F.max("t").alias("seen"))
    newest = u.groupBy("series_id").agg(F.max("seen").alias("newest"))
    tail = F.col("newest") - F.col("seen")
    return u.join(newest, "series_id").select("series_id", "user_id", "created", F.when(tail > DAY, F.col("seen")).alias("ended"), tail.alias("unknown_tail"))


@query(
    "d04_preflight",
    f"""WITH {H}, i AS (SELECT *, t - 3600 * row_number() OVER (PARTITION BY series_id ORDER BY t) AS k FROM h), r AS (SELECT series_id, count(*) AS n FROM i GROUP BY series_id, k), x AS (SELECT series_id, sum(greatest(n - 17, 0))::BIGINT AS sequences, max(n) AS longest FROM r GROUP BY 1)
 SELECT series_id, sequences, longest, CASE WHEN longest < 18 THEN 'too_short' WHEN sequences < 100 THEN 'few_sequences' ELSE 'ready' END AS status FROM x""",
)
def d04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training sequences of twelve inputs and six targets that whole runs can give."""
    x = runs(hourly(spark, sf_dir), HOUR).groupBy("series_id").agg(F.sum(F.greatest(F.col("slots") - 17, F.lit(0))).alias("sequences"), F.max("slots").alias("longest"))
    return x.withColumn("status", F.when(F.col("longest") < 18, "too_short").when(F.col("sequences") < 100, "few_sequences").otherwise("ready"))


@query(
    "k07_coverage_rules",
    f"""WITH {SCORED}, c AS (SELECT series_id, origin, (actual > predicted)::INTEGER AS m FROM sc WHERE step = 1 AND predicted - actual IS NOT NULL), x AS (SELECT *, sum(m) OVER (PARTITION BY series_id ORDER BY origin ROWS 63 PRECEDING) AS miss, count(*) OVER (PARTITION BY series_id ORDER BY origin ROWS 63 PRECEDING) AS n FROM c)
 SELECT series_id, origin, miss::BIGINT AS missed, CASE WHEN n < 64 THEN 'too_few' WHEN miss > 32 THEN 'rolling' ELSE 'ok' END AS gate FROM x""",
)
def k07(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("series_id").orderBy("origin").rowsBetween(-63, 0)
    c = scored(spark, sf_dir).where((F.col("step") == 1) & (F.col("predicted") - F.col("actual")).isNotNull()).withColumn("m", (F.col("actual") > F.col("predicted")).cast("int"))
    x = c.withColumns({"missed": F.sum("m").over(w), "n": F.count("*").over(w)})
    return x.select("series_id", "origin", "missed", F.when(F.col("n") < 64, "too_few").when(F.col("missed") > 32, "rolling").otherwise("ok").alias("gate"))


@query(
    "s11_scores",
    f"""WITH {SCORED} SELECT series_id, step::INTEGER AS step, count(*) AS targets, count(*) - count(predicted) AS unavailable,
 CASE WHEN count(*) = count(predicted) THEN round(avg(abs(predicted - actual)), 6) END AS mae, CASE WHEN count(*) = count(predicted) THEN round(avg(predicted - actual), 6) END AS bias,
 CASE WHEN count(*) = count(predicted) THEN round(sqrt(avg((predicted - actual) * (predicted - actual))), 6) END AS rmse FROM sc WHERE actual IS NOT NULL AND origin >= {START + 2 * DAY} AND (step > 3 OR predicted IS NOT NULL) GROUP BY 1, 2""",
)
def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).where((F.col("actual").isNotNull()) & (F.col("origin") >= START + 2 * DAY) & ((F.col("step") > 3) | F.col("predicted").isNotNull()))
    return rounded(evaluation.scores(rows, "series_id", "step"), "mae", "bias", "rmse")


@query(
    "t04_stratum_draw",
    f"""WITH {E}, m AS (SELECT user_id, count(*) AS n FROM e GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n, user_id) AS r, count(*) OVER () AS total FROM m),
 u AS (SELECT user_id, user_id % 23 AS owner, ((r - 1) * 3 // total)::INTEGER AS stratum, md5('draw-7-' || user_id) AS h FROM r),
 a0 AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY h) AS k FROM u WHERE stratum = 0), c0 AS (SELECT * FROM a0 WHERE k = 1 ORDER BY h LIMIT 5),
 a1 AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY h) AS k FROM u WHERE stratum = 1 AND owner NOT IN (SELECT owner FROM c0)), c1 AS (SELECT * FROM a1 WHERE k = 1 ORDER BY h LIMIT 5),
 a2 AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY h) AS k FROM u WHERE stratum = 2 AND owner NOT IN (SELECT owner FROM c0 UNION ALL SELECT owner FROM c1)), c2 AS (SELECT * FROM a2 WHERE k = 1 ORDER BY h LIMIT 5)
 SELECT stratum, (row_number() OVER (PARTITION BY stratum ORDER BY h) - 1)::INTEGER AS place, user_id, owner FROM (SELECT * FROM c0 UNION ALL SELECT * FROM c1 UNION ALL SELECT * FROM c2)""",
)
def t04(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loadloom.plans.grids import t03

    users = t03(spark, sf_dir).select(F.col("user_id").alias("app"), (F.col("user_id") % 23).alias("owner"), "stratum")
    return evaluation.stratum_draw(users, 3, 5, "draw-7-").withColumnRenamed("app", "user_id")


#: What befell each arm of each hour, from the hour's requests: column and SQL alike, the worst first.
REASONS = {"FAIL": "value >= 12", "NOT READY": "t % 21600 = 0 AND value > 7", "INCOMPLETE": "value = 1 AND t % 10800 = 0", "FAIL-STAT": "value = 9", "INCONCLUSIVE": "value = 8"}


@query(
    "l07_outcomes",
    f"""WITH {H}, d AS (SELECT series_id, t // 86400 AS day, {", ".join(f'count(*) FILTER (WHERE {c}) AS "{k}"' for k, c in REASONS.items())} FROM h GROUP BY 1, 2)
 SELECT series_id, day, CASE WHEN "FAIL" > 0 THEN 'FAIL' WHEN "NOT READY" > 0 THEN 'NOT READY' WHEN "INCOMPLETE" > 0 THEN 'INCOMPLETE' WHEN "FAIL-STAT" > 0 THEN 'FAIL' WHEN "INCONCLUSIVE" > 0 THEN 'INCONCLUSIVE' ELSE 'PASS' END AS outcome,
  ("FAIL" + "NOT READY" + "INCOMPLETE" + "FAIL-STAT" + "INCONCLUSIVE")::BIGINT AS reasons FROM d""",
)
def l07(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hourly(spark, sf_dir).withColumn("day", F.floor(F.col("t") / DAY))
    said = h.select("series_id", "day", F.explode(F.array(*[F.when(F.expr(c), F.lit(k)) for k, c in REASONS.items()])).alias("class"))
    return evaluation.outcome_of(said, "series_id", "day")


@query(
    "l09_component_report",
    f"""WITH {PROFILE}, ps AS (SELECT series_id, t, last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS v FROM g),
 c AS (SELECT pf.series_id, pf.step, pf.target, y.value AS actual, CASE WHEN k >= 3 THEN p END AS pattern, v AS network, least(0.95, 0.7 + step / 6 * 0.25) AS w, pf.target > {START + 28 * DAY} AS outstanding
  FROM pf JOIN ps ON ps.series_id = pf.series_id AND ps.t = pf.origin LEFT JOIN g y ON y.series_id = pf.series_id AND y.t = pf.target),
 d AS (SELECT *, coalesce(w * pattern + (1 - w) * network, pattern, network) AS hybrid FROM c), m AS (SELECT *, actual IS NOT NULL AND hybrid IS NOT NULL AND pattern IS NOT NULL AND NOT outstanding AS paired FROM d)
 SELECT series_id, step::INTEGER AS step, count(*) FILTER (WHERE NOT outstanding) AS matured, count(*) FILTER (WHERE outstanding) AS outstanding, count(actual) FILTER (WHERE NOT outstanding) AS actual_available,
  count(hybrid) FILTER (WHERE NOT outstanding) AS hybrid_finite, count(pattern) FILTER (WHERE NOT outstanding) AS pattern_usable, count(network) FILTER (WHERE NOT outstanding) AS network_finite,
  round(count(pattern) FILTER (WHERE NOT outstanding) / nullif(count(*) FILTER (WHERE NOT outstanding), 0), 6) AS pattern_share, count(*) FILTER (WHERE paired) AS paired, count(DISTINCT CASE WHEN paired THEN target END) AS targets,
  round(avg(CASE WHEN paired THEN abs(hybrid - actual) END), 6) AS hybrid_mae, round(avg(CASE WHEN paired THEN hybrid - actual END), 6) AS hybrid_bias, round(avg(CASE WHEN paired THEN abs(pattern - actual) END), 6) AS pattern_mae,
  round(avg(CASE WHEN paired THEN pattern - actual END), 6) AS pattern_bias, count(*) FILTER (WHERE NOT outstanding AND pattern IS NULL) AS no_pattern, 0::BIGINT AS identity_mismatch FROM m GROUP BY 1, 2""",
)
def l09(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    pattern = forecasts.profile_forecast(g, DAY, 7, 3, 6, HOUR)
    network = forecasts.persistence(g, 6, HOUR)
    keys = ["series_id", "origin", "step"]
    parts = pattern.select(*keys, "target", F.col("predicted").alias("pattern")).join(network.select(*keys, F.col("predicted").alias("network")), keys).join(forecasts.blend(pattern, network).select(*keys, F.col("predicted").alias("hybrid")), keys)
    actual = g.select("series_id", F.col("t").alias("target"), F.col("value").alias("actual"))
    rows = parts.join(actual, ["series_id", "target"], "left").withColumns({"weight": F.least(F.lit(0.95), 0.7 + F.col("step") / 6 * 0.25), "outstanding": F.col("target") > START + 28 * DAY})
    return rounded(evaluation.component_report(rows, "series_id", "step"), "pattern_share", "hybrid_mae", "hybrid_bias", "pattern_mae", "pattern_bias")


@query(
    "k12_block_choice",
    f"""WITH {TREND}, n0 AS (SELECT a.*, g.value AS p FROM a LEFT JOIN g ON g.series_id = a.series_id AND g.t = a.target - 86400),
 n AS (SELECT series_id, origin, target, CASE WHEN count(p) OVER (PARTITION BY series_id, origin) = 6 THEN p END AS predicted FROM n0),
 ps AS (SELECT series_id, t, last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS v FROM g),
 u AS (SELECT series_id, origin, target, predicted, 't' AS arm FROM tr UNION ALL SELECT series_id, origin, target, predicted, 's' FROM n UNION ALL SELECT a.series_id, origin, target, v, 'p' FROM a JOIN ps ON ps.series_id = a.series_id AND ps.t = a.origin),
 c AS (SELECT u.series_id, origin + 21600 AS t, round(avg(CASE WHEN arm = 's' THEN abs(predicted - g.value) END), 9) AS s, round(avg(CASE WHEN arm = 'p' THEN abs(predicted - g.value) END), 9) AS p, round(avg(CASE WHEN arm = 't' THEN abs(predicted - g.value) END), 9) AS tr
  FROM u JOIN g ON g.series_id = u.series_id AND g.t = u.target GROUP BY 1, 2),
 pl AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM c WHERE s IS NOT NULL AND p IS NOT NULL AND tr IS NOT NULL),
 z AS (SELECT series_id, max(n) AS n, least(12, max(n)) AS size FROM pl GROUP BY 1),
 b AS (SELECT series_id, n, size, draw, unnest(range(0, ceil(n / size)::BIGINT)) AS b FROM z, (SELECT unnest(range(0, 200)) AS draw)),
 q0 AS (SELECT *, ((draw * 668265263 + b * 374761393 + 11::BIGINT * 974711) % 4294967296)::BIGINT AS x FROM b), q1 AS (SELECT *, (xor(x, x >> 15) * 40503) % 4294967296 AS y FROM q0), q2 AS (SELECT *, (xor(y, y >> 13) * 60493) % 4294967296 AS w FROM q1),
 k AS (SELECT series_id, n, size, draw, b, (xor(w, w >> 16) & 4294967295) % (n - size + 1) AS first, unnest(range(0, size)) AS k FROM q2), d AS (SELECT series_id, draw, first + k AS i FROM k WHERE b * size + k < n),
 sm AS (SELECT d.series_id, d.draw, sum(s) AS s, sum(p) AS p, sum(tr) AS tr FROM d JOIN pl ON pl.series_id = d.series_id AND pl.i = d.i GROUP BY 1, 2),
 gs AS (SELECT series_id, draw, 'persistence' AS candidate, round(CASE WHEN s > 0 THEN (s - p) / s ELSE 0 END, 12) AS gain FROM sm UNION ALL SELECT series_id, draw, 'trend', round(CASE WHEN s > 0 THEN (s - tr) / s ELSE 0 END, 12) FROM sm),
 lo AS (SELECT series_id, candidate, gain AS lower FROM (SELECT *, row_number() OVER (PARTITION BY series_id, candidate ORDER BY gain, draw) - 1 AS r FROM gs) WHERE r = 20),
 pt AS (SELECT series_id, sum(s) AS s, sum(p) AS p, sum(tr) AS tr FROM pl GROUP BY 1), pg AS (SELECT series_id, 'persistence' AS candidate, CASE WHEN s > 0 THEN (s - p) / s ELSE 0 END AS gain FROM pt UNION ALL SELECT series_id, 'trend', CASE WHEN s > 0 THEN (s - tr) / s ELSE 0 END FROM pt),
 j AS (SELECT pg.series_id, pg.candidate, gain, lower, gain >= 0.02 AND lower > 0 AS beats FROM pg JOIN lo ON lo.series_id = pg.series_id AND lo.candidate = pg.candidate)
 SELECT series_id, candidate, round(gain, 6) AS gain, round(lower, 6) AS lower, beats, coalesce(first_value(CASE WHEN beats THEN candidate END) OVER (PARTITION BY series_id ORDER BY beats DESC, gain DESC, candidate), 'seasonal') AS chosen FROM j""",
)
def k12(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = arm_costs(spark, sf_dir).select("series_id", "t", *[F.element_at("c", i + 1).alias(a) for i, a in enumerate(ARMS)])
    return rounded(outcomes.block_choice(costs, ARMS[0], ARMS[1:], 200, 12, 11, 0.02), "gain", "lower")
