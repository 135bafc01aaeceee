"""Queries on paired resampling, percentile rules and repetition logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from loadloom.operators import forecasts, studies as ops
from loadloom.operators.grid import by_series
from loadloom.operators.joins import day_lag_pairs
from loadloom.plans.registry import DAY, H, HOUR, grid, hourly, query, rounded
from loadloom.plans.scoring import AHEAD
from loadloom.session import scratch_dir

DRAWS, SEED = 400, 11


@query(
    "l04_paired_bootstrap",
    f"""WITH {H}, d AS (SELECT x.series_id, x.t // 86400 AS day, sum(x.value - y.value) AS diff FROM h x JOIN h y ON y.series_id = x.series_id AND y.t = x.t - 86400 GROUP BY 1, 2),
 pl AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM d),
 q0 AS (SELECT series_id, n, x.draw, ((x.draw * 668265263 + i * 374761393 + {SEED}::BIGINT * 974711) % 4294967296)::BIGINT AS x FROM pl, (SELECT unnest(range(0, {DRAWS})) AS draw) x),
 q1 AS (SELECT *, (xor(x, x >> 15) * 40503) % 4294967296 AS y FROM q0), q2 AS (SELECT *, (xor(y, y >> 13) * 60493) % 4294967296 AS z FROM q1), q AS (SELECT series_id, draw, (xor(z, z >> 16) & 4294967295) % n AS i FROM q2),
 m AS (SELECT q.series_id, q.draw, sum(diff) / any_value(n) AS m FROM q JOIN pl ON pl.series_id = q.series_id AND pl.i = q.i GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY m, draw) - 1 AS r FROM m),
 b AS (SELECT series_id, max(CASE WHEN r = 10 THEN m END) AS low, max(CASE WHEN r = 389 THEN m END) AS high, least(1.0, 2 * least((count(*) FILTER (WHERE m <= 0) + 1) / {DRAWS + 1}, (count(*) FILTER (WHERE m >= 0) + 1) / {DRAWS + 1})) AS p FROM r GROUP BY 1),
 o AS (SELECT series_id, count(*) AS n, sum(diff) / count(*) AS mean FROM d GROUP BY 1)
 SELECT o.series_id, n, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, round(p, 9) AS p FROM o JOIN b ON b.series_id = o.series_id""",
)
def l04_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = day_lag_pairs(hourly(spark, sf_dir), DAY).groupBy("series_id", F.floor(F.col("t") / DAY).alias("day")).agg(F.sum("residual").alias("diff"))
    return rounded(rounded(ops.paired_bootstrap(d, DRAWS, SEED), "mean", "low", "high"), "p", places=9)


RULES = {"p50": 0.5, "p70": 0.7, "p75": 0.75}
STUDY = AHEAD + """, dd AS (SELECT unnest(range(1, 8)) AS d), x AS (SELECT a.series_id, a.origin, a.step, y.value AS v, pow(0.3, d - 1) AS w, y.t FROM a, dd, g y WHERE y.series_id = a.series_id AND y.t = a.target - d * 86400 AND y.value IS NOT NULL),
 c AS (SELECT *, (sum(w) OVER (PARTITION BY series_id, origin, step ORDER BY v, t ROWS UNBOUNDED PRECEDING) - w / 2) / sum(w) OVER (PARTITION BY series_id, origin, step) AS c FROM x),
 dr AS (SELECT series_id, t, avg(value) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) < avg(value) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 11 PRECEDING AND 6 PRECEDING) AS falls FROM g),
 ru AS (SELECT series_id, t AS origin, unnest(['p50', 'p70', 'p75', 'adaptive']) AS rule, unnest([0.5, 0.7, 0.75, CASE WHEN falls THEN 0.7 ELSE 0.75 END])::DOUBLE AS q FROM dr),
 z AS (SELECT c.series_id, c.origin, c.step, rule, any_value(q) AS q, count(*) AS support, max(c) FILTER (WHERE c <= q) AS cl, arg_max(v, c) FILTER (WHERE c <= q) AS vl, min(c) FILTER (WHERE c >= q) AS ch, arg_min(v, c) FILTER (WHERE c >= q) AS vh FROM c JOIN ru ON ru.series_id = c.series_id AND ru.origin = c.origin GROUP BY 1, 2, 3, 4),
 p AS (SELECT series_id, origin, step, rule, support, CASE WHEN cl IS NULL THEN vh WHEN ch IS NULL OR ch = cl THEN vl ELSE vl + (vh - vl) * (q - cl) / (ch - cl) END AS value FROM z)"""


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted pattern of seven days under every rule; the adaptive one is lower where the last hours fall."""
    g, w = grid(spark, sf_dir), by_series()
    falls = F.avg("value").over(w.rowsBetween(-5, 0)) < F.avg("value").over(w.rowsBetween(-11, -6))
    moved = g.select("series_id", F.col("t").alias("origin"), F.when(falls, 0.7).otherwise(0.75).alias("q"))
    sent = g.where("value is not null").select("series_id", "t", "value", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("d")).withColumn("target", F.col("t") + F.col("d") * DAY)
    rows = forecasts.ahead(g, 6, HOUR).join(sent, ["series_id", "target"]).withColumn("weight", F.pow(F.lit(0.3), F.col("d") - 1)).join(moved, ["series_id", "origin"])
    return ops.weighted_percentiles(rows, {r: F.lit(q) for r, q in RULES.items()} | {"adaptive": F.col("q")}, "series_id", "origin", "step", "target", "q")


@query(
    "l14_percentile_rules",
    f"""WITH {STUDY}, er AS (SELECT a.series_id, a.step, r.rule, p.value - y.value AS e FROM a JOIN (SELECT unnest(['p50', 'p70', 'p75', 'adaptive']) AS rule) r ON true LEFT JOIN p ON p.series_id = a.series_id AND p.origin = a.origin AND p.step = a.step AND p.rule = r.rule LEFT JOIN g y ON y.series_id = a.series_id AND y.t = a.target),
 f AS (SELECT * FROM er UNION ALL SELECT series_id, 0, rule, e FROM er)
 SELECT series_id, rule, step::INTEGER AS step, count(e) AS scored, count(*) - count(e) AS skipped, round(avg(abs(e)), 5) AS mae, round(avg(e), 5) AS bias, round(count(*) FILTER (WHERE e < -1e-9)::DOUBLE / nullif(count(e), 0), 6) AS under_rate FROM f GROUP BY 1, 2, 3""",
)
def l14(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    cells = forecasts.ahead(g, 6, HOUR).join(g.select("series_id", F.col("t").alias("target"), F.col("value").alias("actual")), ["series_id", "target"], "left")
    # whole counts make exact hits; a last digit of the interpolation must not turn one into a miss
    told = patterns(spark, sf_dir).select("series_id", "origin", "step", *[F.round(r, 9).alias(r) for r in (*RULES, "adaptive")])
    found = ops.rule_scores(cells.join(told, ["series_id", "origin", "step"], "left"), [*RULES, "adaptive"])
    return rounded(rounded(found, "mae", "bias", places=5), "under_rate")


@query(
    "l14_inertness",
    f"""WITH {STUDY}, i AS (SELECT series_id, origin, step, any_value(support) AS support, max(value) FILTER (WHERE rule = 'p75') - max(value) FILTER (WHERE rule = 'p50') AS d FROM p GROUP BY 1, 2, 3)
 SELECT series_id, support, count(*) AS cells, count(*) FILTER (WHERE abs(d) < 1e-9) AS same FROM i GROUP BY 1, 2""",
)
def l14_inertness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a support of one every percentile is that one value, so the rule changes nothing."""
    return patterns(spark, sf_dir).groupBy("series_id", F.col("support").cast("bigint").alias("support")).agg(F.count("*").alias("cells"), F.count_if(F.abs(F.col("p75") - F.col("p50")) < 1e-9).alias("same"))


@query(
    "l15_log_summary",
    f"""WITH {H}, r AS (SELECT series_id AS scenario, (t // 86400)::BIGINT AS data_seed, CASE WHEN t // 86400 % 2 = 0 THEN 'long' ELSE 'short' END AS history, (10 + t // 86400 % 3)::INTEGER AS epochs, CASE WHEN t // 3600 % 3 = 0 THEN 'lstm' ELSE 'gru-' || (t // 3600 % 2) END AS arm, CASE WHEN value < 8 THEN value * 12.5 END AS mae, value FROM h)
 SELECT scenario, data_seed, history, epochs, arm, count(*) AS runs, count(mae) AS successful, count(*) - count(mae) AS failed, count(*) FILTER (WHERE value >= 10) AS non_finite_forecast, count(*) FILTER (WHERE value >= 8 AND value < 10) AS no_scored_origins, count(*) FILTER (WHERE mae > 40) AS "over",
  round(min(mae), 2) AS least, round(max(mae), 2) AS most, CASE WHEN min(mae) > 0 THEN round(max(mae) / min(mae), 2) END AS spread FROM r GROUP BY 1, 2, 3, 4, 5""",
)
def l15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts written as a log of repetitions, a header for each series and day, and read back in small splits."""
    day, hour = F.floor(F.col("t") / DAY), F.floor(F.col("t") / HOUR)
    outcome = F.when(F.col("value") >= 10, "non-finite forecast").when(F.col("value") >= 8, "no scored origins").otherwise((F.col("value") * 12.5).cast("string"))
    arm = F.when(hour % 3 == 0, "lstm").otherwise(F.concat(F.lit("gru-"), (hour % 2).cast("string")))
    rep = F.concat(F.lit("  "), arm, F.lit("  seed "), F.when(hour % 5 == 0, "None").otherwise(hour.cast("string")), F.lit(": MAE "), outcome, F.when(F.col("value") * 12.5 > 40, " DIVERGED").otherwise(""), F.lit(" [1.5s]"))
    h = hourly(spark, sf_dir)
    body = h.select("series_id", "t", F.lit(1).alias("k"), rep.alias("line"))
    head = h.select("series_id", (day * DAY).alias("t"), F.lit(0).alias("k"), F.concat(F.lit("=== "), "series_id", F.lit(" (data seed "), day.cast("string"), F.lit(", "), F.when(day % 2 == 0, "long").otherwise("short"), F.lit(" history, "), (10 + day % 3).cast("string"), F.lit(" epochs, unseeded)")).alias("line")).distinct()
    path = f"{scratch_dir(spark)}/log-{uuid.uuid4().hex}"
    body.unionByName(head).repartition("series_id").sortWithinPartitions("series_id", "t", "k").select("line").write.text(path)
    return ops.repetition_summary(ops.read_repetitions(spark, path), 40.0)
