"""Queries on shortage events: how they ended, and what decisions had to do with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loadloom.functions.scalars import required_replicas
from loadloom.operators import shortage as ops
from loadloom.plans.outcomes import SAMPLES, samples
from loadloom.plans.registry import H, HOUR, events, grid, query
from loadloom.plans.scoring import NAIVE, naive

LOOKBACK, FRESH = 6 * HOUR, 2 * HOUR

#: The grid with what was needed and ready, and its shortage runs.
RUNS = NAIVE + SAMPLES[len(H) :] + """, sg AS (SELECT g.series_id, g.t, sh.rpm, sh.ready, sh.need FROM g LEFT JOIN sh ON sh.series_id = g.series_id AND sh.t = g.t),
 sx AS (SELECT *, coalesce(ready < need, false) AS bad, lag(ready) OVER w AS was, lag(need) OVER w AS need_was, lead(ready) OVER w AS after,
  row_number() OVER w - row_number() OVER (PARTITION BY series_id, coalesce(ready < need, false) ORDER BY t) AS k FROM sg WINDOW w AS (PARTITION BY series_id ORDER BY t)),
 ev AS (SELECT series_id, min(t) AS "start", max(t) AS "end", count(*) AS samples, sum(need - ready) * 60.0::DOUBLE AS shortage, max(need - ready) AS deficit, first(need ORDER BY t) AS need_at_onset, first(was ORDER BY t) IS NULL AS left_cut,
  last(after ORDER BY t) IS NULL AS right_cut, last(after ORDER BY t) > last(ready ORDER BY t) AS rose, coalesce(first(need ORDER BY t) > first(need_was ORDER BY t), false) AS demand_step FROM sx WHERE bad GROUP BY series_id, k)"""


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = samples(spark, sf_dir).withColumn("need", required_replicas(F.col("rpm")))
    return grid(spark, sf_dir).select("series_id", "t").join(seen, ["series_id", "t"], "left")


@query(
    "r05_event_recovery",
    f"""WITH {RUNS} SELECT series_id, "start", "end", samples, shortage, deficit, need_at_onset, left_cut, right_cut, demand_step, CASE WHEN NOT right_cut THEN "end" + 3600 END AS recovered,
 CASE WHEN NOT right_cut THEN ("end" + 3600 - "start") / 60 END AS recovery_minutes, CASE WHEN NOT right_cut THEN CASE WHEN rose THEN 'ready_rose' ELSE 'demand_fell' END END AS cause FROM ev""",
)
def r05_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.shortage_runs(slots(spark, sf_dir), HOUR)


#: Decisions: every event of the log is one; what it decided follows from its number.
DECISION = {
    "applied": "CASE WHEN ord % 11 <> 0 THEN 2 + ord % 7 END",
    "desired": "1 + ord // 4 % 5",
    "forecast_status": "CASE WHEN ord % 5 <> 0 THEN 'used' ELSE 'stale' END",
    "raw": "2 + ord % 5",
    "confident": "2 + ord % 5 - ord % 2",
    "clamped": "CASE WHEN ord % 19 <> 0 THEN 2 + ord % 3 END",
    "predicted": "2 + ord % 3 - CASE WHEN ord % 3 = 0 THEN 1 ELSE 0 END",
    "safeguards": "ord % 13 = 0",
    "most": "ord % 6",
    "action": "CASE WHEN ord % 4 < 2 THEN 'hold_down' ELSE 'apply' END",
    "source": "CASE WHEN ord % 7 = 0 THEN 'reactive' ELSE 'forecast' END",
    "issuance_id": "CASE WHEN ord % 17 = 0 THEN 'view' ELSE series_id END || ':' || (t // 21600 * 21600)",
}


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("series_id", "t", "ord", *[F.expr(rule.replace("//", "div")).alias(c) for c, rule in DECISION.items()])


def issuances(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = naive(spark, sf_dir).where(F.col("origin") % (6 * HOUR) == 0)
    steps = F.collect_list(F.struct("target", (F.col("predicted") * 400).alias("value")))
    return n.groupBy(F.concat("series_id", F.lit(":"), F.col("origin").cast("string")).alias("issuance_id"), F.col("series_id").alias("application")).agg(steps.alias("steps"))


TAGS = RUNS + f""", dec AS (SELECT series_id, t, ord, {", ".join(f"{rule} AS {c}" for c, rule in DECISION.items())} FROM e),
 da AS (SELECT ev.series_id, ev.start, ev.need_at_onset AS n0, coalesce(list({{'t': d.t, 'applied': d.applied}} ORDER BY d.t, d.ord) FILTER (WHERE d.t IS NOT NULL), []) AS s,
  last(d ORDER BY d.t, d.ord) FILTER (WHERE d.t IS NOT NULL) AS z FROM ev LEFT JOIN dec d ON d.series_id = ev.series_id AND d.t BETWEEN ev.start - {LOOKBACK} AND ev.start GROUP BY 1, 2, 3),
 db AS (SELECT *, CASE WHEN start - z.t <= {FRESH} THEN z END AS d, len(list_filter(range(1, len(s) + 1), lambda i: s[i].t - CASE WHEN i = 1 THEN start - {LOOKBACK} ELSE s[i - 1].t END > {FRESH})) = 0 AS dense,
  s[coalesce(list_max(list_filter(range(1, len(s) + 1), lambda i: coalesce(s[i].applied, 0) < n0)), 0) + 1].t AS run FROM da),
 iu AS (SELECT DISTINCT series_id || ':' || origin AS issuance_id, series_id AS application FROM n WHERE origin % 21600 = 0),
 fc AS (SELECT db.series_id, db.start, min(n.target) AS target, first(n.predicted * 400 ORDER BY n.target) AS f FROM db JOIN n ON n.series_id = db.series_id AND n.series_id || ':' || n.origin = db.d.issuance_id AND n.origin % 21600 = 0
  AND n.target >= db.start AND n.predicted IS NOT NULL WHERE db.d.forecast_status = 'used' GROUP BY 1, 2),
 tg AS (SELECT db.series_id, db.start, db.n0, db.d.t AS decision_t, fc.target, fc.f, sh.rpm AS truth, list_filter([
  CASE WHEN d IS NULL OR NOT dense THEN 'decision_coverage_gap' WHEN db.start - run >= {HOUR} THEN 'applied_ahead_ready_late' END,
  CASE WHEN d.forecast_status <> 'used' THEN 'no_forecast' WHEN d.raw < n0 THEN 'lead_peak_low' WHEN d.confident < n0 THEN 'confidence_cut' WHEN d.clamped < n0 THEN 'clamp_cut' WHEN d.predicted < n0 THEN 'overestimate_cut' END,
  CASE WHEN d.safeguards THEN 'safeguard_recorded' END, CASE WHEN d.most > 0 AND n0 > d.most THEN 'max_clip' END,
  CASE WHEN coalesce(d.desired, 0) >= n0 AND coalesce(d.applied, 0) < n0 AND d.action LIKE 'hold%' THEN 'hold' END, CASE WHEN d.source = 'reactive' THEN 'reactive_floor' END,
  CASE WHEN iu.application <> db.series_id THEN 'issuance_join_mismatch' END, CASE WHEN fc.f < 400 * (1 + fc.target // 3600 % 4) THEN 'forecast_below_plan' END, CASE WHEN fc.f < sh.rpm THEN 'forecast_below_truth' END], lambda x: x IS NOT NULL) AS tags
  FROM db LEFT JOIN iu ON iu.issuance_id = db.d.issuance_id LEFT JOIN fc ON fc.series_id = db.series_id AND fc.start = db.start LEFT JOIN sh ON sh.series_id = db.series_id AND sh.t = fc.target)"""


@query("r06_event_tags", f"""WITH {TAGS} SELECT series_id, "start", n0 AS need_at_onset, decision_t, target, f AS forecast, truth, CASE WHEN len(tags) = 0 THEN 'undetermined' ELSE array_to_string(tags, ',') END AS tags FROM tg""")
def r06(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = ops.shortage_runs(slots(spark, sf_dir), HOUR)
    truth = samples(spark, sf_dir).select("series_id", "t", F.col("rpm").alias("value"))
    plan = lambda t: 400 * (1 + F.floor(t / HOUR) % 4)
    out = ops.event_tags(runs, decisions(spark, sf_dir), issuances(spark, sf_dir), truth, plan, LOOKBACK, FRESH, HOUR)
    return out.select("series_id", "start", "need_at_onset", F.col("at.t").alias("decision_t"), "forecast.target", F.col("forecast.value").alias("forecast"), "truth", F.array_join("tags", ",").alias("tags"))


@query(
    "r06_autoscaler_tags",
    f"""WITH {RUNS}, q AS (SELECT ev.series_id, ev.start, count(*) FILTER (WHERE t % 10800 <> 0 AND need - (t // 3600) % 2 >= need) AS met, count(*) FILTER (WHERE t % 10800 <> 0 AND need - (t // 3600) % 2 < need) AS below,
  count(*) FILTER (WHERE t % 10800 = 0) AS unobserved FROM ev JOIN sg ON sg.series_id = ev.series_id AND sg.t BETWEEN ev.start AND ev.end GROUP BY 1, 2)
 SELECT *, CASE WHEN met + below = 0 THEN 'hpa_unobserved' ELSE array_to_string(list_filter([CASE WHEN below > 0 THEN 'hpa_desired_below_need' END, CASE WHEN unobserved > 0 THEN 'hpa_partially_unobserved' END, CASE WHEN below = 0 THEN 'hpa_desired_met_ready_late' END], lambda x: x IS NOT NULL), ',') END AS tags FROM q""",
)
def r06_autoscaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = slots(spark, sf_dir)
    desired = s.where((F.col("t") % (3 * HOUR) != 0) & F.col("need").isNotNull()).select("series_id", "t", (F.col("need") - F.floor(F.col("t") / HOUR) % 2).alias("desired"))
    return ops.autoscaler_tags(s, desired, ops.shortage_runs(s, HOUR)).withColumn("tags", F.array_join("tags", ","))
