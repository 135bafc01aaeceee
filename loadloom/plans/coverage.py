"""Queries on hourly evidence, coverage by group, the coverage rules and a challenger's bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loadloom.operators import choices, coverage, forecasts
from loadloom.plans.registry import DAY, HOUR, START, grid, query, rounded
from loadloom.plans.scoring import PROFILE, SCORED, scored

MISS = 0.15
#: A window of six targets at every hour; every fourth bound is missing, those of the first days are replayed, the last are pending.
_RECORDS = f"""rc AS (SELECT series_id, origin, origin + 21600 AS e, CASE WHEN origin < {START + 6 * DAY} THEN 'replay' ELSE 'prospective' END AS mode, origin % 21600 = 0 AS gate,
  CASE WHEN origin + 21600 > {START + 27 * DAY} THEN 'pending' WHEN count(predicted - actual) = 6 THEN 'scored' ELSE 'unscorable' END AS status,
  CASE WHEN status = 'scored' THEN max(actual) END AS y, max(predicted) AS base, CASE WHEN origin // 3600 % 4 <> 1 THEN max(predicted) * 1.25 END AS upper,
  {", ".join(f"CASE WHEN status = 'scored' THEN max(CASE WHEN step = {s} THEN abs(predicted - actual) END) END AS s{k}" for k, s in enumerate((1, 3, 6)))} FROM sc GROUP BY 1, 2)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.abs(F.col("predicted") - F.col("actual"))
    rows = scored(spark, sf_dir).groupBy("series_id", "origin").agg(
        F.count(e).alias("known"), F.max("actual").alias("y"), F.max("predicted").cast("double").alias("base"), F.array(*[F.max(F.when(F.col("step") == s, e)) for s in (1, 3, 6)]).alias("errors")
    )
    status = F.when(F.col("origin") + 6 * HOUR > START + 27 * DAY, "pending").when(F.col("known") == 6, "scored").otherwise("unscorable")
    rows = rows.withColumn("status", status)
    judged = [F.when(F.col("status") == "scored", F.col(c)).alias(c) for c in ("y", "errors")]
    return rows.select(
        "series_id", "origin", (F.col("origin") + 6 * HOUR).alias("end"), F.when(F.col("origin") < START + 6 * DAY, "replay").otherwise("prospective").alias("mode"), (F.col("origin") % (6 * HOUR) == 0).alias("gate"),
        "status", "base", F.when(F.floor(F.col("origin") / HOUR) % 4 != 1, F.col("base") * 1.25).alias("upper"), *judged,
    )


def _pinball(y: str, u: str) -> str:
    return f"CASE WHEN {y} >= {u} THEN {1 - MISS!r}::DOUBLE * ({y} - {u}) ELSE {MISS!r}::DOUBLE * ({u} - {y}) END"


_OUT = "NOT issue AND status = 'scored'"
_OWN = "mode = 'prospective'"
_COUNTS = {
    "issued": f"issue AND {_OWN}", "gate_issued": f"issue AND {_OWN} AND gate", "scored": f"{_OUT} AND {_OWN}", "unscorable": f"NOT issue AND status = 'unscorable' AND {_OWN}", "gate_scored": f"{_OUT} AND {_OWN} AND gate",
    "gate_unscorable": f"NOT issue AND status = 'unscorable' AND {_OWN} AND gate", "bounded": f"{_OUT} AND {_OWN} AND upper IS NOT NULL", "covered": f"{_OUT} AND {_OWN} AND y <= upper",
    "gate_bounded": f"{_OUT} AND {_OWN} AND gate AND upper IS NOT NULL", "gate_covered": f"{_OUT} AND {_OWN} AND gate AND y <= upper", "stepped": f"{_OUT} AND {_OWN} AND s0 IS NOT NULL",
    "replay_issued": "issue AND mode = 'replay'", "replay_scored": f"{_OUT} AND mode = 'replay'", "replay_unscorable": "NOT issue AND status = 'unscorable' AND mode = 'replay'",
    "replay_bounded": f"{_OUT} AND mode = 'replay' AND gate AND upper IS NOT NULL", "replay_covered": f"{_OUT} AND mode = 'replay' AND gate AND y <= upper",
}
_SUMS = {"pinball": (f"{_OUT} AND {_OWN} AND gate AND upper IS NOT NULL", _pinball("y", "upper")), "abs_error": (f"{_OUT} AND {_OWN}", "abs(y - base)"), "bias": (f"{_OUT} AND {_OWN}", "base - y")} | {f"step_{k}": (f"{_OUT} AND {_OWN}", f"s{k}") for k in range(3)}


@query(
    "a14_trust_evidence",
    f"""WITH {SCORED}, {_RECORDS}, b AS (SELECT *, origin // 3600 AS hour, true AS issue FROM rc UNION ALL SELECT *, e // 3600, false FROM rc WHERE status <> 'pending')
 SELECT series_id, hour, {", ".join(f"count(*) FILTER (WHERE {c}) AS {k}" for k, c in _COUNTS.items())}, {", ".join(f"round(coalesce(sum({x}) FILTER (WHERE {c}), 0), 6) AS {k}" for k, (c, x) in _SUMS.items())} FROM b GROUP BY 1, 2""",
)
def a14s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(coverage.hourly_evidence(records(spark, sf_dir), MISS, 3), *_SUMS)


@query(
    "a07_coverage_groups",
    f"""WITH {PROFILE}, lv AS (SELECT series_id, origin, min(CASE WHEN k >= 3 THEN p END) AS least, max(CASE WHEN k >= 3 THEN p END) AS most FROM pf GROUP BY 1, 2), n0 AS (SELECT a.*, g.value AS p FROM a LEFT JOIN g ON g.series_id = a.series_id AND g.t = a.target - 86400),
 n AS (SELECT series_id, origin, step, target, CASE WHEN count(p) OVER (PARTITION BY series_id, origin) = 6 THEN p END AS predicted FROM n0), sc AS (SELECT n.*, g.value AS actual FROM n JOIN g ON g.series_id = n.series_id AND g.t = n.target), {_RECORDS},
 q AS (SELECT series_id, round(quantile_cont(base, {1 / 3!r}), 6) AS lo, round(quantile_cont(base, {2 / 3!r}), 6) AS hi FROM rc GROUP BY 1),
 x AS (SELECT rc.*, lo, hi, round(least, 6) AS least, round(most, 6) AS most FROM rc JOIN q ON q.series_id = rc.series_id LEFT JOIN lv ON lv.series_id = rc.series_id AND lv.origin = rc.origin WHERE y IS NOT NULL),
 gr AS (SELECT *, unnest(list_filter(['all', CASE WHEN base <= lo THEN 'low' END, CASE WHEN base > lo AND base <= hi THEN 'mid' END, CASE WHEN base > hi THEN 'high' END, CASE WHEN most > least THEN 'ramp' END, CASE WHEN NOT most > least THEN 'plateau' END, CASE WHEN most <= 4 THEN 'near_zero' END, CASE WHEN base = 0 THEN 'zero_forecast' END], lambda g: g IS NOT NULL)) AS "group" FROM x)
 SELECT series_id, "group", count(upper) AS windows, count(*) - count(upper) AS unbounded, round(avg(CASE WHEN upper IS NOT NULL THEN (y <= upper)::INTEGER END), 6) AS coverage, round(avg(upper - base), 6) AS width,
  round(avg(CASE WHEN most IS NOT NULL THEN (upper - base) / greatest(most, 1e-9) END), 6) AS width_over_level, round(avg(CASE WHEN upper IS NOT NULL THEN {_pinball("y", "upper")} END), 6) AS pinball FROM gr GROUP BY 1, 2""",
)
def a07s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terciles of each series' own bases; the level of a window is the profile over its targets."""
    rows = records(spark, sf_dir)
    level = forecasts.profile_forecast(grid(spark, sf_dir), DAY, 7, 3, 6, HOUR).groupBy("series_id", "origin").agg(F.round(F.min("predicted"), 6).alias("least"), F.round(F.max("predicted"), 6).alias("most"))
    cuts = rows.groupBy("series_id").agg(*[F.round(F.percentile("base", q), 6).alias(k) for k, q in (("lo", 1 / 3), ("hi", 2 / 3))])
    out = coverage.coverage_by_group(rows.join(level, ["series_id", "origin"], "left").join(cuts, "series_id"), F.col("lo"), F.col("hi"), 4.0, MISS, "series_id")
    return rounded(out, "coverage", "width", "width_over_level", "pinball")


LIMITS = coverage.Limits(recent=24, rolling=12, consecutive=6, least_day=8, coverage=0.72)
_LOOKS = "lk AS (SELECT series_id, target AS t, actual <= predicted * 1.25 AS covered FROM sc WHERE step = 1 AND predicted - actual IS NOT NULL)"


@query(
    "k07_trust_rules",
    f"""WITH {SCORED}, {_LOOKS}, m0 AS (SELECT *, (NOT covered)::INTEGER AS m, sum(covered::INTEGER) OVER (PARTITION BY series_id ORDER BY t) AS block FROM lk),
 m AS (SELECT *, (sum(m) OVER (PARTITION BY series_id ORDER BY t ROWS {LIMITS.recent - 1} PRECEDING))::BIGINT AS missed, (sum(m) OVER (PARTITION BY series_id, block ORDER BY t))::BIGINT AS in_a_row FROM m0),
 wk AS (SELECT a.series_id, a.t, count(*) AS n, sum(b.m)::BIGINT AS miss FROM m a JOIN m b ON b.series_id = a.series_id AND b.t <= a.t AND b.t // 3600 >= ceil((a.t - 604800) / 3600.0) GROUP BY 1, 2),
 dy AS (SELECT series_id, t // 86400 AS day, count(*) AS n, sum(m) AS miss FROM m GROUP BY 1, 2), fd AS (SELECT * FROM dy WHERE n >= {LIMITS.least_day} AND n < 25 AND miss >= n * 2 // 5 + 1),
 fc AS (SELECT m.series_id, m.t, count(fd.day) AS failed FROM m LEFT JOIN fd ON fd.series_id = m.series_id AND m.t >= (fd.day + 1) * 86400 + 720 AND m.t <= (fd.day + 7) * 86400 - 3600 GROUP BY 1, 2),
 r AS (SELECT m.series_id, m.t, missed, in_a_row, failed, n, miss, missed >= {LIMITS.rolling} AS r1, in_a_row >= {LIMITS.consecutive} AS r2, failed > 0 AS r3, (n - miss) / n < {LIMITS.coverage} AND miss >= n * 28 // 100 + 1 AS r4 FROM m JOIN wk USING (series_id, t) JOIN fc USING (series_id, t)),
 b AS (SELECT *, (r1 AND NOT coalesce(lag(r1) OVER w, false))::INTEGER + (r2 AND NOT coalesce(lag(r2) OVER w, false))::INTEGER AS begins FROM r WINDOW w AS (PARTITION BY series_id ORDER BY t))
 SELECT series_id, t, missed, in_a_row, failed::INTEGER AS failed_days, n AS week_outcomes, miss AS week_missed, (sum(begins) OVER (PARTITION BY series_id ORDER BY t))::BIGINT AS alarms,
  array_to_string(list_filter([CASE WHEN r1 THEN 'rolling' END, CASE WHEN r2 THEN 'consecutive' END, CASE WHEN r3 THEN 'day' END, CASE WHEN r4 THEN 'seven_day' END], lambda x: x IS NOT NULL), ',') AS failing FROM b""",
)
def k07s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly outcomes of the first step, with tables of allowed misses for a day and for a week."""
    looks = scored(spark, sf_dir).where((F.col("step") == 1) & (F.col("predicted") - F.col("actual")).isNotNull()).select("series_id", F.col("target").alias("t"), (F.col("actual") <= F.col("predicted") * 1.25).alias("covered"))
    day = spark.range(25).select(F.col("id").alias("outcomes"), (F.floor(F.col("id") * 2 / 5) + 1).alias("misses"))
    week = spark.range(170).select(F.col("id").alias("outcomes"), (F.floor(F.col("id") * 28 / 100) + 1).alias("misses"))
    return coverage.coverage_rules(looks, LIMITS, day, week, 720)


@query(
    "k10_challenger_bands",
    f"""WITH {SCORED}, p AS (SELECT series_id, t, last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS v FROM g),
 x AS (SELECT sc.series_id, sc.target AS t, predicted * 1.25 AS one, p.v * 1.25 AS other, actual AS y FROM sc JOIN p ON p.series_id = sc.series_id AND p.t = sc.origin WHERE step = 1),
 l AS (SELECT *, {_pinball("y", "one")} AS lc, {_pinball("y", "other")} AS lb FROM x WHERE y IS NOT NULL AND one IS NOT NULL AND other IS NOT NULL),
 ev AS (SELECT a.series_id, a.t, count(*) AS pairs, sum(b.lc) AS c, sum(b.lb) AS b, a.t - min(b.t) AS span FROM l a JOIN l b ON b.series_id = a.series_id AND b.t <= a.t AND b.t // 3600 >= ceil((a.t - 604800) / 3600.0) GROUP BY 1, 2),
 co AS (SELECT series_id, t, {", ".join(f"sum({x}) OVER w AS {k}" for k, x in {"sc": "greatest(y - one, 0)", "sb": "greatest(y - other, 0)", "tc": "one", "tb": "other"}.items())} FROM l WINDOW w AS (PARTITION BY series_id ORDER BY t RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)),
 j AS (SELECT ev.series_id, ev.t, pairs, span, round(CASE WHEN b > 0 THEN c / b END, 9) AS ratio, pairs >= 48 AND span >= 172800 AND b > 0 AND sc <= 1.02::DOUBLE * sb AND tc <= 1.02::DOUBLE * tb AS basis FROM ev JOIN co ON co.series_id = ev.series_id AND co.t = ev.t)
 SELECT series_id, t, pairs, span::BIGINT AS span, ratio, basis AND coalesce(ratio <= 0.95, false) AS enters, basis AND coalesce(ratio <= 1.0, false) AS stays FROM j""",
)
def k10s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seasonal bound challenges the last value's; costs are the shortage and the capacity of the day before."""
    last = forecasts.persistence(grid(spark, sf_dir), 6, HOUR).where("step = 1").select("series_id", "origin", (F.col("predicted") * 1.25).alias("other"))
    x = scored(spark, sf_dir).where("step = 1").join(last, ["series_id", "origin"]).select("series_id", F.col("target").alias("t"), (F.col("predicted") * 1.25).alias("one"), "other", F.col("actual").alias("y")).dropna()
    losses = x.select("series_id", "t", choices.pinball(F.col("y"), F.col("one"), MISS).alias("challenger"), choices.pinball(F.col("y"), F.col("other"), MISS).alias("baseline"))
    w = Window.partitionBy("series_id").orderBy("t").rangeBetween(-DAY, 0)
    short = {k: F.sum(F.greatest(F.col("y") - F.col(c), F.lit(0.0))).over(w) for k, c in (("shortage_challenger", "one"), ("shortage_baseline", "other"))}
    costs = x.select("series_id", "t", *[c.alias(k) for k, c in short.items()], F.sum("one").over(w).alias("replica_time_challenger"), F.sum("other").over(w).alias("replica_time_baseline"))
    return choices.challenger_bands(choices.paired_evidence(losses), costs, 48, 2 * DAY)
