"""Queries on generators and heartbeats, and on counters at boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loadloom.operators import generators as ops
from loadloom.plans.registry import DAY, E, G, HOUR, START, events, grid, query, rounded

END = START + 30 * DAY
SLACK, ORPHAN_GAP, LIMIT = 600, HOUR, 2 * HOUR


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generator ran from a user's first event of a day to the last."""
    return events(spark, sf_dir).groupBy("series_id", "user_id", F.floor(F.col("t") / DAY)).agg(F.min("t").alias("begin"), F.max("t").alias("last"), F.count("*").alias("k")).where("k > 1").select("series_id", "begin", "last")


@query(
    "v07_generator_findings",
    f"""WITH {E}, p AS (SELECT series_id, min(t) AS a, max(t) AS z FROM e GROUP BY series_id, user_id, t // 86400 HAVING count(*) > 1),
 s AS (SELECT series_id, t, k, sum(d) AS d FROM (SELECT series_id, a AS t, 0 AS k, 1 AS d FROM p UNION ALL SELECT series_id, z, 2, -1 FROM p) GROUP BY 1, 2, 3),
 c AS (SELECT *, sum(d) OVER (PARTITION BY series_id ORDER BY t, k) AS n FROM s), o AS (SELECT *, sum(CASE WHEN d > 0 AND n >= 2 AND n - d < 2 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY t, k) AS g FROM c),
 ov AS (SELECT series_id, 'overlap' AS kind, min(t) AS "first", max(t) AS "last", max(n) AS n FROM o WHERE n >= 2 OR (d < 0 AND n - d >= 2) GROUP BY series_id, g),
 f AS (SELECT series_id, t FROM e WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.series_id = e.series_id AND e.t BETWEEN p.a - {SLACK} AND p.z + {SLACK})),
 fg AS (SELECT *, sum(CASE WHEN x THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY t) AS g FROM (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY series_id ORDER BY t) > {ORPHAN_GAP}, true) AS x FROM f)),
 b AS (SELECT series_id, t, lag(t) OVER (PARTITION BY series_id ORDER BY t) AS was FROM e)
 SELECT series_id, kind, "first", "last", n::BIGINT AS n FROM ov UNION ALL SELECT series_id, 'orphan', min(t), max(t), count(*) FROM fg GROUP BY series_id, g
 UNION ALL SELECT series_id, CASE WHEN was IS NULL THEN 'gap_open_left' ELSE 'gap' END, coalesce(was, {START}), t, 0 FROM b WHERE t - coalesce(was, {START}) > {LIMIT}
 UNION ALL SELECT series_id, 'gap_open_right', max(t), {END}, 0 FROM e GROUP BY 1 HAVING {END} - max(t) > {LIMIT}""",
)
def v07_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.generator_findings(runs(spark, sf_dir), events(spark, sf_dir).select("series_id", "t"), START, END, SLACK, ORPHAN_GAP, LIMIT, DAY)


def counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests so far, sampled at every tenth event; the counter starts anew each fifth day."""
    x = events(spark, sf_dir).withColumn("value", F.row_number().over(Window.partitionBy("series_id", F.floor(F.col("t") / (5 * DAY))).orderBy("t", "ord")).cast("double"))
    return x.where(F.col("ord") % 10 < 6).groupBy("series_id", "t").agg(F.max("value").alias("value"))


MAX_GAP = 3 * HOUR


@query(
    "w10_received_bounds",
    f"""WITH {G}, k0 AS (SELECT series_id, t, ord, row_number() OVER (PARTITION BY series_id, t // {5 * DAY} ORDER BY t, ord)::DOUBLE AS v FROM e), k AS (SELECT series_id, t, max(v) AS v FROM k0 WHERE ord % 10 < 6 GROUP BY 1, 2),
 x AS (SELECT series_id, t AS ta, v AS va, lead(t) OVER w AS tb, lead(v) OVER w AS vb, lead(t, 2) OVER w AS tc, lead(v, 2) OVER w AS vc, lag(t) OVER w AS tz, lag(v) OVER w AS vz FROM k WINDOW w AS (PARTITION BY series_id ORDER BY t)),
 y AS (SELECT *, CASE WHEN ta - tz <= {MAX_GAP} AND va >= vz THEN (va - vz) / (ta - tz) END AS sl, CASE WHEN tc - tb <= {MAX_GAP} AND vc >= vb THEN (vc - vb) / (tc - tb) END AS sr FROM x),
 atb AS (SELECT h.t AS b, y.* FROM (SELECT DISTINCT series_id, t FROM hs UNION SELECT series_id, t + 3600 FROM hs) h JOIN y ON y.series_id = h.series_id AND h.t >= y.ta AND (h.t < y.tb OR (y.tb IS NULL AND h.t = y.ta))),
 z AS (SELECT series_id, b, b = ta AS exact, CASE WHEN b > ta AND tb - ta > {MAX_GAP} THEN 'gap' WHEN b > ta AND vb < va THEN 'reset' END AS u, va, vb, ta, tb,
  CASE WHEN sl IS NOT NULL THEN least(greatest(va + sl * (b - ta), va), vb) END AS l, CASE WHEN sr IS NOT NULL THEN least(greatest(vb - sr * (tb - b), va), vb) END AS r FROM atb),
 q AS (SELECT series_id, b, u, CASE WHEN u IS NULL THEN CASE WHEN exact THEN va WHEN l IS NOT NULL AND r IS NOT NULL THEN (l + r) / 2 ELSE coalesce(l, r, va + (vb - va) * (b - ta) / (tb - ta)) END END AS v, va AS lo, CASE WHEN exact THEN va ELSE vb END AS hi,
  CASE WHEN exact THEN 0 WHEN l IS NOT NULL AND r IS NOT NULL THEN abs(l - r) / 2 + 1 ELSE (vb - va) / 2 + 1 END AS err, CASE WHEN exact THEN 0 ELSE tb - ta END AS wd FROM z),
 i AS (SELECT series_id, ta // 3600 * 3600 AS s, max(tb - ta) AS apart, bool_or(vb < va) AS fell FROM x WHERE tb <= ta // 3600 * 3600 + 3600 GROUP BY 1, 2),
 m AS (SELECT g.series_id, g.t AS start, CASE WHEN coalesce(a.u = 'reset', false) OR coalesce(c.u = 'reset', false) OR coalesce(i.fell, false) THEN 'reset' WHEN a.v IS NOT NULL AND c.v IS NOT NULL AND coalesce(i.apart, 0) <= {MAX_GAP} THEN 'ok' ELSE 'gap' END AS state, a.v AS av, c.v AS cv, a.lo AS al, a.hi AS ah, c.lo AS cl, c.hi AS ch, a.err AS ae, c.err AS ce, greatest(coalesce(apart, 0), a.wd, c.wd) AS mg
  FROM g LEFT JOIN q a ON a.series_id = g.series_id AND a.b = g.t LEFT JOIN q c ON c.series_id = g.series_id AND c.b = g.t + 3600 LEFT JOIN i ON i.series_id = g.series_id AND i.s = g.t)
 SELECT series_id, start, state, CASE WHEN state = 'ok' THEN round(greatest(0, cv - av), 4) END AS received, CASE WHEN state = 'ok' THEN greatest(0.0, cl - ah) END AS least, CASE WHEN state = 'ok' THEN ch - al END AS most, CASE WHEN state = 'ok' THEN round(ae + ce, 4) END AS err, CASE WHEN state = 'ok' THEN mg END AS max_gap FROM m""",
)
def w10_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = grid(spark, sf_dir).select("series_id", F.col("t").alias("start"))
    return rounded(ops.received_between(counter(spark, sf_dir), spans, HOUR, MAX_GAP), "received", "err", places=4)
