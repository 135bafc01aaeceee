"""Queries on studies of several arms: comparisons, reasons and outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loadloom.operators import verdicts as ops
from loadloom.operators.verdicts import Comparison
from loadloom.plans.registry import DAY, H, HOUR, hourly, query, rounded

WEEK, DRAWS, SEED, LEVEL = 7 * DAY, 200, 3, 0.5
CANDIDATES, OTHERS = ("click", "view", "error"), ("purchase", "signup")
SEEDS = tuple(range(7))
COMPARISONS = tuple(Comparison(a, o, "violation", margin=60.0) for a in CANDIDATES for o in OTHERS) + tuple(Comparison(a, o, "errors", margin=0.05) for a in CANDIDATES for o in OTHERS) + tuple(Comparison(a, o, "provisioned", benefit=0.02) for a in CANDIDATES for o in OTHERS)
SHARE = 0.6


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks are studies, series arms, weekdays seeds; a day is valid if most of its hours were seen and none stood out far above its mean."""
    day = Window.partitionBy("series_id", F.floor(F.col("t") / DAY))
    h = hourly(spark, sf_dir).select("series_id", "t", "value", F.floor(F.col("t") / HOUR).alias("hour"), (3 * F.col("value") * F.count("*").over(day)).alias("v"), F.sum("value").over(day).alias("s"))
    d = h.groupBy(F.floor(F.col("t") / WEEK).alias("study"), F.col("series_id").alias("arm"), F.floor(F.col("t") % WEEK / DAY).alias("seed")).agg(
        F.count("*").alias("hours"), (F.count_if(F.col("v") >= 5 * F.col("s")) * 60).alias("violation"), (F.sum(F.when(F.col("hour") % 9 == 0, F.col("value"))) / F.sum("value")).alias("e"),
        F.sum(F.ceil(F.col("value") / 2)).cast("double").alias("provisioned"), F.avg(F.ceil(F.col("value") / 2) - F.col("value") / 2).alias("surplus"),
        (F.count_if(F.col("v") < 5 * F.col("s")) * 60).alias("ok_minutes"), (F.count("*") * 60).alias("observed_minutes"), F.count_if(F.col("v") >= 6 * F.col("s")).alias("eligible"), F.count_if(F.col("v") >= 14 * F.col("s")).alias("top"),
    )
    valid = (F.col("hours") >= 12) & (F.col("top") == 0)
    return d.withColumn("errors", F.coalesce("e", F.lit(0.0))).withColumn("valid", valid).withColumn("cause", F.when(~valid, F.when(F.col("top") > 0, "product").when(F.col("hours") >= 6, "short")))


def ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A study is ready if every arm was seen in it, and often enough."""
    d = days(spark, sf_dir).groupBy("study").agg(F.count_distinct("arm").alias("arms"), F.sum("hours").alias("hours"))
    return d.select("study", F.explode(F.array(F.struct(F.lit("all_arms").alias("name"), (F.col("arms") == 5).alias("met")), F.struct(F.lit("hours").alias("name"), F.when(F.col("hours") > 300, True).alias("met")))).alias("r")).select("study", "r.*")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.compared(days(spark, sf_dir), COMPARISONS, DRAWS, SEED, LEVEL)


_ASKED = ", ".join(f"({i}, '{c.arm}', '{c.other}', '{c.key}', '{c.name}', {c.margin or 'NULL'}::DOUBLE, {c.benefit or 'NULL'}::DOUBLE)" for i, c in enumerate(COMPARISONS))
_EACH = ", ".join(f"'{a}'" for a in CANDIDATES)
FOUND = H + f""", d0 AS (SELECT t // {WEEK} AS study, series_id AS arm, t % {WEEK} // {DAY} AS seed, count(*) AS hours, count(*) FILTER (WHERE v >= 5 * s) * 60 AS violation, coalesce(sum(value) FILTER (WHERE t // 3600 % 9 = 0) / sum(value), 0) AS errors, sum(ceil(value / 2))::DOUBLE AS provisioned,
  avg(ceil(value / 2) - value / 2) AS surplus, count(*) FILTER (WHERE v < 5 * s) * 60 AS ok_minutes, count(*) * 60 AS observed_minutes, count(*) FILTER (WHERE v >= 6 * s) AS eligible, count(*) FILTER (WHERE v >= 14 * s) AS top FROM (SELECT *, 3 * value * count(*) OVER x AS v, sum(value) OVER x AS s FROM h WINDOW x AS (PARTITION BY series_id, t // 86400)) GROUP BY 1, 2, 3),
 dy AS (SELECT *, hours >= 12 AND top = 0 AS valid, CASE WHEN top > 0 THEN 'product' WHEN hours < 12 AND hours >= 6 THEN 'short' END AS cause FROM d0),
 cq(no, arm, other, key, name, margin, benefit) AS (VALUES {_ASKED}),
 mt AS (SELECT study, arm, seed, surplus, unnest(['violation', 'errors', 'provisioned']) AS key, unnest([violation::DOUBLE, errors, provisioned]) AS v FROM dy WHERE valid),
 pr AS (SELECT a.study, cq.no, a.seed, a.v AS a, b.v AS b, a.surplus AS sa, b.surplus AS sb FROM cq JOIN mt a ON a.arm = cq.arm AND a.key = cq.key JOIN mt b ON b.arm = cq.other AND b.key = cq.key AND b.study = a.study AND b.seed = a.seed),
 pl AS (SELECT *, row_number() OVER (PARTITION BY study, no ORDER BY seed) - 1 AS i, count(*) OVER (PARTITION BY study, no) AS n FROM pr),
 q0 AS (SELECT study, no, n, x.draw, ((x.draw * 668265263 + i * 374761393 + {SEED}::BIGINT * 974711) % 4294967296)::BIGINT AS x FROM pl, (SELECT unnest(range(0, {DRAWS})) AS draw) x),
 q1 AS (SELECT *, (xor(x, x >> 15) * 40503) % 4294967296 AS y FROM q0), q2 AS (SELECT *, (xor(y, y >> 13) * 60493) % 4294967296 AS z FROM q1), q3 AS (SELECT study, no, draw, (xor(z, z >> 16) & 4294967295) % n AS i FROM q2),
 bm AS (SELECT q3.study, q3.no, q3.draw, sum(a - b) / any_value(n) AS m FROM q3 JOIN pl ON pl.study = q3.study AND pl.no = q3.no AND pl.i = q3.i GROUP BY 1, 2, 3), br AS (SELECT *, row_number() OVER (PARTITION BY study, no ORDER BY m, draw) - 1 AS r FROM bm),
 bs AS (SELECT study, no, max(CASE WHEN r = {int(0.025 * DRAWS)} THEN m END) AS low, max(CASE WHEN r = {-int(-0.975 * DRAWS // 1) - 1} THEN m END) AS high, least(1.0, 2 * least((count(*) FILTER (WHERE m <= 0) + 1) / {DRAWS + 1}, (count(*) FILTER (WHERE m >= 0) + 1) / {DRAWS + 1})) AS p FROM br GROUP BY 1, 2),
 ms AS (SELECT study, no, count(*) AS n, avg(a) AS arm_mean, avg(b) AS other_mean, sum(a - b) / count(*) AS mean, abs(avg(sa) - avg(sb)) <= greatest(0.05 * avg(sb), 0.05) AS surplus_matched FROM pr GROUP BY 1, 2),
 fd AS (SELECT * FROM ms JOIN bs USING (study, no) JOIN cq USING (no)),
 h0 AS (SELECT study, no, p * (count(*) OVER (PARTITION BY study) - row_number() OVER w + 1) AS x, row_number() OVER w AS k FROM fd WHERE benefit IS NOT NULL WINDOW w AS (PARTITION BY study ORDER BY p, study || '|' || no)),
 h1 AS (SELECT study, no, least(1.0, max(x) OVER (PARTITION BY study ORDER BY k ROWS UNBOUNDED PRECEDING)) <= {LEVEL} AS rejected FROM h0),
 fv AS (SELECT fd.*, CASE WHEN benefit IS NOT NULL THEN CASE WHEN CASE WHEN other_mean <> 0 THEN (other_mean - arm_mean) / other_mean ELSE 0 END >= benefit AND coalesce(rejected, false) AND mean < 0 AND surplus_matched THEN 'pass' ELSE 'not established' END
  WHEN high <= margin THEN 'pass' WHEN low > margin THEN 'fail' ELSE 'inconclusive' END AS verdict FROM fd LEFT JOIN h1 ON h1.study = fd.study AND h1.no = fd.no)"""


@query("l07_comparisons", f"WITH {FOUND} SELECT study, arm, name, margin, benefit, n, round(arm_mean, 6) AS arm_mean, round(other_mean, 6) AS other_mean, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, round(p, 6) AS p, surplus_matched, verdict FROM fv")
def l07_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(found(spark, sf_dir), "arm_mean", "other_mean", "mean", "low", "high", "p").select("study", "arm", "name", "margin", "benefit", "n", "arm_mean", "other_mean", "mean", "low", "high", "p", "surplus_matched", "verdict")


REASONS = FOUND + f""", ea AS (SELECT study, unnest([{_EACH}]) AS arm FROM (SELECT DISTINCT study FROM dy)), pq AS (SELECT study, count(DISTINCT arm) = 5 AS a, sum(hours) > 300 AS b FROM dy GROUP BY 1),
 r1 AS (SELECT ea.study, ea.arm, CASE WHEN cause = 'product' THEN 'FAIL' ELSE 'INCOMPLETE' END AS class, CASE WHEN cause = 'product' THEN 'invalid by the product: ' || dy.arm || '/' || seed ELSE 'unusable day ' || dy.arm || '/' || seed || ': ' || coalesce(cause, 'unknown') END AS reason FROM dy JOIN ea ON ea.study = dy.study WHERE NOT valid
  UNION ALL SELECT ea.study, arm, 'NOT READY', 'prerequisite not met: all_arms' FROM ea JOIN pq USING (study) WHERE NOT a UNION ALL SELECT ea.study, arm, 'NOT READY', 'prerequisite not met: hours' FROM ea JOIN pq USING (study) WHERE NOT b
  UNION ALL SELECT ea.study, ea.arm, 'INCOMPLETE', 'no valid day ' || s.arm || '/' || s.seed FROM (SELECT study, arm, unnest(range(0, 7)) AS seed FROM (SELECT DISTINCT study, arm FROM dy)) s JOIN ea ON ea.study = s.study WHERE NOT EXISTS (SELECT 1 FROM dy WHERE dy.study = s.study AND dy.arm = s.arm AND dy.seed = s.seed AND valid)),
 jd AS (SELECT * FROM ea WHERE NOT EXISTS (SELECT 1 FROM r1 WHERE r1.study = ea.study AND r1.arm = ea.arm)), ow AS (SELECT fv.* FROM fv JOIN jd ON jd.study = fv.study AND jd.arm = fv.arm),
 sm AS (SELECT dy.study, dy.arm, sum(ok_minutes) / nullif(sum(observed_minutes), 0) AS share, max(eligible) AS used FROM dy JOIN jd ON jd.study = dy.study AND jd.arm = dy.arm WHERE valid GROUP BY 1, 2),
 rs AS (SELECT * FROM r1 UNION ALL SELECT study, arm, CASE WHEN surplus_matched AND verdict = 'fail' THEN 'FAIL-STAT' ELSE 'INCONCLUSIVE' END, name || CASE WHEN NOT surplus_matched THEN ': surplus not matched' WHEN verdict = 'fail' THEN ': beyond the margin' ELSE ': crosses the margin' END FROM ow WHERE margin IS NOT NULL AND (NOT surplus_matched OR verdict <> 'pass')
  UNION ALL SELECT study, arm, 'FAIL-STAT', 'share of good minutes' FROM sm WHERE coalesce(share, 0) < {SHARE} UNION ALL SELECT study, arm, 'INCONCLUSIVE', 'never used' FROM sm WHERE used <= 0
  UNION ALL SELECT study, arm, 'INCONCLUSIVE', 'no useful benefit' FROM jd WHERE NOT EXISTS (SELECT 1 FROM ow WHERE ow.study = jd.study AND ow.arm = jd.arm AND benefit IS NOT NULL AND verdict = 'pass'))"""


def reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.study_reasons(days(spark, sf_dir), ready(spark, sf_dir), found(spark, sf_dir), CANDIDATES, SEEDS, SHARE)


@query("l07_reasons", f"WITH {REASONS} SELECT study, arm, class, reason FROM rs")
def l07_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reasons(spark, sf_dir)


@query(
    "l07_study_outcomes",
    f"""WITH {REASONS}, oc AS (SELECT ea.study, ea.arm, min(CASE class WHEN 'FAIL' THEN 1 WHEN 'NOT READY' THEN 2 WHEN 'INCOMPLETE' THEN 3 WHEN 'FAIL-STAT' THEN 4 WHEN 'INCONCLUSIVE' THEN 5 END) AS k, count(class) AS reasons FROM ea LEFT JOIN rs ON rs.study = ea.study AND rs.arm = ea.arm GROUP BY 1, 2)
 SELECT study, arm, CASE k WHEN 1 THEN 'FAIL' WHEN 2 THEN 'NOT READY' WHEN 3 THEN 'INCOMPLETE' WHEN 4 THEN 'FAIL' WHEN 5 THEN 'INCONCLUSIVE' ELSE 'PASS' END AS outcome, reasons FROM oc""",
)
def l07_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.study_outcomes(days(spark, sf_dir), reasons(spark, sf_dir), CANDIDATES)
