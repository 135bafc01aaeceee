"""Queries on choices with memory, the evidence behind them, and the theta forecaster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loadloom.operators import choices, evaluation
from loadloom.operators.grid import forward_fill
from loadloom.operators.theta import LEAST_INDEX, theta
from loadloom.plans.evaluation import LOOKS
from loadloom.plans.registry import DAY, G, H, HOUR, START, grid, hourly, query, rounded
from loadloom.plans.scoring import SCORED, TREND, scored
from loadloom.plans.selection import ARMS, arm_costs

PART, POOL, DRAWS, BLOCK, SEED, GAIN = 3 * DAY, 3, 200, 12, 11, 0.02
_PAIRS = {"sp": ("s", "p"), "st": ("s", "tr"), "pt": ("p", "tr"), "tp": ("tr", "p")}
_GAINS = ", ".join(f"round(CASE WHEN {r} IS NOT NULL AND {c} IS NOT NULL THEN CASE WHEN {r} > 0 THEN ({r} - {c}) / {r} ELSE 0 END END, 12) AS {k}" for k, (r, c) in _PAIRS.items())
_WHOLE = ", ".join(f"CASE WHEN count({a}) OVER w = count(*) OVER w THEN sum({a}) OVER w END AS {a}" for a in ("s", "p", "tr"))
_LOWER = ", ".join(f"CASE WHEN count({k}) > {DRAWS // 10} THEN list_sort(list({k}) FILTER (WHERE {k} IS NOT NULL))[{DRAWS // 10 + 1}] END AS l{k}" for k in _PAIRS)
_BEATS = {k: f"coalesce(d.{k} >= {GAIN} AND d.l{k} > 0, false)" for k in _PAIRS}


@query(
    "k12_incumbent_choice",
    f"""WITH RECURSIVE {TREND}, n0 AS (SELECT a.*, g.value AS p FROM a LEFT JOIN g ON g.series_id = a.series_id AND g.t = a.target - 86400),
 n AS (SELECT series_id, origin, target, CASE WHEN count(p) OVER (PARTITION BY series_id, origin) = 6 THEN p END AS predicted FROM n0),
 ps AS (SELECT series_id, t, last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS v FROM g),
 u AS (SELECT series_id, origin, target, predicted, 't' AS arm FROM tr UNION ALL SELECT series_id, origin, target, predicted, 's' FROM n UNION ALL SELECT a.series_id, origin, target, v, 'p' FROM a JOIN ps ON ps.series_id = a.series_id AND ps.t = a.origin),
 c AS (SELECT u.series_id, origin + 21600 AS t, {", ".join(f"round(avg(CASE WHEN arm = '{k}' THEN abs(predicted - g.value) END), 9) AS {a}" for k, a in (("s", "s"), ("p", "p"), ("t", "tr")))} FROM u JOIN g ON g.series_id = u.series_id AND g.t = u.target GROUP BY 1, 2),
 pl AS (SELECT series_id, t // {PART} AS part, s, p, tr, row_number() OVER (PARTITION BY series_id, t // {PART} ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY series_id, t // {PART}) AS n FROM c WHERE s IS NOT NULL),
 z AS (SELECT series_id, part, max(n) AS n, least({BLOCK}, max(n)) AS size, count(p) = count(*) AS okp, count(tr) = count(*) AS okt, sum(s) AS s, CASE WHEN okp THEN sum(p) END AS p, CASE WHEN okt THEN sum(tr) END AS tr FROM pl GROUP BY 1, 2),
 b AS (SELECT series_id, part, n, size, okp, okt, draw, unnest(range(0, ceil(n / size)::BIGINT)) AS b FROM z, (SELECT unnest(range(0, {DRAWS})) AS draw)),
 q0 AS (SELECT *, ((draw * 668265263 + (part * 1009 + b) * 374761393 + {SEED}::BIGINT * 974711) % 4294967296)::BIGINT AS x FROM b), q1 AS (SELECT *, (xor(x, x >> 15) * 40503) % 4294967296 AS y FROM q0), q2 AS (SELECT *, (xor(y, y >> 13) * 60493) % 4294967296 AS w FROM q1),
 k AS (SELECT *, (xor(w, w >> 16) & 4294967295) % (n - size + 1) AS first, unnest(range(0, size)) AS j FROM q2), dr AS (SELECT series_id, part, draw, okp, okt, first + j AS i FROM k WHERE b * size + j < n),
 sm AS (SELECT dr.series_id, dr.part, draw, sum(s) AS s, CASE WHEN okp THEN sum(p) END AS p, CASE WHEN okt THEN sum(tr) END AS tr FROM dr JOIN pl ON pl.series_id = dr.series_id AND pl.part = dr.part AND pl.i = dr.i GROUP BY dr.series_id, dr.part, draw, okp, okt),
 po AS (SELECT series_id, part, draw, {_WHOLE} FROM sm WINDOW w AS (PARTITION BY series_id, draw ORDER BY part ROWS {POOL - 1} PRECEDING)),
 lo AS (SELECT series_id, part, {_LOWER} FROM (SELECT series_id, part, {_GAINS} FROM po) GROUP BY 1, 2),
 pz AS (SELECT series_id, part, count(*) OVER w AS parts, (sum(n) OVER w)::BIGINT AS origins, {_WHOLE} FROM z WINDOW w AS (PARTITION BY series_id ORDER BY part ROWS {POOL - 1} PRECEDING)),
 d AS MATERIALIZED (SELECT pz.series_id, pz.part, parts, origins, {_GAINS}, {", ".join(f"l{x}" for x in _PAIRS)}, row_number() OVER (PARTITION BY pz.series_id ORDER BY pz.part) AS no FROM pz JOIN lo ON lo.series_id = pz.series_id AND lo.part = pz.part),
 f AS (SELECT DISTINCT series_id, 0::BIGINT AS no, 0::BIGINT AS part, 0::BIGINT AS parts, 0::BIGINT AS origins, NULL::VARCHAR AS previous, NULL::VARCHAR AS incumbent, NULL::VARCHAR AS chosen, NULL::VARCHAR AS path FROM d
  UNION ALL SELECT series_id, no, part, parts, origins, previous, incumbent,
   CASE WHEN incumbent = 'persistence' THEN CASE WHEN bpt THEN 'trend' ELSE incumbent END WHEN incumbent = 'trend' THEN CASE WHEN btp THEN 'persistence' ELSE incumbent END
    WHEN bsp AND (NOT bst OR sp >= st) THEN 'persistence' WHEN bst THEN 'trend' ELSE 'seasonal' END,
   CASE WHEN incumbent IS NOT NULL THEN CASE WHEN (incumbent = 'persistence' AND bpt) OR (incumbent = 'trend' AND btp) THEN 'challenged' ELSE 'held' END WHEN bsp OR bst THEN 'won' WHEN usable THEN 'fell' ELSE 'none' END
  FROM (SELECT d.*, f.chosen AS previous, CASE f.chosen WHEN 'persistence' THEN d.sp WHEN 'trend' THEN d.st END IS NOT NULL AS usable, CASE WHEN CASE f.chosen WHEN 'persistence' THEN d.sp WHEN 'trend' THEN d.st END >= 0 THEN f.chosen END AS incumbent,
    {", ".join(f"{c} AS b{k}" for k, c in _BEATS.items())} FROM f JOIN d ON d.series_id = f.series_id AND d.no = f.no + 1))
 SELECT series_id, part, parts, origins, previous, incumbent, chosen, path FROM f WHERE no > 0""",
)
def k12s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A training every three days, on the evidence of its own and the two before it."""
    errors = arm_costs(spark, sf_dir).select("series_id", "t", F.floor(F.col("t") / PART).alias("part"), *[F.element_at("c", i + 1).alias(a) for i, a in enumerate(ARMS)])
    return choices.incumbent_choice(errors, ARMS[0], ARMS[1:], DRAWS, BLOCK, SEED, POOL, GAIN)


#: Which recipe of a challenger is on offer at a look: column and SQL alike.
RECIPES = {"lstm": "(t // 432000) % 2", "statistical": "(t // 777600) % 2"}
_AT = {"lstm": "l", "statistical": "s"}
_KEPT = ", ".join(f"CASE WHEN r.{m}_recipe = {i} THEN CASE WHEN r.naive_trusted AND r.{m}_enters THEN coalesce(k.{a}{i}, r.t) END ELSE k.{a}{i} END AS {a}{i}" for m, a in _AT.items() for i in (0, 1))
_IN = {m: f"{m}_trusted AND ((coalesce(was, '') = '{m}' AND naive_trusted AND {m}_stays AND {m}_recipe = recipe) OR coalesce(t - CASE {m}_recipe WHEN 0 THEN {a}0 ELSE {a}1 END >= 14400, false))" for m, a in _AT.items()}


@query(
    "k11_recipe_fallback",
    f"""WITH RECURSIVE {H}, r AS MATERIALIZED (SELECT series_id, t, {", ".join(f"{c} AS {k}" for k, c in LOOKS.items())}, {", ".join(f"{c} AS {m}_recipe" for m, c in RECIPES.items())}, row_number() OVER (PARTITION BY series_id ORDER BY t) AS n FROM h),
 k AS (SELECT DISTINCT series_id, 0::BIGINT AS n, 0::BIGINT AS t, NULL::VARCHAR AS used, NULL::BIGINT AS recipe, NULL::BIGINT AS l0, NULL::BIGINT AS l1, NULL::BIGINT AS s0, NULL::BIGINT AS s1, 0::INTEGER AS switches FROM r
  UNION ALL SELECT series_id, n, t, used, CASE WHEN used IS NOT DISTINCT FROM was THEN recipe WHEN used = 'lstm' THEN lstm_recipe WHEN used = 'statistical' THEN statistical_recipe END, l0, l1, s0, s1, switches + (used IS DISTINCT FROM was)::INTEGER
  FROM (SELECT *, CASE WHEN {_IN["lstm"]} THEN 'lstm' WHEN {_IN["statistical"]} THEN 'statistical' WHEN naive_trusted THEN 'naive' END AS used
   FROM (SELECT r.*, k.used AS was, k.recipe, k.switches, {_KEPT} FROM k JOIN r ON r.series_id = k.series_id AND r.n = k.n + 1)))
 SELECT series_id, t, used, switches FROM k WHERE n > 0""",
)
def k11s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fallback order where each challenger's recipe changes every few days."""
    recipes = [F.expr(c.replace("//", "div")).cast("string").alias(f"{m}_recipe") for m, c in RECIPES.items()]
    return evaluation.fallback(hourly(spark, sf_dir).select("series_id", "t", *[F.expr(c).alias(k) for k, c in LOOKS.items()], *recipes), 4 * HOUR)


ALPHAS = [k / 20 for k in range(1, 20)]


@query(
    "f11_theta",
    f"""WITH RECURSIVE {G}, fl AS (SELECT series_id, t, last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS value FROM g),
 o AS (SELECT series_id, t AS origin FROM fl WHERE t % {DAY} = 0), w AS (SELECT o.series_id, o.origin, fl.t, fl.value, row_number() OVER (PARTITION BY o.series_id, o.origin ORDER BY fl.t) AS i FROM o JOIN fl ON fl.series_id = o.series_id AND fl.t > o.origin - {7 * DAY} AND fl.t <= o.origin),
 x AS (SELECT *, greatest({LEAST_INDEX}, avg(value) OVER (PARTITION BY series_id, origin, t % {DAY}) / avg(value) OVER (PARTITION BY series_id, origin)) AS idx FROM w),
 d AS MATERIALIZED (SELECT series_id, origin, t, i, idx, value / idx AS v FROM x),
 z AS MATERIALIZED (SELECT series_id, origin, count(*) AS n, regr_slope(v, i) AS b FROM d GROUP BY 1, 2),
 f AS (SELECT series_id, origin, i, k / 20.0::DOUBLE AS alpha, v AS level, 0.0::DOUBLE AS sse FROM d JOIN z USING (series_id, origin), range(1, 20) y(k) WHERE i = 1 AND n >= 48
  UNION ALL SELECT d.series_id, d.origin, d.i, alpha, alpha * v + (1 - alpha) * level, sse + (v - level) * (v - level) FROM f JOIN d ON d.series_id = f.series_id AND d.origin = f.origin AND d.i = f.i + 1),
 best AS (SELECT f.*, n, b, row_number() OVER (PARTITION BY f.series_id, f.origin ORDER BY round(sse, 6), alpha) AS r FROM f JOIN z ON z.series_id = f.series_id AND z.origin = f.origin AND z.n = f.i)
 SELECT o.series_id, o.origin, s.step::INTEGER AS step, o.origin + s.step * 3600 AS target, alpha, CASE WHEN level IS NOT NULL THEN round(greatest(0.0, (level + 0.5 * b * (s.step - 1 + 1 / alpha - pow(1 - alpha, n) / alpha)) * d.idx), 4) END AS predicted
 FROM o CROSS JOIN range(1, 7) s(step) LEFT JOIN best ON best.series_id = o.series_id AND best.origin = o.origin AND best.r = 1
 LEFT JOIN d ON d.series_id = o.series_id AND d.origin = o.origin AND d.t = o.origin + s.step * 3600 - {DAY}""",
)
def f11s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each series at each midnight, from its grid filled forward over seven days."""
    whole = forward_fill(grid(spark, sf_dir)).select("series_id", "t", F.col("filled").cast("double").alias("value"))
    return rounded(theta(whole, DAY, 6, HOUR, 7 * DAY, DAY, ALPHAS), "predicted", places=4)
