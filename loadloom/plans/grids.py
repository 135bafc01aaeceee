"""Queries on sources, cleaning, grids and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loadloom.functions.scalars import day_phase, decision_source, floor_to
from loadloom.operators import aggregates, grid as ops, windows
from loadloom.plans.registry import DAY, E, G, H, HOUR, START, events, grid, hourly, query, rounded
from loadloom.session import read_table

MASK = ((START + 5 * DAY, START + 5 * DAY + 6 * HOUR, "upgrade"), (START + 5 * DAY + 3 * HOUR, START + 6 * DAY, "outage"), (START + 20 * DAY, START + 20 * DAY + HOUR, "probe"))
MASK_SQL = ", ".join(f"({i}, {a}, {b}, '{r}')" for i, (a, b, r) in enumerate(MASK))
CUTOFF = START + 25 * DAY


@query("s01_read_samples", f"WITH {E} SELECT series_id, t, round(avg(value), 6) AS value FROM e WHERE t BETWEEN {START} AND {START + 10 * DAY} GROUP BY 1, 2")
def s01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.average_samples(events(spark, sf_dir), START, START + 10 * DAY), "value")


@query(
    "s03_parse_json_events",
    """SELECT event_id, event_type, json_valid(props) AS parsed, floor(epoch_us(ts) / 1000000)::BIGINT AS t FROM events WHERE json_valid(props)""",
)
def s03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose JSON column parses; the rest would go to a reject table."""
    from loadloom.functions.scalars import epoch_seconds

    rows = read_table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "map<string,string>"))
    return rows.where("p is not null").select("event_id", "event_type", F.lit(True).alias("parsed"), epoch_seconds(F.col("ts")).alias("t"))


@query(
    "s07_latest_chunk_wins",
    f"""WITH {E}, c AS (SELECT series_id, t // 600 * 600 AS t, ord % 3 AS chunk, value FROM e),
 r AS (SELECT *, row_number() OVER (PARTITION BY series_id, t ORDER BY chunk DESC, value DESC) AS r FROM c)
 SELECT series_id, t, chunk, round(value, 6) AS value FROM r WHERE r = 1""",
)
def s07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later chunk overrides an earlier one at the same time; one aggregation, no sort of whole groups."""
    rows = events(spark, sf_dir).select("series_id", floor_to(F.col("t"), 600).alias("t"), (F.col("ord") % 3).alias("chunk"), "value")
    last = rows.groupBy("series_id", "t").agg(F.max(F.struct("chunk", "value")).alias("m"))
    return rounded(last.select("series_id", "t", "m.chunk", "m.value"), "value")


@query(
    "s08_first_receipt_and_corrections",
    f"""WITH {E}, r AS (SELECT series_id, t // 3600 * 3600 AS t, ord AS received, round(value, 0) AS v FROM e),
 f AS (SELECT series_id, t, arg_min(v, received) AS first_value FROM r GROUP BY 1, 2)
 SELECT f.series_id, f.t, any_value(f.first_value) AS value, count(*) FILTER (WHERE r.v <> f.first_value) AS corrections
 FROM f JOIN r ON r.series_id = f.series_id AND r.t = f.t GROUP BY 1, 2""",
)
def s08(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("series_id", floor_to(F.col("t"), HOUR).alias("t"), F.col("ord").alias("received"), F.round("value", 0).alias("v"))
    first = rows.groupBy("series_id", "t").agg(F.min_by("v", "received").alias("value"))
    return rows.join(first, ["series_id", "t"]).groupBy("series_id", "t", "value").agg(F.count_if(F.col("v") != F.col("value")).alias("corrections"))


@query(
    "c01_grid_snap",
    f"""WITH {E}, s AS (SELECT *, floor((t + 300) / 600)::BIGINT * 600 AS slot FROM e),
 n AS (SELECT * FROM s WHERE abs(t - slot) <= 30), r AS (SELECT *, row_number() OVER (PARTITION BY series_id, slot ORDER BY t DESC, ord DESC) AS r FROM n)
 SELECT series_id, slot AS t, round(value, 6) AS value FROM r WHERE r = 1""",
)
def c01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.snap(events(spark, sf_dir), 600, 30), "value")


@query(
    "c01_snap_reasons",
    f"""WITH {E}, s AS (SELECT *, floor((t + 300) / 600)::BIGINT * 600 AS slot FROM e)
 SELECT series_id, count(*) AS points, count(*) FILTER (WHERE abs(t - slot) > 30) AS off_grid,
  count(*) FILTER (WHERE abs(t - slot) <= 30) - count(DISTINCT CASE WHEN abs(t - slot) <= 30 THEN slot END) AS duplicates FROM s GROUP BY 1""",
)
def c01r(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.snap_reasons(events(spark, sf_dir), 600, 30)


@query("c02_settled_slots", f"WITH {E} SELECT series_id, t // 600 * 600 AS slot, count(*) AS n FROM e WHERE t <= ({CUTOFF} - 120) // 600 * 600 GROUP BY 1, 2")
def c02(spark: SparkSession, sf_dir: str) -> DataFrame:
    visible = events(spark, sf_dir).where(F.col("t") <= (CUTOFF - 120) // 600 * 600)
    return visible.groupBy("series_id", floor_to(F.col("t"), 600).alias("slot")).agg(F.count("*").alias("n"))


@query("c03_mask_counts", f"WITH {H}, m(no, a, b, reason) AS (VALUES {MASK_SQL}), x AS (SELECT series_id, h.t, min(no) AS no FROM h JOIN m ON h.t BETWEEN a AND b GROUP BY 1, 2) SELECT x.no, m.reason, count(*) AS dropped FROM x JOIN m ON m.no = x.no GROUP BY 1, 2")
def c03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.mask_counts(hourly(spark, sf_dir), MASK)


@query("c03_mask_points", f"WITH {H}, m(no, a, b, reason) AS (VALUES {MASK_SQL}) SELECT series_id, t, value FROM h WHERE NOT EXISTS (SELECT 1 FROM m WHERE h.t BETWEEN a AND b)")
def c03p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.mask_points(hourly(spark, sf_dir), MASK)


@query("c04_normalize", f"WITH {E}, b AS (SELECT series_id, avg(value) AS base FROM e GROUP BY 1) SELECT e.series_id, e.ord, round(value * 1000 / 250 * 100, 4) AS cpu_percent, round(value / nullif(base, 0) * 100, 4) AS base_percent FROM e JOIN b ON b.series_id = e.series_id")
def c04(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    base = e.groupBy("series_id").agg(F.avg("value").alias("base"))  # one row for each series
    return e.join(base, "series_id").select("series_id", "ord", F.round(F.col("value") * 1000 / 250 * 100, 4).alias("cpu_percent"), F.round(F.col("value") / F.nullif("base", F.lit(0.0)) * 100, 4).alias("base_percent"))


@query("c05_reject_reasons", f"WITH {E} SELECT CASE WHEN value IS NULL THEN 'missing' WHEN value < 1 THEN 'too_small' WHEN t % 60 > 30 THEN 'off_grid' WHEN t >= {CUTOFF} THEN 'out_of_chunk' ELSE 'ok' END AS reason, count(*) AS n FROM e GROUP BY 1")
def c05(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("value").isNull(), "missing").when(F.col("value") < 1, "too_small").when(F.col("t") % 60 > 30, "off_grid").when(F.col("t") >= CUTOFF, "out_of_chunk").otherwise("ok")
    return events(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("c06_state_domain", "SELECT count(*) AS n, count(*) FILTER (WHERE quality NOT IN (0, 1) OR quality IS NULL) AS bad_quality, count(*) FILTER (WHERE toxic NOT IN (0, 1) OR toxic IS NULL) AS bad_toxic FROM labels")
def c06(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = lambda c: F.count_if(F.col(c).isNull() | ~F.col(c).isin(0, 1))
    return read_table(spark, sf_dir, "labels").agg(F.count("*").alias("n"), bad("quality").alias("bad_quality"), bad("toxic").alias("bad_toxic"))


@query("c07_merge_conflicts", f"WITH {E}, k AS (SELECT series_id, t // 60 AS minute, round(value, 0) AS v FROM e) SELECT series_id, minute, min(v) AS low, max(v) AS high, count(*) AS n, min(v) <> max(v) AS conflict FROM k GROUP BY 1, 2")
def c07(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = events(spark, sf_dir).select("series_id", F.floor(F.col("t") / 60).alias("minute"), F.round("value", 0).alias("v"))
    return k.groupBy("series_id", "minute").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n")).withColumn("conflict", F.col("low") != F.col("high"))


@query(
    "c08_eligibility_funnel",
    f"""WITH {E}, d AS (SELECT user_id, t // 86400 AS day, count(*) AS n FROM e GROUP BY 1, 2),
 u AS (SELECT user_id, count(*) AS days, avg(n) AS mean, count(*) / 30.0 AS active FROM d GROUP BY 1)
 SELECT count(*) AS users, count(*) FILTER (WHERE days >= 10) AS present, count(*) FILTER (WHERE days >= 10 AND mean >= 2) AS busy,
  count(*) FILTER (WHERE days >= 10 AND mean >= 2 AND active >= 0.9) AS eligible FROM u""",
)
def c08(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("t") / DAY).alias("day")).agg(F.count("*").alias("n"))
    u = d.groupBy("user_id").agg(F.count("*").alias("days"), F.avg("n").alias("mean"))
    present, busy, active = F.col("days") >= 10, F.col("mean") >= 2, F.col("days") / 30 >= 0.9
    return u.agg(F.count("*").alias("users"), F.count_if(present).alias("present"), F.count_if(present & busy).alias("busy"), F.count_if(present & busy & active).alias("eligible"))


@query(
    "c09_decision_source",
    """WITH d AS (SELECT o_orderkey % 5 AS desired, o_custkey % 5 AS cur, o_orderkey % 3 AS pred, o_custkey % 3 AS rea FROM orders)
 SELECT CASE WHEN desired = cur THEN 'keep_current' WHEN desired = 0 THEN 'min' WHEN desired = 4 THEN 'max' WHEN pred = rea AND desired = pred THEN 'tie'
  WHEN desired = pred THEN 'prediction' ELSE 'reactive' END AS source, count(*) AS n FROM d GROUP BY 1""",
)
def c09(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = F.col("o_orderkey"), F.col("o_custkey")
    return read_table(spark, sf_dir, "orders").groupBy(decision_source(o % 5, k % 5, o % 3, k % 3, F.lit(0), F.lit(4)).alias("source")).agg(F.count("*").alias("n"))


@query("g01_regularize", f"WITH {G} SELECT * FROM g")
def g01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir)


@query("g02_forward_fill", f"WITH {G} SELECT series_id, t, value, last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS filled FROM g")
def g02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.forward_fill(grid(spark, sf_dir))


GAPS = f"""{H}, m(no, a, b, reason) AS (VALUES {MASK_SQL}),
 p AS (SELECT series_id, t AS a, lead(t) OVER w AS b, value AS va, lead(value) OVER w AS vb FROM h WINDOW w AS (PARTITION BY series_id ORDER BY t)),
 j AS (SELECT *, ((b - a) // 3600 - 1)::INTEGER AS missing FROM p WHERE b - a > 3600),
 q AS (SELECT *, CASE WHEN a % 3600 <> 0 OR b % 3600 <> 0 THEN 'off_grid' WHEN missing > 3 THEN 'too_long' WHEN b > {CUTOFF} THEN 'after_cutoff'
  WHEN EXISTS (SELECT 1 FROM m WHERE m.a < j.b AND m.b > j.a) THEN 'masked' ELSE 'filled' END AS reason FROM j)"""


@query("g03_judge_gaps", f"WITH {GAPS} SELECT series_id, a, b, va, vb, missing, reason FROM q")
def g03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.judge_gaps(hourly(spark, sf_dir), HOUR, 3, CUTOFF, MASK)


FILLED = GAPS + """, f AS (SELECT series_id, t, value, false AS imputed FROM h UNION ALL
 SELECT series_id, a + k * 3600, va + (vb - va) * k / (missing + 1), true FROM (SELECT *, unnest(range(1, missing + 1)) AS k FROM q WHERE reason = 'filled'))"""


@query("g03_fill_gaps", f"WITH {FILLED} SELECT series_id, t, round(value, 6) AS value, imputed FROM f")
def g03f(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hourly(spark, sf_dir)
    return rounded(ops.fill_gaps(h, ops.judge_gaps(h, HOUR, 3, CUTOFF, MASK), HOUR), "value")


@query("g05_capped_windows")
def g05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held against a plain loop over slots in the tests."""
    h = hourly(spark, sf_dir)
    return ops.capped_windows(h, ops.judge_gaps(h, HOUR, 3, CUTOFF, MASK), HOUR, 0.05)


RUNS = H + ", i AS (SELECT *, t - 3600 * row_number() OVER (PARTITION BY series_id ORDER BY t) AS k FROM h), r AS (SELECT series_id, min(t) AS \"start\", max(t) AS \"end\", count(*) AS slots FROM i GROUP BY series_id, k)"


@query("g04_longest_run", f"""WITH {RUNS} SELECT series_id, "start", "end", slots FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY slots DESC, "start") AS n FROM r) WHERE n = 1""")
def g04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.longest_run(hourly(spark, sf_dir), HOUR)


@query("g12_run_ending_at", f"""WITH {RUNS}, x AS (SELECT series_id, least(({CUTOFF} - "start") // 3600 + 1, 48) AS slots FROM r WHERE "start" <= {CUTOFF} AND "end" >= {CUTOFF} AND ({CUTOFF} - "start") // 3600 + 1 >= 2)
 SELECT series_id, {CUTOFF} - (slots - 1) * 3600 AS "start", {CUTOFF}::BIGINT AS "end", slots FROM x""")
def g12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.run_ending_at(hourly(spark, sf_dir), HOUR, CUTOFF, 2, 48)


@query(
    "g07_coverage_gaps",
    f"""WITH {E}, p AS (SELECT DISTINCT series_id, t FROM e WHERE t BETWEEN {START + DAY} AND {START + 20 * DAY}),
 x AS (SELECT series_id, lag(t) OVER (PARTITION BY series_id ORDER BY t) AS a, t AS b, false AS open_left, false AS open_right FROM p
  UNION ALL SELECT series_id, {START + DAY}, min(t), true, false FROM p GROUP BY 1 UNION ALL SELECT series_id, max(t), {START + 20 * DAY}, false, true FROM p GROUP BY 1)
 SELECT * FROM x WHERE b - a > 3000""",
)
def g07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.coverage_gaps(events(spark, sf_dir).select("series_id", "t").distinct(), START + DAY, START + 20 * DAY, 3000)


@query(
    "g08_gap_stats",
    f"""WITH {H}, x AS (SELECT *, lead(t) OVER (PARTITION BY series_id ORDER BY t) - t - 3600 AS apart FROM h WHERE t >= {START} AND t < {START + 30 * DAY})
 SELECT series_id, 720::BIGINT AS expected, count(*) AS present, 720 - count(*) AS missing, greatest(max(apart), min(t) - {START}, {START + 30 * DAY - 3600} - max(t)) AS longest_gap FROM x GROUP BY 1""",
)
def g08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.gap_stats(hourly(spark, sf_dir), START, START + 30 * DAY, HOUR)


@query(
    "g10_bad_state_runs",
    f"""WITH {H}, s AS (SELECT series_id, t, value > 4 AS bad, lag(t) OVER w AS before, lead(t) OVER w AS after, row_number() OVER w AS n,
  row_number() OVER (PARTITION BY series_id, value > 4 ORDER BY t) AS k FROM h WINDOW w AS (PARTITION BY series_id ORDER BY t))
 SELECT series_id, min(t) AS first_bad, max(t) AS last_bad, arg_min(coalesce(before, -1), t) AS healthy_before, arg_max(coalesce(after, -1), t) AS healthy_after, count(*) AS points
 FROM s WHERE bad GROUP BY series_id, n - k""",
)
def g10(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = hourly(spark, sf_dir).select("series_id", "t", (F.col("value") > 4).alias("bad"))
    return ops.state_runs(states).fillna(-1, ["healthy_before", "healthy_after"])


@query(
    "g11_longest_over",
    f"""WITH {H}, o AS (SELECT *, t - 3600 * row_number() OVER (PARTITION BY series_id ORDER BY t) AS k FROM h WHERE value > 3),
 r AS (SELECT series_id, count(*) AS n FROM o GROUP BY series_id, k), m AS (SELECT series_id, max(n) AS longest FROM r GROUP BY 1), a AS (SELECT DISTINCT series_id FROM h)
 SELECT a.series_id, coalesce(longest, 0)::BIGINT AS longest, coalesce(longest, 0) >= 6 AS alarm FROM a LEFT JOIN m ON m.series_id = a.series_id""",
)
def g11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.longest_over(hourly(spark, sf_dir), HOUR, 3, 6)


@query(
    "g14_eligible_origins",
    f"""WITH {G}, x AS (SELECT *, sum(CASE WHEN value IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS n FROM g)
 SELECT series_id, t FROM x WHERE value IS NOT NULL AND n = 6""",
)
def g14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.eligible_origins(grid(spark, sf_dir).withColumn("imputed", F.lit(False)), 6)


@query("t01_latest_n", f"WITH {E} SELECT series_id, t, ord FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t DESC, ord DESC) AS r FROM e) WHERE r <= 64")
def t01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.latest(events(spark, sf_dir), 64, F.desc("t"), F.desc("ord")).select("series_id", "t", "ord")


@query(
    "t03_volume_strata",
    f"""WITH {E}, m AS (SELECT user_id, count(*) AS n FROM e GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n, user_id) AS r, count(*) OVER () AS total FROM m)
 SELECT user_id, n, ((r - 1) * 3 // total)::INTEGER AS stratum FROM r""",
)
def t03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strata of equal count by volume. Ranks come from the counts of each volume, so no task sorts all users."""
    from pyspark.sql import Window

    users = events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"))
    sizes = users.groupBy("n").agg(F.count("*").alias("c"))  # one row for each different volume
    before = sizes.withColumns({"before": F.coalesce(F.sum("c").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("c").over(Window.partitionBy())})
    ranked = users.join(before, "n").withColumn("r", F.col("before") + F.row_number().over(Window.partitionBy("n").orderBy("user_id")) - 1)
    return ranked.select("user_id", "n", F.floor(F.col("r") * 3 / F.col("total")).cast("int").alias("stratum"))


@query("t05_keep_first", f"WITH {E} SELECT series_id, t // 3600 AS hour, arg_min(ord, t * 1000000 + ord) AS ord FROM e GROUP BY 1, 2")
def t05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("series_id", F.floor(F.col("t") / HOUR).alias("hour")).agg(F.min_by("ord", F.struct("t", "ord")).alias("ord"))


@query("u02_answered_by_both", f"WITH {E} SELECT t // 86400 AS day, user_id FROM e WHERE series_id = 'click' INTERSECT SELECT t // 86400, user_id FROM e WHERE series_id = 'view'")
def u02(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = lambda s: events(spark, sf_dir).where(F.col("series_id") == s).select(F.floor(F.col("t") / DAY).alias("day"), "user_id")
    return cells("click").intersect(cells("view"))


@query("u03_absent_days", f"WITH {E}, u AS (SELECT DISTINCT user_id FROM e), d AS (SELECT unnest(range({START // DAY}, {START // DAY + 30})) AS day) SELECT user_id, day FROM u, d EXCEPT SELECT user_id, t // 86400 FROM e")
def u03(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("user_id", F.floor(F.col("t") / DAY).alias("day")).distinct()
    return e.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(START // DAY).cast("bigint"), F.lit(START // DAY + 29).cast("bigint"))).alias("day")).join(e, ["user_id", "day"], "left_anti")


@query("fn_day_phase", f"WITH {E} SELECT CASE WHEN t // 3600 % 24 BETWEEN 6 AND 14 THEN 'rising' WHEN t // 3600 % 24 = 15 THEN 'peak' WHEN t // 3600 % 24 BETWEEN 16 AND 20 THEN 'falling' ELSE 'trough' END AS phase, count(*) AS n FROM e GROUP BY 1")
def fn_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy(day_phase(F.floor(F.col("t") / HOUR) % 24).alias("phase")).agg(F.count("*").alias("n"))


@query("a20_conflicts", "SELECT o_custkey, o_orderstatus, count(*) AS n, count(DISTINCT o_orderpriority) = 1 AS identical FROM orders GROUP BY 1, 2")
def a20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.conflicts(read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority"), "o_custkey", "o_orderstatus")
