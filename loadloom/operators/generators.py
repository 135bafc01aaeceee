"""Generators of load against their heartbeats, and counters at boundaries that no sample falls on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loadloom.operators.grid import by_series
from loadloom.operators.ranges import carry_forward, running_total

FINDING = ("series_id", "kind", "first", "last", "n")


def _line(intervals: DataFrame, slack: int) -> DataFrame:
    """Starts (+1) and ends (-1) of closed intervals, a start before an end at the same time."""
    start = F.struct((F.col("begin") - slack).alias("t"), F.lit(0).alias("kind"), F.lit(1).alias("delta"))
    end = F.struct((F.col("last") + slack).alias("t"), F.lit(2).alias("kind"), F.lit(-1).alias("delta"))
    return intervals.select("series_id", F.explode(F.array(start, end)).alias("e")).select("series_id", "e.*")


def overlaps_by_sweep(intervals: DataFrame, width: int) -> DataFrame:
    """Maximal times at which two or more intervals (series_id, begin, last) are open: first, last, n (most at once).

    Starts and ends are swept in order of time with a running count, so the work is that of sorting; pairs are never formed.
    """
    order = ["t", "kind"]
    # what starts or ends at one instant is one step of the sweep
    steps = _line(intervals, 0).groupBy("series_id", "t", "kind").agg(F.sum("delta").alias("delta"))
    swept = running_total(steps, "delta", order, width, "open").withColumn("opened", F.when((F.col("delta") > 0) & (F.col("open") >= 2) & (F.col("open") - F.col("delta") < 2), F.col("t")))
    swept = carry_forward(swept, "opened", order, width, "first")
    inside = (F.col("open") >= 2) | ((F.col("delta") < 0) & (F.col("open") - F.col("delta") >= 2))
    return swept.where(inside).groupBy("series_id", "first").agg(F.max("t").alias("last"), F.max("open").alias("n"))


def orphan_beats(intervals: DataFrame, beats: DataFrame, slack: int, gap: int, width: int) -> DataFrame:
    """Groups (no two neighbours over ``gap`` apart) of heartbeats at which no interval, widened by ``slack``, is open: first, last, n."""
    seen = beats.select("series_id", "t", F.lit(1).alias("kind"), F.lit(0).alias("delta"))
    line = running_total(_line(intervals, slack).unionByName(seen), "delta", ["t", "kind"], width, "open").where("kind = 1 and open = 0").groupBy("series_id", "t").agg(F.count("*").alias("beats"))
    line = carry_forward(line, "t", ["t"], width, "before", strict=True)
    line = line.withColumn("opened", F.when(F.coalesce(F.col("t") - F.col("before") > gap, F.lit(True)), F.col("t")))
    return carry_forward(line, "opened", ["t"], width, "first").groupBy("series_id", "first").agg(F.max("t").alias("last"), F.sum("beats").alias("n"))


def beat_gaps(beats: DataFrame, lo: int, hi: int, limit: int, width: int) -> DataFrame:
    """Times over ``limit`` without a heartbeat in [lo, hi], the edges among them: kind (gap, gap_open_left, gap_open_right), first, last."""
    line = carry_forward(beats.select("series_id", "t").distinct(), "t", ["t"], width, "before", strict=True)
    inner = line.where(F.col("t") - F.coalesce("before", F.lit(lo)) > limit).select("series_id", F.when(F.col("before").isNull(), "gap_open_left").otherwise("gap").alias("kind"), F.coalesce("before", F.lit(lo)).alias("first"), F.col("t").alias("last"))
    right = beats.groupBy("series_id").agg(F.max("t").alias("first")).where(F.lit(hi) - F.col("first") > limit)
    return inner.unionByName(right.select("series_id", F.lit("gap_open_right").alias("kind"), "first", F.lit(hi).cast("bigint").alias("last")))


def generator_findings(intervals: DataFrame, beats: DataFrame, lo: int, hi: int, slack: int, orphan_gap: int, limit: int, width: int) -> DataFrame:
    """What is wrong with the generators of each series, as (series_id, kind, first, last, n): overlap, orphan, and the kinds of gaps."""
    told = overlaps_by_sweep(intervals, width).withColumn("kind", F.lit("overlap")).select(*FINDING)
    told = told.unionByName(orphan_beats(intervals, beats, slack, orphan_gap, width).withColumn("kind", F.lit("orphan")).select(*FINDING))
    return told.unionByName(beat_gaps(beats, lo, hi, limit, width).withColumn("n", F.lit(0).cast("bigint")).select(*FINDING))


def _slope(t0: Column, v0: Column, t1: Column, v1: Column, max_gap: int) -> Column:
    """A counter's rate between neighbours, NULL over a gap or a reset."""
    return F.when((t1 > t0) & (t1 - t0 <= max_gap) & (v1 >= v0), (v1 - v0) / (t1 - t0))


def at_boundaries(samples: DataFrame, every: int, max_gap: int) -> DataFrame:
    """A counter (series_id, t, value; one sample a time) at each multiple of ``every`` from its first sample to its last.

    A row for each boundary: value, lo, hi (the samples around it), err, width, unknown (gap or reset, else NULL). At a sample it
    is exact. Between two it is the mean of two lines, one through the pair before and one through the pair after, each kept
    within the samples; their disagreement is the error, beside one for the counter's grain. With one line, or none (then
    between the samples), the error is half their difference.
    """
    w = by_series()
    x = samples.select("series_id", F.col("t").alias("ta"), F.col("value").alias("va"), *[F.lead(c, k).over(w).alias(f"{c}{k}") for k in (1, 2) for c in ("t", "value")], *[F.lag(c, 1).over(w).alias(f"{c}_") for c in ("t", "value")])
    first = F.ceil(F.col("ta") / every).cast("bigint") * every
    last = F.coalesce(F.col("t1") - 1, F.col("ta"))
    at = x.where(first <= last).withColumn("boundary", F.explode(F.sequence(first, last, F.lit(every).cast("bigint"))))
    ta, va, tb, vb, b = (F.col(c) for c in ("ta", "va", "t1", "value1", "boundary"))
    exact = b == ta
    unknown = F.when(~exact & (tb - ta > max_gap), "gap").when(~exact & (vb < va), "reset")
    clamp = lambda v: F.when(v.isNotNull(), F.least(F.greatest(v, va), vb))
    left = clamp(va + _slope(F.col("t_"), F.col("value_"), ta, va, max_gap) * (b - ta))
    right = clamp(vb - _slope(tb, vb, F.col("t2"), F.col("value2"), max_gap) * (tb - b))
    at = at.withColumns({"exact": exact, "unknown": unknown, "left": left, "right": right})
    both = F.col("left").isNotNull() & F.col("right").isNotNull()
    value = F.when(F.col("exact"), va).when(both, (F.col("left") + F.col("right")) / 2).otherwise(F.coalesce("left", "right", va + (vb - va) * (b - ta) / (tb - ta)))
    err = F.when(F.col("exact"), 0.0).when(both, F.abs(F.col("left") - F.col("right")) / 2 + 1).otherwise((vb - va) / 2 + 1)
    known = F.col("unknown").isNull()
    return at.select("series_id", "boundary", "unknown", *[F.when(known, c).alias(n) for n, c in (("value", value), ("lo", va), ("hi", F.when(F.col("exact"), va).otherwise(vb)), ("err", err), ("width", F.when(F.col("exact"), 0).otherwise(tb - ta)))])


def received_between(samples: DataFrame, spans: DataFrame, every: int, max_gap: int) -> DataFrame:
    """What a counter received in each span [start, start + every) of ``spans`` (series_id, start): state, received, least, most, err, max_gap.

    State: ok; reset (a boundary or two samples inside show one); absent (no samples of the series); gap. The bounds come from the
    samples around both boundaries and hold whatever happened between them.
    """
    at = at_boundaries(samples, every, max_gap)
    w = by_series()
    pairs = samples.select("series_id", "t", "value", F.lead("t").over(w).alias("t1"), F.lead("value").over(w).alias("v1"), F.expr(f"t div {every} * {every}").alias("start"))
    inside = pairs.where(F.col("t1") <= F.col("start") + every).groupBy("series_id", "start").agg(F.max(F.col("t1") - F.col("t")).alias("apart"), F.max(F.col("v1") < F.col("value")).alias("fell"))
    edge = lambda p, shift: at.select("series_id", (F.col("boundary") - shift).alias("start"), *[F.col(c).alias(f"{p}_{c}") for c in ("unknown", "value", "lo", "hi", "err", "width")])
    known = samples.select("series_id").distinct().withColumn("sampled", F.lit(True))
    x = spans.join(known, "series_id", "left").join(inside, ["series_id", "start"], "left").join(edge("a", 0), ["series_id", "start"], "left").join(edge("b", every), ["series_id", "start"], "left")
    reset = (F.col("a_unknown") == "reset") | (F.col("b_unknown") == "reset") | F.col("fell")
    good = F.col("a_value").isNotNull() & F.col("b_value").isNotNull() & (F.coalesce("apart", F.lit(0)) <= max_gap)
    state = F.when(F.col("sampled").isNull(), "absent").when(F.coalesce(reset, F.lit(False)), "reset").when(good, "ok").otherwise("gap")
    x = x.withColumn("state", state)
    ok = lambda c: F.when(F.col("state") == "ok", c)
    return x.select(
        "series_id", "start", "state",
        ok(F.greatest(F.lit(0.0), F.col("b_value") - F.col("a_value"))).alias("received"),
        ok(F.greatest(F.lit(0.0), F.col("b_lo") - F.col("a_hi"))).alias("least"),
        ok(F.col("b_hi") - F.col("a_lo")).alias("most"),
        ok(F.col("a_err") + F.col("b_err")).alias("err"),
        ok(F.greatest(F.coalesce("apart", F.lit(0)), "a_width", "b_width")).alias("max_gap"),
    )
