"""Maturation, calibration, trust, capacity and evidence over issued forecasts and recorded telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loadloom.functions.scalars import ratio, required_replicas
from loadloom.operators.folds import fold_rows
from loadloom.operators.grid import by_series
from loadloom.operators.ranges import carry_forward


def window_outcomes(issued: DataFrame, receipts: DataFrame, now: int, settle: int, grace: int) -> DataFrame:
    """Judges each issued window once its last target has settled.

    ``issued``: series_id, origin, targets (array), bound; ``receipts``: series_id, t, value, received. A value counts if received by
    the last target plus settle and grace. Before the end plus settle a window is pending; with a target missing at the
    deadline it is unscorable; else its highest value is held against the bound.
    """
    end = F.array_max("targets")
    wanted = issued.select("series_id", "origin", "bound", end.alias("end"), F.size("targets").alias("n"), F.explode("targets").alias("t"))
    got = wanted.join(receipts, ["series_id", "t"], "left").withColumn("ok", F.col("received") <= F.col("end") + settle + grace)
    whole = got.groupBy("series_id", "origin", "bound", "end", "n").agg(F.count_if(F.coalesce("ok", F.lit(False))).alias("got"), F.max(F.when(F.col("ok"), F.col("value"))).alias("highest"))
    status = F.when(F.lit(now) < F.col("end") + settle, "pending").when(F.col("got") == F.col("n"), "scored").when(F.lit(now) < F.col("end") + settle + grace, "pending").otherwise("unscorable")
    scored = whole.withColumn("status", status)
    y = F.when(F.col("status") == "scored", F.col("highest"))
    return scored.select("series_id", "origin", "end", "status", y.alias("highest"), (y <= F.col("bound")).alias("covered"), (y - F.col("bound")).alias("residual"))


def queue_status(issued: DataFrame, observed: DataFrame, late: int, width: int = 86400) -> DataFrame:
    """Early, matched (seen at most ``late`` after the target) or dropped, from the first observation at or after the target.

    Time is read backwards, in ranges of ``width``, and the last observation met is carried along.
    """
    line = issued.select("series_id", (-F.col("target")).alias("t"), F.lit(1).alias("kind"), "key").unionByName(observed.select("series_id", (-F.col("t")).alias("t"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("key")))
    line = line.withColumn("at", F.when(F.col("kind") == 0, -F.col("t")))
    found = carry_forward(line, "at", ["t", "kind"], width, "seen").where("kind = 1")
    wait = F.col("seen") + F.col("t")
    return found.select("series_id", "key", F.when(F.col("seen").isNull(), "early").when(wait <= late, "matched").otherwise("dropped").alias("status"))


def upper_bounds(scores: DataFrame, a: float, seconds: int, most: int, least: int) -> DataFrame:
    """The k-th smallest of the scores of the last ``seconds`` (at most ``most``), k = ceil((n + 1)(1 - a)); NULL with a reason where
    there are under ``least`` or k is over their number. ``scores``: series_id, t, base, sigma, score (known at t)."""
    trail = by_series().rangeBetween(-seconds, -1)
    held = scores.withColumn("s", F.array_sort(F.slice(F.reverse(F.collect_list("score").over(trail)), 1, most)))
    n = F.size("s")
    k = F.ceil((n + 1) * F.lit(1 - a) - F.lit(1e-9)).cast("int")
    reason = F.when(n < least, "too_few").when(k > n, "beyond").otherwise("ok")
    out = held.withColumns({"n": n, "k": k, "reason": reason})
    bound = F.when(F.col("reason") == "ok", F.greatest(F.lit(0.0), F.col("base") + F.get("s", F.col("k") - 1) * F.col("sigma")))
    return out.select("series_id", "t", "n", "k", "reason", bound.alias("bound"))


def adaptive_level(outcomes: DataFrame, target: int, step: int, scale: int = 10**8) -> DataFrame:
    """Level in whole units of 1/scale after each series' outcomes (seq, missed): a + step * (target - missed), kept in [0, scale].

    The clip makes it depend on the order, so each series is folded by sequence number, with two numbers held; a repeated number
    counts once.
    """
    once = outcomes.groupBy("series_id", "seq").agg(F.min("missed").alias("missed"))

    def turn(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        (level, n), (series, seq, missed) = state, row
        level = max(0, min(scale, level + step * (target - (scale if missed else 0)) // scale))
        return (level, n + 1), (series, seq, level, n + 1)

    steps = fold_rows(once.select("series_id", "seq", "missed"), ["seq"], lambda: (target, 0), turn, "series_id string, seq long, level long, outcomes long")
    last = steps.groupBy("series_id").agg(F.max_by(F.struct("level", "outcomes"), "outcomes").alias("x"))
    return last.select("series_id", "x.level", "x.outcomes")


def paired_days(scored: DataFrame, one: str, other: str) -> DataFrame:
    """Sums of absolute errors by day of two predictors on the cells that both answered; a day is the unit of resampling."""
    e1, e2 = F.abs(F.col(one) - F.col("actual")), F.abs(F.col(other) - F.col("actual"))
    both = scored.where(e1.isNotNull() & e2.isNotNull())
    return both.groupBy("series_id", "day").agg(F.count("*").alias("cells"), F.sum(e1).alias("one"), F.sum(e2).alias("other"))


def draw(n: Column, draw_no: Column, place: Column, seed: int) -> Column:
    """A number in 0..n-1 from a 32-bit integer hash of (seed, draw, place), the same in any engine with 64-bit integers."""
    m = (1 << 32) - 1
    x = ((draw_no.cast("bigint") * 668265263 + place.cast("bigint") * 374761393 + seed * 974711) % (1 << 32)).cast("bigint")
    x = (x.bitwiseXOR(F.shiftright(x, 15)) * 40503) % (1 << 32)
    x = (x.bitwiseXOR(F.shiftright(x, 13)) * 60493) % (1 << 32)
    return F.pmod(x.bitwiseXOR(F.shiftright(x, 16)).bitwiseAND(F.lit(m)), n)


def day_bootstrap(days: DataFrame, draws: int, seed: int) -> DataFrame:
    """Relative improvement of ``one`` over ``other`` with whole days drawn again ``draws`` times: point, 2.5 % and 97.5 % points.

    Days are numbered in each series and joined to the drawn numbers; what is resampled is one row a day, whatever the
    number of forecasts.
    """
    w = Window.partitionBy("series_id")
    placed = days.withColumns({"i": F.row_number().over(w.orderBy("day")) - 1, "n": F.count("*").over(w)})
    asked = placed.select("series_id", "n", F.col("i").alias("place"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    asked = asked.select("series_id", "draw", draw(F.col("n"), F.col("draw"), F.col("place"), seed).cast("int").alias("i"))
    sums = asked.join(placed, ["series_id", "i"]).groupBy("series_id", "draw").agg(ratio(F.sum("other") - F.sum("one"), F.sum("other")).alias("gain"))
    ranked = sums.where("gain is not null").withColumns({"r": F.row_number().over(w.orderBy("gain", "draw")) - 1, "m": F.count("*").over(w)})
    at = lambda q: F.max(F.when(F.col("r") == F.floor(F.col("m") * F.lit(q)), F.col("gain")))
    ends = ranked.groupBy("series_id").agg(F.count("*").alias("draws"), at(0.025).alias("low"), at(0.975).alias("high"))
    point = days.groupBy("series_id").agg(ratio(F.sum("other") - F.sum("one"), F.sum("other")).alias("gain"))
    return point.join(ends, "series_id")


def block_choice(errors: DataFrame, baseline: str, candidates: list[str], draws: int, block: int, seed: int, least_gain: float, quantile: float = 0.1) -> DataFrame:
    """Which candidate takes the baseline's place in each series: the one with the largest gain of those that gain ``least_gain`` and whose
    gain stays above 0 at the ``quantile`` of ``draws`` moving-block resamples of the origins; else the baseline.

    ``errors``: series_id, t and a column of errors for each arm; origins that lack one are left out. Blocks are drawn as numbers
    and joined to numbered origins; a row for each candidate: gain, lower, beats, chosen.
    """
    arms, w = [baseline, *candidates], Window.partitionBy("series_id")
    placed = errors.dropna(subset=arms).withColumns({"i": F.row_number().over(w.orderBy("t")) - 1, "n": F.count("*").over(w)})
    asked = placed.groupBy("series_id").agg(F.max("n").alias("n")).withColumn("size", F.least(F.lit(block), F.col("n")).cast("int"))
    asked = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / F.col("size")).cast("int") - 1)).alias("b"))
    asked = asked.withColumn("first", draw(F.col("n") - F.col("size") + 1, F.col("draw"), F.col("b"), seed).cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("k"))
    asked = asked.where(F.col("b") * F.col("size") + F.col("k") < F.col("n")).select("series_id", "draw", (F.col("first") + F.col("k")).alias("i"))
    each = lambda ref: F.explode(F.array(*[F.struct(F.lit(c).alias("candidate"), F.lit(o).alias("place"), F.when(F.col(ref) > 0, (F.col(ref) - F.col(c)) / F.col(ref)).otherwise(0.0).alias("gain")) for o, c in enumerate(candidates)])).alias("g")
    sums = asked.join(placed, ["series_id", "i"]).groupBy("series_id", "draw").agg(*[F.sum(a).alias(a) for a in arms]).select("series_id", "draw", each(baseline)).select("series_id", "draw", "g.candidate", F.round("g.gain", 12).alias("gain"))
    ranked = sums.withColumn("r", F.row_number().over(Window.partitionBy("series_id", "candidate").orderBy("gain", "draw")) - 1)
    lower = ranked.where(F.col("r") == int(quantile * draws)).select("series_id", "candidate", F.col("gain").alias("lower"))
    point = placed.groupBy("series_id").agg(*[F.sum(a).alias(a) for a in arms]).select("series_id", each(baseline)).select("series_id", "g.*")
    judged = point.join(lower, ["series_id", "candidate"]).withColumn("beats", (F.col("gain") >= least_gain) & (F.col("lower") > 0))
    best = F.min(F.when(F.col("beats"), F.struct((-F.col("gain")).alias("g"), "place", "candidate"))).over(w)
    return judged.select("series_id", "candidate", "gain", "lower", "beats", F.coalesce(best["candidate"], F.lit(baseline)).alias("chosen"))


def holm(tests: DataFrame, level: float) -> DataFrame:
    """Step-down adjusted p-values in each family, and which are rejected. ``tests``: family, name, p; a few for a family."""
    w = Window.partitionBy("family").orderBy("p", "name")
    ranked = tests.withColumn("x", F.col("p") * (F.count("*").over(Window.partitionBy("family")) - F.row_number().over(w) + 1))
    adjusted = F.least(F.lit(1.0), F.max("x").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.select("family", "name", "p", adjusted.alias("adjusted"), (adjusted <= level).alias("rejected"))


def shortage(samples: DataFrame, seconds: int) -> DataFrame:
    """Needed replicas of each sample (rpm, ready) and the replica-minutes short or over until the next one."""
    need = required_replicas(F.col("rpm"))
    minutes = seconds / 60
    return samples.withColumns({"need": need, "short": F.greatest(need - F.col("ready"), F.lit(0)) * minutes, "over": F.greatest(F.col("ready") - need, F.lit(0)) * minutes})


def shortage_events(samples: DataFrame, lo: int, hi: int) -> DataFrame:
    """Maximal runs of short samples: largest deficit, length, and whether an end of [lo, hi] cuts them."""
    w = by_series()
    marked = samples.withColumn("bad", F.col("short") > 0)
    marked = marked.withColumn("run", F.sum(F.when(F.col("bad") == F.lag("bad").over(w), 0).otherwise(1)).over(w))
    found = marked.where("bad").groupBy("series_id", "run").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.max(F.col("need") - F.col("ready")).alias("deficit"), F.count("*").alias("samples"))
    return found.select("series_id", "start", "end", "deficit", "samples", (F.col("start") == lo).alias("left_cut"), (F.col("end") == hi).alias("right_cut"))


def minute_objectives(minutes: DataFrame, p95: float, p99: float, bad_share: float) -> DataFrame:
    """Whether each minute kept its objectives; unknown where latency was not measured."""
    share = ratio(F.col("failed"), F.col("requests"))
    state = F.when(F.col("p95").isNull(), "unknown").when((F.col("p95") > p95) | (F.col("p99") > p99) | (share > bad_share), "violated").otherwise("kept")
    return minutes.withColumn("state", state)


def piecewise_integral(held: DataFrame, end: int) -> DataFrame:
    """Integral over time of a step function given by its change points, up to ``end``; seconds without a value apart."""
    w = by_series()
    width = F.coalesce(F.lead("t").over(w), F.lit(end)) - F.col("t")
    return held.withColumn("width", width).groupBy("series_id").agg(
        (F.sum(F.when(F.col("value").isNotNull(), F.col("value") * F.col("width"))) / 60).alias("minutes"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("width"))), F.lit(0)).alias("unknown_seconds"),
    )


def demand_from_trace(history: DataFrame, most: float, capacity: float) -> DataFrame:
    """Counts as a share of the history's 99.5 % point (nearest rank), cut at ``most``; intended load rounds half to even."""
    w = Window.partitionBy("series_id")
    ranked = history.withColumns({"r": F.row_number().over(w.orderBy("value", "t")), "n": F.count("*").over(w)})
    peak = ranked.groupBy("series_id").agg(F.max(F.when(F.col("r") == F.ceil(F.col("n") * F.lit(0.995)), F.col("value"))).alias("peak"))
    u = F.least(9 * F.col("value") / F.col("peak"), F.lit(most))
    return history.join(peak, "series_id").select("series_id", "t", "value", "peak", u.alias("share"), F.bround(60 * capacity * u, 0).cast("bigint").alias("intended"), (9 * F.col("value") / F.col("peak") > most).alias("clipped"))


def sliding_examples(grid: DataFrame, inputs: int, targets: int) -> DataFrame:
    """Arrays of the last ``inputs`` values and the next ``targets``; dropped where any target or input is missing."""
    w = by_series()
    x, y = F.collect_list("value").over(w.rowsBetween(-inputs + 1, 0)), F.collect_list("value").over(w.rowsBetween(1, targets))
    return grid.select("series_id", "t", x.alias("x"), y.alias("y")).where((F.size("x") == inputs) & (F.size("y") == targets))


def purged_split(examples: DataFrame, boundary: int, horizon: int) -> DataFrame:
    """train, valid, or purged where the targets cross the boundary."""
    return examples.withColumn("part", F.when(F.col("t") + horizon <= boundary, "train").when(F.col("t") >= boundary, "valid").otherwise("purged"))


def robust_scaled(points: DataFrame, boundary: int) -> DataFrame:
    """Values less the median over the spread of the quartiles, both of the rows before ``boundary``."""
    fit = points.where(F.col("t") < boundary).groupBy("series_id").agg(F.median("value").alias("m"), (F.percentile("value", F.lit(0.75)) - F.percentile("value", F.lit(0.25))).alias("iqr"))
    return points.join(fit, "series_id").select("series_id", "t", (F.when(F.col("iqr") > 0, (F.col("value") - F.col("m")) / F.col("iqr")).otherwise(F.col("value") - F.col("m"))).alias("scaled"))


def final_attempts(attempts: DataFrame, lines: DataFrame, arms: int) -> DataFrame:
    """The one final attempt of each hour that has every arm once; conflict where there are more, unfinalized where none.

    ``attempts``: hour, attempt; ``lines``: attempt, arm (a whole number), final. Lines are counted where they are and then by attempt, before
    they meet the hours, and arms that span under 64 numbers are the bits of one, so what a task holds is a few numbers for
    each of its attempts. An attempt that an hour has twice has each line twice, so it is not final.
    """
    ends = lines.agg(F.min("arm").cast("decimal(20,0)").alias("lo"), F.max("arm").cast("decimal(20,0)").alias("hi")).first()
    if ends["lo"] is not None and ends["hi"] - ends["lo"] < 64:
        held = F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("arm") - F.lit(int(ends["lo"]))).cast("int"))))
    else:
        held = F.count_distinct("arm")
    whole = lines.where("attempt is not null").groupBy("attempt").agg(F.count("*").alias("rows"), held.alias("arms"), F.min("final").alias("lo"), F.max("final").alias("hi"))
    every = (F.col("rows") == arms) & (F.col("arms") == arms) & (F.col("lo") == F.col("hi")) & (F.col("hi") == 1)
    told = attempts.join(whole.where(every).select("attempt", F.lit(True).alias("every")), "attempt", "left")
    valid = told.groupBy("attempt", "hour").agg(((F.count("*") == 1) & F.coalesce(F.bool_and("every"), F.lit(False))).alias("final"))
    out = valid.groupBy("hour").agg(F.count_if("final").alias("finals"), F.min(F.when(F.col("final"), F.col("attempt"))).alias("first_final"))
    status = F.when(F.col("finals") == 1, "final").when(F.col("finals") > 1, "conflict").otherwise("unfinalized")
    return out.select("hour", status.alias("status"), F.when(F.col("finals") == 1, F.col("first_final")).alias("attempt"))
