"""What issued bounds were worth: hourly evidence, coverage by group, and the rules that take trust away."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from loadloom.operators.choices import pinball
from loadloom.operators.grid import by_series
from loadloom.operators.windows import misses, trailing_sums

HOUR, DAY = 3600, 86400


def hourly_evidence(records: DataFrame, miss: float, steps: int) -> DataFrame:
    """Evidence of each series and hour: what was issued in it, and the outcomes of the windows that ended in it.

    ``records``: series_id, origin, end, mode (prospective or replay), gate (whether the issuance counts for the gates), status
    (scored, unscorable, or pending: issued only), y, base, upper (or NULL), errors (absolute errors of ``steps`` steps, or NULL). Replays
    are counted apart, and only their counts. Every record goes to two hours, in one aggregation.
    """
    at = F.explode(F.array(F.struct(F.col("origin").alias("t"), F.lit(True).alias("issue")), F.struct(F.col("end").alias("t"), F.lit(False).alias("issue"))))
    rows = records.select("*", at.alias("at")).where(F.col("at.issue") | F.col("status").isin("scored", "unscorable"))
    own, replay, gate = F.col("mode") == "prospective", F.col("mode") == "replay", F.coalesce("gate", F.lit(False))
    issue, outcome = F.col("at.issue"), ~F.col("at.issue")
    scored, unscorable = outcome & (F.col("status") == "scored"), outcome & (F.col("status") == "unscorable")
    bounded = scored & F.col("upper").isNotNull()
    covered = bounded & (F.col("y") <= F.col("upper"))
    stepped = scored & own & F.col("errors").isNotNull()
    counts = {
        "issued": issue & own, "gate_issued": issue & own & gate, "scored": scored & own, "unscorable": unscorable & own, "gate_scored": scored & own & gate,
        "gate_unscorable": unscorable & own & gate, "bounded": bounded & own, "covered": covered & own, "gate_bounded": bounded & own & gate, "gate_covered": covered & own & gate,
        "stepped": stepped, "replay_issued": issue & replay, "replay_scored": scored & replay, "replay_unscorable": unscorable & replay,
        "replay_bounded": bounded & replay & gate, "replay_covered": covered & replay & gate,
    }
    sums = {
        "pinball": F.when(bounded & own & gate, pinball(F.col("y"), F.col("upper"), miss)), "abs_error": F.when(scored & own, F.abs(F.col("y") - F.col("base"))),
        "bias": F.when(scored & own, F.col("base") - F.col("y")),
    } | {f"step_{k}": F.when(stepped, F.get("errors", F.lit(k))) for k in range(steps)}
    held = [F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in counts.items()] + [F.coalesce(F.sum(c), F.lit(0.0)).alias(k) for k, c in sums.items()]
    return rows.groupBy("series_id", F.floor(F.col("at.t") / HOUR).alias("hour")).agg(*held)


def coverage_by_group(windows: DataFrame, low: Column, high: Column, near_zero: float, miss: float, *keys: str) -> DataFrame:
    """Coverage, mean width over the base, and mean pinball of each group that a window belongs to; a window belongs to several.

    ``windows``: the keys, base, upper (or NULL), y, and least and most, the lowest and highest level expected over the targets. Groups: all;
    low, mid, high by base (up to ``low``, up to ``high``, above); ramp or plateau; near_zero (most at most that) and zero_forecast.
    unbounded counts the windows of a group without a bound, which enter nothing else; one without a level enters no width_over_level.
    """
    ramp = F.col("most") > F.col("least")
    groups = {"all": F.lit(True), "low": F.col("base") <= low, "mid": (F.col("base") > low) & (F.col("base") <= high), "high": F.col("base") > high, "ramp": ramp, "plateau": ~ramp, "near_zero": F.col("most") <= near_zero, "zero_forecast": F.col("base") == 0}
    bounded = F.col("upper").isNotNull()
    width = F.when(bounded, F.col("upper") - F.col("base"))
    rows = windows.where("y is not null").select("*", F.explode(F.filter(F.array(*[F.when(c, F.lit(g)) for g, c in groups.items()]), lambda g: g.isNotNull())).alias("group"))
    return rows.groupBy(*keys, "group").agg(
        F.count_if(bounded).alias("windows"), F.count_if(~bounded).alias("unbounded"), F.avg(F.when(bounded, (F.col("y") <= F.col("upper")).cast("double"))).alias("coverage"),
        F.avg(width).alias("width"), F.avg(F.when(F.col("most").isNotNull(), width / F.greatest(F.col("most"), F.lit(1e-9)))).alias("width_over_level"), F.avg(F.when(bounded, pinball(F.col("y"), F.col("upper"), miss))).alias("pinball"),
    )


class Limits(NamedTuple):
    """When the coverage rules fail. ``recent``: outcomes of the rolling rule, which fails from ``rolling`` misses on; ``consecutive``: misses in a
    row; ``least_day``: outcomes that a day needs to be judged; ``coverage``: what the trailing seven days must not fall below."""

    recent: int
    rolling: int
    consecutive: int
    least_day: int
    coverage: float


def coverage_rules(looks: DataFrame, limits: Limits, day_limits: DataFrame, week_limits: DataFrame, deadline: int) -> DataFrame:
    """The state of the four coverage rules at each look: a gate outcome (series_id, t its end, covered), at most one of a series at a time.

    rolling and consecutive see the latest outcomes. A day is judged when it is complete (its end plus ``deadline`` seconds has passed),
    against the misses that ``day_limits`` (outcomes, misses) allows its number of outcomes; a failed one counts until the hour before
    its start leaves the seven days. seven_day fails where coverage is below the limit and the misses reach those of ``week_limits``.
    A number of outcomes without a row in these tables fails nothing. alarms: how often rolling or consecutive began to fail up to then.
    """
    seen = misses(looks.select("series_id", F.col("t").alias("seq"), "covered"), limits.recent).withColumnRenamed("seq", "t")
    week = trailing_sums(looks, 7 * DAY, outcomes=F.lit(1), missed=(~F.col("covered")).cast("int")).drop("first")
    week = week.join(week_limits.select(F.col("outcomes"), F.col("misses").alias("most")), "outcomes", "left").select("series_id", "t", F.col("outcomes").alias("week_outcomes"), F.col("missed").alias("week_missed"), "most")
    days = looks.groupBy("series_id", F.floor(F.col("t") / DAY).alias("day")).agg(F.count("*").alias("outcomes"), F.count_if(~F.col("covered")).alias("missed"))
    failed = days.where(F.col("outcomes") >= limits.least_day).join(day_limits, "outcomes").where(F.col("missed") >= F.col("misses"))
    failed = failed.select("series_id", "day", ((F.col("day") + 1) * DAY + deadline).alias("start"), ((F.col("day") + 7) * DAY - HOUR).alias("stop"))
    spans = failed.select("series_id", "start", "stop", F.explode(F.sequence(F.col("day") + 1, F.col("day") + 6)).alias("look_day"))
    spans = spans.groupBy("series_id", "look_day").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))  # six at most
    rows = seen.join(week, ["series_id", "t"]).withColumn("look_day", F.floor(F.col("t") / DAY)).join(spans, ["series_id", "look_day"], "left")
    inside = F.size(F.filter("spans", lambda s: (s["start"] <= F.col("t")) & (F.col("t") <= s["stop"])))
    rows = rows.withColumn("failed_days", F.coalesce(F.greatest(inside, F.lit(0)), F.lit(0)))
    covered = (F.col("week_outcomes") - F.col("week_missed")) / F.col("week_outcomes")
    rules = {
        "rolling": F.col("missed") >= limits.rolling, "consecutive": F.col("in_a_row") >= limits.consecutive, "day": F.col("failed_days") > 0,
        "seven_day": (covered < limits.coverage) & F.coalesce(F.col("week_missed") >= F.col("most"), F.lit(False)),
    }
    w = by_series()
    rows = rows.withColumns(rules)
    begins = sum(((F.col(k) & ~F.coalesce(F.lag(k).over(w), F.lit(False))).cast("int") for k in ("rolling", "consecutive")), F.lit(0))
    rows = rows.withColumn("begins", begins).withColumn("alarms", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    failing = F.array_join(F.filter(F.array(*[F.when(F.col(k), F.lit(k)) for k in rules]), lambda k: k.isNotNull()), ",")
    return rows.select("series_id", "t", "missed", "in_a_row", "failed_days", "week_outcomes", "week_missed", "alarms", failing.alias("failing"))
