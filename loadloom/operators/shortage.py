"""Shortage events with how they ended, and tags that say what the recorded decisions had to do with them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from loadloom.operators.grid import by_series


def shortage_runs(slots: DataFrame, step: int) -> DataFrame:
    """Maximal runs of short slots (ready under need) of a whole grid (series_id, t, need, ready; NULL where not observed).

    One row a run: start, end, samples, shortage (replica-minutes), deficit (largest), need_at_onset, left_cut and right_cut (the slot
    before or after was not observed), recovered and recovery_minutes, cause (ready_rose or demand_fell), demand_step (need rose at
    the onset).
    """
    w = by_series()
    bad = F.coalesce(F.col("ready") < F.col("need"), F.lit(False))
    x = slots.withColumns({"bad": bad, "ready_before": F.lag("ready").over(w), "need_before": F.lag("need").over(w), "ready_after": F.lead("ready").over(w)})
    x = x.withColumn("run", F.sum(F.when(F.col("bad") == F.lag("bad").over(w), 0).otherwise(1)).over(w))
    at_start, at_end = lambda c: F.min_by(c, "t"), lambda c: F.max_by(c, "t")
    runs = x.where("bad").groupBy("series_id", "run").agg(
        F.min("t").alias("start"),
        F.max("t").alias("end"),
        F.count("*").alias("samples"),
        (F.sum(F.col("need") - F.col("ready")) * (step / 60)).alias("shortage"),
        F.max(F.col("need") - F.col("ready")).alias("deficit"),
        at_start("need").alias("need_at_onset"),
        at_start("ready_before").isNull().alias("left_cut"),
        at_end("ready_after").isNull().alias("right_cut"),
        at_end("ready_after").alias("_after"),
        at_end("ready").alias("_last"),
        F.coalesce(at_start("need") > at_start("need_before"), F.lit(False)).alias("demand_step"),
    )
    recovered = F.when(~F.col("right_cut"), F.col("end") + step)
    cause = F.when(~F.col("right_cut"), F.when(F.col("_after") > F.col("_last"), "ready_rose").otherwise("demand_fell"))
    return runs.withColumns({"recovered": recovered, "recovery_minutes": (recovered - F.col("start")) / 60, "cause": cause}).drop("run", "_after", "_last")


#: The stations of the replica chain, in the order in which a cut is looked for.
CUTS = (("lead_peak_low", "raw"), ("confidence_cut", "confident"), ("clamp_cut", "clamped"), ("overestimate_cut", "predicted"))


def decisions_before(events: DataFrame, decisions: DataFrame, lookback: int) -> DataFrame:
    """Adds to each event its decisions of the last ``lookback`` seconds up to its start, in order of (t, ord), as the array ``seen``.

    Both sides meet in buckets of the lookback's width, an event in two, so a series is spread over time and an array holds
    one lookback, however long the log is.
    """
    bucket = lambda c: F.floor(F.col(c) / lookback)
    told = decisions.select("series_id", bucket("t").alias("_b"), F.struct("t", "ord", *[c for c in decisions.columns if c not in ("series_id", "t", "ord")]).alias("d"))
    asked = events.select("series_id", "start", F.explode(F.array(bucket("start") - 1, bucket("start"))).alias("_b"))
    met = asked.join(told, ["series_id", "_b"]).where(F.col("d.t").between(F.col("start") - lookback, F.col("start")))
    seen = met.groupBy("series_id", "start").agg(F.array_sort(F.collect_list("d")).alias("seen"))
    return events.join(seen, ["series_id", "start"], "left").withColumn("seen", F.coalesce("seen", F.array().cast(seen.schema["seen"].dataType)))


def event_tags(events: DataFrame, decisions: DataFrame, issuances: DataFrame, truth: DataFrame, plan: Callable[[Column], Column], lookback: int, fresh: int, ahead: int) -> DataFrame:
    """What the decisions before each shortage event had to do with it, as an array of tags; ``undetermined`` where nothing did.

    ``decisions``: series_id, t, ord, applied, desired, forecast_status, raw, confident, clamped, predicted, safeguards, most, action, source,
    issuance_id. ``issuances``: issuance_id, application, steps (array of target, value). ``truth``: series_id, t, value. ``plan`` gives the
    planned rate at a time.

    The decision in force is the last one, if at most ``fresh`` old. Decisions cover the lookback if no two, and no edge, are
    further apart than that. Capacity was applied ahead if every decision of the last ``ahead`` seconds or more, searched
    backwards until one falls short of the need at the onset, had it. Then come the first cut in the replica chain, what held
    capacity back, and the forecast for the first target not before the onset against plan and truth.
    """
    e = decisions_before(events, decisions, lookback)
    start, need, seen = F.col("start"), F.col("need_at_onset"), F.col("seen")
    gaps = F.transform(seen, lambda d, i: d["t"] - F.when(i == 0, start - lookback).otherwise(F.get(seen, i - 1)["t"]))
    short = F.array_max(F.transform(seen, lambda d, i: F.when(F.coalesce(d["applied"], F.lit(0)) < need, i).otherwise(-1)))
    e = e.withColumn("at", F.when(start - F.try_element_at("seen", F.lit(-1))["t"] <= fresh, F.try_element_at("seen", F.lit(-1))))
    e = e.withColumns({"covered": F.col("at").isNotNull() & (F.array_max(gaps) <= fresh), "run": F.get("seen", F.coalesce(short, F.lit(-1)) + 1)["t"]}).drop("seen")
    first = F.array_min(F.filter("steps", lambda s: (s["target"] >= start) & s["value"].isNotNull()))
    used = issuances.select("issuance_id", "application", "steps")
    e = e.withColumn("issuance_id", F.col("at.issuance_id")).join(used, "issuance_id", "left")
    e = e.withColumn("forecast", F.when((F.col("application") == F.col("series_id")) & (F.col("at.forecast_status") == "used"), first)).drop("steps")
    e = e.join(truth.select("series_id", F.col("t").alias("_target"), F.col("value").alias("truth")), (truth["series_id"] == e["series_id"]) & (F.col("_target") == F.col("forecast.target")), "left").drop(truth["series_id"]).drop("_target")
    return e.withColumn("tags", tags_of(start, need, plan(F.col("forecast.target")), ahead)).drop("covered", "run", "application")


def tags_of(start: Column, need: Column, planned: Column, ahead: int) -> Column:
    at = lambda c: F.col(f"at.{c}")
    lead = lambda cond, tag: F.when(cond, tag)
    cut: Column = lead(at("forecast_status") != "used", "no_forecast")
    for tag, column in CUTS:
        cut = cut.when(at(column) < need, tag)
    found: Sequence[Column] = [
        F.when(~F.col("covered"), "decision_coverage_gap").when(start - F.col("run") >= ahead, "applied_ahead_ready_late"),
        cut,
        lead(at("safeguards"), "safeguard_recorded"),
        lead((at("most") > 0) & (need > at("most")), "max_clip"),
        lead((F.coalesce(at("desired"), F.lit(0)) >= need) & (F.coalesce(at("applied"), F.lit(0)) < need) & F.startswith(at("action"), F.lit("hold")), "hold"),
        lead(at("source") == "reactive", "reactive_floor"),
        lead(F.col("application") != F.col("series_id"), "issuance_join_mismatch"),
        lead(F.col("forecast.value") < planned, "forecast_below_plan"),
        lead(F.col("forecast.value") < F.col("truth"), "forecast_below_truth"),
    ]
    tags = F.filter(F.array(*found), lambda x: x.isNotNull())
    return F.when(F.size(tags) == 0, F.array(F.lit("undetermined"))).otherwise(tags)


def autoscaler_tags(slots: DataFrame, desired: DataFrame, runs: DataFrame) -> DataFrame:
    """For each run, in how many of its slots an autoscaler's desired count met the need, was below it or was not observed; and tags.

    A slot finds its run by carrying the run's start forward over the series' slots, so no range join is made.
    """
    x = slots.join(desired, ["series_id", "t"], "left").join(runs.select("series_id", F.col("start").alias("t"), F.col("start").alias("_start"), F.col("end").alias("_end")), ["series_id", "t"], "left")
    w = by_series()
    x = x.withColumn("_run", F.last(F.when(F.col("_start").isNotNull(), F.struct("_start", "_end")), ignorenulls=True).over(w)).where(F.col("t") <= F.col("_run._end"))
    met, seen = F.col("desired") >= F.col("need"), F.col("desired").isNotNull()
    out = x.groupBy("series_id", F.col("_run._start").alias("start")).agg(F.count_if(seen & met).alias("met"), F.count_if(seen & ~met).alias("below"), F.count_if(~seen).alias("unobserved"))
    some = F.filter(F.array(F.when(F.col("below") > 0, "hpa_desired_below_need"), F.when(F.col("unobserved") > 0, "hpa_partially_unobserved"), F.when(F.col("below") == 0, "hpa_desired_met_ready_late")), lambda x: x.isNotNull())
    return out.withColumn("tags", F.when(F.col("met") + F.col("below") == 0, F.array(F.lit("hpa_unobserved"))).otherwise(some))
