"""Scores of accepted forecasts against later observations, beside baselines that were known when they were issued."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loadloom.functions.scalars import ratio

DAY = 86400
METHODS = ("forecast", "persistence", "prevday")


def scored_steps(issuances: DataFrame, observed: DataFrame, as_of: int) -> DataFrame:
    """One row for each issued step, with its state, what was observed, and the errors of the forecast and of both baselines.

    ``issuances``: series_id, issued, artifact (NULL: unknown), steps (array of structs step, target, value); ``observed``: series_id, t, value. A
    target after ``as_of`` is outstanding, one without an observation is a gap, the rest is scored. persistence is what was observed
    at the issuance, prevday what was a day before the target; a scored step whose baseline lies after its issuance ends the job with an
    error, since a score against the future would be no score. Relative errors are NULL where nothing was observed above 0.
    """
    steps = issuances.select("series_id", "issued", F.coalesce("artifact", F.lit("unknown")).alias("artifact"), F.explode("steps").alias("s")).select("series_id", "issued", "artifact", "s.step", "s.target", F.col("s.value").alias("forecast"))
    early = F.col("target") - DAY > F.col("issued")
    steps = steps.withColumn("before", F.when(~early, F.col("target") - DAY))
    seen = lambda t, name: observed.select("series_id", F.col("t").alias(t), F.col("value").alias(name))
    rows = steps.join(seen("target", "actual"), ["series_id", "target"], "left").join(seen("issued", "persistence"), ["series_id", "issued"], "left").join(seen("before", "prevday"), ["series_id", "before"], "left")
    state = F.when(F.col("target") > as_of, "outstanding").when(F.col("actual").isNull(), "gap").otherwise("scored")
    rows = rows.withColumn("state", state)
    scored = F.col("state") == "scored"
    peeked = F.raise_error(F.concat(F.lit("a baseline would read "), (F.col("target") - DAY).cast("string"), F.lit(", after its issuance at "), F.col("issued").cast("string"))).cast("double")
    errors = {f"{m}_ae": F.when(scored, F.abs(F.col(m) - F.col("actual"))) for m in METHODS}
    errors["prevday_ae"] = F.when(scored & early, peeked).otherwise(errors["prevday_ae"])
    relative = {f"{m}_ape": F.when(F.col("actual") > 0, F.col(f"{m}_ae") / F.col("actual")) for m in METHODS}
    return rows.withColumns(errors).withColumns(relative).select("series_id", "artifact", "issued", "step", "target", "state", "forecast", F.when(scored, F.col("actual")).alias("actual"), *errors, *relative)


def score_summary(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts and mean errors of ``scored_steps`` by the keys: pooled over all scored steps, never a mean of means."""
    state = lambda s: F.count_if(F.col("state") == s)
    matured = F.count_if(F.col("state") != "outstanding")
    under = F.count_if(F.coalesce((F.col("state") == "scored") & (F.col("forecast") < F.col("actual")), F.lit(False)))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("steps_issued"), state("scored").alias("steps_scored"), state("gap").alias("gaps"), state("outstanding").alias("outstanding"),
        F.coalesce(ratio(state("scored"), matured), F.lit(0.0)).alias("step_coverage"), (state("outstanding") == 0).alias("matured"),
        F.count_if(F.coalesce(F.col("actual") <= 0, F.lit(False))).alias("zero_observations"), ratio(under, state("scored")).alias("under_share"),
        *[F.avg(f"{m}_ae").alias(f"{m}_mae") for m in METHODS], *[(100 * F.avg(f"{m}_ape")).alias(f"{m}_mape") for m in METHODS],
    )


def issuance_coverage(issuances: DataFrame, start: int, end: int, cadence: int) -> DataFrame:
    """Accepted issuances of each series in [start, end) against those that the cadence asks for (one at least)."""
    expected = max(1, (end - start) // cadence)
    inside = issuances.where((F.col("issued") >= start) & (F.col("issued") < end))
    return inside.groupBy("series_id").agg(F.count("*").alias("accepted"), F.lit(expected).alias("expected"), (F.count("*") / expected).alias("coverage"))


def _finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))


#: States of a record of components, as they are recorded or found.
SCHEMA, STATES = "component-v1", ("absent", "invalid", "misaligned")


def component_state(record: Column, forecasts: Column, steps: int = 6) -> Column:
    """NULL where a record of components can be used, else why not: absent, schema, its own status, length, invalid, misaligned, final_mismatch.

    ``record``: struct of schema, status, reason, targets, pattern, network, blended, final, pattern_there, network_there, weights (arrays of a step
    each); ``forecasts``: array of structs step, target, value. The first step that breaks a rule decides, its place before its numbers.
    """
    arrays = ("targets", "pattern", "network", "blended", "final", "pattern_there", "network_there", "weights")
    whole = [F.coalesce(F.size(record[a]) == steps, F.lit(False)) for a in arrays]

    def broken(i: Column) -> Column:
        at = {a: F.get(record[a], i) for a in arrays}
        fc = F.get(forecasts, i)
        aligned = F.coalesce((fc["step"] == i + 1) & (at["targets"] == fc["target"]), F.lit(False))
        final = _finite(at["final"]) & _finite(fc["value"]) & F.coalesce((F.round(fc["value"], 2) == fc["value"]) & (F.abs(at["final"] - fc["value"]) <= 0.005 + 1e-9), F.lit(False))
        odd = F.lit(False)
        for a in ("pattern", "network", "blended"):
            odd = odd | (at[a].isNotNull() & ~_finite(at[a]))
        for a, flag in (("pattern", "pattern_there"), ("network", "network_there")):
            odd = odd | ~F.coalesce(at[flag] == _finite(at[a]), F.lit(False))
        odd = odd | ~(_finite(at["weights"]) & F.coalesce(at["weights"].between(0, 1), F.lit(False)))
        return F.when(~aligned, "misaligned").when(~final, "final_mismatch").when(odd, "invalid")

    first = F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), broken), lambda s: s.isNotNull()), F.lit(0))
    length = F.coalesce(F.size(forecasts) == steps, F.lit(False))
    for ok in whole:
        length = length & ok
    said = F.when(record["status"].isin(*STATES), record["status"]).otherwise("invalid")
    return (
        F.when(record.isNull(), "absent").when(~record["schema"].eqNullSafe(SCHEMA), "schema").when(~record["status"].eqNullSafe("ok"), said)
        .when(~length, "length").when(record["reason"].isNotNull(), "invalid").otherwise(first)
    )


def identity_mismatches(record: Column, steps: int = 6) -> Column:
    """Steps (from 0) whose blend is not weight * pattern + (1 - weight) * network to 1e-9, where all three are there."""

    def off(i: Column) -> Column:
        p, n, b, w = (F.get(record[a], i) for a in ("pattern", "network", "blended", "weights"))
        told = w * p + (1 - w) * n
        return _finite(p) & _finite(n) & _finite(b) & F.coalesce(F.abs(told - b) > F.greatest(1e-9 * F.greatest(F.abs(told), F.abs(b)), F.lit(1e-9)), F.lit(False))

    return F.filter(F.sequence(F.lit(0), F.lit(steps - 1)), off)
