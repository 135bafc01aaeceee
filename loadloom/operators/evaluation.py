"""Acceptance, trust, comparison and evidence rules over logs, forecasts and telemetry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from loadloom.functions.scalars import ratio
from loadloom.operators.folds import fold_rows
from loadloom.operators.grid import by_series


def raw_samples(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nested sample lines (labels, ts, v) to (accepted points, rejected lines); a NULL value stays, as a staleness marker."""
    ragged = F.coalesce(F.size("ts") != F.size("v"), F.lit(True))
    bad = F.exists("v", lambda x: x.isNotNull() & (F.isnan(x) | (F.abs(x) == float("inf"))))
    judged = lines.withColumn("reason", F.when(ragged, "ragged").when(bad, "not_finite"))
    points = judged.where("reason is null").select("labels", F.explode(F.arrays_zip("ts", "v")).alias("p")).select("labels", F.col("p.ts").alias("t"), F.col("p.v").alias("value"))
    return points, judged.where("reason is not null").select("labels", "reason")


def replay_violations(rows: DataFrame, step: int) -> DataFrame:
    """Rows of a replay table that break its rules, with the first rule broken; rows: series_id, t, value, available."""
    before = F.lag("t").over(by_series("pos"))
    reason = (
        F.when(F.col("t") % step != 0, "off_grid").when(F.col("t") <= before, "not_increasing").when(F.col("value").isNull() | F.isnan("value") | (F.col("value") < 0), "bad_value").when(F.col("available") < F.col("t"), "early")
    )
    return rows.withColumn("reason", reason).where("reason is not null")


def wide_to_long(wide: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row for each key and minute column; minutes count from 1."""
    return wide.select(*keys, F.posexplode(F.array(*[F.col(c) for c in columns])).alias("m", "count")).select(*keys, (F.col("m") + 1).alias("minute"), "count")


def accepted(log: DataFrame, most_age: int) -> DataFrame:
    """Rows that hold against the last *accepted* row of their series: not older in issue or model time, and not from a model over
    ``most_age`` before. A rejected row changes nothing. log: series_id, pos, issued, trained."""

    def turn(last: tuple[int, int], row: tuple) -> tuple[tuple[int, int], tuple]:
        series, pos, issued, trained = row
        why = "stale" if issued - trained > most_age else "out_of_order" if issued < last[0] else "older_model" if trained < last[1] else "ok"
        return ((issued, trained) if why == "ok" else last), (series, pos, why)

    return fold_rows(log.select("series_id", "pos", "issued", "trained"), ["pos"], lambda: (-(1 << 62), -(1 << 62)), turn, "series_id string, pos long, status string")


def first_per(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row of each key, by one aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min(F.struct(order, *[c for c in rest if c != order])).alias("m"))
    return best.select(*keys, *[F.col(f"m.{c}").alias(c) for c in rest])


def hysteresis(looks: DataFrame, seconds: int, bounds: int) -> DataFrame:
    """Trusted or not after each look (t, healthy, issued): lost at once, given back after ``seconds`` of health and ``bounds`` issued."""

    def turn(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        (trusted, since, count), (series, t, healthy, issued) = state, row
        if healthy:
            since, count = t if since is None else since, count + issued
            trusted = trusted or (t - since >= seconds and count >= bounds)
        else:
            trusted, since, count = False, None, 0
        return (trusted, since, count), (series, t, trusted)

    return fold_rows(looks.select("series_id", "t", "healthy", "issued"), ["t"], lambda: (True, None, 0), turn, "series_id string, t long, trusted boolean")


#: What a failing gate is reported as, in the order in which gates are looked at.
GATE_REASONS = (
    ("identity", "IdentityMismatch"), ("state", "StateUnavailable"), ("data", "DataUnavailable"), ("history", "HistoryInsufficient"),
    ("calibration", "CalibrationInsufficient"), ("prospective", "ShadowInsufficient"), ("coverage", "CoverageLow"), ("availability", "DataUnavailable"),
)


def gate_reason(trusted: Column, ever: Column) -> tuple[Column, Column]:
    """(reason, phase) of a candidate from its gates (a boolean column each): the first failing gate by priority; while all hold
    but trust is not given back yet, the shadow is too short."""
    reason = F.coalesce(*[F.when(~F.col(gate), said) for gate, said in GATE_REASONS], F.when(trusted, "Ready").otherwise("ShadowInsufficient"))
    phase = F.when(trusted, "Trusted").when(ever, "Degraded").when(~F.col("history"), "Collecting").when(~F.col("calibration"), "Calibrating").otherwise("Shadow")
    return reason, phase


#: Candidates from the one preferred to the one that is always there.
FALLBACK = ("lstm", "statistical", "naive")


def fallback(looks: DataFrame, dwell: int) -> DataFrame:
    """The candidate in use after each look, and how often it changed up to then.

    ``looks``: series_id, t, and for each of the two challengers its name with _trusted, _enters (evidence to come in) and _stays
    (evidence to keep it), and naive_trusted. A challenger comes in when it is trusted and its evidence has held for ``dwell``
    seconds while the naive one was trusted; one in use that fails goes at once.

    With columns name_recipe (string) the dwell is that of a challenger's recipe: a new one starts anew, and one in use whose recipe
    is not the one it came in with goes, unless the new recipe has dwelt already. Evidence of a recipe that is not on offer rests.
    """
    challengers = FALLBACK[:-1]

    def turn(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        (used, recipe, since, switches), (series, t, naive, *rest) = state, row
        told = dict(zip(challengers, zip(rest[::4], rest[1::4], rest[2::4], rest[3::4]), strict=True))  # trusted, enters, stays, recipe
        offered = {(m, told[m][3]): since.get((m, told[m][3]), t) if naive and told[m][1] else None for m in challengers}
        since = {k: v for k, v in (since | offered).items() if v is not None}
        safe = naive if used == FALLBACK[-1] else used is not None and naive and told[used][0] and told[used][2] and told[used][3] == recipe
        dwelt = {m: t - since.get((m, told[m][3]), t + 1) >= dwell for m in challengers}
        held = [m for m in challengers if told[m][0] and ((safe and m == used) or dwelt[m])]
        now = held[0] if held else FALLBACK[-1] if naive else None
        if now != used:
            recipe, switches = told[now][3] if now in told else None, switches + 1
        return (now, recipe, since, switches), (series, t, now, switches)

    of = {m: F.col(f"{m}_recipe") if f"{m}_recipe" in looks.columns else F.lit("") for m in challengers}
    columns = ["series_id", "t", "naive_trusted", *(c for m in challengers for c in (f"{m}_trusted", f"{m}_enters", f"{m}_stays", of[m].alias(f"{m}_recipe")))]
    return fold_rows(looks.select(*columns), ["t"], lambda: (None, None, {}, 0), turn, "series_id string, t long, used string, switches int")


def worst_status(targets: DataFrame, hits: DataFrame, order: Sequence[str], otherwise: str) -> DataFrame:
    """The worst status of what overlaps each target, in the stated order; ``otherwise`` where nothing does."""
    rank = F.coalesce(*[F.when(F.col("status") == s, F.lit(i)) for i, s in enumerate(order)])
    worst = hits.withColumn("rank", rank).where("rank is not null").groupBy("key").agg(F.min(F.struct("rank", "status")).alias("m"))
    return targets.join(worst.select("key", F.col("m.status").alias("status")), "key", "left").select("key", F.coalesce("status", F.lit(otherwise)).alias("status"))


def offset_bounds(pairs: DataFrame) -> DataFrame:
    """Clock offset of each series from intervals that must all hold it: (lo, hi), empty where they do not meet."""
    out = pairs.groupBy("series_id").agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"))
    return out.withColumn("empty", F.col("lo") > F.col("hi"))


def relative_cost(costs: DataFrame) -> DataFrame:
    """The arm with the least cost of each series, the first name of equal ones, and what the others cost beside it."""
    best = costs.groupBy("series_id").agg(F.min(F.struct("cost", "arm")).alias("m"))
    return costs.join(best, "series_id").select("series_id", "arm", "cost", F.col("m.arm").alias("best"), ratio(F.col("cost"), F.col("m.cost")).alias("times"))


def planned_requests(slots: DataFrame, hours: DataFrame, slot_seconds: int) -> DataFrame:
    """Requests that a table of slot rates (start, rpm) plans for each hour (hour), slots cut at its ends; an equi join on the hour."""
    cut = slots.select("start", "rpm", F.explode(F.sequence(F.floor(F.col("start") / 3600), F.floor((F.col("start") + slot_seconds - 1) / 3600))).alias("h"))
    part = F.least(F.col("start") + slot_seconds, (F.col("h") + 1) * 3600) - F.greatest(F.col("start"), F.col("h") * 3600)
    planned = cut.groupBy("h").agg(F.sum(F.col("rpm") * part / 60).alias("planned"))
    return hours.join(planned, hours["hour"] == planned["h"] * 3600, "left").select("hour", "planned")


def scores(rows: DataFrame, *keys: str) -> DataFrame:
    """Targets, unavailable ones and errors of each key; errors only where every target has a forecast, so a missing one can't win."""
    error, whole = F.col("predicted") - F.col("actual"), F.count("*") == F.count("predicted")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("targets"),
        (F.count("*") - F.count("predicted")).alias("unavailable"),
        F.when(whole, F.avg(F.abs(error))).alias("mae"),
        F.when(whole, F.avg(error)).alias("bias"),
        F.when(whole, F.sqrt(F.avg(error * error))).alias("rmse"),
    )


def write_tables(predictions: DataFrame, found: DataFrame, path: str) -> None:
    """``predictions.csv`` and ``scores.csv`` under ``path``, with headers; folders of part files, as every task writes its own."""
    for df, name in ((predictions, "predictions.csv"), (found, "scores.csv")):
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def stratum_draw(eligible: DataFrame, strata: int, each: int, seed: str) -> DataFrame:
    """``each`` applications of every stratum (app, owner, stratum), no owner twice, strata drawn from low to high.

    The order within a stratum is that of a seeded hash. An owner's first application in it stands for the owner, which is what
    going through them one by one would take. A stratum with too few owners stays short.
    """
    hashed = eligible.withColumn("h", F.md5(F.concat(F.lit(seed), F.col("app").cast("string"))))
    chosen = None
    for s in range(strata):
        own = hashed.where(F.col("stratum") == s)
        if chosen is not None:
            own = own.join(chosen.select("owner"), "owner", "left_anti")
        first = own.groupBy("owner").agg(F.min(F.struct("h", "app", "stratum")).alias("m")).select("m.h", "m.app", "owner", "m.stratum").orderBy("h").limit(each)
        chosen = first if chosen is None else chosen.unionByName(first)
    return chosen.select("stratum", (F.row_number().over(Window.partitionBy("stratum").orderBy("h")) - 1).alias("place"), "app", "owner")


#: Classes of reasons from the one that decides first, and what a study with one is called.
OUTCOMES = (("FAIL", "FAIL"), ("NOT READY", "NOT READY"), ("INCOMPLETE", "INCOMPLETE"), ("FAIL-STAT", "FAIL"), ("INCONCLUSIVE", "INCONCLUSIVE"))


def outcome_of(reasons: DataFrame, *keys: str) -> DataFrame:
    """The outcome of each key: that of its worst reason (``class``), PASS if all of its classes are NULL; and how many it has."""
    rank = F.coalesce(*[F.when(F.col("class") == c, F.lit(i)) for i, (c, _) in enumerate(OUTCOMES)])
    worst = reasons.groupBy(*keys).agg(F.min(rank).alias("worst"), F.count("class").alias("reasons"))
    return worst.select(*keys, F.coalesce(F.get(F.array(*[F.lit(o) for _, o in OUTCOMES]), F.col("worst")), F.lit("PASS")).alias("outcome"), "reasons")


def component_report(rows: DataFrame, *keys: str) -> DataFrame:
    """Availability over matured steps, and errors of the hybrid and its pattern over the steps for which both and the truth are there.

    rows: pattern, network, hybrid, weight, actual, target, outstanding. ``identity_mismatch``: matured steps whose hybrid is not
    weight * pattern + (1 - weight) * network, by more than 1e-9, where all three are there.
    """
    matured = ~F.col("outstanding")
    paired = matured & F.col("actual").isNotNull() & F.col("hybrid").isNotNull() & F.col("pattern").isNotNull()
    there = lambda c: F.count(F.when(matured, F.col(c)))
    mean = lambda c: F.avg(F.when(paired, c))
    told = F.col("weight") * F.col("pattern") + (1 - F.col("weight")) * F.col("network")
    off = F.abs(told - F.col("hybrid")) > 1e-9 * F.greatest(F.lit(1.0), F.abs(told), F.abs("hybrid"))
    return rows.groupBy(*keys).agg(
        F.count_if(matured).alias("matured"),
        F.count_if("outstanding").alias("outstanding"),
        there("actual").alias("actual_available"),
        there("hybrid").alias("hybrid_finite"),
        there("pattern").alias("pattern_usable"),
        there("network").alias("network_finite"),
        ratio(there("pattern"), F.count_if(matured)).alias("pattern_share"),
        F.count_if(paired).alias("paired"),
        F.count_distinct(F.when(paired, F.col("target"))).alias("targets"),
        mean(F.abs(F.col("hybrid") - F.col("actual"))).alias("hybrid_mae"),
        mean(F.col("hybrid") - F.col("actual")).alias("hybrid_bias"),
        mean(F.abs(F.col("pattern") - F.col("actual"))).alias("pattern_mae"),
        mean(F.col("pattern") - F.col("actual")).alias("pattern_bias"),
        F.count_if(matured & F.col("pattern").isNull()).alias("no_pattern"),
        F.count_if(matured & off).alias("identity_mismatch"),
    )
