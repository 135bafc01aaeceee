"""Time grids: snapping, masks, gaps, islands. Rows are (series_id, t, value), t in seconds; NULL means not observed."""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from loadloom.functions.scalars import floor_to


def by_series(*order: str) -> Window:
    return Window.partitionBy("series_id").orderBy(*(order or ("t",)))


def average_samples(samples: DataFrame, start: int, end: int) -> DataFrame:
    """Points in [start, end], averaged where a series has several at one time."""
    return samples.where(F.col("t").between(start, end)).groupBy("series_id", "t").agg(F.avg("value").alias("value"))


def count_on_grid(samples: DataFrame, step: int) -> DataFrame:
    """Requests in each slot that has any; summed in each task first, so a hot series shuffles one row a slot and task."""
    return samples.groupBy("series_id", floor_to(F.col("t"), step).alias("t")).agg(F.count("*").cast("double").alias("value"))


def snap(samples: DataFrame, step: int, tolerance: int) -> DataFrame:
    """The nearest slot of each point, at most ``tolerance`` away; of several points in a slot the last (t, then order) stays."""
    slot = F.floor((F.col("t") + step / 2) / step) * step
    near = samples.withColumn("slot", slot).where((F.abs(F.col("t") - F.col("slot")) <= tolerance) & F.col("value").isNotNull() & ~F.isnan("value"))
    last = near.groupBy("series_id", "slot").agg(F.max(F.struct("t", "ord", "value")).alias("m"))
    return last.select("series_id", F.col("slot").alias("t"), F.col("m.value").alias("value"))


def snap_reasons(samples: DataFrame, step: int, tolerance: int) -> DataFrame:
    """How many points each rule of ``snap`` drops, by series."""
    slot = F.floor((F.col("t") + step / 2) / step) * step
    near = samples.withColumn("slot", slot).withColumn("far", F.abs(F.col("t") - F.col("slot")) > tolerance)
    return near.groupBy("series_id").agg(
        F.count("*").alias("points"),
        F.count_if("far").alias("off_grid"),
        (F.count_if(~F.col("far")) - F.count_distinct(F.when(~F.col("far"), F.col("slot")))).alias("duplicates"),
    )


def first_interval(t, mask: Sequence[tuple[int, int, str]]):
    """Place in ``mask`` of the first closed interval (start, end, reason) that holds ``t``, else NULL; a stated list, not a table."""
    return F.coalesce(*[F.when(t.between(a, b), F.lit(i)) for i, (a, b, _) in enumerate(mask)], F.lit(None).cast("int"))


def mask_points(points: DataFrame, mask: Sequence[tuple[int, int, str]]) -> DataFrame:
    return points.where(first_interval(F.col("t"), mask).isNull())


def mask_counts(points: DataFrame, mask: Sequence[tuple[int, int, str]]) -> DataFrame:
    """Points that each interval drops; one in several intervals counts for the first."""
    hits = points.withColumn("no", first_interval(F.col("t"), mask)).where("no is not null").groupBy("no").agg(F.count("*").alias("dropped"))
    return hits.withColumn("reason", F.element_at(F.array(*[F.lit(r) for _, _, r in mask]), F.col("no") + 1))


def regularize(points: DataFrame, step: int) -> DataFrame:
    """Every slot between a series' first and last, value NULL where there is none."""
    spine = points.groupBy("series_id").agg(F.min("t").alias("a"), F.max("t").alias("b")).select("series_id", F.explode(F.sequence("a", "b", F.lit(step).cast("bigint"))).alias("t"))
    return spine.join(points, ["series_id", "t"], "left")


def forward_fill(grid: DataFrame) -> DataFrame:
    return grid.withColumn("filled", F.last("value", ignorenulls=True).over(by_series().rowsBetween(Window.unboundedPreceding, 0)))


def gaps(points: DataFrame, step: int) -> DataFrame:
    """Neighbouring points over one step apart: (series_id, a, b, va, vb, missing)."""
    w = by_series()
    pairs = points.select("series_id", F.col("t").alias("a"), F.lead("t").over(w).alias("b"), F.col("value").alias("va"), F.lead("value").over(w).alias("vb"))
    return pairs.where(F.col("b") - F.col("a") > step).withColumn("missing", (F.floor((F.col("b") - F.col("a")) / step) - 1).cast("int"))


def judge_gaps(points: DataFrame, step: int, most: int, cutoff: int, mask: Sequence[tuple[int, int, str]]) -> DataFrame:
    """Why each gap is filled or not, the first rule that holds: off_grid, too_long, after_cutoff, masked, filled."""
    found = gaps(points, step)
    masked = reduce(lambda x, y: x | y, [(F.lit(a) < F.col("b")) & (F.lit(b) > F.col("a")) for a, b, _ in mask], F.lit(False))
    reason = (
        F.when((F.col("a") % step != 0) | (F.col("b") % step != 0), "off_grid")
        .when(F.col("missing") > most, "too_long")
        .when(F.col("b") > cutoff, "after_cutoff")
        .when(masked, "masked")
        .otherwise("filled")
    )
    return found.withColumn("reason", reason)


def fill_gaps(points: DataFrame, judged: DataFrame, step: int) -> DataFrame:
    """Points and, in gaps judged ``filled``, those on the line between the ends; ``imputed`` tells them apart."""
    k = F.explode(F.sequence(F.lit(1), F.col("missing"))).alias("k")
    made = judged.where("reason = 'filled'").select("series_id", "a", "va", "vb", "missing", k)
    made = made.select("series_id", (F.col("a") + F.col("k") * step).alias("t"), (F.col("va") + (F.col("vb") - F.col("va")) * F.col("k") / (F.col("missing") + 1)).alias("value"), F.lit(True).alias("imputed"))
    return points.select("series_id", "t", "value", F.lit(False).alias("imputed")).unionByName(made)


def runs(points: DataFrame, step: int) -> DataFrame:
    """Maximal runs of neighbouring slots: (series_id, start, end, slots)."""
    w = by_series()
    marked = points.withColumn("new", F.when(F.col("t") - F.lag("t").over(w) == step, 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    return marked.groupBy("series_id", "run").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("slots")).drop("run")


def longest_run(points: DataFrame, step: int) -> DataFrame:
    """The longest run of each series, the earliest of equal ones."""
    best = runs(points, step).groupBy("series_id").agg(F.min(F.struct((-F.col("slots")).alias("k"), "start", "end", "slots")).alias("m"))
    return best.select("series_id", "m.start", "m.end", "m.slots")


def run_ending_at(points: DataFrame, step: int, end: int, least: int, most: int) -> DataFrame:
    """The run that ends at ``end``, cut to its last ``most`` slots; none if it has under ``least``."""
    found = runs(points, step).where((F.col("start") <= end) & (F.col("end") >= end)).withColumn("slots", ((end - F.col("start")) / step + 1).cast("long"))
    kept = F.least(F.col("slots"), F.lit(most))
    return found.where(F.col("slots") >= least).select("series_id", (end - (kept - 1) * step).alias("start"), F.lit(end).cast("long").alias("end"), kept.alias("slots"))


def coverage_gaps(points: DataFrame, lo: int, hi: int, limit: int) -> DataFrame:
    """Stretches of [lo, hi] over ``limit`` without a point; open where no point bounds them. A series in no point: none here."""
    inside = points.where(F.col("t").between(lo, hi))
    edges = inside.groupBy("series_id").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    w = by_series()
    middle = inside.select("series_id", F.lag("t").over(w).alias("a"), F.col("t").alias("b"), F.lit(False).alias("open_left"), F.lit(False).alias("open_right"))
    left = edges.select("series_id", F.lit(lo).cast("long").alias("a"), F.col("a").alias("b"), F.lit(True).alias("open_left"), F.lit(False).alias("open_right"))
    right = edges.select("series_id", F.col("b").alias("a"), F.lit(hi).cast("long").alias("b"), F.lit(False).alias("open_left"), F.lit(True).alias("open_right"))
    return middle.unionByName(left).unionByName(right).where(F.col("b") - F.col("a") > limit)


def gap_stats(points: DataFrame, lo: int, hi: int, step: int) -> DataFrame:
    """Expected, present and missing slots of [lo, hi) and the longest gap, edges included."""
    w = by_series()
    inside = points.where((F.col("t") >= lo) & (F.col("t") < hi)).withColumn("apart", F.lead("t").over(w) - F.col("t") - step)
    expected = (hi - lo) // step
    return inside.groupBy("series_id").agg(
        F.lit(expected).cast("long").alias("expected"),
        F.count("*").alias("present"),
        (F.lit(expected) - F.count("*")).alias("missing"),
        F.greatest(F.max("apart"), F.min("t") - lo, F.lit(hi) - step - F.max("t")).alias("longest_gap"),
    )


def state_runs(states: DataFrame) -> DataFrame:
    """Runs of bad states with the healthy points around them; ``states``: series_id, t, bad."""
    w = by_series()
    marked = states.withColumn("flip", F.when(F.col("bad") == F.lag("bad").over(w), 0).otherwise(1)).withColumn("run", F.sum("flip").over(w))
    marked = marked.withColumn("before", F.lag("t").over(w)).withColumn("after", F.lead("t").over(w))
    found = marked.groupBy("series_id", "run").agg(F.first("bad").alias("bad"), F.min("t").alias("first_bad"), F.max("t").alias("last_bad"), F.min_by("before", "t").alias("healthy_before"), F.max_by("after", "t").alias("healthy_after"), F.count("*").alias("points"))
    return found.where("bad").drop("run", "bad")


def longest_over(points: DataFrame, step: int, limit: float, least: int) -> DataFrame:
    """Longest run of neighbouring slots over ``limit``; an alarm if it has ``least`` slots or more."""
    over = runs(points.where(F.col("value") > limit), step).groupBy("series_id").agg(F.max("slots").alias("longest"))
    return points.select("series_id").distinct().join(over, "series_id", "left").select("series_id", F.coalesce("longest", F.lit(0)).alias("longest"), (F.coalesce("longest", F.lit(0)) >= least).alias("alarm"))


def capped_windows(points: DataFrame, judged: DataFrame, step: int, most_share: float) -> DataFrame:
    """The longest run of each series after filling (the earliest of equal ones) in which filled slots are at most ``most_share``.

    While a run has more, its latest filled gap is opened again and the longest run is looked for anew. Rows: series_id, start, end,
    slots, filled, removed (gaps opened). What a task gets of a series is one row for each stretch of observed slots and the filled
    gap after it, never its slots.
    """
    observed = runs(points, step)
    bridges = judged.where("reason = 'filled'").select("series_id", F.col("a").alias("end"), "missing")
    stretches = observed.join(bridges, ["series_id", "end"], "left").select("series_id", "start", "slots", F.coalesce("missing", F.lit(0)).alias("bridge"))
    return stretches.groupBy("series_id").applyInPandas(_capped(step, most_share), "series_id string, start long, end long, slots long, filled long, removed int")


def _capped(step: int, most_share: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start")
        rows = list(zip(pdf["start"].tolist(), pdf["slots"].tolist(), pdf["bridge"].tolist(), strict=True))
        blocks, own = [], []  # (-slots, start, stretches); stretches of a block are joined by filled gaps

        def push(part: list) -> None:
            heapq.heappush(blocks, (-sum(n for _, n, _ in part) - sum(b for _, _, b in part[:-1]), part[0][0], part))

        for row in rows:
            own.append(row)
            if not row[2]:
                push(own)
                own = []
        removed = 0
        while True:
            size, start, part = heapq.heappop(blocks)
            filled = sum(b for _, _, b in part[:-1])
            if filled <= most_share * -size:
                return pd.DataFrame([(pdf["series_id"].iloc[0], start, start + (-size - 1) * step, -size, filled, removed)], columns=["series_id", "start", "end", "slots", "filled", "removed"])
            removed += 1
            push(part[:-1])
            push(part[-1:])

    return run


def eligible_origins(filled: DataFrame, steps: int) -> DataFrame:
    """Origins that were observed and whose next ``steps`` slots all were; ``filled`` is a whole grid with value and imputed."""
    ahead = by_series().rowsBetween(1, steps)
    genuine = F.when(F.col("value").isNotNull() & ~F.coalesce("imputed", F.lit(False)), 1).otherwise(0)
    return filled.withColumn("own", genuine).withColumn("next", F.sum("own").over(ahead)).where((F.col("own") == 1) & (F.col("next") == steps)).select("series_id", "t")
