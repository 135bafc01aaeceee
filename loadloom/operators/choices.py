"""Choices that look back at what was chosen before, and the evidence that they rest on."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from loadloom.operators.folds import fold_rows
from loadloom.operators.outcomes import draw
from loadloom.operators.windows import trailing_sums


def _gain(reference: str, candidate: str) -> Column:
    """How much less the candidate's error is; NULL where either is not usable."""
    known = F.col(reference).isNotNull() & F.col(candidate).isNotNull()
    return F.when(known, F.round(F.when(F.col(reference) > 0, (F.col(reference) - F.col(candidate)) / F.col(reference)).otherwise(0.0), 12))


def _pooled(parts: DataFrame, arms: Sequence[str], pool: int, *keys: str) -> DataFrame:
    """Error sums over each partition and those before it; an arm that lacks one of them is NULL."""
    w = Window.partitionBy(*keys).orderBy("part").rowsBetween(1 - pool, 0)
    return parts.withColumns({a: F.when(F.count(a).over(w) == F.count("*").over(w), F.sum(a).over(w)) for a in arms} | {"parts": F.count("*").over(w), "origins": F.sum("n").over(w)})


def resampled_sums(placed: DataFrame, arms: Sequence[str], draws: int, block: int, seed: int) -> DataFrame:
    """Error sums of ``draws`` moving-block resamples of every partition: series_id, part, draw, n and the arms.

    ``placed``: series_id, part, i (place from 0), n and the arms. An origin carries the sum of the block that begins at it, and that of
    the short block which may end a resample, so a draw meets a row for each block, not for each origin.
    """
    order = Window.partitionBy("series_id", "part").orderBy("i").rowsBetween(0, block - 1)
    size = F.least(F.lit(block), F.col("n")).cast("int")
    blocks = F.ceil(F.col("n") / size).cast("int")
    short = (F.col("n") - (blocks - 1) * size).cast("int")
    sums = {f"{a}_{k}": F.aggregate(F.slice(F.collect_list(F.coalesce(a, F.lit(0.0))).over(order), F.lit(1), n), F.lit(0.0), lambda s, x: s + x) for a in arms for k, n in (("whole", size), ("short", short))}
    heads = placed.withColumns(sums).select("series_id", "part", F.col("i").alias("first"), *sums)
    asked = placed.where("i = 0").select("series_id", "part", "n", blocks.alias("blocks"), size.alias("size")).select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    asked = asked.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    asked = asked.withColumn("first", draw(F.col("n") - F.col("size") + 1, F.col("draw"), F.col("part") * 1009 + F.col("b"), seed).cast("int"))
    last = F.col("b") == F.col("blocks") - 1
    return asked.join(heads, ["series_id", "part", "first"]).groupBy("series_id", "part", "draw").agg(F.first("n").alias("n"), *[F.sum(F.when(last, F.col(f"{a}_short")).otherwise(F.col(f"{a}_whole"))).alias(a) for a in arms])


def incumbent_choice(errors: DataFrame, baseline: str, candidates: Sequence[str], draws: int, block: int, seed: int, pool: int = 3, least_gain: float = 0.05, hold_gain: float = 0.0, quantile: float = 0.1) -> DataFrame:
    """What each training (a partition of origins) chooses for its series, given what the one before it chose.

    ``errors``: series_id, part (long, in order of training), t and a column of errors for each arm; origins without the baseline's are
    left out, and a candidate that lacks an origin of a pooled partition takes no part. Evidence is pooled over the ``pool`` latest
    partitions. A candidate beats a reference if it gains ``least_gain`` and its gain stays above 0 at the ``quantile`` of the
    resamples. The choice before is the incumbent while it gains ``hold_gain`` over the baseline: it stays unless another beats it.
    Else the largest gain of those that beat the baseline wins, the earlier of equal ones, or the baseline stays.

    Gives series_id, part, parts, origins, previous, incumbent, chosen, path (challenged, held, won, fell, none).
    """
    arms, names = [baseline, *candidates], list(candidates)
    w = Window.partitionBy("series_id", "part")
    placed = errors.where(F.col(baseline).isNotNull()).select("series_id", "part", *arms, (F.row_number().over(w.orderBy("t")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    sums = placed.groupBy("series_id", "part").agg(F.count("*").alias("n"), *[F.when(F.count(a) == F.count("*"), F.sum(a)).alias(a) for a in arms])
    usable = sums.select("series_id", "part", *[F.col(a).isNotNull().alias(f"{a}_whole") for a in names])
    drawn = resampled_sums(placed, arms, draws, block, seed).join(usable, ["series_id", "part"])
    drawn = drawn.withColumns({a: F.when(F.col(f"{a}_whole"), F.col(a)) for a in names})
    pairs = [(r, c) for r in arms for c in names if r != c]
    place = int(quantile * draws)  # of at most `draws` sorted numbers
    lower = _pooled(drawn, arms, pool, "series_id", "draw").groupBy("series_id", "part").agg(*[F.get(F.array_sort(F.collect_list(_gain(r, c))), F.lit(place)).alias(f"lower_{k}") for k, (r, c) in enumerate(pairs)])
    point = _pooled(sums, arms, pool, "series_id").select("series_id", "part", "parts", "origins", *[_gain(r, c).alias(f"gain_{k}") for k, (r, c) in enumerate(pairs)])
    rows = point.join(lower, ["series_id", "part"]).select("series_id", "part", "parts", "origins", *[f"{x}_{k}" for k in range(len(pairs)) for x in ("gain", "lower")])

    def turn(previous: str | None, row: tuple) -> tuple[str, tuple]:
        series, part, parts, origins, *rest = row
        gain = dict(zip(pairs, rest[::2], strict=True))
        beats = {p: g is not None and g >= least_gain and low > 0 for p, g, low in zip(pairs, rest[::2], rest[1::2], strict=True)}
        usable_before = previous in names and gain[baseline, previous] is not None
        incumbent = previous if usable_before and gain[baseline, previous] >= hold_gain else None
        against = incumbent or baseline
        winners = [c for c in names if c != incumbent and beats[against, c]]
        if winners:
            chosen, path = max(winners, key=lambda c: (gain[against, c], -names.index(c))), "challenged" if incumbent else "won"
        else:
            chosen, path = against, "held" if incumbent else "fell" if usable_before else "none"
        return chosen, (series, part, parts, origins, previous, incumbent, chosen, path)

    return fold_rows(rows, ["part"], lambda: None, turn, "series_id string, part long, parts long, origins long, previous string, incumbent string, chosen string, path string")


def pinball(actual: Column, bound: Column, miss: float) -> Column:
    """Loss of an upper bound that may be missed with probability ``miss``."""
    return F.when(actual >= bound, (1 - miss) * (actual - bound)).otherwise(miss * (bound - actual))


def paired_evidence(losses: DataFrame, seconds: int = 7 * 86400) -> DataFrame:
    """What is known at every paired outcome of a challenger against the baseline: pairs, loss sums of both, span of their ends.

    ``losses``: series_id, t (end of the window), challenger and baseline (loss or NULL); rows that lack one are no pairs. The trailing window
    is cut at whole hours.
    """
    paired = losses.where(F.col("challenger").isNotNull() & F.col("baseline").isNotNull())
    found = trailing_sums(paired, seconds, pairs=F.lit(1), challenger=F.col("challenger"), baseline=F.col("baseline"))
    return found.withColumn("span", F.col("t") - F.col("first")).drop("first")


def challenger_bands(evidence: DataFrame, costs: DataFrame, least_pairs: int, least_span: int, enter: float = 0.95, stay: float = 1.0, cost: float = 1.02) -> DataFrame:
    """Whether the evidence lets a challenger in (``enters``) and lets it stay (``stays``), with its loss ratio.

    ``costs``: series_id, t, and name_challenger with name_baseline for every cost. Both bands ask for enough pairs over a long enough span,
    a baseline loss above 0, and every cost known and at most ``cost`` times the baseline's; they differ in the loss ratio alone.
    """
    names = sorted(c.removesuffix("_challenger") for c in costs.columns if c.endswith("_challenger"))
    both = evidence.join(costs, ["series_id", "t"], "left")
    cheap = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"{n}_challenger") <= cost * F.col(f"{n}_baseline"), F.lit(False)) for n in names])
    basis = (F.col("pairs") >= least_pairs) & (F.col("span") >= least_span) & (F.col("baseline") > 0) & cheap
    ratio = F.when(F.col("baseline") > 0, F.round(F.col("challenger") / F.col("baseline"), 9))
    bands = {k: basis & F.coalesce(ratio <= x, F.lit(False)) for k, x in (("enters", enter), ("stays", stay))}
    return both.select("series_id", "t", "pairs", "span", ratio.alias("ratio"), *[c.alias(k) for k, c in bands.items()])
