"""From measured days of several arms to reasons and an outcome for each candidate."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from loadloom.operators.evaluation import outcome_of
from loadloom.operators.outcomes import holm
from loadloom.operators.studies import paired_bootstrap

#: How near mean surpluses must be (relative to the comparator's, and at least) for two arms to be compared.
SURPLUS_RELATIVE, SURPLUS_FLOOR = 0.05, 0.05


class Comparison(NamedTuple):
    """``arm`` against ``other`` on a metric of the days; ``margin`` for noninferiority, else ``benefit`` the least relative reduction."""

    arm: str
    other: str
    key: str
    margin: float | None = None
    benefit: float | None = None

    @property
    def name(self) -> str:
        return f"{self.key} vs {self.other}"


def compared(days: DataFrame, comparisons: Sequence[Comparison], draws: int, seed: int, level: float) -> DataFrame:
    """One row for each study and comparison: n, means of both arms, mean difference with interval and p, surplus_matched, verdict.

    ``days``: study, arm, seed, valid, surplus and the metrics. A day of one arm pairs with the other arm's of the same seed where both are
    valid. Noninferiority: pass if the interval ends within the margin, fail if it begins beyond it, else inconclusive. Benefit: pass if
    the reduction is large enough, the difference below 0, the surplus matched, and Holm's step-down over all benefit
    comparisons of the study rejects.
    """
    # a day goes to the comparisons its arm takes part in, and the pair meets by aggregation
    roles = F.filter(F.array(*[F.when(F.col("arm").isin(c.arm, c.other), F.struct(F.lit(i).alias("no"), (F.col("arm") == c.arm).alias("own"), F.col(c.key).cast("double").alias("v"))) for i, c in enumerate(comparisons)]), lambda x: x.isNotNull())
    sent = days.where("valid").select("study", "seed", "surplus", F.explode(roles).alias("r"))
    of = lambda own, c: F.max(F.when(F.col("r.own") == own, F.col(c)))
    pairs = sent.groupBy("study", F.col("r.no").alias("no"), "seed").agg(of(True, "r.v").alias("a"), of(False, "r.v").alias("b"), of(True, "surplus").alias("sa"), of(False, "surplus").alias("sb")).where("a is not null and b is not null")
    pairs = pairs.withColumn("series_id", F.concat_ws("|", "study", "no"))
    tests = paired_bootstrap(pairs.select("series_id", F.col("seed").alias("day"), (F.col("a") - F.col("b")).alias("diff")), draws, seed)
    means = pairs.groupBy("series_id", "study", "no").agg(F.avg("a").alias("arm_mean"), F.avg("b").alias("other_mean"), F.avg("sa").alias("sa"), F.avg("sb").alias("sb"))
    asked = F.array(*[F.struct(F.lit(c.arm).alias("arm"), F.lit(c.name).alias("name"), F.lit(c.margin).cast("double").alias("margin"), F.lit(c.benefit).cast("double").alias("benefit")) for c in comparisons])
    x = means.join(tests, "series_id").withColumn("c", F.get(asked, F.col("no"))).select("*", "c.*").drop("c")
    x = x.withColumn("surplus_matched", F.abs(F.col("sa") - F.col("sb")) <= F.greatest(SURPLUS_RELATIVE * F.col("sb"), F.lit(SURPLUS_FLOOR)))
    rejected = holm(x.where("benefit is not null").select(F.col("study").alias("family"), F.col("series_id").alias("name"), "p"), level).select(F.col("name").alias("series_id"), "rejected")
    x = x.join(rejected, "series_id", "left")
    within = F.when(F.col("high") <= F.col("margin"), "pass").when(F.col("low") > F.col("margin"), "fail").otherwise("inconclusive")
    reduction = F.when(F.col("other_mean") != 0, (F.col("other_mean") - F.col("arm_mean")) / F.col("other_mean")).otherwise(0.0)
    useful = (reduction >= F.col("benefit")) & F.coalesce("rejected", F.lit(False)) & (F.col("mean") < 0) & F.col("surplus_matched")
    verdict = F.when(F.col("benefit").isNotNull(), F.when(useful, "pass").otherwise("not established")).otherwise(within)
    return x.withColumn("verdict", verdict).drop("series_id", "no", "sa", "sb", "rejected")


def _said(rows: DataFrame, which: Column, kind: str, reason: Column) -> DataFrame:
    return rows.where(which).select("study", "arm", F.lit(kind).alias("class"), reason.alias("reason"))


def study_reasons(days: DataFrame, ready: DataFrame, found: DataFrame, candidates: Sequence[str], seeds: Sequence[int], least_share: float) -> DataFrame:
    """Reasons (study, arm, class, reason) that keep a candidate from passing.

    ``days`` also has cause (why a day is invalid; ``product`` is the candidate's fault), ok_minutes, observed_minutes, eligible; ``ready``: study,
    name, met; ``found``: the rows of ``compared``. Observed breaches come first; then prerequisites that are not known to be met; then what is
    missing: unusable days, and seeds of any arm without a valid one. Only a complete study without a breach is judged by its
    numbers: noninferiority (where surpluses do not match, nothing can be said), the share of good minutes, use, and benefit.
    """
    studies = days.select("study").distinct()
    each = studies.withColumn("arm", F.explode(F.array(*[F.lit(c) for c in candidates])))
    day = F.concat(F.col("arm_"), F.lit("/"), F.col("seed").cast("string"))
    for_all = lambda rows: rows.withColumnRenamed("arm", "arm_").join(each, "study")
    bad = for_all(days.where(~F.col("valid")).select("study", "arm", "seed", "cause"))
    product = F.coalesce(F.col("cause") == "product", F.lit(False))
    reasons = _said(bad, product, "FAIL", F.concat(F.lit("invalid by the product: "), day))
    reasons = reasons.unionByName(_said(ready.join(each, "study"), ~F.coalesce("met", F.lit(False)), "NOT READY", F.concat(F.lit("prerequisite not met: "), F.col("name"))))
    reasons = reasons.unionByName(_said(bad, ~product, "INCOMPLETE", F.concat(F.lit("unusable day "), day, F.lit(": "), F.coalesce("cause", F.lit("unknown")))))
    have = days.groupBy("study", "arm").agg(F.collect_set(F.when(F.col("valid"), F.col("seed"))).alias("have"))
    lacking = have.withColumn("seed", F.explode(F.array_except(F.array(*[F.lit(s).cast("bigint") for s in seeds]), "have")))
    reasons = reasons.unionByName(_said(for_all(lacking.drop("have")), F.lit(True), "INCOMPLETE", F.concat(F.lit("no valid day "), day)))
    judged = each.join(reasons.select("study", "arm").distinct(), ["study", "arm"], "left_anti")
    own = found.join(judged, ["study", "arm"])
    worse = own.where("margin is not null")
    reasons = reasons.unionByName(_said(worse, ~F.col("surplus_matched"), "INCONCLUSIVE", F.concat(F.col("name"), F.lit(": surplus not matched"))))
    reasons = reasons.unionByName(_said(worse, F.col("surplus_matched") & (F.col("verdict") == "fail"), "FAIL-STAT", F.concat(F.col("name"), F.lit(": beyond the margin"))))
    reasons = reasons.unionByName(_said(worse, F.col("surplus_matched") & (F.col("verdict") == "inconclusive"), "INCONCLUSIVE", F.concat(F.col("name"), F.lit(": crosses the margin"))))
    sums = days.where("valid").groupBy("study", "arm").agg(F.sum("ok_minutes").alias("ok"), F.sum("observed_minutes").alias("seen"), F.max("eligible").alias("used")).join(judged, ["study", "arm"])
    reasons = reasons.unionByName(_said(sums, F.coalesce(F.col("ok") / F.nullif("seen", F.lit(0)), F.lit(0.0)) < least_share, "FAIL-STAT", F.lit("share of good minutes")))
    reasons = reasons.unionByName(_said(sums, F.coalesce(F.col("used"), F.lit(0)) <= 0, "INCONCLUSIVE", F.lit("never used")))
    useful = own.where("benefit is not null and verdict = 'pass'").select("study", "arm").distinct()
    return reasons.unionByName(_said(judged.join(useful, ["study", "arm"], "left_anti"), F.lit(True), "INCONCLUSIVE", F.lit("no useful benefit")))


def study_outcomes(days: DataFrame, reasons: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """Outcome of each study and candidate, and how many reasons it has; PASS without any."""
    each = days.select("study").distinct().withColumn("arm", F.explode(F.array(*[F.lit(c) for c in candidates])))
    return outcome_of(each.join(reasons.select("study", "arm", "class"), ["study", "arm"], "left"), "study", "arm")
