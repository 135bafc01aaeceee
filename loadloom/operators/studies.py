"""Paired resampling, a study of percentile rules, and summaries of repetition logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from loadloom.functions.scalars import ratio
from loadloom.operators.outcomes import draw
from loadloom.operators.ranges import carry_forward


def paired_bootstrap(diffs: DataFrame, draws: int, seed: int) -> DataFrame:
    """Mean of paired differences (series_id, day, diff) with whole days drawn again: n, mean, low and high (2.5 % and 97.5 %), p.

    The ends are the draws' means at floor(0.025 draws) and ceil(0.975 draws) - 1, in order; p is twice the smaller share of draws on
    either side of 0, each with one added above and below, at most 1. Days are numbered and joined to the drawn numbers.
    """
    w = Window.partitionBy("series_id")
    placed = diffs.withColumns({"i": F.row_number().over(w.orderBy("day")) - 1, "n": F.count("*").over(w)})
    asked = placed.select("series_id", "n", F.col("i").alias("place"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    asked = asked.select("series_id", "draw", "n", draw(F.col("n"), F.col("draw"), F.col("place"), seed).cast("int").alias("i"))
    means = asked.join(placed.drop("n"), ["series_id", "i"]).groupBy("series_id", "draw").agg((F.sum("diff") / F.max("n")).alias("m"))
    ranked = means.withColumn("r", F.row_number().over(w.orderBy("m", "draw")) - 1)
    at = lambda k: F.max(F.when(F.col("r") == k, F.col("m")))
    side = lambda c: (F.count_if(c) + 1) / (draws + 1)
    ends = ranked.groupBy("series_id").agg(at(int(0.025 * draws)).alias("low"), at(min(draws - 1, -int(-0.975 * draws // 1) - 1)).alias("high"), F.least(F.lit(1.0), 2 * F.least(side(F.col("m") <= 0), side(F.col("m") >= 0))).alias("p"))
    return diffs.groupBy("series_id").agg(F.count("*").alias("n"), (F.sum("diff") / F.count("*")).alias("mean")).join(ends, "series_id")


def weighted_percentiles(points: DataFrame, ranks: dict[str, Column], *keys: str) -> DataFrame:
    """Several weighted percentiles of each group's values in one pass over one sorted list; support is the list's length.

    ``points``: the keys, value, t (breaks ties), weight; a group is as small as the days that a pattern looks back on. ``ranks``: name to
    rank, a constant or a column that depends on the keys (its columns must be among them).
    """
    s = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("value", "t", "weight"))).alias("s"))
    up_to = lambda i: F.aggregate(F.slice("s", 1, i), F.lit(0.0), lambda a, x: a + x["weight"])
    s = s.withColumn("total", up_to(F.size("s")))
    s = s.withColumn("s", F.transform("s", lambda x, i: F.struct(((up_to(i + 1) - x["weight"] / 2) / F.col("total")).alias("at"), x["value"].alias("value"))))

    def value(q: Column) -> Column:
        lo, hi = F.try_element_at(F.filter("s", lambda x: x["at"] <= q), F.lit(-1)), F.try_element_at(F.filter("s", lambda x: x["at"] >= q), F.lit(1))
        between = lo["value"] + (hi["value"] - lo["value"]) * (q - lo["at"]) / (hi["at"] - lo["at"])
        return F.when(lo.isNull(), hi["value"]).when(hi.isNull() | (hi["at"] == lo["at"]), lo["value"]).otherwise(between)

    return s.select(*keys, F.size("s").alias("support"), *[value(q).alias(name) for name, q in ranks.items()])


def rule_scores(cells: DataFrame, rules: list[str]) -> DataFrame:
    """For each series, rule and step (0: all): scored, skipped (no value or no actual), mae, bias (over-prediction above 0), under_rate."""
    told = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("value")) for r in rules]))
    rows = cells.select("series_id", "actual", F.explode(F.array(F.lit(0), F.col("step"))).alias("step"), told.alias("r"))
    e = F.col("r.value") - F.col("actual")
    return rows.groupBy("series_id", F.col("r.rule").alias("rule"), "step").agg(F.count(e).alias("scored"), F.count_if(e.isNull()).alias("skipped"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), ratio(F.count_if(F.coalesce(e < 0, F.lit(False))).cast("double"), F.count(e).cast("double")).alias("under_rate"))


HEADER = r"^=== (\w+) \(data seed (-?\d+), (\w+) history, (\d+) epochs, unseeded\)"
REPETITION = r"^\s{2}(\S+)\s+seed\s+(\S+): MAE (.+?)(\s+DIVERGED)?\s+\[([\d.]+)s\]\s*$"
#: The log's only wordings of a failure.
FAILURES = {"non-finite forecast": "non_finite_forecast", "no scored origins": "no_scored_origins"}


def read_repetitions(spark: SparkSession, path: str) -> DataFrame:
    """Repetitions of a text log in its order: file, scenario, data_seed, history, epochs, arm, rep, model_seed, mae, failure, seconds.

    A header holds for the lines after it, until the next. A file may be read in several splits: a line's place is its split's offset
    and its number within the split, each split finds the header it starts under from the ones before, and no file is read
    in one task. Lines of neither kind, and repetitions before any header, are left out. An outcome that is neither a
    number nor a known failure is refused: the query fails and names it.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("series_id"), F.col("_metadata.file_block_start").alias("t"), F.monotonically_increasing_id().alias("line"))
    of = lambda p, g: F.regexp_extract("value", p, g)
    header = F.when(F.col("value").rlike(HEADER), F.struct("t", "line", of(HEADER, 1).alias("scenario"), of(HEADER, 2).cast("bigint").alias("data_seed"), of(HEADER, 3).alias("history"), of(HEADER, 4).cast("int").alias("epochs")))
    told = lines.withColumn("header", header).where(F.col("header").isNotNull() | F.col("value").rlike(REPETITION))
    under = carry_forward(told, "header", ["t", "line"], 1, "under").where("header is null and under is not null")
    raw = F.trim(of(REPETITION, 3))
    number = raw.try_cast("double")
    kinds = F.create_map(*[F.lit(x) for kv in FAILURES.items() for x in kv])
    failure = F.when(number.isNull(), F.coalesce(kinds[raw], F.raise_error(F.concat(F.lit("unrecognised outcome in the log: "), raw))))
    rep = F.row_number().over(Window.partitionBy("series_id", "under.t", "under.line", of(REPETITION, 1)).orderBy("t", "line"))
    seed = of(REPETITION, 2)
    return under.select(
        F.col("series_id").alias("file"), "under.scenario", "under.data_seed", "under.history", "under.epochs", of(REPETITION, 1).alias("arm"), rep.alias("rep"),
        F.when(seed != "None", seed.try_cast("bigint")).alias("model_seed"), number.alias("mae"), failure.alias("failure"), of(REPETITION, 5).cast("double").alias("seconds"),
    )


def repetition_summary(repetitions: DataFrame, threshold: float) -> DataFrame:
    """Of each scenario and arm: runs, successful and failed ones, each kind of failure, how many were over the threshold, and least and largest
    error with their ratio over successful runs alone. A failure is no exceedance, and an exceedance no failure."""
    ok = F.col("failure").isNull()
    least, most = F.min(F.when(ok, F.col("mae"))), F.max(F.when(ok, F.col("mae")))
    kinds = [F.count_if(F.coalesce(F.col("failure") == k, F.lit(False))).alias(k) for k in FAILURES.values()]
    return repetitions.groupBy("scenario", "data_seed", "history", "epochs", "arm").agg(
        F.count("*").alias("runs"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"), *kinds, F.count_if(ok & (F.col("mae") > threshold)).alias("over"),
        F.round(least, 2).alias("least"), F.round(most, 2).alias("most"), F.when(least > 0, F.round(most / least, 2)).alias("spread"),
    )
