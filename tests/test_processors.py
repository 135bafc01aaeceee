"""State processors give the batch operators' rows, in any split into micro-batches and over a restart."""

import random

import pytest
from pyspark.sql import functions as F

from loadloom.operators import evaluation, outcomes
from loadloom.streaming import processors

T0, STEP, STEPS = 1_704_067_200, 600, 6
HORIZON = STEP * STEPS


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, processors.STATE_STORE)
    yield
    spark.conf.set(key, before)


def drain(df, tmp_path):
    q = df.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()


ISSUED, RECEIPTS = "series_id string, origin long, targets array<long>, bound double", "series_id string, t long, value double, received long"


def telemetry():
    """Windows of six targets and receipts: on time, after settling, after the deadline, twice, never; without a bound; of no window."""
    rng = random.Random(1)
    issued, receipts = [], []
    for s in "ab":
        for k in range(0, 40, 3):
            issued.append((s, T0 + k * STEP, [T0 + (k + j) * STEP for j in range(1, STEPS + 1)], rng.choice([4.0, 6.0, None])))
        for k in range(1, 50):
            t = T0 + k * STEP
            delay = rng.choice([1, 5, 100, 119, 400, 719, 720, 900, 5000, None] if s == "a" else [1, 30, 300])
            if delay is not None:
                receipts.append((s, t, float(rng.randrange(7)), t + delay))
                if rng.random() < 0.2:
                    receipts.append((s, t, 99.0, t + delay + 5))  # the first receipt stands
    return issued, receipts


def test_maturation_equals_the_batch_over_restarts(spark, tmp_path, rocks):
    issued, receipts = telemetry()
    far = T0 + 10**6
    cuts = [0, T0 + 4000, T0 + 4100, T0 + 12_345, far]  # issuances and receipts come in the order of time, in files of uneven size

    def put(k):
        between = lambda rows, at: [r for r in rows if cuts[k] <= r[at] < cuts[k + 1]]
        for rows, schema, to, at in ((issued, ISSUED, "issued", 1), (receipts, RECEIPTS, "seen", 3)):
            spark.createDataFrame(between(rows, at), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / to))

    def run():
        left = spark.readStream.schema(ISSUED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "issued"))
        right = spark.readStream.schema(RECEIPTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "seen"))
        drain(processors.window_maturation(left, right, HORIZON, 3 * STEP), tmp_path)

    put(0)
    put(1)
    run()
    put(2)
    put(3)
    run()  # from the checkpoint
    spark.createDataFrame([("z", far, 0.0, far)], RECEIPTS).write.mode("append").parquet(str(tmp_path / "seen"))
    run()
    out = spark.read.parquet(str(tmp_path / "out"))
    first = {}
    for s, t, v, r in receipts:
        first[s, t] = min(first.get((s, t), (r, v)), (r, v))
    once = spark.createDataFrame([(s, t, v, r) for (s, t), (r, v) in first.items()], RECEIPTS)
    batch = outcomes.window_outcomes(spark.createDataFrame(issued, ISSUED), once, far, 120, 600)
    told = lambda df: sorted(map(str, df.select("series_id", "origin", "status", "highest", "covered", "residual").collect()))
    assert told(out.where("status <> 'late'")) == told(batch)
    assert {r.status for r in batch.collect()} == {"scored", "unscorable"}
    late = {(s, o, t, r) for s, o, targets, _ in issued for rs, t, _, r in receipts if rs == s and t in targets and r > o + HORIZON + 720}
    assert late and {tuple(r) for r in out.where("status = 'late'").select("series_id", "origin", "t", "received").collect()} == late


def test_a_late_value_never_reopens(spark, tmp_path, rocks):
    targets = [T0 + STEP * j for j in range(1, STEPS + 1)]
    spark.createDataFrame([("a", T0, targets, 5.0)], ISSUED).write.parquet(str(tmp_path / "issued"))
    deadline = T0 + HORIZON + 720
    parts = [[("a", t, 1.0, t + 5) for t in targets[:-1]], [("z", T0, 0.0, deadline + 50)], [("a", targets[-1], 1.0, deadline + 60)], [("a", targets[-1], 1.0, deadline + 70), ("z", T0, 0.0, deadline + 999)]]
    for rows in parts:
        spark.createDataFrame(rows, RECEIPTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "seen"))
        left = spark.readStream.schema(ISSUED).parquet(str(tmp_path / "issued"))
        drain(processors.window_maturation(left, spark.readStream.schema(RECEIPTS).parquet(str(tmp_path / "seen")), HORIZON, HORIZON), tmp_path)
    got = sorted((r.status, r.received) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("late", deadline + 60), ("late", deadline + 70), ("unscorable", None)]


def test_levels_and_trust_equal_the_folds_over_a_restart(spark, tmp_path, rocks):
    rng = random.Random(9)
    schema = "series_id string, seq long, t long, missed boolean, healthy boolean, issued long"
    rows = [(s, k, T0 + k * 3600, rng.choice([True, False, False, False]), rng.random() > (0.02 if s == "a" else 0.1), 2) for s in "ab" for k in range(120)]
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    put = lambda part: spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    early, late = [r for r in rows if r[1] < 50], [r for r in rows if r[1] >= 50]
    put(early)
    drain(processors.calibrated_trust(read()), tmp_path)
    put(early[20:] + late[:9])  # replayed records come again
    put(late)
    drain(processors.calibrated_trust(read()), tmp_path)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == len(rows) == got.select("series_id", "seq").distinct().count()
    table = spark.createDataFrame(rows, schema)
    levels = outcomes.adaptive_level(table.select("series_id", "seq", "missed"), 10_000_000, 500_000).collect()
    ends = got.groupBy("series_id").agg(F.max_by("level", "seq").alias("level")).collect()
    assert sorted((r.series_id, r.level) for r in levels) == sorted((r.series_id, r.level) for r in ends)
    trust = evaluation.hysteresis(table.select("series_id", "t", "healthy", "issued"), 86400, 32)
    assert sorted(map(tuple, got.select("series_id", "t", "trusted").collect())) == sorted(map(tuple, trust.collect()))
    assert {r.trusted for r in got.collect()} == {True, False}
