"""Streaming jobs give the batch's rows, also after a restart from their checkpoint."""

import pytest
from pyspark.sql import functions as F

from loadloom.streaming import jobs

SCHEMA = "series_id string, t long, value double, ts timestamp"


@pytest.fixture
def source(spark, tmp_path):
    """Three files of points, then one far ahead that moves the watermark past all of them."""
    rows = [(s, 1_704_067_200 + 60 * k, float(k % 7)) for s in "ab" for k in range(200) if k % (3 if s == "a" else 5)]
    parts = [rows[0::3], rows[1::3], rows[2::3], [("a", 1_704_067_200 + 10**6, 0.0), ("b", 1_704_067_200 + 10**6, 0.0)]]

    def add(k):
        df = spark.createDataFrame(parts[k], "series_id string, t long, value double").withColumn("ts", F.timestamp_seconds("t"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    return rows, add


def stream(spark, tmp_path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def drain(df, tmp_path, mode="append"):
    q = df.writeStream.outputMode(mode).format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()


def test_settled_counts_and_restart(spark, tmp_path, source):
    rows, add = source
    add(0)
    add(1)
    add(2)
    add(3)
    drain(jobs.settled_counts(stream(spark, tmp_path)), tmp_path)
    drain(jobs.settled_counts(stream(spark, tmp_path)), tmp_path)  # nothing new: nothing twice
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).where("t < 1705000000").collect()))
    counts = {}
    for s, t, _ in rows:
        counts[s, t // 600 * 600] = counts.get((s, t // 600 * 600), 0) + 1
    late = {k for k in counts if k not in {g[:2] for g in got}}
    assert got and all(counts[g[:2]] >= g[2] for g in got) and not late


def test_first_receipts(spark, tmp_path, source):
    rows, add = source
    for k in (0, 0, 1, 2):
        add(k)
    drain(jobs.first_receipts(stream(spark, tmp_path), "1 day"), tmp_path)
    got = sorted((r.series_id, r.t) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((s, t) for s, t, _ in rows)


def test_levels_are_counted_once(spark, tmp_path):
    rows = [("a", k, k % 4 == 0) for k in range(40)] + [("b", k, k % 9 == 0) for k in range(25)]
    spark.createDataFrame([*rows, *rows[:7]], "series_id string, seq long, missed boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    outcomes = spark.readStream.schema("series_id string, seq long, missed boolean").parquet(str(tmp_path / "in"))
    drain(jobs.adaptive_levels(outcomes), tmp_path)
    got = {(r.series_id, r.seq): r.level for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    for s in "ab":
        level = 10_000_000
        for x, k, missed in rows:
            if x == s:
                level = max(0, min(10**8, level + 500_000 * (10_000_000 - (10**8 if missed else 0)) // 10**8))
                assert got[s, k] == level
    assert len(got) == len(rows)


def test_batch_windows(spark, source):
    rows, _ = source
    df = spark.createDataFrame(rows, "series_id string, t long, value double").withColumn("ts", F.timestamp_seconds("t"))
    assert jobs.sessions(df, "90 seconds").agg(F.sum("beats")).first()[0] == len(rows)
    assert jobs.sliding_counts(df, "20 minutes", "10 minutes").agg(F.sum("n")).first()[0] == 2 * len(rows)


def test_matured_targets(spark, tmp_path):
    """Every target comes once: with its value where a receipt came, else with NULL when none can come any more."""
    t0 = 1_704_067_200
    issued = [("a", t0 + 600 * k, 1.0 + k) for k in range(20)]
    values = [("a", t0 + 600 * k, float(k)) for k in range(20) if k % 4]
    far = t0 + 10**6
    spark.createDataFrame([*issued, ("z", far, 0.0)], "series_id string, t long, predicted double").withColumn("target_ts", F.timestamp_seconds("t")).drop("t").coalesce(1).write.parquet(str(tmp_path / "issued"))
    spark.createDataFrame([*values, ("z", far, 0.0)], "series_id string, t long, value double").withColumn("ts", F.timestamp_seconds("t")).coalesce(1).write.parquet(str(tmp_path / "seen"))
    left = spark.readStream.schema("series_id string, predicted double, target_ts timestamp").parquet(str(tmp_path / "issued"))
    right = spark.readStream.schema("series_id string, t long, value double, ts timestamp").parquet(str(tmp_path / "seen"))
    drain(jobs.matured(left, right), tmp_path)
    got = {(r.series_id, int(r.target_ts.timestamp())): r.actual for r in spark.read.parquet(str(tmp_path / "out")).where("series_id = 'a'").collect()}
    assert got == {("a", t0 + 600 * k): float(k) if k % 4 else None for k in range(20)}
