"""Repetition logs read in splits, percentiles of one list, and the paired bootstrap against plain loops."""

import random

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from loadloom.operators import aggregates, studies

LOG = """noise before any header
  lstm  seed 1: MAE 9.0  [1.0s]
=== ramp (data seed -3, short history, 40 epochs, unseeded)
  lstm  seed None: MAE 12.5  [3.1s]
  gru  seed 7: MAE non-finite forecast  [0.4s]
  lstm  seed 8: MAE 80.25   DIVERGED  [2.0s]
some other line
  lstm  seed 9: MAE no scored origins  [2.0s]
=== step (data seed 4, long history, 10 epochs, unseeded)
  lstm  seed 9: MAE 0  [2.0s]
  lstm  seed x: MAE 5  [2.0s]
"""


def test_logs_carry_their_header_over_splits(spark, tmp_path):
    filler = "".join(f"=== s{k} (data seed {k}, long history, 5 epochs, unseeded)\n" + "".join(f"  a{j % 2}  seed {j}: MAE {k + j}.5  [1.0s]\n" for j in range(60)) for k in range(20))
    (tmp_path / "a.log").write_text(LOG)
    (tmp_path / "b.log").write_text(filler)
    keys = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5  # files are read in several splits
        rows = studies.read_repetitions(spark, str(tmp_path))
        got = sorted(map(tuple, rows.where("scenario in ('ramp', 'step')").select("scenario", "data_seed", "history", "epochs", "arm", "rep", "model_seed", "mae", "failure", "seconds").collect()), key=str)
        assert got == sorted([
            ("ramp", -3, "short", 40, "lstm", 1, None, 12.5, None, 3.1), ("ramp", -3, "short", 40, "gru", 1, 7, None, "non_finite_forecast", 0.4), ("ramp", -3, "short", 40, "lstm", 2, 8, 80.25, None, 2.0),
            ("ramp", -3, "short", 40, "lstm", 3, 9, None, "no_scored_origins", 2.0), ("step", 4, "long", 10, "lstm", 1, 9, 0.0, None, 2.0), ("step", 4, "long", 10, "lstm", 2, None, 5.0, None, 2.0),
        ], key=str)
        many = rows.where("scenario like 's_' or scenario like 's__'").collect()
        assert sorted((r.data_seed, r.arm, r.rep, r.mae) for r in many) == sorted((k, f"a{j % 2}", j // 2 + 1, k + j + 0.5) for k in range(20) for j in range(60))
        told = {(r.scenario, r.arm): r for r in studies.repetition_summary(rows, 40.0).collect()}
        r = told["ramp", "lstm"]
        assert (r.runs, r.successful, r.failed, r.no_scored_origins, r.non_finite_forecast, r.over, r.least, r.most, r.spread) == (3, 2, 1, 1, 0, 1, 12.5, 80.25, 6.42)
        assert told["step", "lstm"].spread is None and told["ramp", "gru"].least is None
        (tmp_path / "c.log").write_text("=== x (data seed 1, long history, 5 epochs, unseeded)\n  a  seed 1: MAE perhaps  [1.0s]\n")
        with pytest.raises(SparkRuntimeException, match="perhaps"):
            studies.read_repetitions(spark, str(tmp_path / "c.log")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_percentiles_of_one_list_equal_one_at_a_time(spark):
    rng = random.Random(2)
    rows = [(k, t, float(rng.randrange(5)), 0.3**t) for k in range(40) for t in range(rng.randrange(1, 8))]
    points = spark.createDataFrame(rows, "k int, t int, value double, weight double")
    many = studies.weighted_percentiles(points, {"p10": F.lit(0.1), "p50": F.lit(0.5), "p75": F.lit(0.75), "by_key": F.col("k") / 40}, "k")
    got = {r.k: r for r in many.collect()}
    for name, q in (("p10", 0.1), ("p50", 0.5), ("p75", 0.75)):
        for r in aggregates.weighted_percentile(points, q, "k").collect():
            assert abs(got[r.k][name] - r.value) < 1e-9
    assert all(got[k].support == sum(r[0] == k for r in rows) for k in got)
    assert abs(got[30].by_key - got[30].p75) < 1e-12


def test_paired_bootstrap_equals_a_loop(spark):
    m = (1 << 32) - 1

    def drawn(d, i, n, seed):
        x = (d * 668265263 + i * 374761393 + seed * 974711) % (1 << 32)
        x = ((x ^ (x >> 15)) * 40503) % (1 << 32)
        x = ((x ^ (x >> 13)) * 60493) % (1 << 32)
        return ((x ^ (x >> 16)) & m) % n

    rng = random.Random(4)
    diffs = {s: [float(rng.randrange(-9, 14)) for _ in range(n)] for s, n in (("a", 12), ("b", 1), ("c", 30))}
    table = spark.createDataFrame([(s, day, v) for s, vs in diffs.items() for day, v in enumerate(vs)], "series_id string, day long, diff double")
    for r in studies.paired_bootstrap(table, 101, 5).collect():
        vs = diffs[r.series_id]
        means = sorted(sum(vs[drawn(d, i, len(vs), 5)] for i in range(len(vs))) / len(vs) for d in range(101))
        p = min(1, 2 * min((sum(x <= 0 for x in means) + 1) / 102, (sum(x >= 0 for x in means) + 1) / 102))
        assert (r.n, r.mean, r.low, r.high) == (len(vs), sum(vs) / len(vs), means[2], means[98]) and abs(r.p - p) < 1e-12
