"""Scaled forecasts against a plain loop."""

import math
import random

from pyspark.sql import functions as F

from loadloom.operators import corrections, forecasts

HOUR, DAY, T0 = 3600, 86400, 1_704_067_200


def test_ratios_equal_a_loop(spark):
    rng = random.Random(3)
    value = {k: (None if rng.random() < 0.1 else float(rng.randrange(0, 9))) for k in range(24 * 9)}
    grid = spark.createDataFrame([("a", T0 + k * HOUR, v) for k, v in value.items()], "series_id string, t long, value double")
    filled, last = {}, None
    for k, v in value.items():
        last = v if v is not None else last
        filled[k] = last

    def profile(k):
        found = [value[k - 24 * d] for d in range(1, 8) if value.get(k - 24 * d) is not None]
        return sum(found) / len(found) if found else None

    def ratio(k, reference, low, high):
        top = bottom = 0.0
        for j in range(6):
            p = reference(k - j) if k - j >= 0 else None
            if p and p > 0 and filled[k - j] is not None:
                w = math.exp(-math.log(2) / 3 * j)
                top, bottom = top + w * filled[k - j] / p, bottom + w
        return min(high, max(low, top / bottom)) if bottom else 1.0

    for r in corrections.profile_ratio(grid, DAY, 6, HOUR).collect():
        k, p = (r.origin - T0) // HOUR, profile((r.target - T0) // HOUR)
        assert abs(r.ratio - ratio(k, profile, 0.6, 1.6)) < 1e-9
        assert (r.predicted is None) == (p is None) and (p is None or abs(r.predicted - p * r.ratio) < 1e-9)
    naive = forecasts.seasonal_naive(grid, DAY, 6, HOUR)
    said = {(r.origin, r.step): r.predicted for r in naive.collect()}
    first = lambda k: said.get((T0 + (k - 1) * HOUR, 1))
    rows = corrections.bias_corrected(naive, grid).collect()
    assert len(rows) == len(said) and any(r.ratio not in (0.85, 1.0, 1.2) for r in rows)
    for r in rows:
        raw = said[r.origin, r.step]
        assert abs(r.ratio - ratio((r.origin - T0) // HOUR, first, 0.85, 1.2)) < 1e-9
        assert r.predicted is None if raw is None else abs(r.predicted - raw * r.ratio) < 1e-9
    gone = naive.withColumn("predicted", F.when(F.col("step") != 3, F.col("predicted")))
    assert corrections.bias_corrected(gone, grid).where("predicted is not null").count() == 0
