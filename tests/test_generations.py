"""Fits in generations against least squares; which generation serves; components behind recorded issuances."""

import random

import numpy as np
from pyspark.sql import functions as F

from loadloom.operators import forecasts, generations, served

HOUR, DAY, T0 = 3600, 86400, 1_704_067_200


def points(spark, days, missing):
    rng = random.Random(7)
    rows = [(s, T0 + k * HOUR, None if missing(s, k) else 50 + 20 * np.sin(k / 4) + rng.random() * 9) for s in "ab" for k in range(24 * days)]
    return spark.createDataFrame([(s, t, None if v is None else float(v)) for s, t, v in rows], "series_id string, t long, value double")


def test_generations_equal_least_squares_and_fall_back_once(spark):
    grid = points(spark, 12, lambda s, k: (s == "b" and 150 < k < 260 and k % 3 == 0) or k in (77, 78))
    left = generations.residuals(grid, DAY, False)
    fits = {(r.series_id, r.boundary): r for r in generations.ar_generations(left, HOUR, 6 * HOUR, 7 * DAY, 110, 6 * HOUR).collect()}
    raw = {(r.series_id, r.t): r.raw for r in left.collect()}
    assert {r.status for r in fits.values()} >= {"ok", "few_rows"}
    for (s, b), fit in fits.items():
        x, y = [], []
        for t in range(b - 7 * DAY + 4 * HOUR, b + 1, HOUR):
            row = [raw.get((s, t - k * HOUR)) for k in range(4)]
            if None not in row:
                x.append([1.0, *row[1:]])
                y.append(row[0])
        assert fit.n == len(y)
        if fit.status == "ok":
            assert np.allclose([fit.c0, fit.c1, fit.c2, fit.c3], np.linalg.lstsq(np.array(x), np.array(y), rcond=None)[0], atol=1e-6)
        else:
            assert fit.status != "few_rows" or len(y) < 110
    got = generations.generation_forecast(grid, DAY, 6, HOUR, 6 * HOUR, 7 * DAY, 110, 6 * HOUR).collect()
    assert len(got) == 2 * 12 * 24 * 6
    for r in got:
        own = r.origin // (6 * HOUR) * 6 * HOUR
        ok = [b for b in (own, own - 6 * HOUR) if (r.series_id, b) in fits and fits[r.series_id, b].status == "ok"]
        assert r.generation == (ok[0] if ok else None)
        assert r.stale == (ok[0] != own if ok else None)
        assert (r.status == "ok") == (r.predicted is not None) == (r.reason is None)
    assert {r.stale for r in got} == {True, False, None}
    once = forecasts.profile_ar(grid, DAY, 6, HOUR, 7 * DAY, 110, 6 * HOUR).where(F.col("origin") % (6 * HOUR) == 0).where("predicted is not null")
    fresh = {(r.series_id, r.origin, r.step): r.predicted for r in got if not r.stale and r.origin % (6 * HOUR) == 0}
    assert once.count() and all(abs(fresh[r.series_id, r.origin, r.step] - r.predicted) < 1e-6 for r in once.collect())


def test_served_components_have_a_status_for_every_step(spark):
    grid = points(spark, 9, lambda s, k: k == 200)
    at = T0 + 205 * HOUR
    six = lambda o, **odd: [(k, o + k * HOUR + odd.get("move", 0) * (k == 3), odd.get("rpm", 1.5)) for k in range(1, 7)]
    rows = [("a", at, 4, six(at)), ("a", at - HOUR, 6, six(at - HOUR)), ("a", at + HOUR, 4, six(at + HOUR, move=60)), ("a", at + 2 * HOUR, 4, six(at + 2 * HOUR, rpm=float("inf"))), ("b", at, 4, six(at, rpm=None)),
            ("b", at + HOUR, 0, six(at + HOUR)), ("b", None, 4, six(at)), ("b", at + 2 * HOUR, 4, []), ("b", at + 3 * HOUR, 4, None), ("a", T0 + 200 * HOUR, 4, six(T0 + 200 * HOUR)), ("a", T0 + 3 * HOUR, 4, six(T0 + 3 * HOUR)), ("a", T0 + 2 * HOUR, 4, six(T0 + 2 * HOUR))]
    issued = spark.createDataFrame(rows, "series_id string, origin long, sequence_length int, forecasts array<struct<step:int,target:long,rpm:double>>")
    got = {}
    for r in served.served_components(issued, grid, forecasts.profile_forecast(grid, DAY, 7, 1, 6, HOUR), DAY, HOUR).collect():
        got.setdefault((r.series_id, r.origin), {}).setdefault(r.predictor, []).append((r.step, r.status, r.detail))
    status = lambda s, o, p: {x[1] for x in got[s, o][p]}
    assert len(got) == 8 and all(len(v) == 6 for c in got.values() for v in c.values())  # four issuances are unusable
    assert all(status("a", at, p) == {"ok"} for p in served.PREDICTORS)
    assert status("a", at - HOUR, "seasonal") == {"unavailable"} and status("a", at - HOUR, "persistence") == {"ok"}  # six slots reach the hole
    assert all(status("a", at + HOUR, p) == {"failed"} for p in served.PREDICTORS)
    assert status("a", at + 2 * HOUR, "served") == {"non_finite"} and status("b", at, "served") == {"unavailable"}
    assert status("a", T0 + 200 * HOUR, "persistence") == {"unavailable"}
    assert status("a", T0 + 3 * HOUR, "previous_day") == {"unavailable"} == status("a", T0 + 3 * HOUR, "seasonal")
    assert {d for _, _, d in got["a", T0 + 3 * HOUR]["seasonal"]} == {"no support"} and {d for _, _, d in got["a", T0 + 2 * HOUR]["seasonal"]} == {"invalid input window"}
