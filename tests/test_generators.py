"""Sweeps over generators and counters at boundaries against plain loops; ranges of any width give the same."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loadloom.operators import generators, joins, ranges
from loadloom.operators.grid import by_series

BEAT, RUN = "series_id string, t long", "series_id string, begin long, last long"


def brute_overlaps(runs):
    out = []
    for s in {r[0] for r in runs}:
        own = [r[1:] for r in runs if r[0] == s]
        instants = sorted({t for r in own for t in r})
        count = lambda t: sum(a <= t <= b for a, b in own)
        now = None
        for t, after in zip(instants, [*instants[1:], None], strict=True):
            between = sum(a <= t and after is not None and b >= after for a, b in own)
            if count(t) >= 2:
                now = now or [t, t, 0]
                now[1:] = [t, max(now[2], count(t))]
            if now and between < 2:
                out.append((s, *now))
                now = None
    return sorted(out)


@pytest.mark.parametrize("width", [7, 100, 10**6])
def test_sweeps_equal_loops(spark, width):
    rng = random.Random(width)
    runs = [(s, a, a + rng.choice([0, 3, 20, 60])) for s in "abc" for a in (rng.randrange(900) for _ in range(25))] + [("a", 950, 960), ("a", 960, 970), ("d", 5, 9)]
    beats = [(s, rng.randrange(1000)) for s in "abcd" for _ in range(80)] + [("e", 10)]
    table, seen = spark.createDataFrame(runs, RUN), spark.createDataFrame(beats, BEAT)
    got = sorted(map(tuple, generators.overlaps_by_sweep(table, width).select("series_id", "first", "last", "n").collect()))
    assert got == brute_overlaps(runs) and ("a", 960, 960, 2) in got
    want = []
    for s in "abcde":
        group = []
        alone = sorted(t for x, t in beats if x == s and not any(r[0] == s and r[1] - 5 <= t <= r[2] + 5 for r in runs))
        for t in [*alone, None]:
            if group and (t is None or t - group[-1] > 30):
                want.append((s, group[0], group[-1], len(group)))
                group = []
            group.append(t)
    assert sorted(map(tuple, generators.orphan_beats(table, seen, 5, 30, width).select("series_id", "first", "last", "n").collect())) == sorted(want)
    want = []
    for s in "abcde":
        at = sorted({t for x, t in beats if x == s})
        want += [(s, "gap", x, y) for x, y in zip(at, at[1:]) if y - x > 25]
        want += [(s, "gap_open_left", 0, at[0])] * (at[0] > 25) + [(s, "gap_open_right", at[-1], 1000)] * (1000 - at[-1] > 25)
    assert sorted(map(tuple, generators.beat_gaps(seen, 0, 1000, 25, width).select("series_id", "kind", "first", "last").collect())) == sorted(want)
    assert generators.generator_findings(table.limit(0), seen.limit(0), 0, 10, 1, 1, 1, width).collect() == []


def test_ranges_equal_windows_over_the_whole_series(spark):
    rng = random.Random(3)
    rows = [(s, rng.randrange(500), k, rng.choice([None, None, float(k)])) for s in "ab" for k in range(200)]
    line = spark.createDataFrame(rows, "series_id string, t long, k int, v double")
    for strict, end in ((False, 0), (True, -1)):
        want = line.withColumn("x", F.last("v", ignorenulls=True).over(by_series("t", "k").rowsBetween(-(10**9), end)))
        got = ranges.carry_forward(line, "v", ["t", "k"], 13, "x", strict)
        assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(map(tuple, want.collect()))
    want = line.withColumn("x", F.coalesce(F.sum("v").over(by_series("t", "k").rowsBetween(-(10**9), 0)), F.lit(0)))
    assert Counter(map(tuple, ranges.running_total(line, "v", ["t", "k"], 13, "x").select(*want.columns).collect())) == Counter(map(tuple, want.collect()))
    asked = line.select("series_id", "t").distinct()
    samples = line.groupBy("series_id", "t").agg(F.max("v").alias("value"))
    got = {(r.series_id, r.t): (r.sample_t, r.value) for r in joins.as_of(asked, samples, 40).collect()}
    held = {(r.series_id, r.t): r.value for r in samples.collect()}
    for s, t in got:
        last = max(x for y, x in held if y == s and x <= t)
        assert got[s, t] == (last, held[s, last])


def test_bounds_hold_the_truth_and_states_tell_why_not(spark):
    rng = random.Random(5)
    arrivals = sorted(rng.uniform(0, 6000) for _ in range(900))
    count = lambda t: sum(a <= t for a in arrivals)
    times = [t for t in range(0, 6001, 17) if not 2000 < t < 2300] + [3000]
    samples = sorted({(t, float(count(t) - (count(4300) if t > 4300 else 0))) for t in times})
    table = spark.createDataFrame([("a", t, v) for t, v in samples], "series_id string, t long, value double")
    spans = spark.createDataFrame([(s, t) for s in "az" for t in range(0, 6600, 300)], "series_id string, start long")
    got = {(r.series_id, r.start): r for r in generators.received_between(table, spans, 300, 60).collect()}
    assert len(got) == 44 and all(got["z", t].state == "absent" for t in range(0, 6600, 300))
    for t in range(0, 6600, 300):
        r = got["a", t]
        expected = "reset" if t == 4200 else "gap" if t in (1800, 2100) or t >= 5700 and t + 300 > max(times) else "ok"
        assert r.state == expected, (t, r)
        if r.state == "ok":
            truth = count(t + 300) - count(t)
            assert r.least <= truth <= r.most and abs(r.received - truth) <= r.err + 8 and r.least <= r.received <= r.most
        else:
            assert r.received is None and r.most is None
    steady = spark.createDataFrame([("a", t, float(t * 2)) for t in range(7, 900, 20)], "series_id string, t long, value double")
    r = generators.received_between(steady, spans.where("series_id = 'a' and start = 300"), 300, 60).first()
    assert r.state == "ok" and abs(r.received - 600) < 1e-9 and abs(r.err - 2) < 1e-9
