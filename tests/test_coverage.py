"""Hourly evidence, coverage by group and the coverage rules, against plain loops."""

import random

import pytest

from loadloom.operators import coverage

HOUR, DAY = 3600, 86400


def test_rules_at_every_look(spark):
    rng = random.Random(4)
    looks = []
    for s in "ab":
        t = 10 * DAY
        for _ in range(700):
            t += rng.choice([1800, 1800, 3600, 5 * HOUR])
            looks.append((s, t, rng.random() > (0.45 if (t // DAY) % 9 == 3 else 0.12)))
    limits = coverage.Limits(recent=20, rolling=7, consecutive=4, least_day=5, coverage=0.86)
    day = {m: m // 3 + 1 for m in range(40)}
    week = {m: m // 10 + 1 for m in range(400) if m != 77}
    tables = [spark.createDataFrame(list(d.items()), "outcomes long, misses long") for d in (day, week)]
    got = {(r.series_id, r.t): r for r in coverage.coverage_rules(spark.createDataFrame(looks, "series_id string, t long, covered boolean").repartition(7), limits, *tables, 720).collect()}
    assert len(got) == len(looks)
    seen_rules = set()
    for s in "ab":
        own, row, alarms, was = [], 0, 0, {"rolling": False, "consecutive": False}
        for _, t, covered in (x for x in looks if x[0] == s):
            own.append((t, covered))
            row = 0 if covered else row + 1
            recent = [c for _, c in own][-limits.recent :]
            oldest = -(-(t - 7 * DAY) // HOUR)
            inside = [c for u, c in own if u // HOUR >= oldest]
            failed = 0
            for d in range(-(-((oldest + 1) * HOUR) // DAY), (t - 720) // DAY):
                of = [c for u, c in own if u // DAY == d]
                failed += len(of) >= limits.least_day and of.count(False) >= day[len(of)]
            now = {
                "rolling": recent.count(False) >= limits.rolling, "consecutive": row >= limits.consecutive, "day": failed > 0,
                "seven_day": inside.count(True) / len(inside) < limits.coverage and inside.count(False) >= week.get(len(inside), 10**9),
            }
            alarms += sum(now[k] and not was[k] for k in was)
            was = {k: now[k] for k in was}
            r = got[s, t]
            assert (r.missed, r.in_a_row, r.failed_days, r.week_outcomes, r.week_missed, r.alarms) == (recent.count(False), row, failed, len(inside), inside.count(False), alarms)
            assert r.failing == ",".join(k for k in now if now[k])
            seen_rules |= {k for k in now if now[k]}
    assert seen_rules == {"rolling", "consecutive", "day", "seven_day"}


RECORD = "series_id string, origin long, end long, mode string, gate boolean, status string, y double, base double, upper double, errors array<double>"


def test_evidence_of_two_hours(spark):
    rows = [
        ("a", 0, 4000, "prospective", True, "scored", 5.0, 4.0, 6.0, [1.0, 2.0]),
        ("a", 100, 4100, "prospective", False, "scored", 7.0, 4.0, 6.0, None),
        ("a", 200, 4200, "prospective", None, "unscorable", None, 4.0, 6.0, None),
        ("a", 300, 4300, "prospective", True, "scored", 9.0, 4.0, None, [5.0, 5.0]),
        ("a", 400, 9000, "prospective", True, "pending", None, 4.0, 6.0, None),
        ("a", 500, 4500, "replay", True, "scored", 8.0, 4.0, 6.0, [4.0, 4.0]),
        ("a", 600, 4600, "prospective", True, "scored", 8.0, 4.0, 6.0, [4.0, 1.0]),
    ]
    got = {r.hour: r.asDict() for r in coverage.hourly_evidence(spark.createDataFrame(rows, RECORD), 0.1, 2).collect()}
    assert set(got) == {0, 1}
    assert {k: v for k, v in got[0].items() if v} == {"series_id": "a", "issued": 6, "gate_issued": 4, "replay_issued": 1}
    one = got[1]
    assert (one["scored"], one["unscorable"], one["gate_scored"], one["bounded"], one["covered"], one["gate_bounded"], one["gate_covered"]) == (4, 1, 3, 3, 1, 2, 1)
    assert (one["replay_scored"], one["replay_bounded"], one["replay_covered"], one["stepped"]) == (1, 1, 0, 3)
    assert one["pinball"] == pytest.approx(0.1 * 1 + 0.9 * 2) and (one["abs_error"], one["bias"]) == (13.0, -13.0)
    assert (one["step_0"], one["step_1"]) == (10.0, 8.0)
    assert coverage.hourly_evidence(spark.createDataFrame([], RECORD), 0.1, 2).count() == 0


def test_groups_of_a_window(spark):
    from pyspark.sql import functions as F

    rows = [("a", 0.0, 2.0, 1.0, 1.0, 1.0), ("a", 2.0, 3.0, 4.0, 1.0, 5.0), ("a", 9.0, None, 4.0, 9.0, 9.0), ("a", 3.0, 9.0, 4.0, None, None), ("a", 4.0, 5.0, None, 1.0, 1.0)]
    windows = spark.createDataFrame(rows, "k string, base double, upper double, y double, least double, most double")
    got = {r.group: r for r in coverage.coverage_by_group(windows, F.lit(2.0), F.lit(5.0), 1.0, 0.1, "k").collect()}
    assert {g: (r.windows, r.unbounded) for g, r in got.items()} == {"all": (3, 1), "low": (2, 0), "mid": (1, 0), "high": (0, 1), "ramp": (1, 0), "plateau": (1, 1), "near_zero": (1, 0), "zero_forecast": (1, 0)}
    assert got["all"].coverage == pytest.approx(2 / 3) and got["low"].width == 1.5 and got["ramp"].width_over_level == pytest.approx(0.2)
    assert got["high"].coverage is None and got["mid"].width_over_level is None and got["ramp"].pinball == pytest.approx(0.9)
