"""Studies made so that each kind of reason decides once."""

from loadloom.operators import verdicts
from loadloom.operators.verdicts import Comparison

DAYS = "study long, arm string, seed long, valid boolean, cause string, violation double, cost double, surplus double, ok_minutes long, observed_minutes long, eligible long"
SEEDS = range(6)
RULES = (Comparison("c", "o", "violation", margin=5.0), Comparison("c", "o", "cost", benefit=0.1))


def study(no, own=10.0, cost=50.0, surplus=1.0, ok=95, used=3, odd=()):
    rows = {}
    for s in SEEDS:
        rows["c", s] = [no, "c", s, True, None, own + s % 2, cost - s % 3, surplus, ok, 100, used]
        rows["o", s] = [no, "o", s, True, None, 10.0 + s % 3, 100.0, 1.0, 95, 100, 0]
    for (arm, s), cause in dict(odd).items():
        rows[arm, s][3:5] = [False, cause]
    return [tuple(r) for r in rows.values()]


def test_each_kind_of_reason_decides_once(spark):
    days = [*study(1), *study(2, odd={("o", 1): "product"}), *study(3), *study(4, odd={("c", 2): "short", ("o", 0): None}), *study(5, own=60.0), *study(6, surplus=2.0), *study(7, cost=99.0), *study(8, ok=10, used=0), *[r for r in study(9) if r[1:3] != ("o", 3)]]
    table = spark.createDataFrame(days, DAYS)
    ready = spark.createDataFrame([(k, "bound", {3: None}.get(k, True)) for k in range(1, 10)] + [(3, "other", False)], "study long, name string, met boolean")
    found = verdicts.compared(table, RULES, 199, 1, 0.05)
    by = {(r.study, r.name): r for r in found.collect()}
    assert by[1, "violation vs o"].verdict == "pass" == by[1, "cost vs o"].verdict and by[5, "violation vs o"].verdict == "fail"
    assert by[7, "cost vs o"].verdict == "not established" and not by[6, "cost vs o"].surplus_matched and by[4, "violation vs o"].n == 4
    reasons = verdicts.study_reasons(table, ready, found, ["c"], list(SEEDS), 0.9)
    said = {}
    for r in reasons.collect():
        assert r.arm == "c"
        said.setdefault(r.study, set()).add((r["class"], r.reason))
    assert said == {
        2: {("FAIL", "invalid by the product: o/1"), ("INCOMPLETE", "no valid day o/1")},
        3: {("NOT READY", "prerequisite not met: bound"), ("NOT READY", "prerequisite not met: other")},
        4: {("INCOMPLETE", "unusable day c/2: short"), ("INCOMPLETE", "unusable day o/0: unknown"), ("INCOMPLETE", "no valid day c/2"), ("INCOMPLETE", "no valid day o/0")},
        5: {("FAIL-STAT", "violation vs o: beyond the margin")},
        6: {("INCONCLUSIVE", "violation vs o: surplus not matched"), ("INCONCLUSIVE", "no useful benefit")},
        7: {("INCONCLUSIVE", "no useful benefit")},
        8: {("FAIL-STAT", "share of good minutes"), ("INCONCLUSIVE", "never used")},
        9: {("INCOMPLETE", "no valid day o/3")},
    }
    got = {r.study: r.outcome for r in verdicts.study_outcomes(table, reasons, ["c"]).collect()}
    assert got == {1: "PASS", 2: "FAIL", 3: "NOT READY", 4: "INCOMPLETE", 5: "FAIL", 6: "INCONCLUSIVE", 7: "INCONCLUSIVE", 8: "FAIL", 9: "INCOMPLETE"}
