"""Scores beside baselines, and what records of components are worth."""

import pytest
from pyspark.sql import functions as F

from loadloom.operators import scoring

DAY = 86400
ISSUED = "series_id string, issued long, artifact string, steps array<struct<step int, target long, value double>>"
SEEN = [("a", 0, 5.0), ("a", DAY, 8.0), ("a", DAY + 60, 10.0), ("a", DAY + 120, 0.0), ("a", 60, 9.0)]


def table(spark, rows):
    return spark.createDataFrame(rows, ISSUED), spark.createDataFrame(SEEN, "series_id string, t long, value double")


def test_states_and_baselines(spark):
    issued, seen = table(spark, [("a", DAY, None, [(1, DAY + 60, 12.0), (2, DAY + 120, 3.0), (3, DAY + 180, 4.0), (4, DAY + 240, 4.0)])])
    rows = {r.step: r for r in scoring.scored_steps(issued, seen, DAY + 200).collect()}
    assert [rows[k].state for k in (1, 2, 3, 4)] == ["scored", "scored", "gap", "outstanding"]
    one, two = rows[1], rows[2]
    assert (one.artifact, one.forecast_ae, one.persistence_ae, one.prevday_ae, one.forecast_ape) == ("unknown", 2.0, 2.0, 1.0, 0.2)
    assert (two.forecast_ae, two.forecast_ape, two.persistence_ape, two.prevday_ae) == (3.0, None, None, None) and rows[4].actual is None
    s = scoring.score_summary(scoring.scored_steps(issued, seen, DAY + 200), "series_id").collect()[0]
    assert (s.steps_issued, s.steps_scored, s.gaps, s.outstanding, s.matured, s.zero_observations) == (4, 2, 1, 1, False, 1)
    assert (s.step_coverage, s.under_share, s.forecast_mae, s.forecast_mape) == (pytest.approx(2 / 3), 0.0, 2.5, pytest.approx(20))
    c = scoring.issuance_coverage(issued, DAY, DAY + 3 * 300 + 10, 300).collect()[0]
    assert (c.accepted, c.expected, c.coverage) == (1, 3, pytest.approx(1 / 3))


def test_no_baseline_from_the_future(spark):
    rows = [("a", 0, "x", [(1, DAY + 60, 12.0)])]
    issued, seen = table(spark, rows)
    with pytest.raises(Exception, match="after its issuance at 0"):
        scoring.scored_steps(issued, seen, 2 * DAY).collect()
    assert [r.state for r in scoring.scored_steps(issued, seen, DAY).collect()] == ["outstanding"]  # nothing is looked up yet
    empty = scoring.score_summary(scoring.scored_steps(*table(spark, []), 0), "series_id")
    assert empty.count() == 0


RECORD = "schema string, status string, reason string, targets array<long>, pattern array<double>, network array<double>, blended array<double>, final array<double>, pattern_there array<boolean>, network_there array<boolean>, weights array<double>"


def record(**change):
    base = {"schema": "component-v1", "status": "ok", "reason": None, "targets": [1, 2, 3, 4, 5, 6], "pattern": [2.0] * 6, "network": [4.0] * 6, "blended": [3.0] * 6, "final": [3.004] * 6, "pattern_there": [True] * 6, "network_there": [True] * 6, "weights": [0.5] * 6} | change
    return tuple(base[c.split()[0]] for c in RECORD.split(", "))


def at(k, own, value):
    return [value if i == k else x for i, x in enumerate(own)]


def test_states_of_components(spark):
    nan = float("nan")
    cases = {
        None: record(), "absent": None, "schema": record(schema="v0"), "misaligned": record(targets=[1, 2, 3, 4, 5, 7]), "length": record(pattern=[2.0] * 5),
        "final_mismatch": record(final=at(3, [3.004] * 6, 3.2)), "invalid": record(weights=at(0, [0.5] * 6, 1.5)),
    }
    more = [
        ("invalid", record(status="odd")), ("misaligned", record(status="misaligned")), ("invalid", record(status=None)), ("invalid", record(reason="x")), ("length", record(weights=None)),
        ("invalid", record(pattern=at(2, [2.0] * 6, None))), (None, record(pattern=at(2, [2.0] * 6, None), pattern_there=at(2, [True] * 6, False))), ("invalid", record(network=at(1, [4.0] * 6, nan), network_there=at(1, [True] * 6, False))),
        ("misaligned", record(targets=at(0, [1, 2, 3, 4, 5, 6], 9), weights=at(1, [0.5] * 6, 2.0))), ("invalid", record(weights=at(1, [0.5] * 6, 2.0), final=at(4, [3.004] * 6, 9.0))),
    ]
    rows = [(k, r) for k, r in cases.items()] + more
    df = spark.createDataFrame([(i, r) for i, (_, r) in enumerate(rows)], f"i int, c struct<{', '.join(c.replace(' ', ':', 1) for c in RECORD.split(', '))}>")
    steps = F.array(*[F.struct(F.lit(k).alias("step"), F.lit(k).cast("long").alias("target"), F.lit(3.0).alias("value")) for k in range(1, 7)])
    got = df.select("i", scoring.component_state(F.col("c"), steps).alias("state")).orderBy("i").collect()
    assert [r.state for r in got] == [k for k, _ in rows]
    five = df.where("i = 0").select(scoring.component_state(F.col("c"), F.slice(steps, 1, 5)).alias("state")).collect()
    assert five[0].state == "length"


def test_blend_identity(spark):
    rows = [(record(),), (record(blended=at(1, [3.0] * 6, 3.0 + 1e-8)),), (record(blended=at(4, at(1, [3.0] * 6, 9.0), None)),)]
    df = spark.createDataFrame(rows, f"c struct<{', '.join(c.replace(' ', ':', 1) for c in RECORD.split(', '))}>")
    assert [r[0] for r in df.select(scoring.identity_mismatches(F.col("c"))).collect()] == [[], [1], [1]]
