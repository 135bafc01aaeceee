"""Queries over all events, orders and origins, against plain loops on small tables."""

from collections import defaultdict

import pytest

import __spark_entry__  # noqa: F401  (registers the queries)
from loadloom.plans import registry
from loadloom.plans.registry import DAY, HOUR, QUERIES
from loadloom.session import read_table


@pytest.fixture(scope="module")
def log(spark, sf):
    return registry.events(spark, sf).collect()


def test_nearest_for_every_event(spark, sf, log):
    got = {r.ord: (r.want, r.found, r.found_value) for r in QUERIES["j02_nearest"](spark, sf).collect()}
    expected = {}
    for q in log:
        want = q.t - DAY
        near = min(((abs(e.t - want), e.t, e.value) for e in log if e.series_id == q.series_id and abs(e.t - want) <= 300), default=None)
        if near:
            expected[q.ord] = (want, near[1], pytest.approx(near[2], abs=1e-6))
    assert got == expected and any(k % 7 for k in got)


def test_overlaps_of_all_events(spark, sf, log):
    got = QUERIES["j06_overlaps"](spark, sf).collect()
    told = sorted((r.series_id, r.l, r.r) for r in got)
    expected = sorted((x.series_id, x.ord, y.ord) for x in log for y in log if x.series_id == y.series_id and x.t <= y.t + y.ord % 4 * 600 and x.t + 240 >= y.t)
    assert told == expected and {r.l for r in got} == {e.ord for e in log}


def test_overlaps_are_dealt_to_all_tasks(spark):
    """Few rows make many pairs: neither side is broadcast and no tasks are merged, however small the tables look; odd intervals as in SQL."""
    from loadloom.operators import joins

    spans = [(0, 240), (-700, -650), (599, 600), (600, 600), (1_250, 1_190), (650, 20), (-1, 2_000), (None, 5), (5, None), (0, 240)]
    left = [(s, k, a, b) for s in ("a", "b", None) for k, (a, b) in enumerate(spans)]
    right = [(s, k, c, d) for s in ("b", "a", None) for k, (c, d) in enumerate(spans)]
    found = joins.overlaps(spark.createDataFrame(left, "series_id string, l long, a long, b long"), spark.createDataFrame(right, "series_id string, r long, c long, d long"), 600)
    expected = [(*x, *y[1:]) for x in left for y in right if x[0] and x[0] == y[0] and None not in x + y and x[2] <= y[3] and x[3] >= y[2]]
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    assert found.columns == ["series_id", "l", "a", "b", "r", "c", "d"]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_overlaps_are_written_in_few_bytes(spark, tmp_path):
    """Dense intervals in any order: the pairs are whole, and their files take a fraction of a byte for each."""
    from random import Random

    from loadloom.operators import joins

    times = Random(6)
    left = [("a", k, t, t + 240) for k, t in enumerate(times.randrange(600) for _ in range(701))]
    right = [("a", k, t, t + k % 4 * 600) for k, t in enumerate(times.randrange(600) for _ in range(701))]
    found = joins.overlaps(spark.createDataFrame(left, "series_id string, l long, a long, b long"), spark.createDataFrame(right, "series_id string, r long, c long, d long"), 600)
    found.write.parquet(str(tmp_path / "pairs"))
    written = [(x.l, x.r) for x in spark.read.parquet(str(tmp_path / "pairs")).collect()]
    assert sorted(written) == sorted((x[1], y[1]) for x in left for y in right if x[2] <= y[3] and x[3] >= y[2])
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.6 * len(written)


def test_overlaps_deal_few_copies(spark, sf, log):
    """What is dealt takes disk: each event comes once on either side, and few of them into a second bucket."""
    found = QUERIES["j06_overlaps"](spark, sf)
    found.collect()
    dealt, nodes = 0, [found._jdf.queryExecution().executedPlan().executedPlan()]
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(k) for k in range(node.children().size())]
        nodes += [node.plan()] if node.nodeName().endswith("QueryStage") else []
        dealt += node.metrics().apply("shuffleRecordsWritten").value() if node.nodeName() == "Exchange" else 0
    assert 2 * len(log) <= dealt < 2.5 * len(log)


def test_queue_status_of_every_event(spark, sf, log):
    got = {r.key: r.status for r in QUERIES["k02_queue_status"](spark, sf).collect()}
    for q in log:
        seen = min((e.t for e in log if e.series_id == q.series_id and e.t >= q.t + HOUR), default=None)
        assert got[q.ord] == ("early" if seen is None else "matched" if seen - q.t - HOUR <= 300 else "dropped")
    assert len(got) == len(log)


def test_mask_of_every_event(spark, sf, log):
    from loadloom.plans.grids import MASK

    got = {r.ord: r.explained for r in QUERIES["j13_explained_by_mask"](spark, sf).collect()}
    assert got == {e.ord: next((r for a, b, r in MASK if a - 30 <= e.t <= b + 30), None) for e in log}


def test_final_attempts_of_all_orders(spark, sf):
    lines, days = defaultdict(list), defaultdict(list)
    for x in read_table(spark, sf, "lineitem").collect():
        lines[x.l_orderkey].append((x.l_linenumber, x.l_linestatus == "F"))
    for o in read_table(spark, sf, "orders").collect():
        own = lines[o.o_orderkey]
        whole = len(own) == 4 and len({n for n, _ in own}) == 4 and all(f for _, f in own)
        days[o.o_orderdate] += [o.o_orderkey] if whole else []
    got = {r.hour: (r.status, r.attempt) for r in QUERIES["v17_final_attempts"](spark, sf).collect()}
    assert got == {d: ("final", k[0]) if len(k) == 1 else ("conflict" if k else "unfinalized", None) for d, k in days.items()}
    assert any(k for k in days.values())


def test_weighted_pattern_from_every_origin(spark, sf):
    values = {(r.series_id, r.t): r.value for r in registry.grid(spark, sf).collect()}
    expected = {}
    for s, origin in values:
        for step in range(1, 7):
            sent = sorted((values.get((s, origin + step * HOUR - d * DAY)), -d, 0.3 ** (d - 1)) for d in range(1, 8) if values.get((s, origin + step * HOUR - d * DAY)) is not None)
            total, below, at = sum(w for _, _, w in sent), 0.0, []
            for v, _, w in sent:
                at.append(((below + w / 2) / total, v))
                below += w
            if at:
                lo, hi = max((x for x in at if x[0] <= 0.7), default=None), min((x for x in at if x[0] >= 0.7), default=None)
                v = hi[1] if lo is None else lo[1] if hi is None or hi[0] == lo[0] else lo[1] + (hi[1] - lo[1]) * (0.7 - lo[0]) / (hi[0] - lo[0])
                expected[s, origin, step] = pytest.approx(v, abs=1e-3)
    got = {(r.series_id, r.origin, r.step): r.value for r in QUERIES["f04_weighted_pattern"](spark, sf).collect()}
    assert got == expected and any(k[1] % (12 * HOUR) for k in got)


def test_nearest_forms_no_pairs(spark):
    """Many points around each want: rows are carried, so none is joined to all; of equal times the least value that is there."""
    from loadloom.operators import joins

    rows = [("a", t, float(v) if v else None) for t in range(1_000, 1_040, 2) for v in (0, 2, 1)] + [("b", 5_000, 7.0), (None, 1_000, 1.0)]
    history = spark.createDataFrame(rows, "series_id string, t long, value double")
    wants = [("a", 1, 999), ("a", 2, 1_011), ("a", 3, 1_338), ("a", 4, 1_339), ("b", 5, 4_700), ("b", 6, 4_699), (None, 7, 1_000), ("a", 8, None), ("a", 2, 1_011)]
    targets = spark.createDataFrame(wants, "series_id string, ord long, want long")
    found = joins.nearest(targets, history, 300)
    assert sorted(tuple(r) for r in found.collect()) == [("a", 1, 999, 1_000, 1.0), ("a", 2, 1_011, 1_010, 1.0), ("a", 3, 1_338, 1_038, 1.0), ("b", 5, 4_700, 5_000, 7.0)]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_counted_before_they_meet_their_hours(spark):
    from loadloom.operators import outcomes as ops

    attempts = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (2, 13), (3, 14), (3, 14), (4, None), (None, 15)], "hour long, attempt long")
    arms = {10: (1, 2), 11: (1, 1), 12: (1, 2), 13: (1, 2), 14: (1, 2), 15: (1, 2), None: (1, 2)}
    for far in (1, 10**6):  # arms as bits of one number, and too far apart for that
        lines = spark.createDataFrame([(k, far * a, 1) for k, own in arms.items() for a in own], "attempt long, arm long, final int")
        found = ops.final_attempts(attempts, lines, 2)
        assert {r.hour: (r.status, r.attempt) for r in found.collect()} == {1: ("final", 10), 2: ("conflict", None), 3: ("unfinalized", None), 4: ("unfinalized", None), None: ("final", 15)}
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.rindex("Aggregate [attempt") > plan.index("Join ")  # below the join
