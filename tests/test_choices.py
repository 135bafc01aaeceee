"""Choices with memory, the evidence behind them and the theta forecaster, against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadloom.operators import choices, evaluation
from loadloom.operators.theta import theta

ARMS = ["base", "one", "two"]


def hashed(n, draw, place, seed):
    m = 1 << 32
    x = (draw * 668265263 + place * 374761393 + seed * 974711) % m
    x = (x ^ (x >> 15)) * 40503 % m
    x = (x ^ (x >> 13)) * 60493 % m
    return (x ^ (x >> 16)) % n


def chosen(parts, draws, block, seed, pool, least, hold, quantile):
    """``parts``: (number, rows of errors) in order; the rule row by row."""
    out, previous = [], None
    for at in range(len(parts)):
        own = parts[max(0, at - pool + 1) : at + 1]
        usable = [a for k, a in enumerate(ARMS) if all(r[k] is not None for _, rows in own for r in rows)]

        def mae(arm, places=None, own=own):
            got = [rows[i][ARMS.index(arm)] for (no, rows) in own for i in (places[no] if places else range(len(rows)))]
            return sum(got)

        def resample(d, own=own):
            places = {}
            for no, rows in own:
                n = len(rows)
                size = min(block, n)
                firsts = [hashed(n - size + 1, d, no * 1009 + b, seed) for b in range(-(-n // size))]
                places[no] = [f + k for f in firsts for k in range(size)][:n]
            return places

        def beats(ref, arm):
            gains = sorted((mae(ref, p) - mae(arm, p)) / mae(ref, p) for p in map(resample, range(draws)))
            g = (mae(ref) - mae(arm)) / mae(ref)
            return g, g >= least and gains[int(quantile * draws)] > 0

        network = [a for a in usable if a != "base"]
        incumbent = previous if previous in network and beats("base", previous)[0] >= hold else None
        ref = incumbent or "base"
        told = {a: beats(ref, a) for a in network if a != incumbent}
        won = [a for a in told if told[a][1]]
        now = max(won, key=lambda a: (told[a][0], -ARMS.index(a))) if won else ref
        path = ("challenged" if incumbent else "won") if won else "held" if incumbent else "fell" if previous in network else "none"
        out.append((parts[at][0], len(own), sum(len(r) for _, r in own), previous, incumbent, now, path))
        previous = now
    return out


def test_choice_with_an_incumbent(spark):
    rng = random.Random(5)
    scales = {"a": [(1, 1, 1), (1, 0.7, 0.9), (1, 0.95, 1.1), (1, 0.9, 0.3), (1, 1.2, 1.5), (1, 1.2, 2)], "b": [(1, 0.5, 0.5), (1, None, 0.9), (1, 0.9, 0.99), (1, 3, 0.98)], "c": [(1, 0.8, 1)]}
    made = {s: [(i * 2, [tuple(None if x is None else round(x * rng.uniform(0.8, 1.2), 6) for x in scale) for _ in range(3 + 9 * i)]) for i, scale in enumerate(v)] for s, v in scales.items()}
    rows = [(s, no, t, *r) for s, parts in made.items() for no, rows in parts for t, r in enumerate(rows)]
    rows += [("a", 0, 99, None, 0.1, 0.1), ("d", 1, 1, None, 1.0, 1.0)]  # without the baseline: left out
    table = spark.createDataFrame(rows, "series_id string, part long, t long, base double, one double, two double").repartition(5)
    for pool in (1, 3):
        got = choices.incumbent_choice(table, "base", ARMS[1:], 50, 4, 3, pool, 0.05, 0.0).orderBy("series_id", "part").collect()
        expected = [(s, *r) for s, parts in made.items() for r in chosen(parts, 50, 4, 3, pool, 0.05, 0.0, 0.1)]
        assert [tuple(r) for r in got] == expected
        paths = {r.path for r in got}
        assert paths >= ({"won", "held", "none", "challenged"} if pool == 3 else {"won", "challenged", "fell"})
    assert choices.incumbent_choice(table.limit(0), "base", ARMS[1:], 10, 4, 3).count() == 0


def test_a_new_recipe_waits_again(spark):
    rng = random.Random(2)
    looks = [(s, t, rng.random() < 0.95, *(x for _ in range(2) for x in (rng.random() < 0.9, rng.random() < 0.9, rng.random() < 0.8, f"r{(t // rng.choice((7, 40))) % 2}"))) for s in "ab" for t in range(300)]
    names = [f"{m}_{k}" for m in ("lstm", "statistical") for k in ("trusted", "enters", "stays", "recipe")]
    table = spark.createDataFrame(looks, ["series_id", "t", "naive_trusted", *names])
    got = {(r.series_id, r.t): (r.used, r.switches) for r in evaluation.fallback(table, 4).collect()}
    for s in "ab":
        used, kept, since, switches = None, None, {}, 0
        for _, t, naive, *rest in (r for r in looks if r[0] == s):
            told = {"lstm": rest[:4], "statistical": rest[4:]}
            for m, (_, enters, _, recipe) in told.items():
                if naive and enters:
                    since.setdefault((m, recipe), t)
                else:
                    since.pop((m, recipe), None)
            now = used
            if now is not None and not (naive if now == "naive" else told[now][0] and told[now][3] == kept and naive and told[now][2]):
                now = None
            target = next((m for m, (trusted, _, _, r) in told.items() if trusted and (m == now or t - since.get((m, r), t + 9) >= 4)), "naive" if naive else None)
            if target != used:
                used, kept, switches = target, told[target][3] if target in told else None, switches + 1
            assert got[s, t] == (used, switches)
    plain = table.drop("lstm_recipe", "statistical_recipe")
    assert {(r.series_id, r.t): r.used for r in evaluation.fallback(plain, 4).collect()} != {k: v[0] for k, v in got.items()}


def test_theta_against_a_loop(spark):
    rng = np.random.default_rng(3)
    values = {"a": 50 + 20 * np.sin(np.arange(60)) + rng.uniform(0, 9, 60), "zero": np.zeros(60), "short": np.ones(11), "gap": np.where(np.arange(60) == 30, np.nan, 4.0)}
    rows = [(s, i * 10, None if math.isnan(v) else float(v)) for s, v in values.items() for i, v in enumerate(v)]
    alphas = [0.1, 0.5, 0.9]
    table = theta(spark.createDataFrame(rows, "series_id string, t long, value double"), 60, 3, 10, 240, 40, alphas)
    assert table._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # that of the origins
    got = {(r.series_id, r.origin, r.step): r for r in table.collect()}
    for s, y in values.items():
        for at in range(0, len(y), 4):
            z = y[max(0, at - 23) : at + 1]
            at_slots = (np.arange(at - len(z) + 1, at + 1)) % 6
            for h in range(3):
                r = got.pop((s, at * 10, h + 1))
                assert r.target == (at + h + 1) * 10
                if len(z) < 12 or not np.all(np.isfinite(z)) or z.mean() <= 0:
                    assert r.predicted is None and r.alpha is None
                    continue
                index = np.array([max(1e-6, z[at_slots == k].mean() / z.mean()) for k in range(6)])
                d = z / index[at_slots]
                fits = []
                for a in alphas:
                    level, sse = d[0], 0.0
                    for v in d[1:]:
                        sse, level = sse + (v - level) ** 2, a * v + (1 - a) * level
                    fits.append((round(sse, 6), a, level))
                _, a, level = min(fits)
                slope = np.polyfit(np.arange(len(d)), d, 1)[0]
                assert r.alpha == a and r.predicted == pytest.approx(max(0, (level + 0.5 * slope * (h + 1 / a - (1 - a) ** len(d) / a)) * index[(at + h + 1) % 6]), abs=1e-6)
    assert not got


def test_paired_evidence_and_bands(spark):
    rng = random.Random(1)
    rows = [(s, t, rng.choice([None, rng.uniform(0, 2)]) if rng.random() < 0.1 else rng.uniform(0.5, 1), rng.uniform(0.5, 1.1)) for s in "ab" for t in sorted({rng.randrange(0, 90000, 900) for _ in range(90)})]
    seconds = 7 * 3600
    losses = spark.createDataFrame(rows, "series_id string, t long, challenger double, baseline double")
    evidence = choices.paired_evidence(losses, seconds)
    got = {(r.series_id, r.t): r for r in evidence.collect()}
    pairs = [r for r in rows if r[2] is not None]
    assert len(got) == len(pairs)
    for s, t, *_ in pairs:
        seen = [r for r in pairs if r[0] == s and r[1] <= t and r[1] // 3600 >= -(-(t - seconds) // 3600)]
        r = got[s, t]
        assert (r.pairs, r.span) == (len(seen), t - min(x[1] for x in seen))
        assert (r.challenger, r.baseline) == (pytest.approx(sum(x[2] for x in seen)), pytest.approx(sum(x[3] for x in seen)))
    costs = losses.select("series_id", "t", F.lit(1.0).alias("a_challenger"), F.lit(1.0).alias("a_baseline"), F.when(F.col("t") % 1800 == 0, 2.0).alias("b_challenger"), F.lit(2.0).alias("b_baseline"))
    told = choices.challenger_bands(evidence, costs, 5, 4000).collect()
    for r in told:
        own = got[r.series_id, r.t]
        basis = own.pairs >= 5 and own.span >= 4000 and r.t % 1800 == 0
        assert (r.enters, r.stays) == (basis and own.challenger <= 0.95 * own.baseline, basis and own.challenger <= own.baseline)
    assert {(r.enters, r.stays) for r in told} == {(True, True), (False, True), (False, False)}
