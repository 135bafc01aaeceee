"""Forecasters: rows are (series_id, origin, step, target, predicted); an unavailable forecast is NULL, never 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loadloom.operators.folds import fold_rows
from loadloom.operators.grid import by_series


def ahead(grid: DataFrame, steps: int, step: int) -> DataFrame:
    """Every origin of a whole grid with its targets."""
    return grid.select("series_id", F.col("t").alias("origin"), F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step")).withColumn("target", F.col("origin") + F.col("step") * step)


def persistence(grid: DataFrame, steps: int, step: int) -> DataFrame:
    """The last observed value at or before the origin."""
    held = grid.withColumn("predicted", F.last("value", ignorenulls=True).over(by_series().rowsBetween(Window.unboundedPreceding, 0)))
    return ahead(grid, steps, step).join(held.select("series_id", F.col("t").alias("origin"), "predicted"), ["series_id", "origin"])


def seasonal_naive(grid: DataFrame, season: int, steps: int, step: int) -> DataFrame:
    """The value a season before each target; a forecast has all its steps or none."""
    before = grid.select("series_id", (F.col("t") + season).alias("target"), F.col("value").alias("predicted"))
    found = ahead(grid, steps, step).join(before, ["series_id", "target"], "left")
    whole = F.count("predicted").over(Window.partitionBy("series_id", "origin")) == steps
    return found.withColumn("predicted", F.when(whole, F.col("predicted")))


def profile(grid: DataFrame, season: int, seasons: int, least: int) -> DataFrame:
    """(series_id, t, profile, support): mean of the values 1 to ``seasons`` seasons before, with at least ``least`` of them.

    Each value is sent to the slots that will use it and averaged there, so one hot series is spread over its slots.
    """
    sent = grid.where("value is not null").select("series_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(seasons)), lambda d: F.col("t") + d * season)).alias("t"), "value")
    found = sent.groupBy("series_id", "t").agg(F.avg("value").alias("profile"), F.count("*").alias("support"))
    return found.where(F.col("support") >= least)


def profile_forecast(grid: DataFrame, season: int, seasons: int, least: int, steps: int, step: int) -> DataFrame:
    return ahead(grid, steps, step).join(profile(grid, season, seasons, least).select("series_id", F.col("t").alias("target"), F.col("profile").alias("predicted"), "support"), ["series_id", "target"], "left")


def trend_adaptive(grid: DataFrame, season: int, steps: int, step: int, n: int = 6, damping: float = 0.9) -> DataFrame:
    """Yesterday's value times the recent level ratio, which fades with the step."""
    slots, w = season // step, by_series()
    now, then = w.rowsBetween(-(n - 1), 0), w.rowsBetween(-(slots + n - 1), -slots)
    # sums of whole counts are exact, so the ratio is the quotient of two exact numbers, however the rows were added up
    top, bottom = F.sum("value").over(now) * F.count("value").over(then), F.sum("value").over(then) * F.count("value").over(now)
    ratios = grid.select("series_id", F.col("t").alias("origin"), F.when(F.sum("value").over(then) > 0, F.least(F.greatest(top / bottom, F.lit(0.5)), F.lit(2.0))).alias("ratio"))
    before = grid.select("series_id", (F.col("t") + season).alias("target"), F.col("value").alias("lagged"))
    both = ahead(grid, steps, step).join(ratios, ["series_id", "origin"]).join(before, ["series_id", "target"], "left")
    fades = F.array(*[F.lit(round(damping**k, 12)) for k in range(1, steps + 1)])  # constants: powers differ in their last place between machines
    return both.select("series_id", "origin", "step", "target", (F.col("lagged") * (1 + (F.col("ratio") - 1) * F.element_at(fades, F.col("step")))).alias("predicted"))


def member_median(members: DataFrame) -> DataFrame:
    """Median and mean over the finite ones of several forecasters' rows; fewer than two give NULL."""
    out = members.groupBy("series_id", "origin", "step").agg(F.count("predicted").alias("members"), F.median("predicted").alias("median"), F.avg("predicted").alias("mean"))
    return out.select("series_id", "origin", "step", "members", *[F.when(F.col("members") >= 2, F.col(c)).alias(c) for c in ("median", "mean")])


def blend(pattern: DataFrame, other: DataFrame) -> DataFrame:
    """Step-weighted blend; a side with no value leaves the other."""
    both = pattern.select("series_id", "origin", "step", F.col("predicted").alias("p")).join(other.select("series_id", "origin", "step", F.col("predicted").alias("o")), ["series_id", "origin", "step"])
    weight = F.least(F.lit(0.95), 0.7 + F.col("step") / 6 * 0.25)
    return both.select("series_id", "origin", "step", F.coalesce(weight * F.col("p") + (1 - weight) * F.col("o"), "p", "o").alias("predicted"))


def ar_sums(residuals: DataFrame, lags: int, seconds: int) -> DataFrame:
    """Trailing sums of products for a regression of ``r`` on its ``lags`` lags with intercept, over the last ``seconds``."""
    w = by_series()
    x = residuals.withColumns({f"x{k}": F.lag("r", k).over(w) for k in range(1, lags + 1)}).withColumn("x0", F.lit(1.0))
    whole = F.col("r").isNotNull()
    for k in range(1, lags + 1):
        whole = whole & F.col(f"x{k}").isNotNull()
    trail = by_series().rangeBetween(-seconds, 0)
    total = lambda c: F.coalesce(F.sum(F.when(whole, c)).over(trail), F.lit(0.0))
    sums: dict[str, Column] = {"n": F.coalesce(F.sum(F.when(whole, 1)).over(trail), F.lit(0))}
    for i in range(lags + 1):
        sums[f"b{i}"] = total(F.col(f"x{i}") * F.col("r"))
        for j in range(i, lags + 1):
            sums[f"a{i}{j}"] = total(F.col(f"x{i}") * F.col(f"x{j}"))
    return x.withColumns(sums)


def ar_fit(residuals: DataFrame, seconds: int, least: int) -> DataFrame:
    """First-order fit r = c + phi * r[-1] from trailing sums; NULL with under ``least`` rows, a flat series or a root of 0.999 or more."""
    s = ar_sums(residuals, 1, seconds)
    det = F.col("a00") * F.col("a11") - F.col("a01") * F.col("a01")
    phi = (F.col("a00") * F.col("b1") - F.col("a01") * F.col("b0")) / det
    c = (F.col("b0") - phi * F.col("a01")) / F.col("a00")
    good = (F.col("n") >= least) & (F.abs(det) > 1e-9)
    fitted = s.withColumn("phi", F.when(good, phi)).withColumn("c", F.when(good & (F.abs(F.col("phi")) < 0.999), c))
    return fitted.select("series_id", "t", "r", "n", F.when(F.col("c").isNotNull(), F.col("phi")).alias("phi"), "c")


def solved(s: DataFrame, lags: int, good: Column) -> DataFrame:
    """Adds c0 .. c``lags``, the solution of the normal equations of ``ar_sums``; NULL where ``good`` is not so or a pivot vanishes.

    Gaussian elimination, unrolled; the matrix is symmetric and a sum of squares, so its pivots need no exchange.
    """
    k = lags + 1
    a = lambda i, j: f"a{min(i, j)}{max(i, j)}"
    m = s.withColumns({f"m0_{i}{j}": F.col(a(i, j)) if j < k else F.col(f"b{i}") for i in range(k) for j in range(k + 1)})
    for p in range(k - 1):
        step = {}
        for i in range(p + 1, k):
            for j in range(p + 1, k + 1):
                step[f"m{p + 1}_{i}{j}"] = F.col(f"m{p}_{i}{j}") - F.try_divide(f"m{p}_{i}{p}", f"m{p}_{p}{p}") * F.col(f"m{p}_{p}{j}")
        m = m.withColumns(step)
    for i in reversed(range(k)):
        rest = F.col(f"m{i}_{i}{k}")
        for j in range(i + 1, k):
            rest = rest - F.col(f"m{i}_{i}{j}") * F.col(f"c{j}")
        m = m.withColumn(f"c{i}", F.when(good & (F.col(f"m{i}_{i}{i}") > 1e-9), rest / F.col(f"m{i}_{i}{i}")))
    return m.select(*s.columns, *[f"c{i}" for i in range(k)])


def stable(radius: float = 0.999) -> Column:
    """Whether all roots of z^3 - c1 z^2 - c2 z - c3 lie within ``radius`` (the conditions of Jury, with z scaled)."""
    a1, a2, a3 = (-F.col(f"c{i}") / radius**i for i in (1, 2, 3))
    return (F.abs(a3) < 1) & (1 + a1 + a2 + a3 > 0) & (1 - a1 + a2 - a3 > 0) & (F.abs(a2 - a1 * a3) < 1 - a3 * a3)


def profile_ar(grid: DataFrame, season: int, steps: int, step: int, seconds: int, rows: int, span: int, relative: bool = False, clip: float = 0.5) -> DataFrame:
    """The seven-season profile of each target plus an AR(3) forecast of what is left over it, never below 0.

    Residuals are y - profile, or with ``relative`` y / profile - 1 (clipped to ``clip`` in the fit alone, not in the lags that the
    recursion starts from). At each origin the fit takes the last ``seconds`` and needs ``rows`` whole rows spanning ``span``; a
    fit with a root of 0.999 or more and origins without all three lags give NULL. A target without a profile is NULL.
    """
    both = grid.join(profile(grid, season, 7, 1).select("series_id", "t", "profile"), ["series_id", "t"], "left")
    usable = F.when(F.col("profile") > 0, F.col("profile")) if relative else F.col("profile")
    raw = (F.col("value") / usable - 1) if relative else F.col("value") - usable
    clipped = F.when(raw.isNotNull(), F.least(F.greatest(raw, F.lit(-clip)), F.lit(clip)))  # greatest alone would pass over NULL
    left = both.select("series_id", "t", raw.alias("raw"), (clipped if relative else raw).alias("r"))
    whole = F.col("r").isNotNull() & F.col("x1").isNotNull() & F.col("x2").isNotNull() & F.col("x3").isNotNull()
    # the first row of the trailing days has its lags within them, so rows start three steps later
    s = ar_sums(left, 3, seconds - 4 * step)
    trail = by_series().rangeBetween(-(seconds - 4 * step), 0)
    at = F.when(whole, F.col("t"))
    good = (F.col("n") >= rows) & (F.max(at).over(trail) - F.min(at).over(trail) >= span)
    s = s.withColumn("good", good)
    fitted = solved(s, 3, F.col("good"))
    if not relative:
        fitted = fitted.withColumn("c0", F.when(stable(), F.col("c0")))
    lags = fitted.select("series_id", F.col("t").alias("origin"), "c0", "c1", "c2", "c3", F.col("raw").alias("h1"), F.lag("raw", 1).over(by_series()).alias("h2"), F.lag("raw", 2).over(by_series()).alias("h3"))
    made = [F.col("h3"), F.col("h2"), F.col("h1")]
    for k in range(steps):
        lags = lags.withColumn(f"f{k + 1}", F.col("c0") + F.col("c1") * made[-1] + F.col("c2") * made[-2] + F.col("c3") * made[-3])
        made.append(F.col(f"f{k + 1}"))
    ahead_ = lags.select("series_id", "origin", F.posexplode(F.array(*[f"f{k + 1}" for k in range(steps)])).alias("k", "left"))
    ahead_ = ahead_.select("series_id", "origin", (F.col("k") + 1).alias("step"), (F.col("origin") + (F.col("k") + 1) * step).alias("target"), "left")
    to = profile(grid, season, 7, 1).select("series_id", F.col("t").alias("target"), "profile")
    out = ahead_.join(to, ["series_id", "target"], "left")
    raw = F.col("profile") * (1 + F.col("left")) if relative else F.col("profile") + F.col("left")
    return out.select("series_id", "origin", "step", "target", F.when(raw.isNotNull(), F.greatest(raw, F.lit(0.0))).alias("predicted"))


def smoothing_grid(grid: DataFrame, alphas: list[float]) -> DataFrame:
    """Simple exponential smoothing of every series under every alpha, and the alpha with the least squared error.

    Each series is folded in order of time with all alphas at once; the series run side by side.
    """
    ordered = grid.where("value is not null").groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "value"))), lambda x: x["value"]).alias("v"))
    runs = ordered.select("series_id", "v", F.explode(F.array(*[F.lit(a) for a in alphas])).alias("alpha"))
    folded = F.aggregate(
        F.slice("v", F.lit(2), F.size("v")),
        F.struct(F.element_at("v", 1).alias("level"), F.lit(0.0).alias("sse")),
        lambda acc, x: F.struct((acc["level"] + F.col("alpha") * (x - acc["level"])).alias("level"), (acc["sse"] + (x - acc["level"]) * (x - acc["level"])).alias("sse")),
    )
    done = runs.where(F.size("v") > 0).select("series_id", "alpha", folded.alias("f"))
    best = done.groupBy("series_id").agg(F.min(F.struct(F.col("f.sse").alias("sse"), "alpha", F.col("f.level").alias("level"))).alias("m"))
    return best.select("series_id", "m.alpha", "m.sse", "m.level")


def seasonal_smoothing(grid: DataFrame, m: int, params: list[tuple[float, float, float]], steps: int) -> DataFrame:
    """Additive level, trend and season of ``m`` slots (even) under each (alpha, beta, gamma); the triple with the least squared error
    forecasts ``steps`` slots ahead. Series with under two whole seasons have no row.

    Start: a centred 2 x m moving average over the first seasons (five, or as many as there are, and enough for ten averages) is
    the trend; the mean of what is left over it at each place of a season, less their mean, the season; a line through the first
    ten averages level and slope. Missing slots are filled forward before. Each series is folded in order of time; series and
    triples run side by side.
    """
    filled = grid.withColumn("v", F.last("value", ignorenulls=True).over(by_series().rowsBetween(Window.unboundedPreceding, 0))).where("v is not null")
    ordered = filled.groupBy("series_id").agg(F.max("t").alias("origin"), F.transform(F.sort_array(F.collect_list(F.struct("t", "v"))), lambda x: x["v"]).alias("v"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    enough = -(-(10 + m) // m)
    head = ordered.withColumn("cycles", F.greatest(F.least(F.lit(5), F.floor(F.size("v") / m)), F.lit(enough)).cast("int")).where((F.size("v") >= 2 * m) & (F.size("v") >= F.col("cycles") * m))
    head = head.withColumn("plain", F.transform(F.sequence(F.lit(1), F.col("cycles") * m - m + 1), lambda j: total(F.slice("v", j, m)) / m))
    head = head.withColumn("trend", F.zip_with(F.slice("plain", F.lit(1), F.size("plain") - 1), F.slice("plain", F.lit(2), F.size("plain") - 1), lambda x, y: (x + y) / 2))
    over = F.transform("trend", lambda y, j: F.element_at("v", j + m // 2 + 1) - y)
    head = head.withColumn("over", over)
    at_place = lambda k: F.filter("over", lambda x, j: (j + m // 2) % m == k)
    head = head.withColumn("places", F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda k: total(at_place(k)) / F.size(at_place(k))))
    head = head.withColumn("season", F.transform("places", lambda x: x - total(F.col("places")) / m))
    head = head.withColumn("mean", total(F.slice("trend", 1, 10)) / 10).withColumn("slope", total(F.transform(F.slice("trend", 1, 10), lambda y, j: (j - 4.5) * y)) / 82.5)
    tried = head.select("series_id", "origin", "v", "season", "mean", "slope", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(g).alias("g")) for a, b, g in params])).alias("p"))
    start = F.struct((F.col("mean") - F.col("slope") * 5.5).alias("level"), F.col("slope").alias("trend"), F.col("season"), F.lit(0.0).alias("sse"))

    def turn(acc: Column, y: Column) -> Column:
        s = F.element_at(acc["season"], 1)  # the season turns: its first slot is the one due now
        error = y - (acc["level"] + acc["trend"] + s)
        level = acc["level"] + acc["trend"] + F.col("p.a") * error
        return F.struct(level.alias("level"), (acc["trend"] + F.col("p.a") * F.col("p.b") * error).alias("trend"), F.concat(F.slice(acc["season"], 2, m - 1), F.array(s + F.col("p.g") * error)).alias("season"), (acc["sse"] + error * error).alias("sse"))

    done = tried.select("series_id", "origin", "p", F.aggregate("v", start, turn).alias("f"))
    best = done.groupBy("series_id", "origin").agg(F.min(F.struct(F.col("f.sse").alias("sse"), "p", "f")).alias("x"))
    out = best.select("series_id", "origin", "x.sse", "x.p", F.posexplode(F.slice("x.f.season", 1, steps)).alias("k", "s"), "x.f")
    return out.select("series_id", "origin", (F.col("k") + 1).alias("step"), F.col("p.a").alias("alpha"), F.col("p.b").alias("beta"), F.col("p.g").alias("gamma"), "sse", (F.col("f.level") + (F.col("k") + 1) * F.col("f.trend") + F.col("s")).alias("predicted"))


def ensemble(one: DataFrame, other: DataFrame, weight: float = 0.5, partial: str = "refuse") -> DataFrame:
    """``weight`` of one forecaster and the rest of the other, at the origins and steps of ``one``, never below 0.

    ``partial``: with ``refuse`` a forecast of which any member lacks any step is NULL at every step; with ``finite`` a step is the
    mean of those members that have it.
    """
    both = one.select("series_id", "origin", "step", F.col("predicted").alias("a")).join(other.select("series_id", "origin", "step", F.col("predicted").alias("b")), ["series_id", "origin", "step"], "left")
    mixed = weight * F.col("a") + (1 - weight) * F.col("b")
    if partial == "finite":
        mixed = F.coalesce(mixed, "a", "b")
    else:
        forecast = Window.partitionBy("series_id", "origin")
        mixed = F.when(F.count(mixed).over(forecast) == F.count("*").over(forecast), mixed)
    return both.select("series_id", "origin", "step", F.when(mixed.isNotNull(), F.greatest(mixed, F.lit(0.0))).alias("predicted"))


def lagged_ridge(grid: DataFrame, lags: tuple[int, ...], season: int, steps: int, step: int, seconds: int, rows: int, ridge: float = 1e-3) -> DataFrame:
    """A ridge regression for each step on the values ``lags`` - 1 slots back, fitted anew at every origin; (.., predicted, degraded).

    The fit takes the rows of the last ``seconds`` whose targets are known, standardizes them and adds ``ridge`` times their
    number to the diagonal; its sums come from trailing windows, so no row is read twice for an origin. Where under ``rows`` rows
    are in the window, or any value in them is missing, the step is yesterday's value, or the last one, and ``degraded``. At
    least 1.
    """
    w, k = by_series(), len(lags)
    base = grid.withColumns({f"x{i}": F.lag("value", lag - 1).over(w) for i, lag in enumerate(lags)}).withColumn("held", F.last("value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    base = base.withColumn("place", F.row_number().over(w))
    out = None
    for h in range(1, steps + 1):
        span = seconds // step - 1 - h  # rows before the last one whose target is known
        trail = w.rowsBetween(-span, 0)
        rowed = base.withColumn("y", F.lead("value", h).over(w)).withColumn("in_", F.col("place") >= max(lags))
        whole = F.col("in_") & F.col("y").isNotNull()
        for i in range(k):
            whole = whole & F.col(f"x{i}").isNotNull()
        total = lambda c: F.sum(F.when(whole, c)).over(trail)  # noqa: B023, E731
        sums = {"n": F.coalesce(F.sum(whole.cast("int")).over(trail), F.lit(0)), "asked": F.sum(F.col("in_").cast("int")).over(trail), "sy": total(F.col("y"))}
        for i in range(k):
            sums |= {f"s{i}": total(F.col(f"x{i}")), f"q{i}": total(F.col(f"x{i}") * F.col("y"))}
            sums |= {f"p{i}{j}": total(F.col(f"x{i}") * F.col(f"x{j}")) for j in range(i, k)}
        s = rowed.withColumns(sums)
        mean = lambda i: F.col(f"s{i}") / F.col("n")
        spread = {f"d{i}": F.sqrt(F.greatest(F.col(f"p{i}{i}") / F.col("n") - mean(i) * mean(i), F.lit(0.0))) for i in range(k)}
        s = s.where("n > 0").withColumns(spread).withColumns({f"d{i}": F.when(F.col(f"d{i}") < 1e-9, 1.0).otherwise(F.col(f"d{i}")) for i in range(k)})
        made = {f"b{i}": (F.col(f"q{i}") - mean(i) * F.col("sy")) / F.col(f"d{i}") for i in range(k)}
        for i in range(k):
            for j in range(i, k):
                cross = (F.col(f"p{i}{j}") - F.col("n") * mean(i) * mean(j)) / (F.col(f"d{i}") * F.col(f"d{j}"))
                made[f"a{i}{j}"] = cross + ridge * F.col("n") if i == j else cross
        fit = solved(s.withColumns(made), k - 1, (F.col("n") >= rows) & (F.col("n") == F.col("asked")))
        fit = fit.select("series_id", (F.col("t") + h * step).alias("origin"), (F.col("sy") / F.col("n")).alias("my"), *[f"c{i}" for i in range(k)], *[f"d{i}" for i in range(k)], *[mean(i).alias(f"m{i}") for i in range(k)])
        now = base.select("series_id", F.col("t").alias("origin"), "held", *[f"x{i}" for i in range(k)])
        told = now.join(fit, ["series_id", "origin"], "left").join(grid.select("series_id", (F.col("t") + season - h * step).alias("origin"), F.col("value").alias("before")), ["series_id", "origin"], "left")
        value = F.col("my")
        for i in range(k):
            value = value + (F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"d{i}") * F.col(f"c{i}")
        own = told.select("series_id", "origin", F.lit(h).alias("step"), (F.col("origin") + h * step).alias("target"), F.coalesce(value, "before", "held").alias("p"), value.isNull().alias("degraded"))
        own = own.withColumn("predicted", F.when(F.col("p").isNotNull(), F.greatest("p", F.lit(1.0)))).drop("p")
        out = own if out is None else out.unionByName(own)
    return out


def online_selector(costs: DataFrame, arms: list[str], half_life: float, least: int, penalty: float, default: int = 0) -> DataFrame:
    """The arm in use at each row. ``costs``: series_id, t, c (one matured cost for each arm, NULL where not matured by t).

    A row's costs are taken in first: each arm's average fades with ``half_life``. Until every arm has ``least`` costs the default is in
    use. Then the least average wins, where all but the arm in use bear ``penalty``; within 1e-9 (relative over 1) of the best the arm
    in use stays, else the first in order is taken.
    """
    keep = 0.5 ** (1 / half_life)

    def turn(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        (means, counts, use), (series, t, found) = state, row
        means = [m if c is None else c if m is None else (1 - keep) * c + keep * m for m, c in zip(means, found, strict=True)]
        counts = [k + (c is not None) for k, c in zip(counts, found, strict=True)]
        if min(counts) < least:
            use = default
        else:
            asked = [m + (0.0 if i == use else penalty) for i, m in enumerate(means)]
            limit = min(asked) + 1e-9 * max(1.0, abs(min(asked)))
            if asked[use] > limit:
                use = next(i for i, x in enumerate(asked) if x <= limit)
        return (means, counts, use), (series, t, arms[use])

    return fold_rows(costs.select("series_id", "t", "c"), ["t"], lambda: ([None] * len(arms), [0] * len(arms), default), turn, "series_id string, t long, arm string")
