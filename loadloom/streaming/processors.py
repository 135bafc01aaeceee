"""Stateful stream processors: maturation with a deadline on receipt time, and calibration with trust.

They need the RocksDB state store: ``spark.sql.streaming.stateStore.providerClass`` set to ``STATE_STORE``.
Times are seconds; ``at`` is the event time as a timestamp and carries the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTCOME = "series_id string, origin long, status string, highest double, covered boolean, residual double, t long, value double, received long"
OUTCOME_COLUMNS = [c.split()[0] for c in OUTCOME.split(", ")]


class Maturation(StatefulProcessor):
    """Closes one issued window. Only receipt times decide: when the rows happen to be read changes nothing.

    From ``settle`` after its end a window is scored as soon as every target was received; at ``settle`` plus ``grace`` it closes for
    good, unscorable if a target is missing. A value received after that deadline is given as ``late`` and reopens nothing. A
    closed window is remembered for ``keep``; values for windows that nobody issued go at their deadline.
    """

    def __init__(self, horizon: int, settle: int, grace: int, keep: int) -> None:
        self.settled, self.deadline, self.keep = horizon + settle, horizon + settle + grace, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "bound double, targets array<long>")
        self.closed = handle.getValueState("closed", "closed boolean")
        self.values = handle.getMapState("values", "t long", "value double, received long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        origin, late = key[1], []
        for row in (r for frame in rows for r in frame.itertuples(index=False)):
            if row.targets is not None:
                if not (self.window.exists() or self.closed.exists()):  # the first issuance stands
                    self.window.update((None if pd.isna(row.bound) else float(row.bound), [int(t) for t in row.targets]))
                    self._wake(origin + self.settled)
                    self._wake(origin + self.deadline)
                continue
            t, value, received = int(row.t), float(row.value), int(row.received)
            if received > origin + self.deadline:
                if self.window.exists() or self.closed.exists():
                    late.append((*key, "late", None, None, None, t, value, received))
            elif not self.closed.exists():
                known = self.values.getValue((t,)) if self.values.containsKey((t,)) else None
                if known is None or received < known[1]:
                    self.values.updateValue((t,), (value, received))
                    self._wake(origin + self.deadline)
        now = timerValues.getCurrentWatermarkInMs()
        yield self._told(late + (self._outcome(key, final=False) if now >= 1000 * (origin + self.settled) else []))

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        origin, now = key[1], expiredTimerInfo.getExpiryTimeInMs()
        if now >= 1000 * (origin + self.deadline + self.keep):
            self.closed.clear()
            told = []
        else:
            told = self._outcome(key, final=now >= 1000 * (origin + self.deadline))
        yield self._told(told)

    def close(self) -> None: ...

    def _wake(self, seconds: int) -> None:
        self.handle.registerTimer(1000 * seconds)

    def _outcome(self, key: tuple, final: bool) -> list[tuple]:
        if not self.window.exists():
            if final:
                self.values.clear()
            return []
        bound, targets = self.window.get()
        got = [self.values.getValue((t,))[0] for t in targets if self.values.containsKey((t,))]
        if len(got) < len(targets) and not final:
            return []
        self.window.clear()
        self.values.clear()
        self.closed.update((True,))
        self._wake(key[1] + self.deadline + self.keep)
        if len(got) < len(targets):
            return [(*key, "unscorable", None, None, None, None, None, None)]
        highest = max(got)
        return [(*key, "scored", highest, None if bound is None else highest <= bound, None if bound is None else highest - bound, None, None, None)]

    @staticmethod
    def _told(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=OUTCOME_COLUMNS).astype({"covered": "object", "t": "Int64", "received": "Int64"})


def window_maturation(issued: DataFrame, receipts: DataFrame, horizon: int, every: int, settle: int = 120, grace: int = 600, keep: int = 86400, slack: str = "0 seconds") -> DataFrame:
    """Terminal outcomes of issued windows, once each, and late receipts.

    ``issued``: series_id, origin, targets (array), bound; ``receipts``: series_id, t, value, received. Targets lie within ``horizon`` of
    the origin and origins are multiples of ``every``, so a receipt goes to the windows that could hold it and each window
    is a key of its own: a series with a third of all rows is spread over its windows. The clock is the latest
    origin or receipt time read; ``slack`` is how far rows may be read behind it.
    """
    first = F.ceil((F.col("t") - horizon) / every).cast("bigint") * every
    asked = issued.select("series_id", F.col("origin").cast("bigint"), F.timestamp_seconds("origin").alias("at"), F.col("targets").cast("array<bigint>"), F.col("bound").cast("double"), F.lit(None).cast("bigint").alias("t"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("bigint").alias("received"))
    seen = receipts.select("series_id", F.explode(F.filter(F.sequence(first, first + horizon, F.lit(every).cast("bigint")), lambda o: o < F.col("t"))).alias("origin"), F.timestamp_seconds("received").alias("at"), F.lit(None).cast("array<bigint>").alias("targets"), F.lit(None).cast("double").alias("bound"), F.col("t").cast("bigint"), F.col("value").cast("double"), F.col("received").cast("bigint"))
    line = asked.unionByName(seen).withWatermark("at", slack)
    return line.groupBy("series_id", "origin").transformWithStateInPandas(Maturation(horizon, settle, grace, keep), OUTCOME, "append", "EventTime")


VERDICT = "series_id string, seq long, t long, level long, trusted boolean"


class Calibration(StatefulProcessor):
    """Adaptive level and trust of one series, one step for each sequence number.

    Level: a + step * (target - missed) in whole units of 1/scale, kept in [0, scale], moved by bounded outcomes alone. Trust: lost at
    the first unhealthy look, given back after ``seconds`` of health and ``bounds`` issued. Each is a state of its own; the number of the
    last step guards both, so a repeated or replayed record changes neither.
    """

    def __init__(self, target: int, step: int, scale: int, seconds: int, bounds: int) -> None:
        self.target, self.step, self.scale, self.seconds, self.bounds = target, step, scale, seconds, bounds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.level = handle.getValueState("level", "level long")
        self.trust = handle.getValueState("trust", "trusted boolean, since long, issued long")
        self.seq = handle.getValueState("seq", "seq long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        level = self.level.get()[0] if self.level.exists() else self.target
        trusted, since, issued = self.trust.get() if self.trust.exists() else (True, None, 0)
        last = self.seq.get()[0] if self.seq.exists() else -1
        out = []
        for row in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            seq, t = int(row.seq), int(row.t)
            if seq <= last:
                continue
            last = seq
            if not pd.isna(row.missed):  # no bound was issued: nothing is learnt
                level = max(0, min(self.scale, level + self.step * (self.target - (self.scale if row.missed else 0)) // self.scale))
            if row.healthy:
                since, issued = t if since is None else since, issued + int(row.issued)
                trusted = trusted or (t - since >= self.seconds and issued >= self.bounds)
            else:
                trusted, since, issued = False, None, 0
            out.append((key[0], seq, t, level, trusted))
        self.level.update((level,))
        self.trust.update((trusted, since, issued))
        self.seq.update((last,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in VERDICT.split(", ")])

    def close(self) -> None: ...


def calibrated_trust(outcomes: DataFrame, target: int = 10_000_000, step: int = 500_000, scale: int = 10**8, seconds: int = 86400, bounds: int = 32) -> DataFrame:
    """Level and trust after each outcome (series_id, seq, t, missed, healthy, issued), exactly once by sequence number."""
    return outcomes.groupBy("series_id").transformWithStateInPandas(Calibration(target, step, scale, seconds, bounds), VERDICT, "append", "None")
