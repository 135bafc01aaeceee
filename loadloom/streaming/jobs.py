"""Structured Streaming forms of the issuance and maturation path.

Event time is seconds in ``t``; ``ts`` is the same as a timestamp and carries the watermark. Each job gives the batch
operator's rows once its input has come, and goes on from its checkpoint after a restart.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SETTLE = "120 seconds"


def settled_counts(stream: DataFrame, width: str = "10 minutes", settle: str = SETTLE) -> DataFrame:
    """Requests in each tumbling window, given once the watermark (``settle`` behind) has passed its end."""
    return stream.withWatermark("ts", settle).groupBy("series_id", F.window("ts", width).alias("w")).agg(F.count("*").alias("n")).select("series_id", F.unix_seconds("w.start").alias("t"), "n")


def sliding_counts(stream: DataFrame, width: str, slide: str, settle: str = SETTLE) -> DataFrame:
    return stream.withWatermark("ts", settle).groupBy("series_id", F.window("ts", width, slide).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("series_id", F.unix_seconds("w.start").alias("t"), "n", "total")


def sessions(stream: DataFrame, gap: str, settle: str = SETTLE) -> DataFrame:
    """Heartbeats under ``gap`` apart, as one row each."""
    out = stream.withWatermark("ts", settle).groupBy("series_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("beats"))
    return out.select("series_id", F.unix_seconds("w.start").alias("start"), F.unix_seconds("w.end").alias("end"), "beats")


def first_receipts(stream: DataFrame, keep: str = "1 hour") -> DataFrame:
    """The first row of each (series_id, t); later ones within the watermark are dropped."""
    return stream.withWatermark("ts", keep).dropDuplicatesWithinWatermark(["series_id", "t"])


def matured(issued: DataFrame, receipts: DataFrame, deadline: str = "720 seconds") -> DataFrame:
    """Issued targets (series_id, target_ts, predicted) with the value received for them by the deadline, NULL where none came.

    A left outer stream-stream join: a target is given with NULL once the watermark shows that no receipt can still come.
    """
    left = issued.withWatermark("target_ts", "0 seconds").select(F.col("series_id").alias("s"), "target_ts", "predicted")
    right = receipts.withWatermark("ts", deadline)
    on = (F.col("s") == F.col("series_id")) & (F.col("ts") >= F.col("target_ts")) & (F.col("ts") < F.col("target_ts") + F.expr("interval 1 second"))
    return left.join(right, on, "leftOuter").select(F.col("s").alias("series_id"), "target_ts", "predicted", F.col("value").alias("actual"))


LEVEL = "series_id string, seq long, level long"
LEVEL_STATE = "seq long, level long"


def level_updates(target: int, step: int, scale: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, level = state.get if state.exists else (-1, target)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for s, missed in zip(rows["seq"].tolist(), rows["missed"].tolist(), strict=True):
            if s <= seq:  # seen before: a restart or a repeated record
                continue
            seq, level = s, max(0, min(scale, level + step * (target - (scale if missed else 0)) // scale))
            out.append((key[0], seq, level))
        state.update((seq, level))
        yield pd.DataFrame(out, columns=["series_id", "seq", "level"])

    return run


def adaptive_levels(outcomes: DataFrame, target: int = 10_000_000, step: int = 500_000, scale: int = 10**8) -> DataFrame:
    """The level after each outcome (series_id, seq, missed), exactly once by sequence number; the state of a series is two numbers."""
    return outcomes.groupBy("series_id").applyInPandasWithState(level_updates(target, step, scale), LEVEL, LEVEL_STATE, "append", GroupStateTimeout.NoTimeout)
