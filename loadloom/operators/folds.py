"""Folds over the ordered rows of each series, for rules whose next step depends on what the last one decided.

Rows are dealt by series, sorted in their tasks and read batch by batch; what is held is one series' state, a few numbers,
however long the series is. Series run side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}


def fold_rows(rows: DataFrame, order: list[str], start: Callable[[], Any], turn: Callable[[Any, tuple], tuple[Any, tuple]], schema: str) -> DataFrame:
    """``turn`` takes the state and a row of ``rows`` (series_id first) to the next state and a row of ``schema``."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != now:
                    now, state = row[0], start()
                state, told = turn(state, row)
                out.append(told)
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, ARROW[k]) for c, k in zip(columns, kinds, strict=True)], names=list(names))

    return rows.repartition("series_id").sortWithinPartitions("series_id", *order).mapInArrow(run, schema)
