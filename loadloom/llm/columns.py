"""Column helpers for operators that stay within DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

WORDS = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORDS), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column], most: int = 1 << 26) -> Column:
    """Running totals of an array under an associative ``combine``.

    In each step every place takes in the total that ends ``step`` places before it, and the step doubles, so the work is
    n log n and no array grows.
    """

    def level(x: Column, step: int) -> Column:
        if step >= most:
            return x
        taken = F.transform(x, lambda v, i: F.when(i >= step, combine(F.get(x, i - step), v)).otherwise(v))
        return F.when(F.size(x) <= step, x).otherwise(let(taken, lambda y: level(y, step * 2)))

    return let(values, lambda x: level(x, 1))


def matches(text: Column, pattern: str) -> Column:
    """Leftmost matches that don't overlap: array of (start, end, value), in code points, end exclusive.

    The pieces between matches and the matches themselves take turns, so running sums of their lengths give every place.
    """
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(pairs: Column) -> Column:
        ends = running(F.transform(pairs, lambda x: x["gap"] + F.length(x["value"])), lambda a, b: a + b)
        spans = lambda e: F.transform(pairs, lambda x, i: F.struct((F.get(e, i) - F.length(x["value"])).alias("start"), F.get(e, i).alias("end"), x["value"].alias("value")))
        return let(ends, spans)

    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("value")), lambda x: x["value"].isNotNull())
    return F.when(text.rlike(pattern), let(pairs, placed)).otherwise(empty)
