"""Scalar rules as column expressions: replica conversion, leads, phases, statistics of one row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed values.
REQUESTS_PER_REPLICA_MINUTE = 600
CEIL_SLACK = 1e-9


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without zone, read as UTC whatever the session's zone is."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def floor_to(t: Column, step: int) -> Column:
    return F.floor(t / step) * step


def ratio(top: Column, bottom: Column) -> Column:
    """NULL, never 0, where there is nothing to divide by."""
    return F.when(bottom != 0, top / bottom)


def required_replicas(rpm: Column, capacity: float = REQUESTS_PER_REPLICA_MINUTE) -> Column:
    return F.greatest(F.lit(1), F.ceil(rpm / capacity - CEIL_SLACK).cast("int"))


def capped_prediction(predicted: Column, reactive: Column, most_extra: int, percent: int) -> Column:
    """A prediction may exceed the reactive count by a share of it, and by no more than ``most_extra``."""
    return F.least(predicted, reactive + F.least(F.lit(most_extra), F.ceil(reactive * percent / 100).cast("int")))


def headroom_replicas(rpm: Column, capacity: float, headroom: float) -> Column:
    return F.ceil(rpm / (capacity * (1 - headroom / 100))).cast("int")


def lead_seconds(delay: Column, control: int, act: int, step: int, least: Column) -> Column:
    """The larger of the time to act and the least lead, in whole steps."""
    return F.greatest(F.ceil((delay + control + act + step) / step), F.ceil(least / step)).cast("long") * step


def day_phase(hour: Column) -> Column:
    return F.when(hour.between(6, 14), "rising").when(hour == 15, "peak").when(hour.between(16, 20), "falling").otherwise("trough")


def pinball(actual: Column, bound: Column, tau: float) -> Column:
    return F.when(actual >= bound, tau * (actual - bound)).otherwise((1 - tau) * (bound - actual))


def asymmetric_cost(actual: Column, predicted: Column, under: float = 2.0, over: float = 1.0) -> Column:
    return F.when(actual > predicted, under * (actual - predicted)).otherwise(over * (predicted - actual))


def decision_source(desired: Column, current: Column, prediction: Column, reactive: Column, least: Column, most: Column) -> Column:
    """What a desired count came from, first rule that holds."""
    return (
        F.when(desired == current, "keep_current")
        .when(desired == least, "min")
        .when(desired == most, "max")
        .when((prediction == reactive) & (desired == prediction), "tie")
        .when(desired == prediction, "prediction")
        .otherwise("reactive")
    )
