"""Plausibility flags of readings; for inspection, nothing is dropped by them. NaN is null, so no flag is set by it."""

from __future__ import annotations

from pyspark.sql import Column

from fieldmark.functions.scalars import to_numeric
from fieldmark.schemas import HEART_RATE, LATITUDE, LONGITUDE, TOP_SPEED


def bad_latitude(lat: Column) -> Column:
    lat = to_numeric(lat)
    return (lat < -LATITUDE) | (lat > LATITUDE)


def bad_longitude(lon: Column) -> Column:
    lon = to_numeric(lon)
    return (lon < -LONGITUDE) | (lon > LONGITUDE)


def negative_speed(speed: Column) -> Column:
    return to_numeric(speed) < 0


def high_speed(speed: Column) -> Column:
    return to_numeric(speed) > TOP_SPEED


def bad_heart_rate(rate: Column) -> Column:
    """Outside the plausible range; a rate of zero counts."""
    rate = to_numeric(rate)
    return (rate < HEART_RATE[0]) | (rate > HEART_RATE[1])


def bad_heart_rate_nonzero(rate: Column) -> Column:
    """Outside the plausible range, but not zero."""
    rate = to_numeric(rate)
    return ((rate > 0) & (rate < HEART_RATE[0])) | (rate > HEART_RATE[1])


def zero_heart_rate(rate: Column) -> Column:
    return to_numeric(rate) == 0
