"""Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.config import CLOCK_START, DAY, HOUR, RISK_BANDS


def whole_units(t: Column, unit: int) -> Column:
    """Floor division of integers, exact for any size of ``t``."""
    return ((t - F.pmod(t, F.lit(unit))) / F.lit(unit)).cast("long")


def hour_of_day(t: Column, ticks: int = 1) -> Column:
    return F.pmod(whole_units(t, HOUR * ticks), F.lit(24)).cast("long")


def day_of_week(t: Column, ticks: int = 1) -> Column:
    return F.pmod(whole_units(t, DAY * ticks), F.lit(7)).cast("long")


def days_since_start(t: Column, start: int = CLOCK_START, ticks: int = 1) -> Column:
    return (t - F.lit(start)) / F.lit(DAY * ticks)


def is_night(hour: Column) -> Column:
    return ((hour >= 23) | (hour <= 5)).cast("int")


def is_weekend(day: Column) -> Column:
    return (day >= 5).cast("int")


def where(condition: Column, then: Column, otherwise: Column) -> Column:
    """Two-way choice; an unknown condition takes the second branch."""
    return F.when(condition, then).otherwise(otherwise)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def floor_clip(c: Column, floor: float) -> Column:
    return F.greatest(c, F.lit(floor))


def safe_key(c: Column) -> Column:
    """``:``, blank and ``/`` become ``_``."""
    return F.translate(c, ": /", "___")


def decision(probability: Column, threshold: float) -> Column:
    return probability >= F.lit(threshold)


def risk_level(probability: Column) -> Column:
    (first_bound, first_name), *rest = RISK_BANDS
    banded = F.when(probability < first_bound, first_name)
    for bound, name in rest:
        banded = banded.when(probability < bound, name)
    return banded.when(probability.isNotNull(), "CRITICAL")


def in_domain(c: Column, values: list) -> Column:
    """Membership where an unknown value is outside the domain."""
    return F.coalesce(c.isin(values), F.lit(False))


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a timestamp column, with or without time zone."""
    return F.unix_micros(F.col(column).cast(T.TimestampType()))
