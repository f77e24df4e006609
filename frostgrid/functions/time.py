"""Exact integer time arithmetic that does not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIT_MICROS = {
    "microsecond": 1,
    "millisecond": 1_000,
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
    "week": 604_800_000_000,
}
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def duration_micros(duration: str) -> int:
    """Microseconds in a duration such as ``"15 minutes"`` or ``"1 hour 30 minutes"``, which may be 0."""
    words = duration.split()
    amounts, units = words[::2], [unit.rstrip("s") for unit in words[1::2]]
    if not units or len(amounts) != len(units) or not all(a.isdigit() for a in amounts) or not set(units) <= set(UNIT_MICROS):
        raise ValueError(f"not a fixed step: {duration!r}")
    return sum(int(amount) * UNIT_MICROS[unit] for amount, unit in zip(amounts, units))


def step_micros(step: str) -> int:
    """As :func:`duration_micros`, above 0."""
    length = duration_micros(step)
    if length == 0:
        raise ValueError(f"not a fixed step: {step!r}")
    return length


def floor_div(value: Column, width: Column | int) -> Column:
    """``floor(value / width)`` in whole numbers, right for negatives too."""
    width = F.lit(width).cast("bigint") if isinstance(width, int) else width
    return F.call_function("div", value - F.pmod(value, width), width)


def micros(df: DataFrame, name: str) -> Column:
    """A time column as microseconds since 1970.

    For a ``timestamp_ntz`` the seconds come from ``unix_timestamp``, which reads
    it as it stands but cuts toward 0. Only the fraction of the second is taken
    from a cast through the session time zone, whose offsets are whole seconds.
    """
    column = F.col(name)
    if not isinstance(df.schema[name].dataType, T.TimestampNTZType):
        return F.unix_micros(column)
    fraction = F.pmod(F.unix_micros(column.cast("timestamp")), F.lit(1_000_000))
    cut_up = (column < F.expr(EPOCH)) & (fraction > 0)
    seconds = F.unix_timestamp(column) - F.when(cut_up, 1).otherwise(0)
    return seconds * 1_000_000 + fraction


def from_micros(value: Column, dtype: T.DataType) -> Column:
    """Inverse of :func:`micros` for a column of type ``dtype``."""
    if isinstance(dtype, T.TimestampNTZType):
        return F.expr(EPOCH) + value * F.expr("interval '0.000001' second")
    return F.timestamp_micros(value)
