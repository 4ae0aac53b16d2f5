"""Calendar arithmetic on year, month and day numbers, Julian before a change-over day.

Spark's DATE is proleptic Gregorian, so historical days stay integers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The first day of the new calendar, as yyyymmdd.
CHANGE_OVER = 17520914
DAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def _div(a: Column, b: int) -> Column:
    """Floor division of a non-negative column."""
    return F.floor(a / b).cast("long")


def day_number(y: Column, m: Column, d: Column) -> Column:
    """The Julian day number; Julian calendar before the change-over, Gregorian from it on."""
    a = _div(14 - m, 12)
    yy, mm = y + 4800 - a, m + 12 * a - 3
    base = d + _div(153 * mm + 2, 5) + 365 * yy + _div(yy, 4)
    return F.when(y * 10000 + m * 100 + d >= CHANGE_OVER, base - _div(yy, 100) + _div(yy, 400) - 32045).otherwise(base - 32083).cast("long")


def weekday(y: Column, m: Column, d: Column) -> Column:
    """0 for Monday to 6 for Sunday."""
    return (day_number(y, m, d) % 7).cast("int")


def is_leap(y: Column) -> Column:
    return F.when(y > 1752, ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)).otherwise(y % 4 == 0)


def days_in_month(y: Column, m: Column) -> Column:
    return F.when(m == 2, F.when(is_leap(y), 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def valid(y: Column, m: Column, d: Column, day: Column | None = None) -> Column:
    """The day exists, and falls on the weekday (0 for Monday) if one is given."""
    out = m.between(1, 12) & (d >= 1) & (d <= days_in_month(y, m))
    return out if day is None else out & (day.isNull() | (weekday(y, m, d) == day))
