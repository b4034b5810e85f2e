"""Dates and times (F5). Session time zone UTC is assumed for epoch values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import Value, col
from .text import java_pattern

day, month, year, hour, minute, second = F.dayofmonth, F.month, F.year, F.hour, F.minute, F.second
hours, minutes, seconds = F.hour, F.minute, F.second
quarter, day_of_year, isoweeknum = F.quarter, F.dayofyear, F.weekofyear


def now() -> Column:
    return F.current_timestamp()


def today() -> Column:
    return F.current_date()


def date(*args: Value) -> Column:
    """DATE(year, month, day), DATE(text, strftime pattern) or DATE(x)."""
    if len(args) == 3:
        return F.make_date(*map(col, args))
    return F.to_date(args[0], java_pattern(args[1])) if len(args) == 2 else col(args[0]).cast("date")


def days(a: Column, b: Column) -> Column:
    return F.floor((F.unix_timestamp(a.cast("timestamp")) - F.unix_timestamp(b.cast("timestamp"))) / 86400)


def edate(d: Column, n: Value) -> Column:
    return F.add_months(d, n)


def time(*args: Value) -> Column:
    """TIME(h, m, s) or TIME(x), as text HH:mm:ss."""
    return F.format_string("%02d:%02d:%02d", *map(col, args)) if len(args) == 3 else F.date_format(args[0], "HH:mm:ss")


def datetime(*args: Value) -> Column:
    """DATETIME(y, mo, d, h, mi, s) or DATETIME(x)."""
    return F.make_timestamp(*map(col, args)) if len(args) == 6 else col(args[0]).cast("timestamp")


def weekday(d: Column) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return F.dayofweek(d) - 1


def weeknum(d: Column) -> Column:
    """Week of the year, 0 to 53; weeks begin on Sunday."""
    return F.floor((F.dayofyear(d) + 7 - F.dayofweek(d)) / 7)


#: Days of the units of differences: these are not calendar months and years.
UNIT_DAYS = {"D": 1, "M": 30, "Y": 365}


def datetimediff(a: Column, b: Column, unit: str) -> Column:
    return F.floor((F.unix_timestamp(a.cast("timestamp")) - F.unix_timestamp(b.cast("timestamp"))) / (86400 * UNIT_DAYS[unit.upper()]))


def datedif(a: Column, b: Column, unit: str) -> Column:
    return F.floor(F.datediff(a, b) / UNIT_DAYS[unit.upper()])


datediff = datedif


def n(c: Column) -> Column:
    """A boolean as 1 or 0, else a whole number."""
    return c.cast("int")


def epoch_seconds(d: Column) -> Column:
    return F.unix_timestamp(d.cast("timestamp"))


def strftime(d: Column, pattern: str) -> Column:
    return F.date_format(d, java_pattern(pattern))


def millisecond(d: Column) -> Column:
    return F.floor(F.pmod(F.unix_micros(d.cast("timestamp")), F.lit(1_000_000)) / 1000)


def microsecond(d: Column) -> Column:
    return F.pmod(F.unix_micros(d.cast("timestamp")), F.lit(1_000_000))


# Names of units in upper case and the units of truncation.
UNITS = {
    "YEAR": "year", "YEARS": "year", "Y": "year", "QUARTER": "quarter", "Q": "quarter", "MONTH": "month", "MONTHS": "month", "M": "month", "WEEK": "week", "WEEKS": "week", "W": "week", "DAY": "day", "DAYS": "day", "D": "day",
    "HOUR": "hour", "HOURS": "hour", "H": "hour", "MINUTE": "minute", "MINUTES": "minute", "SECOND": "second", "SECONDS": "second", "S": "second",
}


def date_trunc(d: Column, unit: str) -> Column:
    """Year to second, with quarter and week (Monday), by any name of UNITS in any case; other units are an error."""
    known = UNITS.get(unit.strip().strip("\"'").strip().upper())
    if known is None:
        raise ValueError(f"unknown unit {unit}")
    return F.date_trunc(known, d)
