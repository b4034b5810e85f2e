"""Operators (F2). Dates and timestamps plus or minus a number move by days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import Value, as_text, col


def divide(a: Column, b: Value) -> Column:
    """True division; null for a divisor of 0."""
    return a.cast("double") / F.nullif(col(b).cast("double"), F.lit(0.0))


def modulo(a: Column, b: Value) -> Column:
    """Remainder with the sign of ``a``; null for a divisor of 0."""
    return a % F.nullif(col(b), F.lit(0))


def multiply(a: Column, b: Value) -> Column:
    return a * col(b)


def add(a: Column, b: Value, temporal: bool = False) -> Column:
    """Sum; with ``temporal`` a date or timestamp moved by ``b`` days, as a timestamp."""
    return a.cast("timestamp") + F.make_dt_interval(days=col(b).cast("int")) if temporal else a + col(b)


def plus(a: Column) -> Column:
    return a


def subtract(a: Column, b: Value, temporal: str | None = None) -> Column:
    """Difference; with ``temporal="days"`` a date or timestamp ``b`` days earlier, with ``"dates"`` the whole days from
    ``b`` to ``a``."""
    if temporal == "days":
        return a.cast("timestamp") - F.make_dt_interval(days=col(b).cast("int"))
    if temporal == "dates":
        return F.datediff(a.cast("date"), col(b).cast("date")).cast("long")
    return a - col(b)


def minus(a: Column) -> Column:
    return -a


def concat(a: Value, b: Value) -> Column:
    """``a & b``: both as text; null if either is."""
    return F.concat(as_text(a), as_text(b))


def equal(a: Column, b: Value) -> Column:
    return a == col(b)


def unequal(a: Column, b: Value) -> Column:
    return a != col(b)


def greater(a: Column, b: Value) -> Column:
    return a > col(b)


def greater_equal(a: Column, b: Value) -> Column:
    return a >= col(b)


def less(a: Column, b: Value) -> Column:
    return a < col(b)


def less_equal(a: Column, b: Value) -> Column:
    return a <= col(b)


def and_(a: Column, b: Column, *_: Column) -> Column:
    """The first two arguments only."""
    return a & b


def or_(a: Column, b: Column, *_: Column) -> Column:
    """The first two arguments only."""
    return a | b


def not_(a: Column) -> Column:
    return ~a


def xor(a: Column, b: Column, *_: Column) -> Column:
    """The first two arguments only."""
    return (a | b) & ~(a & b)
