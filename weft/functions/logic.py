"""Logic (F1)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegralType, StringType

from .base import col, type_name, typed, Value


def if_(condition: Column, a: Value, b: Value, kind: str | None = None) -> Column:
    """IF: ``b`` takes the type ``kind`` (that of ``a``) where given; a null condition picks ``b``."""
    other = col(b) if kind is None else col(b).cast(kind)
    return F.when(condition, col(a)).otherwise(other)


def ifna(a: Column, b: Value) -> Column:
    return F.coalesce(a, col(b))


def ifs(*parts: Value) -> Column:
    """IFS(c1, v1, ..., default): the first true branch; the last argument is always the default, and a ``True`` before
    it belongs to it."""
    *pairs, default = parts
    if len(pairs) % 2 and pairs[-1] is True:
        pairs = pairs[:-1]
    if len(pairs) % 2:
        raise ValueError("ifs takes pairs and a default")
    return reduce(lambda rest, k: F.when(pairs[k], col(pairs[k + 1])).otherwise(rest), range(len(pairs) - 2, -1, -2), col(default))


def switch(x: Column, *parts: Value, kind: str | None = None) -> Column:
    """SWITCH(x, v1, r1, ..., [default]): null if nothing matches and no default is given; results become ``kind``."""
    pairs, default = (parts[:-1], parts[-1]) if len(parts) % 2 else (parts, None)
    typed = (lambda v: col(v).cast(kind)) if kind else col
    return reduce(lambda rest, k: F.when(x == col(pairs[k]), typed(pairs[k + 1])).otherwise(rest), range(len(pairs) - 2, -1, -2), typed(default))


def choose(i: Column, *values: Value) -> Column:
    """CHOOSE: 1-based; null out of range."""
    return reduce(lambda rest, k: F.when(i == k, col(values[k - 1])).otherwise(rest), range(len(values), 0, -1), F.lit(None))


def isblank(c: Column) -> Column:
    """Null only: an empty string is not blank."""
    return c.isNull()


isna = isblank


def iseven(c: Column) -> Column:
    return c % 2 == 0


def isodd(c: Column) -> Column:
    """False for negative odd numbers, whose remainder is -1."""
    return c % 2 == 1


def istext(df: DataFrame, name: str) -> Column:
    return F.lit(isinstance(df.schema[name].dataType, StringType))


def isnumber(df: DataFrame, name: str) -> Column:
    """True for integer and float columns; else whether the text is digits with an optional point (no sign)."""
    if isinstance(df.schema[name].dataType, IntegralType | FloatType | DoubleType):
        return F.lit(True)
    return F.col(name).cast("string").rlike(r"^\d*\.?\d+$")


def true() -> Column:
    return F.lit(True)


def false() -> Column:
    return F.lit(False)


def between(c: Column, low: Value, high: Value) -> Column:
    return c.between(col(low), col(high))


def fill_null(c: Column, value: Value, kind: str | None = None) -> Column:
    return F.coalesce(c, col(value).cast(kind) if kind else col(value))


def nullif(a: Column, b: Value, kind: str | None = None) -> Column:
    return F.nullif(a, col(b).cast(kind) if kind else col(b))


def isnan(c: Column) -> Column:
    """Null for a null."""
    return F.when(c.isNotNull(), F.isnan(c.cast("double")))


def isinf(c: Column) -> Column:
    return F.abs(c.cast("double")) == F.lit(float("inf"))


#: What a text must look like to be a number; others are told apart without the cost of a failed cast.
_WHOLE, _REAL = r"^[\x00-\x20]*[+-]?\d+[\x00-\x20]*$", r"(?i)^[\x00-\x20]*[+-]?(\d|\.\d|inf|nan)"


def try_cast(c: Column, name: str) -> Column:
    """The cast, or null where it fails."""
    kind = type_name(name)
    pattern = _WHOLE if kind in ("tinyint", "smallint", "int", "bigint") else _REAL if kind in ("float", "double") or kind.startswith("decimal") else None
    tried = c.try_cast(kind)
    return tried if pattern is None else F.when(~typed(c, "string") | c.cast("string").rlike(pattern), tried)


def coalesce(*values: Value) -> Column:
    return F.coalesce(*map(col, values))
