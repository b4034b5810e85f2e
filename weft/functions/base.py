"""Casting, copying and membership (F7), and helpers of the other groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | str | int | float | bool | None

# Names of types and the Spark types they stand for.
TYPE_NAMES = {
    "TINYINT": "tinyint", "SMALLINT": "smallint", "INT": "int", "INTEGER": "int", "BIGINT": "bigint", "LONG": "bigint", "FLOAT": "float", "REAL": "float", "DOUBLE": "double", "NUMERIC": "double", "DECIMAL": "decimal(38,18)",
    "STRING": "string", "TEXT": "string", "VARCHAR": "string", "CHAR": "string", "BOOLEAN": "boolean", "BOOL": "boolean", "DATE": "date", "DATETIME": "timestamp", "TIMESTAMP": "timestamp",
}


def col(x: Value) -> Column:
    """A Column as it is; anything else as a literal."""
    return x if isinstance(x, Column) else F.lit(x)


def type_name(name: str) -> str:
    """The Spark type of a type name in any case; unknown names pass through."""
    return TYPE_NAMES.get(name.strip().upper(), name)


def typed(c: Value, *names: str) -> Column:
    """Whether an expression is of one of these types; known before the query runs."""
    return F.typeof(col(c)).isin(*names)


def whole(*cs: Value) -> Column:
    """Whether all are of whole-number types."""
    out = F.lit(True)
    for c in cs:
        out = out & typed(c, "tinyint", "smallint", "int", "bigint")
    return out


def as_text(c: Value) -> Column:
    """As text; floating-point numbers of 1e-4 to 1e15 without exponent."""
    s = col(c).cast("string")
    plain = F.regexp_replace(F.regexp_replace(s.try_cast("decimal(38,18)").cast("string"), "0+$", ""), r"\.$", ".0")
    return F.when(typed(c, "double", "float") & s.rlike(r"^-?\d\.\d+E([7-9]|1[0-4]|-4)$"), plain).otherwise(s)


def cast(c: Value, name: str) -> Column:
    """CAST: bad input is an error under ANSI rules; see ``try_cast``."""
    return col(c).cast(type_name(name))


def duplicate(c: Column) -> Column:
    return col(c)


def isin(c: Column, *values: Value) -> Column:
    return c.isin(*values)


def notin(c: Column, *values: Value) -> Column:
    """Not a member; null for a null."""
    return ~c.isin(*values)


def gestep(c: Column, step: Value = 0) -> Column:
    """1 if at least ``step``, else 0; a null is not."""
    return F.when(c >= col(step), 1).otherwise(0)
