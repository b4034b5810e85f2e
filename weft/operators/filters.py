"""Filters: conditions joined by AND and OR from left to right, where AND binds tighter."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

#: A value that no value of the column's type equals.
UNREADABLE = object()
_WHOLE, _NUMBER = re.compile(r"\s*[+-]?\d+\s*"), re.compile(r"\s*[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?\s*", re.I)
_DATE = re.compile(r"\s*[+-]?\d{4,7}(-\d{1,2}(-\d{1,2}([ T].*)?)?)?\s*")
_TRUTH = dict.fromkeys(("true", "t", "yes", "y", "1"), True) | dict.fromkeys(("false", "f", "no", "n", "0"), False)


def _number(text: str) -> Any:
    return int(text) if _WHOLE.fullmatch(text) else float(text) if _NUMBER.fullmatch(text) else UNREADABLE


def typed(value: Any, kind: DataType | None = None) -> Any:
    """A value as the column's type reads it: text as a number, a truth value or a date where the column holds those, and a
    number as text for a column of texts; UNREADABLE if it is none. Without a type text is read by its looks."""
    if isinstance(kind, StringType) and isinstance(value, int | float) and not isinstance(value, bool):
        return str(value)
    if not isinstance(value, str) or isinstance(kind, StringType):
        return value
    if isinstance(kind, DateType | TimestampType | TimestampNTZType):
        return value if _DATE.fullmatch(value) else UNREADABLE
    if isinstance(kind, BooleanType):
        return _TRUTH.get(value.strip().lower(), UNREADABLE)
    if isinstance(kind, NumericType):
        return _number(value)
    found = _TRUTH[value.strip().lower()] if value.strip().lower() in ("true", "false") else _number(value)
    return value if found is UNREADABLE else found


@dataclass(frozen=True)
class Condition:
    """``left`` (a column name or an expression), an operator, and a value, a Column or several values.

    ``joined`` says how the condition is tied to the one before it: AND or OR. Values given as text are read by the column's
    type; one that can't be read so is equal to no row and unequal to all but nulls.
    """

    left: str | Column
    operator: str
    right: Any = None
    joined: str = "AND"

    def column(self, df: DataFrame) -> Column:
        """The condition on ``df``, whose type of the left side says how values are read."""
        c = F.col(self.left) if isinstance(self.left, str) else self.left
        op = self.operator.upper()
        if op not in _TESTS:
            raise ValueError(f"unknown operator {self.operator}")
        kind, right = df.select(c).schema[0].dataType, self.right
        none, all_ = F.when(c.isNotNull(), F.lit(False)), F.when(c.isNotNull(), F.lit(True))
        if op in ("IN", "NOTIN"):
            right = [typed(x.strip() if isinstance(x, str) else x, kind) for x in (right.split(",") if isinstance(right, str) else right)]
            right = [_given(x, kind) for x in right if x is not UNREADABLE]
            if not right:
                return none if op == "IN" else all_
        elif op == "BETWEEN":
            right = [_one(x, kind) for x in right]
            if UNREADABLE in [x for x in right if not isinstance(x, Column)]:
                return none
        elif op in _COMPARED:
            right = _one(right, kind)
            if right is UNREADABLE:
                return all_ if op == "NEQ" else none
        return _TESTS[op](c, right)


def _one(v: Any, kind: DataType) -> Any:
    v = v[0] if isinstance(v, list | tuple) and len(v) == 1 else v
    if isinstance(v, Column):
        return v
    v = typed(v, kind)
    return v if v is UNREADABLE else _given(v, kind)


def _given(v: Any, kind: DataType) -> Column:
    """A readable value; text that looks like a date but is none, such as February 30, is null."""
    temporal = isinstance(v, str) and isinstance(kind, DateType | TimestampType | TimestampNTZType)
    return F.lit(v).try_cast(kind) if temporal else F.lit(v)


_COMPARED = ("EQ", "NEQ", "GT", "GTE", "LT", "LTE")
_TESTS = {
    "EQ": lambda c, v: c == v,
    "NEQ": lambda c, v: c != v,
    "GT": lambda c, v: c > v,
    "GTE": lambda c, v: c >= v,
    "LT": lambda c, v: c < v,
    "LTE": lambda c, v: c <= v,
    "IN": lambda c, v: c.isin(v),
    "NOTIN": lambda c, v: ~c.isin(v),
    "BETWEEN": lambda c, v: c.between(*v),
    "CONTAINS": lambda c, v: c.like(f"%{v}%"),
    "NOTCONTAINS": lambda c, v: ~c.like(f"%{v}%"),
    "STARTSWITH": lambda c, v: c.like(f"{v}%"),
    "ENDSWITH": lambda c, v: c.like(f"%{v}"),
    "LIKE": lambda c, v: c.like(v),
    "NULL": lambda c, v: c.isNull(),
    "NOTNULL": lambda c, v: c.isNotNull(),
    "TRUE": lambda c, v: c == F.lit(True),
    "FALSE": lambda c, v: c == F.lit(False),
}


def predicate(df: DataFrame, conditions: list[Condition]) -> Column:
    groups: list[list[Column]] = []
    for k, c in enumerate(conditions):
        if k and c.joined.upper() == "AND":
            groups[-1].append(c.column(df))
        else:
            groups.append([c.column(df)])
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, g) for g in groups])


def where(df: DataFrame, conditions: list[Condition]) -> DataFrame:
    """Rows for which the conditions hold; a null drops the row. No condition keeps all."""
    return df.where(predicate(df, conditions)) if conditions else df
