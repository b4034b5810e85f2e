"""Distinct rows by columns, and find-and-replace."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .shaping import order_keys

# Character classes of the named replacements.
PATTERNS = {"LETTERS": "[A-Za-z]", "DIGITS": "[0-9]", "SYMBOLS": r"[$@#%^*-+/]", "CURRENCY": "[€$£₹]", "PUNCTUATION": "[.,!]"}


def distinct_by(df: DataFrame, columns: list[str], tie: list[tuple[str, str]] | None = None) -> DataFrame:
    """One whole row for each value of ``columns``: the first in the order ``tie``, or any."""
    if not tie:
        return df.dropDuplicates(columns)
    n = F.row_number().over(Window.partitionBy(*columns).orderBy(*order_keys(tie)))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def replaced(c: Column, kind: str, find: str = "", value: str = "") -> Column:
    """``c`` after one replacement of the kind EXACT_TEXT, TEXT, EMPTY, FILL_NULL, REGEX, WHITESPACE or a class of
    characters."""
    kind, safe = kind.upper(), value.replace("\\", "\\\\").replace("$", "\\$")
    if kind == "EXACT_TEXT":
        return F.replace(c, F.lit(find), F.lit(value))
    if kind == "TEXT":
        return F.regexp_replace(c, f"(?i)^{re.escape(find)}$", safe)
    if kind == "EMPTY":
        return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s*$", safe)
    if kind == "FILL_NULL":
        return F.regexp_replace(F.coalesce(c, F.lit(value)), r"(?i)^(?:null|none|)$", safe)
    if kind == "WHITESPACE":
        return F.replace(c, F.lit(" "), F.lit(value))
    if kind == "REGEX":
        return F.regexp_replace(c, find, value)
    if kind not in PATTERNS:
        raise ValueError(f"unknown replacement {kind}")
    return F.regexp_replace(c, PATTERNS[kind], safe)


def find_and_replace(df: DataFrame, columns: list[str], operations: list[tuple[str, str, str]]) -> DataFrame:
    """(kind, find, value) operations in order on every column. Whole-number columns are refused."""
    for name in columns:
        if isinstance(df.schema[name].dataType, IntegralType):
            raise ValueError(f"{name} is a number column")
    out = df
    for name in columns:
        c = F.col(name)
        for kind, find, value in operations:
            c = replaced(c, kind, find, value)
        out = out.withColumn(name, c)
    return out
