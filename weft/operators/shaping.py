"""Column shaping, sorting and paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.base import type_name


def synthesize(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add or replace columns one after another; later expressions see earlier columns."""
    return reduce(lambda d, x: d.withColumn(*x), columns.items(), df)


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Renames in order, so that chains work."""
    return reduce(lambda d, x: d.withColumnRenamed(*x), names.items(), df)


def combine(df: DataFrame, name: str, parts: list[str | Column]) -> DataFrame:
    """A column of joined texts: names of columns, or Columns such as literals. Null if any part is null."""
    return df.withColumn(name, F.concat(*((F.col(p) if isinstance(p, str) else p).cast("string") for p in parts)))


def reorder(df: DataFrame, first: list[str]) -> DataFrame:
    """Listed columns that exist come first, the rest follow as they were."""
    there = list(dict.fromkeys(c for c in first if c in df.columns))
    return df.select(*there, *(c for c in df.columns if c not in there))


def visible(df: DataFrame, columns: list[str] | None = None, hidden: list[str] = ()) -> DataFrame:
    """The visible columns; None or ["*"] means all but the hidden ones."""
    names = df.columns if columns in (None, ["*"]) else columns
    return df.select(*(c for c in names if c not in hidden))


def cast(df: DataFrame, types: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(type_name(t)) for c, t in types.items()})


def literal(df: DataFrame, name: str, value, kind: str | None = None) -> DataFrame:  # noqa: ANN001
    return df.withColumn(name, F.lit(value).cast(type_name(kind)) if kind else F.lit(value))


def unpivoted(df: DataFrame, keys: list[str], values: list[str], name: str = "name", value: str = "value") -> DataFrame:
    """Wide to long."""
    return df.unpivot(keys, values, name, value)


def order_keys(keys: list[tuple[str, str]]) -> list[Column]:
    """(column, "asc" or "desc") as sort orders; nulls come last either way."""
    return [F.col(c).desc_nulls_last() if d.lower().startswith("desc") else F.col(c).asc_nulls_last() for c, d in keys]


def sort(df: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    return df.orderBy(*order_keys(keys))


def page(df: DataFrame, keys: list[tuple[str, str]], limit: int, number: int = 1) -> DataFrame:
    """Page ``number`` from 1 of ``limit`` rows. ``keys`` should name every row once, or pages may overlap."""
    return sort(df, keys).offset(limit * (number - 1)).limit(limit)
