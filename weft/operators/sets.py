"""Unions."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import Condition, where


@dataclass(frozen=True)
class Child:
    """A table with {parent column: own column} and filters of its own."""

    table: DataFrame
    columns: dict[str, str] = field(default_factory=dict)
    filters: tuple[Condition, ...] = ()


def union(parent: DataFrame, children: list[Child], distinct: bool = False, filters: tuple[Condition, ...] = ()) -> DataFrame:
    """The parent's rows and the children's, in the parent's columns and types; columns that are not mapped are null.

    All rows, or distinct ones.
    """
    parts = [where(parent, list(filters))]
    for child in children:
        own = where(child.table, list(child.filters))
        parts.append(own.select(*((F.col(child.columns[f.name]) if f.name in child.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in parent.schema.fields)))
    out = reduce(DataFrame.unionByName, parts)
    return out.distinct() if distinct else out


@dataclass(frozen=True)
class Branch:
    """A table with filters and output expressions by name."""

    table: DataFrame
    columns: dict[str, Column]
    filters: tuple[Condition, ...] = ()


def branches(parts: list[Branch], distinct: bool = False) -> DataFrame:
    """Two or more branches one below another; the first one names the columns."""
    if len(parts) < 2:
        raise ValueError("a union has two branches at least")
    names = list(parts[0].columns)
    out = reduce(DataFrame.unionByName, [where(b.table, list(b.filters)).select(*(b.columns[n].alias(n) for n in names)) for b in parts])
    return out.distinct() if distinct else out
