"""Grouping, conditions on groups, formula aggregates and pivots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "COUNT": F.count, "COUNT_DISTINCT": F.count_distinct, "SUM": F.sum, "AVG": F.avg, "MEAN": F.avg, "MIN": F.min, "MAX": F.max, "STD": F.stddev_samp, "STDDEV": F.stddev_samp, "VARIANCE": F.var_samp, "APPROX_COUNT_DISTINCT": F.approx_count_distinct,
}


def aggregate(name: str, c: str | Column) -> Column:
    """An aggregate by name of a column or expression; only COUNT takes ``*``."""
    kind = name.upper()
    if kind not in AGGREGATES:
        raise ValueError(f"unknown aggregate {name}")
    if isinstance(c, str) and c == "*":
        if kind != "COUNT":
            raise ValueError(f"{name} does not take *")
        return F.count(F.lit(1))
    return AGGREGATES[kind](F.col(c) if isinstance(c, str) else c)


def grouped(df: DataFrame, keys: list[str], columns: dict[str, Column], having: Column | Callable[[dict[str, Column]], Column] | None = None, hidden: dict[str, Column] | None = None, after: Column | None = None) -> DataFrame:
    """Group, keep groups by ``having``, and filter the result by ``after``.

    ``columns`` are aggregates or arithmetic of aggregates, by name. ``having`` may use them and the ``hidden``
    aggregates, which do not appear in the result. Without keys there is one group, also of an empty table.
    """
    both = {**columns, **(hidden or {})}
    try:
        out = df.groupBy(*keys).agg(*(c.alias(n) for n, c in both.items()))
        plan = out._jdf.queryExecution().analyzed()
    except AnalysisException as e:
        raise ValueError(f"no aggregate: {e}") from e
    # Window calls stand above the grouping in the plan, whatever columns and literals are called.
    while plan.nodeName() != "Aggregate":
        if plan.nodeName() == "Window":
            raise ValueError("a window call is no aggregate")
        plan = plan.children().head()
    if having is not None:
        out = out.where(having({n: F.col(n) for n in both}) if callable(having) and not isinstance(having, Column) else having)
    out = out.select(*keys, *columns)
    return out if after is None else out.where(after)


#: New columns that a pivot finds by itself.
PIVOT_NAMES = 1000


def span(c: str, temporal: bool = False) -> Column:
    """MAX - MIN; of dates in whole days."""
    return F.datediff(F.max(c), F.min(c)).cast("long") if temporal else F.max(c) - F.min(c)


def pivoted(df: DataFrame, row: str, column: str, value: str, names: list | None = None, aggregator: str = "MIN", fill: str | int | None = None) -> DataFrame:
    """Long to wide: one column for each of ``names``, the aggregate of ``value``.

    Given names make one pass do. Without them a pass finds the values of ``column``, nulls aside; more than PIVOT_NAMES are
    an error, and no more than that reach the driver. ``fill`` stands for missing values of the new
    columns; for number columns it is used if it is a whole number.
    """
    if aggregator.upper() == "COUNT_DISTINCT":
        raise ValueError("COUNT_DISTINCT is no pivot aggregate")
    if names is None:
        names = sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(PIVOT_NAMES + 1).collect())
        if len(names) > PIVOT_NAMES:
            raise ValueError(f"{column} has more than {PIVOT_NAMES} values")
    out = df.groupBy(row).pivot(column, names).agg(aggregate(aggregator, value))
    if fill is None:
        return out
    new = [f for f in out.schema.fields if f.name != row]
    numbers = [f.name for f in new if isinstance(f.dataType, NumericType)]
    texts = [f.name for f in new if f.name not in numbers]
    try:
        out = out.fillna(int(fill), numbers) if numbers else out
    except ValueError:
        pass
    return out.fillna(str(fill), texts) if texts else out
