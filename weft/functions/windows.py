"""Window formulas (F6). An order is always asked for, and frames are explicit; nulls come last.

``keys`` part the table. Without keys Spark would send the table to one task, so a key is required.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def window(keys: list[str], order: list[str | Column]) -> WindowSpec:
    if not keys or not order:
        raise ValueError("a window formula needs keys and an order")
    return Window.partitionBy(*keys).orderBy(*(F.col(o).asc_nulls_last() if isinstance(o, str) else o for o in order))


def _running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _whole(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def lag(c: str, w: WindowSpec, n: int = 1, default=None) -> Column:  # noqa: ANN001
    return F.lag(c, n, default).over(w)


def lead(c: str, w: WindowSpec, n: int = 1, default=None) -> Column:  # noqa: ANN001
    return F.lead(c, n, default).over(w)


def cumsum(c: str, w: WindowSpec) -> Column:
    return F.sum(c).over(_running(w))


def cummean(c: str, w: WindowSpec) -> Column:
    return F.avg(c).over(_running(w))


def cummin(c: str, w: WindowSpec) -> Column:
    return F.min(c).over(_running(w))


def cummax(c: str, w: WindowSpec) -> Column:
    return F.max(c).over(_running(w))


def first(c: Column, w: WindowSpec, text: bool = False) -> Column:
    """The first value that is not null (nor empty, for text)."""
    return F.first(F.nullif(c, F.lit("")) if text else c, ignorenulls=True).over(_whole(w))


def last(c: Column, w: WindowSpec, text: bool = False) -> Column:
    return F.last(F.nullif(c, F.lit("")) if text else c, ignorenulls=True).over(_whole(w))


def row_number(w: WindowSpec) -> Column:
    return F.row_number().over(w)


def rank(w: WindowSpec) -> Column:
    return F.rank().over(w)


def dense_rank(w: WindowSpec) -> Column:
    return F.dense_rank().over(w)


def percent_rank(w: WindowSpec) -> Column:
    return F.percent_rank().over(w)
