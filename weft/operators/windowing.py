"""Window columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scans
from .shaping import order_keys

_RANKS = {"ROW_NUMBER": F.row_number, "RANK": F.rank, "DENSE_RANK": F.dense_rank, "PERCENT_RANK": F.percent_rank}
_SHIFTS = {"LAG": F.lag, "LEAD": F.lead}
_AGGREGATES = {"SUM": F.sum, "AVG": F.avg, "COUNT": F.count, "MIN": F.min, "MAX": F.max, "STDDEV": F.stddev_samp, "STD": F.stddev_samp, "VARIANCE": F.var_samp, "VAR": F.var_samp, "BIT_XOR": F.bit_xor}
UNBOUNDED = "unbounded"


@dataclass(frozen=True)
class WindowColumn:
    """A window function by name with its partition, order and rows frame.

    ``c``: a column name or an expression. Frames: without bounds the whole partition; with one bound the other is
    unbounded; ranks, LAG and LEAD take none; a negative bound lies on the other side of the row. A window without partition
    keys, or with ``split`` (for keys of which one may have very many rows), is cut by its order and runs in many tasks, see
    :mod:`scans`; ``whole_table`` says that the table is small enough for one task.
    """

    name: str
    function: str
    partition: tuple[str, ...] = ()
    order: tuple[tuple[str, str], ...] = ()
    c: str | Column | None = None
    offset: int = 1
    preceding: int | str | None = None
    following: int | str | None = None
    whole_table: bool = False
    split: bool = False

    def checked(self) -> WindowColumn:
        kind = self.function.upper()
        if kind not in (*_RANKS, *_SHIFTS, *_AGGREGATES, "FIRST", "LAST"):
            raise ValueError(f"unknown window function {self.function}")
        if not self.order and (kind in _SHIFTS or (kind in _RANKS and kind != "ROW_NUMBER")):
            raise ValueError(f"{kind} needs an order")
        if self.c is None and kind not in (*_RANKS, *_SHIFTS, "COUNT"):
            raise ValueError(f"{kind} needs a column")
        return self

    def distributed(self) -> bool:
        return self.split or not (self.partition or self.whole_table)

    def plain_total(self) -> bool:
        """Whether this is one value for the whole table."""
        return not (self.partition or self.order) and self.distributed() and self.bounds() == (None, None) and self.function.upper() in _AGGREGATES

    def value_name(self, df: DataFrame) -> str | None:
        """The name of the column that the function is of: for LAG and LEAD the first order column, for COUNT the table's
        first, if none is given. None for an expression."""
        c = self.c if self.c is not None else self.order[0][0] if self.function.upper() in _SHIFTS else df.columns[0]
        return c if isinstance(c, str) else None

    def value(self, df: DataFrame) -> Column:
        name = self.value_name(df)
        return self.c if name is None else F.col(name)

    def bounds(self) -> tuple[int | None, int | None]:
        """First and last row of the frame, from the row itself; None: no bound."""
        return tuple(None if n is None or n == UNBOUNDED else sign * int(n) for n, sign in ((self.preceding, -1), (self.following, 1)))

    def reach(self, df: DataFrame) -> tuple[int, int]:
        """How many rows before and after a row the function looks at one by one."""
        kind = self.function.upper()
        if kind in _RANKS:
            return 0, 0
        if kind in _SHIFTS:
            n = self.offset if kind == "LAG" else -self.offset
            return max(0, n), max(0, -n)
        a, b = self.bounds()
        if a is None or b is None:
            return max(0, -(a or 0)), max(0, b or 0)
        return max(0, -a), max(0, b)

    def plain(self, df: DataFrame) -> Column:
        """The function without a window, for its type."""
        kind = self.function.upper()
        return self.value(df) if kind in ("FIRST", "LAST") else _AGGREGATES[kind](self.value(df))

    def column(self, df: DataFrame) -> Column:
        kind = self.checked().function.upper()
        w = Window.partitionBy(*self.partition)
        if self.order:
            w = w.orderBy(*order_keys(list(self.order)))
        if kind in _RANKS:
            return _RANKS[kind]().over(w if self.order else w.orderBy(F.lit(1)))
        c = self.value(df)
        if kind in _SHIFTS:
            return _SHIFTS[kind](c, self.offset).over(w)
        a, b = self.bounds()
        w = w.rowsBetween(Window.unboundedPreceding if a is None else a, Window.unboundedFollowing if b is None else b)
        if kind in ("FIRST", "LAST"):
            return (F.first if kind == "FIRST" else F.last)(c, ignorenulls=True).over(w)
        return _AGGREGATES[kind](c).over(w)


def running(name: str, function: str, c: str | Column, order: tuple[tuple[str, str], ...], partition: tuple[str, ...] = (), split: bool = False) -> WindowColumn:
    """CUMSUM, CUMMEAN, CUMMIN or CUMMAX, from the first row to this one, over a partition or the whole table."""
    kinds = {"CUMSUM": "SUM", "CUMMEAN": "AVG", "CUMMIN": "MIN", "CUMMAX": "MAX"}
    if function.upper() not in kinds:
        raise ValueError(f"unknown running function {function}")
    return WindowColumn(name, kinds[function.upper()], partition, order, c, preceding=UNBOUNDED, following=0, split=split)


def with_windows(df: DataFrame, columns: list[WindowColumn], ordered: bool = False) -> DataFrame:
    """Add window columns in order; ``ordered`` sorts the result by the last one's order.

    Distributed columns that follow one another with the same partition and order share one scan. A whole-table aggregate
    without order and frame is taken from the scan of the whole table that it follows, else it is one row that is joined.
    """
    at = 0
    while at < len(columns):
        w = columns[at].checked()
        if not w.distributed():
            df, at = df.withColumn(w.name, w.column(df)), at + 1
            continue
        if w.plain_total():
            df, at = df.drop(w.name).crossJoin(F.broadcast(df.agg(w.plain(df).alias(w.name)))), at + 1
            continue
        end, names = at + 1, {w.name}
        while end < len(columns) and _together(df, w, columns[end], names):
            names.add(columns[end].checked().name)
            end += 1
        df, at = scans.distributed(df, columns[at:end]), end
    return df.orderBy(*order_keys(list(columns[-1].order))) if ordered and columns and columns[-1].order else df


def _together(df: DataFrame, w: WindowColumn, x: WindowColumn, names: set[str]) -> bool:
    # A name within the text of an expression may be no column of it; then it gets a scan of its own all the same.
    uses = x.name in names or (any(n in str(x.c) for n in names) if isinstance(x.c, Column) else x.value_name(df) in names)
    return x.distributed() and ((w.partition, w.order) == (x.partition, x.order) or (x.plain_total() and not w.partition)) and not uses
