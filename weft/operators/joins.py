"""Joins: right tables are tied one after another to what has been joined so far."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import bounds_of, range_join

KINDS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "cross": "cross"}
#: Rows of a side that all rows of the other side are tested with.
FEW = 1000
_COMPARE = {"EQ": "__eq__", "NEQ": "__ne__", "LT": "__lt__", "LTE": "__le__", "GT": "__gt__", "GTE": "__ge__"}


@dataclass(frozen=True)
class Right:
    """A right table with its name, the kind of join and (left column, operator, right column) criteria, all ANDed."""

    table: DataFrame
    name: str
    kind: str = "inner"
    on: tuple[tuple[str, str, str], ...] = ()


def join(left: DataFrame, *rights: Right) -> DataFrame:
    """Joined columns: all of the left, then the right's.

    A right column whose name is taken becomes ``{name}_{column}``; an inner join's right key that equals a left key of
    the same name is dropped. The same table may come again under another name. Left columns are those of the table
    joined so far. Unknown kinds are an error; a join without criteria must be a cross join. A join by comparisons alone
    is cut into ranges, see :mod:`ranges`, unless a side that Spark may send to every task is known to be small.
    """
    for r in rights:
        if r.kind not in KINDS:
            raise ValueError(f"unknown join {r.kind}")
        if bool(r.on) == (r.kind == "cross"):
            raise ValueError("criteria are for all joins but the cross join")
        taken = set(left.columns)
        names = {c: f"{r.name}_{c}" if c in taken else c for c in r.table.columns}
        hidden = {c: f"__{r.name}__{c}" for c in r.table.columns}
        right = r.table.select(*(F.col(c).alias(hidden[c]) for c in r.table.columns))
        on = [(a, op, hidden[b]) for a, op, b in r.on]
        if on and not any(op == "EQ" for _, op, _ in on) and bounds_of(on) and not _small(left, right, r.kind):
            joined = range_join(left, right, on, KINDS[r.kind], lambda on=on: _all(F.col, F.col, on))
        else:
            joined = left.join(right, _all(left.__getitem__, right.__getitem__, on), KINDS[r.kind]) if on else left.crossJoin(right)
        same = {b for a, op, b in r.on if op == "EQ" and a == b and r.kind == "inner"}
        left = joined.select(*left.columns, *(F.col(hidden[c]).alias(names[c]) for c in r.table.columns if c not in same))
    return left


def _all(left, right, on) -> Column:  # noqa: ANN001
    return reduce(lambda x, y: x & y, [getattr(left(a), _COMPARE[op])(right(b)) for a, op, b in on])


def _small(left: DataFrame, right: DataFrame, kind: str) -> bool:
    """Whether a side that may be broadcast is known to have few rows: each row of the other side is tested with all of them.
    They are counted where Spark's own estimate is one that it broadcasts."""
    most = left.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    sides = [d for d, outer in ((right, ("right", "full")), (left, ("left", "full"))) if kind not in outer]
    return any(int(str(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most and d.limit(FEW + 1).count() <= FEW for d in sides)
