"""Type-2 history: every version of every key, with the time from and to which it held."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.shared import kept

from .upkeep import Table

ADDED = ("scd_id", "scd_updated_at", "scd_valid_from", "scd_valid_to")


@dataclass(frozen=True)
class History:
    """``keys`` name a row; a change shows by a later ``updated_at``, or by any of ``check`` columns.

    ``close_missing`` closes versions whose key has left the source.
    """

    keys: tuple[str, ...]
    updated_at: str | None = None
    check: tuple[str, ...] = ()
    close_missing: bool = False

    def checked(self, source: DataFrame) -> History:
        if not self.keys or bool(self.updated_at) == bool(self.check):
            raise ValueError("a history needs keys and either updated_at or check columns")
        for c in (*self.keys, *self.check, *([self.updated_at] if self.updated_at else [])):
            if c not in source.columns or c in ADDED:
                raise ValueError(f"no such source column: {c}")
        return self


def _time(h: History, now: Any) -> Column:
    return F.col(h.updated_at) if h.updated_at else F.lit(now).cast("timestamp")


def version_id(h: History, time: Column) -> Column:
    """md5 of the keys and the time as text; a null is empty."""
    return F.md5(F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in h.keys), F.coalesce(time.cast("string"), F.lit(""))))


def first(source: DataFrame, h: History, now: Any) -> DataFrame:
    """The first snapshot: every row is an open version. A repeated key is an error; null keys are equal to one another."""
    h.checked(source)
    if not source.groupBy(*h.keys).count().where("count > 1").isEmpty():
        raise ValueError("repeated keys in the source")
    t = _time(h, now)
    return source.withColumns({"scd_id": version_id(h, t), "scd_updated_at": t, "scd_valid_from": t, "scd_valid_to": F.lit(None).cast("timestamp")})


def _by_keys(df: DataFrame, h: History) -> list[Column]:
    return [F.col(k).alias(f"_k{i}") for i, k in enumerate(h.keys)]


def _same(h: History) -> Column:
    """Equal keys of a row and one from :func:`_by_keys`; nulls are equal."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(h.keys)])


def _coming(open_: DataFrame, source: DataFrame, h: History, now: Any) -> DataFrame:
    """New open versions: of keys that have none, and of rows that have changed."""
    new = first(source, h, now)
    was = open_.select(*_by_keys(open_, h), F.col("scd_valid_from").alias("_from"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(h.check) if c in open_.columns), F.lit(True).alias("_known"))
    if h.updated_at:
        change = F.col("_from") < F.col(h.updated_at)
    else:
        tests = [~F.col(c).eqNullSafe(F.col(f"_c{i}")) if c in open_.columns else F.col(c).isNotNull() for i, c in enumerate(h.check)]
        change = reduce(lambda a, b: a | b, tests)
    return new.join(was, _same(h), "left").where(F.col("_known").isNull() | change).select(new.columns)


def advanced(snapshot: DataFrame, source: DataFrame, h: History, now: Any) -> DataFrame:
    """The snapshot after another look at the source.

    New keys and changed rows come as open versions; the version before a change is closed at the new one's time. Closed
    versions stay as they are. Source columns that are new are null in older versions; columns that the source has lost
    are null in newer ones. Null keys are equal to one another. A key that the source repeats is an error.
    """
    open_, closed = snapshot.where("scd_valid_to IS NULL"), snapshot.where("scd_valid_to IS NOT NULL")
    coming = _coming(open_, source, h, now)
    ends = coming.select(*_by_keys(coming, h), F.col("scd_valid_from").cast("timestamp").alias("_end"))
    then = open_.join(ends, _same(h), "left").withColumn("scd_valid_to", F.col("_end")).select(snapshot.columns)
    if h.close_missing:
        there = source.select(*_by_keys(source, h), F.lit(True).alias("_there")).distinct()
        then = then.join(there, _same(h), "left").withColumn("scd_valid_to", F.when(F.col("_there").isNull() & F.col("scd_valid_to").isNull(), F.lit(now).cast("timestamp")).otherwise(F.col("scd_valid_to"))).select(snapshot.columns)
    return closed.unionByName(then).unionByName(coming, allowMissingColumns=True)


# Histories kept in a table. A run writes what has changed and nothing else: new versions, and for each version that it
# closes a row that says so (its keys, id and run, with the time). Both come in one append, so a run counts whole or not.

#: The run that made a version, and whether a row closes a version instead of being one.
RUN, END = "_run", "_end"


def _resolved(table: Table, closed: bool = True) -> DataFrame:
    rows = table.read()
    versions = rows.where(~F.col(END)).drop(END)
    ends = rows.where(END).select(F.col("scd_id").alias("_id"), F.col(RUN).alias("_made"), F.col("scd_valid_to").alias("_to"))
    own = (F.col("scd_id") == F.col("_id")) & (F.col(RUN) == F.col("_made"))
    if not closed:
        return versions.where("scd_valid_to IS NULL").join(ends, own, "left_anti")
    return versions.join(ends, own, "left").withColumn("scd_valid_to", F.coalesce("scd_valid_to", "_to")).drop("_id", "_made", "_to")


def stored(table: Table) -> DataFrame:
    """All versions of a stored history, closed ones with their end."""
    return _resolved(table).drop(RUN)


def advance_stored(table: Table, source: DataFrame, h: History, now: Any) -> DataFrame:
    """Another look at the source for a stored history (the first one makes it); returns all versions.

    Writes the new versions and the ends of old ones alone. It reads, of the open versions, keys, times and check columns.
    """
    number = table._version()[0] + 1
    if not table.exists():
        table.write(first(source, h, now).withColumns({RUN: F.lit(number).cast("long"), END: F.lit(False)}))
        return stored(table)
    open_ = _resolved(table, closed=False)
    coming = kept(_coming(open_, source, h, now).withColumns({RUN: F.lit(number).cast("long"), END: F.lit(False)}))
    ends = coming.select(*_by_keys(coming, h), F.col("scd_valid_from").cast("timestamp").alias("_to"))
    if h.close_missing:
        there = source.select(*_by_keys(source, h))
        ends = ends.unionByName(open_.join(there, _same(h), "left_anti").select(*_by_keys(open_, h), F.lit(now).cast("timestamp").alias("_to")))
    over = open_.join(ends, _same(h)).select(*h.keys, "scd_id", RUN, F.col("_to").alias("scd_valid_to"), F.lit(True).alias(END))
    rows = coming.unionByName(over, allowMissingColumns=True)
    # Nothing new is no version. Both sides read folders that an append leaves alone.
    if not rows.isEmpty():
        table.write(rows, keep=True)
    return stored(table)


def settle(table: Table) -> DataFrame:
    """Write a stored history anew with the ends in their versions, so that later runs have fewer rows to join."""
    table.write(_resolved(table).withColumn(END, F.lit(False)))
    return stored(table)
