"""Joins whose criteria are comparisons alone: a value of one side within bounds that rows of the other side give.

The values of the one side are cut into bins at boundaries from a bounded sample, and bins of numbers and times into cells,
each level having cells of a quarter of the level above. A row with bounds takes the level at which it goes over a few cells,
and goes to each of them (rows open at one side: to each bin); a value has one cell at each level that its bin's rows take;
rows meet by cell, with all criteria tested. So the pairs that are tested are about as many as those that are found. A bin
with more than its share of the sampled values (a frequent value has a bin of its own) is dealt over several parts: its values
by a hash, and the rows with bounds to each of them. A cell whose pairs are too many for a task is dealt over several turns:
its rows with bounds by a hash, and its values to each. So the join is an equi-join that Spark shuffles, and a task holds about
one share of the values. It is never a broadcast: the estimate of a side's size does not know of its copies.

Rows with bounds that go to the same cells travel in blocks, and each value is paired with a block at a time. So the rows of a
block come again and again in the same order, beside one value after another: of a result that grows with the square, written
as Parquet, little more is left than its runs and repetitions.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.shared import kept

#: Bins, and sampled values of each; the driver sees their product.
BINS, SAMPLED = 64, 200
#: Levels below the bins, and the values that a cell of the last level has on average at least.
LEVELS, FEWEST = 10, 4
#: Rows with bounds in a block, pairs of a cell in one turn, and values that a task has on average at most: dictionaries of
#: Parquet hold 131,072 whole numbers.
BLOCK, PAIRS, VALUES = 128, 100_000_000, 50_000
#: Turns of a cell at most, as a power of 2.
TURNS = 20
LESS, MORE = ("LT", "LTE"), ("GT", "GTE")
_TURNED = {"LT": "GT", "LTE": "GTE", "GT": "LT", "GTE": "LTE"}
_PLACE = ("_level", "_cell", "_part")
Criterion = tuple[str, str, str]


@dataclass(frozen=True)
class Bounds:
    """Which side has the value (``left``: the left one), its column, and the other side's columns below and above it."""

    left: bool
    value: str
    low: str | None
    high: str | None


def bounds_of(on: list[Criterion]) -> list[Bounds]:
    """The values with a bound on both sides if the criteria have such, else those with a bound; none without a comparison."""
    found = []
    for left, own in ((True, on), (False, [(b, _TURNED.get(op, op), a) for a, op, b in on])):
        for value in dict.fromkeys(a for a, op, _ in own if op in _TURNED):
            low = next((b for a, op, b in own if a == value and op in MORE), None)
            high = next((b for a, op, b in own if a == value and op in LESS), None)
            found.append(Bounds(left, value, low, high))
    sides = [(b.low is not None) + (b.high is not None) for b in found]
    return [b for b, n in zip(found, sides, strict=True) if n == max(sides)]


class Slots:
    """Bins of a column's values and the slots that each bin is dealt over."""

    def __init__(self, values: list[Any], bins: int = BINS) -> None:
        """``values``: a sample."""
        values = sorted(values)
        self.cuts = sorted({values[i * len(values) // bins] for i in range(1, bins)}) if values else []
        # A value that fills whole bins ends its bin, so that its neighbours do not share it.
        inner = {values[bisect_right(values, c)] for c in self.cuts if values.count(c) * bins >= len(values) and bisect_right(values, c) < len(values)} if values else set()
        self.cuts = sorted({*self.cuts, *inner})
        sizes = [0] * (len(self.cuts) + 1)
        for v in values:
            sizes[bisect_right(self.cuts, v)] += 1
        self.slots = [max(1, round(n * bins / max(1, len(values)))) for n in sizes]

    def bin_of(self, c: Column) -> Column:
        """The number of a value's bin. As a function of an array: comparisons one within another become too much code."""
        return F.size(F.filter(F.array(*map(F.lit, self.cuts)), lambda cut: cut <= c)) if self.cuts else F.lit(0)

    def parts_of(self, number: Column) -> Column:
        """How many parts a bin has."""
        return F.element_at(F.array(*map(F.lit, self.slots)), number + 1)


@dataclass(frozen=True)
class Values:
    """What is known of a column of values: how many there are, the least and the largest, a sample (nulls and NaN aside),
    and whether the two bounds hold for all of them."""

    n: int
    least: Any
    most: Any
    sample: list[Any]
    exact: bool


def looked_at(df: DataFrame, column: str, bins: int = BINS) -> Values:
    """About SAMPLED values a bin of a column, and its bounds."""
    kind = df.schema[column].dataType.typeName()
    there = df.select(F.col(column).alias("v")).where(F.col("v").isNotNull())
    number = F.isnan("v") if kind in ("float", "double") else F.lit(False)
    v = F.when(~number, F.col("v"))
    n, least, most, odd = there.agg(F.count(v), F.min(v), F.max(v), F.count_if(number)).first()
    share = min(1.0, bins * SAMPLED / max(n, 1))
    there = there.where(~number)
    sample = [r[0] for r in (there if share == 1.0 else there.sample(share, 7)).collect()]
    # Times lose their zone on the way through Python.
    return Values(n, least, most, sample, n > 0 and not odd and not kind.startswith("timestamp"))


NUMBERS, TIMES = {"byte", "short", "integer", "long", "decimal", "float", "double"}, {"date", "timestamp", "timestamp_ntz"}


def _measure(kinds: set[str]) -> Callable[[Column], Column] | None:
    """Columns of these types as doubles in the order of their comparison, if there is such a measure."""
    if kinds <= NUMBERS - {"float"} or kinds == {"float"}:
        return lambda c: c.cast("double")
    if kinds == {"date"}:
        return lambda c: F.unix_date(c).cast("double")
    if kinds == {"timestamp"}:
        return lambda c: F.unix_micros(c).cast("double")
    return None


class Cells:
    """Where values and rows with bounds meet: columns ``_level``, ``_cell`` and ``_part``."""

    def __init__(self, seen: Values, measure: Callable[[Column], Column] | None, bins: int = BINS) -> None:
        self.seen, self.measure, self.slots = seen, measure, Slots(seen.sample, bins)
        self.last = 0
        while measure and self.last < LEVELS and seen.n >= FEWEST * bins * 4 ** (self.last + 1):
            self.last += 1

    def _at(self, c: Column, name: str) -> dict[str, Column]:
        """The bin of a value or bound, and which share of the bin is below it. Both grow with it."""
        found = {f"{name}_bin": self.slots.bin_of(c)}
        if self.last:
            edges = [self.seen.least, *self.slots.cuts, self.seen.most]
            at = F.element_at(F.array(*(self.measure(F.lit(e)) for e in edges)), F.col(f"{name}_bin") + 1)
            width = F.element_at(F.array(*(self.measure(F.lit(b)) - self.measure(F.lit(a)) for a, b in zip(edges, edges[1:], strict=False))), F.col(f"{name}_bin") + 1)
            share = F.when(width > 0, (self.measure(c) - at) / width).otherwise(0.0)
            # NaN is above every number for Spark, and so is the end of the last bin.
            found[f"{name}_share"] = F.greatest(F.lit(0.0), F.least(share, F.lit(1 - 2.0**-20)))
        return found

    def _cell(self, name: str, level: Column) -> Column:
        if not self.last:
            return F.col(f"{name}_bin").cast("long")
        cells = F.pow(F.lit(4.0), level)
        return (F.col(f"{name}_bin") * cells + F.floor(F.col(f"{name}_share") * cells)).cast("long")

    def _with(self, df: DataFrame, columns: dict[str, Column]) -> DataFrame:
        for name, c in columns.items():
            df = df.withColumn(name, c)
        return df

    def spans(self, df: DataFrame, low: Column | None, high: Column | None) -> DataFrame:
        """The level, and first and last cell, of values between two bounds; no row where a bound is null or no value can be."""
        there = [c.isNotNull() for c in (low, high) if c is not None]
        if self.seen.exact:
            there += [b for b in (low is not None and low <= F.lit(self.seen.most), high is not None and high >= F.lit(self.seen.least)) if b is not False]
        df = df.where(reduce(lambda x, y: x & y, there))
        last = len(self.slots.slots) - 1
        df = self._with(df, self._at(low, "_a") if low is not None else {"_a_bin": F.lit(0), "_a_share": F.lit(0.0)})
        df = self._with(df, self._at(high, "_b") if high is not None else {"_b_bin": F.lit(last), "_b_share": F.lit(1 - 2.0**-20)})
        level = F.lit(0)
        if self.last:
            over = F.col("_b_bin") + F.col("_b_share") - F.col("_a_bin") - F.col("_a_share")
            level = F.greatest(F.lit(0), F.least(F.lit(self.last), F.floor(1 - F.log(4.0, F.greatest(over, F.lit(4.0**-LEVELS)))).cast("int")))
        df = df.withColumn("_level", level).withColumn("_a", self._cell("_a", F.col("_level"))).withColumn("_b", self._cell("_b", F.col("_level")))
        return df.where("_a <= _b").drop("_a_bin", "_a_share", "_b_bin", "_b_share")

    def blocks(self, spans: DataFrame, order: list[str]) -> DataFrame:
        """Rows of :meth:`spans` that go to the same cells, as arrays ``_rows`` of BLOCK rows at most, so that those that a value
        matches stand together. Written, or Spark would work the same out anew for each use of it."""
        place, rows = ["_level", "_a", "_b"], [c for c in spans.columns if c not in ("_level", "_a", "_b")]
        dealt = spans.withColumn("_deal", F.xxhash64(*_hashed(spans))).repartitionByRange(*place, "_deal").sortWithinPartitions(*place, *order, "_deal")
        dealt = dealt.withColumn("_block", F.shiftright(F.monotonically_increasing_id(), BLOCK.bit_length() - 1))
        return kept(dealt.groupBy(*place, "_block").agg(F.collect_list(F.struct(*rows)).alias("_rows")))

    def taken(self, spans: DataFrame) -> dict[int, list[int]]:
        """The levels that rows of :meth:`spans` or :meth:`blocks` take in each bin."""
        found: dict[int, list[int]] = {}
        for number, level in spans.select(F.explode(F.sequence(self._own("_a"), self._own("_b"))), "_level").distinct().collect():
            found.setdefault(number, []).append(level)
        return found

    def turns(self, blocks: DataFrame) -> DataFrame:
        """The cells of more than PAIRS pairs, by the average of values in a cell, and the turns they are dealt over."""
        values = self.seen.n / len(self.slots.slots) / F.when(self.slots.parts_of(self._own("_cell")) > 1, 1.0).otherwise(F.pow(F.lit(4.0), F.col("_level")))
        met = blocks.select("_level", F.explode(F.sequence("_a", "_b")).alias("_cell"), F.size("_rows").alias("n")).groupBy("_level", "_cell").agg(F.sum("n").alias("n"))
        return kept(met.select("_level", "_cell", F.least(F.ceil(F.col("n") * values / PAIRS), F.lit(2**TURNS)).cast("int").alias("_turns")).where("_turns > 1"))

    def _own(self, cell: str) -> Column:
        """The bin of a cell."""
        return F.floor(F.col(cell) / F.pow(F.lit(4.0), F.col("_level"))).cast("int")

    def copied(self, df: DataFrame) -> DataFrame:
        """A row of :meth:`spans` or :meth:`blocks` for each of its places."""
        df = df.withColumn("_cell", F.explode(F.sequence("_a", "_b")))
        if max(self.slots.slots) == 1:
            df = df.withColumn("_part", F.lit(0))
        else:
            df = df.withColumn("_part", F.explode(F.sequence(F.lit(0), self.slots.parts_of(self._own("_cell")) - 1)))
        return df.drop("_a", "_b")

    def placed(self, df: DataFrame, c: Column, salt: Column) -> DataFrame:
        """Values with bin, share and part."""
        df = self._with(df, self._at(c, "_v"))
        part = F.pmod(salt, self.slots.parts_of(F.col("_v_bin"))).cast("int") if max(self.slots.slots) > 1 else F.lit(0)
        return df.withColumn("_part", F.when(c.isNotNull(), part))

    def leveled(self, df: DataFrame, c: Column, levels: list[int] | dict[int, list[int]]) -> DataFrame:
        """A row of :meth:`placed` for each level: those of its bin, or the same for all, which nulls have too."""
        if isinstance(levels, dict):
            by_bin = F.array(*(F.array(*map(F.lit, sorted(levels.get(i, [])))).cast("array<int>") for i in range(len(self.slots.slots))))
            df = df.where(c.isNotNull()).withColumn("_level", F.explode(F.element_at(by_bin, F.col("_v_bin") + 1)))
        else:
            df = df.withColumn("_level", F.explode(F.array(*map(F.lit, levels)))) if len(levels) > 1 else df.withColumn("_level", F.lit(levels[0] if levels else 0))
        return df.withColumn("_cell", F.when(c.isNotNull(), self._cell("_v", F.col("_level")))).drop("_v_bin", "_v_share")

    def values(self, df: DataFrame, c: Column, salt: Column, levels: list[int]) -> DataFrame:
        """A row for each level of a value; one of null places for a null."""
        return self.leveled(self.placed(df, c, salt), c, levels)


def _hashed(df: DataFrame) -> list[str]:
    """The columns that Spark hashes."""
    return [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]


def _met(cells: Cells, blocks: DataFrame, values: DataFrame) -> DataFrame:
    """Values beside the rows of the blocks that come to their places."""
    blocks, turns = cells.copied(blocks), cells.turns(blocks)
    if turns.isEmpty():
        blocks, values = (d.withColumn("_turn", F.lit(0)) for d in (blocks, values))
    else:
        blocks, values = (d.join(F.broadcast(turns), ["_level", "_cell"], "left").withColumn("_turns", F.coalesce("_turns", F.lit(1))) for d in (blocks, values))
        blocks, values = blocks.withColumn("_turn", F.pmod("_block", "_turns").cast("int")), values.withColumn("_turn", F.explode(F.sequence(F.lit(0), F.col("_turns") - 1)))
    blocks, values = (d.withColumn("_place", _packed()).drop(*_PLACE, "_turn", "_turns") for d in (blocks, values))
    # By number, as what is shuffled says little of the size of the result, by which Spark would put tasks together.
    tasks = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-cells.seen.n // VALUES))
    met = blocks.select("_place", "_rows").repartition(tasks, "_place").hint("merge").join(values.repartition(tasks, "_place").hint("merge"), "_place")
    return met.select(*(c for c in values.columns if c != "_place"), F.inline("_rows"))


def _packed() -> Column:
    """Cell (LEVELS levels of a few bins), level, part and turn as one number."""
    return F.shiftleft(F.shiftleft(F.shiftleft(F.col("_cell"), 4).bitwiseOR(F.col("_level")), 8).bitwiseOR(F.col("_part")), TURNS).bitwiseOR(F.col("_turn"))


def _same(places: tuple[str, ...]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(c) == F.col(f"_at{c}") for c in places])


def _unmatched(side: DataFrame, column: str, other: DataFrame, extreme: Column, test: Callable[[], Column]) -> DataFrame:
    """The rows that match no row of the other side, by a single comparison with the ``extreme`` of its ``column``."""
    return side.withColumn(column, other.select(extreme).scalar()).where(~F.coalesce(test(), F.lit(False))).select(*side.columns)


def range_join(left: DataFrame, right: DataFrame, on: list[Criterion], kind: str, test: Callable[[], Column], bins: int = BINS) -> DataFrame:
    """The join of two tables without a column name in common, with all columns of both; ``test``: all criteria.

    Where either side could have the values, it is the one with more of them, since the other side's rows are copied. In
    outer joins by one comparison the rows that nothing matches are those that the other side's largest or least does not
    match; in others they are found by a number that they are written with.
    """
    seen = [(b, looked_at(left if b.left else right, b.value, bins)) for b in {b.left: b for b in reversed(bounds_of(on))}.values()]
    b, known = max(seen, key=lambda x: (x[1].n, x[0].left))
    values, ranges = (left, right) if b.left else (right, left)
    keep_values, keep_ranges = kind in ("full", "left" if b.left else "right"), kind in ("full", "right" if b.left else "left")
    kinds = {values.schema[b.value].dataType.typeName(), *(ranges.schema[c].dataType.typeName() for c in (b.low, b.high) if c)}
    if not (len(kinds) == 1 or kinds <= NUMBERS or kinds <= TIMES):
        # Texts beside numbers are compared as numbers, and so have no order of their own.
        return left.join(right, test(), kind)
    cells = Cells(known, _measure(kinds) if b.low and b.high else None, bins)
    columns, bound, rest, numbered = [*left.columns, *right.columns], b.low or b.high, [], (keep_values or keep_ranges) and len(on) > 1
    if numbered:
        ranges, values = (kept(d.withColumn(n, F.monotonically_increasing_id())) for d, n in ((ranges, "_row"), (values, "_row_v")))
    else:
        least, most = (F.min, F.max) if b.low else (F.max, F.min)
        rest += [_unmatched(values, bound, ranges, least(bound), test)] if keep_values else []
        rest += [_unmatched(ranges, b.value, values, most(b.value), test)] if keep_ranges else []
    blocks = cells.blocks(cells.spans(ranges, *(F.col(c) if c else None for c in (b.low, b.high))), [c for c in (b.low, b.high) if c])
    one = cells.placed(values, F.col(b.value), F.xxhash64(*_hashed(values)))
    one = cells.leveled(kept(one) if numbered else one, F.col(b.value), cells.taken(blocks))
    out = _met(cells, blocks, one).where(test()).select(*columns)
    if numbered:
        many, one = cells.copied(blocks.select("_level", "_a", "_b", F.inline("_rows"))), one.withColumnsRenamed({c: f"_at{c}" for c in _PLACE})
        for keep, d, x, y, row in ((keep_ranges, ranges, many, one, "_row"), (keep_values, values, one, many, "_row_v")):
            if keep:
                found = x.hint("merge").join(y.hint("merge"), _same(_PLACE) & test(), "left_semi").select(row).distinct()
                rest.append(d.join(found.hint("merge"), row, "left_anti").drop("_row", "_row_v"))
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), rest, out)
