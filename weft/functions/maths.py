"""Mathematics (F3)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add, mul

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, IntegralType

from weft.shared import kept

from .base import Value, col, whole

abs_, acos, asin, atan, atan2 = F.abs, F.acos, F.asin, F.atan, F.atan2
ceiling, cos, cot, degrees, exp, floor = F.ceil, F.cos, F.cot, F.degrees, F.exp, F.floor
ln, log10, log2, radians, sign, sin, sqrt, tan = F.ln, F.log10, F.log2, F.radians, F.signum, F.sin, F.sqrt, F.tan
pi, e, greatest, least = F.pi, F.e, F.greatest, F.least


def bitand(a: Column, b: Value) -> Column:
    return a.bitwiseAND(col(b))


def bitor(a: Column, b: Value) -> Column:
    return a.bitwiseOR(col(b))


def bitxor(a: Column, b: Value) -> Column:
    return a.bitwiseXOR(col(b))


def bitlshift(a: Column, n: Value) -> Column:
    """``a`` times 2 to the n; exact for whole numbers, and an error beyond 64 bits."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), col(n).cast("int"))
    return F.when(whole(a, n) & col(n).between(0, 62), a.cast("long") * one).otherwise((a * F.pow(F.lit(2.0), col(n))).cast("long"))


def bitrshift(a: Column, n: Value) -> Column:
    """The whole part, downward, of ``a`` by 2 to the n; exact for whole numbers."""
    shifted = F.call_function("shiftright", a.cast("long"), col(n).cast("int"))
    return F.when(whole(a, n) & col(n).between(0, 63), shifted).otherwise(F.floor(a / F.pow(F.lit(2.0), col(n))).cast("long"))


def delta(a: Column, b: Value) -> Column:
    """1 if equal, else 0; a null equals nothing."""
    return F.when(a == col(b), 1).otherwise(0)


def even(x: Column) -> Column:
    """Up to a whole number, then on to an even one. The remainder has the sign of x, so -3 becomes -2."""
    up = F.ceil(x)
    return F.when(up >= 0, up + up % 2).otherwise(up - up % 2)


def odd(x: Column) -> Column:
    """Up to a whole number, then on to an odd one. The remainder has the sign of x, so -3 becomes -5."""
    up = F.ceil(x)
    return F.when(up >= 0, up + (1 - up % 2)).otherwise(up - (1 - up % 2))


def int_(x: Column) -> Column:
    """Whole part, toward zero."""
    return x.cast("long")


def log(x: Column, base: Value = 10) -> Column:
    return F.ln(x) / F.ln(col(base).cast("double"))


def mod(a: Column, b: Value) -> Column:
    return a % F.nullif(col(b), F.lit(0))


modulus = mod


def power(a: Column, b: Value) -> Column:
    return F.pow(a, col(b))


def product(*xs: Value) -> Column:
    return reduce(mul, map(col, xs))


def quotient(a: Column, b: Value) -> Column:
    """The quotient rounded down; exact for whole numbers, null for a divisor of 0."""
    b = F.nullif(col(b), F.lit(0))
    x, y = F.when(b < 0, -a.cast("long")).otherwise(a.cast("long")), F.abs(b.cast("long"))
    return F.when(whole(a, b), F.call_function("div", x - F.pmod(x, y), y)).otherwise(F.floor(a / b))


def round_(x: Column, n: Value) -> Column:
    """Rounded as a double; n null is 0, and is held to -15 .. 15. n may be an expression."""
    x = x.cast("double")
    if not isinstance(n, Column):
        return F.round(x, max(-15, min(15, int(n or 0))))
    places = F.least(F.greatest(F.coalesce(n.cast("int"), F.lit(0)), F.lit(-15)), F.lit(15))
    return reduce(lambda rest, k: F.when(places == k, F.round(x, k)).otherwise(rest), range(-15, 16), F.lit(None).cast("double"))


def rounddown(x: Column, n: int = 0) -> Column:
    return F.floor(x * 10.0**n) / 10.0**n


def roundup(x: Column, n: int = 0) -> Column:
    return F.ceil(x * 10.0**n) / 10.0**n


def trunc(x: Column, n: int = 0) -> Column:
    y = x * 10.0**n
    return F.when(x < 0, F.ceil(y)).otherwise(F.floor(y)) / 10.0**n


def sqrtpi(x: Column) -> Column:
    """The root of x, times pi."""
    return F.sqrt(x) * F.pi()


def sum_(*xs: Value) -> Column:
    """Across the arguments; null if any is."""
    return reduce(add, map(col, xs))


def sumsq(a: Value, *xs: Value) -> Column:
    """The first argument as it is, plus the squares of the others."""
    return reduce(add, [col(a), *(F.pow(col(x), F.lit(2.0)) for x in xs)])


def average(*xs: Value) -> Column:
    return sum_(*xs) / F.lit(float(len(xs)))


def difference(a: Column, b: Column, kind: str = "number") -> Column:
    """``kind``: "number", "timestamp" (days with fractions) or "date" (whole days)."""
    if kind == "timestamp":
        return (F.unix_timestamp(a.cast("timestamp")) - F.unix_timestamp(b.cast("timestamp"))) / F.lit(86400.0)
    return F.datediff(a, b).cast("long") if kind == "date" else a - b


def clip(x: Column, low: Value, high: Value) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, col(low)), col(high)))


def negate(x: Column) -> Column:
    return -x


def random(seed: int | None = None) -> Column:
    return F.rand(seed)


# Statistics of a whole column on every row. Any number of them costs one aggregate and the join of its single row; all
# quantiles together take another pass.

#: The type in which whole numbers and decimals are ordered.
EXACT = "decimal(38,18)"


@dataclass(frozen=True)
class Quantile:
    """The value below which a share ``q`` of a column lies, between two values by linear interpolation."""

    c: str
    q: float


def max_of(c: str) -> Column:
    return F.max(c)


def min_of(c: str) -> Column:
    return F.min(c)


def median(c: str) -> Quantile:
    return Quantile(c, 0.5)


def quantile(c: str, q: float) -> Quantile:
    return Quantile(c, q)


def variance(c: str) -> Column:
    return F.var_samp(c)


def stddev(c: str) -> Column:
    return F.stddev_samp(c)


def cov(a: str, b: str) -> Column:
    return F.covar_samp(a, b)


def _exact(kind: DataType) -> bool:
    """Whether EXACT holds every value of the type."""
    return isinstance(kind, IntegralType) or (isinstance(kind, DecimalType) and kind.scale <= 18 and kind.precision - kind.scale <= 20)


def _quantile_row(df: DataFrame, wanted: dict[str, Quantile]) -> DataFrame:
    """One row with exact quantiles, by name; null without values. NaN counts as the greatest value.

    All columns are one list of (column, value) whose repeats are counted. The counts are range-partitioned and written once,
    and ranks are running sums inside a partition after the totals of those before, so no task holds a column. Whole numbers
    and decimals are ordered as decimals, so values that one double stands for stay apart.
    """
    columns = list(dict.fromkeys(w.c for w in wanted.values()))
    exact = {c: _exact(df.schema[c].dataType) for c in columns}
    values = [F.struct(F.lit(i).alias("i"), (F.col(c) if exact[c] else F.lit(None)).cast(EXACT).alias("x"), (F.lit(None) if exact[c] else F.col(c)).cast("double").alias("d")) for i, c in enumerate(columns)]
    each = df.select(F.explode(F.array(*values)).alias("v")).select("v.*").where("x IS NOT NULL OR d IS NOT NULL")
    counts = each.groupBy("i", "x", "d").agg(F.count(F.lit(1)).alias("n"))
    # Another evaluation may cut the ranges elsewhere, so the partitions are kept by value.
    part = kept(counts.repartitionByRange("i", "x", "d").select("i", "x", "d", "n", F.spark_partition_id().alias("p")))
    totals = part.groupBy("i", "p").agg(F.sum("n").alias("t"))
    before = totals.select("i", "p", (F.sum("t").over(Window.partitionBy("i").orderBy("p")) - F.col("t")).alias("before"), F.sum("t").over(Window.partitionBy("i")).alias("all"))
    upto = F.sum("n").over(Window.partitionBy("i", "p").orderBy("x", "d"))
    ranked = part.join(F.broadcast(before), ["i", "p"]).select("i", "x", "d", "all", (F.col("before") + upto).alias("last"), (F.col("before") + upto - F.col("n")).alias("first"))
    picked, made = {}, {}
    for name, w in wanted.items():
        own, v = F.col("i") == columns.index(w.c), "x" if exact[w.c] else "d"
        at = F.lit(w.q) * (F.col("all") - 1)
        holds = lambda k, own=own, v=v: F.max(F.when(own & (F.col("first") <= k) & (k < F.col("last")), F.col(v)))
        picked |= {f"{name}_lo": holds(F.floor(at)), f"{name}_hi": holds(F.ceil(at)), f"{name}_part": F.max(F.when(own, at - F.floor(at)))}
        lo, hi, share = (F.col(f"{name}_{k}") for k in ("lo", "hi", "part"))
        made[name] = lo.cast("double") + F.when(share > 0, (hi - lo).cast("double") * share).otherwise(0.0)
    return ranked.agg(*(c.alias(n) for n, c in picked.items())).select(*(c.alias(n) for n, c in made.items()))


def with_statistics(df: DataFrame, **statistics: Column | Quantile) -> DataFrame:
    """``df`` with whole-table statistics on every row, by name: one aggregate for the plain ones and one for all quantiles,
    whose single rows are joined."""
    plain = {n: c for n, c in statistics.items() if not isinstance(c, Quantile)}
    quantiles = {n: c for n, c in statistics.items() if isinstance(c, Quantile)}
    out = df.join(F.broadcast(df.agg(*(c.alias(n) for n, c in plain.items())))) if plain else df
    out = out.join(F.broadcast(_quantile_row(df, quantiles))) if quantiles else out
    return out.select(*df.columns, *statistics)
