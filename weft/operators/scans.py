"""Window columns whose partitions no single task should hold: a whole table, or keys with very many rows.

The rows are range-partitioned by keys and order, sorted and written once; each row keeps its place in that order
(``_seq``), whose upper bits name its range, the "cut". Copies of a row are dealt to several cuts too. Spark's own window
functions then run within (cut, key), each cut in a task of its own, and what the other cuts of the same key hold comes
from two small tables:

* carries: for a key that lies in several cuts, the partial aggregates, counts and first and last orders of its cuts, run
  forwards and backwards over the cuts. A boundary splits one key at most, so that is at most two rows a cut, whatever the
  number of rows and keys: they are broadcast.
* halos: the rows next to a boundary that bounded frames, LAG and LEAD look at, copied to the cuts that need them.

Cost: two shuffles of the rows and one write, no sort beyond a cut. Functions' values are made where the rows are written,
each expression once; only ranks with peers hold the order and count equal ones; carries are joined after the windows. Spark
adds up a bounded frame anew for every row; long ones of counts and of exact sums are differences of two running values, so
they cost the same at any length. A frame longer than a cut copies rows to several cuts, so cuts should be longer than the
longest bounded frame. A plan with a shuffle is written before it is cut, since rows of
a repeated task could come in another order.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Row, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.shared import kept

from .shaping import order_keys

if TYPE_CHECKING:
    from .windowing import WindowColumn

#: Bits of ``_seq`` below those of the cut, as Spark numbers rows.
_BITS = 33
#: A bounded frame of more rows is taken from running values, where these are exact.
_LONG = 16
PEERS, SHIFTS = ("RANK", "DENSE_RANK", "PERCENT_RANK"), ("LAG", "LEAD")
RANKS = ("ROW_NUMBER", *PEERS)
_VARIANCES = {"STDDEV": True, "STD": True, "VARIANCE": False, "VAR": False}
Parts = dict[str, Column]


def _parts(kind: str, c: Column) -> Parts:
    """The partial aggregates that a kind is made of. FIRST and LAST are by ``_seq``."""
    if kind in ("SUM", "MIN", "MAX"):
        return {"x": getattr(F, kind.lower())(c)}
    if kind == "BIT_XOR":
        return {"x": F.bit_xor(c)}
    if kind == "COUNT":
        return {"n": F.count(c)}
    if kind == "AVG":
        return {"x": F.sum(c), "n": F.count(c)}
    if kind in _VARIANCES:
        return {"n": F.count(c), "a": F.avg(c.cast("double")), "v": F.var_pop(c) * F.count(c)}
    by = F.when(c.isNotNull(), F.col("_seq"))
    return {"x": (F.min_by if kind == "FIRST" else F.max_by)(c, by)}


def _over(kind: str, c: Column, w: WindowSpec) -> Parts:
    """The same parts over a window's frame."""
    if kind in ("FIRST", "LAST"):
        return {"x": getattr(F, kind.lower())(c, ignorenulls=True).over(w)}
    return {k: p.over(w) if kind not in _VARIANCES or k != "v" else F.var_pop(c).over(w) * F.count(c).over(w) for k, p in _parts(kind, c).items()}


def _run(kind: str, x: Parts, w: WindowSpec, whole: WindowSpec) -> Parts:
    """The parts of many cuts as one, over a frame of cuts."""
    if kind in ("FIRST", "LAST"):
        return {"x": getattr(F, kind.lower())(x["x"], ignorenulls=True).over(w)}
    if kind in ("MIN", "MAX", "BIT_XOR"):
        return {"x": getattr(F, kind.lower())(x["x"]).over(w)}
    if kind not in _VARIANCES:
        return {k: F.sum(c).over(w) for k, c in x.items()}
    # Squares of means are taken about a value near them, so that little is lost where the mean is large.
    near = F.coalesce(F.avg(x["a"]).over(whole), F.lit(0.0))
    n, d = F.sum(x["n"]).over(w), F.coalesce(x["a"], F.lit(0.0)) - near
    own = F.sum(x["n"] * F.when(x["n"] > 0, d).otherwise(0.0)).over(w) / F.nullif(n, F.lit(0))
    return {"n": n, "a": own + near, "v": F.sum(F.coalesce(x["v"], F.lit(0.0)) + x["n"] * d * d).over(w) - n * own * own}


def _merge(kind: str, x: Parts, y: Parts) -> Parts:
    """Parts of rows that come before others and of those others, as one."""
    if kind in _VARIANCES:
        n, m = F.coalesce(x["n"], F.lit(0)), F.coalesce(y["n"], F.lit(0))
        d = y["a"] - x["a"]
        both = (n > 0) & (m > 0)
        pick = lambda k: F.when(n > 0, x[k]).otherwise(y[k])
        return {"n": n + m, "a": F.when(both, x["a"] + d * m / (n + m)).otherwise(pick("a")), "v": F.when(both, x["v"] + y["v"] + d * d * n * m / (n + m)).otherwise(pick("v"))}
    if kind in ("FIRST", "LAST"):
        return {"x": F.coalesce(*((x["x"], y["x"]) if kind == "FIRST" else (y["x"], x["x"])))}
    if kind in ("MIN", "MAX"):
        return {"x": (F.least if kind == "MIN" else F.greatest)(x["x"], y["x"])}
    if kind == "BIT_XOR":
        return {"x": F.coalesce(x["x"].bitwiseXOR(y["x"]), x["x"], y["x"])}
    return {k: F.coalesce(x[k] + y[k], x[k], y[k]) for k in x}


def _finish(kind: str, x: Parts) -> Column:
    if kind == "COUNT":
        return F.coalesce(x["n"], F.lit(0))
    if kind == "AVG":
        return x["x"] / F.nullif(x["n"], F.lit(0))
    if kind in _VARIANCES:
        v = F.when(x["n"] > 1, F.greatest(x["v"], F.lit(0.0)) / (x["n"] - 1))
        return F.sqrt(v) if _VARIANCES[kind] else v
    return x["x"]


def _slots(df: DataFrame, cuts: int) -> Column:
    """A number for each cut such that Spark's hash deals every cut to a task of its own."""
    found: dict[int, int] = {}
    ids = df.sparkSession.range(64 * cuts + 1024).select("id", F.pmod(F.hash("id"), F.lit(cuts)).alias("to"))
    for r in ids.groupBy("to").agg(F.min("id").alias("id")).collect():
        found[r["to"]] = r["id"]
    free = iter(range(10**9, 10**9 + cuts))
    return F.element_at(F.array(*(F.lit(found.get(i, next(free))).cast("long") for i in range(cuts))), F.col("_cut") + 1)


def _same(names: list[str], a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in names], F.lit(True))


def _values(df: DataFrame, columns: list[WindowColumn]) -> tuple[list[str], Parts]:
    """For each window column the column that holds its function's value (ranks: none), and those of them to be made, each
    expression once."""
    at: list[str] = []
    made: Parts = {}
    seen: dict[int, str] = {}
    for i, w in enumerate(columns):
        name = w.value_name(df)
        if w.function.upper() in RANKS:
            at.append("")
        elif name in df.columns and "." not in name:
            at.append(name)
        else:
            at.append(seen.setdefault(id(w.c), f"_w_c{i}") if name is None else f"_w_c{i}")
            made[at[-1]] = w.value(df)
    return at, made


def ranged(df: DataFrame, keys: list[str], order: list[Column], values: Parts | None = None) -> DataFrame:
    """``df`` written in the order of keys, ``order`` and content, with ``_seq``, the place of a row in its cut, the cut, and
    ``values``, which are computed where the rows are written and not shuffled."""
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        df = kept(df)
    tied = [f.name for f in df.schema.fields if not re.search("map<|variant", f.dataType.simpleString())]
    by = [*(F.col(k).asc() for k in keys), *order, F.xxhash64(*tied).asc(), F.col("_id").asc()]
    df = df.withColumn("_id", F.monotonically_increasing_id())
    return kept(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_seq", F.monotonically_increasing_id()).withColumns(values or {}).drop("_id")).withColumn("_cut", F.shiftright("_seq", _BITS).cast("int"))


def distributed(df: DataFrame, columns: list[WindowColumn]) -> DataFrame:
    """``df`` with window columns of one partition and order (both may be empty); none may use another's result.

    Values are those of Spark's own windows, but ranks are long; rows of equal order are taken in the order of their
    content, copies in any.
    Names that begin with ``_w_``, ``_seq``, ``_cut``, ``_side`` and ``_id`` are taken for the time of the job.
    """
    keys, order = list(columns[0].partition), order_keys(list(columns[0].order))
    own = [c for c in df.columns if c not in {w.name for w in columns}]
    at, values = _values(df, columns)
    # Only these look at equal orders: for them the order is held, and the peers of each cut are counted.
    ordered = {f"_w_o{i}": F.col(c) for i, (c, _) in enumerate(columns[0].order)} if any(w.function.upper() in PEERS for w in columns) else {}
    rows = ranged(df, keys, order, values | ordered)
    before, behind = max([0, *(w.reach(df)[0] for w in columns)]), max([0, *(w.reach(df)[1] for w in columns)])
    exact = {i: t for i, w in enumerate(columns) if _long(w) and (t := _exact(w, rows.schema[at[i]].dataType))}
    bounded = sorted({at[i] for i, t in exact.items() if columns[i].function.upper() != "COUNT" and t == T.LongType()})
    summary, facts = _summary(rows, keys, list(columns), at, list(ordered), bounded)
    cuts = (facts["_cut"] or 0) + 1
    # A running sum of a cut and its halos must fit, or the frames are added up as Spark does.
    most = {c: max(abs(facts[f"_w_min{j}"] or 0), abs(facts[f"_w_max{j}"] or 0)) * ((facts["_w_n"] or 0) + before + behind) for j, c in enumerate(bounded)}
    exact = {i: t for i, t in exact.items() if columns[i].function.upper() == "COUNT" or most.get(at[i], 0) < 2**63}
    carry = kept(_carried(summary, keys, list(columns), bool(ordered)))
    rows = rows.withColumn("_side", F.lit(0))
    if before or behind:
        # Only what functions look at beyond a boundary is read again and copied.
        looked = {*keys, *ordered, "_seq", "_cut", "_side", *(c for w, c in zip(columns, at, strict=True) if any(w.reach(df)))}
        rows = rows.unionByName(_halo(rows.select(*(F.col(f"`{c}`") for c in rows.columns if c in looked)), carry, keys, before, behind), allowMissingColumns=True)
    rows = rows.withColumn("_slot", _slots(df, cuts)).repartition(cuts, "_slot")

    part = Window.partitionBy("_slot", *keys)
    w_all, w_seq = part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), part.orderBy("_seq")
    run, mine = w_seq.rowsBetween(Window.unboundedPreceding, 0), F.when(F.col("_side") == 0, F.col("_seq"))
    if ordered:
        rows = rows.withColumn("_w_first", F.min(mine).over(w_all)).withColumn("_w_o", F.struct(*ordered))
        rows = rows.withColumn("_w_new", (F.col("_seq") == F.col("_w_first")) | ~F.lag("_w_o").over(w_seq).eqNullSafe(F.col("_w_o")))
        new = (F.col("_side") == 0) & F.col("_w_new")
        rows = rows.withColumn("_w_peer", F.max(F.when(new, F.col("_seq"))).over(run)).withColumn("_w_dense", F.count(F.when(new, 1)).over(run)).withColumn("_w_rows", F.count(mine).over(w_all))
    within: Parts = {"_w_place": F.count(mine).over(run)} if any(w.function.upper() == "ROW_NUMBER" for w in columns) else {}
    for i, t in exact.items():
        rows = rows.withColumns(_running(i, columns[i], F.col(at[i]), t, w_seq))
    for i, w in enumerate(columns):
        if i in exact:
            within |= {f"_w_v{i}{k}": x for k, x in _difference(i, w, exact[i], w_seq).items()}
        elif w.function.upper() not in RANKS and not _total(w, keys):
            within |= {f"_w_v{i}{k}": x for k, x in _within(w, F.col(at[i]), w_seq, part.orderBy(F.desc("_seq"))).items()}
    # The carries come after the windows, so these sort and hold the rows alone.
    rows = rows.withColumns(within).where(F.col("_side") == 0)
    joined = rows.alias("r").join(F.broadcast(carry).alias("s"), (F.col("r._cut") == F.col("s._cut")) & _same(keys, "r", "s"), "left")
    carried = [c for c in carry.columns if c not in (*keys, "_cut")]
    rows = joined.select("r.*", *(F.col(f"s.{c}").alias(c) for c in carried))
    out = rows.select(*own, *(_column(i, w, df, rows.columns, i in exact).alias(w.name) for i, w in enumerate(columns)))
    # A frame that ends before the row, or starts after it, and is open at the other side: the running value, shifted.
    for w in filter(_late, columns):
        out = _shifted(out, w)
    return out.select(*own, *(w.name for w in columns))


def _late(w: WindowColumn) -> bool:
    a, b = w.bounds()
    return w.function.upper() not in (*RANKS, *SHIFTS) and ((a is None and b is not None and b < 0) or (b is None and a is not None and a > 0))


def _shifted(df: DataFrame, w: WindowColumn) -> DataFrame:
    a, b = w.bounds()
    shift = type(w)("_w_shifted", "LAG" if a is None else "LEAD", w.partition, w.order, w.name, offset=-b if a is None else a, split=True)
    out = distributed(df, [shift])
    c = F.coalesce("_w_shifted", F.lit(0)) if w.function.upper() == "COUNT" else F.col("_w_shifted")
    return out.withColumn(w.name, c).drop("_w_shifted")


def _open(w: WindowColumn) -> bool:
    """Whether the frame may hold rows of any other cut."""
    return w.function.upper() not in (*RANKS, *SHIFTS) and None in w.bounds()


def _long(w: WindowColumn) -> bool:
    a, b = w.bounds()
    return w.function.upper() in ("COUNT", "SUM", "AVG") and a is not None and b is not None and b - a >= _LONG


def _total(w: WindowColumn, keys: list[str]) -> bool:
    """Whether all rows of the table have one value, which the carries hold."""
    return not keys and _open(w) and w.bounds() == (None, None)


def _exact(w: WindowColumn, t: T.DataType) -> T.DataType | None:
    """The type in which values of type ``t`` are counted or added up without rounding, if there is one."""
    if w.function.upper() == "COUNT" or isinstance(t, T.IntegralType):
        return T.LongType()
    # A cut has less than 10**10 rows, and the difference of two sums takes one digit more.
    return T.DecimalType(t.precision + 10, t.scale) if isinstance(t, T.DecimalType) and t.precision <= 27 else None


def _running(i: int, w: WindowColumn, c: Column, t: T.DataType, w_seq: WindowSpec) -> Parts:
    """Count and sum from the first row of a cut and its halos to this one, and over all of them."""
    spans = {"r": w_seq.rowsBetween(Window.unboundedPreceding, 0), "e": w_seq.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)}
    out = {f"_w_{s}{i}n": F.count(c).over(x) for s, x in spans.items()}
    return out if w.function.upper() == "COUNT" else out | {f"_w_{s}{i}x": F.coalesce(F.sum(c).over(x), F.lit(0).cast(t)) for s, x in spans.items()}


def _difference(i: int, w: WindowColumn, t: T.DataType, w_seq: WindowSpec) -> Parts:
    """The parts over a bounded frame: the running value at its last row less that before its first."""
    a, b = w.bounds()

    def run(k: str, n: int) -> Column:
        c = F.col(f"_w_r{i}{k}")
        if n > 0:
            return F.coalesce(F.lead(c, n).over(w_seq), F.col(f"_w_e{i}{k}"))
        return F.coalesce(F.lag(c, -n).over(w_seq), F.lit(0).cast(t if k == "x" else "long")) if n else c

    return {k: (run(k, b) - run(k, a - 1)).cast(t if k == "x" else "long") for k in ("n" if w.function.upper() == "COUNT" else "nx")}


def _summary(rows: DataFrame, keys: list[str], columns: list[WindowColumn], at: list[str], ordered: list[str], bounded: list[str]) -> tuple[DataFrame, Row]:
    """A row for each cut of each key that has several: rows, first place, first and last order, partial aggregates. And the
    last cut, the most rows of a cut, and the bounds of some columns."""
    some, ends = rows, None
    bounds = {f"_w_{f}{j}": getattr(F, f)(F.col(c).cast("long")) for j, c in enumerate(bounded) for f in ("min", "max")}
    if keys:
        ends = kept(rows.groupBy("_cut").agg(F.min(F.struct(*keys)).alias("a"), F.max(F.struct(*keys)).alias("b"), F.count(F.lit(1)).alias("_w_n"), *(c.alias(k) for k, c in bounds.items())))
        split = ends.select("_cut", F.explode(F.array_distinct(F.array("a", "b"))).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k.*")
        some = rows.alias("r").join(F.broadcast(kept(split)).alias("s"), _same(keys, "r", "s"), "left_semi").select("r.*")
    parts: Parts = {"_w_n": F.count(F.lit(1)), "_w_first": F.min("_seq")} | ({} if keys else bounds)
    for i, w in enumerate(columns):
        if _open(w):
            parts |= {f"_w_p{i}{k}": c for k, c in _parts(w.function.upper(), F.col(at[i])).items()}
    out = some.groupBy("_cut", *keys).agg(*(c.alias(k) for k, c in parts.items()))
    if ordered:
        peers = some.groupBy("_cut", *keys, F.struct(*ordered).alias("_w_o")).agg(F.min("_seq").alias("_w_s"))
        sides = peers.groupBy("_cut", *keys).agg(F.count(F.lit(1)).alias("_w_d"), F.max("_w_s").alias("_w_ls"), F.min_by("_w_o", "_w_s").alias("_w_fo"), F.max_by("_w_o", "_w_s").alias("_w_lo"))
        out = out.alias("r").join(sides.alias("s"), (F.col("r._cut") == F.col("s._cut")) & _same(keys, "r", "s")).select("r.*", "s._w_d", "s._w_ls", "s._w_fo", "s._w_lo")
    out = kept(out)
    return out, (out if ends is None else ends).agg(F.max("_cut").alias("_cut"), F.max("_w_n").alias("_w_n"), *(getattr(F, k[3:6])(k).alias(k) for k in bounds)).first()


def _carried(summary: DataFrame, keys: list[str], columns: list[WindowColumn], ordered: bool) -> DataFrame:
    """For each cut of the summary: rows before and in all, partial aggregates before and after it, and where the peers of
    its first order began. The summary has at most two rows a cut."""
    w = Window.partitionBy(*keys).orderBy("_cut")
    whole = Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    up, down = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    out = {"_w_off": F.coalesce(F.sum("_w_n").over(up), F.lit(0)), "_w_all": F.sum("_w_n").over(whole), "_w_own": F.col("_w_n"), "_w_start": F.col("_w_first")}
    for i, c in enumerate(columns):
        kind = c.function.upper()
        if _open(c):
            x = {k[len(f"_w_p{i}") :]: F.col(k) for k in summary.columns if k.startswith(f"_w_p{i}") and not k[len(f"_w_p{i}") :][:1].isdigit()}
            if _total(c, keys):
                out |= {f"_w_t{i}{k}": v for k, v in _run(kind, x, w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), whole).items()}
                continue
            out |= {f"_w_b{i}{k}": v for k, v in _run(kind, x, up, whole).items()} | {f"_w_a{i}{k}": v for k, v in _run(kind, x, down, whole).items()}
    if ordered:
        summary = summary.withColumn("_w_go", F.coalesce(F.lag("_w_lo").over(w).eqNullSafe(F.col("_w_fo")) & F.lag("_w_n").over(w).isNotNull(), F.lit(False)))
        summary = summary.withColumn("_w_place", F.coalesce(F.sum("_w_n").over(up), F.lit(0)) + F.col("_w_ls") - F.col("_w_first") + 1)
        # The last peers of a cut that is all one peer group with the cut before began where those did.
        summary = summary.withColumn("_w_began", F.when(~(F.col("_w_go") & (F.col("_w_d") == 1)), F.col("_w_place")))
        summary = summary.withColumn("_w_began", F.last("_w_began", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        out |= {"_w_pp": F.when(F.col("_w_go"), F.lag("_w_began").over(w)), "_w_db": F.coalesce(F.sum("_w_d").over(up), F.lit(0)) - F.sum(F.col("_w_go").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))}
    return summary.select("_cut", *keys, *(c.alias(k) for k, c in out.items()))


def _halo(rows: DataFrame, carry: DataFrame, keys: list[str], before: int, behind: int) -> DataFrame:
    """Copies of the rows within ``before`` rows of a later cut and ``behind`` rows of an earlier one, for those cuts."""
    c = F.broadcast(carry.select("_cut", *keys, "_w_off", "_w_own", "_w_start")).alias("c")
    ago = F.col("_seq") - F.col("_w_start")
    near = rows.alias("r").join(c, (F.col("r._cut") == F.col("c._cut")) & _same(keys, "r", "c")).where((F.col("_w_own") - ago <= before) | (ago < behind)).select("r.*", (F.col("_w_off") + ago + 1).alias("_w_q"))
    t = F.broadcast(carry.select(*keys, F.col("_cut").alias("_w_to"), F.col("_w_off").alias("_w_x"), (F.col("_w_off") + F.col("_w_own")).alias("_w_y"))).alias("t")
    q = F.col("n._w_q")
    first = (q <= F.col("t._w_x")) & (q > F.col("t._w_x") - before)
    last = (q > F.col("t._w_y")) & (q <= F.col("t._w_y") + behind)
    met = near.alias("n").join(t, _same(keys, "n", "t") & (F.col("n._cut") != F.col("t._w_to")) & (first | last))
    side = F.when(first, F.lit(-1)).otherwise(F.lit(1))
    return met.select(*(F.col(f"n.{c}") for c in rows.columns if c not in ("_cut", "_side")), F.col("t._w_to").alias("_cut"), side.alias("_side")).select(*rows.columns)


def _frame(w: WindowColumn) -> tuple[int | None, int | None]:
    a, b = w.bounds()
    return ((None, 0) if a is None else (0, None)) if _late(w) else (a, b)


def _within(w: WindowColumn, c: Column, w_seq: WindowSpec, w_back: WindowSpec) -> Parts:
    """The parts of a function over the rows of a cut and its halos; an open side ends at the cut."""
    kind = w.function.upper()
    if kind in SHIFTS:
        return {"x": (F.lag if kind == "LAG" else F.lead)(c, w.offset).over(w_seq)}
    a, b = _frame(w)
    if a is None:
        c = F.when(F.col("_side") == 0 if b is None else F.col("_side") >= 0, c)
    elif b is None:
        c = F.when(F.col("_side") <= 0, c)
        if kind == "COUNT":
            # All but those before: no second sort.
            return {"n": F.count(c).over(w_seq.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.count(c).over(w_seq.rowsBetween(Window.unboundedPreceding, a - 1))}
        # Spark adds up a frame that is open behind anew for every row; seen from the end it only grows.
        return _over({"FIRST": "LAST", "LAST": "FIRST"}.get(kind, kind), c, w_back.rowsBetween(Window.unboundedPreceding, -a))
    return _over(kind, c, w_seq.rowsBetween(Window.unboundedPreceding if a is None else a, Window.unboundedFollowing if b is None else b))


def _column(i: int, w: WindowColumn, df: DataFrame, names: list[str], exact: bool) -> Column:
    """The function's value from its parts within the cut and those carried from the others."""
    kind = w.function.upper()
    off = F.coalesce("_w_off", F.lit(0))
    if kind == "ROW_NUMBER":
        return off + F.col("_w_place")
    if kind in PEERS:
        rank = F.when(F.col("_w_pp").isNotNull() & (F.col("_w_peer") == F.col("_w_first")), F.col("_w_pp")).otherwise(off + F.col("_w_peer") - F.col("_w_first") + 1)
        n = F.coalesce("_w_all", "_w_rows")
        return {
            "RANK": lambda: rank,
            "DENSE_RANK": lambda: F.coalesce("_w_db", F.lit(0)) + F.col("_w_dense"),
            "PERCENT_RANK": lambda: F.when(n > 1, (rank - 1) / (n - 1).cast("double")).otherwise(0.0),
        }[kind]()
    if kind in SHIFTS:
        return F.col(f"_w_v{i}x")
    a, b = _frame(w)
    x = {k: F.col(f"_w_v{i}{k}") for k in "xnav" if f"_w_v{i}{k}" in names}
    if a is None and x:
        x = _merge(kind, {k: F.col(f"_w_b{i}{k}") for k in x}, x)
    if b is None and x:
        x = _merge(kind, x, {k: F.col(f"_w_a{i}{k}") for k in x})
    if _total(w, list(w.partition)):
        x = {k: F.col(f"_w_t{i}{k}") for k in "xnav" if f"_w_t{i}{k}" in names}
    elif exact and "x" in x:
        x["x"] = F.when(x["n"] > 0, x["x"])
    return _finish(kind, x).cast(df.select(w.plain(df)).schema[0].dataType)
