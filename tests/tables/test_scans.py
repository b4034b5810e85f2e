"""Windows cut over many tasks against Spark's own."""

import math
import random
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from weft.operators import scans, windowing
from weft.operators.windowing import WindowColumn as W


@pytest.fixture
def cut(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.fixture(scope="module")
def df(spark):
    rng = random.Random(5)
    rows = [(i, "hot" if i % 10 else rng.choice(["a", "b", None]), rng.choice([1, 2, 2, 3, None]), rng.choice([None, *range(-50, 50)]), 1e6 + rng.random(), rng.choice(["p", "q", None])) for i in range(1500)]
    return spark.createDataFrame(rows, "id long, k string, t int, v int, x double, s string").withColumn("d", F.col("v").cast("decimal(10,2)")).repartition(3)


def close(a, b):
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) if isinstance(a, float) and isinstance(b, float) else a == b


def same(df, columns):
    """By rows, which ``id`` names."""
    got = windowing.with_windows(df, columns)
    want = windowing.with_windows(df, [replace(c, split=False, whole_table=True) for c in columns])
    assert got.columns == want.columns
    for x, y in zip(got.orderBy("id").collect(), want.orderBy("id").collect(), strict=True):
        assert all(map(close, x, y)), (x, y)


FRAMES = [(None, None), ("unbounded", 0), (0, "unbounded"), (3, 2), (400, 1), (None, 3), (2, None), (5, -2), (-1, 4), ("unbounded", -2), (-3, "unbounded"), (0, 0)]


KINDS = [("SUM", "v"), ("SUM", "d"), ("COUNT", "v"), ("AVG", "v"), ("MIN", "s"), ("MAX", "v"), ("STDDEV", "x"), ("VAR", "v"), ("FIRST", "s"), ("LAST", "v"), ("SUM", "t"), ("BIT_XOR", "id")]


@pytest.mark.parametrize("part", [(), ("k",)])
def test_frames(spark, df, cut, part):
    order = (("t", "desc"), ("id", "asc"))
    # Every frame with four kinds, and every kind with four frames.
    pairs = [(f, KINDS[(i + 3 * j) % len(KINDS)]) for i, f in enumerate(FRAMES) for j in range(4)]
    late = [x for x in pairs if scans._late(W("", "SUM", preceding=x[0][0], following=x[0][1]))]
    same(df, [W(f"o{i}", kind, part, order, c, preceding=a, following=b, split=True) for i, ((a, b), (kind, c)) in enumerate([x for x in pairs if x not in late] + late[:3])])


@pytest.mark.parametrize("part", [(), ("k",)])
def test_ranks_and_shifts(spark, df, cut, part):
    order = (("t", "asc"), ("id", "desc"))
    same(df, [W("rn", "ROW_NUMBER", part, order, split=True), W("l1", "LAG", part, order, "v", split=True), W("l9", "LAG", part, order, "s", 300, split=True), W("n2", "LEAD", part, order, "v", 2, split=True), W("own", "LAG", part, order, split=True)])
    ties = (("t", "desc"), ("s", "asc"))
    same(df, [W("rk", "RANK", part, ties, split=True), W("dr", "DENSE_RANK", part, ties, split=True), W("pr", "PERCENT_RANK", part, ties, split=True)])
    same(df, [W("rk", "RANK", part, (("t", "asc"),), split=True), W("dr", "DENSE_RANK", part, (("t", "asc"),), split=True)])


def test_the_cuts_are_even_and_copies_are_dealt(spark, cut):
    df = spark.range(4000).select(F.lit(1).alias("k"), F.lit(2).alias("v"))
    rows = scans.ranged(df, ["k"], [F.col("v").asc()])
    sizes = [r["count"] for r in rows.groupBy("_cut").count().collect()]
    assert len(sizes) == 7 and max(sizes) < 2 * min(sizes)
    got = windowing.with_windows(df, [W("n", "ROW_NUMBER", ("k",), (("v", "asc"),), split=True), W("r", "RANK", ("k",), (("v", "asc"),), split=True)])
    assert sorted(r.n for r in got.collect()) == list(range(1, 4001)) and {r.r for r in got.collect()} == {1}
    slots = spark.range(7).select(F.col("id").cast("int").alias("_cut"))
    assert slots.select(scans._slots(slots, 7).alias("s")).repartition(7, "s").select(F.spark_partition_id().alias("p")).distinct().count() == 7


def test_odd_rows(spark, df, cut):
    order = (("id", "asc"),)
    cols = [W("n", "ROW_NUMBER", (), order), W("s", "SUM", (), order, "v", preceding="unbounded", following=0), W("r", "RANK", (), order), W("l", "LAG", (), order, "v")]
    assert windowing.with_windows(df.limit(0), cols).collect() == []
    assert [tuple(r)[-4:] for r in windowing.with_windows(df.limit(1).withColumn("v", F.lit(4)), cols).collect()] == [(1, 4, 1, None)]
    total = windowing.with_windows(df, [W("all", "SUM", c="v"), W("n", "COUNT", c="v"), W("v", "MAX", c="v")])
    assert total.columns.count("v") == 1 and {(r["all"], r["n"], r["v"]) for r in total.collect()} == {tuple(df.agg(F.sum("v"), F.count("v"), F.max("v")).first())}
    named = windowing.with_windows(df, [W("v", "SUM", ("k",), order, "v", preceding="unbounded", following=0, split=True), W("twice", "SUM", ("k",), order, "v", preceding=0, following=0, split=True)])
    assert named.where("v <> twice").isEmpty()
    run = windowing.with_windows(df, [windowing.running(k.lower(), k, "v", order) for k in ("CUMSUM", "CUMMEAN", "CUMMIN", "CUMMAX")], ordered=True).orderBy("id").tail(1)[0]
    assert tuple(run)[-4:] == tuple(df.agg(F.sum("v"), F.avg("v"), F.min("v"), F.max("v")).first())
    with pytest.raises(ValueError, match="unknown running"):
        windowing.running("x", "CUMPRODUCT", "v", order)


def written_columns(monkeypatch):
    found, kept = [], scans.kept
    monkeypatch.setattr(scans, "kept", lambda d: found.append([c for c in d.columns if c.startswith("_w_")]) or kept(d))
    return found


def test_hot_keys_write_a_value_once_and_no_order(spark, df, cut, monkeypatch):
    order, more, found = (("t", "asc"), ("id", "asc")), F.col("v") + 1, written_columns(monkeypatch)
    columns = [W("row", "ROW_NUMBER", ("k",), order, split=True), W("near", "SUM", ("k",), order, more, preceding=3, following=2, split=True), W("run", "SUM", ("k",), order, more, preceding="unbounded", following=0, split=True), W("first", "FIRST", ("k",), order, "s", split=True)]
    columns += [W(f"c{a}", "COUNT", ("k",), order, "v", preceding=a, split=True) for a in (0, 2, -2, 400)]
    same(df, columns)
    assert next(c for c in found if c) == ["_w_c1"] and not any(c in ("_w_o0", "_w_fo", "_w_d") for cs in found for c in cs)


def test_whole_tables_take_one_window_before_the_carries(spark, df, cut, monkeypatch):
    order, found = (("t", "desc"), ("id", "asc")), written_columns(monkeypatch)
    columns = [W("row", "ROW_NUMBER", (), order), W("back", "LAG", (), order, "v", 3), W("run", "SUM", (), order, "v", preceding="unbounded", following=0), W("near", "AVG", (), order, "v", preceding=9, following=2), W("ahead", "COUNT", (), order, "s", preceding=0)]
    same(df, columns)
    plan = windowing.with_windows(df, columns)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bWindow \[", plan)) == 1 and plan.index("BroadcastHashJoin") < plan.index("Window [")
    assert not any(c in ("_w_c3", "_w_o0", "_w_fo", "_w_d") for cs in found for c in cs)


def plan_of(df, columns):
    return windowing.with_windows(df, columns)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("part", [(), ("k",)])
def test_long_frames_are_not_added_up_anew(spark, df, cut, part):
    order, df = (("id", "asc"),), df.withColumn("small", F.col("v").cast("short")).withColumn("holes", F.when(F.col("id") % 100 == 0, F.col("v")))
    made = [("AVG", "v", 100, 20), ("SUM", "d", 60, -40), ("SUM", "small", -30, 70), ("AVG", "holes", 20, 0), ("COUNT", "s", 2000, 2000), ("SUM", "holes", 0, 300), ("AVG", "d", 400, 1)]
    columns = [W(f"o{i}", kind, part, order, c, preceding=a, following=b, split=True) for i, (kind, c, a, b) in enumerate(made)]
    same(df, columns)
    assert not re.search(r"(sum|count)\([^)]*\) windowspecdefinition\([^)]*frame\(RowFrame, (-?\d|currentrow)", plan_of(df, columns))


def test_sums_that_may_not_fit_stay_frames(spark, df, cut):
    order, df = (("id", "asc"),), df.withColumn("wide", F.when(F.col("id") % 40 == 0, F.lit(2**62)).otherwise(F.lit(-3)))
    columns = [W("far", "SUM", (), order, "wide", preceding=20, following=0), W("real", "SUM", (), order, "x", preceding=20, following=0)]
    same(df, columns)
    assert len(re.findall(r"sum\([^)]*\) windowspecdefinition\([^)]*frame\(RowFrame, -20", plan_of(df, columns))) == 2


def test_totals_of_the_whole_table_come_from_the_scan(spark, df, cut, monkeypatch):
    order, found = (("t", "desc"), ("id", "asc")), written_columns(monkeypatch)
    columns = [W("row", "ROW_NUMBER", (), order), W("first", "FIRST", (), order, "s"), W("n", "COUNT", c="v"), W("most", "MAX", c="d"), W("spread", "STDDEV", c="x")]
    same(df, columns)
    assert any("_w_t4v" in cs for cs in found)
    plan = plan_of(df, columns)
    assert len(re.findall(r"\bWindow \[", plan)) == 1 and "Aggregate" not in plan and "max(" not in plan
