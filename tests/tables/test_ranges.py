"""Joins by comparisons alone, cut into ranges, against Spark's nested loop."""

import random

import pytest

from pyspark.sql import functions as F

from weft.operators import joins, ranges


@pytest.fixture
def large(spark):
    """No table counts as small."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(2)
    points = [(i, rng.choice([None, 50, 50, 50, rng.randrange(100)]), rng.choice("xyz"), rng.choice([float("nan"), 1.5, 2.0])) for i in range(400)]
    spans = [(i, lo, rng.choice([None, lo, (lo or 0) + rng.randrange(-3, 30)]), rng.choice("xyz")) for i in range(60) for lo in [rng.choice([None, rng.randrange(-20, 120)])]]
    return spark.createDataFrame(points, "id long, v int, s string, f double"), spark.createDataFrame(spans, "n long, lo int, hi int, s string")


CASES = [
    (("v", "GTE", "lo"), ("v", "LTE", "hi")),
    (("v", "GT", "lo"), ("v", "LT", "hi"), ("s", "NEQ", "s")),
    (("v", "LT", "lo"),),
    (("v", "GTE", "hi"),),
    (("s", "LT", "s"),),
    (("f", "LT", "hi"), ("v", "GT", "lo")),
]


@pytest.mark.parametrize("kind", ["inner", "left", "right", "full"])
@pytest.mark.parametrize("on", CASES)
def test_equals_the_nested_loop(spark, sides, large, kind, on):
    rows = lambda d: sorted(map(repr, map(tuple, d.collect())))
    for a, b, criteria in ((*sides, on), (*sides[::-1], tuple((y, ranges._TURNED.get(op, op), x) for x, op, y in on))):
        got = joins.join(a, joins.Right(b, "other", kind, criteria))
        left, right = a.select(*(a[c].alias(f"a_{c}") for c in a.columns)), b.select(*(b[c].alias(f"b_{c}") for c in b.columns))
        test = joins._all(left.__getitem__, right.__getitem__, [(f"a_{x}", op, f"b_{y}") for x, op, y in criteria])
        assert rows(got) == rows(left.join(right, test, kind))


def test_no_nested_loop_and_small_sides_are_sent(spark, sides, large):
    plan = lambda: joins.join(sides[0], joins.Right(spark.range(9), "other", "inner", (("v", "LT", "id"),)))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan() and "Cartesian" not in plan()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    assert "NestedLoop" in plan()


def test_frequent_values_are_dealt_over_slots():
    values = [7] * 600 + list(range(300)) + [299] * 100
    slots = ranges.Slots(values, 16)
    at = ranges.bisect_right(slots.cuts, 7)
    assert slots.slots[at] >= 9 and slots.cuts[at] == 8 and sum(slots.slots) < 40
    assert ranges.Slots([], 16).slots == [1] and ranges.Slots([3] * 50, 16).slots[-1] == 16


def test_empty_sides(spark, sides, large):
    a, b = sides
    for x, y in ((a.limit(0), b), (a, b.limit(0))):
        assert joins.join(x, joins.Right(y, "other", "inner", CASES[0])).collect() == []
        assert joins.join(x, joins.Right(y, "other", "full", CASES[0])).count() == x.count() + y.count()


def test_copied_rows_are_no_broadcast_and_many_rows_no_nested_loop(spark):
    """Both sides are small by Spark's estimate: the pairs are still not tested one by one, nor the copies broadcast."""
    a, b = spark.range(3000).withColumnRenamed("id", "v"), spark.range(2000).select(F.col("id").alias("lo"), (F.col("id") + 2).alias("hi"))
    for kind, on, n in (("inner", (("v", "GTE", "lo"), ("v", "LTE", "hi")), 6000), ("full", (("v", "LT", "lo"),), 1999 * 2000 // 2 + 1001 + 1)):
        got = joins.join(a, joins.Right(b, "other", kind, on))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "BroadcastHashJoin" not in plan
        assert got.count() == n


def test_cells_follow_the_width_of_the_bounds(spark):
    """A row goes to few cells, and a cell of narrow bounds has few values."""
    v = spark.range(200_000).withColumnRenamed("id", "v")
    cells = ranges.Cells(ranges.looked_at(v, "v"), ranges._measure({"long"}))
    spans = cells.copied(cells.spans(spark.range(0, 200_000, 50).select(F.col("id").alias("lo"), (F.col("id") + 9).alias("hi")), F.col("lo"), F.col("hi")))
    levels = [r[0] for r in spans.select("_level").distinct().collect()]
    values = cells.values(v, F.col("v"), F.col("v"), levels)
    assert min(levels) >= 4 and spans.groupBy("lo").count().agg(F.max("count")).first()[0] <= 7
    assert spans.join(values, ["_level", "_cell", "_part"]).count() < 4 * 10 * 4000


def test_a_result_that_grows_with_the_square_is_small_as_parquet(spark, tmp_path):
    """Rows of a block come in the same order beside one value after another: before, a byte and more was left of each pair."""
    a, b = spark.range(2500).selectExpr("id AS n", "id * 7919L % 2503 AS v"), spark.range(3000).selectExpr("id AS m", "id * 6007L % 3001 AS w")
    joins.join(a, joins.Right(b, "other", "full", (("v", "LT", "w"),))).select("n", "m").write.parquet(f"{tmp_path}/out")
    pairs = spark.read.parquet(f"{tmp_path}/out").where("n IS NOT NULL AND m IS NOT NULL").count()
    assert pairs == a.join(b, F.col("v") < F.col("w")).count()
    assert sum(f.stat().st_size for f in tmp_path.glob("out/*.parquet")) < pairs / 3


def test_one_comparison_joins_once(spark, sides, large):
    """What one comparison leaves over follows from the largest and least values: no further join."""
    for op, kind in (("LT", "full"), ("GTE", "left"), ("GT", "right")):
        got = joins.join(sides[0], joins.Right(sides[1], "other", kind, (("v", op, "lo"),)))
        assert got._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 1


@pytest.mark.parametrize("on", CASES)
def test_small_blocks_and_many_turns(spark, sides, large, monkeypatch, on):
    for name, n in (("BLOCK", 4), ("PAIRS", 20), ("VALUES", 50)):
        monkeypatch.setattr(ranges, name, n)
    rows = lambda d: sorted(map(repr, map(tuple, d.collect())))
    a, b = sides
    left, right = a.select(*(a[c].alias(f"a_{c}") for c in a.columns)), b.select(*(b[c].alias(f"b_{c}") for c in b.columns))
    test = joins._all(left.__getitem__, right.__getitem__, [(f"a_{x}", op, f"b_{y}") for x, op, y in on])
    got = joins.join(a, joins.Right(b, "other", "full", on))
    assert rows(got) == rows(left.join(right, test, "full"))
    assert "explode(sequence(0, (_turns" in got._jdf.queryExecution().analyzed().toString()


def test_values_take_the_levels_of_their_bin_alone(spark):
    """Few rows with narrower bounds in one bin: the values of the others keep one place."""
    v = spark.range(200_000).withColumnRenamed("id", "v")
    cells = ranges.Cells(ranges.looked_at(v, "v"), ranges._measure({"long"}))
    given = spark.range(0, 200_000, 50).select(F.col("id").alias("lo"), (F.col("id") + F.when(F.col("id") < 500, 1).otherwise(400)).alias("hi"))
    taken = cells.taken(cells.spans(given, F.col("lo"), F.col("hi")))
    assert len(taken) == len(cells.slots.slots) and len(taken[0]) > 1 and len(taken[40]) == 1
    values = cells.leveled(cells.placed(v, F.col("v"), F.col("v")), F.col("v"), taken)
    assert 200_000 < values.count() < 210_000


def test_the_result_of_an_interval_join_is_small_as_parquet(spark, tmp_path):
    """As above, with three columns and narrow bounds: 0.62 bytes a pair; before, 0.85."""
    a = spark.range(20_000).selectExpr("id AS n", "id * 7919L % 20011 AS v")
    b = spark.range(20_000).selectExpr("id AS m", "concat('type', id * 31 % 5) AS k", "id * 6007L % 20011 AS lo", "id * 6007L % 20011 + 150 AS hi")
    joins.join(a, joins.Right(b, "other", "inner", (("v", "GTE", "lo"), ("v", "LTE", "hi")))).select("n", "m", "k").write.parquet(f"{tmp_path}/out")
    pairs = spark.read.parquet(f"{tmp_path}/out").count()
    assert pairs == a.join(b, F.col("v").between(F.col("lo"), F.col("hi"))).count()
    assert sum(f.stat().st_size for f in tmp_path.glob("out/*.parquet")) < pairs * 0.72
