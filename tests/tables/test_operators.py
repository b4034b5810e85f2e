"""Odd rows, refusals and properties of the table operators."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from weft.functions import dates, logic, maths, text, windows
from weft.operators import aggregates, cleaning, filters, joins, sets, windowing
from weft.plans import history, models, upkeep
from weft.sources import tables as sources


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_null_rules_of_formulas(spark):
    null = F.lit(None).cast("double")
    assert one(spark, logic.isnan(null)) is None and one(spark, logic.isinf(null)) is None
    assert one(spark, maths.clip(null, 0.0, 1.0)) is None and one(spark, maths.delta(null, 1)) == 0
    assert one(spark, text.concatenate("a", null)) is None and one(spark, text.join("-", "a", null, "b")) == "a-b"
    assert one(spark, text.proper(F.lit("ÀB cD"))) == "Àb cd" and one(spark, text.split_part(F.lit("a.b"), ".", 2)) == "b"
    assert one(spark, maths.even(F.lit(-3.0))) == -2 and one(spark, maths.odd(F.lit(-4.0))) == -5
    assert one(spark, maths.sumsq(F.lit(3), 2)) == 7 and one(spark, logic.isodd(F.lit(-3))) is False
    assert text.java_pattern("%Y-%m at %H") == "yyyy-MM 'at' HH"
    with pytest.raises(ValueError):
        windows.window([], ["x"])
    with pytest.raises(ValueError):
        logic.ifs(F.lit(True), 1, F.lit(False), 2)


def test_filters(spark):
    df = spark.createDataFrame([(1, "x"), (None, "y"), (3, None)], "a int, b string")
    q = filters.Condition
    assert filters.where(df, []).count() == 3
    assert rows(filters.where(df, [q("a", "NEQ", 1)])) == [(3, None)]
    assert rows(filters.where(df, [q("a", "EQ", 1), q("b", "EQ", "y", "OR"), q("a", "GT", 0)])) == [(1, "x")]
    assert filters.typed("12") == 12 and filters.typed("1.5") == 1.5 and filters.typed("true") is True and filters.typed("a") == "a"
    with pytest.raises(ValueError):
        filters.where(df, [q("a", "SOUNDS", 1)])


def test_joins(spark):
    a = spark.createDataFrame([(1, "l"), (2, "l"), (None, "l")], "k int, v string")
    b = spark.createDataFrame([(1, "r"), (1, "r2"), (None, "r")], "k int, v string")
    out = joins.join(a, joins.Right(b, "b", "inner", (("k", "EQ", "k"),)))
    assert out.columns == ["k", "v", "b_v"] and rows(out) == [(1, "l", "r"), (1, "l", "r2")]
    left = joins.join(a, joins.Right(b, "b", "left", (("k", "EQ", "k"),)))
    assert left.columns == ["k", "v", "b_k", "b_v"] and left.count() == 4
    for bad in (joins.Right(b, "b", "outer", (("k", "EQ", "k"),)), joins.Right(b, "b", "inner"), joins.Right(b, "b", "cross", (("k", "EQ", "k"),))):
        with pytest.raises(ValueError):
            joins.join(a, bad)


def test_aggregates(spark):
    none = spark.createDataFrame([], "k int, v double, n string")
    assert rows(aggregates.grouped(none, [], {"n": F.count("v"), "s": F.sum("v")})) == [(0, None)]
    df = spark.createDataFrame([(1, 1.0, "x"), (1, 2.0, "y"), (2, None, "x")], "k int, v double, n string")
    assert rows(aggregates.pivoted(df, "k", "n", "v", ["x", "y"], "SUM", "nope")) == [(1, 1.0, 2.0), (2, None, None)]
    over = F.sum("v").over(Window.partitionBy("k"))
    for bad in (lambda: aggregates.grouped(df, ["k"], {"x": over}), lambda: aggregates.aggregate("SUM", "*"), lambda: aggregates.aggregate("MODE", "v"), lambda: aggregates.pivoted(df, "k", "n", "v", ["x"], "COUNT_DISTINCT")):
        with pytest.raises(ValueError):
            bad()


def test_windows_need_what_they_use(spark):
    df = spark.createDataFrame([(1, 1), (1, 2)], "k int, v int")
    for bad in (windowing.WindowColumn("x", "RANK", ("k",)), windowing.WindowColumn("x", "SUM", ("k",)), windowing.WindowColumn("x", "NTILE", ("k",), c="v"), windowing.WindowColumn("x", "FIRST", ("k",))):
        with pytest.raises(ValueError):
            windowing.with_windows(df, [bad])
    out = windowing.with_windows(df, [windowing.WindowColumn("s", "SUM", ("k",), (("v", "desc"),), "v", following=0)], ordered=True)
    assert [tuple(r) for r in out.collect()] == [(1, 2, 2), (1, 1, 3)]


def test_unions_keep_row_counts_and_types(spark):
    a, b = spark.createDataFrame([(1, "x")], "i long, s string"), spark.createDataFrame([("2", 5)], "i string, extra int")
    out = sets.union(a, [sets.Child(b, {"i": "i"})])
    assert out.dtypes == a.dtypes and rows(out) == [(1, "x"), (2, None)]
    with pytest.raises(ValueError):
        sets.branches([sets.Branch(a, {"i": F.col("i")})])


def test_cleaning(spark):
    df = spark.createDataFrame([(1, "Null"), (2, None), (3, "  "), (4, "a$1")], "i int, s string")
    got = lambda *op: [r[0] for r in df.orderBy("i").select(cleaning.replaced(F.col("s"), *op)).collect()]
    assert got("FILL_NULL", "", "$1") == ["$1", "$1", "  ", "a$1"] and got("EMPTY", "", "e") == ["Null", "e", "e", "a$1"]
    assert got("TEXT", "A$1", "b") == ["Null", None, "  ", "b"]
    with pytest.raises(ValueError):
        cleaning.find_and_replace(df, ["i"], [("DIGITS", "", "x")])


def test_merge_is_idempotent_and_checks_keys(spark, tmp_path):
    table = upkeep.Table(spark, str(tmp_path / "t"))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    load = upkeep.Load("INCREMENTAL", ("k",))
    assert not table.exists() and rows(upkeep.run(df, table, load)) == rows(df)
    delta = spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string")
    once = rows(upkeep.run(delta, table, load))
    assert once == rows(upkeep.run(delta, table, load)) == [(1, "a"), (2, "B"), (3, "c"), (None, "n")]
    twice = spark.createDataFrame([(5, "x"), (5, "y")], "k int, v string")
    with pytest.raises(ValueError):
        upkeep.run(twice, table, load)
    assert (5, "y") in rows(upkeep.run(twice, table, upkeep.Load("INCREMENTAL", ("k",), latest_by="v")))
    for bad in (upkeep.Load("HEAP"), upkeep.Load("INCREMENTAL", strategy="date"), upkeep.Load("INCREMENTAL", strategy="moon")):
        with pytest.raises(ValueError):
            bad.checked()


def test_append_writes_new_rows_alone(spark, tmp_path):
    table = upkeep.Table(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        table.read()
    for k in range(3):
        upkeep.append(table, spark.range(k, k + 1))
    assert rows(table.read()) == [(0,), (1,), (2,)] and len(list((tmp_path / "t").glob("v-*"))) == 3
    assert rows(upkeep.full(table, spark.range(1))) == [(0,)]
    assert rows(upkeep.add_column(table, "c", "int")) == [(0, None)]


def test_merge_writes_touched_buckets_alone(spark, tmp_path):
    table, load = upkeep.Table(spark, str(tmp_path / "t")), upkeep.Load("INCREMENTAL", ("id",))
    df = spark.range(2000).withColumn("v", F.lit("a"))
    upkeep.run(df, table, load)
    before = set((tmp_path / "t").glob(f"{upkeep.FOLDER}=*"))
    out = upkeep.run(spark.createDataFrame([(5, "b"), (5000, "c")], "id long, v string"), table, load)
    (new,) = set((tmp_path / "t").glob(f"{upkeep.FOLDER}=*")) - before
    assert len(list(new.glob(f"{upkeep.BUCKET}=*"))) <= 2
    assert out.count() == 2001 and rows(out.where("v <> 'a'")) == [(5, "b"), (5000, "c")]
    assert upkeep.run(df.limit(0), table, load).count() == 2001
    assert rows(upkeep.add_column(table, "w", "int").where("id = 5")) == [(5, "b", None)]
    out = upkeep.run(spark.createDataFrame([(5, "d", 7)], "id long, v string, w int"), table, load)
    assert out.count() == 2001 and rows(out.where("w = 7")) == [(5, "d", 7)]
    assert table.vacuum() > 0 and table.read().count() == 2001 and len(table._versions()) == 1
    empty = upkeep.Table(spark, str(tmp_path / "e"))
    assert upkeep.run(df.limit(0), empty, load).count() == 0 and upkeep.run(df, empty, load).count() == 2000


def test_a_table_keeps_its_buckets_and_odd_key_names(spark, tmp_path):
    df = spark.range(200).select(F.col("id").alias("a key"), F.lit("x").alias("v"))
    load = upkeep.Load("INCREMENTAL", ("a key",))
    upkeep.run(df, upkeep.Table(spark, str(tmp_path / "t"), 4), load)
    again = upkeep.Table(spark, str(tmp_path / "t"))
    out = upkeep.run(df.where("`a key` < 3").withColumn("v", F.lit("y")), again, load)
    assert again.buckets == 4 and out.count() == 200 and out.where("v = 'y'").count() == 3
    assert all(b < 4 for _, bs, _ in again._version()[1] for b in bs)


def test_two_writers_cannot_take_one_version(spark, tmp_path):
    a, b = (upkeep.Table(spark, str(tmp_path / "t")) for _ in range(2))
    a.write(spark.range(1))
    number, parts, keys = a._version()
    b.write(spark.range(2))
    with pytest.raises(upkeep.Conflict):
        a._commit(number + 1, parts, keys)
    assert rows(a.read()) == [(0,), (1,)]


def test_null_keys_are_one_another(spark, tmp_path):
    old = spark.createDataFrame([(None, "n"), (1, "a"), (2, "")], "k int, v string")
    assert upkeep.changed_rows(old, old, {"key_columns": ["k"]}).count() == 0
    new = spark.createDataFrame([(None, "m"), (1, "a"), (2, None)], "k int, v string")
    assert rows(upkeep.changed_rows(new, old, {"key_columns": ["k"]})) == [(2, None), (None, "m")]
    table, load = upkeep.Table(spark, str(tmp_path / "t")), upkeep.Load("INCREMENTAL", ("k",), "checksum", {"key_columns": ["k"]})
    upkeep.run(old, table, load)
    for _ in range(2):
        assert rows(upkeep.run(new, table, load)) == [(1, "a"), (2, None), (None, "m")]


def test_overrides_and_fallback(spark, tmp_path):
    table, load = upkeep.Table(spark, str(tmp_path / "t")), upkeep.Load("INCREMENTAL", ("k",), "full_scan")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    upkeep.run(df, table, load)
    assert rows(upkeep.run(df.where("k = 1"), table, load, materialization="TABLE")) == [(1, "a")]
    assert rows(upkeep.run(df, table, load, materialization="VIEW")) == rows(df) and table.read().count() == 1

    def fails(*_):
        raise RuntimeError("no delta")

    assert rows(upkeep.run_or_reload(df, table, load, strategy="custom", options={"function": fails})) == rows(df)
    with pytest.raises(ValueError):
        upkeep.run_or_reload(df.unionAll(df), table, load, strategy="custom", options={"function": fails})
    only = upkeep.run(df.withColumn("v", F.lit("z")), table, load, strategy="custom", options={"function": lambda s, d, o: s.where("k = 2")})
    assert rows(only) == [(1, "a"), (2, "z")]


def test_filter_values_follow_the_column(spark):
    df = spark.createDataFrame([("12", 12, "true"), ("abc", 3, "x"), ("012", 5, "12")], "c string, n int, b string")
    got = lambda *c: [r.n for r in filters.where(df, [filters.Condition(*c)]).orderBy("n").collect()]
    assert got("c", "EQ", "12") == [12] and got("c", "IN", "12,abc") == [3, 12] and got("c", "NEQ", 12) == [3, 5] and got("n", "IN", "3, 5") == [3, 5]
    assert got("b", "EQ", "true") == [12] and got("n", "GT", "4") == [5, 12] and got("c", "BETWEEN", ["0", "2"]) == [5, 12]


def test_windows_in_aggregates_are_known_by_the_plan(spark):
    df = spark.range(4).withColumn("a OVER b", F.col("id") % 2)
    assert rows(aggregates.grouped(df, ["a OVER b"], {"x": F.max(F.lit(" OVER "))})) == [(0, " OVER "), (1, " OVER ")]
    for bad in (F.sum("id").over(Window.partitionBy("a OVER b")), F.row_number().over(Window.orderBy("a OVER b")), F.sum(F.sum("id")).over(Window.partitionBy("a OVER b"))):
        with pytest.raises(ValueError):
            aggregates.grouped(df, ["a OVER b"], {"x": bad})
    for small in (False, True):
        assert rows(windowing.with_windows(df, [windowing.WindowColumn("r", "ROW_NUMBER", order=(("id", "asc"),), whole_table=small)]).select("id", "r")) == [(i, i + 1) for i in range(4)]


def test_quantiles_of_whole_columns(spark):
    rng = random.Random(3)
    values = [rng.choice([None, 1.5, 7.25, rng.uniform(-9, 9)]) for _ in range(501)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = maths.with_statistics(df, a=maths.median("v"), b=maths.quantile("v", 0.137), c=maths.quantile("v", 1.0), n=F.count("v")).first()
    there = np.array([v for v in values if v is not None])
    assert [got.a, got.b, got.c] == pytest.approx(np.quantile(there, [0.5, 0.137, 1.0]).tolist()) and got.n == len(there)
    assert maths.with_statistics(df.limit(0).unionAll(spark.createDataFrame([(None,)], "v double")), a=maths.median("v")).first().a is None


def test_units_of_truncation():
    with pytest.raises(ValueError):
        dates.date_trunc(F.lit("2024-01-01"), "moon")


def test_downstream_models_load_what_they_need(spark):
    built = []
    m = {n: models.Model(n, i, lambda *d: d[0]) for n, i in {"a": ("src",), "b": ("a",), "c": ("b", "d"), "d": ("src",)}.items()}
    df = spark.range(1)
    models.run(m, {"src": df}, ["b"], keep=lambda n, x: built.append(n) or x, load=lambda n: built.append(f"load {n}") or df)
    assert built == ["load a", "load d", "b", "c"]


def test_kept_marks_and_plans(spark, tmp_path):
    table = upkeep.Table(spark, str(tmp_path / "marks"))
    one, two = spark.range(5), spark.range(9)
    assert upkeep.advance_kept(one, "id", "long", table).first().rows == 5
    second = upkeep.advance_kept(two, "id", "long", table).first()
    assert (second.old_value, second.new_value, second.rows) == ("4", "8", 4)
    third = upkeep.advance_kept(two.limit(0), "id", "long", table).first()
    assert (third.old_value, third.new_value, third.rows) == ("8", "8", 0) and table.read().count() == 3
    plans = models.compiled(spark, {"m": two.where("id > 3")}, upkeep.Table(spark, str(tmp_path / "plans"))).collect()
    assert [p.model for p in plans] == ["m"] and "Filter" in plans[0].plan


def test_history_refuses_repeated_keys(spark):
    h, a = history.History(("k",), check=("v",)), spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(ValueError):
        history.advanced(history.first(a, h, "2024-01-01"), spark.createDataFrame([(1, "b"), (1, "c")], "k int, v string"), h, "2024-02-01")


def test_empty_destination_is_a_first_run(spark):
    src = spark.createDataFrame([(1,), (None,)], "c int")
    assert upkeep.above_mark(src, src.limit(0), {"column": "c"}).count() == 2
    assert upkeep.above_mark(src, src.where("c = 1"), {"column": "c"}).count() == 0
    assert upkeep.has_new(src, "c", 0) and not upkeep.has_new(src, "c", 1)


def test_history_has_one_open_version_a_key(spark):
    h = history.History(("k",), check=("v",))
    a = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    b = spark.createDataFrame([(1, "b", 7), (2, None, 7), (3, "c", 7)], "k int, v string, extra int")
    snap = history.advanced(history.first(a, h, "2024-01-01"), b, h, "2024-02-01")
    assert snap.where("scd_valid_to IS NULL").count() == 3 and snap.count() == 4
    assert snap.where("k = 1 AND scd_valid_to IS NULL").first().extra == 7
    for bad in (history.History(()), history.History(("k",)), history.History(("k",), check=("zz",)), history.History(("k",), "v", ("v",))):
        with pytest.raises(ValueError):
            history.first(a, bad, "2024-01-01")


def test_model_selection():
    m = {n: models.Model(n, i, lambda *d: d[0]) for n, i in {"a": ("src",), "b": ("a",), "c": ("b",), "d": ("src",)}.items()}
    assert models.order(m) == ["a", "d", "b", "c"]
    assert models.selected(m, ["b"]) == ["a", "b"] and models.selected(m, exclude=["b"]) == ["a", "d"] and models.below(m, {"a"}) == {"a", "b", "c"}
    with pytest.raises(ValueError):
        models.selected(m, ["b"], ["b"])


def test_lineage_and_contracts(spark):
    m = {"b": models.Model("b", ("src", "a"), None, {"a": "join"}), "a": models.Model("a", ("src",), None)}
    assert ("a", "b", "join", "model") in rows(models.lineage(spark, m))
    old, new = spark.createDataFrame([], "x int, y int"), spark.createDataFrame([], "x string")
    assert rows(models.broken_columns(old, new, {"m": ["x", "y"]})) == [("m", "x", "type"), ("m", "y", "missing")]


def test_seeds(spark, tmp_path):
    good, bad = tmp_path / "my seed-1.csv", tmp_path / "bad.csv"
    good.write_text('id,the date,"a/b (c)"\n1,2024-01-02 03:04:05,x\n2,2024-02-02 03:04:05,\n')
    df = sources.seed(spark, str(good))
    assert df.dtypes == [("id", "int"), ("the_date", "timestamp"), ("a_b_c", "string")]
    assert sources.table_name(str(good)) == "my_seed_1"
    bad.write_text("$$,b\n1,2\n")
    out = {r.path: r.ok for r in sources.load_seeds(spark, [str(good), str(bad)]).collect()}
    assert out == {str(good): True, str(bad): False}
    assert sources.scan(spark, "my_seed_1").count() == 2
    assert ("default", "my_seed_1", "id", "int", True) in rows(sources.listing(spark))
    for sql in ("DELETE FROM t", "truncate table t"):
        with pytest.raises(ValueError):
            sources.query(spark, sql)
    assert sources.query(spark, "SELECT 'DELETE' AS x").count() == 1
    long = spark.createDataFrame([("z" * 300,)], "s string")
    assert sources.sample(long).first().s.endswith("...(truncated)") and rows(sources.columns(long)) == [("s", "string", True, "String")]


def test_jdbc(spark, tmp_path):
    """A database that Spark brings along, in memory of this process."""
    url = f"jdbc:derby:memory:{tmp_path.name};create=true"
    spark.range(100).selectExpr("id", "'n' || id AS name").write.jdbc(url, "things", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    df = sources.jdbc(spark, url, "things", "ID", 0, 100, 4, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert df.rdd.getNumPartitions() == 4 and df.count() == 100 and df.where("ID = 7").first()[1] == "n7"


def test_dump_and_restore(spark, tmp_path):
    df = spark.range(5)
    upkeep.dump({"r": df}, str(tmp_path / "d"))
    assert upkeep.restore(spark, ["r"], str(tmp_path / "d"))["r"].count() == 5


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
