"""Stored tables under odd keys, many appends, repeated batches; stored histories; digests."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from weft.functions import maths
from weft.operators import aggregates, filters
from weft.plans import history, models, upkeep
from weft.streaming import loads


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_merges_do_not_depend_on_the_time_zone(spark, tmp_path):
    df = spark.range(400).select(F.timestamp_seconds(F.col("id") * 3600).alias("t"), F.lit("old").alias("v"))
    load = upkeep.Load("INCREMENTAL", ("t",))
    table = upkeep.Table(spark, str(tmp_path / "t"))
    upkeep.run(df, table, load)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        upkeep.run(df.where("t = timestamp_seconds(36000)").withColumn("v", F.lit("new")), table, load)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    out = table.read()
    assert out.count() == out.select("t").distinct().count() == 400 and out.where("v = 'new'").count() == 1


def test_zero_and_minus_zero_are_one_key(spark, tmp_path):
    load, table = upkeep.Load("INCREMENTAL", ("k",)), upkeep.Table(spark, str(tmp_path / "t"))
    kind = "k double, v string"
    upkeep.run(spark.createDataFrame([(0.0, "a"), (1.5, "b"), (float("nan"), "c"), (None, "d")], kind), table, load)
    out = upkeep.run(spark.createDataFrame([(-0.0, "z"), (float("nan"), "y"), (None, "x")], kind), table, load)
    assert sorted(r.v for r in out.collect()) == ["b", "x", "y", "z"]


def test_a_delta_takes_the_types_of_the_table(spark, tmp_path):
    load, table = upkeep.Load("INCREMENTAL", ("k",)), upkeep.Table(spark, str(tmp_path / "t"))
    upkeep.run(spark.createDataFrame([(1, 1, "a"), (2, 2, "b")], "k int, n int, v string"), table, load)
    delta = spark.createDataFrame([("2", 7, 9), ("3", 8, 9)], "k string, n long, v int")
    out = upkeep.run(delta, table, load)
    assert out.dtypes == [("k", "int"), ("n", "int"), ("v", "string")] and rows(out) == [(1, 1, "a"), (2, 7, "9"), (3, 8, "9")]
    with pytest.raises(Exception, match="CAST_INVALID|CAST_OVERFLOW"):
        upkeep.run(spark.createDataFrame([(1 << 40, 1, "x")], "k long, n int, v string"), table, load)
    assert rows(table.read()) == [(1, 1, "a"), (2, 7, "9"), (3, 8, "9")]


def test_tables_cut_by_text_are_cut_anew(spark, tmp_path):
    load, table = upkeep.Load("INCREMENTAL", ("k",)), upkeep.Table(spark, str(tmp_path / "t"))
    df = spark.range(50).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    upkeep.run(df, table, load)
    file = tmp_path / "t" / "current" / "00000001" / "part-0"
    file.write_text(file.read_text().replace(', "typed"', ""))
    (file.parent / ".part-0.crc").unlink()
    assert table._version()[2] == [] and table.read().count() == 50
    out = upkeep.run(df.where("k = 3").withColumn("v", F.lit("b")), table, load)
    assert out.count() == 50 and rows(out.where("v = 'b'")) == [(3, "b")] and table._version()[2] == ["k"]


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation ")


def test_many_appends_are_few_scans_and_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(upkeep, "FOLDERS", 10)
    table = upkeep.Table(spark, str(tmp_path / "t"))
    for k in range(35):
        table.write(spark.range(k, k + 1), keep=True)
        assert scans(table.read()) == 1 and len(table._version()[1]) <= 11
    assert rows(table.read()) == sorted([(k,) for k in range(35)], key=repr)
    upkeep.add_column(table, "c", "int")
    for k in range(3):
        upkeep.append(table, spark.createDataFrame([(100 + k, k)], "id long, c int"))
    assert scans(table.read()) == 2 and table.read().where("c IS NOT NULL").count() == 3
    keyed, load = upkeep.Table(spark, str(tmp_path / "k"), 4), upkeep.Load("INCREMENTAL", ("id",))
    upkeep.run(spark.range(20).withColumn("v", F.lit(0)), keyed, load)
    for k in range(6):
        upkeep.run(spark.createDataFrame([(k, k + 1), (100 + k, 0)], "id long, v int"), keyed, load)
        upkeep.append(keyed, spark.createDataFrame([(200 + k, 7), (201 + k, 7)], "id long, v int"))
    out = keyed.read()
    assert scans(out) == 1 and out.count() == 20 + 6 + 12 and out.where("id < 6 AND v = id + 1").count() == 6 and len(keyed._version()[1]) <= 12


def test_a_batch_counts_once(spark, tmp_path):
    table, df = upkeep.Table(spark, str(tmp_path / "t")), spark.range(3)
    assert loads.load_batch(table, df, [], "s", 0) and not loads.load_batch(table, df, [], "s", 0)
    assert loads.load_batch(table, df, [], "s", 1) and loads.load_batch(table, df, [], "other", 0) and table.read().count() == 9
    upkeep.append(table, df)
    table.compact()
    assert table.marks() == {"s": 1, "other": 0} and not loads.load_batch(table, df, [], "s", 1) and table.read().count() == 12


def test_a_stream_that_starts_again_is_not_loaded_twice(spark, tmp_path):
    """Spark forgets that the last batch is done, as after a driver lost between the version and the note of it."""
    table, place = upkeep.Table(spark, str(tmp_path / "t")), tmp_path / "in"
    spark.range(5).write.parquet(str(place))

    def load():
        loads.upsert(spark.readStream.schema("id long").parquet(str(place)), table, [], str(tmp_path / "c")).awaitTermination()

    load()
    assert len(table.marks()) == 1 and table.read().count() == 5
    for f in (tmp_path / "c" / "commits").iterdir():
        f.unlink()
    load()
    assert table.read().count() == 5
    spark.range(5, 7).write.mode("append").parquet(str(place))
    load()
    assert rows(table.read()) == [(k,) for k in range(7)]


def test_repeats_and_late_events(spark, tmp_path):
    table, place, at = upkeep.Table(spark, str(tmp_path / "t")), str(tmp_path / "in"), dt.datetime(2024, 1, 1)
    for n, new in enumerate([[(1, 0), (1, 1), (2, 5)], [(2, 6), (3, 40)], [(4, 41), (9, 2)], [(3, 45)]]):
        spark.createDataFrame([(k, at + dt.timedelta(minutes=m)) for k, m in new], "id long, ts timestamp").write.mode("append").parquet(place)
        stream = loads.deduplicated(spark.readStream.schema("id long, ts timestamp").parquet(place), ["id"], "ts", "10 minutes")
        loads.upsert(stream, table, [], str(tmp_path / "c")).awaitTermination()
    # 9 came more than ten minutes late.
    assert sorted(r.id for r in table.read().collect()) == [1, 2, 3, 4]


def test_digests_leave_equal_parts_alone(spark):
    old = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    new = old.where("k <> 17").withColumn("v", F.when(F.col("k") == 40, 99).otherwise(F.col("v"))).unionByName(spark.createDataFrame([(6000, 1), (None, 2)], "k long, v long"))
    options = {"key_columns": ["k"], "buckets": 256}
    assert rows(upkeep.changed_rows(new, old, options)) == rows(new.where("k IN (40, 6000) OR k IS NULL"))
    assert upkeep.changed_rows(old, old, options).count() == 0 and upkeep.changed_rows(new, old.limit(0), options).count() == new.count()


H = history.History(("k", "g"), check=("v",), close_missing=True)


def test_null_keys_have_a_history(spark):
    a = spark.createDataFrame([(None, 1, "a"), (1, None, "b")], "k int, g int, v string")
    snap = history.first(a, H, "2024-01-01")
    for day in ("2024-01-02", "2024-01-03"):
        snap = history.advanced(snap, a, H, day)
    assert snap.count() == 2 and snap.where("scd_valid_to IS NULL").count() == 2
    b = spark.createDataFrame([(None, 1, "A")], "k int, g int, v string")
    snap = history.advanced(snap, b, H, "2024-01-04")
    assert snap.count() == 3 and snap.where("scd_valid_to IS NULL").count() == 1
    with pytest.raises(ValueError, match="repeated"):
        history.first(b.unionAll(b), H, "2024-01-01")


def test_stored_histories_write_changes_alone(spark, tmp_path):
    table = upkeep.Table(spark, str(tmp_path / "h"))
    first = spark.range(1000).select(F.col("id").cast("int").alias("k"), F.lit(None).cast("int").alias("g"), F.lit("a").alias("v"))
    snap = history.first(first, H, "2024-01-01")
    history.advance_stored(table, first, H, "2024-01-01")
    looks = [first.withColumn("v", F.when(F.col("k") < 10, "b").otherwise(F.col("v"))), first.where("k <> 500").withColumn("extra", F.lit(1)), first, first]
    for n, look in enumerate(looks, 2):
        snap = history.advanced(snap, look, H, f"2024-01-0{n}")
        got = history.advance_stored(table, look, H, f"2024-01-0{n}")
        assert rows(got.select(snap.columns)) == rows(snap)
        written = [table.spark.read.parquet(f"{table.path}/{f}").count() for f, *_ in table._version()[1]]
    assert written == [1000, 20, 21, 1]  # The last look found nothing new.
    assert rows(history.settle(table).select(snap.columns)) == rows(snap) and len(table._version()[1]) == 1
    assert rows(history.advance_stored(table, first.limit(0), H, "2024-02-01").where("scd_valid_to IS NULL")) == []


def test_values_that_a_type_cannot_read(spark):
    df = spark.createDataFrame([(1, True, dt.date(2024, 1, 1), 2.5), (1000, False, None, -1.0), (None, None, None, None)], "n int, b boolean, d date, x double")
    got = lambda *c: [r.n for r in filters.where(df, [filters.Condition(*c)]).orderBy("n").collect()]
    assert got("n", "EQ", "abc") == got("n", "GT", "") == got("n", "IN", "abc,") == got("n", "BETWEEN", ["0", "x"]) == got("n", "EQ", "1_000") == got("d", "EQ", "2024-02-30") == got("d", "LT", "never") == []
    assert got("n", "IN", "1,abc") == [1] and got("n", "NEQ", "abc") == got("n", "NOTIN", "abc") == [1, 1000] and got("n", "NOTIN", "abc,1") == [1000]
    assert got("b", "EQ", "1") == got("b", "EQ", "yes") == got("b", "EQ", True) == [1] and got("b", "EQ", "2") == [] and got("x", "GTE", "2.5") == got("n", "LT", "1.5") == got("d", "EQ", "2024-1-1") == [1]


def test_pivot_finds_names(spark, monkeypatch):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 3), (2, None, 4)], "r int, c string, v int")
    out = aggregates.pivoted(df, "r", "c", "v", aggregator="SUM")
    assert out.columns == ["r", "a", "b"] and rows(out) == [(1, 3, 2), (2, None, None)]
    monkeypatch.setattr(aggregates, "PIVOT_NAMES", 1)
    with pytest.raises(ValueError, match="more than 1"):
        aggregates.pivoted(df, "r", "c", "v")


def test_quantiles_are_exact_and_share_a_write(spark, monkeypatch):
    big = 1 << 60
    df = spark.createDataFrame([(big + k, float(k), k) for k in range(101)], "i long, d double, k int").withColumn("m", F.col("k").cast("decimal(12,4)"))
    writes = []
    monkeypatch.setattr(maths, "kept", lambda d, real=maths.kept: writes.append(1) or real(d))
    got = maths.with_statistics(df, a=maths.median("i"), b=maths.quantile("d", 0.255), c=maths.quantile("m", 1.0), low=maths.quantile("d", 0.0), e=maths.quantile("k", 0.1), n=F.max("k")).first()
    assert tuple(got)[-6:] == (float(big + 50), pytest.approx(25.5), 100.0, 0.0, 10.0, 100) and len(writes) == 1


def test_lineage_of_columns(spark):
    src = {"s": spark.createDataFrame([], "a int, b int, c string, d array<int>"), "t": spark.createDataFrame([], "a int, z int")}
    m = {
        "x": models.Model("x", ("s", "t"), lambda s, t: s.join(t, s["a"] == t["a"], "left").where("c <> ''").groupBy(s["a"]).agg(F.sum(F.col("b") * F.col("z")).alias("n"))),
        "y": models.Model("y", ("x", "s"), lambda x, s: x.select(F.col("n").alias("u"), F.lit(1).alias("one")).unionAll(s.select("b", "a")).withColumn("r", F.rank().over(__import__("pyspark").sql.Window.orderBy("u")))),
        "w": models.Model("w", ("s",), lambda s: s.alias("l").join(s.alias("r"), F.col("l.a") == F.col("r.b")).select(F.col("r.c").alias("q"), F.explode("l.d").alias("e"))),
    }
    got = rows(models.column_lineage(spark, m, src))
    assert got == sorted([("s", "a", "x", "a"), ("s", "b", "x", "n"), ("t", "z", "x", "n"), ("x", "n", "y", "u"), ("s", "b", "y", "u"), ("s", "a", "y", "one"), ("x", "n", "y", "r"), ("s", "b", "y", "r"), ("s", "c", "w", "q"), ("s", "d", "w", "e")], key=repr)
    assert models.needed_columns(m, src, "s") == {"x": ["a", "b", "c"], "y": ["a", "b"], "w": ["a", "b", "c", "d"]}
    assert models.needed_columns(m, src, "t") == {"x": ["a", "z"]}


def test_models_side_by_side(spark, tmp_path):
    import threading

    both, seen = threading.Barrier(2, timeout=60), []

    def keep(name, df):
        if name in ("a", "b"):
            both.wait()  # Passes only if both run at once.
        seen.append(name)
        return upkeep.full(upkeep.Table(spark, str(tmp_path / name)), df)

    def fails(_):
        raise RuntimeError("no")

    m = {n: models.Model(n, i, f) for n, i, f in [("a", ("src",), lambda d: d), ("b", ("src",), lambda d: d), ("c", ("a", "b"), lambda x, y: x.unionAll(y)), ("bad", ("a",), fails), ("below", ("bad", "c"), lambda x, y: y)]}
    out = models.run_side_by_side(m, {"src": spark.range(3)}, keep, at_once=2)
    assert list(out.done) == ["a", "b", "c"] and out.done["c"].count() == 6 and isinstance(out.failed["bad"], RuntimeError) and out.skipped == ["below"]
    assert sorted(seen) == ["a", "b", "c"]
    assert list(models.run_side_by_side(m, {"src": spark.range(3)}, lambda n, d: d, ["a"]).done) == ["a"]
