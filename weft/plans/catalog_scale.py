"""Registered queries of what is cut over many tasks or kept between runs: whole-table windows, range joins, streams,
stored histories. With the SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.operators import aggregates, cleaning, joins, windowing
from weft.sources import tables as sources
from weft.streaming import loads

from . import catalog_tables, history, models, upkeep
from .scratch import scratch, scratch_table

QUERIES, ORACLES = {}, {}
C, W = F.col, windowing.WindowColumn


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _add(sql: str | None):  # noqa: ANN202
    def note(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return note


_LINE = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
_CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"


@_add(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER w AS rn, lag(l_quantity, 3) OVER w AS prev3, lead(l_shipdate) OVER w AS next_date,
  CAST(sum({_CENTS}) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cents, max(l_tax) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tax_ahead,
  round(avg(CAST(l_quantity AS BIGINT)) OVER (w ROWS BETWEEN 100 PRECEDING AND 20 FOLLOWING), 6) AS near, count(*) OVER () AS n
  FROM lineitem WINDOW w AS (ORDER BY {", ".join(_LINE)})""")
def window_whole_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = tuple((c, "asc") for c in _LINE)
    cents = F.round(C("l_extendedprice") * 100).cast("bigint")
    d = windowing.with_windows(_read(spark, sf_dir, "lineitem").select(*_LINE, "l_tax"), [
        W("rn", "ROW_NUMBER", (), order), W("prev3", "LAG", (), order, "l_quantity", 3), W("next_date", "LEAD", (), order, "l_shipdate"), W("cents", "SUM", (), order, cents, preceding="unbounded", following=0),
        W("tax_ahead", "MAX", (), order, "l_tax", preceding=0), W("near", "AVG", (), order, C("l_quantity").cast("bigint"), preceding=100, following=20), W("n", "COUNT", c="l_orderkey"),
    ])
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "rn", "prev3", "next_date", "cents", "tax_ahead", F.round("near", 6).alias("near"), "n")


@_add("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, rank() OVER w AS rk, dense_rank() OVER w AS dr, round(percent_rank() OVER w, 9) AS pr FROM lineitem WINDOW w AS (ORDER BY l_shipdate DESC NULLS LAST, l_quantity NULLS LAST)""")
def window_whole_table_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = (("l_shipdate", "desc"), ("l_quantity", "asc"))
    d = windowing.with_windows(_read(spark, sf_dir, "lineitem"), [W("rk", "RANK", (), order), W("dr", "DENSE_RANK", (), order), W("pr", "PERCENT_RANK", (), order)])
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "rk", "dr", F.round("pr", 9).alias("pr"))


@_add(f"""WITH t AS (SELECT *, CASE WHEN l_orderkey % 10 = 0 THEN l_returnflag ELSE 'hot' END AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, k, row_number() OVER w AS rn, CAST(sum({_CENTS}) OVER (w ROWS BETWEEN 50 PRECEDING AND 10 FOLLOWING) AS BIGINT) AS near,
  CAST(sum({_CENTS}) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cents, CAST(sum({_CENTS}) OVER (PARTITION BY k) AS BIGINT) AS total, count(*) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead,
  first_value(l_linestatus) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_status, min(l_discount) OVER (w ROWS BETWEEN 30 PRECEDING AND 5 PRECEDING) AS lo
  FROM t WINDOW w AS (PARTITION BY k ORDER BY {", ".join(_LINE)})""")
def window_hot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    order, part = tuple((c, "asc") for c in _LINE), ("k",)
    cents = F.round(C("l_extendedprice") * 100).cast("bigint")
    d = _read(spark, sf_dir, "lineitem").withColumn("k", F.when(C("l_orderkey") % 10 == 0, C("l_returnflag")).otherwise("hot"))
    d = windowing.with_windows(d, [
        W("rn", "ROW_NUMBER", part, order, split=True), W("near", "SUM", part, order, cents, preceding=50, following=10, split=True), W("cents", "SUM", part, order, cents, preceding="unbounded", following=0, split=True), W("total", "SUM", part, order, cents, split=True),
        W("ahead", "COUNT", part, order, "l_orderkey", preceding=0, split=True), W("first_status", "FIRST", part, order, "l_linestatus", split=True), W("lo", "MIN", part, order, "l_discount", preceding=30, following=-5, split=True),
    ])
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "k", "rn", "near", "cents", "total", "ahead", "first_status", "lo")


@_add("""SELECT o_orderkey, event_id, event_type FROM orders JOIN (SELECT *, value * 1000 - 20 AS lo, value * 1000 + 20 AS hi FROM events) e ON o_totalprice >= lo AND o_totalprice <= hi""")
def join_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").select("event_id", "event_type", (C("value") * 1000 - 20).alias("lo"), (C("value") * 1000 + 20).alias("hi"))
    return joins.join(_read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), joins.Right(e, "events", "inner", (("o_totalprice", "GTE", "lo"), ("o_totalprice", "LTE", "hi")))).select("o_orderkey", "event_id", "event_type")


@_add("SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_acctbal < c_acctbal")
def join_less_than(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), _read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return joins.join(s, joins.Right(c, "customer", "full", (("s_acctbal", "LT", "c_acctbal"),))).select("s_suppkey", "c_custkey")


@_add("SELECT event_id, user_id, value FROM events")
def stream_append_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream without keys, whose batches all come twice."""
    table, given = scratch_table(spark), _read(spark, sf_dir, "events").select("event_id", "user_id", "value")
    for number in range(3):
        for _ in range(2):
            loads.load_batch(table, given.where(C("event_id") % 3 == number), [], "events", number)
    return table.read()


@_add("SELECT event_id, user_id FROM events")
def stream_without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in four slices of time; each slice brings a part of the one before again, and long after their time some events
    of the first slice under new ids."""
    table, place = scratch_table(spark), scratch(spark)
    given = _read(spark, sf_dir, "events").select("event_id", "user_id", C("ts").cast("timestamp").alias("at"))
    ends = given.select(F.min("at").cast("double").alias("a"), F.max("at").cast("double").alias("b"))
    sliced = given.crossJoin(F.broadcast(ends)).withColumn("n", F.least(F.lit(3), F.floor((C("at").cast("double") - C("a")) * 4 / (C("b") - C("a"))))).select(*given.columns, "n")
    quarter = f"{int(ends.select(F.ceil((C('b') - C('a')) / 4)).first()[0]) + 1} seconds"
    for n in range(4):
        new, again = sliced.where(C("n") == n), sliced.where((C("n") == n - 1) & (C("user_id") % 2 == 0))
        late = sliced.where((C("n") == 0) & (F.lit(n) == 3)).withColumn("event_id", -1 - C("event_id"))
        new.unionByName(again).unionByName(late).drop("n").write.mode("append").parquet(place)
        stream = spark.readStream.schema(given.schema).parquet(place)
        loads.upsert(loads.deduplicated(stream, ["event_id"], "at", quarter), table, [], f"{place}-checkpoint").awaitTermination()
    return table.read().select("event_id", "user_id")


HISTORY = history.History(("c_custkey",), check=("c_acctbal", "c_mktsegment"), close_missing=True)


@_add("""WITH v AS (SELECT *, c_custkey % 5 = 0 AS changed, c_custkey % 7 = 0 AS gone, c_custkey % 3 = 0 AS late FROM customer)
SELECT c_custkey, c_acctbal, CAST('2024-01-01' AS TIMESTAMP) AS scd_valid_from, CASE WHEN changed OR gone THEN CAST('2024-02-01' AS TIMESTAMP) END AS scd_valid_to FROM v WHERE NOT late
UNION ALL SELECT c_custkey, CASE WHEN changed THEN c_acctbal + 1 ELSE c_acctbal END, CAST('2024-02-01' AS TIMESTAMP), NULL FROM v WHERE NOT gone AND (late OR changed)
UNION ALL SELECT c_custkey, c_acctbal, CAST('2024-04-01' AS TIMESTAMP), NULL FROM v WHERE gone""")
def history_in_a_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five looks: the first, changes with leavers, the same again, the leavers' return beside the others, the same again."""
    c, table = _read(spark, sf_dir, "customer"), scratch_table(spark)
    now = c.where("c_custkey % 7 <> 0").withColumn("c_acctbal", C("c_acctbal") + (C("c_custkey") % 5 == 0).cast("int"))
    back = now.unionByName(c.where("c_custkey % 7 = 0"))
    looks = [(c.where("c_custkey % 3 <> 0"), "2024-01-01"), (now, "2024-02-01"), (now, "2024-03-01"), (back, "2024-04-01"), (back, "2024-05-01")]
    for source, at in looks:
        history.advance_stored(table, source, HISTORY, at)
    return history.stored(table).select("c_custkey", "c_acctbal", "scd_valid_from", "scd_valid_to")


def _given(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {n: _read(spark, sf_dir, n) for n in ("lineitem", "orders", "customer")}


@_add("""WITH e(from_table, from_column, to_table, to_column) AS (VALUES ('lineitem', 'l_orderkey', 'order_lines', 'l_orderkey'), ('lineitem', 'l_extendedprice', 'order_lines', 'lines_total'),
  ('order_lines', 'l_orderkey', 'order_facts', 'l_orderkey'), ('order_lines', 'lines_total', 'order_facts', 'lines_total'), ('order_lines', 'lines', 'order_facts', 'lines'),
  ('order_facts', 'o_custkey', 'customer_value', 'o_custkey'), ('order_facts', 'o_totalprice', 'customer_value', 'total'), ('order_facts', 'lines', 'customer_value', 'lines')
  UNION ALL SELECT 'orders', c, 'order_facts', c FROM unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) t(c)
  UNION ALL SELECT 'customer', c, 'customer_value', c FROM unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) t(c)),
n AS (SELECT 'lineitem' AS from_table, count(*) AS rows FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'customer', count(*) FROM customer)
SELECT e.*, rows FROM e LEFT JOIN n USING (from_table)""")
def models_column_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column lineage of the example models, read from their plans, with the rows of each source."""
    given = _given(spark, sf_dir)
    rows = [sources.row_count(d).withColumn("from_table", F.lit(n)) for n, d in given.items()]
    return models.column_lineage(spark, catalog_tables._models(), given).join(rows[0].unionByName(rows[1]).unionByName(rows[2]), "from_table", "left")


@_add("""SELECT model, "column", why, (SELECT count(*) FROM orders) AS rows FROM (VALUES ('order_facts', 'o_custkey', 'missing'), ('order_facts', 'o_totalprice', 'type')) t(model, "column", why)""")
def models_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What breaks where orders lose a column and change the type of another one."""
    given = _given(spark, sf_dir)
    after = given["orders"].drop("o_custkey").withColumn("o_totalprice", C("o_totalprice").cast("string"))
    broken = models.broken_columns(given["orders"], after, models.needed_columns(catalog_tables._models(), given, "orders"))
    return broken.crossJoin(F.broadcast(given["orders"].agg(F.count(F.lit(1)).alias("rows"))))


@_add("""SELECT c_custkey, orders, total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def models_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The example models beside one that fails and one made from it, which alone are missing."""
    m = models.Model
    graph = catalog_tables._models() | {"wrong": m("wrong", ("orders",), lambda o: o.select(F.raise_error(F.lit("no"))).limit(1)), "after": m("after", ("wrong",), lambda d: d)}
    out = models.run_side_by_side(graph, _given(spark, sf_dir), lambda n, d: upkeep.full(scratch_table(spark), d))
    if (sorted(out.failed), out.skipped) != (["wrong"], ["after"]):
        raise ValueError("models stopped that should not, or the other way round")
    return out.done["customer_value"].select("c_custkey", "orders", "total")


@_add("""SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY o_custkey""")
def pivot_found_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.pivoted(_read(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", "o_orderkey", aggregator="COUNT", fill=0)


@_add("""SELECT o_orderkey FROM orders WHERE o_totalprice > 50000 OR o_orderdate < TIMESTAMP '1992-02-01' AND o_orderkey NOT IN (5, 7)""")
def filter_unreadable_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that a column's type can't read match nothing, and differ from all."""
    q = catalog_tables.filters.Condition
    return catalog_tables.filters.where(_read(spark, sf_dir, "orders"), [
        q("o_totalprice", "GT", "5e4"), q("o_totalprice", "EQ", "much", "OR"), q("o_orderkey", "IN", "1_000,x", "OR"), q("o_orderdate", "LT", "1992-02-01", "OR"), q("o_orderkey", "NOTIN", "5,abc,7"), q("o_orderkey", "NEQ", "abc"),
        q("o_orderdate", "GT", "soon", "OR"),
    ]).select("o_orderkey")


@_add("""SELECT o_orderkey, k AS middle FROM orders, (SELECT quantile_cont(o_orderkey, 0.5) AS k FROM orders) WHERE o_orderkey <= 3""")
def quantile_of_whole_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.functions import maths

    return maths.with_statistics(_read(spark, sf_dir, "orders").select("o_orderkey"), middle=maths.median("o_orderkey")).where("o_orderkey <= 3")


@_add("""SELECT column_name AS "column", CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' END AS type,
  CASE data_type WHEN 'VARCHAR' THEN 'String' WHEN 'TIMESTAMP' THEN 'Time' ELSE 'Number' END AS kind, (SELECT count(*) FROM orders) AS rows FROM information_schema.columns WHERE table_name = 'orders'""")
def source_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of a table as the catalog lists it, with their kinds and the table's rows."""
    d, name = _read(spark, sf_dir, "orders"), f"listed_{uuid.uuid4().hex}"
    d.createTempView(name)
    try:
        listed = sources.listing(spark).where(C("table") == name).select("column", "type").distinct()
        return listed.join(sources.columns(d).select("column", "kind"), "column").crossJoin(F.broadcast(sources.row_count(d)))
    finally:
        spark.catalog.dropTempView(name)


@_add("""SELECT model, rows FROM (SELECT 'order_lines' AS model, count(DISTINCT l_orderkey) AS rows FROM lineitem UNION ALL SELECT 'order_facts', count(*) FROM orders)""")
def models_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models that ``facts`` names, with what they need and without what is excluded, and their rows."""
    graph = catalog_tables._models()
    names = models.selected(graph, include=["facts"], exclude=["value"])
    built = models.run({n: graph[n] for n in names}, _given(spark, sf_dir))
    return reduce(DataFrame.unionByName, [sources.row_count(d).select(F.lit(n).alias("model"), "rows") for n, d in built.items()])


@_add("""SELECT guard, (SELECT count(*) FROM orders) AS rows FROM unnest(['aggregate with a window', 'history without keys', 'incremental without its column', 'replacement in numbers', 'unknown join', 'unknown materialization']) t(guard)""")
def guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is refused before a job runs; a guard that lets its case through is missing."""
    o = _read(spark, sf_dir, "orders")
    cases = {
        "unknown join": lambda: joins.join(o, joins.Right(o, "other", "sideways", (("o_orderkey", "EQ", "o_orderkey"),))),
        "aggregate with a window": lambda: aggregates.grouped(o, ["o_custkey"], {"n": F.sum("o_totalprice").over(Window.partitionBy("o_custkey"))}),
        "replacement in numbers": lambda: cleaning.find_and_replace(o, ["o_orderkey"], [("DIGITS", "", "x")]),
        "history without keys": lambda: history.first(o, history.History((), check=("o_totalprice",)), "2024-01-01"),
        "incremental without its column": lambda: upkeep.Load("INCREMENTAL", strategy="timestamp").checked(),
        "unknown materialization": lambda: upkeep.Load("HEAP").checked(),
    }

    def refused(case: Callable[[], object]) -> bool:
        try:
            case()
        except ValueError:
            return True
        return False

    rows = [(n,) for n, case in cases.items() if refused(case)]
    return spark.createDataFrame(rows, "guard string").crossJoin(F.broadcast(sources.row_count(o)))
