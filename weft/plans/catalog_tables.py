"""Registered queries of the table transformations and of table upkeep, with the SQL that says the same."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import aggregates, cleaning, filters, joins, sets, shaping, windowing
from weft.sources import tables as sources
from weft.streaming import loads

from . import history, models, upkeep
from .scratch import scratch, scratch_table

QUERIES, ORACLES = {}, {}


def _read(spark: SparkSession, sf_dir: str, *names: str):  # noqa: ANN202
    found = [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]
    return found if len(found) > 1 else found[0]


def _add(sql: str | None):  # noqa: ANN202
    def note(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return note


C = F.col


@_add("SELECT l_orderkey AS order_id, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue, l_returnflag || '-' || l_linestatus AS flags, CAST(l_quantity AS BIGINT) AS qty, 'web' AS channel FROM lineitem")
def shaping_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = shaping.synthesize(_read(spark, sf_dir, "lineitem"), {"net": 1 - C("l_discount"), "revenue": C("l_extendedprice") * C("net")})
    d = shaping.combine(d, "flags", ["l_returnflag", F.lit("-"), "l_linestatus"])
    d = shaping.literal(shaping.cast(shaping.rename(d, {"l_orderkey": "oid", "oid": "order_id", "l_quantity": "qty"}), {"qty": "BIGINT"}), "channel", "web", "STRING")
    return shaping.visible(shaping.reorder(d, ["order_id", "missing", "l_linenumber"]), ["order_id", "l_linenumber", "revenue", "flags", "qty", "channel"])


@_add("SELECT c_custkey, name, value FROM (SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS nation, c_acctbal AS balance FROM customer) UNPIVOT (value FOR name IN (nation, balance))")
def shaping_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "customer").select("c_custkey", C("c_nationkey").cast("double").alias("nation"), C("c_acctbal").alias("balance"))
    return shaping.unpivoted(d, ["c_custkey"], ["nation", "balance"])


@_add("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 50")
def sort_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.page(_read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [("o_totalprice", "desc"), ("o_orderkey", "asc")], 50, 2)


@_add("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity = 5 OR l_quantity >= 45 AND l_discount < 0.03 AND l_returnflag <> 'N' OR l_linenumber > 5 AND l_tax <= 0.01")
def filter_values_and_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = filters.Condition
    d = filters.where(_read(spark, sf_dir, "lineitem"), [q("l_quantity", "EQ", "5"), q("l_quantity", "GTE", "45", "OR"), q("l_discount", "LT", "0.03"), q("l_returnflag", "NEQ", "N"), q("l_linenumber", "GT", 5, "OR"), q("l_tax", "LTE", 0.01)])
    return d.select("l_orderkey", "l_linenumber")


@_add("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount = l_tax OR l_discount <> l_tax AND l_linenumber > l_quantity OR l_linenumber >= l_suppkey OR l_suppkey < l_linenumber OR l_partkey <= l_quantity")
def filter_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = filters.Condition
    d = filters.where(_read(spark, sf_dir, "lineitem"), [q("l_discount", "EQ", C("l_tax")), q("l_discount", "NEQ", C("l_tax"), "OR"), q("l_linenumber", "GT", C("l_quantity")), q("l_linenumber", "GTE", C("l_suppkey"), "OR"), q("l_suppkey", "LT", C("l_linenumber"), "OR"), q("l_partkey", "LTE", C("l_quantity"), "OR")])
    return d.select("l_orderkey", "l_linenumber")


@_add("SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1995 AND o_orderstatus IN ('F', 'O') AND o_orderpriority NOT IN ('1-URGENT') AND o_totalprice BETWEEN 1000 AND 300000 AND o_orderkey IS NOT NULL")
def filter_formula_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = filters.Condition
    d = filters.where(_read(spark, sf_dir, "orders"), [q(F.year("o_orderdate"), "EQ", 1995), q("o_orderstatus", "IN", "F, O"), q("o_orderpriority", "NOTIN", ["1-URGENT"]), q("o_totalprice", "BETWEEN", [1000, 300000]), q("o_orderkey", "NOTNULL")])
    return d.select("o_orderkey")


@_add("SELECT p_partkey FROM part WHERE p_name LIKE '%a%' AND p_name NOT LIKE '%zz%' AND p_brand LIKE 'Brand%' OR p_brand LIKE '%1' AND p_type LIKE '%E%' OR p_name IS NULL OR (p_size > 10) = true AND (p_size > 40) = false")
def filter_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = filters.Condition
    d = filters.where(_read(spark, sf_dir, "part"), [q("p_name", "CONTAINS", "a"), q("p_name", "NOTCONTAINS", "zz"), q("p_brand", "STARTSWITH", "Brand"), q("p_brand", "ENDSWITH", "1", "OR"), q("p_type", "LIKE", "%E%"), q("p_name", "NULL", joined="OR"), q(C("p_size") > 10, "TRUE", joined="OR"), q(C("p_size") > 40, "FALSE")])
    return d.select("p_partkey")


@_add("SELECT o_orderkey, c_custkey, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def join_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n, r = _read(spark, sf_dir, "orders", "customer", "nation", "region")
    j = joins.Right
    d = joins.join(o.select("o_orderkey", "o_custkey"), j(c.select("c_custkey", "c_nationkey"), "customer", "inner", (("o_custkey", "EQ", "c_custkey"),)), j(n, "nation", "left", (("c_nationkey", "EQ", "n_nationkey"),)), j(r, "region", "left", (("n_regionkey", "EQ", "r_regionkey"),)))
    return d.select("o_orderkey", "c_custkey", "n_name", "r_name")


@_add("SELECT c_custkey, o_orderkey, o_totalprice FROM (SELECT * FROM orders WHERE o_totalprice > 200000) RIGHT JOIN customer ON o_custkey = c_custkey")
def join_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = _read(spark, sf_dir, "orders", "customer")
    d = joins.join(o.where("o_totalprice > 200000"), joins.Right(c, "customer", "right", (("o_custkey", "EQ", "c_custkey"),)))
    return d.select("c_custkey", "o_orderkey", "o_totalprice")


@_add("SELECT a.n_nationkey, a.customers, b.n_nationkey AS suppliers_n_nationkey, b.suppliers FROM (SELECT c_nationkey AS n_nationkey, count(*) AS customers FROM customer WHERE c_nationkey < 15 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS n_nationkey, count(*) AS suppliers FROM supplier WHERE s_nationkey > 8 GROUP BY 1) b ON a.n_nationkey = b.n_nationkey")
def join_full_with_clashing_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = _read(spark, sf_dir, "customer", "supplier")
    a = c.where("c_nationkey < 15").groupBy(C("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    b = s.where("s_nationkey > 8").groupBy(C("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    return joins.join(a, joins.Right(b, "suppliers", "full", (("n_nationkey", "EQ", "n_nationkey"),)))


@_add("SELECT a.n_name, b.n_name AS other_n_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey AND a.n_name <> b.n_name")
def join_self_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _read(spark, sf_dir, "nation")
    return joins.join(n, joins.Right(n, "other", "inner", (("n_regionkey", "EQ", "n_regionkey"), ("n_nationkey", "LT", "n_nationkey"), ("n_name", "NEQ", "n_name")))).select("n_name", "other_n_name")


@_add("SELECT n_name, r_name FROM nation, region")
def join_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = _read(spark, sf_dir, "nation", "region")
    return joins.join(n, joins.Right(r, "region", "cross")).select("n_name", "r_name")


@_add("SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate AND l_extendedprice <= o_totalprice AND l_shipdate > o_orderdate")
def join_range_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = _read(spark, sf_dir, "lineitem", "orders")
    on = (("l_orderkey", "EQ", "o_orderkey"), ("l_shipdate", "GTE", "o_orderdate"), ("l_extendedprice", "LTE", "o_totalprice"), ("l_shipdate", "GT", "o_orderdate"))
    return joins.join(li, joins.Right(o, "orders", "inner", on)).select("l_orderkey", "l_linenumber", "o_orderstatus")


@_add("""SELECT l_returnflag, l_linestatus, count(l_tax) AS n_tax, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, round(sum(l_quantity), 2) AS qty,
  round(avg(l_discount), 6) AS disc, round(avg(l_tax), 6) AS tax, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, round(stddev_samp(l_quantity), 4) AS sd, round(var_samp(l_quantity), 4) AS var
  FROM lineitem GROUP BY ALL""")
def aggregate_all_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, r = aggregates.aggregate, F.round
    return aggregates.grouped(_read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], {
        "n_tax": a("COUNT", "l_tax"), "n": a("COUNT", "*"), "suppliers": a("COUNT_DISTINCT", "l_suppkey"), "qty": r(a("SUM", "l_quantity"), 2), "disc": r(a("AVG", "l_discount"), 6), "tax": r(a("MEAN", "l_tax"), 6),
        "first_ship": a("MIN", "l_shipdate"), "last_ship": a("MAX", "l_shipdate"), "sd": r(a("STDDEV", "l_quantity"), 4), "var": r(a("VARIANCE", "l_quantity"), 4),
    })


@_add("""SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)) / count(*), 2) AS revenue_per_line, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END), 2) AS returned,
  round(sum(abs(coalesce(l_discount, 0) - 0.05)), 4) AS off, coalesce(max(nullif(l_tax, 0)), 0) AS top_tax, CAST(sum(l_quantity) AS BIGINT) AS qty,
  date_diff('day', CAST(min(l_shipdate) AS DATE), CAST(max(l_shipdate) AS DATE)) AS ship_days
  FROM lineitem GROUP BY l_suppkey HAVING count(*) > 20 AND count(DISTINCT l_partkey) > 5 OR sum(l_quantity) > 2000""")
def aggregate_formulas_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.grouped(
        _read(spark, sf_dir, "lineitem"), ["l_suppkey"],
        {
            "revenue_per_line": F.round(F.sum(C("l_extendedprice") * (1 - C("l_discount"))) / F.count(F.lit(1)), 2), "returned": F.round(F.sum(F.when(C("l_returnflag") == "R", C("l_quantity")).otherwise(0)), 2),
            "off": F.round(F.sum(F.abs(F.coalesce("l_discount", F.lit(0)) - 0.05)), 4), "top_tax": F.coalesce(F.max(F.nullif("l_tax", F.lit(0.0))), F.lit(0.0)), "qty": F.sum("l_quantity").cast("bigint"), "ship_days": aggregates.span("l_shipdate", temporal=True),
        },
        having=lambda c: (c["_n"] > 20) & (c["_parts"] > 5) | (c["_qty"] > 2000),
        hidden={"_n": aggregates.aggregate("COUNT", "*"), "_parts": aggregates.aggregate("COUNT_DISTINCT", "l_partkey"), "_qty": F.sum("l_quantity")},
    )


@_add("SELECT o_custkey, count(*) AS n, round(max(o_totalprice) - min(o_totalprice), 2) AS spread FROM orders GROUP BY o_custkey HAVING count(*) >= 12")
def aggregate_then_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.grouped(_read(spark, sf_dir, "orders"), ["o_custkey"], {"n": aggregates.aggregate("COUNT", "*"), "spread": F.round(aggregates.span("o_totalprice"), 2)}, after=C("n") >= 12)


@_add("SELECT count(*) AS n, round(sum(o_totalprice), 0) AS total FROM orders")
def aggregate_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.grouped(_read(spark, sf_dir, "orders"), [], {"n": aggregates.aggregate("COUNT", "*"), "total": F.round(aggregates.aggregate("SUM", "o_totalprice"), 0)})


@_add("""SELECT o_custkey, coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0) AS "F", coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 0) AS "O", coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 0) AS "P" FROM (SELECT o_custkey, o_orderstatus, round(o_totalprice) AS o_totalprice FROM orders) GROUP BY o_custkey""")
def pivot_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "orders").withColumn("o_totalprice", F.round("o_totalprice"))
    return aggregates.pivoted(d, "o_custkey", "o_orderstatus", "o_totalprice", ["F", "O", "P"], "SUM", "0")


@_add("""SELECT o_custkey, coalesce(min(o_orderpriority) FILTER (o_orderstatus = 'F'), '-') AS "F", coalesce(min(o_orderpriority) FILTER (o_orderstatus = 'O'), '-') AS "O" FROM orders GROUP BY o_custkey""")
def pivot_default_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.pivoted(_read(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", "o_orderpriority", ["F", "O"], fill="-")


@_add("""SELECT o_custkey, o_orderkey, CAST(row_number() OVER w AS INTEGER) AS rn, CAST(rank() OVER p AS INTEGER) AS rk, CAST(dense_rank() OVER p AS INTEGER) AS dr, round(percent_rank() OVER p, 6) AS pr,
  lag(o_orderdate) OVER w AS prev_date, lead(o_totalprice, 2) OVER w AS next2, first_value(o_totalprice) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_price,
  last_value(o_totalprice) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_price
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), p AS (PARTITION BY o_custkey ORDER BY o_orderstatus DESC NULLS LAST)""")
def window_ranks_and_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, w, p = ("o_custkey",), (("o_orderdate", "asc"), ("o_orderkey", "asc")), (("o_orderstatus", "desc"),)
    x = windowing.WindowColumn
    cols = [x("rn", "ROW_NUMBER", part, w), x("rk", "RANK", part, p), x("dr", "DENSE_RANK", part, p), x("pr", "PERCENT_RANK", part, p), x("prev_date", "LAG", part, w), x("next2", "LEAD", part, w, "o_totalprice", 2), x("first_price", "FIRST", part, w, "o_totalprice"), x("last_price", "LAST", part, w, "o_totalprice")]
    d = windowing.with_windows(_read(spark, sf_dir, "orders"), cols)
    return d.select("o_custkey", "o_orderkey", "rn", "rk", "dr", F.round("pr", 6).alias("pr"), "prev_date", "next2", "first_price", "last_price")


@_add("""SELECT l_orderkey, l_linenumber, round(sum(l_extendedprice * (1 - l_discount)) OVER w, 2) AS running, round(avg(l_quantity) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS near,
  count(l_orderkey) OVER (PARTITION BY l_orderkey) AS n, min(l_tax) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lo, max(l_tax) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi,
  round(stddev_samp(l_quantity) OVER (PARTITION BY l_orderkey), 4) AS sd, round(var_samp(l_quantity) OVER (PARTITION BY l_orderkey), 4) AS var
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)""".replace("OVER w, 2) AS running", "OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS running"))
def window_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, w = ("l_orderkey",), tuple((c, "asc") for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"))
    x = windowing.WindowColumn
    cols = [
        x("running", "SUM", part, w, C("l_extendedprice") * (1 - C("l_discount")), preceding="unbounded", following=0), x("near", "AVG", part, w, "l_quantity", preceding=2, following=1), x("n", "COUNT", part), x("lo", "MIN", part, w, "l_tax"),
        x("hi", "MAX", part, w, "l_tax", preceding=0), x("sd", "STDDEV", part, c="l_quantity"), x("var", "VAR", part, c="l_quantity"),
    ]
    d = windowing.with_windows(_read(spark, sf_dir, "lineitem"), cols)
    return d.select("l_orderkey", "l_linenumber", F.round("running", 4).alias("running"), F.round("near", 6).alias("near"), "n", "lo", "hi", F.round("sd", 4).alias("sd"), F.round("var", 4).alias("var"))


@_add("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS n FROM orders) WHERE n = 1")
def clean_distinct_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.distinct_by(_read(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"], [("o_totalprice", "desc"), ("o_orderkey", "asc")]).select("o_custkey", "o_orderkey", "o_orderstatus")


@_add("""SELECT p_partkey, replace(p_brand, 'Brand', 'B') AS exact, regexp_replace(p_brand, '^brand#12$', 'x', 'i') AS whole, regexp_replace(coalesce(nullif(p_brand, 'Brand#11'), ''), '^\\s*$', 'empty') AS emptied,
  regexp_replace(p_brand, '[A-Za-z]', 'L', 'g') AS letters, regexp_replace(p_brand, '[0-9]', '9', 'g') AS digits, regexp_replace(p_brand || ' a+b', '[$@#%^*-+/]', '_', 'g') AS symbols,
  replace(p_name, ' ', '_') AS spaces, regexp_replace('€5 ' || p_brand, '[€$£₹]', 'EUR', 'g') AS currency, regexp_replace(p_name || '!', '[.,!]', '', 'g') AS stops, regexp_replace(p_name, '[aeiou]+', '*', 'g') AS pattern,
  regexp_replace(coalesce(nullif(p_brand, 'Brand#22'), 'none here'), '^(null|none|)$', 'none here', 'i') AS filled FROM part""")
def clean_find_and_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, r = _read(spark, sf_dir, "part"), cleaning.replaced
    b, n = C("p_brand"), C("p_name")
    return d.select(
        "p_partkey", r(b, "EXACT_TEXT", "Brand", "B").alias("exact"), r(b, "TEXT", "brand#12", "x").alias("whole"), r(F.nullif(b, F.lit("Brand#11")), "EMPTY", value="empty").alias("emptied"), r(b, "LETTERS", value="L").alias("letters"), r(b, "DIGITS", value="9").alias("digits"),
        r(F.concat(b, F.lit(" a+b")), "SYMBOLS", value="_").alias("symbols"), r(n, "WHITESPACE", value="_").alias("spaces"), r(F.concat(F.lit("€5 "), b), "CURRENCY", value="EUR").alias("currency"), r(F.concat(n, F.lit("!")), "PUNCTUATION").alias("stops"),
        r(n, "REGEX", "[aeiou]+", "*").alias("pattern"), r(F.nullif(b, F.lit("Brand#22")), "FILL_NULL", value="none here").alias("filled"),
    )


@_add("SELECT p_partkey, regexp_replace(replace(p_brand, '#', ' '), '[0-9]', 'n', 'g') AS p_brand, regexp_replace(replace(p_type, '#', ' '), '[0-9]', 'n', 'g') AS p_type FROM part")
def clean_columns_by_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.find_and_replace(_read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type"), ["p_brand", "p_type"], [("EXACT_TEXT", "#", " "), ("DIGITS", "", "n")])


@_add("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, CAST(NULL AS DOUBLE) FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT n_nationkey, n_name, CAST(n_regionkey AS DOUBLE) FROM nation")
def union_all_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s, n = _read(spark, sf_dir, "customer", "supplier", "nation")
    parent = c.select(C("c_custkey").alias("id"), C("c_name").alias("name"), C("c_acctbal").alias("balance"))
    return sets.union(parent, [sets.Child(s, {"id": "s_suppkey", "name": "s_name"}, (filters.Condition("s_acctbal", "GT", 0),)), sets.Child(n, {"id": "n_nationkey", "name": "n_name", "balance": "n_regionkey"})])


@_add("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = _read(spark, sf_dir, "customer", "supplier")
    return sets.union(c.select(C("c_nationkey").alias("nation")), [sets.Child(s, {"nation": "s_nationkey"})], distinct=True)


@_add("SELECT o_orderkey AS id, 'order' AS kind, year(o_orderdate) AS y FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT l_orderkey, 'line', CAST(CAST(l_linenumber AS VARCHAR) AS BIGINT) FROM lineitem WHERE l_quantity > 40 UNION ALL SELECT event_id, 'event', 0 FROM events WHERE event_type = 'click'")
def union_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li, e = _read(spark, sf_dir, "orders", "lineitem", "events")
    q = filters.Condition
    return sets.branches([
        sets.Branch(o, {"id": C("o_orderkey"), "kind": F.lit("order"), "y": F.year("o_orderdate").cast("long")}, (q("o_orderstatus", "EQ", "F"),)),
        sets.Branch(li, {"id": C("l_orderkey"), "kind": F.lit("line"), "y": C("l_linenumber").cast("string").cast("long")}, (q("l_quantity", "GT", 40),)),
        sets.Branch(e, {"id": C("event_id"), "kind": F.lit("event"), "y": F.lit(0).cast("long")}, (q("event_type", "EQ", "click"),)),
    ])


@_add("SELECT count(*) AS rows FROM lineitem")
def source_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.row_count(_read(spark, sf_dir, "lineitem"))


@_add("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def source_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = f"{scratch(spark)}/nation.csv"
    upkeep.export_csv(_read(spark, sf_dir, "nation"), place)
    return sources.seed(spark, place)


@_add("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 LIMIT 100")
def source_guarded_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    _read(spark, sf_dir, "orders").createOrReplaceTempView("weft_orders")
    return sources.query(spark, "SELECT o_orderpriority, count(*) AS n FROM weft_orders GROUP BY 1 ORDER BY 1")


CUT = "1996-01-01"


def _changed(orders: DataFrame) -> DataFrame:
    """Orders from the cut on, and earlier ones of status P with a corrected price."""
    return orders.where(f"o_orderdate >= '{CUT}' OR o_orderstatus = 'P'").withColumn("o_totalprice", F.when(C("o_orderdate") < CUT, -1.0).otherwise(C("o_totalprice")))


@_add(f"SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'P' AND o_orderdate < '{CUT}' THEN -1.0 ELSE o_totalprice END AS o_totalprice FROM orders")
def upkeep_merge_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, table = _read(spark, sf_dir, "orders"), scratch_table(spark)
    load = upkeep.Load("INCREMENTAL", ("o_orderkey",), "full_scan")
    upkeep.run(o.where(f"o_orderdate < '{CUT}'"), table, load)
    for _ in range(2):
        out = upkeep.run(_changed(o), table, load)
    return out.select("o_orderkey", "o_orderstatus", "o_totalprice")


@_add("SELECT o_orderkey, o_orderdate FROM orders")
def upkeep_append_above_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, table = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), scratch_table(spark)
    load = upkeep.Load("INCREMENTAL", (), "timestamp", {"column": "o_orderdate"})
    upkeep.run(o.where(f"o_orderdate < '{CUT}'"), table, load)
    upkeep.run(o, table, load)
    return upkeep.run(o, table, load)


@_add(f"SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderdate < '{CUT}' THEN -1.0 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderdate >= '{CUT}' OR o_orderstatus = 'P'")
def upkeep_changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    now = o.where(f"o_orderdate < '{CUT}'").join(_changed(o).select("o_orderkey"), "o_orderkey", "left_anti").unionByName(_changed(o))
    return upkeep.changed_rows(now, o.where(f"o_orderdate < '{CUT}'"), {"key_columns": ["o_orderkey"]}).select("o_orderkey", "o_totalprice")


@_add("SELECT c_custkey, c_name, CAST(c_custkey * 2 AS BIGINT) AS twice FROM customer")
def upkeep_schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, table = _read(spark, sf_dir, "customer").select("c_custkey", "c_name"), scratch_table(spark)
    load = upkeep.Load("INCREMENTAL", ("c_custkey",), "sequence", {"column": "c_custkey"})
    upkeep.run(c, table, load)
    return upkeep.run(c.withColumn("twice", C("c_custkey") * 2), table, load)


@_add(f"SELECT CAST(CAST('{CUT}' AS TIMESTAMP) AS VARCHAR) AS old_value, CAST(max(o_orderdate) AS VARCHAR) AS new_value, count(*) FILTER (o_orderdate > '{CUT}') AS rows FROM orders")
def upkeep_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.advance(_read(spark, sf_dir, "orders"), "o_orderdate", CUT, "timestamp")


@_add("""SELECT 'o_orderkey' AS "column", 'sequence' AS kind, 0.9::DOUBLE AS score, CAST(min(o_orderkey) AS VARCHAR) AS least, CAST(max(o_orderkey) AS VARCHAR) AS greatest, count(*) - count(o_orderkey) AS nulls, count(*) AS rows FROM orders
UNION ALL SELECT 'o_custkey', 'sequence', 0.9::DOUBLE, CAST(min(o_custkey) AS VARCHAR), CAST(max(o_custkey) AS VARCHAR), count(*) - count(o_custkey), count(*) FROM orders
UNION ALL SELECT 'o_orderdate', 'timestamp', 0.9::DOUBLE, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S'), strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S'), count(*) - count(o_orderdate), count(*) FROM orders""")
def upkeep_key_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.key_candidates(_read(spark, sf_dir, "orders")).drop("distinct_about")


@_add("""SELECT "column", abs(about - n) <= 0.2 * n AS near FROM (SELECT 'o_orderkey' AS "column", count(DISTINCT o_orderkey) AS n, count(DISTINCT o_orderkey) AS about FROM orders
UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey), count(DISTINCT o_custkey) FROM orders UNION ALL SELECT 'o_orderdate', count(DISTINCT o_orderdate), count(DISTINCT o_orderdate) FROM orders)""")
def upkeep_key_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    names = ["o_orderkey", "o_custkey", "o_orderdate"]
    n = o.agg(*(F.count_distinct(c).alias(c) for c in names)).unpivot([], names, "column", "n")
    return upkeep.key_candidates(o).join(n, "column").select("column", (F.abs(C("distinct_about") - C("n")) <= 0.2 * C("n")).alias("near"))


@_add("SELECT c_custkey, c_name, 'view' AS how FROM customer WHERE c_nationkey < 5 UNION ALL SELECT c_custkey, c_name, 'plan' FROM customer WHERE c_nationkey >= 20")
def upkeep_view_and_ephemeral(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, table = _read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), scratch_table(spark)
    shown = upkeep.run(c.where("c_nationkey < 5"), table, upkeep.Load("VIEW"), "weft_customers_of_some_nations")
    inline = upkeep.run(c.where("c_nationkey >= 20"), table, upkeep.Load("EPHEMERAL"))
    return shown.select("c_custkey", "c_name", F.lit("view").alias("how")).unionByName(inline.select("c_custkey", "c_name", F.lit("plan").alias("how")))


@_add("SELECT s_suppkey, s_name, CAST(CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END AS INTEGER) AS grade FROM supplier")
def upkeep_add_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, table = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), scratch_table(spark)
    upkeep.full(table, s, ["s_suppkey"])
    upkeep.add_column(table, "grade", "int")
    graded = s.where("s_suppkey % 2 = 0").withColumn("grade", C("s_suppkey").cast("int"))
    return upkeep.run(graded, table, upkeep.Load("INCREMENTAL", ("s_suppkey",)))


@_add("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def upkeep_dump_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = scratch(spark)
    upkeep.dump(dict(zip(("nation", "region"), _read(spark, sf_dir, "nation", "region"), strict=True)), place)
    back = upkeep.restore(spark, ["nation", "region"], place)
    return back["nation"].join(back["region"], C("n_regionkey") == C("r_regionkey")).select("n_nationkey", "n_name", "r_name")


@_add("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def upkeep_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, table = _read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), scratch_table(spark)
    load = upkeep.Load("INCREMENTAL", ("o_orderkey",))
    upkeep.run(o, table, load)
    return upkeep.run(o.where("o_orderstatus = 'F'"), table, load, materialization="TABLE").select("o_orderkey", "o_totalprice")


@_add("SELECT event_id, CAST(ts AS DATE) AS day FROM events")
def upkeep_date_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, table = _read(spark, sf_dir, "events").select("event_id", C("ts").cast("date").alias("day")), scratch_table(spark)
    load = upkeep.Load("INCREMENTAL", (), "date", {"column": "day"})
    middle = e.agg(F.date_add(F.min("day"), F.floor(F.datediff(F.max("day"), F.min("day")) / 2).cast("int")).alias("m"))
    upkeep.run(e.join(F.broadcast(middle), C("day") <= C("m")).drop("m"), table, load)
    return upkeep.run(e, table, load)


@_add("SELECT event_id, user_id FROM events")
def upkeep_sequence_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, table = _read(spark, sf_dir, "events").select("event_id", "user_id"), scratch_table(spark)
    load = upkeep.Load("INCREMENTAL", ("event_id",), "sequence", {"column": "event_id"})
    half = e.agg((F.max("event_id") / 2).alias("h"))
    upkeep.run(e.join(F.broadcast(half), C("event_id") <= C("h")).drop("h"), table, load)
    return upkeep.run(e, table, load)


@_add("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer")
def upkeep_custom_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, table = _read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), scratch_table(spark)
    own = {"function": lambda source, destination, options: source.where(C("c_custkey") % options["every"] == 0), "every": 3}
    load = upkeep.Load("INCREMENTAL", ("c_custkey",), "custom", own)
    upkeep.run(c, table, load)
    return upkeep.run(c.withColumn("c_acctbal", C("c_acctbal") + 1), table, load)


@_add("SELECT c_custkey, c_name FROM customer")
def upkeep_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    def fails(*_) -> DataFrame:  # noqa: ANN002
        raise RuntimeError("the delta can't be had")

    c, table = _read(spark, sf_dir, "customer").select("c_custkey", "c_name"), scratch_table(spark)
    upkeep.full(table, c.where("c_custkey % 2 = 0"), ["c_custkey"])
    return upkeep.run_or_reload(c, table, upkeep.Load("INCREMENTAL", ("c_custkey",), "custom", {"function": fails}))


@_add("SELECT CAST(NULL AS VARCHAR) AS old_value, CAST(max(event_id) FILTER (event_id % 2 = 0 OR event_id < 100) AS VARCHAR) AS new_value, count(*) FILTER (event_id % 2 = 0 OR event_id < 100) AS rows FROM events UNION ALL SELECT a, CAST(b AS VARCHAR), n FROM (SELECT CAST((SELECT max(event_id) FROM events WHERE event_id % 2 = 0 OR event_id < 100) AS VARCHAR) AS a, max(event_id) AS b, count(*) FILTER (event_id > (SELECT max(event_id) FROM events WHERE event_id % 2 = 0 OR event_id < 100)) AS n FROM events)")
def upkeep_kept_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, table = _read(spark, sf_dir, "events"), scratch_table(spark)
    upkeep.advance_kept(e.where("event_id % 2 = 0 OR event_id < 100"), "event_id", "long", table)
    upkeep.advance_kept(e, "event_id", "long", table)
    return table.read().select("old_value", "new_value", "rows")


@_add("SELECT true AS above_old, false AS above_last, true AS first FROM (SELECT count(*) FROM orders)")
def upkeep_has_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    last = o.agg(F.max("o_orderdate")).first()[0]
    found = (upkeep.has_new(o, "o_orderdate", CUT), upkeep.has_new(o, "o_orderdate", last), upkeep.has_new(o, "o_orderdate", None))
    return spark.createDataFrame([found], "above_old boolean, above_last boolean, first boolean")


@_add("SELECT r_regionkey, r_name, n FROM region JOIN (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1) ON r_regionkey = n_regionkey")
def source_seeds_and_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    place, schema = scratch(spark), f"weft_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE DATABASE {schema} LOCATION '{place}/{schema}'")
    r, n = _read(spark, sf_dir, "region", "nation")
    for name, df in (("my region-1.csv", r), ("nations.csv", n)):
        upkeep.export_csv(df, f"{place}/{name}")
    for _ in range(2):  # loading again replaces
        sources.load_seeds(spark, [f"{place}/my region-1.csv", f"{place}/nations.csv"], schema)
    found = sources.scan(spark, "nations", schema).groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))
    return sources.scan(spark, "my_region_1", schema).join(found, C("r_regionkey") == C("n_regionkey")).select(C("r_regionkey").cast("int").alias("r_regionkey"), "r_name", "n")


@_add("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 50")
def source_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.preview(_read(spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice"], [("o_totalprice", "desc"), ("o_orderkey", "asc")], 50, 2)


@_add("SELECT CAST(5 AS BIGINT) AS n, true AS known FROM (SELECT count(*) FROM orders)")
def source_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    some = sources.sample(o, 5).join(o.select("o_orderkey").distinct(), "o_orderkey", "left_semi")
    return some.agg(F.count(F.lit(1)).alias("n")).select("n", (C("n") == 5).alias("known"))


@_add("SELECT event_id, user_id, value FROM events")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = scratch_table(spark)
    given = _read(spark, sf_dir, "events")
    stream = spark.readStream.schema(given.schema).parquet(f"{sf_dir}/events.parquet*")
    loads.upsert(stream, table, ["event_id"], f"{table.path}-checkpoint").awaitTermination()
    return table.read().select("event_id", "user_id", "value")


SNAP = history.History(("c_custkey",), check=("c_acctbal", "c_mktsegment"), close_missing=True)


@_add("""WITH v AS (SELECT *, c_custkey % 5 = 0 AS changed, c_custkey % 7 = 0 AS gone, c_custkey % 3 = 0 AS late FROM customer)
SELECT c_custkey, c_acctbal, CAST('2024-01-01' AS TIMESTAMP) AS scd_valid_from, CASE WHEN changed OR gone THEN CAST('2024-02-01' AS TIMESTAMP) END AS scd_valid_to FROM v WHERE NOT late
UNION ALL SELECT c_custkey, CASE WHEN changed THEN c_acctbal + 1 ELSE c_acctbal END, CAST('2024-02-01' AS TIMESTAMP), NULL FROM v WHERE NOT gone AND (late OR changed)""")
def history_check_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    now = c.where("c_custkey % 7 <> 0").withColumn("c_acctbal", C("c_acctbal") + (C("c_custkey") % 5 == 0).cast("int"))
    snap = history.first(c.where("c_custkey % 3 <> 0"), SNAP, "2024-01-01")
    snap = history.advanced(history.advanced(snap, now, SNAP, "2024-02-01"), now, SNAP, "2024-03-01")
    return snap.select("c_custkey", "c_acctbal", "scd_valid_from", "scd_valid_to")


@_add(f"""SELECT o_orderkey, md5(o_orderkey || '|' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')) AS scd_id, o_orderdate AS scd_valid_from, CASE WHEN o_orderstatus = 'P' THEN o_orderdate + INTERVAL 1 DAY END AS scd_valid_to FROM orders WHERE o_orderdate < '{CUT}'
UNION ALL SELECT o_orderkey, md5(o_orderkey || '|' || strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S')), o_orderdate + INTERVAL 1 DAY, NULL FROM orders WHERE o_orderdate < '{CUT}' AND o_orderstatus = 'P'
UNION ALL SELECT o_orderkey, md5(o_orderkey || '|' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')), o_orderdate, NULL FROM orders WHERE o_orderdate >= '{CUT}'""")
def history_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    h = history.History(("o_orderkey",), updated_at="o_orderdate")
    later = o.withColumn("o_orderdate", F.when((C("o_orderstatus") == "P") & (C("o_orderdate") < CUT), C("o_orderdate") + F.make_dt_interval(days=F.lit(1))).otherwise(C("o_orderdate"))).withColumn("note", F.lit("new"))
    snap = history.advanced(history.first(o.where(f"o_orderdate < '{CUT}'"), h, None), later, h, None)
    return snap.select("o_orderkey", "scd_id", "scd_valid_from", "scd_valid_to")


def _models() -> dict[str, models.Model]:
    m = models.Model
    return {x.name: x for x in [
        m("order_lines", ("lineitem",), lambda li: li.groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("lines_total"), F.count(F.lit(1)).alias("lines"))),
        m("order_facts", ("orders", "order_lines"), lambda o, s: joins.join(o, joins.Right(s, "lines", "left", (("o_orderkey", "EQ", "l_orderkey"),))), {"order_lines": "join"}),
        m("customer_value", ("customer", "order_facts"), lambda c, f: joins.join(c, joins.Right(f.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.sum("lines").alias("lines")), "facts", "left", (("c_custkey", "EQ", "o_custkey"),))), {"order_facts": "join"}),
    ]}


@_add("""SELECT c_custkey, c_name, orders, total, lines FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS total, sum(n) AS lines
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey GROUP BY 1) ON c_custkey = o_custkey""")
def models_customer_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = dict(zip(("lineitem", "orders", "customer"), _read(spark, sf_dir, "lineitem", "orders", "customer"), strict=True))
    return models.run(_models(), given, ["customer_value"])["customer_value"].select("c_custkey", "c_name", "orders", "total", "lines")


@_add("SELECT o_custkey, count(*) AS n FROM orders LEFT JOIN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 10 GROUP BY 1) ON o_orderkey = l_orderkey GROUP BY 1")
def models_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``facts`` and what is made from it are built anew; ``lines`` is loaded from its table."""
    m, (li, o), tables = models.Model, _read(spark, sf_dir, "lineitem", "orders"), {}
    graph = {x.name: x for x in [
        m("lines", ("lineitem",), lambda d: d.where("l_quantity > 10").select("l_orderkey").distinct()), m("facts", ("orders", "lines"), lambda d, s: d.join(s, C("o_orderkey") == C("l_orderkey"), "left")),
        m("by_customer", ("facts",), lambda d: d.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))),
    ]}

    def keep(name: str, df: DataFrame) -> DataFrame:
        return upkeep.full(tables.setdefault(name, scratch_table(spark)), df)

    models.run(graph, {"lineitem": li, "orders": o.limit(0)}, keep=keep)
    return models.run(graph, {"lineitem": li.limit(0), "orders": o}, ["facts"], keep, lambda n: tables[n].read())["by_customer"]


@_add("""SELECT * FROM (VALUES ('lineitem', 'order_lines', 'source', 'source', (SELECT count(*) FROM lineitem)), ('orders', 'order_facts', 'source', 'source', (SELECT count(*) FROM orders)), ('order_lines', 'order_facts', 'join', 'model', NULL),
  ('customer', 'customer_value', 'source', 'source', (SELECT count(*) FROM customer)), ('order_facts', 'customer_value', 'join', 'model', NULL)) t("from", "to", kind, from_is, rows)""")
def models_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage with the rows of each source."""
    counts = reduce(DataFrame.unionByName, [sources.row_count(_read(spark, sf_dir, t)).withColumn("from", F.lit(t)) for t in ("lineitem", "orders", "customer")])
    return models.lineage(spark, _models()).join(counts, "from", "left").select("from", "to", "kind", "from_is", "rows")


@_add("SELECT 'order_lines' AS model, true AS has_grouping, count(*) > 0 AS filled FROM lineitem")
def models_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = models.run(_models(), {"lineitem": _read(spark, sf_dir, "lineitem")}, ["order_lines"])
    plans = models.compiled(spark, built, scratch_table(spark))
    filled = built["order_lines"].agg((F.count(F.lit(1)) > 0).alias("filled"))
    return plans.join(F.broadcast(filled)).select("model", C("plan").contains("Aggregate").alias("has_grouping"), "filled")


@_add("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS INTEGER) AS latest FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey")
def window_implicit_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windowing.WindowColumn("latest", "ROW_NUMBER", ("o_custkey",), (("o_orderdate", "desc"), ("o_orderkey", "asc")))
    return windowing.with_windows(_read(spark, sf_dir, "orders"), [w], ordered=True).select("o_custkey", "o_orderkey", "latest")


@_add("SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#11', '12') OR p_type = '7' OR (p_size IN (3, 5) AND p_name <> '12')")
def filter_texts_like_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = filters.Condition
    d = filters.where(_read(spark, sf_dir, "part"), [q("p_brand", "IN", "Brand#11, 12"), q("p_type", "EQ", "7", "OR"), q("p_size", "IN", "3,5", "OR"), q("p_name", "NEQ", "12")])
    return d.select("p_partkey", "p_brand")


@_add("""SELECT 'price' AS "check", count(*) FILTER (NOT coalesce(o_totalprice > 1000, false)) AS failed FROM orders UNION ALL SELECT 'status', count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) FROM orders
  UNION ALL SELECT 'unique', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)""")
def models_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    return models.checks(o, price=C("o_totalprice") > 1000, status=C("o_orderstatus").isin("F", "O")).unionByName(models.unique(o, "o_custkey"))


@_add("""SELECT o_orderkey, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS qty_a, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS qty_n, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS qty_r
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def example_sums_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = _read(spark, sf_dir, "orders", "lineitem")
    flags = {f"qty_{f.lower()}": F.when(C("l_returnflag") == f, C("l_quantity")).otherwise(0) for f in "ANR"}
    d = shaping.synthesize(joins.join(o, joins.Right(li, "lines", "inner", (("o_orderkey", "EQ", "l_orderkey"),))), flags)
    return aggregates.grouped(d, ["o_orderkey"], {n: F.sum(n) for n in flags})


@_add("""SELECT p_brand, count(*) AS n_lines, round(avg(l_quantity), 4) AS avg_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey
  LEFT JOIN nation ON s_nationkey = n_nationkey GROUP BY p_brand ORDER BY revenue DESC""")
def example_brand_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p, s, n = _read(spark, sf_dir, "lineitem", "part", "supplier", "nation")
    j = joins.Right
    d = joins.join(li, j(p, "part", "left", (("l_partkey", "EQ", "p_partkey"),)), j(s, "supplier", "left", (("l_suppkey", "EQ", "s_suppkey"),)), j(n, "nation", "left", (("s_nationkey", "EQ", "n_nationkey"),)))
    d = shaping.synthesize(d, {"revenue": C("l_extendedprice") * (1 - C("l_discount"))})
    return shaping.sort(aggregates.grouped(d, ["p_brand"], {"n_lines": aggregates.aggregate("COUNT", "*"), "avg_qty": F.round(F.avg("l_quantity"), 4), "revenue": F.round(F.sum("revenue"), 2)}), [("revenue", "desc")])
