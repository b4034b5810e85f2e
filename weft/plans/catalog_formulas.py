"""Registered queries of the formula functions: one for each group, over whole tables, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import base, dates, logic, maths, operators, text, windows


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(table: str, keys: list[str], columns: dict[str, tuple]):  # noqa: ANN202
    """A query that projects expressions over a table, and its SQL; columns: name -> (function of the DataFrame, SQL)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _read(spark, sf_dir, table)
        return df.select(*keys, *(make(df).alias(name) for name, (make, _) in columns.items()))

    sql = f"SELECT {', '.join(keys)}, " + ", ".join(f"{s} AS {name}" for name, (_, s) in columns.items()) + f" FROM {table}"
    return run, sql




C = F.col
LOGIC = {
    "f_if": (lambda d: logic.if_(C("l_quantity") > 25, C("l_tax"), 0, "double"), "CASE WHEN l_quantity > 25 THEN l_tax ELSE 0.0::DOUBLE END"),
    "f_ifna": (lambda d: logic.ifna(F.nullif("l_returnflag", F.lit("N")), "none"), "coalesce(nullif(l_returnflag, 'N'), 'none')"),
    "f_ifs": (lambda d: logic.ifs(C("l_quantity") < 10, "low", C("l_quantity") < 30, "mid", True, "high"), "CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 30 THEN 'mid' ELSE 'high' END"),
    "f_switch": (lambda d: logic.switch(C("l_returnflag"), "A", 1, "R", 2), "CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 END"),
    "f_choose": (lambda d: logic.choose(C("l_linenumber"), "a", "b", "c"), "CASE l_linenumber WHEN 1 THEN 'a' WHEN 2 THEN 'b' WHEN 3 THEN 'c' END"),
    "f_isblank": (lambda d: logic.isblank(F.nullif("l_returnflag", F.lit("N"))), "nullif(l_returnflag, 'N') IS NULL"),
    "f_isna": (lambda d: logic.isna(C("l_shipdate")), "l_shipdate IS NULL"),
    "f_iseven": (lambda d: logic.iseven(C("l_partkey")), "l_partkey % 2 = 0"),
    "f_isodd": (lambda d: logic.isodd(3 - C("l_linenumber")), "(3 - l_linenumber) % 2 = 1"),
    "f_istext": (lambda d: logic.istext(d, "l_returnflag"), "true"),
    "f_isnumber": (lambda d: logic.isnumber(d, "l_returnflag"), "regexp_full_match(l_returnflag, '\\d*\\.?\\d+')"),
    "f_true": (lambda d: logic.true(), "true"),
    "f_false": (lambda d: logic.false(), "false"),
    "f_between": (lambda d: logic.between(C("l_quantity"), 10, 20), "l_quantity BETWEEN 10 AND 20"),
    "f_fill_null": (lambda d: logic.fill_null(F.nullif("l_linenumber", F.lit(1)), "7", "int"), "coalesce(nullif(l_linenumber, 1), 7)"),
    "f_nullif": (lambda d: logic.nullif(C("l_linenumber"), "2", "int"), "nullif(l_linenumber, 2)"),
    "f_isnan": (lambda d: logic.isnan(C("l_tax")), "isnan(l_tax)"),
    "f_isinf": (lambda d: logic.isinf(C("l_tax")), "isinf(l_tax)"),
    "f_try_cast": (lambda d: logic.try_cast(C("l_returnflag"), "INTEGER"), "TRY_CAST(l_returnflag AS INTEGER)"),
    "f_try_cast_texts": (lambda d: logic.try_cast(F.concat(F.when(C("l_linenumber") > 2, "").otherwise(C("l_returnflag")), C("l_partkey").cast("string")), "BIGINT"), "TRY_CAST(CASE WHEN l_linenumber > 2 THEN '' ELSE l_returnflag END || l_partkey AS BIGINT)"),
    "f_try_cast_real": (lambda d: logic.try_cast(F.concat(F.when(C("l_linenumber") > 2, "-").otherwise("x"), C("l_quantity").cast("string")), "DOUBLE"), "TRY_CAST(CASE WHEN l_linenumber > 2 THEN '-' ELSE 'x' END || l_quantity AS DOUBLE)"),
    "f_coalesce": (lambda d: logic.coalesce(F.nullif("l_linestatus", F.lit("O")), C("l_returnflag")), "coalesce(nullif(l_linestatus, 'O'), l_returnflag)"),
}
OPERATORS = {
    "o_div": (lambda d: operators.divide(C("l_quantity"), C("l_linenumber") - 1), "l_quantity / nullif(l_linenumber - 1, 0)"),
    "o_mod": (lambda d: operators.modulo(C("l_partkey"), 7), "l_partkey % 7"),
    "o_mul": (lambda d: operators.multiply(C("l_linenumber"), 3), "l_linenumber * 3"),
    "o_add": (lambda d: operators.add(C("l_linenumber"), 3), "l_linenumber + 3"),
    "o_add_days": (lambda d: operators.add(C("l_shipdate"), 5, temporal=True).cast("date"), "CAST(l_shipdate + INTERVAL 5 DAY AS DATE)"),
    "o_plus": (lambda d: operators.plus(C("l_tax")), "l_tax"),
    "o_sub": (lambda d: operators.subtract(C("l_linenumber"), 3), "l_linenumber - 3"),
    "o_sub_days": (lambda d: operators.subtract(C("l_shipdate"), 5, "days").cast("date"), "CAST(l_shipdate - INTERVAL 5 DAY AS DATE)"),
    "o_sub_dates": (lambda d: operators.subtract(C("l_shipdate"), F.lit("1995-01-01"), "dates"), "date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE))"),
    "o_neg": (lambda d: operators.minus(C("l_linenumber")), "-l_linenumber"),
    "o_concat": (lambda d: operators.concat(C("l_linenumber"), C("l_returnflag")), "CAST(l_linenumber AS VARCHAR) || l_returnflag"),
    "o_eq": (lambda d: operators.equal(C("l_linenumber"), 2), "l_linenumber = 2"),
    "o_ne": (lambda d: operators.unequal(C("l_linenumber"), 2), "l_linenumber <> 2"),
    "o_gt": (lambda d: operators.greater(C("l_linenumber"), 2), "l_linenumber > 2"),
    "o_ge": (lambda d: operators.greater_equal(C("l_linenumber"), 2), "l_linenumber >= 2"),
    "o_lt": (lambda d: operators.less(C("l_linenumber"), 2), "l_linenumber < 2"),
    "o_le": (lambda d: operators.less_equal(C("l_linenumber"), 2), "l_linenumber <= 2"),
    "o_and": (lambda d: operators.and_(C("l_linenumber") > 1, C("l_tax") > 0.03), "l_linenumber > 1 AND l_tax > 0.03"),
    "o_or": (lambda d: operators.or_(C("l_linenumber") > 1, C("l_tax") > 0.03), "l_linenumber > 1 OR l_tax > 0.03"),
    "o_not": (lambda d: operators.not_(C("l_linenumber") > 1), "NOT l_linenumber > 1"),
    "o_xor": (lambda d: operators.xor(C("l_linenumber") > 1, C("l_tax") > 0.03), "(l_linenumber > 1) <> (l_tax > 0.03)"),
}
R = lambda c: F.round(c, 6)
MATHS = {
    "m_abs": (lambda d: maths.abs_(C("c_acctbal")), "abs(c_acctbal)"),
    "m_acos": (lambda d: R(maths.acos(C("c_custkey") % 100 / 100.0)), "round(acos(c_custkey % 100 / 100.0), 6)"),
    "m_asin": (lambda d: R(maths.asin(C("c_custkey") % 100 / 100.0)), "round(asin(c_custkey % 100 / 100.0), 6)"),
    "m_atan": (lambda d: R(maths.atan("c_acctbal")), "round(atan(c_acctbal), 6)"),
    "m_atan2": (lambda d: R(maths.atan2("c_acctbal", F.lit(10.0))), "round(atan2(c_acctbal, 10.0), 6)"),
    "m_bitand": (lambda d: maths.bitand(C("c_custkey"), 12), "c_custkey & 12"),
    "m_bitor": (lambda d: maths.bitor(C("c_custkey"), 12), "c_custkey | 12"),
    "m_bitxor": (lambda d: maths.bitxor(C("c_custkey"), 12), "xor(c_custkey, 12)"),
    "m_bitlshift": (lambda d: maths.bitlshift(C("c_custkey"), 3), "c_custkey * 8"),
    "m_bitrshift": (lambda d: maths.bitrshift(C("c_custkey"), 3), "c_custkey // 8"),
    "m_ceiling": (lambda d: maths.ceiling("c_acctbal"), "CAST(ceil(c_acctbal) AS BIGINT)"),
    "m_cos": (lambda d: R(maths.cos("c_custkey")), "round(cos(c_custkey), 6)"),
    "m_cot": (lambda d: R(maths.cot(C("c_custkey") % 50 + 1.5)), "round(cot(c_custkey % 50 + 1.5), 6)"),
    "m_degrees": (lambda d: R(maths.degrees(C("c_custkey") % 50)), "round(degrees(c_custkey % 50), 6)"),
    "m_delta": (lambda d: maths.delta(C("c_nationkey"), 5), "CASE WHEN c_nationkey = 5 THEN 1 ELSE 0 END"),
    "m_even": (lambda d: maths.even(C("c_acctbal")), "CAST(CASE WHEN ceil(c_acctbal) >= 0 THEN ceil(c_acctbal)::BIGINT + ceil(c_acctbal)::BIGINT % 2 ELSE ceil(c_acctbal)::BIGINT - ceil(c_acctbal)::BIGINT % 2 END AS BIGINT)"),
    "m_odd": (lambda d: maths.odd(C("c_acctbal")), "CAST(CASE WHEN ceil(c_acctbal) >= 0 THEN ceil(c_acctbal)::BIGINT + (1 - ceil(c_acctbal)::BIGINT % 2) ELSE ceil(c_acctbal)::BIGINT - (1 - ceil(c_acctbal)::BIGINT % 2) END AS BIGINT)"),
    "m_exp": (lambda d: R(maths.exp(C("c_custkey") % 5)), "round(exp(c_custkey % 5), 6)"),
    "m_floor": (lambda d: maths.floor("c_acctbal"), "CAST(floor(c_acctbal) AS BIGINT)"),
    "m_int": (lambda d: maths.int_(C("c_acctbal")), "CAST(trunc(c_acctbal) AS BIGINT)"),
    "m_ln": (lambda d: R(maths.ln(C("c_custkey") + 1)), "round(ln(c_custkey + 1), 6)"),
    "m_log": (lambda d: R(maths.log(C("c_custkey") + 1, 3)), "round(ln(c_custkey + 1) / ln(3), 6)"),
    "m_log10": (lambda d: R(maths.log10(C("c_custkey") + 1)), "round(log10(c_custkey + 1), 6)"),
    "m_log2": (lambda d: R(maths.log2(C("c_custkey") + 1)), "round(log2(c_custkey + 1), 6)"),
    "m_mod": (lambda d: maths.mod(C("c_custkey"), 7), "c_custkey % 7"),
    "m_modulus": (lambda d: maths.modulus(C("c_custkey"), C("c_nationkey")), "c_custkey % nullif(c_nationkey, 0)"),
    "m_pi": (lambda d: R(maths.pi()), "round(pi(), 6)"),
    "m_power": (lambda d: maths.power(C("c_nationkey"), 3), "pow(c_nationkey, 3)::DOUBLE"),
    "m_product": (lambda d: maths.product(C("c_custkey"), C("c_nationkey"), 2), "c_custkey * c_nationkey * 2"),
    "m_quotient": (lambda d: maths.quotient(C("c_custkey"), C("c_nationkey")), "CAST(floor(c_custkey / nullif(c_nationkey, 0)) AS BIGINT)"),
    "m_quotient_large": (lambda d: maths.quotient(C("c_custkey") + 9007199254740993, 2), "(c_custkey + 9007199254740993) // 2"),
    "m_quotient_below": (lambda d: maths.quotient(C("c_custkey") - 50, -7), "CAST(floor((c_custkey - 50) / -7.0) AS BIGINT)"),
    "m_quotient_real": (lambda d: maths.quotient(C("c_acctbal"), 3.5), "CAST(floor(c_acctbal / 3.5) AS BIGINT)"),
    "m_bitlshift_large": (lambda d: maths.bitlshift(C("c_custkey") + 9007199254740993, 2), "(c_custkey + 9007199254740993) * 4"),
    "m_bitrshift_large": (lambda d: maths.bitrshift(C("c_custkey") + 9007199254740993, 1), "(c_custkey + 9007199254740993) // 2"),
    "m_radians": (lambda d: R(maths.radians(C("c_custkey"))), "round(radians(c_custkey), 6)"),
    "m_round": (lambda d: maths.round_(C("c_custkey") / 8, 2), "round(c_custkey / 8, 2)"),
    "m_round_by": (lambda d: maths.round_(C("c_acctbal"), C("c_custkey") % 3), "CASE c_custkey % 3 WHEN 0 THEN round(c_acctbal) WHEN 1 THEN round(c_acctbal, 1) ELSE round(c_acctbal, 2) END"),
    "m_rounddown": (lambda d: maths.rounddown(C("c_acctbal"), 1), "floor(c_acctbal * 10.0::DOUBLE) / 10.0::DOUBLE"),
    "m_roundup": (lambda d: maths.roundup(C("c_acctbal"), 1), "ceil(c_acctbal * 10.0::DOUBLE) / 10.0::DOUBLE"),
    "m_trunc": (lambda d: maths.trunc(C("c_acctbal"), 1), "CASE WHEN c_acctbal < 0 THEN ceil(c_acctbal * 10.0::DOUBLE) ELSE floor(c_acctbal * 10.0::DOUBLE) END / 10.0::DOUBLE"),
    "m_sign": (lambda d: maths.sign("c_acctbal"), "CAST(sign(c_acctbal) AS DOUBLE)"),
    "m_sin": (lambda d: R(maths.sin("c_custkey")), "round(sin(c_custkey), 6)"),
    "m_sqrt": (lambda d: R(maths.sqrt("c_custkey")), "round(sqrt(c_custkey), 6)"),
    "m_sqrtpi": (lambda d: R(maths.sqrtpi(C("c_custkey"))), "round(sqrt(c_custkey) * pi(), 6)"),
    "m_sum": (lambda d: maths.sum_(C("c_custkey"), C("c_nationkey"), 1), "c_custkey + c_nationkey + 1"),
    "m_sumsq": (lambda d: maths.sumsq(C("c_custkey"), C("c_nationkey"), 2), "c_custkey + pow(c_nationkey, 2)::DOUBLE + 4.0"),
    "m_average": (lambda d: R(maths.average(C("c_custkey"), C("c_nationkey"), 1)), "round((c_custkey + c_nationkey + 1) / 3.0::DOUBLE, 6)"),
    "m_tan": (lambda d: R(maths.tan(C("c_custkey") % 50 / 50.0)), "round(tan(c_custkey % 50 / 50.0), 6)"),
    "m_difference": (lambda d: maths.difference(C("c_custkey"), C("c_nationkey")), "c_custkey - c_nationkey"),
    "m_clip": (lambda d: maths.clip(C("c_acctbal"), 0.0, 5000.0), "least(greatest(c_acctbal, 0.0::DOUBLE), 5000.0::DOUBLE)"),
    "m_negate": (lambda d: maths.negate(C("c_custkey")), "-c_custkey"),
    "m_e": (lambda d: R(maths.e()), "round(exp(1), 6)"),
    "m_greatest": (lambda d: maths.greatest("c_custkey", C("c_nationkey").cast("long")), "greatest(c_custkey, c_nationkey)"),
    "m_least": (lambda d: maths.least("c_custkey", C("c_nationkey").cast("long")), "least(c_custkey, c_nationkey)"),
}
TEXT = {
    "t_numbervalue": (lambda d: text.numbervalue(F.right("p_brand", F.lit(2))), "TRY_CAST(right(p_brand, 2) AS DOUBLE)"),
    "t_clean": (lambda d: text.clean(F.concat("p_name", F.lit("é\t!"))), "regexp_replace(p_name || 'é' || chr(9) || '!', '[^\\x20-\\x7E]+', '', 'g')"),
    "t_code": (lambda d: text.code(C("p_name")), "ascii(p_name)"),
    "t_ascii": (lambda d: text.ascii_(C("p_brand")), "ascii(p_brand)"),
    "t_concatenate": (lambda d: text.concatenate(C("p_brand"), "-", C("p_size")), "p_brand || '-' || p_size"),
    "t_concat": (lambda d: text.concat(C("p_brand"), C("p_size")), "p_brand || p_size"),
    "t_exact": (lambda d: text.exact(C("p_brand"), "Brand#11"), "p_brand = 'Brand#11'"),
    "t_find": (lambda d: text.find("a", C("p_name")), "CAST(strpos(p_name, 'a') AS INTEGER)"),
    "t_find_columns": (lambda d: text.find(F.left("p_type", F.lit(1)), C("p_brand"), C("p_size") % 3 + 1), "CAST(CASE WHEN strpos(substr(p_brand, p_size % 3 + 1), left(p_type, 1)) = 0 THEN 0 ELSE strpos(substr(p_brand, p_size % 3 + 1), left(p_type, 1)) + p_size % 3 END AS INTEGER)"),
    "t_search": (lambda d: text.search("e", C("p_type")), "CAST(strpos(p_type, 'e') AS INTEGER)"),
    "t_fixed": (lambda d: text.fixed(C("p_size")), "CAST(p_size AS VARCHAR)"),
    "t_fixed_large": (lambda d: text.fixed(C("p_partkey") * 1.0 + 12345678.5, 2), "CAST(p_partkey + 12345678.5::DOUBLE AS VARCHAR)"),
    "t_fixed_whole": (lambda d: text.fixed(F.lit(1e20)), "'100000000000000000000'"),
    "t_concat_doubles": (lambda d: text.concatenate(C("p_retailprice") * 100000, "/", C("p_size") / 4), "CAST(p_retailprice * 100000 AS VARCHAR) || '/' || CAST(p_size / 4 AS VARCHAR)"),
    "t_left": (lambda d: text.left(C("p_name"), 3), "left(p_name, 3)"),
    "t_right": (lambda d: text.right(C("p_name"), 3), "right(p_name, 3)"),
    "t_mid": (lambda d: text.mid(C("p_name"), 2, 4), "substr(p_name, 2, 4)"),
    "t_len": (lambda d: text.len_("p_name"), "CAST(length(p_name) AS INTEGER)"),
    "t_length": (lambda d: text.length("p_type"), "CAST(length(p_type) AS INTEGER)"),
    "t_lower": (lambda d: text.lower("p_brand"), "lower(p_brand)"),
    "t_upper": (lambda d: text.upper("p_name"), "upper(p_name)"),
    "t_proper": (lambda d: text.proper(C("p_type")), "upper(left(p_type, 1)) || lower(substr(p_type, 2))"),
    "t_capitalize": (lambda d: text.capitalize(C("p_name")), "upper(left(p_name, 1)) || lower(substr(p_name, 2))"),
    "t_initcap": (lambda d: text.initcap(C("p_brand")), "upper(left(p_brand, 1)) || lower(substr(p_brand, 2))"),
    "t_rept": (lambda d: text.rept(C("p_brand"), 2), "repeat(p_brand, 2)"),
    "t_substitute": (lambda d: text.substitute(C("p_brand"), "#", "."), "replace(p_brand, '#', '.')"),
    "t_trim": (lambda d: text.trim(F.concat(F.lit(" \t"), "p_name", F.lit(" "))), "p_name"),
    "t_ltrim": (lambda d: text.ltrim(F.concat(F.lit("  "), "p_name")), "p_name"),
    "t_rtrim": (lambda d: text.rtrim(F.concat("p_name", F.lit("\n "))), "p_name"),
    "t_contains": (lambda d: text.contains(C("p_name"), "a"), "contains(p_name, 'a')"),
    "t_startswith": (lambda d: text.startswith(C("p_brand"), "Brand#1"), "starts_with(p_brand, 'Brand#1')"),
    "t_endswith": (lambda d: text.endswith(C("p_brand"), "2"), "ends_with(p_brand, '2')"),
    "t_hash_same": (lambda d: text.hash_(C("p_brand"), C("p_size")) == text.hash_(F.concat(C("p_brand"), C("p_size").cast("string"))), "true"),
    "t_like": (lambda d: text.like(C("p_type"), "%E%"), "p_type LIKE '%E%'"),
    "t_ilike": (lambda d: text.ilike(C("p_type"), "%e%"), "p_type ILIKE '%e%'"),
    "t_join": (lambda d: text.join("/", C("p_brand"), C("p_size"), F.nullif("p_type", "p_type")), "p_brand || '/' || p_size"),
    "t_lpad": (lambda d: text.lpad(C("p_size").cast("string"), 5, "0"), "lpad(CAST(p_size AS VARCHAR), 5, '0')"),
    "t_rpad": (lambda d: text.rpad(C("p_size").cast("string"), 5, "."), "rpad(CAST(p_size AS VARCHAR), 5, '.')"),
    "t_regex_extract": (lambda d: text.regex_extract(C("p_brand"), r"#(\d)", 1), "CASE WHEN regexp_matches(p_brand, '#(\\d)') THEN regexp_extract(p_brand, '#(\\d)', 1) END"),
    "t_regex_extract_whole": (lambda d: text.regex_extract(C("p_name"), "[aeiou]z", 2), "CASE WHEN regexp_matches(p_name, '[aeiou]z') THEN regexp_extract(p_name, '[aeiou]z', 0) END"),
    "t_regex_replace": (lambda d: text.regex_replace(C("p_brand"), r"(\d)(\d)", r"\2\1"), "regexp_replace(p_brand, '(\\d)(\\d)', '\\2\\1', 'g')"),
    "t_regex_search": (lambda d: text.regex_search(C("p_name"), "a.*e"), "regexp_matches(p_name, 'a.*e')"),
    "t_reverse": (lambda d: text.reverse("p_brand"), "reverse(p_brand)"),
    "t_timestamp": (lambda d: text.timestamp(F.concat(F.lit("2024-03-0"), (C("p_size") % 9 + 1).cast("string"), F.lit(" 10:20")), "%Y-%m-%d %H:%M"), "strptime('2024-03-0' || (p_size % 9 + 1) || ' 10:20', '%Y-%m-%d %H:%M')"),
    "t_translate": (lambda d: text.translate("p_brand", "Bd", "bD"), "translate(p_brand, 'Bd', 'bD')"),
    "t_levenshtein": (lambda d: text.levenshtein("p_brand", F.lit("Brand#99")), "CAST(levenshtein(p_brand, 'Brand#99') AS INTEGER)"),
    "t_split_size": (lambda d: F.size(text.split(C("p_brand"), "#")), "CAST(len(string_split(p_brand, '#')) AS INTEGER)"),
    "t_split_part": (lambda d: text.split_part(C("p_brand"), "#", 2), "string_split(p_brand, '#')[2]"),
    "t_split_part_out": (lambda d: text.split_part(C("p_brand"), "#", 9), "string_split(p_brand, '#')[9]"),
}
O = "o_orderdate"
DATES = {
    "d_date_parts": (lambda d: dates.date(dates.year(O), dates.month(O), 1), "make_date(year(o_orderdate), month(o_orderdate), 1)"),
    "d_date_text": (lambda d: dates.date(F.date_format(O, "dd/MM/yyyy"), "%d/%m/%Y"), "CAST(o_orderdate AS DATE)"),
    "d_date": (lambda d: dates.date(C(O)), "CAST(o_orderdate AS DATE)"),
    "d_day": (lambda d: dates.day(O), "CAST(day(o_orderdate) AS INTEGER)"),
    "d_month": (lambda d: dates.month(O), "CAST(month(o_orderdate) AS INTEGER)"),
    "d_year": (lambda d: dates.year(O), "CAST(year(o_orderdate) AS INTEGER)"),
    "d_days": (lambda d: dates.days(C(O), F.lit("1995-06-01 12:00:00")), "CAST(floor((epoch(o_orderdate) - epoch(TIMESTAMP '1995-06-01 12:00:00')) / 86400) AS BIGINT)"),
    "d_edate": (lambda d: dates.edate(C(O).cast("date"), 3), "CAST(CAST(o_orderdate AS DATE) + INTERVAL 3 MONTH AS DATE)"),
    "d_hours": (lambda d: dates.hours(O), "CAST(hour(o_orderdate) AS INTEGER)"),
    "d_minutes": (lambda d: dates.minutes(O), "CAST(minute(o_orderdate) AS INTEGER)"),
    "d_seconds": (lambda d: dates.seconds(O), "CAST(second(o_orderdate) AS INTEGER)"),
    "d_hour": (lambda d: dates.hour(O), "CAST(hour(o_orderdate) AS INTEGER)"),
    "d_minute": (lambda d: dates.minute(O), "CAST(minute(o_orderdate) AS INTEGER)"),
    "d_second": (lambda d: dates.second(O), "CAST(second(o_orderdate) AS INTEGER)"),
    "d_time_parts": (lambda d: dates.time(dates.hour(O), 5, 9), "printf('%02d:05:09', hour(o_orderdate))"),
    "d_time": (lambda d: dates.time(C(O)), "strftime(o_orderdate, '%H:%M:%S')"),
    "d_datetime_parts": (lambda d: dates.datetime(dates.year(O), 2, 3, 4, 5, 6), "make_timestamp(year(o_orderdate), 2, 3, 4, 5, 6)"),
    "d_datetime": (lambda d: dates.datetime(C(O)), "CAST(o_orderdate AS TIMESTAMP)"),
    "d_isoweeknum": (lambda d: dates.isoweeknum(O), "CAST(weekofyear(o_orderdate) AS INTEGER)"),
    "d_weekday": (lambda d: dates.weekday(C(O)), "CAST(dayofweek(o_orderdate) AS INTEGER)"),
    "d_weeknum": (lambda d: dates.weeknum(C(O)), "CAST(strftime(o_orderdate, '%U') AS BIGINT)"),
    "d_datetimediff": (lambda d: dates.datetimediff(C(O), F.lit("1990-01-01"), "M"), "CAST(floor((epoch(o_orderdate) - epoch(TIMESTAMP '1990-01-01')) / (86400 * 30)) AS BIGINT)"),
    "d_datediff": (lambda d: dates.datediff(C(O), F.lit("1990-01-01").cast("date"), "Y"), "CAST(floor(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) / 365) AS BIGINT)"),
    "d_n": (lambda d: dates.n(C("o_totalprice") > 1000), "CAST(o_totalprice > 1000 AS INTEGER)"),
    "d_quarter": (lambda d: dates.quarter(O), "CAST(quarter(o_orderdate) AS INTEGER)"),
    "d_day_of_year": (lambda d: dates.day_of_year(O), "CAST(dayofyear(o_orderdate) AS INTEGER)"),
    "d_epoch_seconds": (lambda d: dates.epoch_seconds(C(O)), "CAST(epoch(o_orderdate) AS BIGINT)"),
    "d_strftime": (lambda d: dates.strftime(C(O), "%Y/%m/%d at %H:%M"), "strftime(o_orderdate, '%Y/%m/%d at %H:%M')"),
    "d_millisecond": (lambda d: dates.millisecond(C(O)), "CAST(millisecond(o_orderdate) % 1000 AS BIGINT)"),
    "d_microsecond": (lambda d: dates.microsecond(C(O)), "CAST(microsecond(o_orderdate) % 1000000 AS BIGINT)"),
    "d_trunc_week": (lambda d: dates.date_trunc(C(O), "week"), "CAST(date_trunc('week', o_orderdate) AS TIMESTAMP)"),
    "d_trunc_month": (lambda d: dates.date_trunc(C(O), "M"), "CAST(date_trunc('month', o_orderdate) AS TIMESTAMP)"),
    "d_trunc_codes": (lambda d: F.concat_ws(" ", *(dates.date_trunc(C(O), u).cast("string") for u in ("Y", "Q", "w", "D", "h", "minutes", "S"))), "concat_ws(' ', " + ", ".join(f"strftime(date_trunc('{u}', o_orderdate), '%Y-%m-%d %H:%M:%S')" for u in ("year", "quarter", "week", "day", "hour", "minute", "second")) + ")"),
    "d_past": (lambda d: (dates.now() > C(O)) & (dates.today() > C(O).cast("date")), "true"),
}
BASE = {
    "b_cast": (lambda d: base.cast(C("s_suppkey"), "TEXT"), "CAST(s_suppkey AS VARCHAR)"),
    "b_duplicate": (lambda d: base.duplicate(C("s_name")), "s_name"),
    "b_isin": (lambda d: base.isin(C("s_nationkey"), 1, 5, 9), "s_nationkey IN (1, 5, 9)"),
    "b_notin": (lambda d: base.notin(C("s_nationkey"), 1, 5, 9), "s_nationkey NOT IN (1, 5, 9)"),
    "b_gestep": (lambda d: base.gestep(C("s_acctbal"), 100), "CASE WHEN s_acctbal >= 100 THEN 1 ELSE 0 END"),
    "b_random": (lambda d: (maths.random(3) >= 0) & (maths.random(4) < 1), "true"),
}


def window_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority")
    w, p = windows.window(["o_custkey"], ["o_orderkey"]), windows.window(["o_custkey"], ["o_orderpriority"])
    r = lambda c: F.round(c, 2)
    return d.select(
        "o_custkey", "o_orderkey", windows.lag("o_orderkey", w).alias("w_lag"), windows.lag("o_orderkey", w, 2, -1).alias("w_lag2"), windows.lead("o_orderkey", w).alias("w_lead"),
        r(windows.cumsum("o_totalprice", w)).alias("w_cumsum"), F.round(windows.cummean("o_totalprice", w), 4).alias("w_cummean"), windows.cummin("o_totalprice", w).alias("w_cummin"), windows.cummax("o_totalprice", w).alias("w_cummax"),
        windows.first(C("o_orderpriority"), w, text=True).alias("w_first"), windows.last(C("o_orderpriority"), w, text=True).alias("w_last"),
        windows.row_number(w).alias("w_row_number"), windows.rank(p).alias("w_rank"), windows.dense_rank(p).alias("w_dense_rank"), R(windows.percent_rank(p)).alias("w_percent_rank"),
    )


WINDOW_SQL = """
SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER w AS w_lag, lag(o_orderkey, 2, -1) OVER w AS w_lag2, lead(o_orderkey) OVER w AS w_lead,
  round(sum(o_totalprice) OVER r, 2) AS w_cumsum, round(avg(o_totalprice) OVER r, 4) AS w_cummean, min(o_totalprice) OVER r AS w_cummin,
  max(o_totalprice) OVER r AS w_cummax, first_value(o_orderpriority) OVER a AS w_first, last_value(o_orderpriority) OVER a AS w_last,
  CAST(row_number() OVER w AS INTEGER) AS w_row_number, CAST(rank() OVER p AS INTEGER) AS w_rank, CAST(dense_rank() OVER p AS INTEGER) AS w_dense_rank,
  round(percent_rank() OVER p, 6) AS w_percent_rank
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey), p AS (PARTITION BY o_custkey ORDER BY o_orderpriority),
  r AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  a AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""


def table_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    r = lambda c: F.round(c, 4)
    return maths.with_statistics(
        d, s_max=maths.max_of("p_retailprice"), s_min=maths.min_of("p_retailprice"), s_median=maths.median("p_size"), s_quantile=maths.quantile("p_size", 0.9), s_price_median=maths.median("p_retailprice"),
        s_variance=r(maths.variance("p_size")), s_stddev=r(maths.stddev("p_size")), s_cov=r(maths.cov("p_size", "p_partkey")),
    )


STATISTICS_SQL = """
SELECT p_partkey, p_size, p_retailprice, s.* FROM part, (SELECT max(p_retailprice) AS s_max, min(p_retailprice) AS s_min,
  CAST(median(p_size) AS DOUBLE) AS s_median, CAST(quantile_cont(p_size, 0.9) AS DOUBLE) AS s_quantile, CAST(median(p_retailprice) AS DOUBLE) AS s_price_median, round(var_samp(p_size), 4) AS s_variance,
  round(stddev_samp(p_size), 4) AS s_stddev, round(covar_samp(p_size, p_partkey), 4) AS s_cov FROM part) s
"""

QUERIES, ORACLES = {}, {}
for _name, _args in {
    "formula_logic": ("lineitem", ["l_orderkey", "l_linenumber"], LOGIC),
    "formula_operators": ("lineitem", ["l_orderkey", "l_linenumber"], OPERATORS),
    "formula_maths": ("customer", ["c_custkey"], MATHS),
    "formula_text": ("part", ["p_partkey"], TEXT),
    "formula_dates": ("orders", ["o_orderkey"], DATES),
    "formula_base": ("supplier", ["s_suppkey"], BASE),
}.items():
    QUERIES[_name], ORACLES[_name] = _query(*_args)
QUERIES |= {"formula_windows": window_formulas, "formula_table_statistics": table_statistics}
ORACLES |= {"formula_windows": WINDOW_SQL, "formula_table_statistics": STATISTICS_SQL}
