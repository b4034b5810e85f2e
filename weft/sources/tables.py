"""Sources: catalog tables, CSV seeds, JDBC, listings, previews and guarded SQL."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weft.operators.shaping import order_keys


def scan(spark: SparkSession, name: str, schema: str | None = None) -> DataFrame:
    """A table of the catalog."""
    return spark.table(f"{schema}.{name}" if schema else name)


def clean_header(name: str) -> str:
    """Spaces and slashes become ``_``, quotes and other odd characters go; an empty header is an error."""
    out = re.sub(r"[^A-Za-z0-9_]", "", re.sub(r"[\s/]", "_", name.strip().replace('"', "").replace("'", "")))
    if not out:
        raise ValueError("a column has no name")
    return out


def seed(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header; types are inferred, and a text column of which every value is a time becomes one.

    One more aggregate over the text columns decides the latter.
    """
    df = spark.read.csv(path, header=True, inferSchema=True)
    names = [clean_header(c) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError("two columns have one name")
    df = df.toDF(*names)
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    if not texts:
        return df
    time = {c: F.try_to_timestamp(F.col(c)) for c in texts}
    row = df.agg(*(((F.count(c) > 0) & (F.count(c) == F.count(t))).alias(c) for c, t in time.items())).first()
    return df.withColumns({c: t for c, t in time.items() if row[c]})


def table_name(path: str) -> str:
    """The table that a seed file becomes."""
    return re.sub(r"[-\s]", "_", path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0])


def load_seeds(spark: SparkSession, paths: list[str], schema: str = "default", at_once: int = 4) -> DataFrame:
    """Load CSV files as tables, some at once; (path, table, ok, message) for each."""

    def one(path: str) -> tuple[str, str, bool, str]:
        name = table_name(path)
        try:
            seed(spark, path).write.mode("overwrite").saveAsTable(f"{schema}.{name}")
            return path, name, True, ""
        except Exception as e:  # a bad file must not stop the others
            return path, name, False, str(e)[:200]

    with ThreadPoolExecutor(at_once) as pool:
        return spark.createDataFrame(list(pool.map(one, paths)), "path string, table string, ok boolean, message string")


def jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A table of a database with a JDBC driver on the class path; ``key`` splits the reading into ``parts`` ranges."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key:
        reader = reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


def listing(spark: SparkSession) -> DataFrame:
    """(schema, table, column, type, nullable) of all tables in the catalog."""
    rows = []
    for d in spark.catalog.listDatabases():
        for t in spark.catalog.listTables(d.name):
            full = f"{d.name}.{t.name}" if not t.isTemporary else t.name
            rows += [(d.name, t.name, f.name, f.dataType.simpleString(), f.nullable) for f in spark.table(full).schema.fields]
    return spark.createDataFrame(rows, "schema string, table string, column string, type string, nullable boolean")


def columns(df: DataFrame) -> DataFrame:
    """(column, type, nullable, kind) of a DataFrame; kind is String, Number, Date, Time, Boolean or Interval."""
    kinds = {"string": "String", "boolean": "Boolean", "date": "Date"}

    def kind(t: str) -> str:
        return kinds.get(t) or ("Time" if t.startswith("timestamp") else "Interval" if t.startswith("interval") else "Number" if re.match(r"(tiny|small|big)?int|float|double|decimal", t) else "String")

    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable, kind(f.dataType.simpleString())) for f in df.schema.fields], "column string, type string, nullable boolean, kind string")


def preview(df: DataFrame, names: list[str], keys: list[tuple[str, str]], limit: int = 100, page: int = 1) -> DataFrame:
    """A page of some columns; ``keys`` must name every row once for pages that fit together."""
    return df.orderBy(*order_keys(keys)).offset(limit * (page - 1)).limit(limit).select(*names)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))


def sample(df: DataFrame, rows: int = 5, of: int = 100, seed_: int = 0, most: int = 100) -> DataFrame:
    """Some of the first rows at random, with long texts cut."""
    cut = {f.name: F.when(F.length(f.name) > most, F.concat(F.left(f.name, F.lit(most)), F.lit("...(truncated)"))).otherwise(F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, StringType)}
    return df.limit(of).orderBy(F.rand(seed_)).limit(rows).withColumns(cut)


def query(spark: SparkSession, sql: str, limit: int = 100) -> DataFrame:
    """The first rows of a SELECT; statements with DELETE or TRUNCATE are refused."""
    bare = re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S)
    if re.search(r"\b(?:DELETE|TRUNCATE)\b", bare, re.I):
        raise ValueError("DELETE and TRUNCATE are refused")
    return spark.sql(sql).limit(limit)
