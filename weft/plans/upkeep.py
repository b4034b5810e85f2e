"""Table upkeep: full loads, views, append, merge and high-water-mark loads on versioned Parquet tables.

A table is a folder with data folders and a pointer that names those of the current version. New data is written next to
the old, then the pointer moves on, so a failed job leaves the table as it was and no job overwrites what it reads. An
append writes the new rows alone. A keyed table is cut into buckets by a hash of its keys, and a merge writes the buckets
again that the delta touches, not the others. Two writers can't take the same version: the later one gets an error.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.operators.shaping import visible

#: Parts that a keyed table is cut into unless it is made with another number, and the columns that name a row's and its
#: folder.
BUCKETS, BUCKET, FOLDER = 64, "_bucket", "_v"
#: A version with more folders of one kind than this gets those of fewer bytes than SMALL as one.
FOLDERS, SMALL = 64, 64 << 20


Part = tuple[str, list[int], str]


class Conflict(RuntimeError):
    """Another writer has taken the version."""


class Table:
    """A versioned Parquet table at a path that Spark can reach.

    A version lists (folder, buckets, schema); a folder without buckets counts whole. Keyed versions hold the column BUCKET
    as a partition of their folders, which readers do not see. A table keeps the number of buckets that it was made with;
    a large one wants so many that a bucket is what a small merge may write again. Folders of one schema are read in one
    scan. Versions also hold marks, such as the last batch of each stream, so that rows and mark come together.

    That two writers can't take one version rests on a file system whose rename is atomic and refuses a name that is taken
    (HDFS, local disks). On an object store without that, let one writer at a time work on a table.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._marks: dict[str, int] = {}
        self._coming: dict[str, int] = {}

    def _files(self):  # noqa: ANN202
        """Hadoop's file system of the table, which Spark itself writes through."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/current")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _versions(self) -> list[int]:
        files, path = self._files()
        place = path(f"{self.path}/current")
        return sorted(int(x.getPath().getName()) for x in files.listStatus(place) if x.getPath().getName().isdigit()) if files.exists(place) else []

    def _version(self, number: int | None = None) -> tuple[int, list[Part], list[str]]:
        """The number of a version (the current one; 0 for none), its folders with their buckets, and its keys."""
        numbers = self._versions()
        if not numbers:
            self._marks = {}
            return 0, [], []
        number = number or numbers[-1]
        lines = self._lines(f"{self.path}/current/{number:08d}")
        parts = [(f, [int(x) for x in bs.split(",") if x], schema) for f, bs, schema in (x.split(" ", 2) for x in lines if x.startswith(("v-", f"{FOLDER}=")))]
        said = {x.split(" ", 1)[0]: json.loads(x.split(" ", 1)[1]) for x in lines if x.startswith(("keys ", "marks "))}
        self._marks = said.get("marks", {})
        # Tables of earlier releases were cut by the keys' texts: they count as not cut, so the next merge cuts them anew.
        self.buckets, keys, *typed = said.get("keys", [self.buckets, [], True])
        return number, parts, keys if typed else []

    def marks(self) -> dict[str, int]:
        """The marks of the current version."""
        self._version()
        return dict(self._marks)

    @contextmanager
    def marking(self, name: str, value: int) -> Iterator[None]:
        """Versions that are made within also set a mark."""
        self._coming = {name: value}
        try:
            yield
        finally:
            self._coming = {}

    def _lines(self, place: str) -> list[str]:
        """The few lines of a version, without a Spark job."""
        files, path = self._files()
        found: list[str] = []
        for status in files.listStatus(path(place)):
            stream = files.open(status.getPath())
            try:
                found += bytes(self.spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode().splitlines()
            finally:
                stream.close()
        return found

    def exists(self) -> bool:
        return bool(self._versions())

    def read(self) -> DataFrame:
        number, parts, _ = self._version()
        if not number:
            raise ValueError(f"no table at {self.path}")
        return self._read(parts)

    def schema(self) -> T.StructType:
        """Columns of the current version, without looking at its files."""
        return _united([schema for _, _, schema in self._version()[1]])

    def _read(self, parts: list[Part]) -> DataFrame:
        """The rows of some folders: one scan for each schema, whatever the number of folders."""
        groups: dict[tuple[str, str], list[Part]] = {}
        for folder, buckets, schema in parts:
            groups.setdefault((schema, "" if not buckets else FOLDER if folder.startswith(FOLDER) else folder), []).append((folder, buckets, schema))
        frames = []
        for (schema, kind), own in groups.items():
            fields, paths = T.StructType.fromJson(json.loads(schema)), [f"{self.path}/{f}" for f, _, _ in own]
            if not kind:
                frames.append(self.spark.read.schema(fields).parquet(*paths))
            elif kind != FOLDER:
                frames.append(self.spark.read.schema(fields.add(BUCKET, T.IntegerType())).parquet(*paths).where(F.col(BUCKET).isin(own[0][1])).drop(BUCKET))
            else:
                df = self.spark.read.schema(fields.add(FOLDER, T.StringType()).add(BUCKET, T.IntegerType())).option("basePath", self.path).parquet(*paths)
                alike: dict[tuple[int, ...], list[str]] = {}
                for f, bs, _ in own:
                    alike.setdefault(tuple(bs), []).append(f.split("=", 1)[1])
                there = reduce(lambda a, b: a | b, [F.col(FOLDER).isin(fs) & F.col(BUCKET).isin(list(bs)) for bs, fs in alike.items()])
                frames.append(df.where(there).drop(FOLDER, BUCKET))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    def _written(self, df: DataFrame, keys: list[str], buckets: Iterable[int] | None = None) -> Part:
        """The rows of ``df`` in a new folder, by bucket if there are keys. Adaptive execution deals a large bucket to
        several tasks and several small ones to one."""
        name = uuid.uuid4().hex[:12]
        folder = f"{FOLDER}=t{name}" if keys else f"v-{name}"
        if keys:
            df.withColumn(BUCKET, bucket_of(df, keys, self.buckets)).hint("rebalance", F.col(BUCKET)).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        else:
            df.write.parquet(f"{self.path}/{folder}")
        fields = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])
        return folder, sorted(range(self.buckets) if buckets is None else buckets) if keys else [], fields.json()

    def _commit(self, number: int, parts: list[Part], keys: list[str]) -> None:
        """Make a version the current one. Its file is written aside and renamed, which fails if the number is taken."""
        lines = [f"keys {json.dumps([self.buckets, keys, 'typed'])}"] if keys else []
        if marks := self._marks | self._coming:
            lines.append(f"marks {json.dumps(marks)}")
        lines += [f"{f} {','.join(map(str, bs))} {schema}" for f, bs, schema in parts]
        aside = f"{self.path}/current/.{uuid.uuid4().hex}"
        files, path = self._files()
        stream = files.create(path(f"{aside}/part-0"), False)
        try:
            stream.write(bytearray("\n".join(lines).encode()))
        finally:
            stream.close()
        to = path(f"{self.path}/current/{number:08d}")
        # A rename onto a folder would move into it, so that is looked at first and afterwards.
        if files.exists(to) or not files.rename(path(aside), to) or files.exists(path(f"{to.toString()}/{aside.rsplit('/', 1)[1]}")):
            files.delete(path(aside), True)
            files.delete(path(f"{to.toString()}/{aside.rsplit('/', 1)[1]}"), True)
            raise Conflict(f"version {number} of {self.path} is taken")

    def write(self, df: DataFrame, keep: bool = False, keys: list[str] | None = None) -> None:
        """A new version of the rows of ``df``, next to those of the current version if ``keep``; cut by ``keys`` if given."""
        number, parts, old = self._version()
        keys = old if keep else (keys or [])
        own = self._written(df, keys)
        self._commit(number + 1, [*(parts if keep else []), own], keys)
        if keep and len(parts) >= FOLDERS:
            self.compact()

    def compact(self) -> int:
        """A new version in which the small folders of a kind (with or without buckets) are one, where there are more than
        FOLDERS of them; how many folders went into others."""
        number, parts, keys = self._version()
        gone = 0
        for keyed in (False, True):
            small = [p for p in parts if bool(p[1]) == keyed and self._bytes(p[0]) < SMALL] if len(parts) > FOLDERS else []
            # Rows in buckets of other keys are left as they are.
            if len(small) > FOLDERS // 2 and (keys or not keyed):
                buckets = sorted({b for _, bs, _ in small for b in bs})
                parts = [*(p for p in parts if p not in small), self._written(self._read(small).select(*_united([x for *_, x in small]).names), keys if keyed else [], buckets)]
                gone += len(small)
        if gone:
            self._commit(number + 1, parts, keys)
        return gone

    def _bytes(self, folder: str) -> int:
        files, path = self._files()
        return files.getContentSummary(path(f"{self.path}/{folder}")).getLength()

    def merge(self, delta: DataFrame, keys: list[str]) -> None:
        """A new version with the rows of ``delta`` in place of those of equal keys. Only touched buckets are written.

        Null keys are equal to one another, and so are 0.0 and -0.0. The delta takes the table's types. A table that is not
        cut by these keys yet is written anew once. The delta is kept first, as it is read for its buckets and for its rows;
        one number a touched bucket reaches the driver.
        """
        number, parts, cut = self._version()
        now = self._read(parts)
        delta = delta.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in now.schema.fields))
        if cut != keys:
            return self._commit(number + 1, [self._written(merged(now, delta, keys), keys)], keys)
        coming = f"v-{uuid.uuid4().hex[:12]}"
        delta.select(*now.columns).write.parquet(f"{self.path}/{coming}")
        delta = self.spark.read.schema(now.schema).parquet(f"{self.path}/{coming}")
        touched = {r[0] for r in delta.select(bucket_of(delta, keys, self.buckets)).distinct().collect()}
        if touched:
            whole = [p for p in parts if not p[1]]
            old = [(f, [b for b in bs if b in touched], schema) for f, bs, schema in parts if set(bs) & touched]
            target = self._read(old + whole).select(*now.columns) if old else now.limit(0)
            own = self._written(merged(target, delta, keys), keys, touched)
            rest = [(f, left, schema) for f, bs, schema in parts if (left := [b for b in bs if b not in touched])]
            self._commit(number + 1, [*rest, *whole, own], keys)
        self._delete([coming])
        return None

    def _delete(self, folders: list[str]) -> None:
        files, path = self._files()
        for f in folders:
            files.delete(path(f"{self.path}/{f}"), True)

    def vacuum(self, versions: int = 1) -> int:
        """Delete folders and buckets that none of the last ``versions`` versions has, and older versions; how many.

        Not while others read older versions or write.
        """
        numbers, kept = self._versions(), {}
        for n in numbers[-versions:]:
            for folder, buckets, _ in self._version(n)[1]:
                kept.setdefault(folder, set()).update(buckets)
        files, path = self._files()
        names = lambda place: [x.getPath().getName() for x in files.listStatus(path(place))]
        gone = [f for f in names(self.path) if f.startswith(("v-", f"{FOLDER}=")) and f not in kept]
        for folder, buckets in kept.items():
            gone += [f"{folder}/{x}" for x in names(f"{self.path}/{folder}") if buckets and x.startswith(f"{BUCKET}=") and int(x.split("=")[1]) not in buckets]
        self._delete(gone + [f"current/{n:08d}" for n in numbers[:-versions]])
        return len(gone)


def _united(schemas: list[str]) -> T.StructType:
    """The columns of all schemas, in the order of their first coming."""
    found: dict[str, T.StructField] = {}
    for x in schemas:
        for f in T.StructType.fromJson(json.loads(x)).fields:
            found.setdefault(f.name, f)
    return T.StructType(list(found.values()))


def bucket_of(df: DataFrame, keys: list[str], buckets: int = BUCKETS) -> Column:
    """The bucket of a row of ``df``, by the values of its keys: no setting of a session has a part in it. Callers bring the
    keys to the table's types first."""

    def value(k: str) -> Column:
        c = F.col(f"`{k}`")
        return F.when(c == 0, F.lit(0.0)).otherwise(c) if df.schema[k].dataType.typeName() in ("float", "double") else c

    return F.pmod(F.xxhash64(*(value(k) for k in keys)), F.lit(buckets)).cast("int")


def full(table: Table, df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """TABLE: a new version of all rows."""
    table.write(df, keys=keys)
    return table.read()


def view(df: DataFrame, name: str) -> DataFrame:
    """VIEW: a name for the query, nothing written."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def ephemeral(df: DataFrame) -> DataFrame:
    """EPHEMERAL: the plan itself."""
    return df


def checked_keys(df: DataFrame, keys: list[str], latest_by: str | None = None) -> DataFrame:
    """``df`` with one row for each key: repeated keys are an error, or the latest by a column stays. Rows with a null key
    stay all."""
    has = ~F.greatest(*(F.col(k).isNull() for k in keys), F.lit(False))
    if latest_by:
        rest = [c for c in df.columns if c not in keys]
        newest = df.where(has).groupBy(*keys).agg(F.max(F.struct(F.col(latest_by).alias("_by"), *rest)).alias("_r"))
        return newest.select(*(F.col(c) if c in keys else F.col(f"_r.{c}") for c in df.columns)).unionByName(df.where(~has))
    if not df.where(has).groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError("repeated keys in the source")
    return df


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def merged(target: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Target rows without a match, and all rows of the delta. Null keys are equal to one another."""
    new = delta.select(*target.columns)
    return target.join(delta.select(*keys), _same(target, delta, keys), "left_anti").unionByName(new)


def drifted(table: Table, df: DataFrame) -> bool:
    """Whether the sets of column names differ; types are not looked at."""
    return set(table.schema().names) != set(df.columns)


def add_column(table: Table, name: str, kind: str) -> DataFrame:
    """A new column, null in all rows there are: a version with one more folder, which has no rows but the column."""
    number, parts, keys = table._version()
    now = table.read()
    if name in now.columns:
        raise ValueError(f"the table has a column {name}")
    table._commit(number + 1, [*parts, table._written(now.limit(0).withColumn(name, F.lit(None).cast(kind)), [])], keys)
    return table.read()


def append(table: Table, df: DataFrame) -> DataFrame:
    """All rows of ``df`` beside those of the table, by column name; what is there is not written again, but small folders
    become one from time to time."""
    if table.exists():
        df = df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in table.schema().fields))
    table.write(df, keep=True)
    return table.read()


insert_into = append


def export_csv(df: DataFrame, path: str, columns: list[str] | None = None, hidden: list[str] = ()) -> None:
    """All rows of the visible columns as CSV files with a header."""
    visible(df, columns, hidden).write.mode("overwrite").csv(path, header=True)


def dump(tables: dict[str, DataFrame], path: str) -> None:
    """All tables below one folder, as Parquet."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def restore(spark: SparkSession, names: list[str], path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


# Delta strategies: (source, destination, options) -> the source rows to load.


def above_mark(source: DataFrame, destination: DataFrame, options: dict[str, Any]) -> DataFrame:
    """Rows whose column is above the destination's greatest value: for times, dates and sequences.

    A destination without values means a first run: all rows, those with a null too.
    """
    c = options["column"]
    mark = destination.agg(F.max(c).alias("_mark"))
    return source.join(F.broadcast(mark), F.col("_mark").isNull() | (F.col(c) > F.col("_mark"))).drop("_mark")


def changed_rows(source: DataFrame, destination: DataFrame, options: dict[str, Any]) -> DataFrame:
    """Rows whose key is new or whose other columns differ, by a checksum. Null keys are equal to one another.

    Rows fall into ``options["buckets"]`` (4096) parts by key. Both sides are first read for a digest of each part, which
    is combined before it is shuffled; only rows of parts whose digests differ are compared with one another.
    """
    keys, n = options["key_columns"], options.get("buckets", 4096)
    rest = [c for c in source.columns if c not in keys]
    text = lambda cs: [x for c in cs for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`").cast("string"))]
    check, part = F.xxhash64(*text(rest), F.lit(0)), F.pmod(F.xxhash64(*text(keys)), F.lit(n)).cast("int").alias("_part")
    row = F.xxhash64(*text(keys), check)

    def digests(df: DataFrame) -> DataFrame:
        return df.groupBy(part).agg(F.struct(F.count(F.lit(1)), F.bit_xor(row), F.sum(F.shiftright(row, 32))).alias("_digest"))

    was = digests(destination).withColumnRenamed("_digest", "_old")
    # At most n rows.
    unequal = F.broadcast(digests(source).join(was, "_part", "left").where(~F.col("_digest").eqNullSafe(F.col("_old"))).select("_part"))
    some = source.withColumn("_part", part).join(unequal, "_part", "left_semi").drop("_part")
    known = destination.select(*keys, check.alias("_was"), part).join(unequal, "_part", "left_semi").drop("_part").distinct()
    return some.join(known, _same(some, known, keys) & (known["_was"] == check), "left_anti")


def full_scan(source: DataFrame, destination: DataFrame, options: dict[str, Any]) -> DataFrame:
    return source


def custom(source: DataFrame, destination: DataFrame, options: dict[str, Any]) -> DataFrame:
    return options["function"](source, destination, options)


STRATEGIES: dict[str, tuple[Callable[..., DataFrame], str | None]] = {
    "timestamp": (above_mark, "column"), "date": (above_mark, "column"), "sequence": (above_mark, "column"), "checksum": (changed_rows, "key_columns"), "full_scan": (full_scan, None), "custom": (custom, "function"),
}


@dataclass(frozen=True)
class Load:
    """How a model is kept: materialization, keys and delta strategy; ``run`` may override any of them for one run."""

    materialization: str = "TABLE"
    keys: tuple[str, ...] = ()
    strategy: str = "full_scan"
    options: dict[str, Any] | None = None
    latest_by: str | None = None

    def checked(self) -> Load:
        if self.materialization not in ("TABLE", "VIEW", "EPHEMERAL", "INCREMENTAL"):
            raise ValueError(f"unknown materialization {self.materialization}")
        if self.materialization == "INCREMENTAL":
            if self.strategy not in STRATEGIES:
                raise ValueError(f"unknown strategy {self.strategy}")
            needed = STRATEGIES[self.strategy][1]
            if needed and not (self.options or {}).get(needed):
                raise ValueError(f"{self.strategy} needs {needed}")
        return self


def run(df: DataFrame, table: Table, load: Load, name: str = "model", **override: Any) -> DataFrame:
    """Bring a table up to date with a model's rows.

    Incremental: the first run and a change of column names load all; otherwise the strategy picks rows of ``df``, which
    are merged by key or, without keys, appended. ``override`` takes fields of the load for this run alone.
    """
    load = replace(load, **override).checked()
    if load.materialization == "VIEW":
        return view(df, name)
    if load.materialization == "EPHEMERAL":
        return ephemeral(df)
    keys = list(load.keys)
    if load.materialization == "TABLE" or not table.exists() or drifted(table, df):
        return _whole(df, table, load)
    delta = STRATEGIES[load.strategy][0](df, table.read(), load.options or {})
    if not keys:
        return append(table, delta)
    table.merge(checked_keys(delta, keys, load.latest_by), keys)
    return table.read()


def _whole(df: DataFrame, table: Table, load: Load) -> DataFrame:
    keys = list(load.keys)
    return full(table, checked_keys(df, keys, load.latest_by) if keys else df, keys)


def run_or_reload(df: DataFrame, table: Table, load: Load, **override: Any) -> DataFrame:
    """An incremental run; where it fails, a full load with the same checks. Wrong settings, repeated keys and another
    writer are no reason to load all."""
    try:
        return run(df, table, load, **override)
    except (ValueError, TypeError, Conflict):
        raise
    except Exception:
        return _whole(df, table, replace(load, **override))


# High-water marks kept outside the table.


def has_new(source: DataFrame, column: str, mark: Any) -> bool:
    """Whether any row is above the mark (any row at all without a mark)."""
    return not (source if mark is None else source.where(F.col(column) > F.lit(mark))).isEmpty()


def advance(source: DataFrame, column: str, mark: Any, kind: str) -> DataFrame:
    """(old_value, new_value, rows): the greatest value as text and the rows above the old mark; one aggregate."""
    c = F.col(column)
    old = F.lit(mark).cast(kind)
    above = F.lit(True) if mark is None else c > old
    row = source.agg(F.max(c).cast("string").alias("new_value"), F.count(F.when(above & c.isNotNull(), 1)).alias("rows"))
    return row.select(old.cast("string").alias("old_value"), "new_value", "rows")


def advance_kept(source: DataFrame, column: str, kind: str, history: Table) -> DataFrame:
    """:func:`advance` from the last mark of ``history``, a table that takes the row and when it was made; returns the row."""
    last = history.read().orderBy(F.desc("at")).first() if history.exists() else None
    row = advance(source, column, last["new_value"] if last else None, kind).withColumn("at", F.current_timestamp())
    # A run without values keeps the old mark.
    append(history, row.withColumn("new_value", F.coalesce("new_value", "old_value")))
    return history.read().orderBy(F.desc("at")).limit(1)


def key_candidates(df: DataFrame) -> DataFrame:
    """Columns that may serve as high-water marks, with a score, their range, distinct and null counts: one aggregate."""
    found = []
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        temporal, whole = t in ("timestamp", "timestamp_ntz", "date"), t in ("int", "bigint", "smallint")
        named = bool(re.search(r"updated|modified|created|date|time|_at$|(^|_)ts$", f.name, re.I))
        keyed = bool(re.search(r"(^|_)id$|key$|seq|number$", f.name, re.I))
        if temporal or whole:
            found.append((f.name, "timestamp" if temporal else "sequence", 0.5 + 0.4 * (named if temporal else keyed)))
    one: list[Column] = [F.count(F.lit(1)).alias("_rows")]
    for name, *_ in found:
        one += [F.min(name).cast("string").alias(f"{name}_min"), F.max(name).cast("string").alias(f"{name}_max"), F.approx_count_distinct(name).alias(f"{name}_n"), F.count(name).alias(f"{name}_c")]
    row = df.agg(*one).first()
    rows = [(n, k, s, row[f"{n}_min"], row[f"{n}_max"], row[f"{n}_n"], row["_rows"] - row[f"{n}_c"], row["_rows"]) for n, k, s in found]
    return df.sparkSession.createDataFrame(rows, "column string, kind string, score double, least string, greatest string, distinct_about long, nulls long, rows long")
