"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.shared import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: lineage ends here and its size is known."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weft-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucket_of_id(column: Column | str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``; the folds of the classifiers use it."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(c.cast("string").cast("binary")) % F.lit(modulus)


#: Classes that a sample has at most.
CLASSES = 200


def bounded_sample(df: DataFrame, key: str, by: str, per_class: int) -> DataFrame:
    """``per_class`` keys of each value of ``by`` (all keys of a smaller class), chosen by a hash of ``key``: one row each.

    Rows that share key and class are one (the least of them by the other columns), so the bound holds however often a key
    is repeated. The class counts cover all rows; of more than CLASSES values of ``by`` the most frequent ones count.
    """
    keyed = df.where(F.col(key).isNotNull())
    counts = {r[by]: r["n"] for r in keyed.groupBy(by).agg(F.approx_count_distinct(key, 0.02).alias("n")).orderBy(F.desc("n"), by).limit(CLASSES).collect()}
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(by).eqNullSafe(F.lit(value)), F.lit(min(1.0, 1.2 * per_class / n))).otherwise(share)
    u = F.pmod(F.xxhash64(F.col(key), F.lit(7919)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rest = [c for c in df.columns if c not in (key, by)]
    some = keyed.where(u < share).groupBy(by, key).agg(F.min(F.struct(*rest)).alias("_r")) if rest else keyed.where(u < share).select(by, key).distinct()
    nth = F.row_number().over(Window.partitionBy(by).orderBy(F.xxhash64(F.col(key), F.lit(7919)), key))
    chosen = some.withColumn("_nth", nth).where(F.col("_nth") <= per_class)
    return chosen.select(key, by, *([F.col(f"_r.{c}").alias(c) for c in rest] if rest else []))


def as_text(column: str) -> Column:
    """An id as text. Python workers take a null beside whole numbers as floating point, which loses digits of large ids;
    ids go in as text and come back by :func:`from_text`."""
    return F.col(column).cast("string")


def from_text(column: str, kind: str, name: str) -> Column:
    """The id of type ``kind`` that :func:`as_text` wrote."""
    return F.col(column).cast(kind).alias(name)


def text_slices(texts: list[str], most_chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together hold about ``most_chars`` characters; a longer text is a range of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most_chars:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


_LETTERS, _WORD = re.compile(r"[A-Za-z]+"), re.compile(r"[^\W\d_]+")


def letter_spans(text: str) -> Iterator[tuple[int, int]]:
    """Places of the runs of letters (``str.isalpha``) of a text."""
    for m in _WORD.finditer(text):
        said, start = m.group(), m.start()
        if said.isalpha():
            yield m.span()
            continue
        # The pattern takes figures such as a half or a Roman eight for letters.
        at = None
        for i, c in enumerate(said + " "):
            if c.isalpha():
                at = i if at is None else at
            elif at is not None:
                yield start + at, start + i
                at = None


def letter_words(text: str) -> list[str]:
    """The runs of letters of a text."""
    if text.isascii():
        return _LETTERS.findall(text)
    found = _WORD.findall(text)
    return found if all(map(str.isalpha, found)) else [text[i:j] for i, j in letter_spans(text)]
