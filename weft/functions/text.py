"""Text (F4). Positions count characters from 1."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import Value, as_text, col

#: What trimming takes away.
SPACE = " \t\n\r\f\v"

lower, upper, length, reverse, levenshtein, translate = F.lower, F.upper, F.length, F.reverse, F.levenshtein, F.translate
len_ = F.length


def numbervalue(s: Column) -> Column:
    return s.try_cast("double")


def clean(s: Column) -> Column:
    """Only printable ASCII stays."""
    return F.regexp_replace(s, r"[^\x20-\x7E]+", "")


def code(s: Column) -> Column:
    return F.ascii(s)


ascii_ = code


def concatenate(*xs: Value) -> Column:
    """As text; null if any part is."""
    return F.concat(*map(as_text, xs))


concat = concatenate


def exact(a: Value, b: Value) -> Column:
    return col(a).cast("string") == col(b).cast("string")


def find(needle: Value, s: Column, start: Value = 1) -> Column:
    """Place of the first match from ``start`` on, 0 if absent; case counts. Any argument may be an expression."""
    return F.call_function("locate", col(needle), s, col(start).cast("int"))


def search(needle: Value, s: Column) -> Column:
    return find(needle, s)


def fixed(x: Column, n: int | None = None) -> Column:
    """Rounded, as text without exponent; without n a whole number. Without n, a number of 1e38 or more gives null."""
    return F.round(x).try_cast("decimal(38,0)").cast("string") if n is None else as_text(F.round(x, n))


def left(s: Column, n: int = 1) -> Column:
    return F.left(s, F.lit(n))


def right(s: Column, n: int = 1) -> Column:
    return F.right(s, F.lit(n))


def mid(s: Column, start: int, n: int) -> Column:
    return F.substring(s, start, n)


def proper(s: Column) -> Column:
    """The first letter of the whole text in upper case, the rest in lower case."""
    return F.concat(F.upper(F.left(s, F.lit(1))), F.lower(F.substring(s, F.lit(2), F.length(s))))


capitalize = initcap = proper


def rept(s: Column, n: int) -> Column:
    return F.repeat(s, F.lit(n))


def substitute(s: Column, old: str, new: str) -> Column:
    return F.replace(s, F.lit(old), F.lit(new))


def trim(s: Column) -> Column:
    return F.trim(s, F.lit(SPACE))


def ltrim(s: Column) -> Column:
    return F.ltrim(s, F.lit(SPACE))


def rtrim(s: Column) -> Column:
    return F.rtrim(s, F.lit(SPACE))


def contains(s: Column, x: Value) -> Column:
    return F.contains(s, col(x))


def startswith(s: Column, x: Value) -> Column:
    return F.startswith(s, col(x))


def endswith(s: Column, x: Value) -> Column:
    return F.endswith(s, col(x))


def hash_(*xs: Value) -> Column:
    """A 64-bit hash of the joined texts; equal inputs, equal values."""
    return F.xxhash64(concatenate(*xs))


def like(s: Column, pattern: str) -> Column:
    return s.like(pattern)


def ilike(s: Column, pattern: str) -> Column:
    return s.ilike(pattern)


def join(separator: str, *xs: Value) -> Column:
    """Nulls are left out."""
    return F.concat_ws(separator, *(col(x).cast("string") for x in xs))


def lpad(s: Column, n: int, pad: str = " ") -> Column:
    return F.lpad(s, n, pad)


def rpad(s: Column, n: int, pad: str = " ") -> Column:
    return F.rpad(s, n, pad)


def regex_extract(s: Column, pattern: str, group: int = 0) -> Column:
    """Null without a match; a pattern without groups gives the whole match."""
    return F.when(s.rlike(pattern), F.regexp_extract(s, pattern, group if re.compile(pattern).groups else 0))


def regex_replace(s: Column, pattern: str, new: str) -> Column:
    """All matches; groups in ``new`` are written \\1."""
    return F.regexp_replace(s, pattern, re.sub(r"\\(\d)", r"$\1", new))


def regex_search(s: Column, pattern: str) -> Column:
    return s.rlike(pattern)


# Strftime codes and the letters of Spark's patterns.
CODES = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%j": "DDD", "%b": "MMM", "%B": "MMMM", "%a": "E", "%A": "EEEE", "%p": "a", "%%": "%"}


def java_pattern(strftime: str) -> str:
    """Spark's date pattern for a strftime pattern; other letters are quoted."""
    out = []
    for part in re.findall(r"%.|[^%]+", strftime):
        if part.startswith("%"):
            if part not in CODES:
                raise ValueError(f"no pattern for {part}")
            out.append(CODES[part])
        else:
            out.append(re.sub(r"[A-Za-z]+", lambda m: f"'{m[0]}'", part))
    return "".join(out)


def timestamp(s: Column, strftime: str) -> Column:
    return F.to_timestamp(s, java_pattern(strftime))


def split(s: Column, delimiter: str) -> Column:
    return F.split(s, re.escape(delimiter))


def split_part(s: Column, delimiter: str, n: int) -> Column:
    """Part n from 1; null out of range."""
    return F.get(F.split(s, re.escape(delimiter)), F.lit(n - 1))
