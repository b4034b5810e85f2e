"""Benchmark decontamination: windows of benchmark words found in training texts, verified, and taken out.

Words are runs of ASCII letters (lower-cased) and digits and of characters beyond ASCII. A window is ten consecutive words
of a benchmark item; an item of fewer words, but not none, is one window. The distinct windows make a hash set that is
broadcast in blocks of at most ``BLOCK`` (window, item) pairs, so that the size of a broadcast and of what the driver
holds is bounded whatever the benchmark's size: documents meet one block after another, each in one narrow pass without
a shuffle. A pass keeps, for the words of a text, their numbers in the block's vocabulary, rolls a hash over each window
length that the block has, looks the hash up in a bit map, and verifies what is left by the window's words themselves.

Odd rows: a null text has no words, like an empty one. An item of null text has no windows; an item of null id has
windows, but its id is not listed. Repeated items count once; repeated documents are rows of their own. An empty benchmark
hits nothing. Other columns pass through untouched; the result columns replace any of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

WINDOW = 10
#: (window, item) pairs of one broadcast: some 30 MB.
BLOCK = 200_000
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
HITS = "n_words int, starts array<int>, ends array<int>, items array<string>"
NAMES = [c.split()[0] for c in HITS.split(", ")]


def words_of(text: str) -> list[bytes]:
    """The words of a text, in UTF-8."""
    return text.encode().translate(_PLAIN).split()


def windows_of(text: str, length: int = WINDOW) -> list[bytes]:
    """The distinct windows of an item: its words with one space between."""
    words = words_of(text)
    return list({b" ".join(words[i : i + length]) for i in range(max(1, len(words) - length + 1))}) if words else []


class Windows:
    """The hash set of one block: (window, item) pairs, by the number of words."""

    def __init__(self, pairs: list[tuple[str, str | None]]) -> None:
        self.number: dict[bytes, int] = {}
        self.items: list[dict[bytes, list[str]]] = []
        self.lengths: list[int] = []
        by_length: dict[int, dict[bytes, list[str]]] = {}
        for window, item in pairs:
            ids = np.array([self.number.setdefault(w, len(self.number)) for w in window.encode().split(b" ")], np.int32)
            own = by_length.setdefault(len(ids), {}).setdefault(ids.tobytes(), [])
            if item is not None:
                own.append(item)
        self.maps: list[np.ndarray] = []
        for n, found in sorted(by_length.items()):
            self.lengths.append(n)
            self.items.append(found)
            bits = max(16, (16 * len(found)).bit_length())
            seen = np.zeros(1 << bits, bool)
            seen[self._hashed(np.frombuffer(b"".join(found), np.int32).reshape(-1, n).T) >> np.uint64(64 - bits)] = True
            self.maps.append(seen)

    @staticmethod
    def _hashed(columns: np.ndarray | list[np.ndarray]) -> np.ndarray:
        """A hash of each window, from the numbers of its first words, second words and so on."""
        h = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            h = (h + c.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs (first word, end) of the occurrences of windows, and the items whose windows occur."""
        get = self.number.get
        numbers = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
        known = np.concatenate([[0], np.cumsum(numbers < 0)])
        runs, items = [], set()
        for n, seen, found in zip(self.lengths, self.maps, self.items, strict=True):
            if len(words) < n:
                continue
            at = np.flatnonzero(known[n:] == known[:-n])
            if len(at):
                h = self._hashed([numbers[at + k] for k in range(n)])
                at = at[seen[h >> np.uint64(64 - (len(seen).bit_length() - 1))]]
            for i in at.tolist():
                own = found.get(numbers[i : i + n].tobytes())
                if own is not None:
                    runs.append((i, i + n))
                    items.update(own)
        return runs, items


def joined_runs(runs: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the runs after overlapping and touching ones are one."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(runs):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def window_pairs(benchmark: DataFrame, length: int = WINDOW) -> DataFrame:
    """(window, item_id as text), each once."""

    @F.pandas_udf("array<string>")
    def windows(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [w.decode() for w in windows_of(t, length)] if t else [])

    return benchmark.select(F.explode(windows("text")).alias("window"), F.col("item_id").cast("string").alias("item")).distinct()


def _scan(windows: Broadcast) -> Callable[..., Column]:
    """The pass of one block: (text, starts, ends, items of the blocks before) to HITS."""

    @F.pandas_udf(HITS)
    def scanned(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, starts, ends, items in parts:
            rows = []
            for t, a, b, i in zip(texts, starts, ends, items, strict=True):
                words = words_of(t) if t else []
                runs, found = windows.value.hits(words)
                if a is not None:
                    runs += zip(a.tolist(), b.tolist(), strict=True)
                    found.update(i)
                rows.append((len(words), *joined_runs(runs), sorted(found)))
            yield pd.DataFrame(rows, columns=NAMES)

    return scanned


def with_hits(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW, block: int | None = None) -> DataFrame:
    """``docs`` with the struct ``_hits``: the number of words, runs of hit words (first word, end) and the items hit.

    One pass over the texts for each block of windows; between passes the rows are written, as each pass has Python workers.
    """
    spark, block = docs.sparkSession, block or BLOCK
    pairs = written(window_pairs(benchmark, length), "windows")
    blocks = max(1, -(-pairs.count() // block))
    none = F.lit(None)
    known: list[Column] = [none.cast("array<int>"), none.cast("array<int>"), none.cast("array<string>")]
    for k in range(blocks):
        own = pairs.where(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == k)
        docs = docs.withColumn("_hits", _scan(spark.sparkContext.broadcast(Windows([tuple(r) for r in own.collect()])))("text", *known))
        if blocks > 1:
            docs = written(docs, "decontamination")
        known = [F.col("_hits.starts"), F.col("_hits.ends"), F.col("_hits.items")]
    return docs


@cache
def _spanless():  # noqa: ANN202
    @F.pandas_udf("string")
    def cut(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([without_runs(t, a, b) if t else t for t, a, b in zip(texts, starts, ends, strict=True)], dtype=object)

    return cut


def without_runs(text: str, starts: list[int], ends: list[int]) -> str:
    """The text without the runs of words, and what stands between their words; white space left on both sides is cut to
    that of the left side."""
    places = [m.span() for m in _WORD.finditer(text)]
    kept, at = [], 0
    for a, b in zip(starts, ends, strict=True):
        kept.append(text[at : places[a][0]])
        at = places[b - 1][1]
        if not kept[-1] or kept[-1][-1].isspace():
            while at < len(text) and text[at].isspace():
                at += 1
    return "".join([*kept, text[at:]])


def decontaminated(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", length: int = WINDOW) -> DataFrame:
    """``docs`` without what ``benchmark`` has: ``spans`` of hit words leave the texts, or ``documents`` with a hit go."""
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove spans or documents, not {remove}")
    seen = with_hits(docs, benchmark, length)
    if remove == "documents":
        return seen.where(F.size("_hits.starts") == 0).drop("_hits")
    # The clean texts don't go through Python again.
    hit = F.size("_hits.starts") > 0
    cut = _spanless()(F.when(hit, F.col("text")), "_hits.starts", "_hits.ends")
    return seen.withColumn("text", F.when(hit, cut).otherwise(F.col("text"))).drop("_hits")


def hits_of_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256 (of the sorted ids with commas between), contaminated."""
    n_hit = F.aggregate(F.zip_with("_hits.ends", "_hits.starts", lambda b, a: (b - a).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return with_hits(docs.select("doc_id", "text"), benchmark).select(
        "doc_id", F.col("_hits.n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size("_hits.items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "_hits.items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


_WORDS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
HITS_SQL = f"""
WITH b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM (SELECT *, least(len(w), {WINDOW}) AS n FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, coalesce({_WORDS_SQL}, []) AS w FROM documents),
p AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n),
h AS (SELECT doc_id, p.n, i, item_id FROM p JOIN g ON g.n = p.n AND g.g = array_to_string(w[i:i + p.n - 1], ' ')),
t AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(range(n)) AS k FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(t.n_hit, 0) AS n_hit, coalesce(s.n_items, 0) AS n_items,
       sha256(coalesce(s.items, '')) AS items_sha256, coalesce(t.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id
"""
