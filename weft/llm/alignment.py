"""Alignment of two tokenizers' encodings of the same texts, and how often each pair of ids ends together in a corpus.

The ids of both encodings have ends in the bytes of the text. Two dictionaries take each encoding's ends to the places of
its ids; the ends that both hash sets have, sorted, slice both id lists into groups, and each slice gives its links: the
ids that end where the slice ends (ids have at least one byte, so that is one of either side).

Both tokenizers begin anew at a space between two visible characters: no id of theirs goes over it, whatever stands
around. Texts are cut there into words, a Python worker encodes and aligns the words that it has not met yet one after
another as one text, and a document is the sequence of its words' groups. ``Aligner`` checks what this rests on.

Corpus counts are one aggregate over (pair, times) rows, a row for each distinct pair of a document, combined before they
are shuffled. The table of counts is joined back by broadcast where it has at most ``BROADCAST`` rows (some 50 MB), and
else by a shuffle whose skewed keys adaptive execution splits.

Odd rows: texts that are null, empty, or that an encoding does not give back byte for byte have no tokens; repeated ids
and rows are rows of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, written

MARK = "▁"
#: Places where both tokenizers begin anew.
CUTS = re.compile(r"(?<=\S) (?=\S)")
#: Texts of these characters are of the same classes for every version of Unicode.
PLAIN = re.compile("[\\t\\n\\r -~¡-ɏ‐-‧€]*")
#: Fixed value: the pattern by which byte-level vocabularies of this kind part texts.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words that are encoded in one text.
TOGETHER = 64
#: Words that a Python worker keeps, and the longest one it keeps.
KEPT_WORDS, KEPT_CHARS = 300_000, 64
#: Rows of the table of counts up to which it is broadcast.
BROADCAST = 1_000_000
ALIGNED = "n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>"
NAMES = [c.split()[0] for c in ALIGNED.split(", ")]


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 characters for themselves, the
    other bytes, in order, for the characters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def common_ends(a_ends: list[int], b_ends: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The ends that both encodings have, in order, and how many ids of each stand before them."""
    a_at, b_at = dict(zip(a_ends, range(1, len(a_ends) + 1), strict=True)), dict(zip(b_ends, range(1, len(b_ends) + 1), strict=True))
    ends = sorted(a_at.keys() & b_at.keys())
    return ends, list(map(a_at.__getitem__, ends)), list(map(b_at.__getitem__, ends))


def edged(word: str) -> bool:
    """Whether a space beside the word would not be a place where both tokenizers begin anew."""
    return not word or word[0].isspace() or word[-1].isspace()


class Aligner:
    """Groups and links of words by two tokenizers; a worker keeps those of words it has met."""

    def __init__(self, byte_level: str, pieces: bytes) -> None:
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        of, vocabulary = byte_of_char(), self.a.get_vocab()
        self.a_bytes = [b"?"] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(MARK, " ").encode())
        if any(MARK in self.b.id_to_piece(i).lstrip(MARK) for i in range(self.b.get_piece_size())) or not all(self.a_bytes + self.b_bytes):
            raise ValueError("a piece goes beyond a word or has no bytes")
        self.a_len, self.b_len = (np.array(list(map(len, x))) for x in (self.a_bytes, self.b_bytes))
        # Where ids follow the order of the merges, the same vocabulary as ranks gives the same ids, faster.
        definition = json.loads(byte_level)
        merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in definition["model"]["merges"]]
        special = {t["id"] for t in definition["added_tokens"]}
        ranks = {x: i for i, x in enumerate(self.a_bytes) if i not in special}
        self.ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if merged == sorted(merged) and len(ranks) + len(special) == len(self.a_bytes) else None
        self.said = [f"{i}{end}" for i in range(max(len(self.a_bytes), len(self.b_bytes))) for end in ",|;\n"]
        self.known: dict[str, tuple[int, int, int, str, bytes] | None] = {}

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, each with a space before, one after another. Words with white space at an end, which are a
        text of their own, come last."""
        n = next((i for i, w in enumerate(words) if edged(w)), len(words))
        texts = [" ".join(words[i : min(n, i + TOGETHER)]) for i in range(0, n, TOGETHER)] + words[n:]
        a: list[int] = []
        for t in texts:
            a += self.ranks.encode_ordinary(f" {t}") if self.ranks is not None and PLAIN.fullmatch(t) else self.a.encode(f" {t}", add_special_tokens=False).ids
        return np.array(a, np.int64), np.array(list(chain.from_iterable(self.b.encode(texts, num_threads=1))), np.int64)

    def aligned(self, words: list[str]) -> list[tuple[int, int, int, str, bytes] | None]:
        """(a ids, b ids, groups, groups as text, links as numbers) of each word with a space before; None where an
        encoding does not give the word's bytes."""
        if not words:
            return []
        a, b = self.encoded(words)
        parts = [f" {w}".encode() for w in words]
        want, stops = b"".join(parts), np.cumsum(list(map(len, parts)))
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != want or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != want:
            half = len(words) // 2
            return [*self.aligned(words[:half]), *self.aligned(words[half:])] if half else [None]
        ends, a_at, b_at = (np.array(x) for x in common_ends(np.cumsum(self.a_len[a]).tolist(), np.cumsum(self.b_len[b]).tolist()))
        groups = np.searchsorted(ends, stops) + 1
        if not np.array_equal(ends[groups - 1], stops):
            raise ValueError("an id goes beyond a word")
        # Each slice is said as its a ids, then its b ids, so an id of one side comes after all ids of the other side in
        # earlier slices, and a b id after the a ids of its own slice too.
        a_n, b_n = np.diff(a_at, prepend=0), np.diff(b_at, prepend=0)
        codes = np.empty(len(a) + len(b), np.int64)
        a_to, b_to = np.arange(len(a)) + np.repeat(b_at - b_n, a_n), np.arange(len(b)) + np.repeat(a_at, b_n)
        codes[a_to], codes[b_to] = a * 4, b * 4
        codes[a_to[a_at - 1]] += 1
        codes[b_to[b_at - 1]] += 2
        codes[b_to[b_at[groups - 1] - 1]] += 1
        said = "".join(map(self.said.__getitem__, codes.tolist())).split("\n")
        pairs = (a[a_at - 1] * len(self.b_bytes) + b[b_at - 1]).astype("<i8").tobytes()
        n_a, n_b, n = (np.diff(x, prepend=0).tolist() for x in (a_at[groups - 1], b_at[groups - 1], groups))
        at = (groups * 8).tolist()
        return list(zip(n_a, n_b, n, said, map(lambda i, k: pairs[i - 8 * k : i], at, n), strict=False))

    def documents(self, texts: list[str]) -> list[tuple]:
        """The row of each text, as ALIGNED has it."""
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        split = [CUTS.split(t) if t else [] for t in texts]
        new = sorted({w for ws in split for w in ws} - self.known.keys(), key=edged)
        self.known.update(zip(new, self.aligned(new), strict=True))
        rows = []
        for ws in split:
            own = list(map(self.known.__getitem__, ws))
            if not own or None in own:
                rows.append((0, 0, 0, "", [], []))
                continue
            n_a, n_b, n_groups, said, pairs = zip(*own, strict=True)
            pairs, times = np.unique(np.frombuffer(b"".join(pairs), "<i8"), return_counts=True)
            rows.append((sum(n_a), sum(n_b), sum(n_groups), hashlib.sha256(";".join(said).encode()).hexdigest(), pairs, times.astype(np.int32)))
        for w in new:
            if len(w) > KEPT_CHARS:
                del self.known[w]
        return rows


def with_alignment(docs: DataFrame, byte_level_file: str, pieces_file: str) -> DataFrame:
    """``docs`` with the struct ``_aligned``: numbers of ids and groups, the groups' hash, and the distinct links of the
    text, each as a id x (number of b ids) + b id, with how often it comes."""
    spark = docs.sparkSession
    with open(byte_level_file, encoding="utf-8") as f, open(pieces_file, "rb") as g:
        files = spark.sparkContext.broadcast((f.read(), g.read()))

    @F.pandas_udf(ALIGNED)
    def align(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        aligner = Aligner(*files.value)
        for texts in parts:
            texts = texts.fillna("").tolist()
            yield pd.DataFrame([r for i, j in text_slices(texts) for r in aligner.documents(texts[i:j])], columns=NAMES)

    return docs.withColumn("_aligned", align("text"))


def vocabulary_size(pieces_file: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces_file).get_piece_size()


def link_counts(aligned: DataFrame, size: int) -> DataFrame:
    """(pair, n, best): how often each pair is linked, and whether no pair of the same b id comes more often."""
    pairs = aligned.select(F.explode(F.arrays_zip("_aligned.pairs", "_aligned.times")).alias("p"))
    counts = written(pairs.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n")), "link-counts")
    most = counts.groupBy((F.col("pair") % size).alias("b")).agg(F.max("n").alias("most"))
    return counts.join(most, F.col("pair") % size == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment_of_documents(docs: DataFrame, byte_level_file: str, pieces_file: str, broadcast: int = BROADCAST) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    rows = docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id())
    aligned = written(with_alignment(rows, byte_level_file, pieces_file).select("_row", "doc_id", "_aligned"), "aligned")
    counts = written(link_counts(aligned, vocabulary_size(pieces_file)), "links")
    own = aligned.select("_row", F.explode(F.arrays_zip("_aligned.pairs", "_aligned.times")).alias("p")).select("_row", F.col("p.pairs").alias("pair"), F.col("p.times").cast("long").alias("k"))
    met = own.join(F.broadcast(counts) if counts.count() <= broadcast else counts, "pair")
    sums = met.groupBy("_row").agg(F.sum("k").alias("n_links"), F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("n_best"), F.sum(F.col("k") * F.col("n")).alias("count_sum"))
    known = aligned.select("_row", "doc_id", *(F.col(f"_aligned.{c}").alias(c) for c in ("n_a", "n_b", "n_groups", "groups_sha256"))).join(sums, "_row", "left")
    return known.select("doc_id", "n_a", "n_b", "n_groups", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum")), "groups_sha256")
