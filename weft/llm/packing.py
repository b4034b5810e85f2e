"""Best-fit packing of documents into sequences of a fixed number of tokens.

Tokens: a document's ids and one separator; documents longer than a sequence are cut. Packing looks at lengths only, and
lengths are at most the capacity, so the instance that is solved is a histogram of at most ``capacity`` counts whatever
the corpus size. First Martello and Toth's dominance reduction fixes sets that provably belong to some optimal packing
(:func:`reduce_instance`), then the remainder is packed best-fit decreasing (:func:`best_fit`), both on whole counts.
The plan is a short list of runs: "items number a to b of length n go, q to a sequence, to sequences from s on, at offset
o". Each piece finds its place by its number among the pieces of its length, which is known from narrow counts.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_text, text_slices, written

CAPACITY = 4096
SEPARATOR = 1
#: Words whose ids a Python worker keeps.
KEPT_WORDS = 400_000


def _chars(*kinds: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] in kinds)


def _plain_chars() -> str:
    """Characters whose words are split here: white space of ASCII, and visible characters up to U+024F that are in
    composed form and whose lower case is such a character too, of the same kind in every Unicode version."""
    kept = []
    for c in map(chr, [9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x250)]):
        low = c.lower()
        if len(low) == 1 and (ord(low) < 0x250) and unicodedata.normalize("NFC", c) == c and unicodedata.category(c)[0] == unicodedata.category(low)[0]:
            kept.append(c)
    return "".join(map(re.escape, kept))


#: Texts of these characters alone are split here, with the tokenizer's own pattern; others by the tokenizer.
_PLAIN = re.compile(f"[{_plain_chars()}‐-‧€]*")
_L, _N = _chars("L"), _chars("N")
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\\s{_L}{_N}]+")


class WordTokenizer:
    """Ids of texts by a tokenizer whose words are independent of one another; the ids of words are kept.

    ``ids`` gives the same as ``encode(text, add_special_tokens=False)``.
    """

    def __init__(self, definition: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        for piece, i in vocabulary.items():
            self.last[i] = piece.endswith("</w>")

    def encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        """Add the ids of new words; a thousand are encoded together and parted where a word's last piece stands. Where
        that does not part them into as many, each is encoded by itself."""
        for i in range(0, len(words), 1000):
            some = words[i : i + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
            data = ids.tobytes()
            if len(cuts) == len(some):
                self.words.update((w, data[a:b]) for w, a, b in zip(some, [0, *cuts], cuts, strict=False))
            else:
                self.words.update((w, self.encoded(w)) for w in some)

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit numbers.

        No word of the tokenizer's goes over white space, so the ids of what stands between white space are kept; only
        new ones are split into words.
        """
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        plain = [_PLAIN.fullmatch(t) is not None and not any(s in t for s in self.special) for t in texts]
        split = [t.lower().split() if p else [] for t, p in zip(texts, plain, strict=True)]
        new = list(set().union(*split) - self.known.keys())
        parts = [_SPLIT.findall(w) for w in new]
        self.words = {}
        self.learn(list(set().union(*parts)))
        own = self.words.__getitem__
        self.known.update((w, b"".join(map(own, ws))) for w, ws in zip(new, parts, strict=True))
        get = self.known.__getitem__
        return [b"".join(map(get, ws)) if p else self.encoded(t) for t, p, ws in zip(texts, plain, split, strict=True)]


PIECES = "doc_id string, piece int, start long, length long, ids_crc32 long, part int, nth long"


def token_pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents, one row each; null text is empty, so such a document is the separator alone.

    ``part`` and ``nth`` number a piece among those of its length and task; they hold only for this one evaluation, so
    the result must be written before use, see :func:`packed`.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer, part = WordTokenizer(definition.value), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for b in batches:
            keys, texts = b["doc_id"].tolist(), b["text"].fillna("").tolist()
            for i, j in text_slices(texts):
                rows = []
                for key, ids in zip(keys[i:j], tokenizer.ids(texts[i:j]), strict=True):
                    ids += SEPARATOR.to_bytes(4, "little")
                    for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[start : start + 4 * capacity]
                        n = len(own) // 4
                        rows.append((key, k, start // 4, n, zlib.crc32(own), part, seen[n]))
                        seen[n] += 1
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    out = docs.select(as_text("doc_id").alias("doc_id"), "text").mapInPandas(run, PIECES)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


@dataclass
class Plan:
    """Runs (length, first item, items, first sequence, items a sequence, offset) and the number of sequences."""

    capacity: int
    counts: dict[int, int]
    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    fixed: int = 0
    taken: dict[int, int] = field(default_factory=lambda: defaultdict(int))

    def put(self, length: int, items: int, first_sequence: int, each: int, offset: int) -> None:
        self.runs.append((length, self.taken[length], items, first_sequence, each, offset))
        self.taken[length] += items
        self.counts[length] -= items
        if not self.counts[length]:
            del self.counts[length]


def _sum_between(counts: dict[int, int], low: int, high: int) -> bool:
    """Whether some two or more items sum to more than ``low`` and at most ``high``."""
    lengths = sorted(n for n in counts if n < high)
    mask = ((1 << (high + 1)) - 1) ^ ((1 << (low + 1)) - 1)
    all_of, reach, single = (1 << (high + 1)) - 1, 1, 0
    for n in reversed(lengths):
        single |= 1 << n
        left, step = min(counts[n], high // n), 1
        while left:
            k = min(step, left)
            reach |= reach << (n * k) & all_of
            left, step = left - k, step * 2
        # Single items lie at ``low`` or below, so what is in the mask is a sum.
        if reach & mask:
            return True
    return False


def reduce_instance(plan: Plan) -> None:
    """Fix every pair (or single) that dominates all sets with its longer item.

    Let r be what a sequence with item j has left and k the longest item within r. If no two or more items sum to more
    than k and at most r, whatever else shares a sequence with j sums to k at most, and could change places with k: some
    optimal packing has the sequence {j, k}. (An exact fit is the case k = r.) Nothing fits: {j} alone.
    Removing items keeps the condition, so as many pairs are fixed as both counts allow.
    """
    for j in sorted(plan.counts, reverse=True):
        while j in plan.counts:
            r = plan.capacity - j
            own = plan.counts[j]
            k = max((n for n in plan.counts if n <= r and (n != j or own > 1)), default=None)
            if k is None:
                pairs = own
            else:
                if k < r:
                    others = dict(plan.counts)
                    others[j] -= 1
                    if _sum_between({n: c for n, c in others.items() if c}, k, r):
                        break
                pairs = own // 2 if k == j else min(own, plan.counts[k])
            first = plan.sequences
            plan.sequences += pairs
            plan.fixed += pairs
            if k == j:
                plan.put(j, 2 * pairs, first, 2, 0)
            else:
                plan.put(j, pairs, first, 1, 0)
                if k is not None:
                    plan.put(k, pairs, first, 1, j)


def best_fit(plan: Plan) -> None:
    """Best-fit decreasing of what is left: each item goes to the fullest sequence that still takes it.

    Sequences filled alike are kept as ranges, so the work follows the number of lengths, not of items. Sequences fixed
    by the reduction are closed.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for n in sorted(plan.counts, reverse=True):
        for r in sorted(x for x in room if x >= n and room[x]):
            while n in plan.counts and room[r]:
                _fill(plan, room, n, r, *room[r].pop())
            if n not in plan.counts:
                break
        if n in plan.counts:
            each = plan.capacity // n
            new = -(-plan.counts[n] // each)
            first = plan.sequences
            plan.sequences += new
            _fill(plan, room, n, plan.capacity, first, new)


def _fill(plan: Plan, room: dict[int, list[tuple[int, int]]], n: int, r: int, first: int, many: int) -> None:
    """Put items of length n into sequences first .. first + many - 1, which have r tokens left each."""
    each, items = r // n, plan.counts[n]
    full = min(many, items // each)
    if full:
        plan.put(n, full * each, first, each, plan.capacity - r)
        room[r - each * n].append((first, full))
    if full < many:
        rest = items - full * each
        if rest:
            plan.put(n, rest, first + full, rest, plan.capacity - r)
            room[r - rest * n].append((first + full, 1))
            full += 1
        if full < many:
            room[r].append((first + full, many - full))


def planned(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The packing plan of a histogram of lengths (1 .. capacity)."""
    plan = Plan(capacity, {int(n): int(c) for n, c in counts.items() if c})
    reduce_instance(plan)
    best_fit(plan)
    return plan


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (of :func:`token_pieces`) with sequence_id and offset.

    The pieces are written once in the shared folder: their numbers within (part, length) must not change between the
    counts and the placing. To the driver goes one count for each length; the plan that goes back to the tasks has a few
    runs for each length (at most some 100,000 numbers at capacity 4096, whatever the corpus size).
    """
    pieces = written(pieces, "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = planned(histogram, capacity)
    runs: dict[int, list] = defaultdict(list)
    for length, first, _, sequence, each, offset in plan.runs:
        runs[length].append((first, sequence, each, offset))
    table = pieces.sparkSession.sparkContext.broadcast({n: np.array(sorted(x), np.int64).T for n, x in runs.items()})
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sequence, offset = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            length, nth = b["length"].to_numpy(), b["nth"].to_numpy()
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                first, seq, each, off = table.value[int(n)]
                k = np.searchsorted(first, nth[own], side="right") - 1
                within = nth[own] - first[k]
                sequence[own] = seq[k] + within // each[k]
                offset[own] = off[k] + within % each[k] * n
            yield b.drop(columns="nth").assign(sequence_id=sequence, offset=offset)

    numbered = pieces.join(base, ["part", "length"]).select(as_text("doc_id").alias("doc_id"), "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("base")).alias("nth"))
    placed = numbered.mapInPandas(place, "doc_id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumn("doc_id", F.col("doc_id").cast("long"))


def packed_documents(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its place; see :func:`token_pieces` and :func:`packed`.

    A null text is empty, so its document is the separator alone. Null and repeated ids keep their rows, each packed by
    itself; an empty table has no pieces; other columns are not read.
    """
    return packed(token_pieces(docs, tokenizer_file, capacity), capacity)
