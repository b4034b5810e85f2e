"""The trie of conversation prefixes: how many conversations share each prefix, and what sharing saves.

Every conversation is first rebuilt on the head of another one (:func:`rebuilt`). A node is a distinct sequence of turns;
it is named by its depth and two 64-bit sums (exclusive or) of hashes of its turns and their places.

Equal conversations are one sequence with a count, so a group of copies is one path. Along a sequence, nodes with the same
members form a chain, which one entry of the tree stands for: the chain's last node. A sequence has few entries, as each
needs another sequence that leaves or ends there (a corpus of N turns has at most about the square root of 2 N on any path,
whatever the length of a conversation). Sequences are sorted by their entries, which lays the tree out depth-first, and
range-partitioned. Each shard of at most ``SHARD`` entries is a :class:`Parentheses` sequence: its range min-max blocks find
where a subtree closes, ranks count leaf pairs, and cumulative sums give the savings between both ends. A node that lies
over the border of shards (the spine) has a row from each; these are added up.

Long conversations are never one task's: places of turns and sums along a conversation are distributed scans
(:mod:`weft.operators.scans`). Only the hash of the ids that end at one node is made in one task, as its definition is
sequential; it reads joined text of up to 4,096 ids a row as a stream.

Odd rows: a null conv_id is no conversation; null roles and texts are empty; turns of equal number are ordered by role and
text, repeated rows are turns of their own; an empty table has no nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators.windowing import WindowColumn, with_windows

from .common import written

#: Conversations whose heads are shared, and how many turns of the head at most.
GROUP, HEAD = 20, 4
#: Entries of a shard.
SHARD = 1 << 18
#: Excess values of one min-max block.
BLOCK = 256
KEY = ["h1", "h2", "d"]


def head_length(c: Column) -> Column:
    return (F.crc32(c.cast("string").cast("binary")) % HEAD).cast("int")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(c, d, t1, t2, w): the turns of every rebuilt conversation, numbered from 1; two hashes of role and text, and the
    words of the text. Also a row of d = 0 for each conversation.

    Conversation c has the first h turns of conversation c - c % 20 (all if fewer, none if absent), then its own turns after
    its first h, h being the CRC-32 of c as text, modulo 4.
    """
    given = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("c"), F.col("turn").isNotNull().alias("has"), "turn", *(F.coalesce(x, F.lit("")).alias(x) for x in ("role", "text")))
    order = tuple((x, "asc") for x in ("has", "turn", "role", "text"))
    placed = with_windows(given, [WindowColumn("pos", "ROW_NUMBER", ("c",), order, split=True)])
    own = written(placed.select("c", F.col("pos").cast("long").alias("pos"), F.xxhash64("role", "text").alias("t1"), F.xxhash64("text", F.lit(1), "role").alias("t2"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("w")), "turns")
    turn = F.struct("pos", "t1", "t2", "w")
    heads = own.where(F.col("pos") < HEAD).groupBy(F.col("c").alias("base")).agg(F.sort_array(F.collect_list(turn)).alias("head"))
    ids = own.where("pos = 1").select("c", head_length(F.col("c")).alias("h"), (F.col("c") - F.col("c") % GROUP).alias("base"))
    begun = written(ids.join(heads, "base", "left").select("c", "h", F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast("array<struct<pos:bigint,t1:bigint,t2:bigint,w:bigint>>")).alias("head")), "heads")
    first = begun.select("c", F.explode("head").alias("t")).select("c", F.col("t.pos").alias("d"), "t.t1", "t.t2", "t.w")
    then = own.join(begun.select("c", "h", F.size("head").alias("n")), "c").where(F.col("pos") > F.col("h")).select("c", (F.col("pos") - F.col("h") + F.col("n")).alias("d"), "t1", "t2", "w")
    zero = F.lit(0).cast("long")
    return first.unionByName(then).unionByName(begun.select("c", zero.alias("d"), zero.alias("t1"), zero.alias("t2"), zero.alias("w")))


def prefixes(turns: DataFrame) -> DataFrame:
    """(c, d, h1, h2, p1, p2, w, cw): each turn with the name of the prefix that it ends and of the one before, its words
    and the words so far. The root is 0, 0."""
    mixed = turns.select("c", "d", "w", *(F.when(F.col("d") > 0, m).otherwise(F.lit(0)).alias(n) for n, m in (("m1", F.xxhash64("d", "t1", "t2")), ("m2", F.xxhash64("t2", "t1", F.lit(2), "d")))))
    order = (("d", "asc"),)
    run = lambda name, f, c: WindowColumn(name, f, ("c",), order, c, preceding="unbounded", following=0, split=True)
    path = with_windows(mixed, [run("h1", "BIT_XOR", "m1"), run("h2", "BIT_XOR", "m2"), run("cw", "SUM", "w")])
    return written(path.select("c", "d", "h1", "h2", F.col("h1").bitwiseXOR(F.col("m1")).alias("p1"), F.col("h2").bitwiseXOR(F.col("m2")).alias("p2"), "w", "cw"), "prefixes")


class Parentheses:
    """A balanced-parentheses sequence (True opens) with a range-minimum tree over blocks of its excess."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits
        self.excess = np.cumsum(np.where(bits, 1, -1))
        n = -(-len(bits) // BLOCK)
        self.size = 1 << max(0, (n - 1).bit_length())
        tree = np.full(2 * self.size, np.iinfo(np.int64).max)
        tree[self.size : self.size + n] = np.minimum.reduceat(self.excess, np.arange(0, len(bits), BLOCK)) if n else []
        for i in range(self.size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        self.low = tree

    def findclose(self, i: int) -> int:
        """Where the parenthesis that opens at ``i`` is closed: the first place after it with an excess below its own."""
        below, block = self.excess[i] - 1, i // BLOCK
        part = self.excess[i + 1 : (block + 1) * BLOCK] <= below
        if part.any():
            return i + 1 + int(part.argmax())
        # The next block whose least excess is that low: up from this block, then down to the left.
        x = self.size + block
        while x & 1 or self.low[x + 1] > below:
            x >>= 1
        x += 1
        while x < self.size:
            x *= 2
            x += int(self.low[x] > below)
        start = (x - self.size) * BLOCK
        return start + int((self.excess[start : start + BLOCK] <= below).argmax())


class Shard:
    """Entries of consecutive sequences, in depth-first order, as parentheses with weights."""

    def __init__(self) -> None:
        self.bits: list[bool] = []
        self.names: list[tuple[int, int, int]] = []
        self.saved: list[int] = []
        self.leaf: list[bool] = []
        self.open: list[int] = []

    def add(self, path: list[tuple[int, int, int]], own: list[int], leaf: bool) -> None:
        """A sequence's entries from the root on; ``own``: what each entry saves, where this sequence is the one to say so,
        else 0. ``leaf``: nothing goes on from its end."""
        same = 0
        while same < min(len(self.open), len(path)) and self.names[self.open[same]] == path[same]:
            same += 1
        self.bits += [False] * (len(self.open) - same)
        del self.open[same:]
        for name in path[same:]:
            self.open.append(len(self.names))
            self.bits.append(True)
            self.names.append(name)
            self.saved.append(0)
            self.leaf.append(False)
        for at, x in zip(self.open, own, strict=True):
            self.saved[at] += x
        self.leaf[self.open[-1]] |= leaf

    def rows(self) -> pd.DataFrame:
        """Leaves and savings of each entry's subtree, as far as this shard has it."""
        self.bits += [False] * len(self.open)
        self.open = []
        tree = Parentheses(np.array(self.bits, bool))
        opens = np.flatnonzero(tree.bits)
        close = np.array([tree.findclose(i) for i in opens.tolist()])
        # A pair "()" is a leaf unless its children lie in the next shard.
        pair = np.zeros(len(tree.bits) + 1, np.int64)
        pair[opens + 1] = (close == opens + 1) & np.array(self.leaf)
        saved = np.zeros(len(tree.bits) + 1, np.int64)
        saved[opens + 1] = self.saved
        rank, total = np.cumsum(pair), np.cumsum(saved)
        h1, h2, d = zip(*self.names, strict=True)
        return pd.DataFrame({"h1": h1, "h2": h2, "d": d, "n_leaves": rank[close + 1] - rank[opens], "saved": total[close + 1] - total[opens]})


def _sharded(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    shard = Shard()
    for b in batches:
        for h1, h2, d, own, leaf in zip(b["h1"], b["h2"], b["d"], b["own"], b["leaf"], strict=True):
            if len(shard.names) >= size:
                yield shard.rows()
                shard = Shard()
            shard.add(list(zip(h1.tolist(), h2.tolist(), d.tolist(), strict=True)), own.tolist(), leaf)
    if shard.names:
        yield shard.rows()


def subtrees(rows: DataFrame, chains: DataFrame, shard: int = SHARD) -> DataFrame:
    """(h1, h2, d, n_leaves, saved) of each chain's last node: of the chain and all that is below it. A shard is cut after
    ``shard`` entries."""
    ends = chains.select(*KEY, "conv", "own", "leaf")
    entry = F.struct("d", "h1", "h2", F.when(F.col("conv") == F.col("c"), F.col("own")).otherwise(F.lit(0)).alias("own"), "leaf")
    paths = rows.select("c", *KEY).join(ends, KEY).groupBy("c").agg(F.sort_array(F.collect_list(entry)).alias("p"))
    paths = paths.select(*(F.col(f"p.{x}").alias(x) for x in ("h1", "h2", "d", "own")), F.element_at("p.leaf", -1).alias("leaf"), F.arrays_zip("p.h1", "p.h2").alias("by"))
    shards = paths.repartitionByRange("by").sortWithinPartitions("by").drop("by").mapInPandas(lambda batches: _sharded(batches, shard), "h1 long, h2 long, d long, n_leaves long, saved long")
    return shards.groupBy(*KEY).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, digest = None, None
    for b in batches:
        rows = []
        for *own, ids in b[[*KEY, "ids"]].itertuples(index=False, name=None):
            if own == key:
                digest.update(b"," + ids.encode())
                continue
            if key:
                rows.append((*key, digest.hexdigest()))
            key, digest = own, hashlib.sha256(ids.encode())
        yield pd.DataFrame(rows, columns=[*KEY, "ends_sha256"])
    if key:
        yield pd.DataFrame([(*key, digest.hexdigest())], columns=[*KEY, "ends_sha256"])


def hashes_of_ends(ends: DataFrame) -> DataFrame:
    """(h1, h2, d, ends_sha256) from (c, h1, h2, d): the ids that end at a node, ascending."""
    some = ends.groupBy(*KEY, F.shiftright("c", 12).alias("part")).agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list("c")), lambda x: x.cast("string"))).alias("ids"))
    return some.repartition(*KEY).sortWithinPartitions(*KEY, "part").select(*KEY, "ids").mapInPandas(_hashed, "h1 long, h2 long, d long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, shard: int = SHARD) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    path = prefixes(rebuilt(conversations))
    ends = written(path.groupBy("c").agg(F.max_by(F.struct(*KEY), "d").alias("e")).select("c", "e.*"), "ends")
    sequences = ends.groupBy(*KEY).agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("n_ends"))
    rows = written(path.join(sequences.select("c", "n_ends"), "c"), "paths")
    nodes = written(rows.groupBy(*KEY).agg(F.sum("n_ends").alias("n"), F.min("c").alias("conv"), *(F.max(x).alias(x) for x in ("p1", "p2", "w", "cw"))), "nodes")
    # Nodes with the same members have the same least member and number of members, and no others do.
    last = nodes.groupBy("conv", "n").agg(F.max_by(F.struct(*KEY, "cw"), "d").alias("last"), F.min_by(F.struct("p1", "p2", F.col("d").alias("top"), (F.col("cw") - F.col("w")).alias("before")), "d").alias("top"))
    last = last.select("conv", "n", "last.*", "top.*").withColumn("own", (F.col("n") - 1) * (F.col("cw") - F.col("before")))
    chains = written(last.join(sequences.select(*KEY, "n_ends"), KEY, "left").withColumn("leaf", F.col("n").eqNullSafe(F.col("n_ends"))), "chains")
    up = [F.col("p1").alias("h1"), F.col("p2").alias("h2"), (F.col("top") - 1).alias("d")]
    children = chains.where("top > 0").groupBy(*up).agg(F.count(F.lit(1)).alias("n_children"))
    parents = chains.where("top > 0").select(F.col("conv").alias("of"), F.col("n").alias("members"), *up).join(chains.select(*KEY, F.col("conv").alias("parent")), KEY).select("of", "members", "parent")
    known = chains.join(subtrees(rows, chains, shard), KEY).join(children, KEY, "left").join(parents, (F.col("conv") == F.col("of")) & (F.col("n") == F.col("members")), "left")
    known = known.select("conv", "n", F.col("d").alias("last"), "top", "before", "parent", "n_leaves", "saved", "n_children")
    inner = F.col("d") < F.col("last")
    whole = nodes.join(known, ["conv", "n"]).join(hashes_of_ends(ends), KEY, "left")
    return whole.select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("d") > F.col("top"), F.col("conv")).otherwise(F.col("parent")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(inner, F.lit(1)).otherwise(F.coalesce("n_children", F.lit(0))).cast("long").alias("n_children"), "n_leaves", (F.col("saved") - (F.col("n") - 1) * (F.col("cw") - F.col("w") - F.col("before"))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


_CRC_SQL = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(CAST(c AS VARCHAR)) + 1), lambda i: CAST(ord(substr(CAST(c AS VARCHAR), i, 1)) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT) FOR z IN range(8)]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""
TRIE_SQL = rf"""
WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT c, list({{'r': r, 'x': x}} ORDER BY turn NULLS FIRST, r, x) AS turns, CAST({_CRC_SQL} % {HEAD} AS BIGINT) AS h FROM t GROUP BY c),
b AS (SELECT s.c, list_concat(coalesce(o.turns[1:s.h], []), s.turns[s.h + 1:]) AS turns FROM s LEFT JOIN s AS o ON o.c = s.c - s.c % {GROUP}),
p AS (SELECT c, turns, unnest(range(len(turns) + 1)) AS d FROM b),
n AS (SELECT turns[1:d] AS path, d, min(c) AS conv_id, count(*) AS n_convs, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE d = len(turns)) AS ends FROM p GROUP BY ALL),
k AS (SELECT path[1:d - 1] AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * len(regexp_extract_all(n.path[d].x, '[^\x20\x09-\x0D]+')) ELSE 0 END AS own FROM n LEFT JOIN k ON k.path = n.path),
a AS (SELECT path[1:e] AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum(own) AS BIGINT) AS saved_tokens FROM (SELECT *, unnest(range(d + 1)) AS e FROM f) GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, a.n_leaves, a.saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM f JOIN a ON a.path = f.path LEFT JOIN n AS u ON f.d > 0 AND u.path = f.path[1:f.d - 1]
"""
