"""Similarity join of documents on word shingles by chosen paths.

Sets of five-word shingles are sketched by min-wise values: each is a token that the set's hash order samples, and the
sketches' agreeing places are as the Jaccard similarity. From a root, a set goes down to a child for each sampled token
that a hash of (node, place, value) chooses, ``BRANCH`` tokens on average. Similar sets share tokens and so children often,
unlike sets rarely. A node with few sets is compared by brute force, a larger one is split further, and runs from other
roots repeat this until the target recall: :func:`runs_for` gives their number.

With 128 places and similarity 0.8, sets meet at a child with probability 1 - exp(-1.28) = 0.72, and 0.60 and 0.54 one
and two levels further down; ten runs miss 3e-6, 1e-4 and 5e-4 of such pairs. Of the pairs that meet, the comparison takes
those whose sketches agree at ``FIRST_AGREE`` of the first places and at ``AGREE`` of all (a pair at the threshold fails
that with probability 2e-7), and compares their whole shingle sets, so links that are found are exact.

Copies (equal sets) are one set for all of this. A pair that meets at several nodes is handled at the least of them. The
whole sets of a node travel in bundles, so a set is a row once for each of its nodes; the rows of the comparison are pairs of
bundles. Its pairs within one group of n near copies stay n²/2, as their links are counted one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, written
from .components import components
from .shingles import SKETCH, Shingler, digest, jaccard_counts, mix, sketch

SIMILARITY = 0.8
#: Share of the pairs at the threshold that some run must bring together, even at the deepest level.
TARGET = 0.9995
BRANCH, DEPTH = 1.6, 3
#: Sets of a node that is compared at once; a larger node is split, and at the last level compared block by block.
BLOCK = 1024
#: Equal places that a pair's sketches need: 0.8 of 128, less 5.4 standard deviations; of the first places, less 6.
AGREE, FIRST, FIRST_AGREE = 78, 32, 12
#: Sets of a bundle, and shingles unless it is one set; a unit compares the whole shingle sets of two bundles.
CHUNK, HELD = 512, 1 << 17


def runs_for(target: float = TARGET, similarity: float = SIMILARITY, depth: int = DEPTH) -> int:
    """Runs that bring together at least ``target`` of the pairs of this similarity that must go down ``depth`` levels.

    Sets that share a node share a child with probability 1 - exp(-BRANCH * similarity); further down a pair meets if one of
    its shared children leads on (a branching process).
    """
    meet = 1.0
    for _ in range(depth):
        meet = 1 - math.exp(-BRANCH * similarity * meet)
    return max(1, math.ceil(math.log(1 - target) / math.log(1 - meet) - 1e-9))


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    shingler = Shingler()
    for b in batches:
        keys, texts = b["key"].tolist(), b["text"].fillna("").tolist()
        for i, j in text_slices(texts):
            rows = []
            for key, t in zip(keys[i:j], texts[i:j], strict=True):
                s = shingler.shingles(t)
                rows.append((key, digest(s), len(s), sketch(s).tobytes()) if len(s) else (key, None, 0, None))
            yield pd.DataFrame(rows, columns=["doc_id", "digest", "n", "mins"])


def _children(parents: np.ndarray, mins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child node) for the places that each row's node chooses."""
    places = np.arange(1, SKETCH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        h = mix(mix((mins.astype(np.uint64) + places) ^ parents[:, None].astype(np.uint64)) + np.uint64(0x632BE59BD9B4E019))
    row, place = np.nonzero(h < np.uint64(int(BRANCH / SKETCH * 2**64)))
    return row, mix(h[row, place] ^ np.uint64(0x51ED270B)).view(np.int64)


def _matrix(column: pd.Series, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def _roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    roots = mix(np.arange(1, runs_for() + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    for b in batches:
        for i in range(0, len(b), 2048):
            some = b.iloc[i : i + 2048]
            mins, reps = _matrix(some["mins"], np.uint32), some["rep"].to_numpy()
            found = [_children(np.full(len(some), r), mins) for r in roots]
            yield pd.DataFrame({"node": np.concatenate([n for _, n in found]), "rep": np.concatenate([reps[r] for r, _ in found])})


def _deeper(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        if len(b):
            row, node = _children(b["node"].to_numpy().view(np.uint64), _matrix(b["mins"], np.uint32))
            yield pd.DataFrame({"node": node, "rep": b["rep"].to_numpy()[row]})


def _grouped(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of rows from batches sorted by ``keys``."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        k = b[keys].to_numpy()
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(b)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            part = b.iloc[i:j]
            if held and (held[-1][keys].iloc[-1].to_numpy() != k[i]).any():
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of one node (or of two of its blocks) whose sketches and sizes allow the similarity, as packed ids."""
    out: list[tuple] = []
    for g in _grouped(batches, ["node", "low", "high"]):
        # The bundles of a block are cut alike in each of its units.
        g = g.sort_values(["block", "rep"], ignore_index=True)
        node, low, high = (int(g[c].iloc[0]) for c in ("node", "low", "high"))
        block = g["block"].to_numpy()
        left = np.flatnonzero(block == low)
        right = left if low == high else np.flatnonzero(block == high)
        if not len(left) or not len(right) or (low == high and len(left) < 2):
            continue
        marks, n, reps = _matrix(g["marks"], np.uint8), g["n"].to_numpy(), g["rep"].to_numpy()
        xs, ys = [], []
        for i in range(0, len(left), 64):
            rows, others = left[i : i + 64], right[i:] if low == high else right
            sizes = np.minimum(n[rows][:, None], n[others][None, :]) >= SIMILARITY * np.maximum(n[rows][:, None], n[others][None, :]) - 1e-9
            x, y = np.nonzero(sizes & ((marks[rows, :FIRST][:, None, :] == marks[others, :FIRST][None, :, :]).sum(axis=2, dtype=np.uint8) >= FIRST_AGREE))
            x, y = rows[x], others[y]
            for j in range(0, len(x), 65_536):
                agree = (marks[x[j : j + 65_536]] == marks[y[j : j + 65_536]]).sum(axis=1, dtype=np.uint8) >= AGREE
                xs.append(x[j : j + 65_536][agree])
                ys.append(y[j : j + 65_536][agree])
        x, y = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (xs, ys))
        if low == high:
            x, y = x[x < y], y[x < y]
        if not len(x):
            continue
        # Pairs that meet at a lesser node belong there.
        nodes = g["nodes"].to_list()
        lesser: dict[int, list[int]] = {}
        for i in np.unique(np.concatenate([x, y])).tolist():
            for k in nodes[i]:
                if k < node:
                    lesser.setdefault(int(k), []).append(i)
        free = np.ones(len(x), bool)
        for members in lesser.values():
            if len(members) > 1:
                there = np.zeros(len(g), bool)
                there[members] = True
                free &= ~(there[x] & there[y])
        x, y = x[free], y[free]
        bundle = np.zeros(len(g), np.int64)
        for some in (left, right):
            bundle[some] = _bundles(n[some])
        pair = bundle[x] * len(g) + bundle[y]
        for c in np.unique(pair).tolist():
            own = pair == c
            out.append((f"{node}/{low}/{c // len(g)}", f"{node}/{high}/{c % len(g)}", reps[x[own]].astype(np.int64).tobytes(), reps[y[own]].astype(np.int64).tobytes()))
        if len(out) >= 200:
            yield pd.DataFrame(out, columns=UNITS)
            out = []
    if out:
        yield pd.DataFrame(out, columns=UNITS)


UNITS, BUNDLE = ["left", "right", "a", "b"], ["rep", "copies", "members"]


def _bundles(n: np.ndarray) -> np.ndarray:
    """The numbers of the bundles that sets of these sizes go to, in their order."""
    out, number, sets, held = np.zeros(len(n), np.int64), 0, 0, 0
    for i, size in enumerate(n.tolist()):
        if sets and (sets == CHUNK or held + size > HELD):
            number, sets, held = number + 1, 0, 0
        out[i], sets, held = number, sets + 1, held + size
    return out


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        held: dict[str, list[np.ndarray]] = {}
        for left, right, x, y in zip(b["left"], b["right"], b["a"], b["b"], strict=True):
            for bundle, own in ((left, x), (right, y)):
                held.setdefault(bundle, []).append(np.unique(np.frombuffer(own, np.int64)))
        reps = {k: np.unique(np.concatenate(v)) for k, v in held.items()}
        yield pd.DataFrame({"bundle": np.repeat(list(reps), [len(v) for v in reps.values()]), "rep": np.concatenate([*reps.values(), np.zeros(0, np.int64)])})


def _whole_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    shingler = Shingler()
    for b in batches:
        yield pd.DataFrame({"rep": b["rep"], "members": [shingler.shingles(t).tobytes() for t in b["text"].fillna("")]})


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each unit: links of each set (weighted by the other's copies) and edges that connect what is linked."""
    for u in (row for b in batches for row in b.itertuples()):
        reps, first = np.unique(np.concatenate([u.l_rep, u.r_rep]).astype(np.int64), return_index=True)
        copies = np.concatenate([u.l_copies, u.r_copies]).astype(np.int64)[first]
        sets = [*u.l_members, *u.r_members]
        members = [np.frombuffer(sets[i], np.uint64) for i in first]
        n = np.array([len(m) for m in members])
        x = np.searchsorted(reps, np.frombuffer(u.a, np.int64))
        y = np.searchsorted(reps, np.frombuffer(u.b, np.int64))
        common = np.zeros(len(x), np.int64)
        if len(x) > 4 * len(reps):
            lo, hi = np.minimum(x, y), np.maximum(x, y)
            for i, j, counts in jaccard_counts(members):
                own = np.flatnonzero((lo >= i) & (lo < i + counts.shape[0]) & (hi >= j) & (hi < j + counts.shape[1]))
                common[own] = counts[lo[own] - i, hi[own] - j]
        else:
            for k, (i, j) in enumerate(zip(x, y, strict=True)):
                common[k] = len(np.intersect1d(members[i], members[j], assume_unique=True))
        linked = common >= SIMILARITY * (n[x] + n[y] - common) - 1e-9
        x, y = x[linked], y[linked]
        if not len(x):
            continue
        links = np.bincount(x, copies[y], len(reps)) + np.bincount(y, copies[x], len(reps))
        top = np.arange(len(reps))

        def find(i: int, top: np.ndarray = top) -> int:
            while top[i] != i:
                top[i] = top[top[i]]
                i = top[i]
            return i

        edges = []
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            a, b = find(i), find(j)
            if a != b:
                top[max(a, b)] = min(a, b)
                edges.append((reps[i], reps[j]))
        own = np.flatnonzero(links)
        yield pd.DataFrame({"a": np.concatenate([reps[own], np.array([e[0] for e in edges], np.int64)]), "b": [None] * len(own) + [int(e[1]) for e in edges], "links": [int(v) for v in links[own]] + [None] * len(edges)}).astype({"b": "Int64", "links": "Int64"})


def joined(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links) for documents (doc_id, text), doc_id an integer.

    n_links: how many other documents have a Jaccard similarity of 0.8 or more, copies included. class_id: the least
    doc_id of the documents that chains of links join. A text of one to four words is one shingle; a text without a word
    (null too) has no links and is a class of its own. Rows that share a doc_id count as copies of one another if their
    texts agree. A row without doc_id takes no part: its class_id is null, its n_links 0. Other columns are not used. An
    empty table gives no rows.
    """
    text = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("key"), "text")
    sets = written(text.mapInPandas(_sets, "doc_id long, digest binary, n int, mins binary"), "sets")
    reps = sets.where("n > 0").groupBy("digest").agg(F.min(F.struct("doc_id", "n", "mins")).alias("r"), F.count(F.lit(1)).alias("copies"))
    reps = written(reps.select("digest", F.col("r.doc_id").alias("rep"), F.col("r.n").alias("n"), F.col("r.mins").alias("mins"), "copies"), "reps")

    nodes = reps.select("rep", "mins").mapInPandas(_roots, "node long, rep long")
    leaves = None
    for level in range(1, DEPTH + 1):
        # Nodes of one set are done; the sizes of the others are counted over all rows.
        nodes = written(nodes, "nodes")
        sizes = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        own = written(nodes.withColumn("_k", F.col("node") % 2).join(sizes.withColumn("_k", F.col("node") % 2), ["node", "_k"]).drop("_k"), "node-sets")
        ready = own if level == DEPTH else own.where(F.col("size") <= BLOCK)
        leaves = ready if leaves is None else leaves.unionAll(ready)
        if level < DEPTH:
            large = own.where(F.col("size") > BLOCK)
            if large.isEmpty():
                break
            nodes = large.select("node", "rep").join(reps.select("rep", "mins"), "rep").select("node", "rep", "mins").mapInPandas(_deeper, "node long, rep long")

    at = leaves.groupBy("rep").agg(F.collect_set(F.struct("node", "size")).alias("at"))
    rows = at.join(reps.select("rep", "n", "mins"), "rep")
    # One byte of each min-wise value is enough to compare: unlike values agree by chance once in 256.
    rows = rows.mapInPandas(_marks, "rep long, n int, marks binary, nodes array<long>, sizes array<long>")
    rows = rows.select("rep", "n", "marks", "nodes", F.explode(F.arrays_zip("nodes", "sizes")).alias("z")).select("rep", "n", "marks", "nodes", F.col("z.nodes").alias("node"), F.ceil(F.col("z.sizes") / BLOCK).cast("int").alias("blocks"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("node", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep", "n", "marks", "nodes")
    units = rows.repartition("node", "low", "high").sortWithinPartitions("node", "low", "high").mapInPandas(_compare, "left string, right string, a binary, b binary")
    units = written(units, "pairs")

    # A set is in one bundle of each of its nodes, however many sets it is compared with there.
    members = written(units.mapInPandas(_members, "bundle string, rep long").distinct(), "members")
    needed = written(members.select("rep").distinct().join(reps.select("rep", "copies"), "rep"), "needed")
    # The first row of a repeated doc_id whose text is the set's; sizes are known here, so few ids are broadcast.
    texts = text.select(F.col("key").alias("rep"), "text").join(needed.select("rep"), "rep")
    whole = texts.mapInPandas(_whole_sets, "rep long, members binary").dropDuplicates(["rep"]).join(needed, "rep")
    sets_of = F.sort_array(F.collect_list(F.struct("rep", "copies", "members"))).alias("s")
    bundles = written(members.join(whole, "rep").groupBy("bundle").agg(sets_of).select("bundle", *(F.col(f"s.{c}").alias(c) for c in BUNDLE)), "bundles")
    for side in ("left", "right"):
        units = units.join(bundles.select(F.col("bundle").alias(side), *(F.col(c).alias(f"{side[0]}_{c}") for c in BUNDLE)), side)
    found = written(units.mapInPandas(_verify, "a long, b long, links long"), "found")

    classes = components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("rep"), "component")
    links = found.where("links is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    named = reps.select("digest", "rep", "copies").join(classes, "rep", "left").join(links, "rep", "left")
    lead = F.substring("digest", 1, 1)
    named = named.select("digest", lead.alias("_k"), F.coalesce("component", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = sets.select("doc_id", "digest", lead.alias("_k")).join(named, ["digest", "_k"], "left")
    out = out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    none = F.lit(None).cast("long")
    return out.unionAll(docs.where("doc_id is null").select(none, none, F.lit(0).cast("long")))


def _marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        marks = _matrix(b["mins"], np.uint32).astype(np.uint8) if len(b) else []
        nodes = [sorted((int(z["node"]), int(z["size"])) for z in at) for at in b["at"]]
        yield pd.DataFrame({"rep": b["rep"], "n": b["n"], "marks": [m.tobytes() for m in marks], "nodes": [[k for k, _ in z] for z in nodes], "sizes": [[s for _, s in z] for z in nodes]})


def kept(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their class: those whose doc_id is the class_id, so one of each group stays.
    Rows without doc_id stay."""
    goes = classes.where(F.col("doc_id") != F.col("class_id")).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(goes, docs["doc_id"].cast("long") == goes["_id"], "left_anti")
