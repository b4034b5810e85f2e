"""Approximate nearest neighbours with an inverted file and product-quantised residuals.

Coarse centroids, codebooks and the number of lists to probe are fitted on a bounded sample; every vector is then
indexed: it goes to the list of its nearest centroid and its residual becomes one byte per subspace. A query visits the
lists of its nearest centroids, ranks their vectors by asymmetric distance tables (query exact, vectors as codes), and
the best of each unit are ranked again by exact distance on the original vectors, as are all others whose code distance
less the error of their code may still be among the nearest: within the lists probed the result is exact. Equal vectors
are one entry of the index, with their smallest ids.

Lists are cut into units of about UNIT vectors, and each vector is shuffled once, to its unit. A query goes to the units
of the lists that it probes. Only a list that more than BLOCK queries probe has its vectors copied, once for each BLOCK of
them, so no task depends on the size of one list or on the number of queries. Lists grow with the square root of the
number of vectors, and the sample that they are fitted on with them, up to stated bounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import written

#: Lists at most, vectors in the sample for each list, and for small tables; numbers that the sample holds at most.
LISTS, EACH, SAMPLE, NUMBERS = 16_384, 16, 16_384, 1 << 25
#: Subspaces and codewords of a subspace.
SUBSPACES, WORDS = 16, 256
#: Vectors of a unit, and queries of a block (about).
UNIT, BLOCK = 8_192, 4_096
#: Share of sampled true neighbours whose lists must be probed; vectors of a unit ranked again first for each query.
TARGET, AGAIN = 0.985, 256
#: Parts that the ids of equal vectors are cut into; queries compared at a time.
SALTS, TOGETHER = 16, 64


def usable(embedding: Column) -> Column:
    """Whether a vector takes part: not null, not zero, all components finite."""
    finite = F.forall(embedding, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Number of the nearest row of c for each row of x."""
    half = (c * c).sum(1) / 2
    return np.concatenate([(half - x[i : i + 8192] @ c.T).argmin(1) for i in range(0, len(x), 8192)]) if len(x) else np.zeros(0, np.int64)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Lloyd's rounds from k random rows; an empty centre takes a random row. Fewer rows than k: the rows themselves."""
    if len(x) <= k:
        return x.copy()
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, c)
        n = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, x[:, j], k) for j in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)])
    return c


@dataclass
class Index:
    """Centroids, codebooks (one array a subspace) and the number of lists to probe."""

    centroids: np.ndarray
    parts: list[np.ndarray]
    books: list[np.ndarray]
    probes: int

    def codes(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = x - self.centroids[lists]
        return np.stack([_nearest(rest[:, p], b) for p, b in zip(self.parts, self.books, strict=True)], axis=1).astype(np.uint8)

    def errors(self, x: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Distances of the rows of x from what their codes stand for."""
        rest = x - self.centroids[lists]
        for s, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            rest[:, p] -= b[codes[:, s]]
        return np.sqrt((rest * rest).sum(1))

    def tables(self, q: np.ndarray, number: int) -> np.ndarray:
        """Squared distances (queries, subspaces, codewords) of what queries have beyond a centroid to the codewords."""
        rest = q - self.centroids[number]
        width = max(map(len, self.books))
        out = np.full((len(q), len(self.books), width), np.inf, np.float32)
        for s, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            d = rest[:, p]
            out[:, s, : len(b)] = (d * d).sum(1)[:, None] - 2 * d @ b.T + (b * b).sum(1)
        return out


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances, in double precision, of one query to the rows of x."""
    d = x.astype(np.float64) - q.astype(np.float64)
    return np.sqrt((d * d).sum(axis=1))


def fit(x: np.ndarray, total: int, neighbours: int = 10, seed: int = 3) -> Index:
    """Fit on sampled vectors; ``total`` is the number of all vectors."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float64)
    centroids = kmeans(x, int(min(lists_for(total), max(1, len(x) // EACH))), rng)
    parts = [p for p in np.array_split(np.arange(x.shape[1]), min(SUBSPACES, x.shape[1])) if len(p)]
    some = x[rng.permutation(len(x))[:8192]]
    rest = some - centroids[_nearest(some, centroids)]
    books = [kmeans(rest[:, p], WORDS, rng) for p in parts]
    # In the sample, how far down a query's order of centroids do its neighbours' lists stand?
    tests = rng.permutation(len(x))[:256]
    lists = _nearest(x, centroids)
    ranks = []
    for t in tests:
        near = np.argsort(exact(x[t], x), kind="stable")
        near = near[near != t][:neighbours]
        order = np.argsort(exact(x[t], centroids), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ranks += place[lists[near]].tolist()
    probes = int(np.quantile(ranks, TARGET)) + 1 if ranks else 1
    return Index(centroids, parts, books, probes)


def lists_for(total: int) -> int:
    """The number of lists for so many vectors."""
    return min(LISTS, max(1, round(math.sqrt(total))))


def fitted(vectors: DataFrame, length: int, neighbours: int = 10) -> tuple[Index, int]:
    """The index model of distinct usable vectors of one length, and their number.

    The sample has EACH vectors for each list, SAMPLE at least, and NUMBERS numbers at most.
    """
    total = vectors.count()
    sample = min(max(SAMPLE, EACH * lists_for(total)), NUMBERS // max(length, 1))
    u = F.pmod(F.xxhash64("embedding", F.lit(31)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = vectors.where(u < F.lit(min(1.0, sample / max(total, 1)))).limit(2 * sample).toArrow()
    x = rows["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows.num_rows, -1)
    return fit(x[np.lexsort(x.T[::-1])] if len(x) else x, total, neighbours), total


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0))


def folded(vectors: DataFrame, most: int) -> DataFrame:
    """(vec_id, embedding, ids): one row for equal vectors, with their ``most`` smallest ids in order; vec_id is the first.

    Equal means equal in two 64-bit hashes. Ids are ranked apart from the vectors, by parts first, so that very many
    copies of one vector are no single task's.
    """
    e = F.transform("embedding", lambda x: x + F.lit(0).cast("float"))  # -0 is 0
    keyed = vectors.select("vec_id", e.alias("embedding")).select("*", F.xxhash64("embedding").alias("k"), F.xxhash64(F.lit(17), "embedding").alias("l"))
    ids = keyed.select("k", "l", "vec_id").distinct().withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    w = Window.partitionBy("k", "l", "salt").orderBy("vec_id")
    ids = ids.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    ids = ids.groupBy("k", "l").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, most).alias("ids"))
    one = keyed.groupBy("k", "l").agg(F.min("embedding").alias("embedding"))
    return one.join(ids, ["k", "l"]).select(F.col("ids")[0].alias("vec_id"), "embedding", "ids")


def _firsts(order: np.ndarray, d: np.ndarray, ids: list, own: int, neighbours: int) -> list[tuple[float, int]]:
    """The nearest (distance, id) of rows in order of distance, ids other than ``own`` once; ties to smaller ids."""
    seen: dict[int, float] = {}
    last = -1.0
    for k in order:
        if len(seen) >= neighbours and d[k] > last:
            break
        last = d[k]
        for i in ids[k]:
            if i != own:
                seen.setdefault(int(i), float(last))
    return sorted((x, i) for i, x in seen.items())[:neighbours]


def searched(vectors: DataFrame, queries: DataFrame, neighbours: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest vectors found for each query, by Euclidean distance.

    vectors, queries: (vec_id, embedding); other columns are not used. A query's own vec_id is no candidate; ties go to
    the smaller vec_id. Null, zero or non-finite vectors take no part, nor do rows without vec_id. A query is compared with
    vectors of its own length; each length has an index of its own (lengths must be few). A repeated query id of one length
    is asked once, and rows of one vec_id are one candidate (the nearest of them). Fewer candidates than ``neighbours``: all
    of them. A query probes as many lists as the index says, and on until they hold enough candidates. Vectors of float
    stay so, others are double; scores are computed in double precision.
    """
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def take(df: DataFrame) -> DataFrame:
        element = df.schema["embedding"].dataType.elementType
        e = F.col("embedding") if isinstance(element, T.FloatType) else F.col("embedding").cast("array<double>")
        df = df.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"))
        return df.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())

    vectors, queries = take(vectors), take(queries)
    found = empty
    for r in queries.groupBy(F.size("embedding").alias("d")).count().orderBy("d").collect():
        same = F.size("embedding") == r["d"]
        own = _of_length(vectors.where(same), queries.where(same), r["d"], neighbours)
        found = own if found is empty else found.unionByName(own)
    return found


def _of_length(vectors: DataFrame, queries: DataFrame, length: int, neighbours: int) -> DataFrame:
    spark = vectors.sparkSession
    queries = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    # One id more than asked for: a query's own is no candidate.
    vectors = written(folded(vectors, neighbours + 1), "vectors")
    index, total = fitted(vectors, length, neighbours)
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    model = spark.sparkContext.broadcast(index)
    kinds = {c: dict(df.dtypes)["embedding"] for c, df in (("vectors", vectors), ("queries", queries))}
    entry = f"vec_id long, embedding {kinds['vectors']}, ids array<long>, list int, codes binary, error double"

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for b in batches:
            if len(b):
                x = _matrix(b["embedding"]).astype(np.float64)
                lists = _nearest(x, m.centroids)
                codes = m.codes(x, lists)
                yield b.assign(list=lists, codes=[c.tobytes() for c in codes], error=m.errors(x, lists, codes))

    indexed = vectors.select("vec_id", "embedding", "ids").mapInPandas(assign, entry)
    # One number a list, at most LISTS of them. Assigning again is cheaper than keeping the table.
    counts = {r["list"]: r["n"] for r in indexed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Candidates of each list. An id with several vectors counts in one list alone, so no sum of lists says too much.
    own = indexed.select(F.explode("ids").alias("id"), "list").groupBy("id").agg(F.min("list").alias("list"))
    held = np.zeros(len(index.centroids), np.int64)
    for r in own.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():
        held[r["list"]] = r["n"]
    candidates = spark.sparkContext.broadcast(held)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for b in batches:
            lists = []
            for q in b["embedding"]:
                near = np.argsort(exact(q, m.centroids), kind="stable")
                # Enough for ``neighbours`` besides the query itself.
                enough = int(np.searchsorted(np.cumsum(candidates.value[near]), neighbours + 1)) + 1
                lists.append(near[: max(m.probes, enough)])
            yield pd.DataFrame({"query_id": b["vec_id"], "query": b["embedding"], "lists": lists})

    asked = written(queries.mapInPandas(probe, f"query_id long, query {kinds['queries']}, lists array<int>"), "asked")
    asked = asked.select("query_id", "query", F.explode("lists").alias("list"))
    units, blocks = np.ones(len(index.centroids), np.int64), np.ones(len(index.centroids), np.int64)
    for number, n in counts.items():
        units[number] = -(-n // UNIT)
    for r in asked.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():
        blocks[r["list"]] = -(-r["n"] // BLOCK)
    layout = spark.sparkContext.broadcast((units, blocks))

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Vectors with their unit, for each block of the queries of their list."""
        units, blocks = layout.value
        for b in batches:
            lists, ids = b["list"].to_numpy(), b["vec_id"].to_numpy()
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            b = b.assign(unit=(mixed % units[lists].astype(np.uint64)).astype(np.int64))
            for k in range(int(blocks[lists].max()) if len(b) else 0):
                yield b[blocks[lists] > k].assign(block=k)

    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Queries for each unit of a list."""
        units, blocks = layout.value
        for b in batches:
            lists, ids = b["list"].to_numpy(), b["query_id"].to_numpy()
            mixed = (ids.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)
            b = b.assign(block=(mixed % blocks[lists].astype(np.uint64)).astype(np.int64))
            for k in range(int(units[lists].max()) if len(b) else 0):
                yield b[units[lists] > k].assign(unit=k)

    def search(key: tuple, qs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
        """The nearest vectors of one unit for the queries of one block."""
        out = []
        if len(qs) and len(vs):
            m, number = model.value, int(key[0])
            x, q, ids = _matrix(vs["embedding"]), _matrix(qs["query"]), vs["ids"].to_numpy()
            codes = np.frombuffer(b"".join(vs["codes"]), np.uint8).reshape(len(vs), -1)
            errors, own_ids = vs["error"].to_numpy(), qs["query_id"].tolist()
            for start in range(0, len(qs), TOGETHER):
                table = m.tables(q[start : start + TOGETHER].astype(np.float64), number)
                sums = np.zeros((len(table), len(vs)), np.float32)
                for s in range(codes.shape[1]):
                    sums += table[:, s][:, codes[:, s]]
                for a, row in enumerate(sums, start):
                    # No vector is nearer than its code less the error of the code (and of the sums).
                    far = np.sqrt(np.maximum(row.astype(np.float64), 0))
                    least = far - errors - 1e-4 * (far + errors) - 1e-6 * np.linalg.norm(q[a])
                    first = np.argpartition(row, AGAIN - 1)[:AGAIN] if len(row) > AGAIN else np.arange(len(row))
                    d = np.full(len(row), np.inf)
                    d[first] = exact(q[a], x[first])
                    best = _firsts(first[np.argsort(d[first], kind="stable")], d, ids, own_ids[a], neighbours)
                    bound = best[-1][0] if len(best) == neighbours else np.inf
                    more = np.flatnonzero((least <= bound) & np.isinf(d))
                    if len(more):
                        d[more] = exact(q[a], x[more])
                        done = np.flatnonzero(np.isfinite(d))
                        best = _firsts(done[np.argsort(d[done], kind="stable")], d, ids, own_ids[a], neighbours)
                    out += [(own_ids[a], i, z) for z, i in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    vs = indexed.mapInPandas(dealt, f"{entry}, unit long, block long")
    qs = asked.mapInPandas(sent, f"query_id long, query {kinds['queries']}, list int, block long, unit long")
    place = ["list", "unit", "block"]
    found = qs.groupBy(*place).cogroup(vs.groupBy(*place)).applyInPandas(search, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")


def neighbours_of_every_hundredth(embeddings: DataFrame) -> DataFrame:
    """The ten nearest rows of every row whose vec_id is divisible by 100."""
    return searched(embeddings, embeddings.where(F.col("vec_id") % 100 == 0))
