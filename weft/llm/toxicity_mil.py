"""Toxicity by multiple-instance learning.

Only documents carry labels. A sentence has the logistic score p of the features of its distinct words; a document's score is the
noisy-or of its sentences, 1 - prod(1 - p). Fitting follows the document labels through that product, so the blame for a
toxic document goes to the sentences that explain it; afterwards sentence scores say where the offence stands.

Fitting takes a bounded sample of labelled documents (``PER_CLASS`` of each label, chosen by hash) on the driver; scoring
is one narrow pass over whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, bounded_sample, bucket_of_id, from_text, letter_words, text_slices, written

#: Labelled documents of each class that the fit takes at most, and features that it keeps.
PER_CLASS, FEATURES = 1500, 2000
#: A feature counts if so many sampled documents have it and its shares in the classes differ by so many standard errors.
LEAST_DOCS, LEAST_Z = 6, 4.0
#: Log-odds of a sentence without evidence: where the fit of it starts, and how strongly it is held there. Without that, toxic
#: documents that the sample can't explain would raise it until documents of thousands of plain sentences are no more clean.
BIAS, HELD = -9.0, 300.0
#: Words whose weights a Python worker keeps.
KEPT_WORDS = 200_000
SENTENCE = re.compile(r"[^.!?\n]+")


def features(word: str) -> tuple[str, ...]:
    """Features of one word in lower case: itself and its beginnings."""
    return "w" + word, "4" + word[:4], "5" + word[:5]


@dataclass
class Model:
    """Weights by feature, and the score of a sentence without any."""

    bias: float
    weights: dict[str, float]
    known: dict[str, float] = field(default_factory=dict)

    def word_weights(self, words: list[str]) -> list[float]:
        known, get = self.known, self.weights.get
        if len(known) > KEPT_WORDS:
            known.clear()
        out = []
        for w in words:
            x = known.get(w)
            if x is None:
                x = known[w] = sum(get(f, 0.0) for f in features(w))
            out.append(x)
        return out

    def sentences(self, text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Places of the sentences that have words, and their probabilities."""
        places, sums = [], []
        low = text.lower()
        same = len(low) == len(text)  # a few letters change length in lower case
        for m in SENTENCE.finditer(text):
            words = letter_words(low[m.start() : m.end()] if same else m.group().lower())
            if words:
                places.append(m.span())
                sums.append(sum(self.word_weights(list(dict.fromkeys(words)))))
        return places, 1 / (1 + np.exp(-np.clip(np.array(sums) + self.bias, -30, 30)))

    def score(self, text: str) -> float:
        """Noisy-or over the sentences; 0 without words."""
        p = self.sentences(text)[1]
        return float(min(1.0, max(0.0, -np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())))) if len(p) else 0.0

    def scores(self, texts: list[str]) -> list[float]:
        return [self.score(t) for t in texts]


def fit(samples: list[tuple[str, int]], steps: int = 250, seed: int = 5) -> Model:
    """Fit on (text, label) pairs. Without both labels in the sample every score is that of an empty sentence."""
    bags = [[letter_words(s.lower()) for s in SENTENCE.findall(t)] for t, _ in samples]
    bags = [[list(dict.fromkeys(ws)) for ws in b if ws] for b in bags]
    y = np.array([label for _, label in samples], dtype=float)
    n1, n0 = y.sum(), len(y) - y.sum()
    if not n1 or not n0:
        return Model(BIAS, {})
    # Features that occur in enough documents and unlike in the two classes.
    found: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for b, label in zip(bags, y, strict=True):
        found[int(label)].update({f for ws in b for w in ws for f in features(w)})
    gain = {}
    for f in found[1].keys() | found[0].keys():
        a, b = found[1][f], found[0][f]
        share = (a + b) / len(y)
        z = abs(a / n1 - b / n0) / np.sqrt(max(share * (1 - share), 1e-9) * (1 / n1 + 1 / n0))
        if a + b >= LEAST_DOCS and z >= LEAST_Z:
            gain[f] = z
    kept = {f: i for i, f in enumerate(sorted(gain, key=lambda f: (-gain[f], f))[:FEATURES])}
    columns, rows, owner = [], [], []
    for i, b in enumerate(bags):
        for ws in b:
            own = [kept[f] for w in ws for f in features(w) if f in kept]
            columns += own
            rows += [len(owner)] * len(own)
            owner.append(i)
    col, row, own = np.array(columns, dtype=np.int64), np.array(rows, dtype=np.int64), np.array(owner, dtype=np.int64)
    w = np.append(np.zeros(len(kept)), BIAS)  # The last weight is the bias.
    rate, mean, square = 0.1, np.zeros(len(w)), np.zeros(len(w))  # Adam
    # Both classes count alike.
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0) * len(y)
    for step in range(1, steps + 1):
        z = np.clip(np.bincount(row, w[col], len(own)) + w[-1], -30, 30)
        p = 1 / (1 + np.exp(-z))
        none = np.exp(np.bincount(own, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y)))
        slope = np.where(y == 1, -none / np.maximum(1 - none, 1e-9), 1.0) * weight
        g = p * slope[own]
        grad = np.bincount(col, g[row], len(w)) + 0.05 * w
        grad[-1] = g.sum() + HELD * (w[-1] - BIAS)
        mean = 0.9 * mean + 0.1 * grad
        square = 0.99 * square + 0.01 * grad * grad
        w -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    return Model(float(w[-1]), {f: float(w[i]) for f, i in kept.items() if abs(w[i]) > 1e-3})


def trained(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """Fit on labelled documents whose fold (crc32 of the id, modulo 5) is not 0, about ``per_class`` of each label.

    Null labels and null texts teach nothing; of rows that share an id one text counts.
    """
    folds = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & (bucket_of_id("k", 5) != 0))
    # At most per_class ids of each of two labels, and one text each: the rows that reach the driver are bounded, and so is the
    # broadcast of the ids, without which all texts could be shuffled to find these few.
    chosen = written(bounded_sample(folds, "k", "y", per_class), "labelled")
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull()).join(F.broadcast(chosen.select("k").distinct()), "k", "left_semi")
    rows = texts.groupBy("k").agg(F.min("t").alias("t")).join(chosen, "k").collect()
    return fit([(r["t"], r["y"]) for r in sorted(rows, key=lambda r: (r["k"], r["y"], r["t"]))])


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted) of every whole text; null or wordless texts score 0. Other columns are not used."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].fillna("").tolist()
            for i, j in text_slices(texts):
                yield pd.DataFrame({"key": b["key"].iloc[i:j].to_numpy(), "score": shared.value.scores(texts[i:j])})

    out = docs.select(as_text(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, "key string, score double")
    return out.select(from_text("key", kind, key), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def with_toxicity(docs: DataFrame, model: Model, text: str = "text", column: str = "_toxicity") -> DataFrame:
    """``docs`` with a double column of scores beside its own columns, which stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(shared.value.scores(b.fillna("").tolist()), dtype=float)

    return docs.withColumn(column, F.pandas_udf(run, "double")(F.col(text)))


def offending(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """(key, start, end, score) of the sentences that score ``least`` or more, in characters of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b["key"], b["text"].fillna(""), strict=True):
                places, p = shared.value.sentences(t)
                rows += [(k, *places[i], float(p[i])) for i in np.flatnonzero(p >= least)]
            yield pd.DataFrame(rows, columns=["key", "start", "end", "score"])

    out = docs.select(as_text(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, "key string, start int, end int, score double")
    return out.select(from_text("key", kind, key), "start", "end", "score")


def toxicity_of_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; see :func:`trained` and :func:`scored`."""
    out = scored(docs, trained(docs, labels))
    return out.select("doc_id", (bucket_of_id("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
