"""Language identification of words and documents by a linear-chain conditional random field.

Every word of a text gets a label by forward-backward: the score of a label sequence is the sum of word scores (affixes,
character n-grams and membership of per-language lexicons, hashed into a weight table) and of learned transitions, so
words of code-switched text get the label that they and their neighbours call for. A document's language is the one with
the largest mean posterior over all its words.

Fitting takes a bounded sample of labelled documents (``PER_LANG`` of each language, chosen by hash) on the driver;
labelling is one narrow pass over all rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, bounded_sample, bucket_of_id, from_text, letter_spans, letter_words, text_slices

#: Documents of each language that the fit takes at most, each whole.
PER_LANG = 300
#: Size of the hashed weight table; words kept in each language's lexicon.
TABLE, LEXICON = 1 << 15, 300
#: Words whose scores a Python worker keeps.
KEPT_WORDS = 200_000
#: The answer for a text without letters.
UNDETERMINED = "und"
#: Size of the tables of character counts; weight of the shorter context, and the chance of a character never seen.
COUNTS, BACK_OFF, UNSEEN = 1 << 17, 2.0, 1e-3
#: A text is foreign if its words are less likely than those of training texts by so many standard deviations.
DEVIATIONS = 10.0
CODES = re.compile(r"\S*\d\S*")


def _slots(kind: int, *codes: np.ndarray, size: int = TABLE) -> np.ndarray:
    """Places in a table of ``size`` for features of one kind, from the codes of their characters."""
    h = np.full(len(codes[0]), kind * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for c in codes:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return (h % np.uint64(size)).astype(np.int64)


def features(words: list[str], lexicon: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(slot, word number) of all features of the words, in lower case: the word, its first and last one to three
    characters, its character pairs and triples with borders, and the lexicons that hold it."""
    low = [w.lower() for w in words]
    sizes = np.array([len(w) for w in low], dtype=np.int64) + 2
    codes = np.frombuffer("".join([f"^{w}$" for w in low]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(sizes)
    starts, owner, every = ends - sizes, np.repeat(np.arange(len(low)), sizes), np.arange(len(low))
    slots, owners = [_slots(1, np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in low], dtype=np.uint64))], [every]
    for k in (2, 3):
        at = np.flatnonzero(owner[: len(owner) - k + 1] == owner[k - 1 :])
        slots.append(_slots(k, *(codes[at + i] for i in range(k))))
        owners.append(owner[at])
    for k in (1, 2, 3):
        some = every[sizes >= k + 2]
        slots += [_slots(3 + k, *(codes[starts[some] + 1 + i] for i in range(k))), _slots(6 + k, *(codes[ends[some] - 2 - i] for i in range(k)))]
        owners += [some, some]
    listed = [(slot, i) for i, w in enumerate(low) if w in lexicon for slot in lexicon[w]]
    if listed:
        slots.append(np.array([x[0] for x in listed]))
        owners.append(np.array([x[1] for x in listed]))
    return np.concatenate(slots), np.concatenate(owners)


class Spelling:
    """How words of each language are spelled: the chance of a character after the two before it, from training words.

    It answers what the chain cannot, as that knows its own labels only: whether a text is in any of these languages.
    ``normal`` holds, for each language, the mean of the words' values in training texts that were left out of the counts,
    their deviation, and that of the texts' means.
    """

    def __init__(self, languages: int) -> None:
        self.counts = [np.zeros((COUNTS, languages), np.float32) for _ in range(3)]
        self.normal = np.zeros((languages, 3))

    @staticmethod
    def _places(words: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """Slots of each character with two, one and no character before it, and the word that each belongs to."""
        low = [w.lower() for w in words]
        sizes = np.array([len(w) for w in low], dtype=np.int64) + 3
        codes = np.frombuffer("".join([f"^^{w}$" for w in low]).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(low)), sizes)
        at = np.flatnonzero(owner[:-2] == owner[2:]) if len(owner) > 2 else np.zeros(0, np.int64)
        a, b, c = codes[at], codes[at + 1], codes[at + 2]
        return [_slots(23, a, b, c, size=COUNTS), _slots(22, b, c, size=COUNTS), _slots(24, a, b, size=COUNTS), _slots(21, b, size=COUNTS)], owner[at]

    def learn(self, words: list[str], language: int) -> None:
        (three, two, context, one), _ = self._places(words)
        for table, slots in zip(self.counts, (three, two), strict=False):
            np.add.at(table[:, language], slots, 1)
        np.add.at(self.counts[2][:, language], np.concatenate([context, one]), 1)

    def values(self, words: list[str]) -> np.ndarray:
        """(words, languages): mean log chance of a word's characters and its end."""
        (three, two, context, one), owner = self._places(words)
        shorter = (self.counts[1][two] + BACK_OFF * UNSEEN) / (self.counts[2][one] + BACK_OFF)
        longer = np.log((self.counts[0][three] + BACK_OFF * shorter) / (self.counts[2][context] + BACK_OFF))
        n = np.maximum(np.bincount(owner, minlength=len(words)), 1)
        return np.stack([np.bincount(owner, longer[:, k], len(words)) / n for k in range(longer.shape[1])], axis=1)

    def deviation(self, mean: float, words: int, language: int) -> float:
        """By how many standard deviations a text of so many words lies below training texts."""
        usual, of_words, of_texts = self.normal[language]
        return float((usual - mean) / np.sqrt(of_texts**2 + of_words**2 / max(words, 1) + 1e-9))


def spelling_of(texts: list[tuple[list[str], int]], languages: int) -> Spelling:
    """From (words, language) of training texts; what is normal is measured on each half by the counts of the other."""
    whole, halves = Spelling(languages), [Spelling(languages), Spelling(languages)]
    for i, (ws, k) in enumerate(texts):
        whole.learn(ws, k)
        halves[i % 2].learn(ws, k)
    seen: list[list[np.ndarray]] = [[] for _ in range(languages)]
    for i, (ws, k) in enumerate(texts):
        seen[k].append(halves[1 - i % 2].values(ws)[:, k])
    for k, values in enumerate(seen):
        if values:
            every, means = np.concatenate(values), np.array([v.mean() for v in values if len(v) >= 20] or [v.mean() for v in values])
            whole.normal[k] = means.mean(), every.std(), means.std()
    return whole


@dataclass
class Model:
    """Weights (TABLE x labels), transitions (logs), the lexicon words with the slots of their languages, and spelling."""

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: dict[str, list[int]]
    spelling: Spelling | None = None

    def scores(self, words: list[str]) -> np.ndarray:
        """(words, labels)"""
        slots, owners = features(words, self.lexicon)
        w = self.weights[slots]
        return np.stack([np.bincount(owners, w[:, k], len(words)) for k in range(w.shape[1])], axis=1)


def _chain(alpha0: np.ndarray, emit: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Forward-backward over a batch (B, T, L) of equally long sequences: unary and summed pair posteriors, log-likelihood."""
    b, t, n = emit.shape
    top = emit.max(axis=2, keepdims=True)
    e, trans = np.exp(emit - top), np.exp(transitions)
    fwd, scale = np.empty_like(e), np.empty((b, t))
    a = alpha0 * e[:, 0]
    for k in range(t):
        if k:
            a = (fwd[:, k - 1] @ trans) * e[:, k]
        scale[:, k] = a.sum(axis=1)
        fwd[:, k] = a / scale[:, k, None]
    back = np.ones((b, n))
    unary, pairs = np.empty_like(e), np.zeros((n, n))
    unary[:, -1] = fwd[:, -1]
    for k in range(t - 1, 0, -1):
        eb = e[:, k] * back / scale[:, k, None]
        pairs += np.einsum("bi,ij,bj->ij", fwd[:, k - 1], trans, eb)
        back = eb @ trans.T
        unary[:, k - 1] = fwd[:, k - 1] * back
    return unary, pairs, np.log(scale).sum() + top.sum(), float(b)


def fit(samples: list[tuple[str, str]], seed: int = 7, epochs: int = 2, steps: int = 60) -> Model:
    """Fit on (text, language) pairs.

    Each language's words are dealt into spans and spans of two documents follow one another in the training sequences,
    so that transitions are learned from real changes of language as well as from staying. Without samples the model has
    no labels and every answer is ``und``.
    """
    rng = np.random.default_rng(seed)
    words = [(w, lang) for t, lang in samples if (w := letter_words(t))]
    labels = sorted({lang for _, lang in words})
    n = len(labels)
    model = Model(labels, np.zeros((TABLE, n)), np.zeros((n, n)), {})
    if n < 2:
        return model
    common = {lang: [w for w, _ in Counter(x.lower() for ws, y in words for x in ws if y == lang).most_common(LEXICON)] for lang in labels}
    for slot, ws in zip(_slots(10, np.arange(n)).tolist(), common.values(), strict=True):
        for w in ws:
            model.lexicon.setdefault(w, []).append(slot)
    seen: dict[str, int] = {}
    spans: list[tuple[np.ndarray, int]] = []
    for ws, lang in words:
        ids = [seen.setdefault(w, len(seen)) for w in ws]
        cut = steps // 2
        # The last span goes back so far that it is full; a shorter text is repeated.
        starts = [*range(0, len(ids) - cut, cut), max(0, len(ids) - cut)]
        spans += [(np.resize(np.array(ids[i : i + cut]), cut), labels.index(lang)) for i in starts]
    slots, owners = features(list(seen), model.lexicon)
    order = np.argsort(owners, kind="stable")
    sizes = np.bincount(owners, minlength=len(seen))
    feats = np.full((len(seen), sizes.max()), TABLE)
    feats[owners[order], np.arange(len(owners)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = slots[order]
    weights = np.zeros((TABLE + 1, n))
    squares, t_squares = np.full((TABLE + 1, n), 1e-8), np.full((n, n), 1e-8)
    trans = model.transitions
    batch = 32
    for epoch in range(epochs):
        order = rng.permutation(len(spans))
        # Three in four sequences go on with the same language where possible.
        if epoch % 2 == 0:
            order = order[np.argsort(np.array([spans[i][1] for i in order]), kind="stable")]
        # An odd last span is followed by the first.
        pairs = np.resize(order, len(order) + len(order) % 2).reshape(-1, 2)
        if epoch % 2 == 0:
            pairs = pairs[rng.permutation(len(pairs))]
        for i in range(0, len(pairs), batch):
            p = pairs[i : i + batch]
            ids = np.stack([np.concatenate([spans[a][0], spans[b][0]]) for a, b in p])
            gold = np.repeat(np.array([[spans[a][1], spans[b][1]] for a, b in p]), ids.shape[1] // 2, axis=1)
            f = feats[ids]
            emit = weights[f].sum(axis=2)
            unary, pair, _, _ = _chain(np.full(n, 1 / n), emit, trans)
            err = -unary
            np.put_along_axis(err, gold[:, :, None], np.take_along_axis(err, gold[:, :, None], 2) + 1, 2)
            flat = f.reshape(-1)
            grad = np.stack([np.bincount(flat, np.repeat(err[:, :, k].reshape(-1), f.shape[2]), TABLE + 1) for k in range(n)], axis=1) / len(p)
            grad -= 1e-3 * weights
            grad[TABLE] = 0
            squares += grad * grad
            weights += 0.3 * grad / np.sqrt(squares)
            want = np.zeros((n, n))
            np.add.at(want, (gold[:, :-1].reshape(-1), gold[:, 1:].reshape(-1)), 1)
            g = (want - pair) / len(p) - 1e-2 * trans
            t_squares += g * g
            trans += 0.1 * g / np.sqrt(t_squares)
    model.weights = weights[:TABLE].astype(np.float32)
    model.spelling = spelling_of([(w, labels.index(lang)) for w, lang in words], n)
    return model


def posteriors(emit: np.ndarray, first: np.ndarray, model: Model) -> np.ndarray:
    """Label posteriors (N, L) for many sequences laid end to end; ``first`` marks where each begins.

    A beginning is a step whose matrix forgets the past, so all sequences form one chain. The chain is cut into blocks;
    products inside all blocks are formed side by side, then carried from block to block.
    """
    n, k = emit.shape
    if not n:
        return np.zeros((0, k))
    width = max(1, int(np.sqrt(n)))
    blocks = -(-n // width)
    e = np.exp(emit - emit.max(axis=1, keepdims=True))
    step = np.exp(model.transitions - model.transitions.max())[None] * e[:, None, :]
    step[first] = np.full((k, 1), 1 / k) * e[first][:, None, :]
    pad = blocks * width - n
    step = np.concatenate([step, np.broadcast_to(np.eye(k), (pad, k, k))]).reshape(blocks, width, k, k)

    def norm(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(x.sum(axis=(-1, -2), keepdims=True), 1e-300)

    whole = norm(step[:, 0])
    for i in range(1, width):
        whole = norm(whole @ step[:, i])
    # What comes into each block from the left and from the right.
    left, right = np.empty((blocks, k)), np.empty((blocks, k))
    a = np.full(k, 1 / k)
    for i in range(blocks):
        left[i] = a
        a = a @ whole[i]
        a /= a.sum()
    b = np.ones(k)
    for i in range(blocks - 1, -1, -1):
        right[i] = b
        b = whole[i] @ b
        b /= b.sum()
    fwd = np.empty((blocks, width, k))
    for i in range(width):
        left = np.einsum("bi,bij->bj", left, step[:, i])
        left /= left.sum(axis=1, keepdims=True)
        fwd[:, i] = left
    for i in range(width - 1, -1, -1):
        fwd[:, i] *= right
        right = np.einsum("bij,bj->bi", step[:, i], right)
        right /= right.sum(axis=1, keepdims=True)
    post = fwd.reshape(-1, k)[:n]
    return post / post.sum(axis=1, keepdims=True)


class Labeller:
    """Applies a model in a Python worker; scores of distinct words are kept."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.labels)))
        self.spelled = np.zeros((0, len(model.labels)))

    def word_ids(self, words: list[str]) -> np.ndarray:
        if len(self.known) > KEPT_WORDS:
            self.known, self.scores, self.spelled = {}, self.scores[:0], self.spelled[:0]
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new:
            self.scores = np.concatenate([self.scores, self.model.scores(new)])
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The numbers of words of the texts; the numbers of the words (of ``word_ids``) and their posteriors, end to end."""
        split = [letter_words(t) for t in texts]
        sizes = np.array([len(w) for w in split], dtype=np.int64)
        ids = self.word_ids([w for ws in split for w in ws])
        first = np.zeros(len(ids), bool)
        first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        return sizes, ids, posteriors(self.scores[ids], first, self.model)

    def documents(self, texts: list[str], foreign: bool = False) -> tuple[list[str], list[float], list[float]]:
        """The language of each text, the mean posterior of it over the text's words and, if asked for, by how many
        deviations the text's spelling is unlike the languages that its words got (else 0)."""
        if not self.model.labels:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        sizes, ids, post = self.words(texts)
        ends = np.cumsum(sizes)

        def mean(x: np.ndarray) -> np.ndarray:
            total = np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0)])
            return (total[ends] - total[ends - sizes]) / np.maximum(sizes, 1)[:, None]

        score = mean(post)
        best = score.argmax(axis=1)
        lang = [self.model.labels[k] if s else UNDETERMINED for k, s in zip(best, sizes, strict=True)]
        far = [0.0] * len(texts)
        if foreign and self.model.spelling:
            if len(self.spelled) < len(self.known):
                new = list(self.known)[len(self.spelled) :]
                self.spelled = np.concatenate([self.spelled, self.model.spelling.values(new)])
            value = mean((self.spelled[ids] * post).sum(axis=1, keepdims=True))[:, 0]
            far = [self.model.spelling.deviation(v, s, k) if s else 0.0 for v, s, k in zip(value, sizes, best, strict=True)]
            # Pieces of keys and codes are no words of any language: such texts are judged without them.
            again = {i: said for i, f in enumerate(far) if f >= DEVIATIONS and (said := CODES.sub(" ", texts[i])) != texts[i]}
            if again:
                for i, (name, f) in zip(again, zip(*self.documents(list(again.values()), True)[::2], strict=True), strict=True):
                    far[i] = far[i] if name == UNDETERMINED else min(far[i], f)
        return lang, [float(min(1.0, max(0.0, m[k]))) if s else 0.0 for m, k, s in zip(score, best, sizes, strict=True)], far


def trained(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = PER_LANG) -> Model:
    """Fit on labelled documents whose fold (crc32 of the id, modulo 3) is not 1, at most ``per_lang`` of each language."""
    labelled = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("y")).where(F.col("y").isNotNull() & F.col("t").isNotNull() & (bucket_of_id("k", 3) != 1))
    rows = bounded_sample(labelled, "k", "y", per_lang).collect()
    return fit([(r["t"], r["y"]) for r in sorted(rows, key=lambda r: (r["k"], r["t"]))])


def identified(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every whole text.

    A text that is null or has no letter gets ``und`` and score 0. Ids may repeat: each row is answered. Only the text is
    an input of the answer; other columns are not used.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(shared.value)
        for b in batches:
            texts = b["text"].fillna("").tolist()
            for i, j in text_slices(texts, 2_000_000):
                lang, score, _ = labeller.documents(texts[i:j])
                yield pd.DataFrame({"key": b["key"].iloc[i:j].to_numpy(), "lang_pred": lang, "score": score})

    out = docs.select(as_text(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, "key string, lang_pred string, score double")
    return out.select(from_text("key", kind, key), "lang_pred", "score")


def with_language(docs: DataFrame, model: Model, text: str = "text", column: str = "_language") -> DataFrame:
    """``docs`` with a struct column (lang_pred, score, foreign) beside its own columns, which stay as they are.

    foreign: by how many standard deviations the spelling of the text's words is less likely than in training texts; above
    ``DEVIATIONS`` the text is in none of the learned languages.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(shared.value)
        for b in batches:
            texts, parts = b.fillna("").tolist(), []
            for i, j in text_slices(texts, 2_000_000):
                parts.append(pd.DataFrame(dict(zip(("lang_pred", "score", "foreign"), labeller.documents(texts[i:j], True), strict=True))))
            yield pd.concat(parts) if parts else pd.DataFrame({"lang_pred": [], "score": [], "foreign": []})

    named = F.pandas_udf(run, "lang_pred string, score double, foreign double")
    return docs.withColumn(column, named(F.col(text)))


def spans(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, end, lang, n_words): the runs of words of one language in each text, in characters of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(shared.value)
        for b in batches:
            rows = []
            for k, t in zip(b["key"], b["text"].fillna(""), strict=True):
                places = list(letter_spans(t))
                if not places or not shared.value.labels:
                    continue
                best = labeller.words([t])[2].argmax(axis=1)
                cuts = [0, *(np.flatnonzero(np.diff(best)) + 1).tolist(), len(best)]
                rows += [(k, places[i][0], places[j - 1][1], shared.value.labels[best[i]], j - i) for i, j in zip(cuts, cuts[1:], strict=False)]
            yield pd.DataFrame(rows, columns=["key", "start", "end", "lang", "n_words"])

    out = docs.select(as_text(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, "key string, start int, end int, lang string, n_words int")
    return out.select(from_text("key", kind, key), "start", "end", "lang", "n_words")


def language_of_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; see :func:`trained` and :func:`identified`."""
    out = identified(docs, trained(docs))
    return out.select("doc_id", (bucket_of_id("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
