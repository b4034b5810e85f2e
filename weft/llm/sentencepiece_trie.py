"""SentencePiece encoding and decoding by a forward pass over a trie of words.

Text becomes marked words (a word with the mark that stands for the space before it). The distinct words of a block of
documents are sorted, which lays out their trie depth-first, and a forward table is run over it: for each prefix it
holds the last piece of the prefix's encoding. Words share the entries of their common prefix.

The given vocabulary is of the BPE kind, whose encoding is the one that the merges by score reach, not the one with the
best sum of scores. So the forward step keeps, for each prefix, the single piece that may follow the last piece of a
shorter prefix without a merge across the border (``stays_apart``); that chain is the BPE encoding of every prefix.
Words may be treated one by one as no piece has a mark after another character; ``Pieces`` checks that.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, from_text, text_slices

MARK = "▁"
#: Line ends are never part of a piece, so they part words as well.
WORDS = re.compile(rf"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
#: Words whose ids, and pairs of pieces whose borders, a Python worker keeps.
KEPT_WORDS, KEPT_PAIRS = 400_000, 600_000


class Pieces:
    """The vocabulary of a SentencePiece BPE model file, with what the forward pass needs."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.rank: dict[str, int] = {}
        self.id: dict[str, int] = {}
        self.byte_ids = [0] * 256
        self.bytes: list[bytes] = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.bytes.append(b"")
            else:
                self.id[piece] = i
                self.rank[piece] = int(-sp.get_score(i)) if len(piece) > 1 else -1
                self.bytes.append(piece.replace(MARK, " ").encode())
        if "\n" in self.id or any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece goes beyond a word")
        self.derived: dict[str, tuple[str, str] | None] = {}
        self.spines: dict[tuple[str, bool], list[tuple[str, int]]] = {}
        self.apart: dict[tuple[str, str], bool] = {}
        # What a piece may end with: the ids of a piece that merging reaches, nothing for a mere ending of one.
        self.ends: dict[str, bytes] = {}
        for piece, i in self.id.items():
            if self.reachable(piece):
                self.ends[piece] = i.to_bytes(4, "little")
                for k in range(1, len(piece)):
                    self.ends.setdefault(piece[k:], b"")

    def merged(self, text: str) -> tuple[list[str], list[tuple[str, str, int]]]:
        """The pieces of ``text`` by plain merging, and the merges in their order."""
        parts, done = list(text), []
        while True:
            best = min(((self.rank[x], i) for i in range(len(parts) - 1) if (x := parts[i] + parts[i + 1]) in self.rank), default=None)
            if best is None:
                return parts, done
            i = best[1]
            done.append((parts[i], parts[i + 1], best[0]))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def split(self, piece: str) -> tuple[str, str] | None:
        """The last merge that makes ``piece``; None for a character or a piece that merging never reaches."""
        if piece not in self.derived:
            parts, done = self.merged(piece)
            self.derived[piece] = done[-1][:2] if done and parts == [piece] else None
        return self.derived[piece]

    def reachable(self, piece: str) -> bool:
        return len(piece) == 1 or self.split(piece) is not None

    def spine(self, piece: str, right: bool) -> list[tuple[str, int]]:
        """The symbols at one end of ``piece`` while it grows, with the rank at which each forms."""
        key = piece, right
        if key not in self.spines:
            own = [(piece, self.rank.get(piece, -1))]
            parts = self.split(piece) if len(piece) > 1 else None
            self.spines[key] = (self.spine(parts[right], right) if parts else []) + own
        return self.spines[key]

    def stays_apart(self, a: str, b: str) -> bool:
        """Whether merging ``a + b`` ends with these two pieces.

        Both grow by their own merges, the lower rank first and the left one in a tie; the border falls if the symbols
        that meet there form a piece of a rank that comes before the next merge on either side.
        """
        key = a, b
        if key not in self.apart:
            self.apart[key] = self._apart(a, b)
        return self.apart[key]

    def _apart(self, a: str, b: str) -> bool:
        left, right = self.spine(a, True), self.spine(b, False)
        if any(x[k][1] > x[k + 1][1] for x in (left, right) for k in range(len(x) - 1)):
            return self.merged(a + b)[0] == [a, b]
        i = j = 0
        none = 1 << 60
        while True:
            cross = self.rank.get(left[i][0] + right[j][0], none)
            next_left = left[i + 1][1] if i + 1 < len(left) else none
            next_right = right[j + 1][1] if j + 1 < len(right) else none
            if cross < next_left and cross <= next_right:
                return False
            if next_left == next_right == none:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def encode_sorted(self, words: list[str]) -> Iterator[bytes]:
        """Ids (int32, little-endian) of sorted distinct words; each depth of the stack is a prefix of the current word.

        A prefix keeps the last piece of its encoding, that piece's ids and the prefix before it, so the stack grows with
        the length of a word; a word's ids are gathered backwards from its end.
        """
        last: list[str] = [""]
        code: list[bytes] = [b""]
        back: list[int] = [0]
        before = ""
        ends, apart = self.ends, self.apart
        for w in words:
            k, most = 0, min(len(w), len(before))
            while k < most and w[k] == before[k]:
                k += 1
            del last[k + 1 :], code[k + 1 :], back[k + 1 :]
            for end in range(k + 1, len(w) + 1):
                start = end - 1
                while start >= 0 and (ids := ends.get(piece := w[start:end])) is not None:
                    if ids:
                        prior = last[start]
                        fits = not start or apart.get((prior, piece))
                        if fits is None:
                            fits = self.stays_apart(prior, piece)
                        if fits:
                            break
                    start -= 1
                else:  # a character without a piece: its bytes
                    start, piece = end - 1, w[end - 1]
                    ids = b"".join([self.byte_ids[x].to_bytes(4, "little") for x in piece.encode()])
                last.append(piece)
                code.append(ids)
                back.append(start)
            before = w
            found, at = [], len(w)
            while at:
                found.append(code[at])
                at = back[at]
            found.reverse()
            yield b"".join(found)


def marked(text: str) -> list[str]:
    """The marked words of a text; an empty text has none."""
    return WORDS.findall(MARK + text.replace(" ", MARK)) if text else []


class Codec:
    """Encoder and decoder of one Python worker."""

    def __init__(self, model: bytes) -> None:
        self.pieces = Pieces(model)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [marked(t) for t in texts]
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        if len(self.pieces.apart) > KEPT_PAIRS:
            self.pieces.apart.clear()
        new = sorted({w for ws in split for w in ws} - self.known.keys())
        self.known.update(zip(new, self.pieces.encode_sorted(new), strict=True))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, ws)), "<i4") for ws in split]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.pieces.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def encoded(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_ids, ids, ids_crc32, decoded_sha256, round_trip) of every text; one narrow pass.

    A null text is empty and has no ids. ``round_trip``: decoding gives the text back (a text that itself holds the mark
    U+2581 comes back with spaces there). Repeated keys and rows are rows of their own, equal texts have equal ids, an empty
    table gives no rows, other columns are not read. The model file is read on the driver and travels with the tasks (0.5 MB).
    """
    spark = docs.sparkSession
    with open(model_file, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(model.value)
        for b in batches:
            texts = b["text"].fillna("").tolist()
            for i, j in text_slices(texts):
                ids = codec.encode(texts[i:j])
                back = [codec.decode(x) for x in ids]
                yield pd.DataFrame({
                    "key": b["key"].iloc[i:j].to_numpy(), "n_ids": [len(x) for x in ids], "ids": ids, "ids_crc32": [zlib.crc32(x.tobytes()) for x in ids],
                    "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in back], "round_trip": [t == u for t, u in zip(back, texts[i:j], strict=True)],
                })

    out = docs.select(as_text(key).alias("key"), F.col(text).alias("text"))
    out = out.mapInPandas(run, "key string, n_ids int, ids array<int>, ids_crc32 long, decoded_sha256 string, round_trip boolean")
    return out.select(from_text("key", kind, key), "n_ids", "ids", "ids_crc32", "decoded_sha256", "round_trip")
