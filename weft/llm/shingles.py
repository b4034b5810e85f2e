"""Word shingles as hashed sets, and their min-wise sketches."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np

#: Words of a shingle.
SHINGLE = 5
#: Min-wise values of a sketch.
SKETCH = 128
#: Words whose hashes a Python worker keeps.
KEPT_WORDS = 200_000

_WORDS = re.compile(r"\w+")
_rng = np.random.default_rng(20_011)
_A = _rng.integers(1, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing step."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Shingle sets of texts; hashes of words are kept."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def hashed_words(self, text: str) -> np.ndarray:
        known, out = self.known, []
        if len(known) > KEPT_WORDS:
            known.clear()
        for w in _WORDS.findall(text.lower()):
            h = known.get(w)
            if h is None:
                h = known[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
            out.append(h)
        return np.array(out, np.uint64)

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the text's runs of SHINGLE words in lower case.

        A text of fewer words has one shingle, all its words; a text without words has none.
        """
        w = self.hashed_words(text or "")
        if not len(w):
            return w
        n = max(1, len(w) - SHINGLE + 1)
        h = np.zeros(n, np.uint64)
        for k in range(min(SHINGLE, len(w))):
            h = mix(h + w[k : k + n] * _M[k])
        return np.unique(h)


def sketch(s: np.ndarray) -> np.ndarray:
    """SKETCH min-wise values (32 bits) of a non-empty set."""
    low = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):
        low = np.minimum(low, (mix(s[i : i + 4096])[:, None] * _A[None, :]).min(axis=0))
    return (low >> np.uint64(32)).astype(np.uint32)


def digest(s: np.ndarray) -> bytes:
    """A 16-byte name of a set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def jaccard_counts(sets: list[np.ndarray], other: list[np.ndarray] | None = None, block: int = 1024) -> Iterator[tuple[int, int, np.ndarray]]:
    """Sizes of the intersections, block by block: (first row, first column, counts).

    Only members that stand in two sets or more matter; each block pair is a product of 0/1 matrices of those.
    """
    right = sets if other is None else other
    for i in range(0, len(sets), block):
        a = sets[i : i + block]
        flat_a = np.concatenate(a) if a else np.zeros(0, np.uint64)
        for j in range(i if other is None else 0, len(right), block):
            b = right[j : j + block]
            flat_b = np.concatenate(b)
            if other is None and i == j:
                names, n = np.unique(flat_a, return_counts=True)
                names = names[n > 1]
            else:
                names = np.intersect1d(flat_a, flat_b)
            counts = np.zeros((len(a), len(b)), np.float32)
            for k in range(0, len(names), 4096):
                part = names[k : k + 4096]
                counts += _incidence(a, flat_a, part) @ _incidence(b, flat_b, part).T
            yield i, j, counts


def _incidence(sets: list[np.ndarray], flat: np.ndarray, names: np.ndarray) -> np.ndarray:
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = np.searchsorted(names, flat)
    at[at == len(names)] = 0
    hit = names[at] == flat
    out = np.zeros((len(sets), len(names)), np.float32)
    out[rows[hit], at[hit]] = 1
    return out
