"""Hashed words of whole texts, an Arrow batch at a time.

Texts of a batch lie one after another in one buffer, so words and their hashes are found by
array arithmetic over its bytes: no loop over words. A word's hash depends on its bytes only.
Batches are worked through in slices of about ``SLICE`` bytes, so memory follows the longest
text, not the batch.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# workers get these functions themselves and need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICE = 1 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

BLANK, LETTER, SIGN = 0, 1, 2


def _classes(signs: int) -> np.ndarray:
    """Byte classes: ASCII blanks, letters (with digits and all bytes of other scripts), signs."""
    kinds = np.full(256, signs, np.uint8)
    kinds[[9, 10, 11, 12, 13, 32]] = BLANK
    for first, last in ((48, 57), (65, 90), (97, 122), (128, 255)):
        kinds[first : last + 1] = LETTER
    return kinds


#: Runs of anything but blanks; runs of letters or of signs; runs of letters alone.
WORDS, WORDS_AND_SIGNS, LETTERS = _classes(LETTER), _classes(SIGN), _classes(BLANK)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit hashes over all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def powers(base: int) -> np.ndarray:
        p = np.full(n + 1, base, np.uint64)
        p[0] = 1
        return np.cumprod(p, dtype=np.uint64)

    return powers(BASE), powers(INVERSE)


class Slice:
    """Words of consecutive texts: the hash, text number and byte span of each."""

    def __init__(self, first: int, data: np.ndarray, ends: np.ndarray, kinds: np.ndarray):
        self.first, self.texts = first, len(ends) - 1
        n = len(data)
        kind = kinds[data]
        change = np.empty(n + 1, bool)
        change[0] = change[n] = True
        np.not_equal(kind[1:], kind[:-1], out=change[1:n])
        change[ends] = True
        cuts = np.flatnonzero(change)
        word = kind[cuts[:-1]] != BLANK
        self.start, self.end = cuts[:-1][word], cuts[1:][word]
        self.text = np.searchsorted(ends, self.start, "right") - 1
        size = max(n, SLICE + 1)
        up, self._down = _powers(size)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=self._sums[1:])
        self.hash = self.span_hash(self.start, self.end)
        #: Words before each text, and in all.
        self.before = np.searchsorted(self.text, np.arange(self.texts + 1))

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes from start to end, wherever they lie."""
        return mixed((self._sums[end] - self._sums[start]) * self._down[start])

    def counts(self) -> np.ndarray:
        return np.diff(self.before)


def slices(texts: pa.Array, kinds: np.ndarray, most: int = 1 << 16) -> Iterator[Slice]:
    """The texts of a column, null being empty, in slices of ``most`` whole texts at most."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + SLICE, "right")) - 1)
        last = min(last, first + most, len(texts))
        part = raw[at[first] : at[last]]
        if len(part):
            yield Slice(first, part, at[first : last + 1] - at[first], kinds)
        first = last


def ngrams(piece: Slice, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words and the text of each; texts of fewer words have none."""
    h, text = piece.hash, piece.text
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(h) - n + 1
    total = h[:m].copy()
    for k in range(1, n):
        total = total * np.uint64(BASE) + h[k : k + m]
    whole = text[:m] == text[n - 1 :]
    return mixed(total[whole]), text[:m][whole]
