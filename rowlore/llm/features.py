"""Hashed words and character n-grams of texts, many texts at a time."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
CHUNK = 1 << 18
_BYTES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
# Bytes of words at whose ends they are left out: ASCII punctuation.
_IS_MARK = np.zeros(256, bool)
_IS_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


_POWERS: dict[int, list[np.ndarray]] = {}


def _powers(size: int) -> list[np.ndarray]:
    """Powers of BASE and of its inverse; those of the last size are kept."""
    if size not in _POWERS:
        _POWERS.clear()
        steps = np.full((2, size), BASE, np.uint64)
        steps[1], steps[:, 0] = pow(BASE, -1, 1 << 64), 1
        _POWERS[size] = list(np.multiply.accumulate(steps, axis=1))
    return _POWERS[size]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(32)


class Bytes:
    """The bytes of texts one after another, with hashes of any stretch of them."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.ends = np.cumsum(sizes) - 1
        self.starts = self.ends + 1 - sizes
        # A space after each text ends its last word.
        self.buf = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        if lower:
            self.buf = _LOWER[self.buf]
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
        size = max(len(self.buf), CHUNK)
        power, self.inverse = _powers(size if size == CHUNK else 1 << size.bit_length())
        self.sums = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum(_BYTES[self.buf] * power[: len(self.buf)], out=self.sums[1:])

    def hashes(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.inverse[start])

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, hash) of each n bytes in a row of one text."""
        if len(self.buf) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        value = mixed((self.sums[n:] - self.sums[:-n]) * self.inverse[: len(self.buf) - n + 1])
        inside = self.doc[: len(value)] == self.doc[n - 1 :]
        return self.doc[: len(value)][inside], value[inside]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and stops of the words, which white space separates."""
        gap = _IS_SPACE[self.buf]
        edge = np.flatnonzero(np.diff(gap.astype(np.int8), prepend=1))
        return edge[0::2], edge[1::2]

    def bare_words(self) -> tuple[np.ndarray, np.ndarray]:
        """The same without punctuation before and after; a word of punctuation alone is left out."""
        start, stop = self.words()
        start, stop = start.copy(), stop.copy()
        while len(start) and (left := _IS_MARK[self.buf[start]] & (start < stop)).any():
            start += left
        while len(start) and (right := _IS_MARK[self.buf[stop - 1]] & (start < stop)).any():
            stop -= right
        real = start < stop
        return start[real], stop[real]


def chunks(texts: list[bytes], size: int = CHUNK) -> list[tuple[int, int]]:
    """(first, past last) of slices of about `size` bytes; a longer text is a slice of its own."""
    out, first, total = [], 0, 0
    for i, t in enumerate(texts):
        if i > first and total + len(t) + 1 > size:
            out.append((first, i))
            first, total = i, 0
        total += len(t) + 1
    return [*out, (first, len(texts))] if len(texts) > first else out
