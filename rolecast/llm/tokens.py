"""Words of many texts at once as NumPy arrays, straight from the UTF-8 bytes of an Arrow column.

Spark splits the table over tasks; inside a task these functions replace per-word Python objects.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


_BASE_INV = np.uint64(_inverse(int(_BASE)))


def space_words() -> np.ndarray:
    """Byte table for words [^\\x20\\x09-\\x0D]+; the case stays."""
    t = np.arange(256, dtype=np.uint16) + 1
    t[[0x20, *range(0x09, 0x0E)]] = 0
    return t


def letter_words() -> np.ndarray:
    """Byte table for words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z."""
    t = np.arange(256, dtype=np.uint16) + 1
    t[0x41:0x5B] += 0x20
    keep = np.zeros(256, bool)
    keep[0x30:0x3A] = keep[0x41:0x5B] = keep[0x61:0x7B] = keep[0x80:] = True
    t[~keep] = 0
    return t


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of the base and of its inverse, grown as longer inputs come."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            up, down = np.full(n, _BASE), np.full(n, _BASE_INV)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up, self.down


_POWERS = _Powers()


@dataclass
class Words:
    """start and end: byte places in data; doc: row of each word; first: first word of each row, and the end."""

    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    mapped: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's mapped bytes, equal in every task."""
        n = len(self.data)
        up, down = _POWERS.get(n + 1)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(self.mapped.astype(np.uint64) * up[:n], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows one after another, and where each row starts; null is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    _, offsets, values = texts.buffers()
    at = np.frombuffer(offsets, np.int64, count=len(texts) + 1 + texts.offset)[texts.offset :]
    if values is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(values, np.uint8, count=int(at[-1]))[at[0] :], at - at[0]


def words(texts: pa.Array, kind: np.ndarray) -> Words:
    data, bounds = text_bytes(texts)
    mapped = kind[data]
    inside = mapped > 0
    begins, ends = inside.copy(), inside.copy()
    if len(data):
        inner = bounds[(bounds > 0) & (bounds < len(data))]
        same = np.ones(len(data), bool)  # the byte before belongs to the same row
        same[0] = False
        same[inner] = False
        begins[1:] &= ~(inside[:-1] & same[1:])
        ends[:-1] &= ~(inside[1:] & same[1:])
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, bounds)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    return Words(data, bounds, start, end, doc, first, mapped)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of h[i:i+k] for every i up to len(h) - k; the caller discards those that cross rows."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= _STEP
        out += h[j : j + n]
    return mix(out)


def whole(first: np.ndarray, n: int, k: int) -> np.ndarray:
    """Which of the n gram starts hold k words of one row."""
    ok = np.zeros(n, bool)
    lengths = np.diff(first)
    left = np.repeat(first[1:], lengths)[:n] - np.arange(n)
    ok[: len(left)] = left >= k
    return ok
