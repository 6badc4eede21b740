"""Words and hashes of whole Arrow text batches, computed on their UTF-8 bytes with NumPy.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which for UTF-8 text is the
pattern ``[^\\x20\\x09-\\x0D]+``. Hashes are 64-bit sums modulo 2**64 (NumPy wraps around).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: texts are processed in groups of about this many bytes (a longer text forms its own group)
GROUP_BYTES = 2 << 20

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mixer (public-domain splitmix64 constants) on uint64 arrays."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def coefficients(n: int, seed: int) -> np.ndarray:
    """``n`` odd pseudo-random 64-bit multipliers."""
    with np.errstate(over="ignore"):
        steps = (np.arange(n, dtype=U) + U(seed)) * U(0x9E3779B97F4A7C15)
    return mix64(steps) | U(1)


@dataclass
class TextGroup:
    """Some rows of a batch: ``rows`` indexes the batch; ``data`` holds their bytes end to end."""

    rows: np.ndarray
    data: np.ndarray
    offsets: np.ndarray  # len(rows) + 1 byte offsets into data

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()


def groups(column: pa.Array, group_bytes: int = GROUP_BYTES) -> Iterator[TextGroup]:
    """Cut a string column into row groups of bounded bytes; null texts count as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + group_bytes, side="right")) - 1)
        hi = min(hi, n)
        part = offsets[lo:hi + 1]
        yield TextGroup(np.arange(lo, hi), data[part[0]:part[-1]], part - part[0])
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of all words, and per text the range of its words (len + 1 bounds)."""
    inside = ~IS_SPACE[data]
    start, end = inside.copy(), inside.copy()
    if len(data):
        start[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
        start[firsts] = inside[firsts]
        end[firsts[firsts > 0] - 1] = inside[firsts[firsts > 0] - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hash of every word: a multilinear sum over its bytes, then mixed with the length."""
    if not len(starts):
        return np.zeros(0, U)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    within = np.arange(int(lens.sum())) - np.repeat(first, lens)
    letters = data[~IS_SPACE[data]].astype(U)
    letters += U(1)
    letters *= coefficients(int(lens.max()), seed * 1_000_003)[within]
    return mix64(np.add.reduceat(letters, first) + lens.astype(U) * U(0xD6E8FEB86659FD93))


class WordPowers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, U(b))
                steps[0] = U(1)
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


class SpanHashes:
    """Prefix sums over word hashes; ``windows(k)`` hashes every run of ``k`` words at once."""

    def __init__(self, hashes: np.ndarray, powers: WordPowers):
        up, self.down = powers.get(len(hashes) + 1)
        self.prefix = np.zeros(len(hashes) + 1, U)
        np.cumsum(hashes * up[:len(hashes)], out=self.prefix[1:])

    def windows(self, k: int) -> np.ndarray:
        n = len(self.prefix) - k
        if n <= 0:
            return np.zeros(0, U)
        return mix64((self.prefix[k:] - self.prefix[:-k]) * self.down[:n])


def as_int64(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
