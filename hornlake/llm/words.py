"""Words and word n-grams of whole Arrow batches, found and hashed on the UTF-8 bytes with numpy.

Both word definitions that the operators use separate at ASCII bytes only, so a word found on the bytes is the
word found on the characters.  A word's hash is a polynomial over random byte values, read from prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut into words at once where memory is short: numpy takes some hundred bytes for each.
SLICE = 1 << 18

_WHITE = [0x20, *range(0x09, 0x0E)]
#: separators[byte]: runs of anything but white space; runs of letters, digits and bytes from 0x80 on.
SPACED = np.isin(np.arange(256), _WHITE)
ALNUM = ~((np.arange(256) >= 0x80) | np.isin(np.arange(256), [*b"0123456789abcdefghijklmnopqrstuvwxyz"]))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_VALUE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_BASES = {"byte": 0x9E3779B97F4A7C15, "word": 0xD6E8FEB86659FD93}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values under which close values part."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(8)
def _powers(base: str, log2: int) -> tuple[np.ndarray, np.ndarray]:
    p = _BASES[base]
    inverse = pow(p, -1, 2**64)
    out = []
    for x in (p, inverse):
        a = np.full(2**log2, x, dtype=np.uint64)
        a[0] = 1
        out.append(np.cumprod(a))
    return out[0], out[1]


def powers(base: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(base, max(16, int(n).bit_length()))


def spans_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: str) -> np.ndarray:
    """A hash of values[start:end] for each pair, independent of where the span lies."""
    up, down = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start])


class Words:
    """The words of consecutive texts: `start`, `end` (bytes), `hash`, and `first[i]:first[i + 1]` for text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, lower: bool):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        inside = ~separators[self.data]
        if len(inside):
            edge = np.zeros(len(inside) + 1, dtype=bool)  # a text begins here
            edge[offsets] = True
            joined = inside[1:] & inside[:-1] & ~edge[1:-1]
            starts, ends = inside.copy(), inside.copy()
            starts[1:] &= ~joined
            ends[:-1] &= ~joined
            self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        else:
            self.start = self.end = np.zeros(0, dtype=np.int64)
        self.first = np.searchsorted(self.start, offsets)
        self.hash = spans_hash(_VALUE[self.data], self.start, self.end, "byte") if len(inside) else np.zeros(0, np.uint64)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words, and which begin a run that stays in its text."""
        total = len(self.hash)
        if total < n:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        at = np.arange(total - n + 1)
        last = np.repeat(self.first[1:], self.counts)[: len(at)]
        return spans_hash(self.hash, at, at + n, "word"), at + n <= last

    def whole(self) -> np.ndarray:
        """A hash of each text's whole word sequence."""
        if not len(self.hash):
            return np.zeros(len(self.first) - 1, np.uint64)
        return spans_hash(self.hash, self.first[:-1], self.first[1:], "word")


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its texts; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice holds `limit` bytes of text, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_arrays(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def words_of(batch: pa.RecordBatch, column: str, separators: np.ndarray, lower: bool) -> Words:
    return Words(*text_arrays(batch.column(batch.schema.get_field_index(column))), separators, lower)
