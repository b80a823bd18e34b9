"""Words and windows of whole texts as numpy arrays, a few MB of text at a time.

A word is a run of bytes outside 0x20 and 0x09-0x0D of the UTF-8 text, which is the same as
a run of `[^\\x20\\x09-\\x0D]` characters.  Words and windows are named by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text whose arrays are held at once.
CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_STEP = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _letters(lower: bool) -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    if lower:
        codes[65:91] += np.uint64(32)
    return mix(codes + np.uint64(_STEP))


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Words(NamedTuple):
    """Words of some texts, in order: hash, number of its text, first and end byte in `data`."""

    hashes: np.ndarray
    owner: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray  # words of each text


class Hasher:
    """Hashes byte ranges of a buffer through running sums, so that any range costs the same."""

    def __init__(self, lower: bool):
        self.letters = _letters(lower)
        self.size = 0

    def _grow(self, size: int) -> None:
        if size > self.size:
            self.size = max(size, CHUNK_BYTES)
            self.up = _powers(_BASE, self.size)
            self.down = _powers(pow(_BASE, -1, 1 << 64), self.size)

    def _values(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.letters[data] * self.up[: len(data)], dtype=np.uint64, out=sums[1:])
        return (sums[ends] - sums[starts]) * self.down[starts]

    def _long_value(self, data: np.ndarray, limit: int) -> int:
        value = 0
        for at in range(0, len(data), limit):
            part = data[at: at + limit]
            own = self._values(part, np.array([0]), np.array([len(part)]))[0]
            value += int(own) * pow(_BASE, at, 1 << 64)
        return value & ((1 << 64) - 1)

    def ranges(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int = 4 * CHUNK_BYTES) -> np.ndarray:
        """Hashes of data[starts[i]:ends[i]], both ascending; at most `limit` bytes are unfolded at once."""
        values = np.zeros(len(starts), dtype=np.uint64)
        first = 0
        while first < len(starts):
            begin = int(starts[first])
            end = int(np.searchsorted(ends, begin + limit, side="right"))
            if end > first:
                part = data[begin: int(ends[end - 1])]
                values[first:end] = self._values(part, starts[first:end] - begin, ends[first:end] - begin)
            else:
                end = first + 1
                values[first] = self._long_value(data[begin: int(ends[first])], limit)
            first = end
        return mix(values + (ends - starts).astype(np.uint64) * np.uint64(_STEP))


def is_word_byte(data: np.ndarray) -> np.ndarray:
    return (data != 0x20) & ((data < 0x09) | (data > 0x0D))


def find_words(data: np.ndarray, offsets: np.ndarray,
               inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """starts, ends, owner and counts of the words of texts data[offsets[i]:offsets[i + 1]].

    `inside` marks the bytes of words, if they are others than those of `is_word_byte`.
    """
    inside = is_word_byte(data) if inside is None else inside
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside
    after = before[1:].copy()
    after[:-1] = inside[1:]
    if len(after):
        after[-1] = False
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    ends = np.flatnonzero(inside & ~after) + 1
    bounds = np.searchsorted(starts, offsets)
    counts = np.diff(bounds)
    return starts, ends, np.repeat(np.arange(len(counts)), counts), counts


def words_of(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> Words:
    starts, ends, owner, counts = find_words(data, offsets)
    return Words(hasher.ranges(data, starts, ends), owner, starts, ends, counts)


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every run of `size` words inside one text."""
    n = len(words.hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    value = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        value = value * np.uint64(_BASE) + words.hashes[j: j + n]
    first = np.flatnonzero(words.owner[:n] == words.owner[size - 1:])
    return mix(value[first]), first


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices of a string column of about `limit` bytes.

    A null text counts as empty.  A text longer than `limit` is a slice of its own.
    """
    if not len(column):
        return
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offset_buffer, data_buffer = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offset_buffer, dtype=kind)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(max(end, first + 1), len(column))
        yield first, end, data[offsets[first]: offsets[end]], offsets[first: end + 1] - offsets[first]
        first = end
