"""Word kernels over Arrow string buffers: numpy only, no Python loop over words.

A word is a run of bytes other than space and \\t\\n\\v\\f\\r. UTF-8 continuation
bytes are never separators, so splitting bytes and splitting code points agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATORS = r" \t\n\x0B\f\r"
WORD = r"[^ \t\n\x0B\f\r]+"

_SEP = np.zeros(256, bool)
_SEP[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CHUNK = np.uint64(0x9E3779B97F4A7C15)
_LENGTH = np.uint64(0xD1342543DE82EF95)
_LATER = np.uint64(0xA0761D6478BD642F)
_BLOCK_BYTES = 1 << 19
#: Masks of the first 0 to 8 bytes of a little-endian word.
_FIRST = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    n = len(column)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offs


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes. Its pieces of eight bytes are mixed one by one, each with its place in the span."""
    if not len(start):
        return np.zeros(0, np.uint64)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))  # the eight bytes from each position on
    length = end - start
    h = mix((eight[start] & _FIRST[np.minimum(length, 8)]) ^ (length.astype(np.uint64) * _LENGTH + np.uint64(seed)))
    long = np.flatnonzero(length > 8)
    if len(long):
        more = (length[long] - 1) // 8
        nth = spread(np.ones(len(long), np.int64), more)
        at = np.repeat(start[long], more) + 8 * nth
        left = np.minimum(np.repeat(end[long], more) - at, 8)
        piece = mix((eight[at] & _FIRST[left]) ^ mix(nth.astype(np.uint64) * _CHUNK + np.uint64(seed)))
        h[long] = mix(h[long] + np.add.reduceat(piece, np.cumsum(more) - more))
    return h


class Block:
    """The words of some consecutive rows: word i of the block has bytes start[i] to end[i]; row r holds words ptr[r] to ptr[r + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int, lower: bool = False):
        self.first = first
        self.rows = len(offsets) - 1
        base = int(offsets[0])
        raw = data[base : int(offsets[-1])]
        self.bytes = _LOWER[raw] if lower else raw
        self.offsets = offsets - base
        n = len(raw)
        word = ~_SEP[raw]
        first_of = np.empty(n + 1, bool)
        first_of[0] = True
        np.logical_not(word, out=first_of[1:])
        first_of[self.offsets] = True
        self.start = np.flatnonzero(word & first_of[:-1])
        last_of = np.empty(n + 1, bool)
        np.logical_not(word, out=last_of[:-1])
        last_of[n] = True
        last_of[self.offsets] = True
        self.end = np.flatnonzero(word & last_of[1:]) + 1
        self.ptr = np.searchsorted(self.start, self.offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes; another seed gives a second, independent one."""
        return span_hashes(self.bytes, self.start, self.end, seed)


def blocks(column: pa.Array, lower: bool = False, limit: int = _BLOCK_BYTES) -> Iterator[Block]:
    """Consecutive rows in blocks of about ``limit`` bytes; a longer row is a block of its own, never cut."""
    data, offsets = buffers(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield Block(data, offsets[at : to + 1], at, lower)
        at = to


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two neighbouring runs."""
    return mix(a * _CHUNK + (b ^ (b >> np.uint64(29))) * _LATER)


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words; run i starts at word i. The caller drops runs that cross rows.

    Runs of 1, 2, 4, ... words are joined in pairs, and k is put together from these: every join mixes, so no
    pattern of words cancels out as it does in a polynomial modulo 2**64.
    """
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    power, size, out, have = words, 1, None, 0
    while True:
        if k & size:
            out = power[: n - size + 1] if out is None else joined(out[: n - have - size + 1], power[have : n - size + 1])
            have += size
        if have == k:
            return mix(out ^ np.uint64(k))
        power = joined(power[: n - 2 * size + 1], power[size : n - size + 1])
        size *= 2


def starts_within(ptr: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions whose run of k words stays in its row, and the n + 1 offsets by row of that list."""
    counts = np.maximum(np.diff(ptr) - (k - 1), 0)
    to = np.concatenate(([0], np.cumsum(counts)))
    return np.repeat(ptr[:-1] - to[:-1], counts) + np.arange(to[-1]), to


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each run, one after the other."""
    to = np.cumsum(counts)
    total = int(to[-1]) if len(to) else 0
    return np.repeat(starts - (to - counts), counts) + np.arange(total)
