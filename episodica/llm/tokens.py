"""Vectorised words and window hashes over whole Arrow text columns.

Everything works on chunks of whole rows: the UTF-8 bytes of a chunk are one NumPy array, words are runs of word bytes
that end at row borders. A distinct word of a chunk is hashed once, with XXH3, and longer windows are hashed from the hashes
of their halves by a scrambler that is not linear. Hashes are 64 bits wide.
Nulls count as empty texts. A chunk holds about CHUNK_BYTES, or one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

#: Bytes of text that one vectorised step takes; a single longer text is taken whole.
CHUNK_BYTES = 1_500_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _space_words() -> np.ndarray:
    flags = np.ones(256, bool)
    flags[[0x20, *range(0x09, 0x0E)]] = False
    return flags


def _alnum_words() -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[0x30:0x3A] = flags[0x61:0x7B] = flags[0x80:] = True
    return flags


#: Words [^\x20\x09-\x0D]+ and, on lower-cased bytes, [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
SPACE_WORDS, ALNUM_WORDS = _space_words(), _alnum_words()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Chunk:
    """Rows first_row.. of a batch: their bytes, and where each row starts (one more entry than rows)."""
    first_row: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The column's UTF-8 bytes in chunks of whole rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(starts, starts[row] + limit, "right")) - 1
        end = min(n, max(row + 1, end))
        yield Chunk(row, raw[starts[row]:starts[end]], starts[row:end + 1] - starts[row])
        row = end


@dataclass
class Words:
    """Words of a chunk: byte spans, the row of each, and the first word of each row (one more entry than rows)."""
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def row_starts(chunk: Chunk) -> np.ndarray:
    """Flags of the bytes at which a row starts; one entry more than bytes."""
    flags = np.zeros(len(chunk.data) + 1, bool)
    flags[chunk.offsets] = True
    return flags


def words(chunk: Chunk, data: np.ndarray, is_word: np.ndarray) -> Words:
    """Runs of word bytes in ``data``, the chunk's bytes or a same-sized version of them."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = is_word[data]
    border = row_starts(chunk)
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | border[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | border[1:])) + 1
    first = np.searchsorted(starts, chunk.offsets)
    return Words(starts, ends, np.repeat(np.arange(chunk.rows), np.diff(first)), first)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashed parts, in this order. It is no polynomial, so no text collides for every choice of constants."""
    return mix((a * _STEP) ^ b)


def span_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Dictionary index of each byte span, and the distinct spans; spans are ascending and apart, and compared in full."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    packed = np.ascontiguousarray(data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)])
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    spans = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    coded = spans.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def value_hashes(values: pa.Array) -> np.ndarray:
    """A 64-bit XXH3 hash of each binary value."""
    return np.fromiter(map(xxh3_64_intdigest, values.to_numpy(zero_copy_only=False)), np.uint64, len(values))


def word_hashes(data: np.ndarray, w: Words) -> np.ndarray:
    """A 64-bit XXH3 hash of each word, computed once for each distinct one."""
    codes, distinct = span_codes(data, w.starts, w.ends)
    return value_hashes(distinct)[codes]


def _windows(levels: list[np.ndarray], unit: int, size: int, starts: np.ndarray | None) -> np.ndarray:
    """Hash of ``size`` consecutive entries from each start (or from every place); level k covers unit * 2**k entries."""
    n = len(levels[0]) + unit - size
    out, at = None, 0
    for k in reversed(range(len(levels))):
        if size // unit >> k & 1:
            piece = levels[k][at:at + n] if starts is None else levels[k][starts + at]
            out = piece if out is None else joined(out, piece)
            at += unit << k
    return out


def _levels(first: np.ndarray, unit: int, size: int) -> list[np.ndarray]:
    levels, width = [first], unit
    while 2 * width <= size:
        levels.append(joined(levels[-1][:-width], levels[-1][width:]))
        width *= 2
    return levels


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size`` consecutive entries; entry i covers i..i+size-1, across rows too."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    return mix(_windows(_levels(mix(hashes), 1, size), 1, size, None) + np.uint64(size))


class ByteWindows:
    """Hashes of windows of whole eights of bytes; the longest is given. Level 0 is the eight bytes themselves, scrambled."""

    def __init__(self, data: np.ndarray, longest: int):
        self.n = len(data)
        eight = np.zeros(max(self.n - 7, 0), np.uint64)
        for k in range(min(8, len(eight))):
            some = (len(eight) - k + 7) // 8
            eight[k::8] = data[k:k + 8 * some].view(np.uint64)
        self.levels = _levels(mix(eight), 8, min(longest, self.n))

    def everywhere(self, size: int) -> np.ndarray:
        return _windows(self.levels, 8, size, None) if self.n >= size else np.zeros(0, np.uint64)

    def at(self, starts: np.ndarray, size: int) -> np.ndarray:
        return _windows(self.levels, 8, size, starts) if len(starts) else np.zeros(0, np.uint64)


def windows_in_rows(first: np.ndarray, size: int) -> np.ndarray:
    """Starts of the windows of ``size`` entries that stay within one row."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    total = int(counts.sum())
    offset = np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts)
    return np.arange(total) + offset


def covered(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Flags of the positions 0..size-1 that lie in any span."""
    depth = np.zeros(size + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    return np.cumsum(depth[:-1]) > 0


def per_row(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many flags are set in each row."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]
