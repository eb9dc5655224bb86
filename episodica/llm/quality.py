"""Quality rules: counts of the base rules, and repetition from a suffix array over words.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. The suffix array of a text holds the positions whose next MIN_REPEAT words
occur again in the text; its longest-common-prefix intervals are the maximal repeated substrings. Their spans are united:
a text is rejected if too large a share of its words is covered, if one repeat is too long for its length, or if it has too
many symbols. All texts of a chunk are sorted together, by row first, with prefix doubling in NumPy. Overlapping repeats count.

Nulls, empty texts and texts without words have zero counts and fail the base rule of 50 words. A text without repeats
has share 0 and longest 0. Very long texts are measured whole. No rows give no rows. Other columns come along; a column of the
output's name is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import tokens
from .batches import struct, with_struct

MIN_WORDS = 50
#: Words of the shortest repeat that counts, and the limits on the share covered and on the longest repeat's share.
MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 8, 0.5, 0.4
#: Symbols to word characters.
MAX_SYMBOLS = 0.1
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_CONTINUED = (np.arange(256) & 0xC0) == 0x80
FIELDS = T.StructType([T.StructField(n, t) for n, t in (
    ("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()),
    ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("covered_words", T.LongType()),
    ("longest_repeat", T.LongType()), ("kept", T.BooleanType()))])


def repeated(keys: np.ndarray) -> np.ndarray:
    """Flags of the keys that occur twice or more."""
    order = np.argsort(keys)
    ordered = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    flags = np.zeros(len(keys), bool)
    flags[order] = same[1:] | same[:-1]
    return flags


def _ranks(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64) + 1


def longest_prefixes(places: np.ndarray, keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of the sequences of consecutive ``places`` by ``keys`` and its longest common prefixes.

    ``keys`` name (row, window) at each of the sorted ``places``; a sequence ends where the next place is missing. Returns
    indices into places, and for each the prefix shared with the entry before (0 for the first).
    """
    n = len(places)
    at = np.full(size + 1, n, np.int64)
    at[places] = np.arange(n)
    gap = np.ones(n, bool)
    gap[:-1] = np.diff(places) != 1
    ends = np.flatnonzero(gap)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n) + 1  # places up to the end of the sequence
    levels = [_ranks(keys)]
    width = 1
    while levels[-1].max() < n and width < left.max():
        rank = np.append(levels[-1], 0)
        following = at[np.minimum(places + width, size)]
        following[left <= width] = n
        levels.append(_ranks(levels[-1] * (n + 2) + rank[following]))
        width *= 2
    order = np.argsort(levels[-1], kind="stable")
    p, q = order[:-1], order[1:]
    shared = np.zeros(n - 1, np.int64)
    limit = np.minimum(left[p], left[q])
    for k in reversed(range(len(levels))):
        step = 1 << k
        open_ = np.flatnonzero(shared + 1 <= limit)
        a, b = p[open_] + shared[open_], q[open_] + shared[open_]
        shared[open_[levels[k][a] == levels[k][b]]] += step
    return order, np.concatenate([[0], np.minimum(shared, limit)])


def repetition(w: tokens.Words, hashes: np.ndarray, min_repeat: int) -> tuple[np.ndarray, np.ndarray]:
    """Words covered by repeats of at least ``min_repeat`` words, and the longest repeat, for each row."""
    rows = len(w.first) - 1
    starts = tokens.windows_in_rows(w.first, min_repeat)
    keys = tokens.mix(tokens.window_hashes(hashes, min_repeat)[starts] + w.row[starts].astype(np.uint64))
    again = repeated(keys)
    places, keys = starts[again], keys[again]
    longest = np.zeros(rows, np.int64)
    if not len(places):
        return np.zeros(rows, np.int64), longest
    order, shared = longest_prefixes(places, keys, len(hashes))
    reach = shared.copy()
    reach[:-1] = np.maximum(reach[:-1], shared[1:])
    found = reach > 0
    at, length = places[order[found]], reach[found] + min_repeat - 1
    np.maximum.at(longest, w.row[at], length)
    flags = tokens.covered(at, at + length, len(hashes))
    return tokens.per_row(flags, w.first), longest


def _duplicate_lines(chunk: tokens.Chunk, w: tokens.Words) -> np.ndarray:
    cuts = np.flatnonzero(chunk.data == 0x0A)
    starts = np.sort(np.concatenate([chunk.offsets[:-1], cuts + 1]))
    row = np.searchsorted(chunk.offsets, starts, "right") - 1
    ends = np.append(starts[1:], len(chunk.data))
    starts, ends, row = starts[ends > starts], ends[ends > starts], row[ends > starts]
    newline = chunk.data[ends - 1] == 0x0A
    worded = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends, row = starts[worded], (ends - newline)[worded], row[worded]
    codes, distinct = tokens.span_codes(chunk.data, starts, ends)
    pairs = np.unique(row * len(distinct) + codes)
    return np.bincount(row, minlength=chunk.rows) - np.bincount(pairs // max(len(distinct), 1), minlength=chunk.rows)


def _measure(chunk: tokens.Chunk, min_repeat: int, max_covered: float, max_longest: float) -> list[np.ndarray]:
    data = chunk.data
    w = tokens.words(chunk, data, tokens.SPACE_WORDS)
    n_words = w.counts
    hashes = tokens.word_hashes(data, w)
    word_chars = tokens.per_row(tokens.SPACE_WORDS[data] & ~_CONTINUED[data], chunk.offsets)
    n_symbols = tokens.per_row(_SYMBOLS[data], chunk.offsets)
    starts = tokens.windows_in_rows(w.first, 3)
    three = starts[repeated(tokens.mix(tokens.window_hashes(hashes, 3)[starts] + w.row[starts].astype(np.uint64)))]
    n_repeat = tokens.per_row(tokens.covered(three, three + 3, len(hashes)), w.first)
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > 50 * n_words)
    covered_words, longest = repetition(w, hashes, min_repeat)
    kept = ~failed & (n_symbols <= MAX_SYMBOLS * word_chars) & (covered_words <= max_covered * n_words) & (longest <= max_longest * n_words)
    return [n_words, word_chars, n_symbols, _duplicate_lines(chunk, w), n_repeat, failed, covered_words, longest, kept]


def quality_rules(docs: DataFrame, text: str = "text", output: str = "quality", min_repeat: int = MIN_REPEAT,
                  max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST) -> DataFrame:
    """``docs`` with a struct of counts and the verdict ``kept``."""
    def scan(column: pa.Array) -> pa.StructArray:
        parts = [_measure(c, min_repeat, max_covered, max_longest) for c in tokens.chunks(column)]
        columns = [np.concatenate(x) for x in zip(*parts)] if parts else [[] for _ in FIELDS]
        kinds = [pa.bool_() if isinstance(f.dataType, T.BooleanType) else pa.int64() for f in FIELDS]
        return struct(FIELDS, [pa.array(c, k) for c, k in zip(columns, kinds)])

    return with_struct(docs, text, output, FIELDS, scan)
