"""Anchors of windows: where equal windows of any two texts must meet.

A window of ``size`` units (words or bytes) is named by its anchor, the smallest hash among its grams, leftmost in a tie.
Equal windows have equal anchors at equal offsets, so grouping by the anchor's hash brings them together, and consecutive
windows with one anchor travel as one run.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_LOW = np.uint64(0xFFFFFFFF)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    n = len(values)
    if n < width:
        return values[:0]
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    padded = padded.reshape(blocks, width)
    prefix = np.minimum.accumulate(padded, axis=1).ravel()
    suffix = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[:n - width + 1], prefix[width - 1:n])


@dataclass
class Runs:
    """Runs of windows with one anchor: first and last window starts, and the anchor's place."""
    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray


def runs(grams: np.ndarray, starts: np.ndarray, width: int) -> Runs:
    """Runs of the windows that begin at the sorted ``starts`` and hold ``width`` grams each."""
    if not len(starts):
        return Runs(starts, starts, starts)
    ranked = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_minimum(ranked, width)[starts] & _LOW).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(starts) != 1)
    begin = np.flatnonzero(new)
    return Runs(starts[begin], starts[np.append(begin[1:], len(starts)) - 1], anchor[begin])


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of the given sizes: the group of each entry, and its number within the group."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)
