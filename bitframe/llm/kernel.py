"""Vectorised text kernel: words, word hashes and shingles of whole Arrow string columns.

All functions work on the UTF-8 bytes of a block of texts at once. Blocks hold about half a million bytes, or one longer text,
so that memory stays bounded however large an Arrow batch is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 500_000
_SEEDS = np.random.Generator(np.random.PCG64(20240613))
_BYTE = _SEEDS.integers(1, 2**64, 256, dtype=np.uint64)
_STEP = _SEEDS.integers(0, 2**64, 8, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    """The first ``n`` powers of an odd 64-bit number, kept and grown by doubling."""
    global _POWERS
    while len(_POWERS) < n:
        _POWERS = np.concatenate([_POWERS, _POWERS * (_POWERS[-1:] * np.uint64(0x9E3779B97F4A7C15))])
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def text_blocks(column: pa.Array, block: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows; a null counts as an empty text."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + block, "right")) - 1)
        yield row, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words (runs of bytes that aren't ``space``), and each text's first word number."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~space[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    both = cut[inside[cut] & inside[cut - 1]]  # a text ends and the next one begins inside a run
    starts[both] = True
    ends[both - 1] = True
    s = np.flatnonzero(starts)
    return s, np.flatnonzero(ends) + 1, np.searchsorted(s, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = ends - starts
    base = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(base, length)
    value = _BYTE[data[place + np.repeat(starts, length)]] * _powers(int(length.max()))[place]
    return mix(np.add.reduceat(value, base) + length.astype(np.uint64))


def windows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words within one text, and each text's first window number."""
    words = np.diff(first)
    counts = np.maximum(words - size + 1, 0)
    out_first = np.concatenate([[0], np.cumsum(counts)])
    if not out_first[-1]:
        return np.zeros(0, np.uint64), out_first
    at = np.arange(out_first[-1]) + np.repeat(first[:-1] - out_first[:-1], counts)
    return mix(sum(hashes[at + j] * _STEP[j] for j in range(size))), out_first


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Each text's set of distinct word shingles as sorted 64-bit hashes, A-Z lower-cased.

    A text of fewer than ``size`` words has its whole sequence as one shingle; one without words has none.
    """
    data = _LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    hashes = word_hashes(data, starts, ends)
    grams, at = windows(hashes, first, size)
    out = []
    for i in range(len(offsets) - 1):
        if at[i + 1] > at[i]:
            out.append(np.unique(grams[at[i] : at[i + 1]]))
        elif n := first[i + 1] - first[i]:
            own = hashes[first[i] : first[i + 1]] * _STEP[:n]
            out.append(mix(np.array([own.sum() + np.uint64(n)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
