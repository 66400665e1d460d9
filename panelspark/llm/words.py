"""Words of whole texts as 64-bit identities, for batches of rows at once."""

from __future__ import annotations

import numpy as np

from panelspark.llm.common import mixed

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _byte_codes() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _is_word_byte() -> np.ndarray:
    table = np.ones(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word; rows never share a word."""
    inside = _is_word_byte()[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    after[edges - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of every span, the spans ascending and apart."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    powers = np.multiply.accumulate(np.full(int(lengths.max()) + 1, _BASE, np.uint64))
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    within = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    values = _byte_codes()[data[within + np.repeat(starts, lengths)]] * powers[within]
    return mixed(np.add.reduceat(values, first) + lengths.astype(np.uint64))


def sequence_hashes(words: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within a row, and the rows they are in."""
    if len(words) < size:
        return np.zeros(0, np.uint64), np.zeros(0, rows.dtype)
    count = len(words) - size + 1
    total = np.zeros(count, np.uint64)
    for k in range(size):
        total += mixed(words[k : k + count] + np.uint64((k + 1) * 0xA0761D6478BD642F & (2**64 - 1)))
    same = rows[:count] == rows[size - 1 :]
    return mixed(total + np.uint64(size))[same], rows[:count][same]


def shingle_sets(
    data: np.ndarray, offsets: np.ndarray, size: int
) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every row as (hashes, rows), ascending by row and hash.

    A row with fewer than ``size`` words has its whole sequence as one shingle,
    a row without words has none.
    """
    data = lowered(data)
    starts, ends = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    rows = np.searchsorted(offsets, starts, side="right") - 1
    hashes, owners = sequence_hashes(words, rows, size)
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    for few in range(1, size):
        short = counts[rows] == few
        if short.any():
            more, whose = sequence_hashes(words[short], rows[short], few)
            hashes, owners = np.concatenate([hashes, more]), np.concatenate([owners, whose])
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    return hashes[first], owners[first]
