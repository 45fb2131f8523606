"""Words and word shingles of whole Arrow text columns, in numpy.

A text is cut into words at separator bytes after A-Z became a-z; words and shingles are
known by 64-bit hashes that are the same in every process. Nulls are empty texts. A column is
taken in slices of at most ``LARGE`` bytes, or ``SMALL`` where each byte needs many times its size
in temporary arrays, so memory follows the slice (or one longer text).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: Everything in ASCII but letters and digits.
NOT_ALNUM = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: Bytes of a slice.
SMALL, LARGE = 1 << 18, 1 << 21

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        made = []
        for b in (_BASE, _INVERSE):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps))
        if n > LARGE + 1:  # of one very long text: not kept
            return made[0], made[1]
        _powers = made[0], made[1]
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ends(texts: pa.LargeStringArray) -> np.ndarray:
    """Where each text starts in the buffer, and where the last one ends."""
    return np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]


def cuts(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows of at most ``most`` bytes, or of one longer row."""
    at = 0
    while at < len(ends) - 1:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield at, to
        at = to


def slices(texts: pa.Array, most: int = LARGE) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive slices of at most ``most`` bytes, or of one longer text, without nulls."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    for at, to in cuts(ends(texts), most):
        yield at, texts.slice(at, to - at).fill_null("")


def body(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a slice, and where each text starts (and the last one ends)."""
    offsets = ends(texts)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the runs of true bytes, which end with their text."""
    breaks = offsets[:-1][offsets[:-1] < len(inside)]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first[breaks] = inside[breaks]
    breaks = breaks[breaks > 0] - 1
    last[breaks] = inside[breaks]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    power, inverse = _upto(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start])


class Words(NamedTuple):
    """Words in text order. ``start`` and ``end`` are bytes from the start of the slice."""

    hash: np.ndarray
    unit: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    offsets: np.ndarray
    unit_start: np.ndarray
    unit_row: np.ndarray


def words(texts: pa.LargeStringArray, separators: bytes = SPACES, lines: bool = False) -> Words:
    """The words of a slice. A unit is a text or, with ``lines``, a line of one."""
    data, offsets = body(texts)
    data = _LOWER[data]
    unit_start, unit_row = offsets[:-1], np.arange(len(texts))
    if lines:
        after = np.flatnonzero(data == 10) + 1
        row = np.searchsorted(unit_start, after - 1, "right") - 1
        unit_start, unit_row = np.concatenate([unit_start, after]), np.concatenate([unit_row, row])
        order = np.lexsort((unit_start, unit_row))
        unit_start, unit_row = unit_start[order], unit_row[order]
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    start, end = runs(inside[data], offsets)
    hashes = span_hashes(data, start, end)
    # units are fewer than words, so they are looked up; of units that start together the last has the words
    held = np.diff(np.searchsorted(start, unit_start), append=len(start))
    unit = np.repeat(np.arange(len(unit_start)), held)
    return Words(hashes, unit, start, end, data, offsets, unit_start, unit_row)


def _sequence(parts: list[np.ndarray]) -> np.ndarray:
    out = np.full(len(parts[0]), len(parts), np.uint64)
    for part in parts:
        out = mix(out * np.uint64(_BASE) + part)
    return out


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and unit of every run of ``k`` words in a unit; a unit of fewer words, but not
    none, has the whole as its one run. Not distinct and in no order."""
    n, units = len(w.hash), len(w.unit_start)
    hashes, where = [], []
    if n >= k:
        whole = w.unit[: n - k + 1] == w.unit[k - 1 :]
        at = np.flatnonzero(whole)
        hashes.append(_sequence([w.hash[at + j] for j in range(k)]))
        where.append(w.unit[at])
    count = np.bincount(w.unit, minlength=units)
    first = np.cumsum(count) - count
    for c in range(1, k):
        short = np.flatnonzero(count == c)
        if len(short):
            hashes.append(_sequence([w.hash[first[short] + j] for j in range(c)]))
            where.append(short)
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(where)
