"""Words, their hashes and their shingles for whole columns of texts at once.

A word is a run of bytes other than space and 0x09 to 0x0D. Hashes have 64 bits; equal words have
equal hashes, and the operators that compare hashes take different words as equal only when all
64 bits agree.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache, wraps
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes that are hashed at a time; the tables of powers have this length.
PIECE = 1 << 17
# Bytes of text whose words are held at a time, unless a single text is longer.
CHUNK = 1 << 22

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
# Everything in ASCII that is not a letter or a digit separates terms.
NOT_ALNUM = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_ODD = (0xD1342543DE82EF95, 0x2545F4914F6CDD1D, 0xAF251AF3B0F025B5, 0xB564EF22EC7AECE5, 0xF7C2EBC08F67F2B5)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one to one."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    letters = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    inverse = pow(_BASE, -1, 1 << 64)
    powers = [np.full(PIECE, base, np.uint64) for base in (_BASE, inverse)]
    for table in powers:
        table[0] = 1
        np.multiply.accumulate(table, out=table)
    return letters, powers[0], powers[1]


def _hash_piece(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    letters, powers, inverse = _tables()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(letters[data] * powers[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def _hash_long(data: np.ndarray) -> np.uint64:
    """One word longer than a piece: the hashes of its pieces, hashed again."""
    total = np.uint64(0)
    for first in range(0, len(data), PIECE):
        part = data[first : first + PIECE]
        one = _hash_piece(part, np.array([0]), np.array([len(part)]))
        total = mixed(one + np.atleast_1d(total) * np.uint64(_ODD[0]))[0]
    return total


class Words(NamedTuple):
    """Words of several texts: their byte ranges, hashes, and the first word of each text."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    firsts: np.ndarray


# Scripts without spaces between words: each of their characters is a word where that is asked for.
UNSPACED = ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x1AAF), (0x3005, 0x3007), (0x3021, 0x312F), (0x31A0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA000, 0xA4CF), (0xA9E0, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))
# Spaces and punctuation of these scripts.
MARKS = ((0x3000, 0x3004), (0x3008, 0x3020), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))


def _wide(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and code points of all characters of three and four bytes."""
    starts = np.flatnonzero(data >= 0xE0)
    four = data[starts] >= 0xF0
    code = np.zeros(len(starts), np.int64)
    for k in range(4):
        at = data[np.minimum(starts + k, len(data) - 1)].astype(np.int64)
        code = np.where((k < 3) | four, code << 6 | (at & (np.where(four, 7, 15) if k == 0 else 63)), code)
    return starts, np.where(four, 4, 3), code


def _within(code: np.ndarray, ranges: tuple[tuple[int, int], ...]) -> np.ndarray:
    return np.logical_or.reduce([(code >= a) & (code <= b) for a, b in ranges])


def find_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, white: np.ndarray = WHITE, unspaced: bool = False, alone: np.ndarray | None = None) -> Words:
    """Words of the texts data[offsets[i]:offsets[i + 1]]; words never cross texts.

    `lower` brings A to Z to lower case; `white` names the bytes that separate words; `alone` those
    that are a word each. With `unspaced` so is each character of a script without spaces, and the
    punctuation of these scripts separates words.
    """
    data = data[offsets[0] : offsets[-1]]
    offsets = (offsets - offsets[0]).astype(np.int64)
    if lower:
        data = _LOWER[data]
    inside = ~white[data]
    breaks = np.zeros(len(data) + 1, bool)
    breaks[offsets] = True
    if unspaced:
        at, size, code = _wide(data)
        own = _within(code, UNSPACED)
        breaks[at[own]] = breaks[(at + size)[own]] = True
        marks = at[_within(code, MARKS)]
        inside[marks] = inside[marks + 1] = inside[marks + 2] = False
    if alone is not None:
        own = np.flatnonzero(alone[data])
        breaks[own] = breaks[own + 1] = True
    gap = ~inside
    first = inside.copy()
    first[1:] &= gap[:-1] | breaks[1:-1]
    last = inside.copy()
    last[:-1] &= gap[1:] | breaks[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        upto = int(np.searchsorted(ends, base + PIECE, "right"))
        if upto <= at:
            hashes[at] = _hash_long(data[base : ends[at]])
            at += 1
            continue
        piece = data[base : ends[upto - 1]]
        hashes[at:upto] = _hash_piece(piece, starts[at:upto] - base, ends[at:upto] - base)
        at = upto
    return Words(starts, ends, hashes, np.searchsorted(starts, offsets))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of strings; a null is an empty text."""
    column = pc.fill_null(column, "")
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), bounds


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most `most` bytes together, or of one text."""
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = max(last, first + 1)
        yield first, last
        first = last


Batches = Iterator[pa.RecordBatch]


def releasing(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A function for mapInArrow that gives freed memory back to the system when its task ends.

    Workers wait for tasks of later stages; what they keep of the largest batch they have seen adds
    up beside the heap of their executor.
    """

    @wraps(run)
    def runs(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return runs


def expand(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges starts[i]:starts[i] + counts[i]: the i of every element, and the element."""
    owner = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    within = np.arange(len(owner)) - np.repeat(ends - counts, counts)
    return owner, np.repeat(starts, counts) + within


def shingles(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of `length` consecutive words starting at each word; the last ones are left out."""
    count = len(hashes) - length + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for k in range(length):
        factor = np.uint64(_ODD[k % len(_ODD)]) ** np.uint64(k // len(_ODD) + 1)
        total += hashes[k : k + count] * factor
    return mixed(total + np.uint64(length))
