"""Vectorized work on the UTF-8 bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer text is worked on alone.
SLICE = 1 << 19

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_rng = np.random.default_rng(20)
_VALUE = _rng.integers(0, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_INK = np.where(SPACE, np.uint64(0), _VALUE)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes, and offsets (rows + 1) of runs of rows; null texts are empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, side="right")) - 1)
        last = min(last, len(texts))
        yield row, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words, runs of other bytes than white space within a text."""
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    ink = ~SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty_like(ink)
    before[0], before[1:] = False, ink[:-1]
    after = np.empty_like(ink)
    after[-1], after[:-1] = False, ink[1:]
    starts = np.flatnonzero(ink & (~before | edge[:-1]))
    ends = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return starts, ends


#: Powers of a step known so far, and of its inverse; of no more places than a slice has.
_known: dict[int, np.ndarray] = {}


def powers(step: int, n: int) -> np.ndarray:
    """The powers 0 to n - 1 of an odd step (at least)."""
    known = _known.get(step)
    if known is None or len(known) < n:
        factors = np.full(max(n, 1), step, dtype=np.uint64)
        factors[0] = 1
        known = np.multiply.accumulate(factors)
        if n <= SLICE + 1:
            _known[step] = known
    return known


def inverse(step: int) -> int:
    return pow(int(step), -1, 1 << 64)


def sums(hashes: np.ndarray, step: int) -> np.ndarray:
    """Sums of the words before each place and before the end, for window_sums()."""
    out = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * powers(int(step), len(hashes))[: len(hashes)], out=out[1:])
    return out


def window_sums(hashes: np.ndarray, first: np.ndarray, end: np.ndarray, step: int, before: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of the words from first to end (exclusive), for each of the places.

    A polynomial in step over the words' hashes, the same wherever the words stand: taken
    from sums over all words before (sums(), if at hand), so its cost doesn't grow with
    the windows.
    """
    if not len(first):
        return np.zeros(0, dtype=np.uint64)
    if before is None:
        before = sums(hashes, step)
    return mix((before[end] - before[first]) * powers(inverse(step), len(hashes) + 1)[first]) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers, one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial over random byte values, mixed."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    # The sum of a word's byte values times the powers of their places in all the data, put
    # back by the power of its start; white space counts nothing.
    value = _INK[data] * powers(int(_STEP), len(data))[: len(data)]
    return mix(np.add.reduceat(value, starts) * powers(inverse(_STEP), len(data))[starts])
