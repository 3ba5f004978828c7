"""Words of k letters (k-mers) of sequences, counted within each row by array operations."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of an ASCII letter; as many letters fit a 64-bit code.
BITS = 7
CODED = 63 // BITS


def windows(seq: str, k: int) -> np.ndarray:
    """All words of an ASCII sequence in order, as byte strings; none where it is shorter."""
    letters = np.frombuffer(seq.encode("ascii"), dtype=np.uint8)
    if len(letters) < k:
        return np.zeros(0, dtype=f"S{k}")
    views = np.lib.stride_tricks.sliding_window_view(letters, k)
    return np.ascontiguousarray(views).view(f"S{k}").ravel()


def word_counts(seq: str, k: int) -> tuple[list[str], np.ndarray]:
    """The distinct words of a sequence and how often each occurs."""
    if seq.isascii() and k <= CODED:
        codes = word_codes(seq, k)
        kinds, n = np.unique(codes, return_counts=True)
        return decoded(kinds, k), n
    counts = Counter(seq[i : i + k] for i in range(len(seq) - k + 1))
    return list(counts), np.fromiter(counts.values(), dtype=np.int64, count=len(counts))


def word_codes(seq: str, k: int) -> np.ndarray:
    letters = np.frombuffer(seq.encode("ascii"), dtype=np.uint8).astype(np.int64)
    n = len(letters) - k + 1
    codes = np.zeros(max(n, 0), dtype=np.int64)
    for i in range(k):
        codes = codes << BITS | letters[i : i + max(n, 0)]
    return codes


def decoded(codes: np.ndarray, k: int) -> list[str]:
    shifts = BITS * np.arange(k - 1, -1, -1)
    letters = ((codes[:, None] >> shifts) & 127).astype(np.uint8)
    return [row.tobytes().decode() for row in letters]


#: Sequences whose words are summed up together, and distinct words held before they are handed over.
TEXTS, HELD = 200, 200_000


def unit_weights(k: int):
    """word, w: of rows seq the counts of their words, scaled to length one, summed up.

    The sums go on through all batches of a task, so what is held is bounded by TEXTS
    sequences and HELD words, whatever the size of a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, sums, others = np.zeros(0, dtype=np.int64), np.zeros(0), Counter()

        def rows() -> pa.RecordBatch:
            columns = [pa.array(decoded(kinds, k) + list(others), pa.string()), pa.array([*sums.tolist(), *others.values()], pa.float64())]
            return pa.RecordBatch.from_arrays(columns, ["word", "w"])

        for batch in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
            codes, weights = [kinds], [sums]
            for seq in batch.column(0).to_pylist():
                if seq is None or len(seq) < k:
                    continue
                if seq.isascii() and k <= CODED:
                    own, n = np.unique(word_codes(seq, k), return_counts=True)
                    codes.append(own)
                    weights.append(n / np.sqrt((n * n).sum()))
                else:
                    words, n = word_counts(seq, k)
                    for word, w in zip(words, n / np.sqrt((n * n).sum()), strict=True):
                        others[word] += float(w)
            kinds, place = np.unique(np.concatenate(codes), return_inverse=True)
            sums = np.bincount(place, weights=np.concatenate(weights), minlength=len(kinds))
            if len(kinds) + len(others) > HELD:
                yield rows()
                kinds, sums, others = kinds[:0], sums[:0], Counter()
        yield rows()

    return run


_BASE = np.full(256, 4, dtype=np.int64)
_BASE[[ord(c) for c in "ACGT"]] = range(4)
#: Bytes of a piece of a bitmap, as the SQL functions over bitmaps take them.
PIECE = 4096


def rolled(letters: np.ndarray, k: int, base: int) -> np.ndarray:
    """The words of k letters as numbers in that base, each from two of half its length."""
    out, size = letters, 1
    for bit in f"{k:b}"[1:]:
        n = max(0, len(letters) - 2 * size + 1)
        out = out[:n] * out.dtype.type(pow(base, size, 1 << 8 * out.itemsize)) + out[size : size + n]
        size *= 2
        if bit == "1":
            n = max(0, len(letters) - size)
            out = out[:n] * out.dtype.type(base) + letters[size : size + n]
            size += 1
    return out


def base_places(letters: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each word the number in base 4, if all its letters are A, C, G and T, and whether it has others."""
    base = _BASE[letters]
    kind = np.uint32 if k < 16 else np.uint64
    others = np.concatenate(([0], np.cumsum(base > 3)))
    n = max(0, len(base) - k + 1)
    return rolled((base & 3).astype(kind), k, 4), others[k : k + n] > others[:n]


def base_codes(seq: str, k: int) -> tuple[np.ndarray, list[str]]:
    """The distinct words of A, C, G and T as numbers in base 4, and those with other letters."""
    code, odd = base_places(np.frombuffer(seq.encode("ascii", "replace"), dtype=np.uint8), k)
    return np.unique(code[~odd]), list({seq[i : i + k] for i in np.flatnonzero(odd)})


def word_bitmap(seqs: DataFrame, k: int) -> np.ndarray:
    """A bit for each of the 4**k words of A, C, G and T, set if a sequence (the only column)
    has it. Tasks send pieces that are joined by or: 4**k / 8 bytes reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(max(4**k, 8 * PIECE), dtype=bool)
        for batch in batches:
            for seq in batch.column(0).to_pylist():
                code, odd = base_places(np.frombuffer((seq or "").encode("ascii", "replace"), dtype=np.uint8), k)
                seen[code[~odd]] = True
        pieces = np.packbits(seen, bitorder="little").reshape(-1, PIECE)
        some = np.flatnonzero(pieces.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([pieces[i].tobytes() for i in some], pa.binary())], ["piece", "bits"])

    out = np.zeros((max(4**k // 8, PIECE) // PIECE, PIECE), dtype=np.uint8)
    for r in seqs.mapInArrow(run, "piece long, bits binary").groupBy("piece").agg(F.bitmap_or_agg("bits").alias("bits")).collect():
        out[r["piece"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out.ravel()


def turned_bitmap(bits: np.ndarray, k: int) -> np.ndarray:
    """The bitmap of the reverse complements of a bitmap's words."""
    left = np.flatnonzero(np.unpackbits(bits, bitorder="little"))
    code = np.zeros(len(left), dtype=np.int64)
    for _ in range(k):
        left, letter = np.divmod(left, 4)
        code = code * 4 + 3 - letter
    out = np.zeros(len(bits) * 8, dtype=bool)
    out[code] = True
    return np.packbits(out, bitorder="little")


#: Bits of the marks of words with other letters, and the base of their hashes.
MARKS, HASH = 24, 0x9E3779B97F4A7C15


def _marks(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - MARKS)


def _has(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> places.dtype.type(3)] >> (places & places.dtype.type(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def _marked(words: list[str], k: int) -> np.ndarray:
    """A bitmap of the first bits of the hashes of the words, all of k letters."""
    seen = np.zeros(1 << MARKS, dtype=bool)
    for at in range(0, len(words), PIECE):
        letters = np.frombuffer("".join(words[at : at + PIECE]).encode("ascii", "replace"), dtype=np.uint8)
        seen[_marks(rolled(letters.astype(np.uint64), k, HASH)[::k])] = True
    return np.packbits(seen, bitorder="little")


def shared_words(seq: Column, k: int, bitmaps: list[np.ndarray], others: list[list[str]]) -> Column:
    """An array with, for each bitmap and list of words with other letters, how many of the
    distinct words of seq are there. They go to all tasks, so the lists must be bounded.

    Words are told apart only where the bitmap, or the hash's mark, has them.
    """
    sets = [frozenset(o) for o in others]
    marks = [_marked(list(o), k) if o else None for o in others]

    def count(seq: str | None) -> list[int]:
        letters = np.frombuffer((seq or "").encode("ascii", "replace"), dtype=np.uint8)
        code, odd = base_places(letters, k)
        plain, odd = code[~odd], np.flatnonzero(odd)
        out = [len(np.unique(plain[_has(bits, plain)])) for bits in bitmaps]
        if len(odd) and any(sets):
            hashes = _marks(rolled(letters.astype(np.uint64), k, HASH)[odd])
            for i, (mark, s) in enumerate(zip(marks, sets, strict=True)):
                if s:
                    out[i] += len({seq[x : x + k] for x in odd[_has(mark, hashes)].tolist()} & s)
        return out

    @F.arrow_udf("array<int>")
    def counted(seqs: pa.Array) -> pa.Array:
        return pa.array([count(s) for s in seqs.to_pylist()], pa.list_(pa.int32()))

    return counted.asNondeterministic()(seq)  # so that a filter on the counts doesn't make them twice
