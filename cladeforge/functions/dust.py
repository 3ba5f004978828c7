"""Stretches of low complexity in nucleotide sequences, by the counts of their triplets.

A window of letters scores the sum over its triplets of n (n - 1) / 2, n being how often a
triplet occurs, ten times and divided by the number of triplets but one. Windows of 64
letters begin at every 32nd; where one scores beyond 20, its part with the highest score is
masked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of a window, the step between windows, the score that is allowed.
WINDOW, STEP, LEVEL = 64, 32, 20
_BASE = np.zeros(256, dtype=np.int64)
for _letters in ("ACGTU", "acgtu"):
    _BASE[[ord(c) for c in _letters]] = (0, 1, 2, 3, 3)


def worst_part(triplets: np.ndarray) -> tuple[int, int, int]:
    """(score, first, last) of the run of triplets that scores most; the first of several."""
    n = len(triplets)
    # same[i, j]: whether triplet j occurs at i as well; a run's score is a sum over its square.
    same = np.triu(triplets[:, None] == triplets[None, :], 1)
    upto = np.cumsum(np.cumsum(same[::-1], axis=0)[::-1], axis=1)  # pairs i <= a < b <= j, by row i, column j
    length = np.arange(n)[None, :] - np.arange(n)[:, None]
    score = np.where(length > 0, 10 * upto // np.maximum(length, 1), 0)
    first, last = np.unravel_index(int(np.argmax(score)), score.shape)
    return int(score[first, last]), int(first), int(last)


def low_complexity(seq: str) -> np.ndarray:
    """Whether each letter of a sequence is masked."""
    out = np.zeros(len(seq), dtype=bool)
    base = _BASE[np.frombuffer(seq.encode("ascii", "replace"), dtype=np.uint8)]
    if len(base) < 5:
        return out
    triplets = base[:-2] * 16 + base[1:-1] * 4 + base[2:]
    for at in range(0, len(seq), STEP):
        part = triplets[at : at + WINDOW - 2]
        if len(part) < 3:
            break
        score, first, last = worst_part(part)
        if score > LEVEL:
            out[at + first : at + last + 3] = True
    return out


def dust_masked(seq: Column, letter: str) -> Column:
    """seq with another letter in the places of low complexity."""

    def mask(text: str | None) -> str | None:
        if text is None:
            return None
        return "".join(letter if m else c for c, m in zip(text, low_complexity(text), strict=True))

    @F.arrow_udf("string")
    def run(seqs: pa.Array) -> pa.Array:
        return pa.array([mask(s) for s in seqs.to_pylist()], pa.string())

    return run(seq)
