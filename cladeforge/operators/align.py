"""Pairwise alignment of candidate pairs, and what is built on it: greedy clusters and
the extraction of segments.

Clusters: each record meets, of the records before it, those that share most minimizers
with it; every minimizer offers only the first records that hold it, so the pairs grow with
the records. They are aligned in the band of diagonals that their minimizers show.

Segments: the references go to the tasks in blocks of bounded size, as an index of their
words. A sequence counts the words that it shares with each, takes those with the most, and
drops those whose edit distance, by bit-parallel columns of many at once, is beyond what
identity and coverage allow. The parts of it that are near enough are aligned first; a
reference that is as good there is aligned with the whole sequence, which decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeforge.functions.sequence import kmers, to_dna
from cladeforge.operators.rounds import cut
from cladeforge.schema import check_range

#: Scores of an alignment column, and costs of a gap: to open, and for each letter.
MATCH, MISMATCH = 2, -4
GAP, END_GAP = (20, 2), (2, 1)
WORD = 8


class Alignment(NamedTuple):
    """identity is matches by columns without the end gaps; low and high the part of the
    first sequence, covered the share of the second, that the letters in them take."""

    identity: float
    covered: float
    low: int
    high: int


def align(first: str, second: str) -> Alignment:
    """Global alignment with affine gaps, cheap at the ends, of two non-empty sequences."""
    return align_parts([first], [second], np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))[0]


def align_parts(firsts: list[str], seconds: list[str], before: np.ndarray, after: np.ndarray) -> list[Alignment]:
    """As align(), of pairs at once whose second sequences have one length; the first ones
    are parts of longer ones, with so many letters before and after them.

    These letters are gaps at the ends, so that an alignment whose other columns lie in the
    part is found as in the whole.
    """
    n, rows, cols = len(firsts), len(seconds[0]), np.array([len(s) for s in firsts])
    width = int(cols.max())
    coded = lambda s: np.frombuffer(s.encode("ascii", "replace"), dtype=np.uint8)
    a, b = np.stack([coded(s) for s in seconds]), np.full((n, width), 255, dtype=np.uint8)  # seconds down, firsts across
    for i, s in enumerate(firsts):
        b[i, : len(s)] = coded(s)
    place, size = np.arange(width + 1), (n, width + 1)
    lead = place + before[:, None]
    down = np.full(size, -(10**9), dtype=np.int64)
    open_down, ext_down = (np.full(size, GAP[i]) for i in (0, 1))
    for costs, end in ((open_down, END_GAP[0]), (ext_down, END_GAP[1])):
        costs[before == 0, 0] = end
        costs[after == 0, cols[after == 0]] = end
    best = np.where(lead > 0, -(END_GAP[0] + END_GAP[1] * lead), 0).astype(np.int64)
    step = np.zeros((rows + 1, *size), dtype=np.int8)  # 0 diagonal, 1 down, 2 across
    longer = np.zeros((rows + 1, *size), dtype=bool)  # a gap down that goes on
    start = np.zeros((rows + 1, *size), dtype=np.int32)  # where a gap across begins
    step[0, :, 1:] = 2
    for i in range(1, rows + 1):
        again = down - ext_down
        fresh = best - open_down - ext_down
        longer[i] = again > fresh
        down = np.maximum(again, fresh)
        diagonal = np.full(size, -(10**9), dtype=np.int64)
        diagonal[:, 1:] = best[:, :-1] + np.where(b == a[:, i - 1 : i], MATCH, MISMATCH)
        stay = np.maximum(diagonal, down)
        cost = END_GAP if i == rows else GAP
        lifted = stay + cost[1] * place
        top = np.maximum.accumulate(lifted, axis=1)
        where = np.maximum.accumulate(np.where(lifted >= top, place, 0), axis=1)
        across = np.full(size, -(10**9), dtype=np.int64)
        across[:, 1:] = top[:, :-1] - cost[0] - cost[1] * place[1:]
        start[i, :, 1:] = where[:, :-1]
        best = np.maximum(stay, across)
        step[i] = np.where(best == diagonal, 0, np.where(best == down, 1, 2))
    return [_traced(step[:, x], longer[:, x], start[:, x], int(where[x, cols[x]] if after[x] else cols[x]), a[x], b[x]) for x in range(n)]


def _traced(step: np.ndarray, longer: np.ndarray, start: np.ndarray, j: int, a: np.ndarray, b: np.ndarray) -> Alignment:
    i, pairs = len(a), []
    while i > 0 or j > 0:
        if step[i, j] == 0 and i and j:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif step[i, j] == 1 and i:
            while longer[i, j]:
                i -= 1
            i -= 1
        else:
            j = int(start[i, j]) if i else 0
    return _summed(pairs, a, b, len(a))


def align_band(first: str, second: str, low: int, high: int) -> Alignment:
    """As align(), over the diagonals from low to high alone (place in the first sequence
    less that in the second); a sequence's ends are gaps where the band leaves them out."""
    a, b = (np.frombuffer(s.encode("ascii", "replace"), dtype=np.uint8) for s in (second, first))
    rows, cols = len(a), len(b)
    low, high = max(low, -rows), min(high, cols)
    width = high - low + 1
    far = -(10**9)
    k = np.arange(width)
    edge_cost = lambda n: np.where(n > 0, END_GAP[0] + END_GAP[1] * n, 0)
    j = k + low  # places in the first sequence before row 0
    best = np.where((j >= 0) & (j <= cols), -edge_cost(np.maximum(j, 0)), far).astype(np.int64)
    down = np.full(width, far, dtype=np.int64)
    step, longer = np.zeros((rows + 1, width), dtype=np.int8), np.zeros((rows + 1, width), dtype=bool)
    start = np.zeros((rows + 1, width), dtype=np.int32)
    step[0] = 2
    end = (far * 2, 0, 0)
    for i in range(1, rows + 1):
        j = k + low + i
        here = (j >= 0) & (j <= cols)
        edge = (j == 0) | (j == cols)
        opens, goes = np.where(edge, END_GAP[0], GAP[0]), np.where(edge, END_GAP[1], GAP[1])
        above, above_down = np.r_[best[1:], far], np.r_[down[1:], far]
        again, fresh = above_down - goes, above - opens - goes
        longer[i] = again > fresh
        down = np.maximum(again, fresh)
        letter = b[np.clip(j - 1, 0, cols - 1)]
        diagonal = np.where(j >= 1, best + np.where(letter == a[i - 1], MATCH, MISMATCH), far)
        stay = np.where(here, np.maximum(diagonal, down), far)
        if 0 <= -low - i < width:  # before the first letter: a gap down from the corner
            stay[-low - i] = max(int(stay[-low - i]), -END_GAP[0] - END_GAP[1] * i)
        cost = END_GAP if i == rows else GAP
        lifted = stay + cost[1] * k
        top = np.maximum.accumulate(lifted)
        where = np.maximum.accumulate(np.where(lifted >= top, k, 0))
        across = np.full(width, far, dtype=np.int64)
        across[1:] = top[:-1] - cost[0] - cost[1] * k[1:]
        start[i, 1:] = where[:-1]
        best = np.where(here, np.maximum(stay, across), far)
        step[i] = np.where(best == diagonal, 0, np.where(best == stay, 1, 2))
        last = cols - low - i
        if 0 <= last < width:  # after the last letter: a gap down to the corner
            end = max(end, (int(best[last] - edge_cost(np.int64(rows - i))), i, last))
    ends = np.where((k + low + rows >= 0) & (k + low + rows <= cols), best - edge_cost(np.maximum(cols - (k + low + rows), 0)), far)
    end = max(end, (int(ends.max()), rows, int(np.argmax(ends))))
    (_, i, c), pairs = end, []
    while i > 0 and 0 <= c < width and i + low + c > 0:
        if step[i, c] == 0:
            pairs.append((i - 1, i + low + c - 1))
            i -= 1
        elif step[i, c] == 1:
            while i > 0 and c < width and longer[i, c]:
                i, c = i - 1, c + 1
            i, c = i - 1, c + 1
        else:
            c = int(start[i, c])
    return _summed(pairs, a, b, rows)


def _summed(pairs: list[tuple[int, int]], a: np.ndarray, b: np.ndarray, rows: int) -> Alignment:
    """Of the aligned places, last first."""
    if not pairs:
        return Alignment(0.0, 0.0, 0, 0)
    (i1, j1), (i0, j0) = pairs[0], pairs[-1]
    columns = (i1 - i0 + 1) + (j1 - j0 + 1) - len(pairs)
    i, j = np.array(pairs).T
    return Alignment(int((a[i] == b[j]).sum()) / columns, len(pairs) / rows, j0, j1 + 1)


def _align_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        several = zip(pdf.pop("seq_a"), pdf.pop("seq_b"), pdf.pop("from"), pdf.pop("upto"), strict=True)
        found = [align(x, y) if pd.isna(low) else align_band(x, y, int(low), int(high)) for x, y, low, high in several]
        yield pdf.assign(**{n: [getattr(x, n) for x in found] for n in Alignment._fields})


def aligned_pairs(pairs: DataFrame) -> DataFrame:
    """a, b, identity, covered, low, high of rows a, b, seq_a, seq_b and a band (from, upto);
    a null one is all."""
    schema = "a string, b string, identity double, covered double, low int, high int"
    return pairs.select("a", "b", "seq_a", "seq_b", "from", "upto").mapInPandas(_align_batches, schema)


def words(sequences: DataFrame, k: int) -> DataFrame:
    """id, word: the distinct k-mers of each sequence."""
    return sequences.select("id", F.explode(F.array_distinct(kmers(F.upper(to_dna(F.col("seq"))), k))).alias("word"))


#: Letters of a minimizer at most, words it is the least of, and the diagonals that a band
#: has on either side of its middle: these, and one a possible edit up to so many more.
LONGEST, NEXT, PAD, DRIFT = 20, 4, 32, 256
#: Minimizers shared for each letter of the overlap, at least: about a sixth of what is
#: expected of records as similar as asked for (0.4 a letter, one of five whole).
DENSITY = 0.0133
#: Records, the first ones, that a minimizer offers, and candidates that a record takes.
OFFERED, TAKEN = 16, 32


def minimizer_length(identity: float) -> int:
    """Letters of which a word stays whole in one of five places at that identity."""
    return LONGEST if identity >= 1 else max(WORD, min(LONGEST, int(math.log(0.2) / math.log(identity))))


def minimizers(seq: str, k: int, window: int = NEXT) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the words that are the least of a run of window words, once each
    where a word occurs once (others are left out: they show no diagonal)."""
    letters = np.frombuffer(seq.encode("ascii", "replace"), dtype=np.uint8).astype(np.uint64)
    n = len(letters) - k + 1
    if n < 1:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    code = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        code = code * np.uint64(0x9E3779B97F4A7C15) + letters[i : i + n] + np.uint64(1)
    code = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    code ^= code >> np.uint64(32)
    runs = np.lib.stride_tricks.sliding_window_view(code, min(window, n))
    place = np.unique(np.argmin(runs, axis=1) + np.arange(len(runs)))
    kinds, first, many = np.unique(code[place], return_index=True, return_counts=True)
    return kinds[many == 1].view(np.int64), place[first[many == 1]]


def _minimized(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [minimizers(s or "", k) for s in batch.column(1).to_pylist()]
            sizes = pa.array(np.cumsum([0, *(len(w) for w, _ in found)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(sizes, pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *x]))) for x in zip(*found, strict=True)] if found else []
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["id", "words", "places"])

    return run


def candidates(ranked: DataFrame, identity: float) -> DataFrame:
    """a, b, from, upto: of each record b (id, ord, seq) up to TAKEN records a before it, by
    the number of minimizers that it shares with them, and a band around the diagonal in
    their middle. Pairs that share too few for the letters that overlap there are left out.

    A minimizer offers its first OFFERED records, which are the likely centroids: the pairs
    are OFFERED a word of a record at most, however many records hold a word.
    """
    k = minimizer_length(identity)
    held = ranked.select("id", "seq").mapInArrow(_minimized(k), "id string, words array<long>, places array<long>")
    rows = held.select("id", F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("places").alias("place")))).join(ranked.select("id", "ord", F.length("seq").alias("size")), "id")
    rows = cut(rows)
    nth = F.row_number().over(Window.partitionBy("word").orderBy("ord", "id"))
    heads = rows.withColumn("nth", nth).where(F.col("nth") <= OFFERED)
    heads = heads.select("word", F.col("id").alias("a"), F.col("ord").alias("ord_a"), F.col("place").alias("place_a"), F.col("size").alias("size_a"))
    pairs = rows.join(heads, "word").where((F.col("ord_a") < F.col("ord")) | ((F.col("ord_a") == F.col("ord")) & (F.col("a") < F.col("id"))))
    shift = F.col("place_a") - F.col("place")
    found = pairs.groupBy("a", F.col("id").alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.median(shift).cast("long").alias("middle"), *(F.first(c).alias(c) for c in ("ord_a", "size_a", "size"))
    )
    overlap = F.least("size_a", F.col("size") + F.col("middle")) - F.greatest("middle", F.lit(0))
    found = found.withColumn("overlap", overlap).where(F.col("n") >= DENSITY * F.col("overlap"))
    best = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("n"), "ord_a", "a"))
    found = found.withColumn("nth", best).where(F.col("nth") <= TAKEN)
    side = PAD + F.least(F.ceil((1 - identity) * F.col("overlap")), F.lit(DRIFT))
    return found.select("a", "b", (F.col("middle") - side).alias("from"), (F.col("middle") + side).alias("upto"))


def _all_pairs(ranked: DataFrame) -> DataFrame:
    """a, b, from, upto: all pairs, the earlier one first, that share a word of WORD letters."""
    left, right = (words(ranked, WORD).withColumnRenamed("id", n) for n in ("a", "b"))
    orders = [ranked.select(F.col("id").alias(n), F.col("ord").alias(f"ord_{n}")) for n in ("a", "b")]
    pairs = left.join(right, "word").select("a", "b").distinct().join(orders[0], "a").join(orders[1], "b")
    before = (F.col("ord_a") < F.col("ord_b")) | ((F.col("ord_a") == F.col("ord_b")) & (F.col("a") < F.col("b")))
    none = F.lit(None).cast("long")
    return pairs.where(before).select("a", "b", none.alias("from"), none.alias("upto"))


def greedy_clusters(records: DataFrame, identity: float, exact: bool = False) -> DataFrame:
    """centroid, target of the records (id, ord, seq) that join another's cluster.

    In the order of ord each record joins, of the centroids before it whose identity
    suffices, the most similar (then the first), or becomes a centroid. Rounds decide all
    records whose earlier neighbours are decided; their number is that of the longest
    chain of neighbours.

    Neighbours come from candidates(), aligned in a band: a similar pair is lost where too few
    of its minimizers are whole, or OFFERED records before it hold each of them. With
    exact they are all pairs that share a word of 8 letters, aligned in full.
    """
    check_range("identity", identity, 0, 1, open_low=True)
    ranked = records.select("id", "ord", F.upper(to_dna(F.col("seq"))).alias("seq"))
    found = _all_pairs(ranked) if exact else candidates(ranked, identity)
    letters = [ranked.select(F.col("id").alias(n), F.col("seq").alias(f"seq_{n}")) for n in ("a", "b")]
    pairs = found.join(letters[0], "a").join(letters[1], "b")
    orders = [ranked.select(F.col("id").alias("a"), F.col("ord").alias("ord_a"))]
    near = aligned_pairs(pairs).where(F.col("identity") >= identity).select("a", "b", "identity")
    near = cut(near.join(orders[0], "a"))
    state = cut(ranked.select("id").withColumn("target", F.lit(None).cast("string")))  # target: itself for centroids
    while not state.where("target is null").isEmpty():
        of_a = state.select(F.col("id").alias("a"), F.col("target").alias("target_a"))
        centroid = F.col("target_a") == F.col("a")
        rank = F.struct((-F.col("identity")).alias("worst"), "ord_a", "a")
        seen = near.join(of_a, "a").groupBy("b").agg(
            F.max(F.col("target_a").isNull()).alias("waits"), F.min(F.when(centroid, rank)).getField("a").alias("best")
        )
        told = state.join(seen.withColumnRenamed("b", "id"), "id", "left")
        new = F.when(F.coalesce("waits", F.lit(False)), F.lit(None)).otherwise(F.coalesce("best", "id"))
        state = cut(told.select("id", F.coalesce("target", new).alias("target")))
    return state.where("id <> target").select(F.col("id").alias("centroid"), "target")


#: Words that a sequence and a reference share at least (all of the reference's, if fewer),
#: references that a sequence takes, by the number of shared words, and letters of a block.
SHARED, BLOCK = 12, 8_000_000
#: Bits of the patterns compared at once, and letters between two looks at their scores.
BITS, LOOK = 1 << 14, 2048
#: Letters of a pattern that fits a lane, letters that a lane answers for, and lanes at once.
WIDEST, STRETCH, LANES = 64, 512, 8192
#: Texts searched together, and cells of alignments made at once (or a single one).
TEXTS, CELLS = 200, 1 << 22
_BASE = np.full(256, 4, dtype=np.int64)
_BASE[[ord(c) for c in "ACGT"]] = range(4)


def base_words(seq: str, k: int = WORD) -> np.ndarray:
    """The distinct words of A, C, G and T, as numbers."""
    base = _BASE[np.frombuffer(seq.encode("ascii", "replace"), dtype=np.uint8)]
    n = len(base) - k + 1
    if n < 1:
        return np.zeros(0, dtype=np.int64)
    code, bad = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    for i in range(k):
        part = base[i : i + n]
        code, bad = code * 4 + (part & 3), bad | (part > 3)
    seen = np.zeros(4**k, dtype=bool)
    seen[code[~bad]] = True
    return np.flatnonzero(seen)


def _distances(text: str, patterns: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """Of each pattern the least edit distance to any part of text that ends at a letter:
    number of the first letter, and letters x patterns, LOOK letters at a time.

    Bit-parallel: a column of the table of all patterns is one long number of vertical
    differences, a bit a letter and one between patterns that takes the carries.
    """
    full = top = at = 0
    tops, equal = [], dict.fromkeys(map(ord, "ACGT"), 0)
    for p in patterns:
        for i, c in enumerate(p.encode("ascii", "replace")):
            equal[c] = equal.get(c, 0) | 1 << at + i
        full |= ((1 << len(p)) - 1) << at
        tops.append(at + len(p) - 1)
        top |= 1 << tops[-1]
        at += len(p) + 1
    size, plus, minus = at // 8 + 1, full, 0
    score = np.array([len(p) for p in patterns], dtype=np.int64)
    byte, bit = np.array(tops) // 8, np.array(tops) % 8
    letters = text.encode("ascii", "replace")
    for begin in range(0, len(letters), LOOK):
        ups, downs = [], []
        for c in letters[begin : begin + LOOK]:
            eq = equal.get(c, 0)
            xv = eq | minus
            xh = ((((eq & plus) + plus) ^ plus) | eq) & full
            up = minus | (full & ~(xh | plus))
            down = plus & xh
            ups.append((up & top).to_bytes(size, "little"))
            downs.append((down & top).to_bytes(size, "little"))
            up, down = up << 1 & full, down << 1 & full
            plus, minus = down | (full & ~(xv | up)), up & xv
        looks = [np.frombuffer(b"".join(x), dtype=np.uint8).reshape(-1, size)[:, byte] >> bit & 1 for x in (ups, downs)]
        path = score + np.cumsum(looks[0].astype(np.int64) - looks[1], axis=0)
        score = path[-1]
        yield begin, path


def least_distances(text: str, patterns: list[str]) -> list[int]:
    """Of each pattern the least edit distance to any part of text."""
    if not patterns:
        return []
    least = np.array([len(p) for p in patterns], dtype=np.int64)
    for _, path in _distances(text, patterns):
        least = np.minimum(least, path.min(axis=0))
    return least.tolist()


def near_ends(text: str, patterns: list[str], most: list[int]) -> list[list[int]]:
    """Of each pattern where the parts of text end (in letters before the end) that are
    within so many edits of it, the empty part included."""
    out = [[0] if len(p) <= n else [] for p, n in zip(patterns, most, strict=True)]
    for begin, path in _distances(text, patterns) if patterns else ():
        letter, which = np.nonzero(path <= np.array(most))
        for i, p in zip((letter + begin + 1).tolist(), which.tolist(), strict=True):
            out[p].append(i)
    return out


def most_edits(size: int, identity: float, coverage: float) -> tuple[int, int]:
    """Edits and letters left out, at most, of a pattern of that size in an alignment as good:
    of the letters not left out at most all are matches, each with its share of columns that
    are none."""
    left = math.floor(size * (1 - coverage) + 1e-9)
    return max(math.floor((size - u) * (1 - identity) / identity + u + 1e-9) for u in (0, left)), left


def near_parts(size: int, pattern: int, ends: list[int], identity: float, left: int) -> list[tuple[int, int]]:
    """The parts of a text of that size in which alignments as good run that end there, but for
    the gaps at the text's ends: their columns are so many times the pattern's letters, and a
    gap of the letters left out is the only one beside them (a longer one across is dearer)."""
    reach = math.floor(pattern / identity + 1e-9) + left + 1
    out: list[tuple[int, int]] = []
    for end in ends:
        low, high = max(0, end - reach), min(size, end + left + 1)
        if out and low <= out[-1][1]:
            out[-1] = out[-1][0], high
        else:
            out.append((low, high))
    return out


class Lanes:
    """Patterns that go over stretches of texts side by side, a lane each: of each pattern
    and text the places where parts within its edits end (in letters before the end).

    The bit-parallel columns of _distances() with a machine word a lane. A lane begins as
    many letters before its own as a part can have, so that its distances up to the edits
    are those of the whole text.
    """

    def __init__(self, patterns: list[str], edits: list[int]):
        coded = [np.frombuffer(p.encode("ascii", "replace"), dtype=np.uint8) for p in patterns]
        self.size, self.edits = np.array([len(p) for p in patterns], dtype=np.int64), np.array(edits, dtype=np.int64)
        kinds = np.unique(np.concatenate([np.zeros(0, dtype=np.uint8), *coded]))
        self.code, self.kinds = np.zeros(256, dtype=np.int64), len(kinds) + 1  # 0: in no pattern
        self.code[kinds] = np.arange(1, self.kinds)
        fits = self.size <= WIDEST
        held = [coded[p] for p in np.flatnonzero(fits)]
        letter = np.concatenate([np.arange(0), *(np.arange(len(c)) for c in held)])
        slot = np.repeat(np.flatnonzero(fits), self.size[fits]) * self.kinds + self.code[np.concatenate([np.zeros(0, dtype=np.uint8), *held])]
        self.equal = np.zeros(len(patterns) * self.kinds, dtype=np.uint64)
        np.bitwise_or.at(self.equal, slot, np.uint64(1) << letter.astype(np.uint64))

    def ends(self, texts: list[str], which: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, pattern and end, sorted; which: the patterns for each text, of up to WIDEST letters."""
        letters = self.code[np.frombuffer("".join(texts).encode("ascii", "replace"), dtype=np.uint8)]
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        first = np.cumsum(sizes) - sizes
        lanes, held, found = [], 0, []
        for t, patterns in enumerate(which):
            own = np.arange(0, sizes[t], STRETCH)
            some = max(1, LANES // max(1, len(own)))
            for at in range(0, len(patterns), some):
                part = patterns[at : at + some]
                lanes.append(np.stack([np.full(len(own) * len(part), t), np.repeat(part, len(own)), np.tile(own, len(part))]))
                held += lanes[-1].shape[1]
                if held >= LANES:
                    found.append(self._run(np.concatenate(lanes, axis=1), letters, first, sizes))
                    lanes, held = [], 0
        if held:
            found.append(self._run(np.concatenate(lanes, axis=1), letters, first, sizes))
        every = np.concatenate([np.zeros((3, 0), dtype=np.int64), *found], axis=1)
        return tuple(every[:, np.lexsort(every[::-1])])

    def _run(self, lanes: np.ndarray, letters: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        text, pattern, own = lanes
        begin = np.maximum(own - self.size[pattern] - self.edits[pattern], 0)
        steps = np.minimum(own + STRETCH, sizes[text]) - begin
        order = np.argsort(steps, kind="stable")
        found = []
        for at in range(0, len(order), LANES):
            some = order[at : at + LANES]
            t, p, place = text[some], pattern[some], begin[some]
            base, last = first[t] + place, len(letters) - 1
            row, edits, top = p * self.kinds, self.edits[p], (self.size[p] - 1).astype(np.uint64)
            plus, minus = np.full(len(some), ~np.uint64(0)), np.zeros(len(some), dtype=np.uint64)
            score, one = self.size[p].copy(), np.uint64(1)
            for step in range(int(steps[some[-1]])):
                eq = self.equal[row + letters[np.minimum(base + step, last)]]
                xv = eq | minus
                xh = (((eq & plus) + plus) ^ plus) | eq
                up, down = minus | ~(xh | plus), plus & xh
                score += (up >> top & one).view(np.int64)
                score -= (down >> top & one).view(np.int64)
                up, down = up << one, down << one
                plus, minus = down | ~(xv | up), up & xv
                near = np.flatnonzero(score <= edits)
                if len(near):
                    end = place[near] + step + 1
                    near, end = near[valid := (end > own[some[near]]) & (step < steps[some[near]])], end[valid]
                    found.append(np.stack([t[near], p[near], end]))
        return np.concatenate([np.zeros((3, 0), dtype=np.int64), *found], axis=1)


class References:
    """A block of references (id, letters) and where their words are."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.ids, self.seqs = [r[0] for r in rows], [r[1] for r in rows]
        held = [base_words(s) for s in self.seqs]
        self.size = np.array([len(w) for w in held], dtype=np.int64)
        flat, owner = np.concatenate([np.zeros(0, dtype=np.int64), *held]), np.repeat(np.arange(len(rows)), self.size)
        order = np.argsort(flat, kind="stable")
        self.owner = owner[order].astype(np.int32)
        self.begin = np.searchsorted(flat[order], np.arange(4**WORD + 1))

    def shared(self, seq: str) -> np.ndarray:
        """How many distinct words each reference shares with a sequence."""
        found = base_words(seq)
        n = self.begin[found + 1] - self.begin[found]
        place = np.repeat(self.begin[found] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self.owner[place], minlength=len(self.ids))

    def most_shared(self, seq: str, most: int | None) -> list[int]:
        """The references that share enough words, those with most of them first; all, if
        there is no bound."""
        if most is None:
            return list(range(len(self.ids)))
        shared = self.shared(seq)
        fit = np.flatnonzero((shared >= np.minimum(SHARED, self.size)) & (shared > 0))
        return sorted(fit.tolist(), key=lambda r: (-shared[r], self.ids[r]))[:most]

    def near(self, texts: list[str], chosen: list[list[int]], lanes: Lanes, identity: float, coverage: float) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
        """text, reference and the parts of the text in which an alignment as good runs, where
        the chosen references of each text may have one."""
        limit = lambda r: most_edits(len(self.seqs[r]), identity, coverage)
        parts = lambda t, r, ends: near_parts(len(texts[t]), len(self.seqs[r]), ends, identity, limit(r)[1])
        fits = [[r for r in c if len(self.seqs[r]) <= WIDEST and limit(r)[0] < len(self.seqs[r])] for c in chosen]
        text, pattern, end = lanes.ends(texts, [np.array(f, dtype=np.int64) for f in fits])
        cuts = np.flatnonzero(np.diff(text, prepend=-1) | np.diff(pattern, prepend=-1)).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(text)], strict=False):
            yield int(text[a]), int(pattern[a]), parts(int(text[a]), int(pattern[a]), end[a:b].tolist())
        for t, (every, fit) in enumerate(zip(chosen, fits, strict=True)):
            part, bits, fit = [], 0, set(fit)
            for r in [*(r for r in every if r not in fit), None]:
                if part and (r is None or bits + len(self.seqs[r]) > BITS):
                    ends = near_ends(texts[t], [self.seqs[p] for p in part], [limit(p)[0] for p in part])
                    yield from ((t, p, parts(t, p, found)) for p, found in zip(part, ends, strict=True) if found)
                    part, bits = [], 0
                if r is not None:
                    part.append(r)
                    bits += len(self.seqs[r])

    def hits(self, texts: list[str], chosen: list[list[int]], lanes: Lanes, identity: float, coverage: float) -> dict[int, tuple[int, Alignment]]:
        """Of each text that has one the best alignment, with its reference."""
        good = lambda x: x.identity >= identity and x.covered >= coverage
        sizes: dict[int, list] = {}
        for t, r, parts in self.near(texts, chosen, lanes, identity, coverage):
            sizes.setdefault(len(self.seqs[r]), []).extend((high - low, t, r, low, high) for low, high in parts)
        pairs = set()
        for size, several in sizes.items():
            several.sort()  # parts of like length together
            at = 0
            while at < len(several):
                to = at + 1
                while to < len(several) and (to - at + 1) * several[to][0] * size < CELLS:
                    to += 1
                _, t, r, low, high = zip(*several[at:to], strict=True)
                after = np.array([len(texts[x]) for x in t]) - high
                found = align_parts([texts[x][a:b] for x, a, b in zip(t, low, high, strict=True)], [self.seqs[x] for x in r], np.array(low), after)
                pairs.update((x, y) for x, y, z in zip(t, r, found, strict=True) if good(z))
                at = to
        best: dict[int, tuple[int, Alignment]] = {}
        for t, r in sorted(pairs):
            if good(x := align(texts[t], self.seqs[r])):
                best[t] = min(best.get(t, (r, x)), (r, x), key=lambda g: (-g[1].identity, self.ids[g[0]]))
        return best


def _best_hits(refs: References, identity: float, coverage: float, most: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes = Lanes(refs.seqs, [most_edits(len(s), identity, coverage)[0] for s in refs.seqs])
        for batch in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
            some = [(i, s) for i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if s]
            texts = [s for _, s in some]
            best = refs.hits(texts, [refs.most_shared(s, most) for s in texts], lanes, identity, coverage) if texts else {}
            found = [(some[t][0], refs.ids[r], x.identity, x.low, x.high) for t, (r, x) in sorted(best.items())]
            columns = zip(*found, strict=True) if found else [()] * 5
            kinds = [pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["id", "b", "identity", "low", "high"])

    return run


HIT = "id string, b string, identity double, low int, high int"


def _in_blocks(sequences: DataFrame, fit: DataFrame, job, schema: str) -> DataFrame:
    """job(block) over the sequences (id, seq), for each block of the references fit."""
    letters = fit.agg(F.sum(F.length("seq"))).first()[0] or 0
    blocks = max(1, math.ceil(letters / BLOCK))
    found = []
    for k in range(blocks):
        rows = fit.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).collect()  # about BLOCK letters
        found.append(sequences.mapInArrow(job(References([(r["id"], r["seq"]) for r in rows])), schema))
    return reduce(DataFrame.union, found)


def _shared_counts(refs: References, most: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                chosen = refs.most_shared(s or "", most)
                n = refs.shared(s or "")[chosen]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(chosen), pa.string()), pa.array([refs.ids[r] for r in chosen], pa.string()), pa.array(n, pa.int64())], ["id", "b", "shared"])

    return run


def segment_candidates(sequences: DataFrame, references: DataFrame, most: int | None = 32) -> DataFrame:
    """id, b, shared: the references (of any length) that extract_seq_segments() looks at for
    each sequence, and the distinct words of A, C, G and T that the two share."""
    fit = cut(references.select("id", F.upper(to_dna(F.col("seq"))).alias("seq")))
    rows = sequences.select("id", F.upper(to_dna(F.col("seq"))).alias("seq"))
    return _in_blocks(rows, fit, lambda refs: _shared_counts(refs, most), "id string, b string, shared long")


def extract_seq_segments(
    sequences: DataFrame,
    references: DataFrame,
    perc_identity: float = 0.7,
    target_coverage: float = 0.9,
    min_seq_len: int = 32,
    max_seq_len: int = 50_000,
    most: int | None = 32,
) -> tuple[DataFrame, DataFrame]:
    """(segments, unmatched): of each sequence the part that aligns best with a reference
    segment on the same strand, if identity and the covered share of the segment suffice.

    The lengths bound the references. Equal identities: the first id of the references. Of
    each block of references a sequence looks at the `most` that share most words with it,
    SHARED or more; None looks at all, and loses nothing. The references go to all tasks,
    a block of BLOCK letters (or one longer reference) at a time; the sequences are read
    once for each block.
    """
    for name, value in (("perc_identity", perc_identity), ("target_coverage", target_coverage)):
        check_range(name, value, 0, 1, open_low=True)
    for name, value in (("min_seq_len", min_seq_len), ("max_seq_len", max_seq_len)):
        check_range(name, value, 1)
    upper = F.upper(to_dna(F.col("seq")))
    fit = cut(references.where(F.length("seq").between(min_seq_len, max_seq_len)).select("id", upper.alias("seq")))
    every = cut(_in_blocks(sequences.select("id", upper.alias("seq")), fit, lambda refs: _best_hits(refs, perc_identity, target_coverage, most), HIT))
    first = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("identity"), "b"))
    best = every.withColumn("n", first).where("n = 1").select("id", "low", "high")
    part = F.substring(F.col("seq"), F.col("low") + 1, F.col("high") - F.col("low"))
    segments = sequences.join(best, "id").withColumn("seq", part).select(*sequences.columns)
    return segments, sequences.join(best, "id", "left_anti")
