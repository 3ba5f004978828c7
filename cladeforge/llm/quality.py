"""Quality selection by importance resampling.

Method: two generative models over hashed n-grams, one of the target (texts labelled
good), one of the raw corpus. The log of a text's importance weight is the sum over its
n-grams of the log ratio of the two; adding Gumbel noise and keeping the k largest keys
draws k texts without replacement in proportion to their weights (Gumbel top-k).

N-grams are bytes, hashed to BUCKETS, and pairs of neighbouring words, of which it only
counts whether the two are the same. The raw model counts all documents, the target a
bounded sample of labelled ones. k is the number of texts whose weight lies above the
threshold that separates the labelled sample best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytetext
from .common import write_table

NGRAM = 4
BUCKETS = 1 << 16
#: Labelled texts of either quality that are looked at, at most.
LABELLED = 20_000
#: How much worse it is to lose a good text than to keep a bad one.
LOSS = 5.0
#: Byte n-grams that a pair of words weighs.
PAIR_WEIGHT = 4.0
SEED = 11


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, in order, and the count of them before each text.

    The pairs of words take two buckets after the hashed ones.
    """
    size = np.diff(offsets)
    grams = np.maximum(size - NGRAM + 1, 0)
    if len(data) >= NGRAM:
        h = np.zeros(len(data) - NGRAM + 1, dtype=np.uint64)
        for i in range(NGRAM):
            h = h * np.uint64(257) + data[i : len(data) - NGRAM + 1 + i]
        h = (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64) % BUCKETS
        inside = np.zeros(len(data) + 1, dtype=np.int64)
        np.add.at(inside, offsets[:-1][grams > 0], 1)
        np.add.at(inside, (offsets[:-1] + grams)[grams > 0], -1)
        h = h[np.cumsum(inside)[: len(h)] > 0]
    else:
        h = np.zeros(0, dtype=np.int64)
    return h, np.concatenate(([0], np.cumsum(grams)))


def pairs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, the neighbouring words that are the same, and those that differ."""
    starts, ends = bytetext.words(data, offsets)
    text = np.searchsorted(offsets, starts, side="right") - 1
    hashes = bytetext.word_hashes(data, starts, ends)
    near = text[1:] == text[:-1]
    same = near & (hashes[1:] == hashes[:-1])
    n = len(offsets) - 1
    return (np.bincount(text[1:][m], minlength=n) for m in (same, near & ~same))


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target, any_row = np.zeros(BUCKETS + 2), np.zeros(BUCKETS + 2), False
    for batch in batches:
        good = np.array([q == 1 for q in batch.column(1).to_pylist()], dtype=bool)
        for row, data, offsets in bytetext.slices(batch.column(0)):
            any_row = True
            chosen = good[row : row + len(offsets) - 1]
            grams, before = features(data, offsets)
            raw[:BUCKETS] += np.bincount(grams, minlength=BUCKETS)
            mine = np.repeat(chosen, np.diff(before))
            target[:BUCKETS] += np.bincount(grams[mine], minlength=BUCKETS)
            for i, n in enumerate(pairs(data, offsets)):
                raw[BUCKETS + i] += n.sum()
                target[BUCKETS + i] += n[chosen].sum()
    if any_row:
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen), pa.array(raw[seen].astype(np.int64)), pa.array(target[seen].astype(np.int64))],
            ["bucket", "raw", "target"],
        )


def ratios(counted: DataFrame) -> np.ndarray:
    """Log ratio of target to raw by bucket, from rows text, quality; zeros without a target."""
    sums = counted.mapInArrow(_counter, "bucket long, raw long, target long").groupBy("bucket")
    table = sums.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.full(BUCKETS + 2, 0.5), np.full(BUCKETS + 2, 0.5)
    place = table.column("bucket").to_numpy()
    raw[place] += table.column("raw").to_numpy()
    target[place] += table.column("target").to_numpy()
    out = np.zeros(BUCKETS + 2)
    if target.sum() > 0.5 * len(target):
        for part in (slice(0, BUCKETS), slice(BUCKETS, None)):
            out[part] = np.log(target[part] / target[part].sum()) - np.log(raw[part] / raw[part].sum())
    out[BUCKETS:] *= PAIR_WEIGHT
    return out


def log_weights(ratio: np.ndarray, texts: pa.Array) -> np.ndarray:
    out = np.zeros(len(texts))
    for row, data, offsets in bytetext.slices(texts):
        grams, before = features(data, offsets)
        n = len(offsets) - 1
        sums = np.zeros(n)
        some = np.diff(before) > 0
        if some.any():
            sums[some] = np.add.reduceat(ratio[grams], before[:-1][some])
        same, differ = pairs(data, offsets)
        out[row : row + n] = sums + same * ratio[BUCKETS] + differ * ratio[BUCKETS + 1]
    return out


def log_weight(ratio: np.ndarray) -> Column:
    @F.arrow_udf("double")
    def weigh(texts: pa.Array) -> pa.Array:
        return pa.array(log_weights(ratio, texts))

    return weigh(F.col("text").cast("string"))


def gumbel(seed: int = SEED) -> Column:
    """Standard Gumbel noise, fixed by doc_id."""
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, name: str, k: int) -> float:
    """The k-th largest value of a column of finite numbers, 1 <= k <= rows.

    Counts ever finer ranges, and looks at the values only of one with few rows.
    """
    low, high = df.agg(F.min(name), F.max(name)).first()
    above, few = 0, 5000
    while True:
        part = df.where(F.col(name).between(low, high))
        if low == high:
            return low
        width = (high - low) / 4096
        place = F.least(F.floor((F.col(name) - low) / width), F.lit(4095)) if width > 0 else F.lit(0)
        rows = part.groupBy(place.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("lo"), F.max(name).alias("hi"))
        for r in sorted(rows.collect(), key=lambda r: -r["b"]):
            if above + r["n"] >= k:
                break
            above += r["n"]
        low, high = r["lo"], r["hi"]
        if r["n"] <= few:
            values = [x[0] for x in df.where(F.col(name).between(low, high)).select(name).collect()]
            return sorted(values, reverse=True)[k - above - 1]


class Selection:
    """A fitted selection: rows doc_id, log_weight, key (a written table), and the least kept key."""

    def __init__(self, docs: DataFrame, labels: DataFrame, seed: int = SEED):
        marks = labels.select("doc_id", "quality").where("doc_id is not null and quality in (0, 1)")
        marks = marks.groupBy("doc_id").agg(F.min("quality").alias("quality"))
        order = F.xxhash64("doc_id", F.lit(seed))
        some = [marks.where(F.col("quality") == q).orderBy(order, "doc_id").limit(LABELLED) for q in (0, 1)]
        sample = F.broadcast(write_table(some[0].unionByName(some[1])))  # 2 LABELLED rows at most
        given = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(sample, "doc_id", "left")
        self.ratio = ratios(given.select("text", "quality"))
        weighed = given.select("doc_id", "quality", log_weight(self.ratio).alias("log_weight"))
        self.rows = write_table(weighed.withColumn("key", F.col("log_weight") + gumbel(seed)))
        threshold = self._threshold()
        k = self.rows.where(F.col("log_weight") >= threshold).count()
        self.least = kth_largest(self.rows, "key", k) if k else float("inf")

    def _threshold(self) -> float:
        """The weight, in steps of a quarter, that loses least on the labelled sample."""
        step = F.floor(F.greatest(F.least("log_weight", F.lit(2000.0)), F.lit(-2000.0)) * 4).alias("step")
        found = self.rows.where("quality is not null").groupBy(step, "quality").count().collect()
        good, bad = ({r["step"]: r["count"] for r in found if r["quality"] == q} for q in (1, 0))
        if not good or not bad:
            return float("-inf")
        lost, best = 0.0, (float("inf"), 0)
        kept = sum(bad.values())
        for s in sorted({*good, *bad}):
            best = min(best, (lost + kept, s))
            lost += LOSS * good.get(s, 0)
            kept -= bad.get(s, 0)
        return best[1] / 4


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, log_weight, key, kept of every row of docs.

    Null and empty texts have weight 0. Without labelled texts of both qualities all rows
    are kept. Labels of other values are ignored, repeated ones count as the worse. Rows
    whose key equals the least kept one are all kept. An empty table gives no rows.
    """
    chosen = Selection(docs, labels)
    return chosen.rows.select("doc_id", "log_weight", "key", (F.col("key") >= chosen.least).alias("kept"))


def select(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that scores() keeps, with their columns."""
    chosen = Selection(docs, labels)
    return docs.where(log_weight(chosen.ratio) + gumbel() >= chosen.least)
