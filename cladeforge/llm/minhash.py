"""Near copies by the Jaccard similarity of word shingle sets.

Method: min-max hashing. Of every permutation both the smallest and the largest value of a
set are kept, so PERMUTATIONS evaluations a shingle give twice as many values, each of
which two sets share with a probability of their similarity; the two of a permutation fall
on different shingles, which makes the share of equal values an unbiased estimate of less
variance than that of as many independent minima. Runs of ROWS minima, and the runs of the
maxima of the same permutations, form the bands; sets that agree on a band are candidates,
and the links are confirmed on the full sets.

What a link can be lost to: that all BANDS differ though the similarity is 0.85 or more,
which has a probability of under 1e-10 for each pair (0.5563**40). There is no other way.

Equal sets meet once, by a 128-bit hash. Sets that share bands, directly or through others,
are a cluster, found from one pair a set and bucket; no text moves for it. A cluster's sets
go to one task, or, beyond HELD shingles, are dealt out to squares of two groups each, where
an inverted index of their shingles counts exactly what one set shares with all others. The
set with the most common shingles is asked first, in a group of near copies the text that
all vary; of the others only those that it isn't linked with ask, as sets that are of one
class needn't be compared. A task gives at most one link a set that joins another's class,
so no group gives its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext
from .common import connected_components, drop_table, write_table
from .simhash import _pairs

#: Values of a band, and the permutations: each run of ROWS of them gives two bands.
ROWS, PERMUTATIONS = 5, 100
BANDS = 2 * PERMUTATIONS // ROWS
#: Shingles of a group of a cluster; a task holds two groups.
HELD = 2_000_000
#: Probability with which a similar pair may share no band.
MISS = 1e-10

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_STEP = 0x2545F4914F6CDD1D
_rng = np.random.default_rng(12)
_A = _rng.integers(0, 1 << 63, size=PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, size=PERMUTATIONS, dtype=np.uint64)
_WEIGHT = _rng.integers(0, 1 << 63, size=ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending and joined, and where each set
    begins (texts + 1 places). Texts are given as joined bytes with offsets."""
    data = LOWER[data]
    starts, ends = bytetext.words(data, offsets)
    hashes = bytetext.word_hashes(data, starts, ends)
    text = np.searchsorted(offsets, starts, side="right") - 1
    n = np.bincount(text, minlength=len(offsets) - 1)
    begin = np.concatenate(([0], np.cumsum(n)))
    first = np.arange(len(starts))
    end = first + words
    whole = end <= begin[text + 1]
    short = (n[text] < words) & (first == begin[text])
    end = np.where(short, begin[text + 1], end)
    use = whole | short
    shingles, text = bytetext.window_sums(hashes, first[use], end[use], _STEP), text[use]
    order = np.lexsort((shingles, text))
    shingles, text = shingles[order], text[order]
    new = np.ones(len(shingles), dtype=bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (text[1:] != text[:-1])
    return shingles[new], np.concatenate(([0], np.cumsum(np.bincount(text[new], minlength=len(offsets) - 1))))


def signatures(sets: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Minima, then maxima, of each of the given sets (none empty) under all permutations."""
    out = np.empty((2 * PERMUTATIONS, len(begin)), dtype=np.uint64)
    for p in range(PERMUTATIONS):
        value = sets * _A[p] + _B[p]
        np.minimum.reduceat(value, begin, out=out[p])
        np.maximum.reduceat(value, begin, out=out[PERMUTATIONS + p])
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """A key a band (BANDS columns) of each set; no two bands share keys but by accident."""
    bands = values.reshape(BANDS, ROWS, -1)
    keys = (bands * _WEIGHT[:, None]).sum(axis=1, dtype=np.uint64)
    return bytetext.mix(keys + np.arange(1, BANDS + 1, dtype=np.uint64)[:, None] * np.uint64(_STEP)).T


def _marks(words: int):
    """Of each text: a 128-bit hash of its shingle set, its size and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in bytetext.slices(batch.column(2).cast(pa.large_string())):
                n = len(offsets) - 1
                sets, begin = shingle_sets(data, offsets, words)
                size = np.diff(begin)
                some = np.flatnonzero(size)
                kind = np.zeros((2, n), dtype=np.uint64)
                lists = np.zeros((len(some), BANDS), dtype=np.uint64)
                if len(some):
                    at = begin[some]
                    for half, weight in enumerate(_WEIGHT[:2]):
                        kind[half, some] = np.add.reduceat(bytetext.mix(sets * weight), at)
                    lists = band_keys(signatures(sets, at))
                ends = np.cumsum(np.r_[0, np.where(size > 0, BANDS, 0)]).astype(np.int32)
                part = batch.slice(row, n)
                columns = [part.column(0), part.column(1), *(pa.array(k.view(np.int64)) for k in kind), pa.array(size, pa.int64())]
                columns += [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(lists).view(np.int64).ravel()))]
                yield pa.RecordBatch.from_arrays(columns, ["spot", "doc_id", "k1", "k2", "n", "keys"])

    return run


def links(sets: list[np.ndarray], percent: int, counts: dict | None = None) -> list[tuple[int, int]]:
    """Places of linked sets: not all of them, but enough to connect what is linked."""
    size = np.array([len(x) for x in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    new = np.r_[True, flat[order][1:] != flat[order][:-1]]
    start = np.flatnonzero(new)
    many = np.diff(np.r_[start, len(flat)])
    kind = np.empty(len(flat), dtype=np.int64)  # of each place in flat the number of its shingle
    kind[order] = np.cumsum(new) - 1
    holders = owner[order]
    begin = np.r_[0, np.cumsum(size)]
    commonness = np.add.reduceat(many[kind], begin[:-1])
    label, found = np.arange(len(sets)), []

    def ask(i: int) -> None:
        kinds = kind[begin[i] : begin[i + 1]]
        kinds = kinds[many[kinds] > 1]
        n = many[kinds]
        place = np.repeat(start[kinds] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shared = np.bincount(holders[place], minlength=len(sets))
        if counts is not None:
            counts["asked"] = counts.get("asked", 0) + 1
        for j in np.flatnonzero((100 * shared >= percent * (size[i] + size - shared)) & (label != label[i])):
            if label[j] != label[i]:
                found.append((i, int(j)))
                label[label == label[j]] = label[i]

    first = int(np.argmax(commonness))
    ask(first)
    for i in range(len(sets)):
        if label[i] != label[first]:
            ask(i)
    return found


def _linked(words: int, percent: int):
    """Over rows root, part, spot, text sorted by root and part: links a, b of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, spots, sets = None, [], []

        def finished() -> Iterator[pa.RecordBatch]:
            if len(sets) > 1:
                yield _pairs([(spots[i], spots[j]) for i, j in links(sets, percent)])

        for batch in batches:
            roots, parts, ids = (batch.column(i).to_pylist() for i in range(3))
            for row, data, offsets in bytetext.slices(batch.column(3).cast(pa.large_string())):
                flat, begin = shingle_sets(data, offsets, words)
                for k in range(len(offsets) - 1):
                    if (roots[row + k], parts[row + k]) != own:
                        yield from finished()
                        own, spots, sets = (roots[row + k], parts[row + k]), [], []
                    spots.append(ids[row + k])
                    sets.append(flat[begin[k] : begin[k + 1]].copy())
        yield from finished()

    return run


def _those(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of texts whose spot is among ids (column spot), by a bitmap of 4 KB for each
    32,768 spots: a small fraction of the ids' own size, and written, so that Spark knows it
    when it decides whether the texts have to be shuffled."""
    bits = write_table(ids.groupBy(F.bitmap_bucket_number("spot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits")))
    place = F.bitmap_bit_position("spot")
    byte = F.conv(F.hex(F.substring("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    lit = F.expr("shiftright(byte, cast(place % 8 as int)) & 1") == 1
    found = texts.withColumn("bucket", F.bitmap_bucket_number("spot")).join(bits, "bucket")
    return found.withColumn("place", place).withColumn("byte", byte).where(lit).select(*texts.columns)


def _links(firsts: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """node, root of the sets (id, n, keys) that are linked; texts: spot, text."""
    bands = firsts.select(F.explode("keys").alias("key"), "id")
    buckets = bands.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead <> last")
    near = bands.join(buckets, "key").where("id <> lead").select(F.col("id").alias("a"), F.col("lead").alias("b"))
    clusters = write_table(connected_components(near).join(firsts.select(F.col("id").alias("node"), "n"), "node"))
    whole = clusters.groupBy("root").agg(F.ceil(F.sum("n") / HELD).cast("int").alias("groups"))
    group = F.pmod(F.xxhash64("node"), F.col("groups")).cast("int")
    square = lambda other: F.least(group, other) * F.col("groups") + F.greatest(group, other)
    # With two groups or more, the squares of two different groups hold those of one, too.
    others = F.filter(F.sequence(F.lit(0), F.col("groups") - 1), lambda g: (g != group) | (F.col("groups") == 1))
    rows = clusters.join(whole, "root").select("root", F.explode(F.transform(others, square)).alias("part"), F.col("node").alias("spot"))
    held = _those(texts, clusters.select(F.col("node").alias("spot"))).join(rows, "spot").select("root", "part", "spot", "text")
    held = held.repartition("root", "part").sortWithinPartitions("root", "part", "spot")
    linked = connected_components(held.mapInArrow(_linked(words, percent), "a long, b long"))
    drop_table(clusters)
    return linked


def components(docs: DataFrame, words: int = 5, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles (long), component_id, kept of every row of docs.

    A text's set are the distinct shingles of so many words of the lower-cased (A-Z) text;
    of a text with fewer words, the whole sequence; of a null, empty or wordless one, none,
    and it links with nothing. Rows link if 100 |intersection| >= percent |union|. A row's
    component_id is the smallest doc_id reachable, itself included, and it is kept if that
    is its own. A null doc_id names no component: such a row has the component_id of the
    others, is kept only if there is none, and then has a null. Repeated rows are repeated,
    each of them kept if one is. Whole texts are taken, whatever their length, in memory
    that grows with the longest one. An empty table gives no rows; further columns of docs
    are ignored.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be 50 to 100: the bands are made for similar sets")
    if (1 - (percent / 100) ** ROWS) ** BANDS > MISS:
        raise ValueError(f"{BANDS} bands of {ROWS} values would miss too many pairs of that similarity")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    texts = write_table(docs.select(F.monotonically_increasing_id().alias("spot"), "doc_id", F.col("text").cast("string").alias("text")))
    schema = f"spot long, doc_id {id_type}, k1 long, k2 long, n long, keys array<long>"
    marked = write_table(texts.select("spot", "doc_id", "text").mapInArrow(_marks(words), schema))
    kind = ["k1", "k2", "n"]
    some = marked.where("n > 0")
    kinds = write_table(some.groupBy(*kind).agg(F.min("spot").alias("id"), F.min("doc_id").alias("first_id")))
    firsts = some.join(kinds.select(F.col("id").alias("spot")), "spot", "left_semi")
    firsts = write_table(firsts.select(F.col("spot").alias("id"), "n", "keys"))
    linked = _links(firsts, texts.select("spot", "text"), words, percent)
    rooted = write_table(kinds.join(linked.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = rooted.join(least, "root").select(*kind, "component_id")
    for done in (firsts, texts):
        drop_table(done)
    out = some.select("doc_id", *kind).join(labels, kind).select("doc_id", "n", "component_id")
    out = out.union(marked.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def oracle(words: int = 5, percent: int = 85) -> str:
    """SQL for components() over the table documents: all pairs that share a shingle."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""WITH RECURSIVE t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id,
 list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, unnest(CASE WHEN len(w) >= {words} THEN list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i:i + {words - 1}], ' '))
 WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM t),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.r < b.r GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * shared >= {percent} * (x.n + y.n - shared)),
g AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(a, b) AS (SELECT r, r FROM t UNION SELECT reach.a, g.b FROM reach JOIN g ON reach.b = g.a),
c AS (SELECT reach.a AS r, min(t.doc_id) AS component_id FROM reach JOIN t ON reach.b = t.r GROUP BY reach.a)
SELECT t.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, t.doc_id IS NOT DISTINCT FROM component_id AS kept
FROM t JOIN c USING (r) LEFT JOIN n USING (r)"""
