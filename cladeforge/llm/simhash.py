"""SimHash fingerprints of word shingles and their linking at a small Hamming radius.

Method: bit-sliced comparison. Fingerprints that agree on enough bit blocks to be
within the radius (pigeonhole) meet in a bucket; there the remaining bits are stored
as vertical bit planes, the distances of one fingerprint to all lanes are updated
together with carry-save counters, and a block of lanes is abandoned once every lane
has exceeded the radius.

Bounds. Buckets hold distinct fingerprints that share `width - free` bits, so at most
2**free of them, whatever the number of documents, copies or near copies: 65,536 at a
radius of 2 (8 blocks), 262,144 at 3 (12 blocks). A bucket yields a star of at most one
link per fingerprint. Copies never meet: they are one fingerprint.

A radius of 3 bits is far above a similarity of 0.8, so near_dedup() with a similarity
takes its candidates elsewhere: texts whose shingle sets have a Jaccard similarity of t
share one of the n - ceil(t n) + 1 first shingles of either, in any one order of all
shingles. The order is that of frequency in a sample, rare ones first, which says only
how many candidates there are, not which pairs are found. Distances of fingerprints, by
the same bit planes in large buckets, prune them; the shingle sets themselves decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, drop_table, unused, write_table

WIDTH = 64
#: Bit blocks of the pigeonhole split by radius; with radius 2, any 6 of the 8 form a key.
BLOCKS = {1: 4, 2: 8, 3: 12}
#: Lanes compared at once, and abandoned together.
LANES = 4096
#: Bits in which fingerprints of sets of similarity 0.8 may differ: 10 on average, more
#: than 28 in fewer than one pair of a million (small sets: about 8, by a binomial bound).
FAR = 28
#: Texts whose shingles are counted for the order, and the shingles with a known count.
ORDER_TEXTS, ORDER_SHINGLES = 10_000, 100_000
#: Rows of a bucket that are compared pair by pair, and those beyond which it is dealt out.
FEW, MANY = 64, 20_000
#: Pairs handed over at once.
HANDED = 500_000


def shingle_hashes(text: bytes | None, words: int, seed: int) -> np.ndarray:
    """Hashes of the shingles of the lower-cased (A-Z) text in turn, repeated ones too."""
    tokens = text.lower().split() if text else []
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = list(accumulate(map(len, tokens), lambda end, size: end + 1 + size))
        starts = [0, *(end + 1 for end in ends)]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :], strict=False)]
    return np.array(hashes, dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are those that more than half of the hashes have."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int.from_bytes(np.packbits(ones, bitorder="little").tobytes(), "little")


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """SimHash of the lower-cased (A-Z) UTF-8 text; null or wordless text gives 0.

    Texts of fewer words than a shingle have their whole word sequence as the only one.
    """
    return majority(shingle_hashes(text, words, seed))


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (long, the fingerprint's 64 bits as a signed number) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py(), words, seed) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {id_type}, fp long")


def _blocks(blocks: int) -> list[list[int]]:
    edges = [WIDTH * i // blocks for i in range(blocks + 1)]
    return [list(range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]


def bucket_masks(radius: int, blocks: int | None = None) -> list[int]:
    """Masks of the bits that form the keys: any two fingerprints within the radius
    agree on all bits of at least one mask."""
    blocks = blocks or BLOCKS[radius]
    split = _blocks(blocks)
    return [sum(1 << b for i in kept for b in split[i]) for kept in combinations(range(blocks), blocks - radius)]


def _planes(fps: np.ndarray, bits: list[int]) -> list[list[int]]:
    """For each block of lanes, a vertical bit plane (a big integer) per bit."""
    out = []
    for at in range(0, len(fps), LANES):
        part = fps[at : at + LANES]
        rows = [np.packbits((part >> np.uint64(b)) & np.uint64(1) != 0, bitorder="little").tobytes() for b in bits]
        out.append([int.from_bytes(row, "little") for row in rows])
    return out


def near_lanes(planes: list[int], bits: list[int], probe: int, lanes: int, radius: int) -> int:
    """Those of `lanes` (a bit set) whose fingerprint differs from probe in at most
    radius (0 to 3) of the bits. Counts by carry-save addition, saturating above 3."""
    one = two = over = 0
    for plane, bit in zip(planes, bits, strict=True):
        differs = (~plane if probe >> bit & 1 else plane) & lanes
        carry = one & differs
        one ^= differs
        over |= two & carry
        two ^= carry
        past = over | (two | one, two, one & two, 0)[radius]
        if past == lanes:
            return 0
    return lanes & ~past if bits else lanes


def star_links(fps: np.ndarray, mask: int, radius: int) -> list[tuple[int, int]]:
    """(fingerprint, smallest of its component) for the components of one bucket.

    fps: distinct fingerprints (uint64, ascending as signed numbers) equal on mask.
    """
    spread = int(np.bitwise_or.reduce(fps ^ fps[0]))
    bits = [b for b in range(WIDTH) if spread >> b & 1]
    planes = _planes(fps, bits)
    waiting = [(1 << min(LANES, len(fps) - at)) - 1 for at in range(0, len(fps), LANES)]
    links = []
    for first in range(len(fps)):
        block, lane = divmod(first, LANES)
        if not waiting[block] >> lane & 1:
            continue
        waiting[block] ^= 1 << lane
        queue = [first]
        while queue:
            probe = int(fps[queue.pop()])
            for k, lanes in enumerate(waiting):
                if not lanes or not (near := near_lanes(planes[k], bits, probe, lanes, radius)):
                    continue
                waiting[k] ^= near
                while near:
                    low = near & -near
                    found = k * LANES + low.bit_length() - 1
                    near ^= low
                    queue.append(found)
                    links.append((int(fps[found]), int(fps[first])))
    return links


def _whole_buckets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[list[np.ndarray]]:
    """The n columns of rows sorted by the first two, buckets (equal in both) undivided."""
    held: list[list[np.ndarray]] = []
    joined = lambda: [np.concatenate(c) for c in zip(*held, strict=True)]
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n)]
        if held and (cols[0][0] != held[0][0][-1] or cols[1][0] != held[0][1][-1]):
            yield joined()
            held = []
        new = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
        last = int(new[-1]) + 1 if len(new) else 0
        if last:
            held.append([c[:last] for c in cols])
            yield joined()
            held = []
        held.append([c[last:] for c in cols])
    if held:
        yield joined()


def _bucket_links(masks: list[int], radius: int):
    """Over rows t, k, fp sorted by t, k, fp: a star of links for each run of t, k."""

    def emit(table: np.ndarray, key: np.ndarray, fps: np.ndarray) -> list[tuple[int, int]]:
        cuts = np.flatnonzero((table[1:] != table[:-1]) | (key[1:] != key[:-1])) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(fps)]))
        out = []
        for a, b in zip(*(x[ends - starts > 1] for x in (starts, ends)), strict=True):
            out += star_links(fps[a:b].view(np.uint64), masks[table[a]], radius)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _whole_buckets(batches, 3):
            yield _pairs(emit(*cols))

    return run


def _pairs(links: list[tuple[int, int]] | np.ndarray) -> pa.RecordBatch:
    both = np.array(links, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])


def link_fingerprints(fps: DataFrame, radius: int = 2, blocks: int | None = None) -> DataFrame:
    """node, root for every fingerprint (column fp, distinct, not null) that links to
    another at radius or fewer differing bits, directly or through others."""
    if radius not in BLOCKS or blocks is not None and blocks <= radius:
        raise ValueError("radius must be 1 to 3, blocks more than that")
    masks = bucket_masks(radius, blocks)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = fps.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("t", "k")
    ).select("t", "k", "fp")
    edges = (
        keyed.repartition("t", "k")
        .sortWithinPartitions("t", "k", "fp")
        .mapInArrow(_bucket_links(masks, radius), "a long, b long")
    )
    return connected_components(edges)


def components(docs: DataFrame, words: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every row of docs.

    component_id is the smallest doc_id reachable over links of radius or fewer
    differing bits. Null, empty and wordless texts have the fingerprint zero and link
    like any other. A null doc_id is kept but never names a component (its own is null
    if no other row is reachable). Repeated rows are repeated; an empty table gives an
    empty result; further columns of docs are ignored.
    """
    marked = write_table(fingerprints(docs, words, seed))
    kinds = write_table(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    linked = link_fingerprints(kinds.select("fp"), radius)
    rooted = kinds.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    rooted = write_table(rooted)
    firsts = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = rooted.join(firsts, "root").select("fp", "component_id")
    return marked.join(labels, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def within(planes: list[int], bits: list[int], probe: int, lanes: int, radius: int) -> int:
    """As near_lanes(), for any radius: counters that begin so that radius + 1 overflows."""
    size = radius.bit_length()
    bias = (1 << size) - 1 - radius
    counters = [lanes if bias >> k & 1 else 0 for k in range(size)]
    over = 0
    for plane, bit in zip(planes, bits, strict=True):
        carry = (~plane if probe >> bit & 1 else plane) & lanes
        for k in range(size):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
            if not carry:
                break
        over |= carry
        if over == lanes:
            return 0
    return lanes & ~over


def _least_shared(a, b, similarity: float):
    """Shingles that sets of a and b must share to be that similar."""
    return np.ceil(similarity / (1 + similarity) * (a + b) - 1e-9)


def _sampled(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                found = np.unique(shingle_hashes(text.as_py(), words, seed))
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["h"])

    return run


def _shingle_counts(texts: DataFrame, words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of a bounded sample of the distinct texts (column text),
    ascending, and in how many of those texts each is."""
    share = min(1.0, ORDER_TEXTS / max(1, texts.count()))
    picked = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))
    counts = texts.where(picked).distinct().mapInArrow(_sampled(words, seed), "h long").groupBy("h").count()
    top = counts.where("count > 1").orderBy(F.desc("count"), "h").limit(ORDER_SHINGLES).toArrow()
    hashes, n = top.column("h").to_numpy().view(np.uint64), top.column("count").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], n[order]


def _prefixes(words: int, seed: int, similarity: float, common: np.ndarray, counts: np.ndarray):
    """Of each text a hash of its shingle set, the set's size and fingerprint, and its
    first shingles, of which similar sets share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, sizes, fps, keys = [], [], [], []
            for text in batch.column(1).cast(pa.binary()):
                found = np.unique(shingle_hashes(text.as_py(), words, seed))
                seen = np.zeros(len(found), dtype=np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
                    seen = np.where(common[at] == found, counts[at], 0)
                kinds.append(xxhash.xxh64_intdigest(found.tobytes(), seed))
                sizes.append(len(found))
                fps.append(majority(found))
                first = len(found) - math.ceil(similarity * len(found) - 1e-9) + 1 if len(found) else 0
                keys.append(found[np.lexsort((found, seen))[:first]].view(np.int64))
            ends = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
            flat = np.concatenate([np.zeros(0, dtype=np.int64), *keys])
            longs = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (kinds, fps)]
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            columns = [batch.column(0), longs[0], pa.array(sizes, pa.int32()), longs[1], lists]
            yield pa.RecordBatch.from_arrays(columns, ["spot", "kind", "n", "fp", "keys"])

    return run


def _bucket_pairs(similarity: float, radius: int, stars: bool):
    """Over rows key, part, n, at, fp, id, class sorted by key and part: pairs a < b of
    different classes of a bucket that can be similar as far as sizes, places and
    fingerprints say; with stars only some, so that each row is in one pair with another
    that leads it."""

    def fitting(cols: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        _, _, n, at, fps, _, classes = cols
        # What two sets can share if this is the first shingle that they do.
        most = np.minimum(n[i] - at[i], n[j] - at[j])
        near = np.bitwise_count(fps[i].view(np.uint64) ^ fps[j].view(np.uint64)) <= radius
        return near & (classes[i] != classes[j]) & (most >= _least_shared(n[i], n[j], similarity))

    def paired(cols: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = cols[5][i], cols[5][j]
        return np.column_stack((np.minimum(a, b), np.maximum(a, b)))

    def sliced(cols: list[np.ndarray]) -> Iterator[np.ndarray]:
        _, number, size = np.unique(cols[6], return_inverse=True, return_counts=True)
        # The rows of one largest class come last: they need not look for each other.
        largest = len(size) - 1 - int(np.argmax(size[::-1]))
        order = np.argsort(number == largest, kind="stable")
        cols = [c[order] for c in cols]
        probes = len(cols[0]) - int(size.max())
        fps = cols[4].view(np.uint64)
        bits = list(range(WIDTH))
        planes = _planes(fps, bits) if probes else []
        waiting = [(1 << min(LANES, len(fps) - at)) - 1 for at in range(0, len(fps), LANES)]
        for k in range(probes):
            block, lane = divmod(k, LANES)
            if not waiting[block] >> lane & 1:
                continue
            waiting[block] ^= 1 << lane
            for place in range(block, len(planes)):
                lanes = waiting[place]
                near = within(planes[place], bits, int(fps[k]), lanes, radius) if lanes else 0
                if not near:
                    continue
                lit = np.frombuffer(near.to_bytes(LANES // 8, "little"), dtype=np.uint8)
                j = place * LANES + np.flatnonzero(np.unpackbits(lit, bitorder="little"))
                i = np.full(len(j), k)
                fit = fitting(cols, i, j)
                yield paired(cols, i[fit], j[fit])
                if stars:
                    led = np.zeros(LANES, dtype=bool)
                    led[j[fit] - place * LANES] = True
                    waiting[place] ^= int.from_bytes(np.packbits(led, bitorder="little").tobytes(), "little")

    def emit(cols: list[np.ndarray]) -> Iterator[np.ndarray]:
        key, part = cols[:2]
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(key)]))
        size = ends - starts
        for a, b in zip(starts[size > FEW], ends[size > FEW], strict=True):
            yield from sliced([c[a:b] for c in cols])
        some = (size > 1) & (size <= FEW)
        if not some.any():
            return
        few = [c[np.repeat(some, size)] for c in cols]
        if stars:
            first = np.repeat(np.cumsum(size[some]) - size[some], size[some])
            i = np.arange(len(first))
            fit = fitting(few, first, i)
            yield paired(few, first[fit], i[fit])
            return
        for d in range(1, FEW):
            i = np.flatnonzero((few[0][d:] == few[0][:-d]) & (few[1][d:] == few[1][:-d]))
            if not len(i):
                break
            i = i[fitting(few, i, i + d)]
            yield paired(few, i, i + d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            found, n = [], 0
            for pairs in emit(cols):
                found.append(pairs)
                n += len(pairs)
                if n > HANDED:
                    yield _pairs(np.unique(np.concatenate(found), axis=0))
                    found, n = [], 0
            if n:
                yield _pairs(np.unique(np.concatenate(found), axis=0))

        for cols in _whole_buckets(batches, 7):
            yield from done(cols)

    return run


def _similar(words: int, seed: int, similarity: float):
    """Those of the pairs a, b whose shingle sets are as similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for r, (one, two) in enumerate(zip(*(batch.column(i).cast(pa.binary()) for i in (2, 3)), strict=True)):
                x, y = (np.unique(shingle_hashes(t.as_py(), words, seed)) for t in (one, two))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep[r] = shared >= _least_shared(len(x), len(y), similarity)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def similar_components(texts: DataFrame, similarity: float, words: int = 5, seed: int = 42) -> DataFrame:
    """spot, class of every row of texts (spot, a distinct long; text): rows of one class
    are linked by Jaccard similarities of that or more, directly or through others.

    Equal shingle sets meet once. A shingle that more than MANY sets begin with is dealt
    out to squares of groups, so no task gets all of them. Buckets first give stars, at
    most a pair for each row, and then all pairs that the confirmed ones have not linked:
    a large group of near copies never gives its pairs.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0, at most 1")
    texts = texts.select("spot", F.col("text").cast("string").alias("text"))
    order = _shingle_counts(texts.select("text"), words, seed)
    schema = "spot long, kind long, n int, fp long, keys array<long>"
    marked = write_table(texts.mapInArrow(_prefixes(words, seed, similarity, *order), schema))
    kind = ["kind", "n", "fp"]
    kinds = write_table(marked.groupBy(*kind).agg(F.min("spot").alias("id")))
    firsts = marked.join(kinds.select(F.col("id").alias("spot")), "spot", "left_semi")
    firsts = write_table(firsts.select(F.col("spot").alias("id"), "n", "fp", "keys"))
    counts = firsts.select(F.explode("keys").alias("key")).groupBy("key").count()
    heavy = counts.where(F.col("count") > MANY).select("key", F.ceil(F.col("count") / MANY).cast("int").alias("groups"))
    heavy = write_table(heavy)

    def candidates(labelled: DataFrame, stars: bool) -> DataFrame:
        keyed = labelled.select(F.posexplode("keys").alias("at", "key"), "n", "fp", "id", "class")
        dealt = keyed.join(F.broadcast(heavy), "key", "left")  # at most a row for each MANY of keyed
        group = F.pmod(F.xxhash64("id"), F.col("groups")).cast("int")
        squares = F.transform(
            F.sequence(F.lit(0), F.col("groups") - 1),
            lambda other: F.least(group, other) * F.col("groups") + F.greatest(group, other),
        )
        part = F.explode(F.when(F.col("groups").isNull(), F.array(F.lit(0))).otherwise(squares))
        rows = dealt.select("key", part.alias("part"), "n", "at", "fp", "id", "class").repartition("key", "part")
        run = _bucket_pairs(similarity, FAR, stars)
        return write_table(rows.sortWithinPartitions("key", "part", "id").mapInArrow(run, "a long, b long").distinct())

    def confirmed(some: DataFrame) -> DataFrame:
        ends = some.select(F.col("a").alias("spot")).union(some.select(F.col("b").alias("spot"))).distinct()
        needed = write_table(texts.join(ends, "spot", "left_semi"))
        for end in ("a", "b"):
            some = some.join(needed.select(F.col("spot").alias(end), F.col("text").alias(f"text_{end}")), end)
        some = some.select("a", "b", "text_a", "text_b")
        edges = write_table(some.mapInArrow(_similar(words, seed, similarity), "a long, b long"))
        drop_table(needed)
        return edges

    tried = candidates(firsts.withColumn("class", F.col("id")), True)
    edges = confirmed(tried)
    roots = connected_components(edges).withColumnRenamed("node", "id")
    labelled = firsts.join(roots, "id", "left").withColumn("class", F.coalesce("root", "id"))
    edges = edges.union(confirmed(candidates(labelled, False).join(tried, ["a", "b"], "left_anti")))
    drop_table(firsts)
    linked = connected_components(edges)
    rooted = kinds.join(linked.withColumnRenamed("node", "id"), "id", "left")
    rooted = rooted.select(*kind, F.coalesce("root", "id").alias("class"))
    return marked.select("spot", *kind).join(rooted, kind).select("spot", "class")


def near_dedup(
    docs: DataFrame, words: int = 5, radius: int = 3, seed: int = 42, similarity: float | None = None
) -> DataFrame:
    """docs without near copies: of each component, the row of the smallest doc_id stays.

    Shingles of five words. With a similarity, texts whose shingle sets have that Jaccard
    similarity or more are linked, and the radius has no part; without one, texts of three
    differing bits or fewer, which stand for a similarity far above 0.8. Rows with a null
    doc_id stay only if no row of their component has one. Of rows that repeat the kept
    doc_id, one stays. Null and wordless texts are copies of each other. Columns are those
    of docs, whatever their names; an empty table gives no rows.
    """
    names = docs.columns
    spot = unused("spot__", names)
    held = write_table(docs.withColumn(spot, F.monotonically_increasing_id()))
    marked = held.select(F.col(spot).alias("spot"), "text")
    if similarity is None:
        keyed = components(marked.toDF("doc_id", "text"), words, radius, seed).toDF("spot", "fp", "class")
    else:
        keyed = similar_components(marked, similarity, words, seed)
    ids = held.select(F.col(spot).alias("spot"), "doc_id").join(keyed.select("spot", "class"), "spot")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "spot")
    kept = ids.groupBy("class").agg(F.min(order).alias("first")).select(F.col("first.spot").alias(spot))
    return held.join(kept, spot, "left_semi").select(*names)
