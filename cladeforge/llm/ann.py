"""Approximate nearest neighbours by cosine.

Method: hash-prefix forest over the whole table. In each of TREES trees a vector has a long
hash string of SYMBOLS symbols; a symbol is the axis, with its sign, along which a random
rotation of the vector lies furthest, so near vectors share it far more often than they
would a few signs of hyperplanes. Every tree is an array of the strings, sorted, which
Spark deals out by tree and first symbol. A query descends each tree to its longest
matching prefix and then ascends all trees together, a symbol at a time, until `budget`
candidates share the prefix. Those are compared by vectors rounded to bytes, and the KEPT
best of each query exactly.

How many are enough is found once: for a bounded sample of the queries the true neighbours
are looked up among all rows, and the budget is the smallest that would find TARGET of them.
Where no budget would, as on vectors with hardly any structure, queries ascend to the root,
that is, meet all rows. On white noise of 64 components first symbols are enough, but some
two fifths of all rows share one in some tree.
Equal vectors are indexed as one, of which the k + 1 rows of smallest vec_id can be results,
so no crowd of copies makes an array long; a query that has fewer than k candidates even at
its first symbols ascends to the root, that is, meets all rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectors
from .common import write_table

TREES, SYMBOLS = 54, 8
#: Bits of a symbol: axes beyond half of their number are not told apart from others.
BITS = 7
SEED = 7
#: Share of true neighbours that the sampled queries must find, and how many are sampled.
TARGET, SAMPLE = 0.93, 200
#: Candidates of a query that are scored exactly.
KEPT = 64
#: Strings of a stretch of an array on average, and those beyond which one is dealt out.
STRETCH, ARRAY_ROWS = 16_384, 500_000


def hash_strings(x: np.ndarray, trees: int = TREES, seed: int = SEED) -> np.ndarray:
    """The hash string of each vector in each tree, as a number, its first symbol highest."""
    dim = x.shape[1]
    axes = min(dim, 1 << BITS - 1)
    out = np.zeros((len(x), trees), dtype=np.int64)
    rng = np.random.default_rng([seed, dim])
    for t in range(trees):
        for _ in range(SYMBOLS):
            turned = x @ np.linalg.qr(rng.standard_normal((dim, dim)) if dim <= 512 else rng.standard_normal((dim, axes)))[0][:, :axes]
            furthest = np.abs(turned).argmax(axis=1)
            sign = turned[np.arange(len(x)), furthest] > 0
            out[:, t] = out[:, t] << BITS | 2 * furthest + sign
    return out


def shared_symbols(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of strings."""
    out = np.zeros(np.broadcast(a, b).shape, dtype=np.int64)
    for length in range(1, SYMBOLS + 1):
        out += (a ^ b) >> BITS * (SYMBOLS - length) == 0
    return out


def prefix_ranges(strings: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end place among sorted strings of what shares 1, 2 ... symbols with asked."""
    rest = BITS * (SYMBOLS - np.arange(1, SYMBOLS + 1))[:, None]
    low = asked[None, :] >> rest << rest
    first = np.searchsorted(strings, low, "left")
    return first, np.searchsorted(strings, low + (np.int64(1) << rest) - 1, "right")


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the rows of a with those of b, in double precision."""
    return (a * b).sum(axis=-1) / (np.sqrt((a * a).sum(axis=-1)) * np.sqrt((b * b).sum(axis=-1)))


def rounded(x: np.ndarray) -> np.ndarray:
    """Unit vectors as whole numbers of a byte, scaled by the largest component of each."""
    return np.rint(x * (127 / np.abs(x).max(axis=1, keepdims=True))).astype(np.int8)


def _coder(batches):
    """kind, dim, codes, bytes, scale of kind, dim, v."""
    for batch in batches:
        if not batch.num_rows:
            continue
        dims, lists = batch.column(1).to_numpy(), batch.column(2)
        for dim in np.unique(dims):
            part = batch.filter(pa.array(dims == dim))
            x = vectors.matrix(part, "v")
            codes = hash_strings(x / np.linalg.norm(x, axis=1, keepdims=True))
            small = rounded(x)
            norms = np.sqrt((small.astype(np.float64) ** 2).sum(axis=1))
            offsets = pa.array((np.arange(len(x) + 1) * TREES).astype(np.int32))
            columns = [*part.columns[:2], pa.ListArray.from_arrays(offsets, pa.array(codes.ravel())), pa.array([r.tobytes() for r in small], pa.binary()), pa.array(norms)]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "dim", "codes", "bytes", "norm"])


def _own_brute(k: int):
    """The k best by cosine of a block of queries and candidates, for vectors.in_blocks()."""

    def block(q, q_rows, c, c_ids, c_rows):
        unit_q, unit_c = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (q, c))
        found = []
        for at in range(0, len(q), 256):
            near = unit_q[at : at + 256] @ unit_c.T
            near[q_rows[at : at + 256][:, None] == c_rows[None, :]] = -np.inf
            least = np.partition(near, -min(k, len(c)), axis=1)[:, -min(k, len(c))]
            qi, ci = np.nonzero(near >= np.maximum(least[:, None] - 1e-9, -2))  # rounding can't hide one of the best
            score = cosine(q[at + qi], c[ci])
            kept = vectors.best(qi, ci, score, c_ids, k)
            found.append((qi[kept] + at, ci[kept], score[kept]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    return block


class Forest:
    """The index of all usable rows of a table, and searches in it."""

    def __init__(self, rows: DataFrame, k: int):
        self.rows, self.k = rows, k
        same = Window.partitionBy("v").orderBy("vec_id", "row")
        few = rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)
        few = few.groupBy("dim", "v").agg(F.min("row").alias("kind"), F.collect_list(F.struct("vec_id", "row")).alias("members"))
        self.kinds = write_table(few.select("kind", "dim", "v", "members"))
        schema = "kind long, dim int, codes array<long>, bytes binary, norm double"
        self.coded = write_table(self.kinds.select("kind", "dim", "v").mapInArrow(_coder, schema))
        # The arrays are dealt out in stretches by the first bits of the strings, at most
        # those of a symbol, and stretches that are too long to several tasks; all of a
        # query's counts and candidates add up. There are TREES x 128 stretches at most.
        self.bits = min(BITS, max(0, math.ceil(math.log2(max(1, self.coded.count()) / STRETCH))))
        each = self.coded.select("dim", F.posexplode("codes").alias("tree", "code"))
        sizes = each.groupBy("dim", "tree", self._first()).agg(F.count(F.lit(1)).alias("n"))
        self.parts = write_table(sizes.select("dim", "tree", "first", F.ceil(F.col("n") / ARRAY_ROWS).cast("int").alias("parts")))

    def _first(self):
        return F.shiftright("code", BITS * SYMBOLS - self.bits).cast("int").alias("first")

    def _strings(self, table: DataFrame, *more: str) -> DataFrame:
        each = table.select("dim", F.posexplode("codes").alias("tree", "code"), *more).select("dim", "tree", self._first(), "code", *more)
        return each.join(F.broadcast(self.parts), ["dim", "tree", "first"])  # TREES x 128 rows a length

    def _met(self, queries: DataFrame, more: tuple[str, ...], index: tuple[str, ...], run, schema: str) -> DataFrame:
        """Runs run(queries, strings) for each array, of queries coded as the index is."""
        key = ["dim", "tree", "first", "part"]
        part = F.pmod(F.xxhash64("kind"), F.col("parts")).cast("int").alias("part")
        right = self._strings(self.coded, "kind", *index).select(*key[:3], part, "code", "kind", *index)
        right = right.toDF(*[c if c == "code" else f"c_{c}" for c in right.columns])
        every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
        left = self._strings(queries, "kind", *more).select(*key[:3], every, "code", "kind", *more)
        return left.groupBy(*key).cogroup(right.groupBy(*(f"c_{c}" for c in key))).applyInArrow(run, schema)

    def reach(self, queries: DataFrame) -> DataFrame:
        """kind, length, n: how many strings share so many symbols with each query, over all trees."""
        fields = pa.schema([("kind", pa.int64()), ("length", pa.int32()), ("n", pa.int64())])

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return fields.empty_table()
            first, end = prefix_ranges(np.sort(right.column("code").to_numpy()), left.column("code").to_numpy())
            length, place = np.nonzero(end - first)
            values = left.column("kind").to_numpy()[place], (length + 1).astype(np.int32), (end - first)[length, place]
            return pa.table([pa.array(v, f.type) for v, f in zip(values, fields, strict=True)], schema=fields)

        found = self._met(queries, (), (), run, "kind long, length int, n long")
        return found.groupBy("kind", "length").agg(F.sum("n").alias("n"))

    def candidates(self, queries: DataFrame) -> DataFrame:
        """kind, c_kind: the KEPT best candidates, by bytes, of queries that have a column
        length to ascend to."""
        fields = pa.schema([("kind", pa.int64()), ("c_kind", pa.int64()), ("near", pa.float32())])

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return fields.empty_table()
            codes = right.column("code").to_numpy()
            order = np.argsort(codes, kind="stable")
            first, end = prefix_ranges(codes[order], left.column("code").to_numpy())
            read = lambda t, name: np.frombuffer(b"".join(t.column(name).to_pylist()), dtype=np.int8).reshape(t.num_rows, -1)
            q, c = read(left, "bytes").astype(np.float32), read(right, "c_bytes")[order].astype(np.float32)
            c /= right.column("c_norm").to_numpy()[order].astype(np.float32)[:, None]
            kinds, mine = right.column("c_kind").to_numpy()[order], left.column("kind").to_numpy()
            lengths = left.column("length").to_numpy()
            out, scores = [], []
            for i, length in enumerate(lengths):
                a, b = first[length - 1, i], end[length - 1, i]
                near, some = c[a:b] @ q[i], np.arange(a, b)
                if b - a > KEPT:
                    best = np.argpartition(-near, KEPT - 1)[:KEPT]
                    near, some = near[best], some[best]
                out.append(some)
                scores.append(near)
            values = np.repeat(mine, [len(x) for x in out]), kinds[np.concatenate(out)], np.concatenate(scores)
            return pa.table([pa.array(v, f.type) for v, f in zip(values, fields, strict=True)], schema=fields)

        found = self._met(queries, ("length", "bytes"), ("bytes", "norm"), run, "kind long, c_kind long, near float")
        once = found.groupBy("kind", "c_kind").agg(F.max("near").alias("near"))
        order = Window.partitionBy("kind").orderBy(F.desc("near"), "c_kind")
        return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= KEPT).select("kind", "c_kind")

    def budget(self, queries: DataFrame, reach: DataFrame, target: float) -> int | None:
        """The least number of candidates with which the sampled queries find their neighbours,
        None if only the root has enough.

        Gathers SAMPLE queries, and of each k neighbours and SYMBOLS counts.
        """
        some = queries.orderBy(F.xxhash64("kind"), "kind").limit(SAMPLE).select("kind")
        some = write_table(self.kinds.join(F.broadcast(some), "kind"))  # SAMPLE rows
        as_rows = lambda df: df.select(F.col("kind").alias("row"), F.col("kind").alias("vec_id"), "dim", "v")
        near = vectors.in_blocks(as_rows(some), as_rows(self.kinds), self.k, "double", _own_brute(self.k))
        order = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id")
        near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.k).select("q_row", "c_row")
        codes = lambda name: self.coded.select(F.col("kind").alias(name), F.col("codes").alias(f"{name}_codes"))
        pairs = near.join(codes("q_row"), "q_row").join(codes("c_row"), "c_row").toArrow()
        counts = reach.join(F.broadcast(some.select("kind")), "kind").collect()
        sizes = {r["kind"]: [0] * SYMBOLS for r in counts}
        for r in counts:
            sizes[r["kind"]][r["length"] - 1] = r["n"]
        if not pairs.num_rows:
            return 1
        deep = shared_symbols(*(vectors.matrix(pairs, f"{n}_codes") for n in ("q_row", "c_row"))).max(axis=1)
        # A pair is found with any budget above what a longer prefix gives.
        owners = pairs.column("q_row").to_pylist()
        needed = [sizes[q][d] + 1 if d < SYMBOLS and q in sizes else 1 for q, d in zip(owners, deep.tolist(), strict=True)]
        reachable = sorted(n for n, d in zip(needed, deep, strict=True) if d > 0)
        wanted = math.ceil(target * len(needed))
        return reachable[wanted - 1] if wanted <= len(reachable) else None


def nearest(table: DataFrame, k: int = 5, every: int = 50, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: of each query the k nearest rows found.

    Queries are the rows whose vec_id is divisible by `every`; every row is indexed and
    a candidate, but for the query's own. Scores are exact cosines of the original
    vectors; ties go to the smaller vec_id. Zero vectors and rows that vectors.usable()
    drops take no part, and a query meets the candidates of its own length; repeated rows
    are indexed each; an empty table gives no rows; further columns are ignored.
    """
    rows = vectors.usable(table, nonzero=True)
    forest = Forest(rows, k)
    asked = write_table(
        rows.where(F.col("vec_id") % every == 0).select("row", "vec_id", "v").join(forest.kinds.select("kind", "v"), "v").select("row", "vec_id", "kind")
    )
    queries = forest.coded.join(asked.select("kind").distinct(), "kind")
    reach = write_table(forest.reach(queries))
    enough = forest.budget(queries, reach, target)
    if enough is None:
        return vectors.search(rows, F.col("vec_id") % every == 0, k, "double", _own_brute(k))
    enough = max(enough, 2 * k)
    # The longest prefix with enough candidates; the first symbol alone where none has.
    lengths = reach.groupBy("kind").agg(F.coalesce(F.max(F.when(F.col("n") >= enough, F.col("length"))), F.lit(1)).alias("length"))
    pairs = forest.candidates(queries.join(lengths, "kind"))
    # Members of the candidates for each query row, but itself, and exact scores.
    own = asked.join(forest.kinds.select("kind", F.col("v").alias("q_v")), "kind").select("kind", F.col("row").alias("q_row"), F.col("vec_id").alias("query_id"), "q_v")
    met = pairs.join(own, "kind").join(forest.kinds.select(F.col("kind").alias("c_kind"), "v", "members"), "c_kind")
    schema = "q_row long, query_id long, score double, members array<struct<vec_id: long, row: long>>"

    def scored(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows)
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            for dim in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dim))
                out[sizes == dim] = cosine(vectors.matrix(part, "q_v"), vectors.matrix(part, "v"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out), batch.column(4)], ["q_row", "query_id", "score", "members"])

    found = met.select("q_row", "query_id", "q_v", "v", "members").mapInArrow(scored, schema)
    found = found.select("q_row", "query_id", "score", F.inline("members")).where("row <> q_row")
    found = write_table(found.select("q_row", "query_id", "vec_id", F.col("row").alias("c_row"), "score"))
    # Queries that are short of candidates meet all rows.
    enough_found = found.groupBy("q_row").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select(F.col("q_row").alias("row"))
    short = write_table(rows.where(F.col("vec_id") % every == 0).join(enough_found, "row", "left_anti"))
    if not short.isEmpty():
        more = vectors.in_blocks(short, rows, k, "double", _own_brute(k))
        found = found.join(short.select(F.col("row").alias("q_row")), "q_row", "left_anti").unionByName(more)
    return vectors.ranked(found, k)
