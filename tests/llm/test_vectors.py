import math
import random

import numpy as np

from cladeforge.llm import ann, topk


def table(spark, n=900, dim=12, seed=2):
    rng = random.Random(seed)
    rows = [(i, [round(rng.gauss(0, 0.3), 2) for _ in range(dim)], "x") for i in range(n)]
    rows += [(i + n, rows[i][1], "copy") for i in range(0, 60)]
    rows += [(20, rows[3][1], "again"), (5000, None, "null"), (5020, [None] * dim, "n"), (5040, [float("nan")] * dim, "nan")]
    rows += [(5060, [float("inf")] * dim, "inf"), (5080, [0.0] * dim, "zero"), (None, rows[5][1], "no id"), (6000, [1.0], "short")]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, row string")


def brute(rows, every, k, score, keep):
    dim = 12
    good = [(i, v) for i, v, _ in rows if i is not None and v and len(v) == dim and all(x is not None and math.isfinite(x) for x in v) and keep(v)]
    out = []
    for a, (i, v) in enumerate(good):
        if i % every == 0:
            s = sorted((-score(v, w), j) for b, (j, w) in enumerate(good) if b != a)[:k]
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out)


def test_top_k_matches_brute_force(spark):
    rows, df = table(spark)
    dot = lambda v, w: sum(math.floor(64 * a) * math.floor(64 * b) for a, b in zip(v, w))
    for k in (1, 20):
        got = sorted(map(tuple, topk.top_k(df, k).collect()))
        assert got == brute(rows, 20, k, dot, lambda v: True)


def test_top_k_blocks(spark, monkeypatch):
    from cladeforge.llm import vectors

    monkeypatch.setattr(vectors, "BLOCK_ROWS", 64)
    rows, df = table(spark)
    dot = lambda v, w: sum(math.floor(64 * a) * math.floor(64 * b) for a, b in zip(v, w))
    assert sorted(map(tuple, topk.top_k(df, 7).collect())) == brute(rows, 20, 7, dot, lambda v: True)


def test_bounds_prune():
    rng = np.random.default_rng(1)
    rows = np.arange(2000)
    for steps, share in ((1, 0.8), (4, 0.2)):  # white noise, and vectors with slow steps
        c = np.floor(64 * np.repeat(rng.normal(size=(2000, 64 // steps)), steps, axis=1)).astype(np.int64)
        counts = {}
        topk.block_search(c[:100], rows[:100], c, rows, rows, 20, counts)
        assert counts["exact"] < share * counts["pairs"]


def test_nearest_recall_and_scores(spark):
    rows, df = table(spark, n=3000)
    cos = lambda v, w: sum(a * b for a, b in zip(v, w)) / math.sqrt(sum(a * a for a in v)) / math.sqrt(sum(b * b for b in w))
    want = brute(rows, 50, 5, cos, any)
    got = ann.nearest(df).collect()
    assert sorted({r.query_id for r in got}) == sorted({w[0] for w in want})
    hits = len({(r.query_id, r.vec_id) for r in got} & {(w[0], w[2]) for w in want})
    assert hits >= 0.9 * len(want)
    vec = {}
    for i, v, _ in rows:
        vec.setdefault(i, []).append(v)
    for r in got:
        assert min(abs(r.score - cos(a, b)) for a in vec[r.query_id] for b in vec[r.vec_id]) < 1e-12


def test_forest_reads_a_small_part_of_the_table(spark):
    """On white noise, the hardest case, of the 0.1 tables."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = np.array([r.embedding for r in df.orderBy("vec_id").collect()], dtype=np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    asked = np.arange(0, len(x), 50)
    near = unit[asked] @ unit.T
    near[np.arange(len(asked)), asked] = -2
    want = {(int(q), int(c)) for q, row in zip(asked, near) for c in np.argsort(-row)[:5]}
    reads = []
    real = ann.Forest.candidates

    def counted(self, queries):
        ask = self.reach(queries.drop("length")).join(queries.select("kind", "length"), ["kind", "length"])
        reads.append(ask.groupBy().sum("n").first()[0])
        return real(self, queries)

    ann.Forest.candidates = counted
    try:
        got = {(r.query_id, r.vec_id) for r in ann.nearest(df).collect()}
    finally:
        ann.Forest.candidates = real
    assert len(got & want) >= 0.9 * len(want)
    assert reads[0] < 0.45 * len(asked) * len(x)  # over all trees, repeated ones counted each time


def test_forest_reads_little_of_vectors_with_structure(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(100, 48))
    x = (np.repeat(centres, 30, axis=0) + 0.1 * rng.normal(size=(3000, 48))).round(4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    asked = np.arange(0, len(x), 50)
    near = unit[asked] @ unit.T
    near[np.arange(len(asked)), asked] = -2
    want = {(int(q), int(c)) for q, row in zip(asked, near) for c in np.argsort(-row)[:5]}
    rows = ann.vectors.usable(df, nonzero=True)
    forest = ann.Forest(rows, 5)
    queries = forest.coded.join(rows.where("vec_id % 50 = 0").select(ann.F.col("row").alias("kind")), "kind")
    reach = forest.reach(queries)
    enough = forest.budget(queries, reach, ann.TARGET)
    lengths = reach.where(ann.F.col("n") >= enough).groupBy("kind").agg(ann.F.max("length").alias("length"))
    read = reach.join(lengths, ["kind", "length"]).groupBy().sum("n").first()[0]
    assert read < 0.2 * len(asked) * len(x)
    got = {(r.query_id, r.vec_id) for r in ann.nearest(df).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_ties_and_copies(spark):
    rows = [(i, [1.0, 0.5, 0.25]) for i in range(300)] + [(300, [-1.0, 0.0, 0.0]), (301, [0.0, 0.0, 0.0]), (302, [2.0, 1.0, 0.5])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert by[0] == [1, 2, 3, 4, 5] and by[50] == [0, 1, 2, 3, 4] and by[300] == [0, 1, 2, 3, 4]


def test_small_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (50, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r)[:3] for r in ann.nearest(df).orderBy("query_id").collect()] == [(0, 1, 50), (50, 1, 0)]
    assert topk.top_k(df).count() == 1
    none = df.limit(0)
    assert ann.nearest(none).count() == 0 and topk.top_k(none).count() == 0
