import hashlib
import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cladeforge.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, cluster string, v int"


def brute(rows, k, rounds, dim, scale=256):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    c = [v for _, v in sorted(kept, key=key)[:k]]
    far = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w))
    own = lambda v: min((far(v, w), j) for j, w in enumerate(c))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(own(v)[1], []).append(v)
        c = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if j in groups else w for j, w in enumerate(c)]
    found = [(i, *own(v)) for i, v in kept]
    per = {j: sum(d for _, d, jj in found if jj == j) for _, _, j in found}
    whole = sum(d for _, d, _ in found)
    digest = lambda j: hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()
    return sorted(((i, j, d, per[j], whole, digest(j)) for i, d, j in found), key=str)


def rows_with_odd_ones(seed=1, n=300, dim=5):
    rng = random.Random(seed)
    rows = [(i, [round(rng.gauss(rng.choice((-1, 0, 2)), 0.3), 2) for _ in range(dim)]) for i in range(n)]
    rows += [(i, rows[i][1]) for i in range(40)] + [(i + n, rows[7][1]) for i in range(60)]  # repeated rows, copies
    rows += [(None, rows[3][1]), (900, None), (901, []), (902, [1.0]), (903, [None] * dim), (904, [float("nan")] * dim), (905, [float("-inf")] * dim)]
    return rows


def test_cluster_matches_brute_force(spark):
    rows = rows_with_odd_ones()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(7)
    for k, rounds in ((1, 1), (7, 3), (12, 5)):
        got = sorted(map(tuple, centroids.cluster(df, k, rounds, 5).collect()), key=str)
        assert got == brute(rows, k, rounds, 5)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [5.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert sorted(map(tuple, centroids.cluster(df, 40, 5, 2).collect()), key=str) == brute(rows, 40, 5, 2)
    none = centroids.cluster(df, 40, 5, 3)
    assert none.collect() == [] and none.columns == centroids.cluster(df, 40, 5, 2).columns


def test_values_beyond_the_held_range(spark):
    df = spark.createDataFrame([(1, [1e300, -1e300], "x", 1), (2, [0.0, 0.0], "x", 1)], SCHEMA)
    got = {r.vec_id: r for r in centroids.cluster(df, 1, 1, 2).collect()}
    assert got[1].distance == got[2].distance == 2 * (centroids.HELD // 2) ** 2


@given(st.integers(0, 2**32), st.sampled_from([3, 300, 1 << 20, 1 << 27]), st.integers(1, 64))
@settings(max_examples=60, deadline=None)
def test_screen_keeps_the_nearest(seed, size, dim):
    rng = np.random.default_rng(seed)
    c = rng.integers(-size, size, (9, dim))
    c[4] = c[2]
    c[5] = c[2]
    c[5, 0] = max(c[5, 0] - 1, -size)
    x = np.vstack([rng.integers(-size, size, (30, dim)), c, (c[2] + c[3]) // 2])  # the last lies between two
    exact = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w)) for w in c] for v in x], dtype=object)
    number, distance = centroids.nearest(x, c)
    assert [int(d) for d in distance] == [min(row) for row in exact]
    assert number.tolist() == [int(np.argmin(row.astype(float) if size < 1 << 20 else [0 if d == min(row) else 1 for d in row])) for row in exact]


def test_screen_leaves_few_to_compare():
    rng = np.random.default_rng(5)
    x, c = np.floor(256 * rng.normal(size=(5000, 64))).astype(np.int64), np.floor(256 * rng.normal(size=(40, 64))).astype(np.int64)
    counts = {}
    centroids.nearest(x, c, counts)
    assert counts["exact"] < 0.001 * counts["pairs"]
