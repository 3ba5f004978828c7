import random

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from cladeforge.llm import simhash


def brute_fp(text, words=3):
    toks = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        toks = toks.replace(c, " ")
    toks = [t for t in toks.split(" ") if t]
    if not toks:
        return 0
    sh = [" ".join(toks[i : i + words]) for i in range(len(toks) - words + 1)] or [" ".join(toks)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows, words, radius):
    fps = [brute_fp(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return sorted(((d, f"{fps[i]:016x}", ids.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


@given(st.text(alphabet="aBÉ \t\n  x", max_size=40), st.integers(1, 5))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text, words):
    assert simhash.fingerprint(text.encode(), words) == brute_fp(text, words)


def test_bit_planes_match_popcounts():
    rng = random.Random(3)
    for n in (2, 60, 5000):
        base = rng.getrandbits(64)
        fps = {base ^ sum(1 << b for b in rng.sample(range(16), rng.randint(0, 4))) for _ in range(n)}
        fps = sorted(fps, key=lambda x: x - (1 << 64) if x >> 63 else x)
        import numpy as np

        arr = np.array(fps, dtype=np.uint64)
        bits = list(range(16))
        for radius in (0, 1, 2, 3):
            planes = simhash._planes(arr[:4096], bits)[0]
            lanes = (1 << min(len(fps), 4096)) - 1
            near = simhash.near_lanes(planes, bits, fps[0], lanes, radius)
            want = sum(1 << i for i, f in enumerate(fps[:4096]) if (f ^ fps[0]).bit_count() <= radius)
            assert near == want


def near_rows(n=160):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(50)]
    rows = []
    for d in range(n):
        if rows and rng.random() < 0.6:
            t = rng.choice(rows)[1].split() if rng.random() < 0.9 else []
            for _ in range(rng.randint(0, 2)):
                if t:
                    t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((d, " ".join(t)))
        else:
            rows.append((d, " ".join(rng.choice(words) for _ in range(rng.randint(0, 400)))))
    return rows + [(3, rows[3][1]), (None, rows[9][1]), (9001, None), (9002, ""), (None, "only one word here")]


def test_components_match_brute_force(spark):
    rows = near_rows()
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, root string, fp int")
    for words, radius in ((3, 2), (5, 3), (3, 1)):
        got = sorted(map(tuple, simhash.components(df, words, radius).collect()), key=str)
        assert got == brute_components(rows, words, radius)


def test_components_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.components(df).count() == 0


def test_near_dedup_keeps_one_of_each(spark):
    rows = near_rows()
    df = spark.createDataFrame([(a, b, "s") for a, b in rows], "doc_id long, text string, source string")
    out = simhash.near_dedup(df)
    assert out.columns == df.columns
    classes = {r[2] if r[2] is not None else "none" for r in brute_components(rows, 5, 3)}
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == sorted(c for c in classes if c != "none")


def shingles(text):
    t = (text or "").lower().split()
    return {" ".join(t[i : i + 5]) for i in range(max(1, len(t) - 4))} if t else set()


def copy_rows():
    """Texts of 6 to 600 words with copies of which planted edits leave a Jaccard
    similarity of about 0.80 to 0.95, some of a copy, and a phrase that most share."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(5000)}"
    phrase = [word() for _ in range(30)]
    rows = []
    for _ in range(60):
        base = [word() for _ in range(rng.choice((6, 9, 20, 60, 200, 600)))]
        if rng.random() < 0.7:
            base[3:3] = phrase
        rows.append(base)
        for _ in range(4):
            t = list(rng.choice((base, rows[-1])))
            for _ in range(max(1, round(len(t) * rng.choice((0.005, 0.01, 0.015, 0.02, 0.022))))):
                t[rng.randrange(len(t))] = word()
            rows.append(t)
    rows = [(d, " ".join(t)) for d, t in enumerate(rows)]
    return rows + [(4, rows[4][1]), (None, rows[9][1]), (9001, None), (9002, " \n"), (9003, "Only one"), (9004, "only  ONE")]


def brute_similar(rows, similarity):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    bands = [0] * 4
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            j_ = len(x & y) / len(x | y) if x | y else 1
            if j_ >= similarity:
                bands[min(3, int((j_ - 0.8) * 20))] += 1
                root[find(i)] = find(j)
    classes = {}
    for i, (d, _) in enumerate(rows):
        classes.setdefault(find(i), []).append(d)
    return sorted(min(x for x in c if x is not None) for c in classes.values()), bands


def test_near_dedup_by_similarity_matches_brute_force(spark, monkeypatch):
    rows = copy_rows()
    want, bands = brute_similar(rows, 0.8)
    assert min(bands) > 10  # pairs in each twentieth from 0.80 on
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.near_dedup(df, similarity=0.8).collect()) == want
    monkeypatch.setattr(simhash, "MANY", 20)  # the shared phrase's buckets in squares
    monkeypatch.setattr(simhash, "ORDER_TEXTS", 1)
    assert sorted(r.doc_id for r in simhash.near_dedup(df, similarity=0.8).collect()) == want


def test_within_matches_popcounts():
    rng = random.Random(4)
    import numpy as np

    fps = np.array([rng.getrandbits(64) for _ in range(300)], dtype=np.uint64)
    planes = simhash._planes(fps, list(range(64)))[0]
    for radius in (0, 3, 7, 26, 28, 31, 32):
        near = simhash.within(planes, list(range(64)), int(fps[0]), (1 << 300) - 1, radius)
        assert near == sum(1 << i for i, f in enumerate(fps) if (int(f) ^ int(fps[0])).bit_count() <= radius)


def test_sliced_buckets_find_every_pair():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(7)
    n = 9000  # more than two blocks of lanes, one bucket
    fps = rng.integers(0, 1 << 20, n) ^ (rng.integers(0, 3, n) << 40)
    sizes, at = rng.integers(90, 110, n).astype(np.int32), rng.integers(0, 20, n).astype(np.int32)
    pick = rng.integers(0, 2, n) == 0
    sizes[pick] = 5000  # these are similar to none of the others
    zero = np.zeros(n, dtype=np.int64)
    cols = [zero, zero.astype(np.int32), sizes, at, fps, np.arange(n), rng.permutation(n) // 3000]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[a : a + 1000]) for c in cols], list("kpnafic")) for a in range(0, n, 1000)]
    got = {(a, b) for x in simhash._bucket_pairs(0.8, 5, False)(iter(batches)) for a, b in zip(*map(pa.Array.to_pylist, x.columns))}
    want = set()
    for i in range(n):
        j = np.arange(i + 1, n)
        most = np.minimum(sizes[i] - at[i], sizes[j] - at[j])
        fit = (most * 1.8 >= 0.8 * (int(sizes[i]) + sizes[j]) - 1e-6) & (np.bitwise_count(fps[j] ^ fps[i]) <= 5) & (cols[6][j] != cols[6][i])
        want.update((i, int(x)) for x in j[fit])
    assert got == want and len(want) > 1000


def test_long_chains_take_few_rounds(spark, monkeypatch):
    from cladeforge.llm import common

    rounds = []
    real = common._star_round
    monkeypatch.setattr(common, "_star_round", lambda pairs: rounds.append(1) or real(pairs))
    chain = [(i, i + 1) for i in range(1000)] + [(2000 + (7 * i) % 1000, 2000 + (7 * i + 7) % 1000) for i in range(999)]
    edges = spark.createDataFrame([*chain, (5, 5), (None, 3), (3000, 3001), (3000, 3001)], "a long, b long")
    got = {r.node: r.root for r in common.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(1001)} | {2000 + i: 2000 for i in range(1000)} | {3000: 3000, 3001: 3000}
    assert len(rounds) <= 13
    assert common.connected_components(edges.limit(0)).count() == 0


def test_near_dedup_keeps_columns_of_any_name(spark):
    text = "one two three four five six seven eight nine ten " * 3
    rows = [(1, text, 8, "s"), (2, text, 9, "t"), (3, "x y", 7, "u"), (4, None, 1, None), (5, "", 2, "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spot__ int, class string")
    for similarity in (0.8, None):
        out = simhash.near_dedup(df, similarity=similarity)
        assert out.columns == df.columns and sorted(map(tuple, out.collect())) == [rows[0], rows[2], rows[3]]
