import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cladeforge.llm import bytetext, minhash

SCHEMA = "doc_id long, text string, n long, class string, spot int"


def shingles(text, words=5):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    toks = [t for t in text.split(" ") if t]
    return {" ".join(toks[i : i + words]) for i in range(len(toks) - words + 1)} or ({" ".join(toks)} if toks else set())


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), c := least.get(find(i)), d == c) for i, (d, _) in enumerate(rows)), key=str)


def got(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(5)
    return sorted(map(tuple, minhash.components(df, **kw).collect()), key=str)


def corpus(seed=4):
    """Groups of edited copies at all similarities around the bound, and odd rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdEFGé") for _ in range(rng.randint(1, 6)))
    rows = []
    for _ in range(30):
        base = [word() for _ in range(rng.choice((6, 9, 40, 200, 800)))]
        for _ in range(8):
            copy = [word() if rng.random() < rng.choice((0, 0.01, 0.02, 0.03)) else w for w in base]
            rows.append((len(rows), rng.choice((" ", "\n")).join(copy)))
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "ONE "), (905, "one two"), (3, "one"), (None, "one two"), (None, "alone"), (None, None)]
    return rows + [(i, rows[i][1]) for i in (5, 6, 7)] + [(1000 + i, rows[9][1].upper()) for i in range(50)]


def test_components_match_brute_force(spark):
    rows = corpus()
    want = brute(rows)
    assert got(spark, rows) == want
    assert 40 < sum(r[3] for r in want) < 260


def test_clusters_dealt_out_to_squares(spark, monkeypatch):
    monkeypatch.setattr(minhash, "HELD", 800)
    rng = random.Random(8)
    rows = [(0, " ".join(f"w{k}" for k in range(120)))]
    for i in range(1, 60):  # a chain: neighbours are similar, its ends are not
        words = rows[-1][1].split()
        words[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words)))
    assert got(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_a_very_long_text(spark):
    rng = random.Random(3)
    words = [str(rng.randrange(10**6)) for _ in range(150_000)]
    assert got(spark, [(1, " ".join(words)), (2, " ".join(words[:140_000])), (3, " ".join(words[:70_000]))]) == [(1, 149_996, 1, True), (2, 139_996, 1, False), (3, 69_996, 3, True)]


@given(st.lists(st.text(alphabet="aB é\t\n", max_size=60), max_size=5), st.integers(1, 6))
@settings(max_examples=150, deadline=None)
def test_shingle_sets(texts, words):
    for row, data, offsets in bytetext.slices(pa.array(texts, pa.large_string())):
        assert row == 0
        sets, begin = minhash.shingle_sets(data, offsets, words)
        assert np.diff(begin).tolist() == [len(shingles(t, words)) for t in texts]
        x = {s: h for t, a, b in zip(texts, begin, begin[1:]) for s, h in zip(sorted(shingles(t, words)), sorted(sets[a:b].tolist()))}
        assert len(set().union(*[sets[a:b].tolist() for a, b in zip(begin, begin[1:])])) == len(x)


def test_estimate_is_unbiased_with_less_variance():
    """Shares of equal values of pairs at 0.85: their mean, and a spread under that of
    independent minima; the bands find them all."""
    rng = np.random.default_rng(9)
    shares, missed = [], 0
    for _ in range(400):
        both, one, two = (rng.integers(0, 1 << 63, size=n, dtype=np.uint64) for n in (85, 8, 7))
        a, b = (np.sort(np.concatenate((both, x))) for x in (one, two))
        x, y = (minhash.signatures(s, np.array([0])) for s in (a, b))
        shares.append((x == y).mean())
        missed += not (minhash.band_keys(x) == minhash.band_keys(y)).any()
    assert abs(np.mean(shares) - 0.85) < 0.005 and missed == 0
    assert np.var(shares) < 1.1 * 0.85 * 0.15 / (2 * minhash.PERMUTATIONS)


def test_near_copies_of_one_text_ask_once():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, size=400, dtype=np.uint64)
    vary = lambda k: np.unique(np.concatenate((base[k:], rng.integers(0, 1 << 63, size=k, dtype=np.uint64))))
    sets, counts = [vary(20) for _ in range(150)] + [np.unique(base)] + [vary(200) for _ in range(5)], {}
    found = minhash.links(sets, 85, counts)
    assert len(found) == 150 and counts["asked"] == 6  # the base, then the five that it isn't linked with
