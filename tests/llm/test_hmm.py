import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from cladeforge.llm import hmm


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w] + [None]


def rows(n=300):
    rng = random.Random(4)
    langs = [[f"{p}{i}" for i in range(60)] for p in ("a", "B", "é")]
    out = [(d, " ".join(rng.choice(langs[d % 3]) for _ in range(rng.randint(0, 40)))) for d in range(n)]
    return out + [(n, None), (n + 1, ""), (7, out[7][1]), (None, "a1 unseen\tB2"), (n + 2, "x " * 3000)]


@pytest.mark.parametrize("top", [20, 32768])
def test_base_and_totals(spark, top):
    data = rows()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    count = Counter(t for d, x in data if not held(d) for t in tokens(x))
    n, v = sum(count.values()), len(count)
    df = spark.createDataFrame([(d, t, 0, "w") for d, t in data], "doc_id long, text string, row int, word string")
    got = sorted(map(tuple, hmm.score(df, frequent=top, rare_classes=4).collect()), key=str)
    want = []
    for d, x in data:
        t = tokens(x)
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        want.append((d, held(d), len(t), sum(count[w] > 0 for w in t), n, base))
    want.sort(key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want] or sorted(g[:5] for g in got if g[0]) == sorted(w[:5] for w in want if w[0])
    by = {}
    for w in want:
        by.setdefault(w[:5], []).append(w[5])
    for g in got:
        assert min(abs(g[5] - b) for b in by[g[:5]]) < 1e-6
    out = [g for g in got if g[1]]
    assert sum(g[6] for g in out) > sum(g[5] for g in out)  # held-out texts are likelier than under the base


def test_forward_is_exact():
    rng = np.random.default_rng(2)
    model = hmm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T)
    seqs = [rng.integers(0, 5, size=k).astype(np.int32) for k in (1, 4, 6, 2)]
    got = hmm.log_likelihoods(model, seqs)
    for s, g in zip(seqs, got):
        p = 0
        for path in itertools.product(range(3), repeat=len(s)):
            q = model.start[path[0]] * model.emit[s[0], path[0]]
            for a, b, c in zip(path, path[1:], s[1:]):
                q *= model.move[a, b] * model.emit[c, b]
            p += q
        assert abs(math.log(p) - g) < 1e-9


def test_baum_welch_counts_are_exact():
    rng = np.random.default_rng(3)
    model = hmm.Model(rng.dirichlet(np.ones(2)), rng.dirichlet(np.ones(2), 2), rng.dirichlet(np.ones(3), 2).T)
    seqs = [rng.integers(0, 3, size=k).astype(np.int32) for k in (1, 5, 3)]
    start, move, emit = np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2))
    for s in seqs:
        paths = {}
        for path in itertools.product(range(2), repeat=len(s)):
            q = model.start[path[0]] * model.emit[s[0], path[0]]
            for a, b, c in zip(path, path[1:], s[1:]):
                q *= model.move[a, b] * model.emit[c, b]
            paths[path] = q
        z = sum(paths.values())
        for path, q in paths.items():
            start[path[0]] += q / z
            for t, k in enumerate(path):
                emit[s[t], k] += q / z
                if t:
                    move[path[t - 1], k] += q / z
    got = hmm.expected_counts(model, seqs)
    for a, b in zip(got, (start, move, emit)):
        assert np.allclose(a, b)


def test_total_probability_is_one():
    model = hmm.Model.first(np.ones(6) / 6, states=3)
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1)
    again = hmm.Model.of_counts(*hmm.expected_counts(model, [np.array([1, 2, 0], dtype=np.int32)]), np.ones(6) / 6)
    assert np.allclose(again.emit.sum(axis=0), 1) and math.isclose(again.start.sum(), 1)


def test_empty_and_nothing_to_learn(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert hmm.score(none).count() == 0
    one = spark.createDataFrame([(d, "a b") for d in range(400) if zlib.crc32(str(d).encode()) % 10 == 0][:2], "doc_id long, text string")
    for r in hmm.score(one).collect():
        assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)


def test_stretches_of_long_texts_count_alike(monkeypatch):
    rng = np.random.default_rng(5)
    model = hmm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(9), 3).T)
    seqs = [rng.integers(0, 9, size=k).astype(np.int64) for k in (700, 3, 90, 1)]
    want = hmm.expected_counts(model, seqs)
    monkeypatch.setattr(hmm, "BLOCK", 64)
    for a, b in zip(hmm.expected_counts(model, seqs), want):
        assert np.allclose(a, b)


def test_scores_are_those_of_a_distribution_over_words(spark):
    """Over all texts of up to one word, known or not, and with rare words in two classes."""
    rng = random.Random(9)
    learned = [(d, " ".join(rng.choice("abcdefgh") for _ in range(2))) for d in range(40) if zlib.crc32(str(d).encode()) % 10]
    held = [d for d in range(1000, 1200) if zlib.crc32(str(d).encode()) % 10 == 0]
    asked = [*"abcdefgh", "unseen"]
    df = spark.createDataFrame(learned + list(zip(held, asked)) + [(held[9], "")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in hmm.score(df, frequent=3, rare_classes=2).collect()}
    one = sum(10 ** got[d] for d in held[:10])
    assert 0 < one < 1
    more = spark.createDataFrame(learned + [(held[i], f"{a} {b}") for i, (a, b) in enumerate([("a", "b"), ("h", "unseen")])], "doc_id long, text string")
    assert all(r.score < 0 for r in hmm.score(more, frequent=3, rare_classes=2).collect())


def test_scores_do_not_hang_on_blocks_and_buckets(spark, monkeypatch):
    """Rare words meet in buckets from several blocks of texts, and no count is rounded."""
    df = spark.createDataFrame([(d, t) for d, t in rows(120) if d is not None], "doc_id long, text string")
    one = sorted(map(tuple, hmm.score(df.repartition(1), frequent=5, rare_classes=4).collect()))
    monkeypatch.setattr(hmm, "BUCKET", 40)
    many = sorted(map(tuple, hmm.score(df.repartition(5), frequent=5, rare_classes=4).collect()))
    assert [r[:5] for r in one] == [r[:5] for r in many]
    assert np.allclose([r[5:] for r in one], [r[5:] for r in many], rtol=1e-4)


def test_written_tables_have_rows_by_block_and_not_by_text_or_word(spark, monkeypatch):
    """What lies on disk between the steps: blocks, and a block's words once for each bucket."""
    sizes, write = [], hmm.write_table

    def counted(df, **options):
        out = write(df, **options)
        sizes.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(hmm, "write_table", counted)
    df = spark.createDataFrame([(d, f"common rare{d % 90} word{d % 70}") for d in range(400)], "doc_id long, text string").repartition(2)
    assert hmm.score(df, frequent=3, rare_classes=4).count() == 400
    assert max(n for columns, n in sizes if columns != ["word", "c"]) < 10


@pytest.mark.parametrize("lanes", [1, 3, 2048])
def test_texts_in_one_lane_do_not_meet(monkeypatch, lanes):
    rng = np.random.default_rng(6)
    model = hmm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(9), 3).T)
    seqs = [rng.integers(0, 9, size=k).astype(np.int64) for k in (40, 1, 7, 7, 2, 30, 1, 12)]
    want = [hmm.expected_counts(model, [s]) for s in seqs]
    logs = [hmm.log_likelihoods(model, [s])[0] for s in seqs]
    monkeypatch.setattr(hmm, "LANES", lanes)
    monkeypatch.setattr(hmm, "PIECE", 16)
    for a, b in zip(hmm.expected_counts(model, seqs), map(sum, zip(*want))):
        assert np.allclose(a, b)
    assert np.allclose(hmm.log_likelihoods(model, seqs), logs)
