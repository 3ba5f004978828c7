import math
import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cladeforge.llm import bytetext, quality

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t", max_size=30)), max_size=12)


@given(TEXTS)
@settings(max_examples=200, deadline=None)
def test_words_and_hashes(texts):
    got = []
    for row, data, offsets in bytetext.slices(pa.array(texts, pa.string())):
        starts, ends = bytetext.words(data, offsets)
        doc = np.searchsorted(offsets, starts, side="right") - 1 + row
        got += [(int(d), bytes(data[a:b]), int(h)) for d, a, b, h in zip(doc, starts, ends, bytetext.word_hashes(data, starts, ends))]
    want = [(i, w) for i, t in enumerate(texts) for w in (t or "").encode().split()]
    assert [g[:2] for g in got] == want
    assert len({g[2] for g in got}) == len({w for _, w in want})
    assert len({(g[1], g[2]) for g in got}) == len({w for _, w in want})


@given(TEXTS)
@settings(max_examples=100, deadline=None)
def test_log_weights_match_brute_force(texts):
    ratio = np.random.default_rng(1).normal(size=quality.BUCKETS + 2)
    got = quality.log_weights(ratio, pa.array(texts, pa.string()))
    for t, g in zip(texts, got):
        b, w = (t or "").encode(), (t or "").encode().split()
        want = 0.0
        for i in range(len(b) - 3):
            h = 0
            for x in b[i : i + 4]:
                h = h * 257 + x
            want += ratio[((h * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 48) % quality.BUCKETS]
        want += sum(ratio[quality.BUCKETS + (x != y)] for x, y in zip(w, w[1:]))
        assert math.isclose(g, want, abs_tol=1e-9)


def corpus(spark):
    rng = random.Random(2)
    good = [" ".join(rng.choice(["the", "ather", "erion", "of", "inth"]) for _ in range(rng.randint(5, 60))) for _ in range(150)]
    bad = [" ".join(f"{rng.choice(['xq', 'zzk'])}###" for _ in range(rng.randint(5, 60))) for _ in range(40)]
    bad += [" ".join(["the"] * rng.randint(20, 60)) for _ in range(15)]
    rows = [(i, t, "s") for i, t in enumerate(good + bad)] + [(9000, None, "s"), (9001, "", "s"), (None, good[0], "s"), (3, good[3], "s")]
    labels = [(i, int(i < 150), 0) for i in range(0, 205, 2)] + [(None, 1, 0), (1, None, 0), (0, 1, 0), (77777, 0, 1)]
    return (
        spark.createDataFrame(rows, "doc_id long, text string, key string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_good_stays_and_bad_goes(spark):
    docs, labels = corpus(spark)
    got = quality.scores(docs, labels).collect()
    assert len(got) == docs.count()
    kept = {r.doc_id for r in got if r.kept}
    assert sum(i in kept for i in range(150)) >= 148
    assert sum(i in kept for i in range(150, 205)) <= 3
    chosen = quality.select(docs, labels)
    assert chosen.columns == docs.columns
    assert {r.doc_id for r in chosen.collect()} == kept


def test_no_labels_keeps_all(spark):
    docs, labels = corpus(spark)
    assert quality.scores(docs, labels.limit(0)).where("kept").count() == docs.count()
    assert quality.scores(docs.limit(0), labels).count() == 0
    assert quality.select(docs.limit(0), labels).count() == 0


def test_kth_largest(spark):
    rng = random.Random(1)
    values = [rng.gauss(0, 1) for _ in range(300)] + [0.5] * 50
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 7, 120, 349, 350):
        assert quality.kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]
