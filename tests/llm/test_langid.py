import random
import zlib

import numpy as np

from cladeforge.llm import langid


def test_gradients_match_finite_differences():
    net = langid.Network(["a", "b", "c"], seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    data, mask = langid.padded([b"ab", b"xyz", b"q", "é".encode()])
    label = np.array([0, 1, 2, 0])
    _, grads = net.gradients(data, mask, label)
    rng = np.random.default_rng(2)
    for name, value in net.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in value.shape)
            if name == "embed":
                at = (int(data.ravel()[rng.integers(0, data.size)]), at[1])
            old, eps = value[at], 1e-3
            value[at] = old + eps
            up, _ = net.gradients(data, mask, label)
            value[at] = old - eps
            down, _ = net.gradients(data, mask, label)
            value[at] = old
            assert abs((up - down) / (2 * eps) - grads[name][at]) < 2e-3, name


def corpus(n=240):
    rng = random.Random(1)
    langs = {"en": ["the", "ing", "tion", "wh"], "fr": ["é", "eau", "que", "ai"], "de": ["ung", "ß", "sch", "keit"]}
    rows = []
    for d in range(n):
        lang = list(langs)[d % 3]
        words = ["".join(rng.choice(langs[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 40))]
        rows.append((d, " ".join(words), lang))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus() + [(900, None, "en"), (901, "12 34 --", "fr"), (902, "", None), (None, "eau que", "fr"), (5, "é" * 9000, None)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = langid.identify(df).collect()
    assert len(got) == len(rows)
    held = {d for d, _, _ in rows if d is not None and zlib.crc32(str(d).encode()) % 4 == 2}
    assert {r.doc_id for r in got if r.held_out} == held
    truth = {d: x for d, _, x in rows[:240]}
    seen = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id != 5]
    assert sum(r.lang_pred == truth[r.doc_id] for r in seen) >= 0.95 * len(seen) > 20
    by = {r.doc_id: r for r in got}
    assert all(by[d].lang_pred == "und" and by[d].score == 0 for d in (900, 901, 902))
    assert all(0 <= r.score <= 1 for r in got)


def test_pool_does_not_depend_on_the_batch():
    net = langid.Network(["x", "y"])
    texts = [b"aa bb", b"cc " * 50, b"z" * 100, b"bb aa"]
    alone = [langid.Labeller(net).pool([t])[0] for t in texts]
    assert np.allclose(langid.Labeller(net).pool(texts), alone, atol=1e-5)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.identify(df).collect()] == ["und"]
    assert langid.identify(df.limit(0)).count() == 0


def brute(net, text):
    """Mean probabilities over the positions, byte by byte."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    p, n = {k: v.astype(np.float64) for k, v in net.p.items()}, langid.HIDDEN

    def states(side, data):
        h, out = np.zeros(n), []
        for byte in data:
            g, a = p["embed"][byte] @ p[f"{side}_in"] + p[f"{side}_b"], h @ p[f"{side}_re"]
            update, reset = sigmoid(g[:n] + a[:n]), sigmoid(g[n : 2 * n] + a[n : 2 * n])
            h = update * h + (1 - update) * np.tanh(g[2 * n :] + reset * a[2 * n :])
            out.append(h)
        return np.array(out)

    logit = np.hstack([states("f", text), states("b", text[::-1])[::-1]]) @ p["out"] + p["bias"]
    e = np.exp(logit)
    return (e / e.sum(axis=1, keepdims=True)).mean(axis=0)


def test_pool_matches_brute_force(monkeypatch):
    net = langid.Network(["x", "y", "z"], seed=3)
    rng = random.Random(2)
    texts = [bytes(rng.randrange(256) for _ in range(k)) for k in (1, 40, 500, 3, 130)]
    assert np.allclose(langid.Labeller(net).pool(texts), [brute(net, t) for t in texts], atol=1e-5)
    monkeypatch.setattr(langid, "BESIDE", 3)
    assert np.allclose(langid.Labeller(net).pool(texts), [brute(net, t) for t in texts], atol=1e-5)


def test_segments_are_close_to_whole_texts(monkeypatch):
    rng = random.Random(4)
    letters = {"a": b"the and of ", "b": "é eau que ".encode()}
    excerpts = {k: [bytes(rng.choice(v) for _ in range(40)) for _ in range(50)] for k, v in letters.items()}
    monkeypatch.setattr(langid, "STEPS", 30)
    net = langid.train(excerpts)
    texts = [bytes(rng.choice(letters[k]) for _ in range(n)) for k, n in (("a", 5000), ("b", 2049), ("a", 1024), ("b", 1025))]
    assert np.allclose(langid.Labeller(net).pool(texts), [brute(net, t) for t in texts], atol=2e-3)


def test_sample_takes_distinct_texts_of_each_language(spark, monkeypatch):
    monkeypatch.setattr(langid, "DOCS_A_LABEL", 5)
    rows = [(t, x) for _, t, x in corpus(30)] + [("eau que " * 30, "fr")] * 50 + [("only", "xx")] * 40
    got = langid.sampled(spark.createDataFrame(rows, "text string, lang string"))
    assert sorted(got) == ["de", "en", "fr", "xx"] and set(got["xx"]) == {b"only"}
    assert all(len(v) <= 5 * langid.EXCERPTS and len(x) <= 4 * langid.EXCERPT for v in got.values() for x in v)
    texts = [t.encode() for t, x in rows if x == "fr"]
    assert all(any(x in t for t in texts) for x in got["fr"])
