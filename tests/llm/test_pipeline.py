import re

import corpus_pipeline
from test_linededup import brute as brute_repeats
from test_minhash import brute as brute_links
from test_minhash import shingles
from test_packing import check as check_packing
from test_pii import BASE, good

DATA = "/root/testdata/sf0.001"


def redacted(text):
    spans = sorted((m.start(), -m.end(), k) for k, p in BASE.items() for m in re.finditer(p, text) if good(k, m.group()))
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
            at = -e
    return "".join([*out, text[at:]])


def kept_of_near_copies(rows):
    """By Jaccard similarities of 0.8 or more; texts without words are copies of each other."""
    with_words = [r for r in rows if shingles(r[1])]
    without = [d for d, t in rows if not shingles(t)]
    return sorted({c for _, _, c, _ in brute_links(with_words, 80)} | set(sorted(without)[:1]))


def test_near_copies_between_the_two_rules(spark):
    """Pairs at 0.8 and just below it, whose fingerprints differ in more than three bits."""
    words = [f"w{i}" for i in range(64)]  # 60 shingles
    edited = lambda *places: " ".join("x" if i in places else w for i, w in enumerate(words))
    rows = [(5, " ".join(words)), (7, edited(30)), (8, edited(0, 63)), (9, edited(10, 30, 50)), (4, ""), (6, None), (10, "alone")]
    texts = dict(rows)
    share = lambda a, b: len(shingles(texts[a]) & shingles(texts[b])) / len(shingles(texts[a]) | shingles(texts[b]))
    assert share(5, 7) >= 0.8 > share(5, 9) and share(5, 8) >= 0.8
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_dedup(spark, docs, DATA)
    assert sorted(r.doc_id for r in got.collect()) == kept_of_near_copies(rows) == [4, 5, 9, 10]


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "redact_pii", "pack"]
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, steps[-1], DATA)
        if name != "pack":
            assert out.columns == docs.columns
            out = corpus_pipeline.write_table(out)
        steps.append(out)
    texts = [{r.doc_id: r.text for r in s.collect()} for s in steps[:5]]
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    bad = [d for d, q in quality.items() if q == 0]
    clean = [d for d, q in quality.items() if q == 1]
    assert sum(d in texts[1] for d in clean) >= 0.97 * len(clean)
    assert sum(d in texts[1] for d in bad) <= 0.4 * len(bad)  # eleven labelled bad texts only
    rows = sorted(texts[1].items())
    words, gone = brute_repeats(rows, 50)
    for (d, _), w, g in zip(rows, words, gone):
        assert texts[2][d].encode().split() == [x for i, x in enumerate(w) if i not in g]
    assert sorted(texts[3]) == kept_of_near_copies(sorted(texts[2].items()))
    for d, t in texts[3].items():
        # What the contexts add may cover anything; the rest is the text with its shapes redacted.
        pieces = map(re.escape, texts[4][d].split("[ID]"))
        assert re.fullmatch("(?s:.+?)".join(pieces), redacted(t))
    check_packing(list(texts[4].items()), steps[5].collect(), 2048)


def test_run_packs_what_the_stages_keep(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.count() > 0
