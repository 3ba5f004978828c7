import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cladeforge.llm import packing

TOK = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@given(st.text(alphabet=st.sampled_from("aB'sé́ \n\t  \u0085\x1c<|endoftext|>1.,ß"), max_size=60))
@settings(max_examples=300, deadline=None)
def test_encoder_matches_tokenizer(text):
    ids = TOK.encode(text, add_special_tokens=False).ids
    got = packing.encoder(public_tokenizers.path("word_bpe_49k.json")).encode_all([b"x", text.encode()])[1]
    assert np.frombuffer(got, "<u4").tolist() == ids


def check(rows, out, window):
    want = {}
    for d, t in rows:
        want.setdefault(d, []).append(TOK.encode(t or "", add_special_tokens=False).ids + [1])
    seqs, docs = defaultdict(list), defaultdict(list)
    for r in out:
        seqs[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append(r)
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window and (at == window or at & (at - 1) == 0)
    for d, texts in want.items():
        if len(texts) > 1:
            assert sum(r.length for r in docs[d]) == sum(map(len, texts))
            continue
        at = 0
        for r in sorted(docs[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(texts[0])
            assert r.ids_crc32 == zlib.crc32(np.array(texts[0][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(texts[0])


def test_pack_round_trip(spark):
    rows = [(d, " ".join(f"word{d % 7}x" for _ in range(d * 13 % 97))) for d in range(120)]
    rows += [(500, "long text " * 4000), (501, None), (502, ""), (503, "été \n"), (7, "again"), (None, "no id")]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, ids int").repartition(3)
    for window in (64, 2048):
        check(rows, packing.pack(df, window=window, open_windows=4).collect(), window)


def test_pack_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_of_a_large_vocabulary_are_encoded_once():
    from types import SimpleNamespace

    from cladeforge.llm import packing

    asked = []
    coder = packing.WordEncoder.__new__(packing.WordEncoder)
    coder.memo = {}
    coder.tokenizer = SimpleNamespace(encode_batch_fast=lambda words, add_special_tokens: asked.append(len(words)) or [SimpleNamespace(ids=[len(w)]) for w in words])
    texts = [b" ".join(b"%d" % i for i in range(at, at + 50_000)) for at in range(0, 600_000, 50_000)]
    first = [coder.encode_all([t]) for t in texts]
    assert [coder.encode_all([t]) for t in texts] == first and sum(asked) == 600_000
