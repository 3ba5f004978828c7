import hashlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cladeforge.llm import crosstok

SCHEMA = "doc_id long, text string, batch int, seg string, total int"
ODD = ["", None, " ", "\n", "a", "  two  spaces \n\n and\ttabs\r\n end  ", "<|endoftext|> <s> </s> <unk> <0x41>", "▁ has the sign", "x▁y", "don't we'll I'M", "naïve 漢字 仮名 😀😀 ﬁ ½", "a b  c d\u0085e", "\x00nul \x1c sep", "x;\r\n}\r\n  {\r", "é ​ zero", "ab" * 900, " ﻿bom", "1234567 3.14 1e9"]


@pytest.fixture(scope="module")
def both():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return a, b


def whole(both, text):
    """Ids and byte ends of both tokenizers over a whole text; None without tokens."""
    if not text:
        return None
    a, b = both
    x, y = a.encode(" " + text, add_special_tokens=False), b.encode(text)
    letters = crosstok._byte_letters()
    one = [bytes(letters[c] for c in t) for t in x.tokens]
    two = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
    if not b"".join(one) == b"".join(two) == (" " + text).encode():
        return None
    return x.ids, one, y, two


def brute(both, rows):
    out, held = [], Counter()
    for doc, text in rows:
        found = whole(both, text)
        if found is None:
            out.append((doc, 0, 0, 0, [], ""))
            continue
        ids_a, one, ids_b, two = found
        spans = []
        for part in (one, two):
            at, s = 0, []
            for t in part:
                s.append((at, at + len(t)))
                at += len(t)
            spans.append(s)
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        links = [(i, j) for i, (p, q) in zip(ids_a, spans[0]) for j, (r, s) in zip(ids_b, spans[1]) if max(p, r) < min(q, s)]
        groups, last = [], 0
        for e in ends:
            inside = [",".join(str(i) for i, (p, q) in zip(ids, s) if last <= p and q <= e) for ids, s in ((ids_a, spans[0]), (ids_b, spans[1]))]
            groups.append("|".join(inside))
            last = e
        held.update(set(links))
        out.append((doc, len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = {}
    for (i, _), n in held.items():
        most[i] = max(n, most.get(i, 0))
    return sorted(((d, a, b, g, len(k), sum(held[p] == most[p[0]] for p in k), sum(held[p] for p in k), h) for d, a, b, g, k, h in out), key=str)


def got(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, crosstok.alignments(df, **kw).collect()), key=str)


def test_odd_texts_match_brute_force(spark, both):
    rows = [*enumerate(ODD), (3, ODD[5]), (None, ODD[9]), (None, None)]
    assert got(spark, rows) == brute(both, rows)


def test_documents_match_brute_force_in_small_batches(spark, both):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 2500").select("doc_id", "text")
    rows = sorted(map(tuple, table.collect()))
    want = brute(both, rows)
    assert got(spark, rows) == want
    assert got(spark, rows, batch_bytes=3000, together=40, most=100) == want


def test_empty_table(spark):
    assert got(spark, []) == []


@given(st.text(alphabet=st.sampled_from(list("ab.;}'s1 \n\t\r \x1c é漢▁<0x")), max_size=40))
@settings(max_examples=400, deadline=None)
def test_segments_tokens_are_the_texts(both, text):
    t = crosstok.tools(*crosstok.default_paths())
    segs = t.segments(text)
    assert "".join(segs) == " " + text
    if "▁" not in text and text:
        joined = [[i for s in side for i in s] for side in zip(*t.encode(segs))]
        assert joined == [both[0].encode(" " + text, add_special_tokens=False).ids, both[1].encode(text)]


def test_cuts_are_verified():
    t = crosstok.tools(*crosstok.default_paths())
    assert t.cuts == " \n\t"
    assert not crosstok.vocabularies_agree(["a", "b c"], " ") and crosstok.vocabularies_agree(["  a", "  "], " ")
    assert crosstok.segment_pattern("").findall("a b") == ["a b"]
    assert crosstok.segment_pattern(" ").findall(" a  b\nc ") == [" a", "  b\nc", " "]
