import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from cladeforge.llm import spm

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
P = spm.pieces(PATH)


def ids(texts):
    return [list(memoryview(b).cast("I")) for b in P.encode_all(texts)]


@given(st.lists(st.text(alphabet=st.sampled_from("aaeinoprst lh \n\tTéñ▁日😀\x000.,"), max_size=80), max_size=4))
@settings(max_examples=400, deadline=None)
def test_encoding_matches_library(texts):
    got = ids(texts)
    assert got == [LIB.encode(t) for t in texts]
    assert [P.decode(x) for x in got] == [LIB.decode(LIB.encode(t)) for t in texts]


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_any_text(text):
    assert ids([text]) == [LIB.encode(text)]


def test_long_texts_without_blanks():
    for t in ("internationalization" * 500, "aaaa" * 3000, "ab" * 5000 + "é" * 999, " " * 777 + "x" + " " * 50, "x  y " * 99):
        assert ids([t]) == [LIB.encode(t)]


def test_window_is_bounded():
    seen = []

    def chars():
        for i, c in enumerate("theinternationaltransport" * 200):
            seen.append(i)
            yield c

    stream = P.stream(chars())
    first = next(stream)
    assert first == LIB.encode("theinternationaltransport" * 200)[1] or first is not None
    assert len(seen) < 200  # ids come out long before the text ends


def test_encode_and_decode(spark):
    rows = [(1, "Hello world", 0), (2, None, 0), (3, "", 0), (None, "été\n  x", 0), (1, "Hello world", 0), (4, "a" * 20000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = spm.round_trip(df).collect()
    assert len(got) == 6 and all(r.decoded_same for r in got)
    by = {r.doc_id: r.ids for r in got}
    for d, t, _ in rows:
        assert by[d] == LIB.encode(t or "")
    texts = {r.doc_id: r.x for r in spm.encode(df).select('doc_id', spm.decoded('ids').alias('x')).collect()}
    assert texts[None] == "été\n  x" and texts[2] == ""
    assert spm.round_trip(df.limit(0)).count() == 0
