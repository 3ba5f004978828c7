import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from cladeforge.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def good(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 8 <= len(d) <= 15
    return True


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if good(k, m.group())]


def check(spark, texts):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, row int")
    got = {r.doc_id: r for r in pii.extract(df).collect()}
    for i, t in enumerate(texts):
        want, r = brute(t), got[i]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert [s for s in r.spans.split(",") if s and not s.startswith("id:")] == want
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in BASE]


FIXED = [
    None, "", "a@b.c_x@d.e", "x@y", "é a.b@c-d.ef.gh, 1.2.3.4.5.6.7.8 999.1.1.1 01.002.0255.3",
    "4041894974608795 and 4041 8949 7460 8795 0", "+1 (988) 555-2485 +12 +1234567890123456", "a@b.c@d.e@f.g",
    "a" * 50000 + "@", "1" * 30000, "x@" + "a." * 9000 + "b", "+" + "1 " * 20000, "a@a.a." * 500, "1.1.1.1 " * 300,
]


def test_fixed_texts(spark):
    check(spark, FIXED)


@given(st.lists(st.text(alphabet="a.@1+- (_\né4", max_size=25), min_size=30, max_size=60))
@settings(max_examples=6, deadline=None)
def test_shapes_match_regex(spark, texts):
    check(spark, texts)


def test_patterns_discover_identifiers(spark):
    rows = [(i, f"filler text number please write to user{i}@mail.example now") for i in range(12)]
    rows += [(100, "some words please write to agent-007x now"), (101, "the plan of agent-007x is old"), (102, "in 2024abc it was cold")]
    got = {r.doc_id: r.spans for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    at = rows[12][1].index("agent")
    assert got[100] == f"id:{at}:{at + 10}"
    assert got[101] == "id:12:22" and got[102] == ""


def test_secrets_are_found_by_their_context(spark):
    digits = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(12)]
    rows = [(i, f'of {i} words | token = "{digits[i]}" | and others') for i in range(8)]
    rows += [(20, 'here token = "s3cret-word9" stands'), (21, f"the sum {digits[9]} of a file of the 2024abc kind"), (22, f"| {digits[10]} |")]
    rows += [(30 + i, f"of {digits[11][:9]}{i} the plan of a file of the many") for i in range(30)]
    got = {r.doc_id: r for r in pii.extract(spark.createDataFrame(rows * 2, "doc_id long, text string")).collect()}
    assert [got[i].n_id for i in range(8)] == [1] * 8 and got[20].n_id == 1
    at = rows[8][1].index("s3cret")
    assert got[20].spans == f"id:{at}:{at + 12}"
    assert got[21].n_id == got[22].n_id == 0 and not any(got[30 + i].n_id for i in range(30))


def test_redact_keeps_columns_of_any_name(spark):
    rows = [(1, "to a@b.cc and", 5, "x", "y"), (1, "to a@b.cc and", 5, "x", "y"), (None, None, 6, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row__ int, cuts__ string, row string")
    out = pii.redact(df)
    want = [(d, t and "to [EMAIL] and", *more) for d, t, *more in rows]
    assert out.columns == df.columns and sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_many_spans_in_one_text(spark):
    check(spark, ["a@b.cc 1.2.3.4 x9y8z7 " * 20_000, "w " * 300_000 + "a@b.cc"])


def test_redact(spark):
    rows = [(i, t, "s") for i, t in enumerate(FIXED[:8])] + [(None, "é mail a@b.cc, ip 1.2.3.4 ", "s"), (3, "é x@y.z", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = pii.redact(df)
    assert out.columns == df.columns
    texts = [r.text for r in out.collect()]
    assert "é mail [EMAIL], ip [IP] " in texts and "é [EMAIL]" in texts and texts.count(None) == 1 and "x@y" in texts
    assert all(not brute(t) for t in texts)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.extract(none).count() == 0 and pii.redact(none).count() == 0
