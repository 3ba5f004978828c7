import random
from collections import defaultdict

import pyarrow as pa
import pytest
import xxhash

from cladeforge.llm import linededup


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute(rows, run, line=8):
    """Removed word places of each row, by its place in rows."""
    words = [(t or "").encode().split() for _, t in rows]
    ranks = [(d is None, d or 0, 42 if t is None else signed(xxhash.xxh64_intdigest(t.encode(), 42)), i) for i, (d, t) in enumerate(rows)]
    where = defaultdict(list)
    for i, w in enumerate(words):
        for a in range(len(w) - run + 1):
            where[tuple(w[a : a + run])].append((ranks[i], a))
        at = 0
        for some in (rows[i][1] or "").encode().split(b"\n"):
            n = len(some.split())
            if line <= n < run:
                where[tuple(some.split())].append((ranks[i], at))
            at += n
    gone = [set() for _ in rows]
    for window, places in where.items():
        first = min(places)
        for rank, a in places:
            if rank != first[0] or a >= first[1] + len(window):
                gone[rank[3]].update(range(a, a + len(window)))
    return words, gone


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["é", "le"]
    text = lambda k: [rng.choice(vocab) for _ in range(k)]
    passages = [text(k) for k in (9, 12, 14, 30)]
    lines = [text(k) for k in (3, 5, 9)]
    rows = []
    for d in range(n):
        w = text(rng.randint(0, 60))
        if d % 3 == 0:
            w[rng.randint(0, len(w)) : 0] = ["\n", *lines[rng.randrange(3)], "\n"]
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(passages)
        if rows and rng.random() < 0.25:
            w = list(rng.choice(rows)[1].split(" "))
            if w and rng.random() < 0.6:
                w[rng.randrange(len(w))] = "edited"
        rows.append((d, rng.choice([" ", "\n", "  \t"]).join(w)))
    rows += [(n, None), (n + 1, ""), (n + 2, "le " * 80), (3, rows[3][1]), (None, rows[5][1]), (n + 3, "word " * 9), (None, " ".join(passages[3]))]
    return rows


@pytest.mark.parametrize("seed,run,span,line", [(1, 10, 5, 4), (2, 12, 12, 8), (3, 10, 4, 1), (4, 11, 1, 20)])
def test_matches_brute_force(spark, seed, run, span, line):
    rows = corpus(seed)
    df = spark.createDataFrame([(a, b, 5) for a, b in rows], "doc_id long, text string, row int").coalesce(1)
    got = defaultdict(list)
    for r in linededup.dedup(df, run, span, line).collect():
        got[r.doc_id].append(r)
    words, gone = brute(rows, run, line)
    want = defaultdict(list)
    for (d, t), w, g in zip(rows, words, gone):
        left = [x for i, x in enumerate(w) if i not in g]
        want[d].append((None if t is None else b" ".join(left), len(w), len(g)))
    for d, items in want.items():
        seen = [(None if r.text is None else b" ".join(r.text.encode().split()), r.words, r.removed_words) for r in got[d]]
        assert sorted(seen, key=str) == sorted(items, key=str)


def test_frequent_passages(spark, monkeypatch):
    monkeypatch.setattr(linededup, "max", lambda a, b: 3, raising=False)  # keys of three rows are frequent
    rows = corpus(6, 90)
    got = linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), 10, 5, 4).collect()
    words, gone = brute(rows, 10, 4)
    assert sorted((r.words, r.removed_words) for r in got) == sorted((len(w), len(g)) for w, g in zip(words, gone))


def test_short_repeated_lines(spark):
    rule = "all rights to these words stay with them who wrote"
    rows = [(d, f"start {d}\n{rule}\nsome other words of {d}\n{'again and ' * 2}", "s") for d in range(5)]
    rows.append((9, f"{rule} {rule}\nhere  {rule}\n{rule}\n", "s"))
    got = dict(tuple(r)[:2] for r in linededup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())
    assert got[0] == rows[0][1] and got[3] == "start 3\nsome other words of 3\nagain and again and "
    assert got[9] == f"{rule} {rule}\nhere  {rule}\n"


def test_row_numbers_do_not_follow_splits(spark, tmp_path):
    rows = corpus(5, 200)
    given = spark.createDataFrame([(a, b, 5) for a, b in rows], "doc_id long, text string, row int").repartition(12)
    given.write.parquet(str(tmp_path / "docs"))
    sizes = iter(["16k", "128m"] * 20)
    real = linededup.write_table

    def resplit(df):  # every job reads the files in other splits than the one before
        out = real(df)
        spark.conf.set("spark.sql.files.maxPartitionBytes", next(sizes))
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        return out

    linededup.write_table = resplit
    try:
        got = linededup.dedup(spark.read.parquet(str(tmp_path / "docs")), 10, 5).collect()
    finally:
        linededup.write_table = real
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r.doc_id, r.words) for r in got if r.doc_id is not None) == sorted((d, len((t or "").split())) for d, t in rows if d is not None)


@pytest.mark.parametrize("names", [("row__", "runs__", "words__", "row"), ("__row", "__runs", "__words", "marks")])
def test_stage_keeps_columns_and_clean_texts(spark, names):
    rows = [(d, f"text {d}\n\nwith  its own\twords {d}", "s", d, d + 1, d + 2) for d in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} {t}" for n, t in zip(names, ("string", "int", "int", "long"))))
    out = linededup.without_repeats(df, 10, 5)
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == rows


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert linededup.dedup(none).count() == 0


def test_very_long_text(spark):
    text = " ".join(f"w{i % 99991}" for i in range(250_000))
    got = linededup.dedup(spark.createDataFrame([(1, text), (2, "x " + text)], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.words, r.removed_words) for r in sorted(got)] == [(1, 250_000, 150_009), (2, 250_001, 250_000)]


def test_cut():
    assert linededup.cut("é b  c\nd e ".encode(), [(1, 3), (4, 5)]) == ("é d ".encode(), 5)
    assert linededup.cut(b" a b ", [(0, 2)]) == (b" ", 2)


def test_slices_of_arrow(spark):
    texts = pa.array([None, "a b", "", "c " * 10]).slice(1)
    assert sum(len(w.hashes) for _, w in linededup._word_lists(texts)) == 12


def test_copies_meet_by_stretches_not_by_windows(spark, monkeypatch):
    rng = random.Random(3)
    passage = [f"w{rng.randrange(5000)}" for _ in range(400)]
    rows = [(d, " ".join([f"a{d}", *passage, f"z{d}"])) for d in range(60)]
    written, real = [], linededup.write_table

    def counted(df):
        out = real(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(linededup, "write_table", counted)
    got = linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.words, r.removed_words) for r in got) == [(402, 0)] + [(402, 400)] * 59
    assert sum(written) < 60 * 400 / 2  # a row for each window is 60 * 351


@pytest.mark.parametrize("frequent", [False, True])
def test_stretches_that_overlap(spark, monkeypatch, frequent):
    if frequent:
        monkeypatch.setattr(linededup, "max", lambda a, b: 1, raising=False)
        monkeypatch.setattr(linededup, "LOOK", 1)
    turns = [" ".join(f"t{i % k}" for i in range(n)) for k, n in ((1, 40), (7, 60), (13, 70), (19, 33))]
    rows = [(d, f"x{d} {t} y{d} {t[: 40 + d]}") for d, t in enumerate(turns * 2)] + [(20, None), (21, ""), (22, "é " * 30)]
    words, gone = brute(rows, 10, 4)
    got = {r.doc_id: r for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), 10, 5, 4).collect()}
    for (d, t), w, g in zip(rows, words, gone):
        left = None if t is None else b" ".join(x for i, x in enumerate(w) if i not in g)
        assert (None if t is None else b" ".join(got[d].text.encode().split()), got[d].removed_words) == (left, len(g))


def test_copies_of_a_frequent_stretch_are_told_in_their_place(spark, monkeypatch):
    monkeypatch.setattr(linededup, "max", lambda a, b: 8, raising=False)  # stretches of four rows are frequent
    dealt, real = [], linededup.later

    def counted(rows, others=False):
        dealt.append(rows.count())
        return real(rows, others)

    monkeypatch.setattr(linededup, "later", counted)
    rng = random.Random(4)
    passage = [f"w{rng.randrange(5000)}" for _ in range(300)]
    line = " ".join(f"l{i}" for i in range(9))
    turn = " ".join(["t"] * 25)
    for copies in (40, 80):
        dealt.clear()
        rows = [(d, " ".join([f"a{d}", *passage, f"z{d}\n{line}\n{turn} x{d}\n{line}"])) for d in range(copies)]
        rows += [(copies + d, rows[d][1]) for d in range(copies)]
        got = linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), 10, 5, 4).collect()
        words, gone = brute(rows, 10, 4)
        assert [(r.words, r.removed_words) for r in sorted(got)] == [(len(w), len(g)) for w, g in zip(words, gone)]
        # Nearly all stretches are copies of a frequent one: the passage has some 80 in each row.
        assert dealt[0] < 12 * 2 * copies, dealt


def test_groups_stay_together_over_batches():
    keys = [1, 1, 2, 2, 2, 2, 2, 3, 4, 4, 5]
    batches = [pa.record_batch([pa.array(keys[i : i + n]), pa.array(range(i, i + n))], ["k", "v"]) for i, n in ((0, 3), (3, 0), (3, 2), (5, 3), (8, 2), (10, 1))]
    parts = [(k.tolist(), v.tolist()) for k, v in linededup._groups(iter(batches)) if len(k)]
    assert sum((k for k, _ in parts), []) == keys and sum((v for _, v in parts), []) == list(range(11))
    assert not any(set(a) & set(b) for (a, _), (b, _) in zip(parts, parts[1:]))
