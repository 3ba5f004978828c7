"""Removal of long passages and lines that occur again.

Method: winnowing. A text is a sequence of lines of two kinds: those it has, and, as
passages seldom begin at a line break, the SPAN words that begin at each word. Of the
hashes of WINDOW successive ones of the second kind the smallest is selected with its
place, so any run of SPAN + WINDOW - 1 = `run` words that two texts share has a selected
hash in common; of the first kind, whose runs may be one line long, the window is one and
every line of LINE words or more is selected. Every window of `run` words selects one hash,
so a selected hash has a stretch of neighbouring windows, and equal windows are in the
stretches of equal hashes. Where a hash occurs more than once, the match is extended from
there both ways: first by the whole stretch, whose windows are all repeats if an earlier
stretch is equal, then, for the stretches left, window by window. All but the first
occurrence of a window or line are repeats, and the words that repeats cover are deleted.

What is deleted was compared by two hashes of different polynomials, of 64 and of 32 bits,
so that among 10^13 windows two unlike ones agree with a chance under 10^-3.

The first occurrence is the one in the row of the smallest doc_id (then of the smallest
xxhash64 of the text), then the leftmost. Rows are put in that order first, so a row's
number says which of two comes first. Within one text a window repeats an earlier one only if the two
don't overlap; a stretch only if it doesn't overlap the earlier one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext
from .common import drop_table, unused, write_table

#: Words of a run that counts as repeated, and of the spans that are hashed.
RUN, SPAN = 50, 25
#: Words that a line of the text needs to count as repeated by itself.
LINE = 8
#: A hash is frequent if more than 1/HOT of all stretches have it.
HOT = 1000
#: Groups that the stretches of a frequent hash are dealt out to.
SALTS = 64
#: Frequent hashes are told from one stretch of so many (a plan switch: results are the same).
LOOK = 16
#: Odd bases of the two polynomials (fractions of the golden ratio and of root 2).
BASES = (0x9E3779B97F4A7C15, 0x6A09E667F3BCC909)
#: Kinds of stretches: repeats, and others whose windows are compared, of rare and of frequent hashes.
REPEAT, RARE, FREQUENT = range(3)
FOUND = "row long, at long, n int, kind int"


def selected(grams: np.ndarray, text: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Places of the window minima of the spans, in each text, all of equal minima's
    rightmost, with the first and the number of the windows that each is the minimum of.
    A text with fewer spans than the window selects none."""
    n = len(grams) - window + 1
    if n <= 0:
        return (np.zeros(0, dtype=np.int64),) * 3
    least, at, width = grams, np.arange(len(grams)), 1
    while width < window:  # minima of ever wider windows, the rightmost of equal ones
        step = min(width, window - width)
        m = len(least) - step
        right = least[step:] <= least[:m]
        least, at = np.minimum(least[step:], least[:m]), np.where(right, at[step:], at[:m])
        width += step
    whole = np.flatnonzero((text[window - 1 :] == text[:n]) & (grams[window - 1 :] != 0) & (grams[:n] != 0))
    at = at[whole]
    new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]][: len(at)])
    return at[new], whole[new], np.diff(np.append(new, len(at)))


class Words:
    """The words of a run of texts: starts, ends, their text, hashes, and each text's first."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.n = data, len(offsets) - 1
        self.starts, self.ends = bytetext.words(data, offsets)
        self.before = np.searchsorted(self.starts, offsets)
        self.text = np.repeat(np.arange(self.n), np.diff(self.before))
        self.hashes = bytetext.word_hashes(data, self.starts, self.ends)
        self.sums = {base: bytetext.sums(self.hashes, base) for base in BASES}

    def spans(self, size: int, base: int) -> np.ndarray:
        """Hash of the `size` words that begin at each word; 0 where the text ends before."""
        out = np.zeros(len(self.text), dtype=np.uint64)
        first = np.arange(max(0, len(out) - size + 1))
        first = first[self.text[first + size - 1] == self.text[first]]
        out[first] = bytetext.window_sums(self.hashes, first, first + size, base, self.sums[base])
        return out

    def hashed(self, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of stretches of words a hash, and their place in the text over half of another."""
        one, two = (bytetext.window_sums(self.hashes, first, end, base, self.sums[base]) for base in BASES)
        spot = (first - self.before[self.text[first]]).astype(np.int64) << 32 | (two >> np.uint64(32)).astype(np.int64)
        return one, spot

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """First word and word after the last of every line that has words."""
        if not len(self.text):
            return (np.zeros(0, dtype=np.int64),) * 2
        feeds = np.cumsum(self.data == 10)[self.starts]
        new = np.r_[True, (feeds[1:] != feeds[:-1]) | (self.text[1:] != self.text[:-1])]
        first = np.flatnonzero(new)
        return first, np.r_[first[1:], len(self.text)]


def _word_lists(texts: pa.Array) -> Iterator[tuple[int, Words]]:
    for row, data, offsets in bytetext.slices(texts):
        yield row, Words(data, offsets)


def _table(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({name: pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for name, x in columns.items()})


def _stretches(run: int, span: int, line: int):
    """hash, key, n, row, spot of the stretches of windows by the span they select, and of
    the lines, which are shorter than run: the span's hash, two hashes of all n words."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for row, w in _word_lists(batch.column(1)):
                grams = w.spans(span, BASES[0])
                at, first, windows = selected(grams, w.text, run - span + 1)
                lines, ends = w.lines()
                fit = (ends - lines >= line) & (ends - lines < run)
                lines, ends = lines[fit], ends[fit]
                starts, ends = np.r_[first, lines], np.r_[first + windows + (run - 1), ends]
                key, spot = w.hashed(starts, ends)
                found = np.r_[grams[at], ~key[len(at) :]]  # a line's is no span's
                yield _table({"hash": found, "key": key, "n": (ends - starts).astype(np.int32), "row": rows[row + w.text[starts]], "spot": spot})

    return go


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """The columns of batches sorted by the first, the rows of each of its values together."""
    held: list[list[np.ndarray]] = []  # of the value seen last
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        cut = int(np.searchsorted(now[0], now[0][-1]))
        if cut or (held and held[-1][0][-1] != now[0][0]):
            yield [np.concatenate(x) for x in zip(*held, [c[:cut] for c in now], strict=True)]
            held = []
        held.append([c[cut:] for c in now])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _met(others: bool):
    """row, at, n, kind of stretches of hash, key, n, row, spot sorted by the first, where a
    hash has more than one: REPEAT if an earlier one is equal, else, if asked for, RARE if
    the hash has another one that is no repeat."""

    def told(hashes, key, n, row, spot):
        new = np.r_[True, hashes[1:] != hashes[:-1]]
        some = np.flatnonzero(~(new & np.r_[new[1:], True]))
        group = np.cumsum(new)[some]
        key, n, row, spot = (x[some] for x in (key, n, row, spot))
        at, half = spot >> 32, spot & 0xFFFFFFFF
        order = np.lexsort((at, row, n, half, key, group))
        group, key, n, row, at, half = (x[order] for x in (group, key, n, row, at, half))
        same = np.zeros(len(group), dtype=bool)
        same[1:] = (group[1:] == group[:-1]) & (key[1:] == key[:-1]) & (half[1:] == half[:-1]) & (n[1:] == n[:-1])
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(group))))
        again = same & ((row != row[first]) | (at >= at[first] + n))
        left = np.bincount(group[~again], minlength=len(new) + 1)
        use = again | others & (left[group] > 1)
        kind = np.where(again, REPEAT, RARE).astype(np.int32)
        return _table({"row": row[use], "at": at[use], "n": n[use], "kind": kind[use]})

    return lambda batches: (told(*columns) for columns in _groups(batches))


def _windows(run: int):
    """row, hash, spot, many of the windows of words in the given stretches; many as given."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places = batch.column(0).to_numpy(), batch.column(2)
            for row, w in _word_lists(batch.column(1)):
                some = places.slice(row, w.n)
                at, n, many = (some.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(3))
                text = np.repeat(np.arange(w.n), some.value_lengths().to_numpy())
                size = n.astype(np.int64) - (run - 1)
                ends = np.cumsum(size)
                first = np.repeat(w.before[text] + at - ends + size, size) + np.arange(size.sum())
                key, spot = w.hashed(first, first + run)
                yield _table({"row": rows[row + w.text[first]], "hash": key, "spot": spot, "many": np.repeat(many, size)})

    return go


def _later(others: bool):
    """row, at, n, kind of the stretches of hash, salt, n, row, spot, sorted by these: of
    all but the first of the equal ones as REPEAT and, if asked for, of others as FREQUENT.
    Of the first of a hash and salt only its place is kept."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # hash, salt, row and spot of the first stretch of the group seen last
        for batch in batches:
            if not batch.num_rows:
                continue
            key, salt, n, row, spot = (batch.column(i).to_numpy() for i in range(5))
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
            new[0] = held is None or (key[0], salt[0]) != held[:2]
            first = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            first_row, first_spot = row[first], spot[first]
            if held is not None:
                first_row, first_spot = np.where(first >= 0, first_row, held[2]), np.where(first >= 0, first_spot, held[3])
            held = key[-1], salt[-1], first_row[-1], first_spot[-1]
            same = (spot ^ first_spot) & 0xFFFFFFFF == 0
            again = ~new & same & ((row != first_row) | (spot >> 32 >= (first_spot >> 32) + n))
            use = (n > 0) & (again | others)
            kind = np.where(again, REPEAT, FREQUENT).astype(np.int32)
            yield _table({"row": row[use], "at": spot[use] >> 32, "n": n[use], "kind": kind[use]})

    return go


def later(rows: DataFrame, others: bool = False) -> DataFrame:
    """row, at, n, kind of the stretches row, hash, spot, n, whose hashes may be frequent: of
    all but the first of the equal ones as REPEAT and, if asked for, of others as FREQUENT.

    One sorted pass. A hash's stretches are dealt out to SALTS groups, each of which begins
    with the first stretch of all: with n = 0, so it sorts first.
    """
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS))
    rows = rows.select("hash", salt.cast("int").alias("salt"), "n", "row", "spot")
    groups = rows.groupBy("hash", "salt").agg(F.min(F.struct("row", "spot")).alias("first"))
    firsts = groups.groupBy("hash").agg(F.min("first").alias("first"), F.collect_list("salt").alias("salts"))
    marks = firsts.select("hash", F.explode("salts").alias("salt"), F.lit(0).alias("n"), "first.row", "first.spot")
    ordered = rows.unionByName(marks).repartition("hash", "salt").sortWithinPartitions("hash", "salt", "n", "row", "spot")
    return ordered.mapInArrow(_later(others), FOUND)


def met(rows: DataFrame, others: bool = False) -> DataFrame:
    """row, at, n, kind of the stretches hash, key, n, row, spot, no hash of which is frequent."""
    rows = rows.select("hash", "key", "n", "row", "spot")
    return rows.repartition("hash").sortWithinPartitions("hash").mapInArrow(_met(others), FOUND)


def joined_runs(at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of the runs that the stretches at:at+size cover together."""
    order = np.argsort(at, kind="stable")
    at, reach = at[order], np.maximum.accumulate((at + size)[order])
    cuts = np.flatnonzero(at[1:] > reach[:-1]) + 1
    return at[np.r_[0, cuts]], reach[np.r_[cuts - 1, len(at) - 1]]


def runs_of_rows(row: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where each row begins in the given stretches, which are sorted by row, and the owner
    (a number of these), first and end of the rows' runs."""
    new = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    text = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(row))))
    # All texts at once: each one's places lie beyond those of the text before.
    base = np.concatenate(([0], np.cumsum(np.maximum.reduceat(at + size, new) + 1)))
    a, b = joined_runs(at + base[text], size)
    owner = np.searchsorted(base, a, side="right") - 1
    return new, owner, a - base[owner], b - base[owner]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, runs of row, at, n, sorted by row."""
    for row, at, size in _groups(batches):
        new, owner, a, b = runs_of_rows(row, at, size)
        values = pa.StructArray.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        offsets = pa.array(np.searchsorted(owner, np.arange(len(new) + 1)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(row[new]), pa.ListArray.from_arrays(offsets, values)], ["row", "runs"])


def _apart(first: dict[str, np.ndarray]):
    """row, at, n, kind, hash, spot of the stretches key, n, row, spot: as REPEAT the runs of
    those that equal one of the given ones (key, n, row, spot, sorted by key), which are the
    first of their kind, and don't overlap it; the others as they are, as FREQUENT."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key, n, row, spot = (c.to_numpy() for c in batch.columns)
            at = spot >> 32
            i = np.minimum(np.searchsorted(first["key"], key), len(first["key"]) - 1)
            same = (first["key"][i] == key) & (first["n"][i] == n) & ((first["spot"][i] ^ spot) & 0xFFFFFFFF == 0)
            again = same & ((row != first["row"][i]) | (at >= (first["spot"][i] >> 32) + n))
            rest = np.flatnonzero(~again)
            kind = np.full(len(rest), FREQUENT, dtype=np.int32)
            yield _table({"row": row[rest], "at": at[rest], "n": n[rest], "kind": kind, "hash": key[rest], "spot": spot[rest]})
            if again.any():
                told = np.flatnonzero(again)
                told = told[np.argsort(row[told], kind="stable")]
                new, owner, a, b = runs_of_rows(row[told], at[told], n[told].astype(np.int64))
                none = np.zeros(len(a), dtype=np.int64)
                yield _table({"row": row[told][new][owner], "at": a, "n": (b - a).astype(np.int32), "kind": none.astype(np.int32) + REPEAT, "hash": none, "spot": none})

    return go


def apart(stretches: DataFrame, least: float) -> DataFrame:
    """_apart() of stretches key, n, row, spot, written. Those that occur `least` times are
    few; each one's first is taken from partial minima and sent to where the others lie, so
    that copies of a frequent stretch are told in their place, whatever their number."""
    half = F.col("spot").bitwiseAND(F.lit(0xFFFFFFFF)).alias("half")
    firsts = stretches.groupBy("key", "n", half).agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("row", "spot")).alias("first"))
    found = firsts.where(F.col("times") >= least).select("key", "n", "first.row", "first.spot").collect()
    columns = np.array(sorted([(0, 0, 0, 0), *map(tuple, found)]), dtype=np.int64).T  # one of no words, as there may be none
    first = dict(zip(("key", "n", "row", "spot"), columns, strict=True))
    return write_table(stretches.mapInArrow(_apart(first), f"{FOUND}, hash long, spot long"))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, places of row, at, n, many, sorted by row."""
    for row, *fields in _groups(batches):
        new = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        values = pa.StructArray.from_arrays([pa.array(x) for x in fields], ["at", "n", "many"])
        offsets = pa.array(np.append(new, len(row)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(row[new]), pa.ListArray.from_arrays(offsets, values)], ["row", "places"])


def cut_all(texts: pa.Array, runs: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts without the given runs (lists of a, b: first word, word after the last, in
    order) and the white space after each of them, and the number of their words."""
    kept, sizes, lengths = [], [], []
    for row, data, offsets in bytetext.slices(texts):
        starts, _ = bytetext.words(data, offsets)
        before = np.searchsorted(starts, offsets)
        some = runs.slice(row, len(offsets) - 1)
        a, b = (some.flatten().field(k).to_numpy() for k in (0, 1))
        text = np.repeat(np.arange(len(some)), some.value_lengths().fill_null(0).to_numpy())
        first, end = before[text] + a, before[text] + b
        starts = np.append(starts, len(data))
        gone = starts[first], np.where(end < before[text + 1], starts[end], offsets[text + 1])
        kept += [data[p:q] for p, q in zip(np.r_[0, gone[1]].tolist(), np.r_[gone[0], len(data)].tolist(), strict=True)]
        sizes.append(np.diff(before))
        lengths.append(np.diff(offsets) - np.bincount(text, gone[1] - gone[0], len(some)).astype(np.int64))
    if not sizes:
        return texts, np.zeros(0, dtype=np.int64)
    offsets = np.concatenate(([0], np.cumsum(np.concatenate(lengths)))).astype(np.int32)
    valid = texts.is_valid().buffers()[1] if texts.null_count else None
    left = pa.Array.from_buffers(pa.string(), len(texts), [valid, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(kept))])
    return left, np.concatenate(sizes).astype(np.int64)


def cut(text: bytes, word_runs: list[tuple[int, int]]) -> tuple[bytes, int]:
    """cut_all() of one text."""
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    left, size = cut_all(pa.array([text.decode()]), pa.array([[{"a": a, "b": b} for a, b in word_runs]], kind))
    return left[0].as_py().encode(), int(size[0])


def _remover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, runs, number of words, others of text, runs, any number, others."""
    for batch in batches:
        left, sizes = cut_all(batch.column(0), batch.column(1))
        yield pa.RecordBatch.from_arrays([left, batch.column(1), pa.array(sizes), *batch.columns[3:]], batch.schema.names)


def repeats(docs: DataFrame, run: int = RUN, span: int = SPAN, line: int = LINE) -> DataFrame:
    """row, runs (array of a, b: first word and word after the last) of every row that has
    any; docs is a written table with columns row (distinct, in the order of rows), text."""
    if not 1 <= span <= run or line < 1:
        raise ValueError("span must be 1 to run, line 1 or more")
    given = docs.select("row", F.col("text").cast("string").alias("text"))
    stretches = write_table(given.mapInArrow(_stretches(run, span, line), "hash long, key long, n int, row long, spot long"))
    # The stretches of a hash meet in one task, but for those that more than 1/HOT of all
    # have (2 * HOT at most): of these, copies of a frequent stretch are told in their place
    # and the equal ones of the others meet, dealt out to groups.
    look = stretches.where(F.pmod(F.xxhash64("row", "spot"), F.lit(LOOK)) == 0)
    many = max(1000, stretches.count() // HOT + 1) / (2 * LOOK)
    counts = look.groupBy("hash").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") >= many)
    frequent = [r["hash"] for r in counts.select("hash").collect()]
    found = met(stretches.where(~F.col("hash").isin(frequent)), others=True)
    used = [stretches]
    if frequent:
        told = apart(stretches.where(F.col("hash").isin(frequent)).select("key", "n", "row", "spot"), many * LOOK)
        rest = told.where(F.col("kind") != REPEAT).select("row", "hash", "spot", "n")
        found = found.unionByName(told.where(F.col("kind") == REPEAT).select("row", "at", "n", "kind")).unionByName(later(rest, others=True))
        used.append(told)
    found = write_table(found)
    for done in used:
        drop_table(done)
    # The windows of those that are no repeats as a whole; what joins the texts grows with
    # them, so the plan is the same at every size.
    by_row = lambda rows: rows.repartition("row").sortWithinPartitions("row")
    places = found.where((F.col("kind") != REPEAT) & (F.col("n") >= run)).select("row", "at", "n", (F.col("kind") == FREQUENT).alias("many"))
    places = by_row(places).mapInArrow(_places, "row long, places array<struct<at: long, n: int, many: boolean>>")
    windows = given.join(places.hint("shuffle_hash"), "row").select("row", "text", "places")
    windows = write_table(windows.mapInArrow(_windows(run), "row long, hash long, spot long, many boolean"))
    alike = windows.select("hash", F.col("hash").alias("key"), F.lit(run).alias("n"), "row", "spot", "many")
    every = found.unionByName(met(alike.where("not many")))
    if frequent:
        every = every.unionByName(later(alike.where("many")))
    every = every.where(F.col("kind") == REPEAT).select("row", "at", F.col("n").cast("long").alias("n"))
    runs = write_table(by_row(every).mapInArrow(_runs, "row long, runs array<struct<a: bigint, b: bigint>>"))
    for done in (found, windows):
        drop_table(done)
    return runs


def _deduped(docs: DataFrame, run: int, span: int, line: int) -> tuple[DataFrame, str, str]:
    """docs, deduplicated, with the runs and the number of words in columns so named."""
    names = docs.columns
    row, runs, size = (unused(n, names) for n in ("row__", "runs__", "words__"))
    # Numbered once, in order: later jobs must see the same numbers, however they split rows.
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text")]
    held = write_table(docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(row, F.monotonically_increasing_id()))
    found = repeats(held.select(F.col(row).alias("row"), "text"), run, span, line).toDF(row, runs)
    others = [c for c in names if c != "text"]
    number = F.lit(0).cast("long").alias(size)
    joined = held.join(found.hint("shuffle_hash"), row, "left").select(F.col("text").cast("string").alias("text"), runs, number, *others)
    return joined.mapInArrow(_remover, joined.schema), runs, size


def dedup(docs: DataFrame, run: int = RUN, span: int = SPAN, line: int = LINE) -> DataFrame:
    """doc_id, text, words, removed_words, runs of every row of docs.

    text lacks the repeated runs, with the white space after each; words counts those of
    the given text; runs lists the removed ones as first:end in words, comma-joined.
    Null text stays null and, like texts without a run or a long enough line, has no
    runs. A null doc_id ranks after all others, of equal ones the smaller xxhash64 of the
    text first; rows that repeat a row are whole copies of it. A text of any length is looked at whole, by itself. An empty table gives no rows;
    further columns are ignored.
    """
    done, runs, words = _deduped(docs.select("doc_id", "text"), run, span, line)
    size = F.aggregate(F.coalesce(runs, F.array().cast(done.schema[runs].dataType)), F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"])
    listed = F.coalesce(F.array_join(F.transform(runs, lambda r: F.concat_ws(":", r["a"], r["b"])), ","), F.lit(""))
    return done.select("doc_id", "text", F.col(words).alias("words"), size.alias("removed_words"), listed.alias("runs"))


def without_repeats(docs: DataFrame, run: int = RUN, span: int = SPAN, line: int = LINE) -> DataFrame:
    """docs with the texts of dedup(); columns are those of docs, whatever their names."""
    return _deduped(docs, run, span, line)[0].select(*docs.columns)
