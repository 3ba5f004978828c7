"""Language-model scoring with a hidden Markov model of words.

Method: Baum-Welch. Every partition runs the scaled forward-backward recursion over its
documents and returns expected counts, Spark sums them, and the sums are the next model.
The scaled forward recursion then gives each text's exact likelihood.

All rounds run over all training documents and whole texts, until a round gains less than
TOLERANCE of the log-likelihood. In the rounds but the last, the states emit classes: each
of the TOP most frequent words is its own class, the end of a text is one, and the other
words are dealt to RARE classes by a hash; so what tasks hold of the corpus is bounded. In
the last round every word counts for itself: its expected counts in each state are summed
over all training words, and each document is scored with the sums of its own words. To
the expected count E(w) of w in a state, whose words are E in all, come 0.1 E / N and
50 u(w), with u(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)); divided by their sum over V + 1
words, the 1 standing for all unseen ones, that is what the state emits. So the whole is a
probability over texts whose unseen words are not told apart.

Texts are encoded once, into rows of some BLOCK tokens: their classes, a number of two
bytes each, in the order in which the recursions read them, and the block's distinct rare
words. A block's rare words go to their buckets by hash with the block's counts of them,
where the counts of all blocks are summed, and the sums come back by block: each word
travels once for a block and not once for a text.

A text is looked at as a whole whatever its length; of one of more than BLOCK tokens the
forward pass keeps the ends of stretches only.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, write_table

STATES = 8
TOP = 32_768
RARE = 1024
#: Rounds of Baum-Welch end when one gains less than this share of the log-likelihood, or
#: after ROUNDS of them; the last one, over words, follows.
TOLERANCE, ROUNDS = 0.005, 8
#: Weight, in tokens, of the unigram that each state is drawn towards.
WEIGHT = 50.0
#: Distinct words a task counts before it hands them over.
COUNTED_WORDS = 200_000
#: Texts and bytes of texts that are split into words together.
TEXTS, BYTES = 1000, 4_000_000
#: Tokens of a block, over which the recursions run together; steps of up to PIECE tokens
#: are looked up and summed together; at most LANES texts run side by side.
BLOCK, PIECE, LANES = 4_000_000, 131_072, 2048
#: Rows of sums that are added up together, and words of blocks that meet in a bucket.
CHUNK, BUCKET = 1024, 150_000
#: Stands for the end of a text; no word has a space.
END = " "
SMOOTH = 0.1


def held_out(modulus: int, remainder: int):
    """Whether crc32 of the doc_id as text leaves the remainder; false for null."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number of the words before each text and all words, lower-cased (A-Z)."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string()).fill_null("")))
    offsets = split.offsets.to_numpy()
    words = split.values.slice(offsets[0], offsets[-1] - offsets[0])
    some = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate(([0], np.cumsum(some.to_numpy(zero_copy_only=False))))
    return before[offsets - offsets[0]], words.filter(some)


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of up to TEXTS rows and BYTES in the column, or of one row."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES, side="right"))
            to = min(max(at + 1, to), at + TEXTS)
            yield batch.slice(at, to - at)
            at = to


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []

    def summed() -> pa.Table:
        table = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
        return table.rename_columns(["word", "n"])

    for batch in _slices(batches, 0):
        found = words_of(batch.column(0))[1].value_counts()
        words, n = found.field("values"), found.field("counts").cast(pa.int64())
        held.append(pa.table({"word": pa.concat_arrays([words, pa.array([END])]), "n": pa.concat_arrays([n, pa.array([batch.num_rows])])}))
        if sum(t.num_rows for t in held) > 2 * COUNTED_WORDS:
            held = [summed()]
            if held[0].num_rows > COUNTED_WORDS:
                yield from held[0].combine_chunks().to_batches()
                held = []
    if held:
        yield from summed().combine_chunks().to_batches()


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c over all rows of docs, words lower-cased (A-Z), the end of texts included."""
    partial = docs.select(F.col("text").cast("string")).mapInArrow(_counts, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("c"))


def _hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words.cast(pa.binary()).to_pylist()), dtype=np.int64, count=len(words))


def _bytes(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def _code_type(classes: int) -> str:
    return "<u2" if classes <= 1 << 16 else "<u4"


def _encoded(ids: list[pa.Array], lengths: list[np.ndarray], codes: list[np.ndarray], rare: list[pa.Array], first_rare: int, rare_classes: int) -> list:
    """A block of texts: doc_ids and lengths in the order of the lanes, texts of each lane,
    classes by step, distinct rare words by hash, and the number of each rare token's word."""
    kinds = pa.chunked_array(rare, pa.string()).combine_chunks().dictionary_encode()
    words, number = kinds.dictionary, kinds.indices.to_numpy(zero_copy_only=False)
    hashes = _hashes(words)
    by_hash = np.argsort(hashes, kind="stable")
    rank = np.empty(len(words), dtype=np.int32)
    rank[by_hash] = np.arange(len(words), dtype=np.int32)
    order, lanes = Lanes.dealt(np.concatenate(lengths))
    every = np.concatenate(codes)
    at = np.flatnonzero(every < 0)
    every[at] = (hashes % rare_classes + first_rare)[number]
    slots = np.zeros(len(every), dtype=np.int32)
    slots[at] = rank[number]
    given = np.concatenate(lengths)
    moved = _runs((np.cumsum(given) - given)[order], lanes.lengths)
    places = lanes.places()
    every[places], slots[places] = every[moved], slots[moved]
    return [
        pa.chunked_array(ids).combine_chunks().take(pa.array(order)),
        _bytes(lanes.lengths.astype("<i4")),
        _bytes(lanes.texts.astype("<i4")),
        _bytes(every.astype(_code_type(first_rare + rare_classes))),
        _bytes(slots[every >= first_rare].astype("<i4")),
        words.take(pa.array(by_hash)),
        len(words),
    ]


BLOCKS = ["held_out", "ids", "lengths", "texts", "codes", "slots", "words", "n_words"]


def _encoder(top: pa.Array, rare_classes: int):
    """Blocks of texts that are held out, or of others: see _encoded(). The end's class is
    0, that of a frequent word its place in top + 1, and the rare ones' classes follow."""

    def block(held: bool, parts: list[tuple]) -> pa.RecordBatch:
        ids, *binaries, words, n = _encoded(*map(list, zip(*parts, strict=True)), len(top) + 1, rare_classes)
        listed = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, words)]
        return pa.RecordBatch.from_arrays(
            [pa.array([held]), listed[0], *(pa.array([x], pa.binary()) for x in binaries), listed[1], pa.array([n], pa.int32())], BLOCKS
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[bool, list[tuple]] = {False: [], True: []}
        for batch in _slices(batches, 2):
            for held, kept in parts.items():
                given = batch.filter(pc.equal(batch.column(1), held))
                if not given.num_rows:
                    continue
                before, words = words_of(given.column(2))
                codes = pc.index_in(words, value_set=top).fill_null(-2).to_numpy(zero_copy_only=False).astype(np.int32) + 1
                rare = words.take(pa.array(np.flatnonzero(codes < 0)))
                kept.append((given.column(0), np.diff(before) + 1, np.insert(codes, before[1:], 0), rare))
                if sum(len(p[2]) for p in kept) >= BLOCK:
                    yield block(held, kept)
                    kept.clear()
        for held, kept in parts.items():
            if kept:
                yield block(held, kept)

    return run


class Model:
    """Start, transition and emission probabilities; emission is classes x states."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, unigram: np.ndarray, states: int = STATES, seed: int = 1) -> Model:
        rng = np.random.default_rng(seed)
        emit = unigram[:, None] * np.exp(rng.normal(size=(len(unigram), states)))
        move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(axis=0))

    @classmethod
    def of_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, unigram: np.ndarray, weight: float = 50):
        """From expected counts, each state drawn towards the unigram of all classes."""
        emit = emit + weight * unigram[:, None]
        start, move = start + 0.1, move + 0.1
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _index(array: np.ndarray) -> np.ndarray:
    """Rising whole numbers in four bytes, where they fit."""
    return array.astype(np.int32) if not len(array) or array[-1] < 1 << 31 else array


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of runs of such starts and lengths, one run after the other."""
    ends = np.cumsum(lengths)
    kind = np.int32 if not len(ends) or ends[-1] + starts.max() < 1 << 31 else np.int64
    out = np.arange(ends[-1] if len(ends) else 0, dtype=kind)
    out += np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    return out


class Lanes:
    """Texts side by side: each lane holds texts one after the other, lanes being longest
    first, and step t has the token t of all lanes that have one. It lies at cuts[t] :
    cuts[t + 1], so that no place is padded and what is done for a step runs along memory.

    lengths: of the texts, lane by lane; texts: number of them in each lane."""

    def __init__(self, lengths: np.ndarray, texts: np.ndarray):
        self.lengths, self.texts = lengths.astype(np.int64), texts.astype(np.int64)
        before, first = np.concatenate(([0], np.cumsum(self.lengths))), np.concatenate(([0], np.cumsum(self.texts)))
        self.sizes = np.diff(before[first])
        live = np.searchsorted(-self.sizes, -np.arange(1, self.sizes[0] + 1), side="right")
        self.cuts = np.concatenate(([0], np.cumsum(live)))
        lane = np.repeat(np.arange(len(self.texts)), self.texts)
        step = before[:-1] - before[first[:-1]][lane]
        by_step = np.argsort(step, kind="stable")
        #: Lanes in which a text starts, by step; those of step t at start_at[t] : start_at[t + 1].
        self.starting, self.start_at = lane[by_step], np.searchsorted(step[by_step], np.arange(len(live) + 1))
        self.start_places = self.cuts[step[by_step]] + self.starting

    @classmethod
    def dealt(cls, lengths: np.ndarray) -> tuple[np.ndarray, Lanes]:
        """The texts' order in lanes of like size, and these. The longest text sets the steps."""
        total, longest = int(lengths.sum()), int(lengths.max())
        lanes: list[list[int]] = [[] for _ in range(min(LANES, len(lengths), -(-total // longest)))]
        sizes = [(0, i) for i in range(len(lanes))]
        for text in np.argsort(-lengths, kind="stable").tolist():
            size, i = sizes[0]
            lanes[i].append(text)
            heapq.heapreplace(sizes, (size + int(lengths[text]), i))
        lanes = [lanes[i] for _, i in sorted(sizes, key=lambda x: (-x[0], x[1]))]
        order = np.concatenate([np.array(texts) for texts in lanes])
        return order, cls(lengths[order], np.array([len(texts) for texts in lanes]))

    def places(self) -> np.ndarray:
        """The place of each token, taken lane by lane."""
        out = _index(self.cuts)[_runs(np.zeros_like(self.sizes), self.sizes)]
        out += np.repeat(_index(np.arange(len(self.sizes))), self.sizes)
        return out

    def placed(self, values: np.ndarray) -> np.ndarray:
        out = np.empty_like(values)
        out[self.places()] = values
        return out

    def stretches(self, size: int, steps: tuple[int, int] | None = None) -> list[tuple[int, int]]:
        """First step and the one after the last of stretches of up to size places, a step at least."""
        at, end = steps or (0, len(self.cuts) - 1)
        out = []
        while at < end:
            to = min(end, max(at + 1, int(np.searchsorted(self.cuts, self.cuts[at] + size, side="right")) - 1))
            out.append((at, to))
            at = to
        return out


def blocks(sequences: list[np.ndarray]) -> Iterator[tuple[np.ndarray, Lanes, np.ndarray]]:
    """Sequences' numbers in the order of lanes, these, and the classes by step, of up to
    BLOCK tokens or a single sequence."""
    ends = np.cumsum([len(s) for s in sequences])
    at = 0
    while at < len(sequences):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, side="right")))
        order, lanes = Lanes.dealt(np.array([len(s) for s in sequences[at:to]]))
        yield order + at, lanes, lanes.placed(np.concatenate([sequences[at + i] for i in order]))
        at = to


def _forward(model: Model, lanes: Lanes, codes: np.ndarray, stretch: tuple[int, int], before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward probabilities (places x states) and scales of a stretch; before: the
    probabilities of the step before it, None at the start."""
    cuts = lanes.cuts[stretch[0] : stretch[1] + 1]
    alpha = np.take(model.emit, codes[cuts[0] : cuts[-1]], axis=0, mode="clip")
    scales = np.empty(len(alpha), dtype=alpha.dtype)
    states, widest = len(model.start), int(cuts[1] - cuts[0])
    ones = np.ones((states, states), dtype=alpha.dtype)
    moved, sums = np.empty((widest, states), dtype=alpha.dtype), np.empty((widest, states), dtype=alpha.dtype)
    cuts, starting = (cuts - cuts[0]).tolist(), lanes.starting
    starts = lanes.start_at[stretch[0] : stretch[1] + 1].tolist()
    for a, b, c, d in zip(cuts, cuts[1:], starts, starts[1:], strict=False):
        now, come, total = alpha[a:b], moved[: b - a], sums[: b - a]
        if before is not None:
            np.matmul(before[: b - a], model.move, out=come)
        if d > c:
            come[starting[c:d]] = model.start
        now *= come
        np.matmul(now, ones, out=total)  # each row's sum, in all its columns
        now /= total
        scales[a:b] = total[:, 0]
        before = now
    return alpha, scales


def _logs(model: Model, lanes: Lanes, codes: np.ndarray) -> np.ndarray:
    """Natural log probability of each text, in the order of the lanes."""
    logs, before = np.empty(lanes.cuts[-1]), None
    for stretch in lanes.stretches(PIECE):
        alpha, scales = _forward(model, lanes, codes, stretch, before)
        logs[lanes.cuts[stretch[0]] : lanes.cuts[stretch[1]]] = np.log(scales)
        before = alpha[len(alpha) - (lanes.cuts[stretch[1]] - lanes.cuts[stretch[1] - 1]) :].copy()
    return np.add.reduceat(logs[lanes.places()], np.cumsum(lanes.lengths) - lanes.lengths)


def log_likelihoods(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each sequence of classes, by the scaled forward recursion."""
    out = np.zeros(len(sequences))
    for numbers, lanes, codes in blocks(sequences):
        out[numbers] = _logs(model, lanes, codes)
    return out


class Expected:
    """Expected starts, transitions and emissions, and the log-likelihood, summed up."""

    def __init__(self, states: int, classes: int):
        self.start, self.move, self.emit = np.zeros(states), np.zeros((states, states)), np.zeros((classes, states))
        self.log = 0.0

    def add(self, model: Model, lanes: Lanes, codes: np.ndarray, asked: np.ndarray | None = None) -> np.ndarray | None:
        """Counts a block; returns the states' probabilities at the asked places (rising)."""
        stretches, ends = lanes.stretches(BLOCK), [None]
        for stretch in stretches[:-1]:
            width = lanes.cuts[stretch[1]] - lanes.cuts[stretch[1] - 1]
            ends.append(_forward(model, lanes, codes, stretch, ends[-1])[0][-width:].copy())
        beta = np.ones((len(lanes.sizes), len(model.start)), dtype=model.emit.dtype)
        told = None if asked is None else np.empty((len(asked), len(model.start)), dtype=model.emit.dtype)
        for stretch, before in zip(stretches[::-1], ends[::-1], strict=True):
            alpha, scales = _forward(model, lanes, codes, stretch, before)
            self.log += float(np.log(scales, dtype=np.float64).sum())
            first = lanes.cuts[stretch[0]]
            for piece in lanes.stretches(PIECE, stretch)[::-1]:
                a, b = lanes.cuts[piece[0]] - first, lanes.cuts[piece[1]] - first
                last = alpha[lanes.cuts[piece[0] - 1] - first : a] if piece[0] > stretch[0] else before
                held = self._piece(model, lanes, codes, piece, alpha[a:b], scales[a:b], last, beta)
                if told is not None:
                    c, d = np.searchsorted(asked, [first + a, first + b])
                    np.take(held, asked[c:d] - (first + a), axis=0, out=told[c:d])
        return told

    def _piece(self, model: Model, lanes: Lanes, codes: np.ndarray, piece: tuple[int, int], alpha: np.ndarray, scales: np.ndarray, last: np.ndarray | None, beta: np.ndarray) -> np.ndarray:
        """The states' probabilities at the piece's places. last: forward probabilities of the
        step before; beta: backward ones of each lane after the piece, on return before it."""
        cuts = lanes.cuts[piece[0] : piece[1] + 1]
        codes, cuts = codes[cuts[0] : cuts[-1]], (cuts - cuts[0]).tolist()
        starts, starting = lanes.start_at[piece[0] : piece[1] + 1].tolist(), lanes.starting
        given = np.take(model.emit, codes, axis=0, mode="clip")
        given /= scales[:, None]
        held, turned = np.empty_like(given), np.ascontiguousarray(model.move.T)
        for t in range(len(cuts) - 2, -1, -1):
            a, b, c, d = cuts[t], cuts[t + 1], starts[t], starts[t + 1]
            here, after = beta[: b - a], given[a:b]
            held[a:b] = here
            after *= here
            if d > c:
                new = starting[c:d]
                after[new] = 0  # nothing moves from one text to the next
                np.matmul(after, turned, out=here)
                here[new] = 1
            else:
                np.matmul(after, turned, out=here)
        moved = np.zeros(model.move.shape)
        if last is not None:
            moved += last[: cuts[1]].T @ given[: cuts[1]]
        # Runs of steps as wide as the one before each: its tokens lie that many places back.
        width = np.diff(cuts)
        edges = [0, *(np.flatnonzero(np.diff(width)) + 1).tolist(), len(width)]
        for x, y in zip(edges, edges[1:], strict=False):
            if x:
                moved += alpha[cuts[x - 1] : cuts[x - 1] + cuts[x + 1] - cuts[x]].T @ given[cuts[x] : cuts[x + 1]]
            for a in range(cuts[x + 1], cuts[y], PIECE // 8):
                b = min(cuts[y], a + PIECE // 8)
                moved += alpha[a - width[x] : b - width[x]].T @ given[a:b]
        self.move += model.move * moved
        held *= alpha
        first = slice(starts[0], starts[-1])
        self.start += held[lanes.start_places[first] - lanes.cuts[piece[0]]].sum(axis=0, dtype=np.float64)
        for k in range(len(self.start)):
            self.emit[:, k] += np.bincount(codes, weights=held[:, k], minlength=len(self.emit))
        return held


def expected_counts(model: Model, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, transitions and emissions over the sequences."""
    found = Expected(len(model.start), len(model.emit))
    for _, lanes, codes in blocks(sequences):
        found.add(model, lanes, codes)
    return found.start, found.move, found.emit


def _lanes(row: dict) -> Lanes:
    return Lanes(np.frombuffer(row["lengths"], "<i4"), np.frombuffer(row["texts"], "<i4"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Blocks one by one; lists stay in Arrow."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: c[i].values if pa.types.is_list(c.type) else c[i].as_py() for name, c in zip(batch.schema.names, batch.columns, strict=True)}


def _chunks(total: Expected) -> Iterator[tuple[int, bytes]]:
    """Number and sums of each CHUNK of rows that has any: emissions of the classes, starts,
    moves and the log-likelihood."""
    states = len(total.start)
    table = np.vstack([total.emit, total.start[None, :], total.move, np.full((1, states), total.log / states)])
    for i, at in enumerate(range(0, len(table), CHUNK)):
        if table[at : at + CHUNK].any():
            yield i, _bytes(table[at : at + CHUNK])


def _of_chunks(rows: list, states: int, classes: int) -> Expected:
    """The sums (classes and a few more: bounded) as one object; rows: chunk, sums."""
    table = np.zeros((classes + states + 2, states))
    for chunk, sums in rows:
        table[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(sums).reshape(-1, states)
    out = Expected(states, classes)
    out.emit[:], out.start[:], out.move[:] = table[:classes], table[classes], table[classes + 1 : -1]
    out.log = float(table[-1].sum())
    return out


def _added(batches: Iterator[pa.RecordBatch], column: str) -> bytes:
    total: np.ndarray | float = 0.0
    for batch in batches:
        for x in batch.column(column):
            total = total + np.frombuffer(x.as_buffer())
    return _bytes(total)


def _single(model: Model) -> Model:
    return Model(*(np.ascontiguousarray(x, dtype=np.float32) for x in (model.start, model.move, model.emit)))


def _expecter(model: Model):
    """Expected counts of a partition over the classes."""
    model = _single(model)
    classes, states = model.emit.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Expected(states, classes)
        for row in _rows(batches):
            total.add(model, _lanes(row), np.frombuffer(row["codes"], _code_type(classes)))
        for chunk, sums in _chunks(total):
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "sums": pa.array([sums], pa.binary())})

    return run


def _add_chunks(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_pydict({"chunk": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([_added(batches, "sums")], pa.binary())})


def baum_welch(coded: DataFrame, model: Model, unigram: np.ndarray) -> tuple[Model, float]:
    """One round over the classes of all rows: the next model, and the log-likelihood of
    this one."""
    found = coded.select("lengths", "texts", "codes").mapInArrow(_expecter(model), "chunk int, sums binary")
    sums = write_table(found.groupBy("chunk").applyInArrow(_add_chunks, "chunk int, sums binary"))
    found = _of_chunks(sums.collect(), len(model.start), len(unigram))
    drop_table(sums)
    return Model.of_counts(found.start, found.move, found.emit, unigram, WEIGHT), found.log


def fit(coded: DataFrame, class_counts: np.ndarray) -> Model:
    """The model of classes of all blocks."""
    unigram = (class_counts + SMOOTH) / (class_counts.sum() + SMOOTH * len(class_counts))
    model, before = Model.first(unigram), -math.inf
    for _ in range(ROUNDS if class_counts.any() else 0):
        model, log = baum_welch(coded, model, unigram)
        if log - before < -TOLERANCE * log:
            break
        before = log
    return model


WORDS = "bucket int, block long, words array<string>, counts binary, sums binary"
TOLD = "bucket int, block long, counts binary, sums binary"


def _asker(model: Model, first_rare: int, buckets: int):
    """The rare words of each block by bucket, in the block's order, with their number and
    expected counts by state in it (null where it is held out); the partition's sums over
    classes, as buckets -1, -2 and so on."""
    model = _single(model)
    classes, states = model.emit.shape
    kinds = [pa.int32(), pa.int64(), pa.list_(pa.string()), pa.binary(), pa.binary()]

    def rows(*columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["bucket", "block", "words", "counts", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Expected(states, classes)
        for row in _rows(batches):
            words = row["words"]
            if not row["held_out"]:
                codes, slots = np.frombuffer(row["codes"], _code_type(classes)), np.frombuffer(row["slots"], "<i4")
                told = total.add(model, _lanes(row), codes, np.flatnonzero(codes >= first_rare))
                counts = np.bincount(slots, minlength=len(words)).astype("<i8")
                sums = np.column_stack([np.bincount(slots, weights=told[:, k], minlength=len(words)) for k in range(states)]).astype("<f4")
            of = _hashes(words) * buckets >> 32
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(of)) + 1, [len(of)])) if len(of) else np.zeros(1, dtype=np.int64)
            listed = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), words)
            parts = list(zip(cuts.tolist(), cuts[1:].tolist(), strict=False))
            none = [None] * len(parts)
            found = (none, none) if row["held_out"] else ([_bytes(x[a:b]) for a, b in parts] for x in (counts, sums))
            yield rows(of[cuts[:-1]].tolist(), [row["block"]] * len(parts), listed, *found)
        chunks = list(_chunks(total))
        none = [None] * len(chunks)
        yield rows([-1 - i for i, _ in chunks], none, none, none, [x for _, x in chunks])

    return run


def _answerer(states: int):
    """The words of a bucket, of all blocks: for each block its words' counts in all."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = key[0].as_py()
        names = ["bucket", "block", "counts", "sums"]
        if bucket < 0:
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([_added(batches, "sums")])], names)
            return
        table = pa.Table.from_batches(batches)
        listed = table.column("words").combine_chunks()
        ends = np.concatenate(([0], np.cumsum(pc.list_value_length(listed).to_numpy(zero_copy_only=False))))
        kinds = listed.flatten().dictionary_encode()
        number, size = kinds.indices.to_numpy(zero_copy_only=False), len(kinds.dictionary)
        learned = np.repeat(table.column("counts").is_valid().to_numpy(), np.diff(ends))
        joined = lambda name, kind: np.frombuffer(b"".join(table.column(name).drop_null().to_pylist()), kind)
        n, given = joined("counts", "<i8"), joined("sums", "<f4").reshape(-1, states)
        seen = number[learned]
        counts = np.zeros(size, dtype="<i8")
        np.add.at(counts, seen, n)
        sums = np.column_stack([np.bincount(seen, weights=given[:, k], minlength=size) for k in range(states)]).astype("<f4")
        for block, a, b in zip(table.column("block").to_pylist(), ends, ends[1:], strict=False):
            asked = number[a:b]
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int32()), pa.array([block], pa.int64()), pa.array([_bytes(counts[asked])]), pa.array([_bytes(sums[asked])])], names
            )

    return run


def _scorer(model: Model, base_log: np.ndarray, known: np.ndarray, least: np.ndarray, whole: np.ndarray, total: float, classes: int):
    """Number of tokens, of known ones, base and score of each text of a block, given the
    counts of its rare words, whole and by state (0 for words that training didn't see)."""
    first_rare, states = len(known), len(model.start)

    def run(blocks: pa.Table, told: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return pa.table({name: pa.array([], kind) for name, kind in zip(SCORED, [blocks.schema.field("ids").type.value_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()], strict=True)})
        row = next(_rows(blocks.combine_chunks().to_batches()))
        lanes = _lanes(row)
        codes = np.frombuffer(row["codes"], _code_type(classes)).astype(np.int64)
        told = told.sort_by("bucket")
        joined = lambda name, kind: np.frombuffer(b"".join(told.column(name).to_pylist()), kind)
        counts, sums = joined("counts", "<i8"), joined("sums", "<f4").reshape(-1, states)
        codes[codes >= first_rare] = first_rare + np.frombuffer(row["slots"], "<i4")
        emit = (sums + least + WEIGHT * ((counts + SMOOTH) / total)[:, None]) / whole
        order, starts = codes[lanes.places()], np.cumsum(lanes.lengths) - lanes.lengths
        found = [
            row["ids"],
            pa.array(np.full(len(starts), row["held_out"])),
            pa.array(lanes.lengths),
            pa.array(np.add.reduceat(np.concatenate([known, counts > 0])[order].astype(np.int64), starts)),
            pa.array(np.add.reduceat(np.concatenate([base_log, np.log10((counts + SMOOTH) / total)])[order], starts)),
            pa.array(_logs(Model(model.start, model.move, np.vstack([model.emit, emit])), lanes, codes) / math.log(10)),
        ]
        return pa.table(found, names=SCORED)

    return run


def _least_count(words: DataFrame, n: int) -> int:
    """A count that at least n words reach, or all if fewer, and not many more than n."""
    sizes = words.groupBy(F.floor(F.log2("c") * 64).alias("step")).agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("n"))
    above = 0
    for r in sorted(sizes.collect(), key=lambda r: -r["step"]):  # a row for each step of the logarithm
        above += r["n"]
        if above >= n:
            return r["c"]
    return 0


SCORED = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]


def score(docs: DataFrame, modulus: int = 10, remainder: int = 0, frequent: int = TOP, rare_classes: int = RARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Learns from the rows that are not held out. Null text counts as empty: its end alone
    is a token. Null doc_ids are not held out. Repeated rows count, and are scored, each;
    with no training rows base_score is 0 and so is score, all texts being of unseen words.
    An empty table gives no rows; further columns are ignored.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    given = docs.select(
        "doc_id",
        held_out(modulus, remainder).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    counts = write_table(word_counts(given.where("not held_out")))
    ends = F.sum(F.when(F.col("word") == END, F.col("c")))
    size = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), ends.alias("ends")).first()
    n, v, ends = size["n"] or 0, size["v"], size["ends"] or 0
    words = counts.where(F.col("word") != END)
    top = words.where(F.col("c") >= _least_count(words, frequent)).orderBy(F.desc("c"), "word").limit(frequent).toArrow()
    first_rare = top.num_rows + 1
    class_counts = np.zeros(first_rare + rare_classes)
    class_counts[:first_rare] = [ends, *top.column("c").to_pylist()]
    others = words.where(F.lit(False))
    if top.num_rows == frequent:
        c, word = top.column("c")[-1].as_py(), top.column("word")[-1].as_py()
        others = words.where((F.col("c") < c) | ((F.col("c") == c) & (F.col("word") > word)))
    kind = lambda word: (F.crc32(word.cast("binary")) % rare_classes + first_rare).cast("int")
    for r in others.groupBy(kind(F.col("word")).alias("class")).agg(F.sum("c").alias("n")).collect():
        class_counts[r["class"]] = r["n"]

    drop_table(counts)
    classes = len(class_counts)
    coded = given.mapInArrow(
        _encoder(top.column("word").combine_chunks().cast(pa.string()), rare_classes),
        f"held_out boolean, ids array<{id_type}>, lengths binary, texts binary, codes binary, slots binary, words array<string>, n_words int",
    )
    # Rows are large: Parquet's writer looks at its memory after each.
    coded = write_table(coded.withColumn("block", F.monotonically_increasing_id()), **{f"parquet.{x}.size.row.check.min": 1 for x in ("block", "page")})
    model = fit(coded.where("not held_out"), class_counts)
    # The last round: by word.
    buckets = -(-(coded.agg(F.sum("n_words")).first()[0] or 1) // BUCKET)
    asked = coded.select("block", "held_out", "lengths", "texts", "codes", "slots", "words").mapInArrow(_asker(model, first_rare, buckets), WORDS)
    told = write_table(asked.groupBy("bucket").applyInArrow(_answerer(STATES), TOLD))
    found = _of_chunks([(-1 - r["bucket"], r["sums"]) for r in told.where("bucket < 0").select("bucket", "sums").collect()], STATES, classes)
    total = float(n + SMOOTH * (v + 1))
    said = found.emit.sum(axis=0)
    least = SMOOTH * said / max(n, 1)
    whole = said + (v + 1) * least + WEIGHT
    emit = (found.emit[:first_rare] + least + WEIGHT * ((class_counts[:first_rare] + SMOOTH) / total)[:, None]) / whole
    start, move = found.start + 0.1, found.move + 0.1
    model = Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit)
    known = class_counts[:first_rare] > 0
    base_log = np.log10((class_counts[:first_rare] + SMOOTH) / total)
    texts = coded.select("block", "held_out", "ids", "lengths", "texts", "codes", "slots")
    done = texts.groupBy("block").cogroup(told.where("bucket >= 0").groupBy("block")).applyInArrow(
        _scorer(model, base_log, known, least, whole, total, classes),
        f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double",
    )
    return done.select(*SCORED[:4], F.lit(n).cast("long").alias("train_tokens"), *SCORED[4:])
