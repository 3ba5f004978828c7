"""SentencePiece encoding and decoding, for BPE models with byte fallback.

Method: streaming Viterbi. Over the characters of a text, every boundary keeps one
backpointer: the last piece of the encoding of the text before it. A piece may end there
if it is compatible with the last piece before its start, that is, if merging would
leave the two apart; of all pieces that end there just one is, so the surviving path is
that of merging by rank. Only the boundaries of the last `longest` characters are kept;
once the paths of all of them pass through one boundary, the pieces before it are
committed. All text goes this way, a stretch of characters at a time. As no piece spans
the boundary before white space (nor a line break that falls back to bytes), the paths
always meet there; the ids that a worker has committed between two such boundaries are
remembered and given out again.
"""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Words and pairs of pieces that a Python worker remembers; results don't depend on it.
MEMO_WORDS = 300_000
MEMO_PAIRS = 500_000
#: Texts worked on together.
TEXTS = 200
ID_BYTES = 4


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The vocabulary of a model: ranks of merged pieces, ids, and how pieces split."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        plain = [
            i for i in range(len(self.text)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        self.bytes = {int(self.text[i][3:5], 16): i for i in range(len(self.text)) if model.is_byte(i)}
        self.id = {self.text[i]: i for i in plain}
        order = sorted((i for i in plain if len(self.text[i]) > 1), key=lambda i: -model.get_score(i))
        self.rank = {self.text[i]: r for r, i in enumerate(order)}
        self.longest = max(map(len, self.id), default=1)
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.ends: dict = {}  # pieces that merging makes, as a trie from their last character back
        for text, i in self.id.items():
            if len(text) == 1 or self.split(text) is not None:
                node = self.ends
                for c in reversed(text):
                    node = node.setdefault(c, {})
                node[""] = i
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}
        special = [i for i in range(len(self.text)) if i not in set(self.bytes.values()) and self.text[i] not in self.id]
        self.raw = [t.replace(SPACE, " ").encode() for t in self.text]
        for b, i in self.bytes.items():
            self.raw[i] = bytes([b])
        for i in special:
            self.raw[i] = " ⁇ ".encode() if model.is_unknown(i) else b""
        self.inner_space = any(SPACE in t.lstrip(SPACE) for t in self.id)

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two parts whose merge makes a piece; None if merging never makes it."""
        if piece not in self.halves:
            parts, last = list(piece), None
            while len(parts) > 1:
                ranks = [self.rank.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
                some = [(r, i) for i, r in enumerate(ranks) if r is not None]
                if not some:
                    break
                i = min(some)[1]
                last = (parts[i], parts[i + 1])
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.halves[piece] = last if len(parts) == 1 else None
        return self.halves[piece]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves the pieces left | right apart.

        Undoes the merges of the two, latest first; a merge across the boundary that
        comes before the undone one would have been done.
        """
        rank, limit = self.rank, len(self.rank) + 1
        a, b = self.text[left], self.text[right]
        while True:
            across = rank.get(a + b)
            if across is not None and across < limit:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, self.split(a)[1]
            else:  # of equal merges the left one is first
                limit, b = rb + 1, self.split(b)[0]

    def _advance(self, window: str, last: list[int], first: int) -> None:
        """Appends the last piece before each boundary from `first` on; -1 for a character
        that falls back to bytes, as for the start."""
        pairs, ends = self.pairs, self.ends
        if len(pairs) > MEMO_PAIRS:
            pairs.clear()
        for end in range(first, len(window) + 1):
            chosen, node, start = -1, ends, end
            while start:
                start -= 1
                node = node.get(window[start])
                if node is None:
                    break
                piece = node.get("")
                if piece is None:
                    continue
                before = last[start]
                if before >= 0:
                    key = before << 20 | piece
                    apart = pairs.get(key)
                    if apart is None:
                        apart = pairs[key] = self.compatible(before, piece)
                    if not apart:
                        continue
                chosen = piece
                break
            last.append(chosen)

    def stream(self, stretches: Iterable[str]) -> Iterator[int]:
        """Ids of a text given in stretches of any length, given out as soon as they are certain."""
        window, last = "", [-1]  # the characters since the last committed boundary
        for stretch in stretches:
            window += stretch
            self._advance(window, last, len(last))
            if len(window) >= 2 * self.longest and (meet := self._meeting(last)):
                yield from self._ids(window, last, meet)
                window, last = window[meet:], last[meet:]
        yield from self._ids(window, last, len(window))

    def _size(self, piece: int) -> int:
        return len(self.text[piece]) if piece >= 0 else 1

    def _meeting(self, last: list[int]) -> int:
        """The latest boundary that the paths of all live boundaries pass through."""
        end = len(last) - 1
        live = set(range(end - self.longest + 1, end + 1))
        while len(live) > 1:
            top = max(live)
            live.remove(top)
            live.add(max(0, top - self._size(last[top])))
        return live.pop()

    def _ids(self, window: str, last: list[int], end: int) -> list[int]:
        out: list[int] = []
        while end > 0:
            piece = last[end]
            if piece >= 0:
                out.append(piece)
                end -= len(self.text[piece])
            else:
                out += [self.bytes.get(b, 0) for b in reversed(window[end - 1].encode())]
                end -= 1
        return out[::-1]

    def _packed(self, text: str) -> bytes:
        step = 2 * self.longest
        ids = list(self.stream(text[at : at + step] for at in range(0, len(text), step)))
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, words: list[list[str]], memo: dict[str, bytes], prefix: str) -> None:
        missing = set().union(*words).difference(memo)
        if len(memo) + len(missing) > MEMO_WORDS:
            memo.clear()
            missing = set().union(*words)
        for w in missing:
            memo[w] = self._packed(prefix + w)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of texts as little-endian unsigned 32-bit bytes."""
        newline = struct.pack("<I", self.bytes[10]) if "\n" not in self.id and 10 in self.bytes else None
        if newline is None or self.inner_space:
            return [self._packed(SPACE + t.replace(" ", SPACE)) if t else b"" for t in texts]
        lines = [[line.split(" ") for line in (" " + t.replace(SPACE, " ")).split("\n")] if t else [] for t in texts]
        odd = lambda words: "" in words[1:]  # noqa: E731  white space in a row
        self._learn([w[1:] for doc in lines for w in doc if not odd(w)], self.words, SPACE)
        self._learn([w[:1] for doc in lines for w in doc if not odd(w)], self.bare, "")
        word, bare = self.words.__getitem__, self.bare.__getitem__
        plain = lambda w: bare(w[0]) + b"".join(map(word, w[1:]))
        spaced = lambda w: b"".join(map(self._packed, re.findall(f"{SPACE}*[^{SPACE}]*", SPACE.join(w))))
        return [newline.join([spaced(w) if odd(w) else plain(w) for w in doc]) for doc in lines]

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids: pieces joined, the white space added before a text taken off again."""
        text = b"".join([self.raw[i] for i in ids]).decode(errors="replace")
        return text[1:] if text.startswith(" ") else text


@functools.cache
def pieces(path: str) -> Pieces:
    """One for each Python worker, whichever tasks it runs."""
    return Pieces(path)


def _encoder(path: str, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(path)
        for batch in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            coded = vocabulary.encode_all(texts)
            ends = np.concatenate(([0], np.cumsum([len(c) // ID_BYTES for c in coded]))).astype(np.int32)
            ids = np.frombuffer(b"".join(coded), dtype="<i4")
            columns, names = [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], ["doc_id", "ids"]
            if check:
                back = [vocabulary.decode(memoryview(c).cast("I")) for c in coded]
                same = [t.replace(SPACE, " ") == x for t, x in zip(texts, back, strict=True)]
                columns, names = [*columns, pa.array(same, pa.bool_())], [*names, "decoded_same"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode(docs: DataFrame, model: str | None = None, check: bool = False) -> DataFrame:
    """doc_id, ids of every row; null and empty texts have no ids.

    With check also decoded_same: whether decoding gives the text back (a null one as
    empty; the model has one character for blanks and U+2581). Repeated rows are
    repeated, null doc_ids kept, further columns ignored; an empty table gives no rows.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    given = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = f"doc_id {id_type}, ids array<int>" + (", decoded_same boolean" if check else "")
    return given.mapInArrow(_encoder(model or default_model(), check), schema)


def decoded(ids, model: str | None = None):
    """Column of the texts of a column of ids; null ids give null, unknown ids fail."""
    path = model or default_model()

    @F.arrow_udf("string")
    def go(lists: pa.Array) -> pa.Array:
        vocabulary = pieces(path)
        return pa.array([None if x is None else vocabulary.decode(x) for x in lists.to_pylist()], pa.string())

    return go(ids)


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids, decoded_same of every row; see encode()."""
    coded = encode(docs, model, check=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "decoded_same")
