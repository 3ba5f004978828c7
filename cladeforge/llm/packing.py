"""Packing of tokenized documents into training sequences of a fixed length.

Method: bounded-space online packing. Every partition keeps a fixed number of open
windows and places each document best-fit. When a document fits in none, it tops up
the fullest window, which is emitted, and its rest opens a new one. What stays open at
the end of the partitions is merged by a second pass over groups of partitions.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_table

WINDOW = 2048
END_ID = 1
#: Windows a partition keeps open.
OPEN_WINDOWS = 16
#: Partitions whose leftovers one merging task takes.
FAN_IN = 32
#: Words whose ids a Python worker remembers; the memory is bounded, results don't depend on it.
MEMO_WORDS = 1_000_000
#: Texts encoded together.
TEXTS = 200
ID_BYTES = 4


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    The tokenizer's pre-tokenization never spans ASCII white space, so a text's ids are
    those of its white-space separated chunks in turn, and those of a chunk are kept.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo: dict[bytes, bytes] = {}

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        split = [text.split() for text in texts]
        memo = self.memo
        missing = list(set().union(*split).difference(memo))
        if len(memo) + len(missing) > MEMO_WORDS:
            memo.clear()
            missing = list(set().union(*split))
        found = self.tokenizer.encode_batch_fast([c.decode() for c in missing], add_special_tokens=False)
        for chunk, encoding in zip(missing, found, strict=True):
            ids = encoding.ids
            memo[chunk] = struct.pack(f"<{len(ids)}I", *ids)
        return [b"".join(map(memo.__getitem__, chunks)) for chunks in split]


@functools.cache
def encoder(path: str) -> WordEncoder:
    """One for each Python worker, whichever tasks it runs."""
    return WordEncoder(path)


class Windows:
    """Open windows of one partition; place() yields the sequences it closes.

    A sequence is a list of pieces (document, start, ids, tokens of the document).
    """

    def __init__(self, window: int, limit: int):
        self.window, self.limit = window, limit
        self.open: list[list] = []  # [free, pieces]

    def place(self, doc, ids: bytes) -> Iterator[list]:
        total = len(ids) // ID_BYTES
        cut = lambda a, b: (doc, a, ids[a * ID_BYTES : b * ID_BYTES], total)
        start = 0
        while total - start >= self.window:
            yield [cut(start, start + self.window)]
            start += self.window
        size = total - start
        if not size:
            return
        fits = [w for w in self.open if w[0] >= size]
        if fits:
            best = min(fits, key=lambda w: w[0])
        elif len(self.open) < self.limit:
            best = [self.window, []]
            self.open.append(best)
        else:
            best = min(self.open, key=lambda w: w[0])
            best[1].append(cut(start, start + best[0]))
            yield best[1]
            start += best[0]
            best[0], best[1] = self.window, []
        best[0] -= total - start
        best[1].append(cut(start, total))
        if not best[0]:
            self.open.remove(best)
            yield best[1]


COLUMNS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _rows(sequence: list, sequence_id: int | None, keep_ids: bool) -> Iterator[tuple]:
    offset = 0
    for doc, start, ids, total in sequence:
        size = len(ids) // ID_BYTES
        yield doc, start, size, zlib.crc32(ids), total, sequence_id, offset, ids if keep_ids else None
        offset += size


def _packer(path: str, window: int, limit: int, types: list[pa.DataType]):
    def batch(rows: list[tuple], part: int) -> pa.RecordBatch:
        cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays([*cols, pa.array([part] * len(rows), pa.int64())], names=NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        windows, rows, closed, end = Windows(window, limit), [], 0, END_ID.to_bytes(ID_BYTES, "little")
        for b in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            for doc, coded in zip(b.column(0).to_pylist(), encoder(path).encode_all(texts), strict=True):
                for sequence in windows.place(doc, coded + end):
                    rows += _rows(sequence, part << 32 | closed, False)
                    closed += 1
            if rows:
                yield batch(rows, part)
                rows = []
        for _, pieces in windows.open:
            rows += _rows(pieces, None, True)
        if rows:
            yield batch(rows, part)

    return run


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "part"]


def _merger(window: int):
    """Joins the leftovers of a group of partitions end to end and cuts them into
    windows; the last, partial one is cut into powers of two, which need no padding."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        stream = pdf.sort_values(["part", "doc_id", "start"], kind="stable")
        total = int(stream["length"].sum())
        whole = total // window
        sizes = [window] * whole + [1 << b for b in range(window.bit_length(), -1, -1) if (total - whole * window) >> b & 1]
        out, number, free, offset = [], 0, sizes[0], 0
        for row in stream.itertuples(index=False):
            start, ids = row.start, row.ids
            while ids:
                size = min(free, len(ids) // ID_BYTES)
                piece, ids = ids[: size * ID_BYTES], ids[size * ID_BYTES :]
                out.append((row.doc_id, start, size, zlib.crc32(piece), row.doc_tokens, 1 << 62 | int(key[0]) << 32 | number, offset))
                start, offset, free = start + size, offset + size, free - size
                if not free and number + 1 < len(sizes):
                    number, offset = number + 1, 0
                    free = sizes[number]
        return pd.DataFrame(out, columns=NAMES[:7]).astype({"doc_id": pdf["doc_id"].dtype})

    return run


def pack(docs: DataFrame, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every row of docs gives the tokenizer's ids of its text and END_ID; null text counts
    as empty (END_ID alone). Each id lies in exactly one piece, pieces follow each other
    gaplessly in their sequence. Sequences are full windows, or powers of two where the
    leftovers of a group of partitions end. Null doc_ids are kept, repeated rows are
    packed once each, an empty table gives no rows, further columns are ignored.
    """
    given_type = docs.schema["doc_id"].dataType.simpleString()
    arrow_id = pa.int64() if given_type in ("bigint", "int", "smallint", "tinyint") else pa.string()
    given = docs.select(F.col("doc_id").cast("long" if arrow_id == pa.int64() else "string"), F.col("text").cast("string"))
    id_type = given.schema["doc_id"].dataType.simpleString()
    types = [arrow_id, *[pa.int64()] * 6, pa.binary()]
    path = tokenizer or default_tokenizer()
    pieces = write_table(
        given.mapInArrow(_packer(path, window, open_windows, types), f"doc_id {id_type}, {COLUMNS}, ids binary, part long")
    )
    left = pieces.where("sequence_id is null").withColumn("doc_id", F.col("doc_id").cast("string"))
    merged = (
        left.groupBy((F.col("part") / FAN_IN).cast("long").alias("merge"))
        .applyInPandas(_merger(window), f"doc_id string, {COLUMNS}")
        .withColumn("doc_id", F.col("doc_id").cast(id_type))
    )
    every = pieces.where("sequence_id is not null").select(NAMES[:7]).unionByName(merged)
    return every.withColumn("doc_id", F.col("doc_id").cast(given_type))
