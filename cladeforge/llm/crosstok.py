"""Alignment of two tokenizers' tokens over the same bytes.

Method: segment deduplication. A text (after a space) is cut before every run of white
space that begins with a character of CUTS and follows another character than white space,
if no entry of either vocabulary holds such a place: then no merge of either tokenizer can
span it, and the segments' tokens, joined, are the text's. vocabularies_agree() tests this
for each character. Each distinct segment of all documents is tokenised and aligned once;
the alignments are joined back to the segments and the documents composed from them.

Documents travel in batches of bounded bytes (a longer document alone): a batch is one row
with its documents as numbers of its own distinct segments. So what is shuffled are the
distinct segments of a batch and the distinct pairs of ids of a batch, not the words of
documents, and a task holds one batch at a time. Distinct segments are dealt to buckets by
a hash, a row for each batch and bucket; a bucket, of which there are more the more batches
there are, aligns each of its segments once and sends them back to the batches.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, write_table

#: Characters before which a text may be cut.
CUTS = " \n\t"
#: Bytes of text of a batch; distinct segments tokenised together, and those from which a
#: task forgets the ones of earlier buckets.
BYTES, SEGMENTS, KNOWN = 8 << 20, 5000, 200_000


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes for
    themselves, the others for the letters from U+0100 on, in turn."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers: ids of many segments, the bytes of each id, and where to cut."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        model = sentencepiece_model_pb2.ModelProto()
        with open(path_b, "rb") as file:
            model.ParseFromString(file.read())
        model.normalizer_spec.add_dummy_prefix = False  # segments bring their own space
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        letters = _byte_letters()
        self.bytes_a = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        self.bytes_b = [
            bytes([int(p.piece[3:5], 16)]) if p.type == p.BYTE else p.piece.replace("▁", " ").encode() for p in model.pieces
        ]
        entries = [b.decode("utf-8", "replace") for b in (*self.bytes_a.values(), *self.bytes_b)]
        self.cuts = "".join(c for c in CUTS if vocabularies_agree(entries, c))
        self.find = segment_pattern(self.cuts)
        self.other = re.compile(rf"[^\S{self.cuts}]") if self.cuts else re.compile("")
        self.plain = re.compile(r"\s*\S+|\s+")
        self.size_a = np.zeros(max(self.bytes_a, default=0) + 1, dtype=np.int64)
        self.size_a[list(self.bytes_a)] = [len(b) for b in self.bytes_a.values()]
        self.size_b = np.array([len(b) for b in self.bytes_b], dtype=np.int64)

    def segments(self, text: str) -> list[str]:
        text = " " + text
        return (self.find if self.other.search(text) else self.plain).findall(text)

    def encode(self, segments: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        ones = self.a.encode_batch_fast(segments, add_special_tokens=False)
        return zip((e.ids for e in ones), self.b.encode(segments, num_threads=1), strict=True)


def vocabularies_agree(entries: list[str], cut: str) -> bool:
    """True if no entry has the character after another one than white space."""
    spans = re.compile(rf"\S{re.escape(cut)}")
    return not any(spans.search(e) for e in entries)


def segment_pattern(cuts: str) -> re.Pattern:
    """Matches a text's segments in turn; with no characters to cut at, the whole text."""
    if not cuts:
        return re.compile(r"(?s).+")
    return re.compile(rf"\s*\S+(?:[^\S{cuts}]\s*\S*)*|\s+")


@functools.lru_cache(maxsize=2)
def tools(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


#: Steps of a link: the A token, the B token or both follow those of the link before.
A_NEXT, B_NEXT, BOTH_NEXT = 1, 2, 3
#: A link as it travels.
LINK = np.dtype([("a", "<u4"), ("b", "<u4"), ("step", "u1")])
SMALL_LINK = np.dtype([("a", "<u2"), ("b", "<u2"), ("step", "u1")])


def align(segments: list[str], both: Tokenizers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of all segments in turn, how many each has, and which have tokens whose bytes
    aren't the segment's (none then). Groups begin where both tokens are new."""
    data = [s.encode() for s in segments]
    found = list(both.encode(segments))
    good = [b"".join(map(both.bytes_a.__getitem__, a)) == d == b"".join(map(both.bytes_b.__getitem__, b)) for d, (a, b) in zip(data, found, strict=True)]
    a, b = (np.array([t for pair, fine in zip(found, good, strict=True) if fine for t in pair[side]], dtype=np.int64) for side in (0, 1))
    end_a, end_b = np.cumsum(both.size_a[a]), np.cumsum(both.size_b[b])
    ends = np.union1d(end_a, end_b)
    links = np.empty(len(ends), dtype=link_type(both))
    in_a, in_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
    links["a"], links["b"] = a[in_a], b[in_b]
    new = lambda x: np.r_[True, x[1:] != x[:-1]] if len(x) else np.zeros(0, dtype=bool)
    links["step"] = new(in_a) * A_NEXT + new(in_b) * B_NEXT
    upto = np.searchsorted(ends, np.cumsum([len(d) if fine else 0 for d, fine in zip(data, good, strict=True)]), side="right")
    return links, np.diff(np.r_[0, upto]), ~np.array(good, dtype=bool)


def link_type(both: Tokenizers) -> np.dtype:
    return SMALL_LINK if max(len(both.bytes_a), len(both.bytes_b)) <= 1 << 16 else LINK


def group_texts(a: list[int], b: list[int], step: list[int], many: list[int]) -> list[str]:
    """`a1,a2|b1;a3|b2` of each run of so many links."""
    out, at = [], 0
    for n in many:
        if n == 1:
            out.append(f"{a[at]}|{b[at]}")
        else:
            groups: list[tuple[list[str], list[str]]] = []
            for k in range(at, at + n):
                if step[k] == BOTH_NEXT:
                    groups.append(([], []))
                if step[k] & A_NEXT:
                    groups[-1][0].append(str(a[k]))
                if step[k] & B_NEXT:
                    groups[-1][1].append(str(b[k]))
            out.append(";".join(f"{','.join(x)}|{','.join(y)}" for x, y in groups))
        at += n
    return out


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2**31, compressed: all low bytes first, then the next ones."""
    raw = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(packed: bytes) -> np.ndarray:
    raw = pa.decompress(packed[8:], decompressed_size=int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int32)


def _coded(paths: tuple[str, str], batch_bytes: int):
    """Rows of documents as batches: distinct segments, and every document as their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, part, made = tools(*paths).segments, TaskContext.get().partitionId(), 0
        number: dict[str, int] = defaultdict()
        number.default_factory = number.__len__
        ids, sizes, codes, size = [], [], [], 0

        def batch_row() -> pa.RecordBatch:
            flat = np.concatenate([np.zeros(0, dtype=np.int32), *codes])
            # Numbered anew, the most frequent first, so that the numbers pack well.
            order = np.argsort(-np.bincount(flat, minlength=len(number)), kind="stable")
            rank = np.empty(len(order), dtype=np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            segs = list(number)
            values = (part << 32) + made, ids, pack(np.array(sizes, dtype=np.int32)), pack(rank[flat]), [segs[k] for k in order]
            kinds = pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.string())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], ["batch", "doc_ids", "sizes", "codes", "segs"])

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                found = find(text) if text else []
                ids.append(doc.as_py())
                sizes.append(len(found))
                codes.append(np.fromiter(map(number.__getitem__, found), dtype=np.int32, count=len(found)))
                size += len(text or "") + 16
                if size > batch_bytes:
                    yield batch_row()
                    made += 1
                    number.clear()
                    ids, sizes, codes, size = [], [], [], 0
        if ids:
            yield batch_row()

    return run


def _dealt(buckets: int):
    """The segments of each batch by bucket: their numbers in the batch, and themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for of, segs in zip(batch.column(0), batch.column(1), strict=True):
                segs = segs.as_py()
                bucket = np.fromiter((zlib.crc32(s.encode()) for s in segs), dtype=np.int64, count=len(segs)) % buckets
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[order])) + 1
                parts = np.split(order, cuts) if len(order) else []
                columns = [pa.array([int(bucket[k[0]]) for k in parts], pa.int64()), pa.array([of.as_py()] * len(parts), pa.int64())]
                columns += [pa.array([k.astype(np.int32).tobytes() for k in parts], pa.binary()), pa.array([[segs[i] for i in k] for k in parts], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "of", "codes", "segs"])

    return run


ALIGNED = "of long, codes binary, many binary, links binary"


def _aligned(paths: tuple[str, str], together: int, most: int):
    """Over rows of whole buckets: each distinct segment is aligned once and every batch
    gets its own: codes, how many links each has (-1: bytes differ), and the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tools(*paths)
        known: dict[str, tuple[int, bytes]] = {}
        bucket, held = None, []

        def sent() -> pa.RecordBatch:
            new = list(dict.fromkeys(s for _, _, segs in held for s in segs if s not in known))
            for at in range(0, len(new), together):
                part = new[at : at + together]
                links, many, bad = align(part, both)
                upto = np.cumsum(many) * links.itemsize
                raw = links.tobytes()
                for s, n, end, wrong in zip(part, many.tolist(), upto.tolist(), bad.tolist(), strict=True):
                    known[s] = (-1, b"") if wrong else (n, raw[end - n * links.itemsize : end])
            got = [[known[s] for s in segs] for _, _, segs in held]
            many = [np.array([n for n, _ in g], dtype=np.int32).tobytes() for g in got]
            columns = [pa.array([of for of, _, _ in held], pa.int64()), *(pa.array(x, pa.binary()) for x in ([c for _, c, _ in held], many, [b"".join(x for _, x in g) for g in got]))]
            return pa.RecordBatch.from_arrays(columns, ["of", "codes", "many", "links"])

        for batch in batches:
            size = 0
            for own, of, codes, segs in zip(*batch.columns, strict=True):
                if own.as_py() != bucket:
                    if len(known) > most:
                        if held:
                            yield sent()
                        held, size = [], 0
                        known.clear()
                    bucket = own.as_py()
                held.append((of.as_py(), codes.as_py(), segs.as_py()))
                size += len(held[-1][2])
                if size > 8 * together:
                    yield sent()
                    held, size = [], 0
            if held:
                yield sent()
                held = []

    return run


COMPOSED = {
    "batch": pa.int64(),
    "doc_ids": pa.list_(pa.int64()),
    **{n: pa.list_(pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")},
    "sha": pa.list_(pa.string()),
    **{n: pa.binary() for n in ("links", "pair", "times")},
    **{n: pa.list_(pa.int32()) for n in ("a", "b", "n")},
}
COMPOSED_DDL = "batch long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, links binary, pair binary, times binary, a array<int>, b array<int>, n array<int>"


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _totals(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Whole-number sums of values by owner (ascending)."""
    sums = np.concatenate(([0], np.cumsum(values.astype(np.int64))))
    edges = np.searchsorted(owner, np.arange(n + 1))
    return sums[edges[1:]] - sums[edges[:-1]]


def _composer(kind: np.dtype):
    return lambda left, right: _composed(left, right, kind)


def _composed(left: pa.Table, right: pa.Table, kind: np.dtype) -> pa.Table:
    """A batch's documents from its segments' alignments: all but what counts of the whole
    corpus decide. links, pair, times: how many distinct pairs of ids each document has,
    which of the batch's pairs a, b they are and how often; n: documents with a pair."""
    sizes, codes = (unpack(left.column(n)[0].as_py()) for n in ("sizes", "codes"))
    docs = len(sizes)
    joined = lambda name, kind: np.frombuffer(b"".join(right.column(name).to_pylist()), dtype=kind)
    number, count, links = joined("codes", np.int32), joined("many", np.int32), joined("links", kind)
    bad, many, first = np.zeros(len(number), dtype=bool), np.zeros(len(number), dtype=np.int64), np.zeros(len(number), dtype=np.int64)
    bad[number], many[number] = count < 0, np.maximum(count, 0)
    first[number] = np.cumsum(np.maximum(count, 0)) - np.maximum(count, 0)
    doc = np.repeat(np.arange(docs), sizes)
    good = (_totals(bad[codes], doc, docs) == 0) & (sizes > 0)
    codes, doc = codes[good[doc]], doc[good[doc]]
    per = {"n_a": links["step"] & A_NEXT, "n_b": links["step"] // B_NEXT, "n_groups": links["step"] == BOTH_NEXT}
    sums = {n: np.concatenate(([0], np.cumsum(v, dtype=np.int64))) for n, v in per.items()}
    found = {n: _totals((v[first + many] - v[first])[codes], doc, docs) for n, v in sums.items()}
    found["n_links"] = _totals(many[codes], doc, docs)
    a, b = links["a"], links["b"]

    pairs, pair = np.unique((a.astype(np.int64) << 32) | b, return_inverse=True)
    kinds, times = np.unique(doc.astype(np.int64) * max(1, len(many)) + codes, return_counts=True)
    kind_doc, kind_code = np.divmod(kinds, max(1, len(many)))
    n = many[kind_code]
    place = np.repeat(first[kind_code] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    keys, inverse = np.unique(np.repeat(kind_doc, n) * max(1, len(pairs)) + pair[place], return_inverse=True)
    often = np.bincount(inverse, weights=np.repeat(times, n), minlength=len(keys)).astype(np.int64)
    link_doc, link_pair = np.divmod(keys, max(1, len(pairs)))
    used = np.bincount(link_pair, minlength=len(pairs))

    groups: list[str] = [""] * len(number)
    for k, text in zip(number.tolist(), group_texts(*(links[n].tolist() for n in ("a", "b", "step")), np.maximum(count, 0).tolist()), strict=True):
        groups[k] = text
    at = np.searchsorted(doc, np.arange(docs + 1))
    text = codes.tolist()
    sha = [hashlib.sha256(";".join([groups[c] for c in text[at[d] : at[d + 1]]]).encode()).hexdigest() if good[d] else "" for d in range(docs)]
    row = {"batch": left.column("batch")[0].as_py(), "doc_ids": left.column("doc_ids")[0].as_py(), "sha": sha} | found
    row |= {"links": pack(np.bincount(link_doc, minlength=docs)), "pair": pack(link_pair), "times": pack(often)}
    row |= {"a": (pairs >> 32).astype(np.int32), "b": (pairs & 0xFFFFFFFF).astype(np.int32), "n": used.astype(np.int32)}
    return pa.table({n: pa.array([row[n]], t) for n, t in COMPOSED.items()})


RESULT = {"doc_id": pa.int64(), **{n: pa.int64() for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")}, "groups_sha256": pa.string()}


def _finished(left: pa.Table, right: pa.Table) -> pa.Table:
    """A row a document, with the corpus-wide counts (pos, total, best) of the batch's pairs."""
    links, pair, times = (unpack(left.column(n)[0].as_py()) for n in ("links", "pair", "times"))
    docs = len(links)
    pos = _numbers(right.column("pos"))
    total, best = np.zeros(len(pos), dtype=np.int64), np.zeros(len(pos), dtype=np.int64)
    total[pos], best[pos] = _numbers(right.column("total")), _numbers(right.column("best"))
    doc = np.repeat(np.arange(docs), links)
    values = {n: left.column(n)[0].values for n in ("n_a", "n_b", "n_groups", "n_links")}
    values |= {"doc_id": left.column("doc_ids")[0].values, "groups_sha256": left.column("sha")[0].values}
    values |= {"n_best": pa.array(_totals(times.astype(np.int64) * best[pair], doc, docs)), "count_sum": pa.array(_totals(times.astype(np.int64) * total[pair], doc, docs))}
    return pa.table({n: values[n] for n in RESULT}, schema=pa.schema(RESULT))


def alignments(
    docs: DataFrame, paths: tuple[str, str] | None = None, batch_bytes: int = BYTES, together: int = SEGMENTS, most: int = KNOWN
) -> DataFrame:
    """doc_id (long), n_a, n_b, n_groups, n_links, n_best, count_sum (long), groups_sha256
    of every row of docs.

    A space and the text are encoded by a byte-level BPE tokenizer (A) and a SentencePiece
    BPE model (B; it brings the space itself); strings of special tokens are plain text.
    Places where tokens of both end cut them into groups; A and B tokens whose bytes overlap
    are links. An id pair's count is the number of rows with such a link. n_best: links with
    the highest count that their A id has anywhere; count_sum: counts summed over links.
    Rows with a null or empty text, or one that either tokenizer doesn't give back byte for
    byte, have zeros and an empty groups_sha256, and add to no count. Repeated rows are
    repeated and counted; a null doc_id stays null; an empty table gives no rows; further
    columns are ignored. The result doesn't depend on batch_bytes, together (segments tokenised
    at once) or most (those that a task remembers over buckets). Texts of any length are worked on whole, one that is longer than a
    batch by itself; a stretch without white space is one segment.
    """
    paths = paths or default_paths()
    coded = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    coded = write_table(coded.mapInArrow(_coded(paths, batch_bytes), "batch long, doc_ids array<long>, sizes binary, codes binary, segs array<string>"))
    buckets = max(64, 8 * coded.count())
    parts = coded.select("batch", "segs").mapInArrow(_dealt(buckets), "bucket long, of long, codes binary, segs array<string>")
    used = parts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_aligned(paths, together, most), ALIGNED)
    composed = coded.drop("segs").groupBy("batch").cogroup(used.groupBy("of")).applyInArrow(_composer(link_type(tools(*paths))), COMPOSED_DDL)
    composed = write_table(composed)
    drop_table(coded)

    pairs = composed.select(F.col("batch").alias("of"), F.posexplode(F.arrays_zip("a", "b", "n")).alias("pos", "p")).select("of", "pos", "p.*")
    counts = write_table(pairs.groupBy("a", "b").agg(F.sum(F.col("n").cast("long")).alias("total")).where("total > 0"))
    most = counts.groupBy("a").agg(F.max("total").alias("most"))
    judged = counts.join(most, "a").select("a", "b", "total", (F.col("total") == F.col("most")).cast("int").alias("best"))
    told = pairs.join(judged, ["a", "b"], "left").select("of", "pos", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("best", F.lit(0)).alias("best"))
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    whole = composed.drop("a", "b", "n").groupBy("batch").cogroup(told.groupBy("of"))
    return whole.applyInArrow(_finished, schema)
