"""Dereplication: one record for equal, prefix-equal or similar sequences."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeforge.functions import lineage as L
from cladeforge.functions.consensus import consensus, most_common
from cladeforge.functions.sequence import to_dna
from cladeforge.operators import align
from cladeforge.operators.rounds import cut
from cladeforge.schema import SEVEN_RANKS, check_choice, check_range, handles


def _order(sequences: DataFrame) -> str:
    return "ord" if "ord" in sequences.columns else "id"


def _members(sequences: DataFrame, derep_prefix: bool, perc_identity: float, min_length: int) -> DataFrame:
    """id, ord, centroid of every sequence of min_length or more; see clusters().

    Equal sequences meet by a 256-bit digest, so the letters stay where they are; only
    for prefixes and similarity are those of the centroids joined. A prefix has the first
    min_length letters of its extensions, so those of centroids that share them with no
    other (told by a hash) are not looked at.
    """
    key = F.upper(to_dna(F.col("seq")))
    keys = sequences.select("id", F.col(_order(sequences)).alias("ord"), key.alias("key")).where(F.length("key") >= min_length)
    rows = keys.select("id", "ord", F.unhex(F.sha2("key", 256)).alias("digest"), F.xxhash64(F.substring("key", 1, max(0, min_length))).alias("head"))
    if derep_prefix:
        rows = cut(rows)  # read several times, the letters once
    kinds = rows.groupBy("digest").agg(F.min(F.struct("ord", "id")).alias("first"), F.count(F.lit(1)).alias("n"), F.first("head").alias("head"))
    kinds = kinds.select("digest", F.col("first.id").alias("centroid"), F.col("first.ord").alias("ord"), "n", "head")
    out = rows.join(kinds.select("digest", "centroid"), "digest").select("id", "ord", "centroid")
    if not derep_prefix and perc_identity >= 1:
        return out
    letters = keys.select(F.col("id").alias("centroid"), "key")
    if derep_prefix:
        heads = kinds.groupBy("head").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
        shared = kinds.join(heads, "head", "left_semi")
        moves = _prefix_map(shared.select("centroid", "ord", "n").join(letters, "centroid"))
        out = _recentred(out, moves)
        kinds = kinds.join(moves, "centroid", "left_anti")
    kinds = kinds.select("centroid", "ord").join(letters, "centroid")
    if perc_identity < 1:
        out = _recentred(out, align.greedy_clusters(kinds.select(F.col("centroid").alias("id"), "ord", F.col("key").alias("seq")), perc_identity))
    return out


def clusters(sequences: DataFrame, derep_prefix: bool = False, perc_identity: float = 1.0, min_length: int = 32) -> DataFrame:
    """id, centroid of every sequence of min_length or more; ids are distinct.

    Sequences are compared without case, T and U alike. A cluster's centroid is its first
    record in the order of the column ord (of id, where there is none). derep_prefix puts
    sequences with their longer extensions, the shortest of them (then the most abundant,
    then the first). Below an identity of 1 the centroids are clustered in turn.
    """
    return _members(sequences, derep_prefix, perc_identity, min_length).select("id", "centroid")


def _recentred(members: DataFrame, moves: DataFrame) -> DataFrame:
    """members with centroids replaced by the target of moves (centroid, target)."""
    return members.join(moves, "centroid", "left").select("id", "ord", F.coalesce("target", "centroid").alias("centroid"))


PREFIXED = "centroid string, inner boolean, size long, n long, ord {ord}, target string, open array<int>"


def _sorted_prefixes(firsts: dict[int, str]):
    """Over rows part, key, centroid, ord, n sorted by part and key: of each row whether
    another one extends it, and the best that does in its part: the shortest that nothing
    extends, then the most abundant, then the first. open: later parts that begin with
    extensions, too (firsts has the first key of each part).

    In this order the extensions of a key follow it, so a stack of the keys that still
    may be extended is all that is kept, and each key enters and leaves it once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[list] = []  # key, centroid, inner, best, part
        done: list[tuple] = []
        kinds: list[pa.DataType] = []

        def leave(at_edge: bool) -> None:
            key, centroid, inner, best, part = stack.pop()
            later = []
            if at_edge:
                for q in range(part + 1, max(firsts) + 1):
                    if q in firsts and not firsts[q].startswith(key):
                        break
                    later += [q] if q in firsts else []
            if stack and (inner or not later):  # what later parts extend is no target
                stack[-1][3] = min(filter(None, (stack[-1][3], best)), default=None, key=lambda b: b[:4])
            size, n, _, order, target = best if best and (inner or not later) else (None,) * 5
            inner = inner or bool(later)
            done.append((centroid, inner, size, -n if n is not None else None, order, target if inner else None, later))

        def rows() -> pa.RecordBatch:
            columns = [pa.array(list(c), t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, ["centroid", "inner", "size", "n", "ord", "target", "open"])

        part = None
        for batch in batches:
            kinds = [pa.string(), pa.bool_(), pa.int64(), pa.int64(), batch.column(3).type, pa.string(), pa.list_(pa.int32())]
            for own, key, centroid, order, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                while stack and (own != part or not key.startswith(stack[-1][0])):
                    leave(own != part)
                if stack:
                    if not stack[-1][2]:
                        stack[-1][2:4] = True, None  # not a target itself
                part = own
                stack.append([key, centroid, False, (len(key), -n, order is not None, order, centroid), own])
            if done:
                yield rows()
        while stack:
            leave(True)
        if done:
            yield rows()

    return run


def _prefix_map(kinds: DataFrame) -> DataFrame:
    """centroid, target of the sequences (distinct keys) that others extend; only sequences
    that nothing extends are targets.

    One pass over the keys in order, in ranges; every range is a task. A key whose
    extensions go on in later ranges is open at the end of its own, which the ranges' first
    keys tell (as many keys as ranges, which Spark's range partitioning holds as well); the
    open ones, few, then meet the rows of those ranges. No letters travel but for the order.
    """
    ranged = kinds.select("key", "centroid", "ord", "n").repartitionByRange("key")
    ranged = cut(ranged.select(F.spark_partition_id().alias("part"), "key", "centroid", "ord", "n"))
    firsts = {r["part"]: r["key"] for r in ranged.groupBy("part").agg(F.min("key").alias("key")).collect()}
    order_type = kinds.schema["ord"].dataType.simpleString()
    inside = ranged.sortWithinPartitions("part", "key").mapInArrow(_sorted_prefixes(firsts), PREFIXED.format(ord=order_type))
    inside = cut(inside)
    found = inside.where("inner and target is not null").select(F.col("centroid").alias("short"), "size", "n", "ord", "target")
    edge = inside.where(F.size("open") > 0).select(F.col("centroid").alias("short"), F.explode("open").alias("part"))
    edge = edge.join(ranged.select(F.col("centroid").alias("short"), F.col("key").alias("short_key")), "short")
    whole = inside.where("not inner").select("centroid")
    beyond = ranged.join(edge, "part").where(F.startswith("key", "short_key")).join(whole, "centroid", "left_semi")
    beyond = beyond.select("short", F.length("key").cast("long").alias("size"), "n", "ord", F.col("centroid").alias("target"))
    best = F.struct("size", -F.col("n"), "ord")
    return found.union(beyond).groupBy("short").agg(F.min_by("target", best).alias("target")).withColumnRenamed("short", "centroid")


def dereplicate(
    sequences: DataFrame,
    taxa: DataFrame,
    mode: str = "uniq",
    perc_identity: float = 1.0,
    rank_handles: list[str] | None = None,
    derep_prefix: bool = False,
    min_length: int = 32,
) -> tuple[DataFrame, DataFrame]:
    """(sequences, taxonomy) of the clusters.

    uniq keeps each centroid and, for every other lineage in its cluster, the first record
    that has it. lca, super, majority keep the centroids with a consensus lineage each.
    Lineages are trimmed and get the bare prefixes of missing last ranks.
    """
    check_choice("mode", mode, ("uniq", "lca", "majority", "super"))
    check_range("perc_identity", perc_identity, 0, 1, open_low=True)
    prefixes = handles(SEVEN_RANKS if rank_handles is None else rank_handles)
    members = _members(sequences, derep_prefix, perc_identity, min_length)
    tidy = taxa.withColumn("taxon", L.lineage(L.labels(F.col("taxon"))))
    ranked = members.join(tidy.select(F.col("feature_id").alias("id"), "taxon"), "id")
    filled = lambda parts: L.lineage(L.backfilled(parts, prefixes)).alias("taxon")
    if mode == "uniq":
        own = F.col("id") == F.col("centroid")
        first = ranked.groupBy("centroid", "taxon").agg(F.min_by("id", F.struct(~own, "ord", "id")).alias("id"))
        kept = first.select("id")
        labelled = tidy.join(kept, tidy.feature_id == kept.id, "left_semi")
        others = [c for c in taxa.columns if c not in ("feature_id", "taxon")]
        taxonomy = labelled.select("feature_id", filled(F.split("taxon", ";")), *others)
    else:
        kept = members.select(F.col("centroid").alias("id")).distinct()
        if mode == "majority":
            found = most_common(ranked, "centroid", "taxon").withColumn("parts", F.split("taxon", ";"))
        else:
            found = consensus(ranked.withColumn("parts", F.split("taxon", ";")), "centroid", "parts", mode)
        taxonomy = found.select(F.col("centroid").alias("feature_id"), filled(F.col("parts")))
    return sequences.join(kept, "id", "left_semi"), taxonomy
