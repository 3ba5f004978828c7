"""Operators on sequence tables (id, description, seq); all are projections and filters,
so they apply to streams as well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeforge.functions import sequence as S
from cladeforge.operators.rounds import cut
from cladeforge.schema import check_range, unused


def cull_seqs(sequences: DataFrame, num_degenerates: int = 5, homopolymer_length: int = 8) -> DataFrame:
    """Without sequences of num_degenerates or more degenerate letters, or a run of one
    letter of homopolymer_length or more."""
    check_range("num_degenerates", num_degenerates, 1)
    check_range("homopolymer_length", homopolymer_length, 2)
    seq = F.col("seq")
    return sequences.where((S.n_degenerate(seq) < num_degenerates) & ~S.has_homopolymer(seq, homopolymer_length))


def degap_seqs(aligned: DataFrame, min_length: int = 1) -> DataFrame:
    """Without gaps, and without sequences that are then shorter than min_length."""
    check_range("min_length", min_length, 1)
    return aligned.withColumn("seq", S.degapped(F.col("seq"))).where(F.length("seq") >= min_length)


def reverse_transcribe(rna: DataFrame) -> DataFrame:
    return rna.withColumn("seq", S.to_dna(F.col("seq")))


def _split(rows: DataFrame, passes: Column) -> tuple[DataFrame, DataFrame]:
    passes = F.coalesce(passes, F.lit(False))
    return rows.where(passes), rows.where(~passes)


def _within(size: Column, low: Column | None, high: Column | None) -> Column:
    out = F.lit(True)
    if low is not None:
        out = out & (size >= low)
    return out if high is None else out & (size <= high)


def filter_seqs_length(sequences: DataFrame, global_min: int | None = None, global_max: int | None = None):
    """(filtered, discarded) by length, bounds inclusive."""
    if global_min is None and global_max is None:
        raise ValueError("give at least one of global_min and global_max")
    for name, value in (("global_min", global_min), ("global_max", global_max)):
        check_range(name, value, 1)
    bounds = [None if v is None else F.lit(v) for v in (global_min, global_max)]
    return _split(sequences, _within(F.length("seq"), *bounds))


def missing_ids(rows: DataFrame, key: str, known: DataFrame, known_key: str, what: str) -> None:
    """Raises ValueError naming up to ten keys of rows that known lacks."""
    lacking = rows.join(known.select(F.col(known_key).alias(key)), key, "left_anti").select(key).distinct()
    if found := [r[0] for r in lacking.orderBy(key).limit(10).collect()]:
        raise ValueError(f"{what}: {', '.join(map(str, found))}")


def filter_seqs_length_by_taxon(
    sequences: DataFrame,
    taxonomy: DataFrame,
    labels: list[str],
    min_lens: list[int] | None = None,
    max_lens: list[int] | None = None,
    global_min: int | None = None,
    global_max: int | None = None,
    check_ids: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(filtered, discarded): by the strictest bounds of the labels that a lineage contains.

    Lineages without any of the labels are bound by the global lengths only. Of repeated
    labels the last bound counts. check_ids raises if a sequence has no lineage (a job).
    """
    if min_lens is None and max_lens is None:
        raise ValueError("give at least one of min_lens and max_lens")
    for name, lens in (("min_lens", min_lens), ("max_lens", max_lens)):
        if lens is not None and len(lens) != len(labels):
            raise ValueError(f"labels and {name} differ in length")
        for n in lens or ():
            check_range(name, n, 1)
    if check_ids:
        missing_ids(sequences, "id", taxonomy, "feature_id", "sequences without taxonomy")

    taxon = unused("taxon", sequences.columns)

    def strictest(lens: list[int] | None, bound: int | None, pick) -> Column:
        known = [F.when(F.contains(F.col(taxon), F.lit(k)), F.lit(n)) for k, n in dict(zip(labels, lens or (), strict=False)).items()]
        return pick(F.array(*known, F.lit(bound).cast("int")))

    low = strictest(min_lens, global_min, F.array_max)
    high = strictest(max_lens, global_max, F.array_min)
    size = F.length("seq")
    fits = F.coalesce(size >= low, F.lit(True)) & F.coalesce(size <= high, F.lit(True))
    taxa = taxonomy.select(F.col("feature_id").alias("id"), F.col("taxon").alias(taxon))
    kept, lost = _split(sequences.join(taxa, "id"), fits)
    return kept.select(*sequences.columns), lost.select(*sequences.columns)


def subsample_fasta(sequences: DataFrame, subsample_size: float = 0.1, random_seed: int = 1) -> DataFrame:
    """Each row with probability subsample_size, fixed by the seed and the id, so that the
    result depends neither on the partitions nor on a retry."""
    check_range("subsample_size", subsample_size, 0, 1, open_low=True)
    check_range("random_seed", random_seed, 1)
    return sequences.where(draw("id", random_seed) < subsample_size)


def draw(column: str, seed: int) -> Column:
    """A number from 0 to 1 for each value: the first 52 bits of the md5 of seed:value."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(column)).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def relabel(sequences: DataFrame, by: str, prefix: str = "", keep: bool = False, order: str = "id") -> DataFrame:
    """New ids: md5, sha1, self (the sequence), or ticker (prefix and a number in the
    order of a column). keep moves the old id to the description."""
    if by not in ("md5", "sha1", "self", "ticker"):
        raise ValueError(f"unknown relabelling {by!r}")
    seq = F.col("seq")
    if by == "ticker":
        return _numbered(sequences, prefix, keep, order)
    new = {"md5": F.md5(seq.cast("binary")), "sha1": F.sha1(seq.cast("binary")), "self": seq}[by]
    return _renamed(sequences, new, keep)


def _renamed(sequences: DataFrame, new: Column, keep: bool) -> DataFrame:
    """All at once, so that each new column is made of the old ones."""
    return sequences.withColumns({"id": new} | ({"description": F.col("id")} if keep else {}))


def _numbered(sequences: DataFrame, prefix: str, keep: bool, order: str) -> DataFrame:
    """Numbers rows in order without one task seeing them all: ranges, then offsets."""
    out, number = numbered(sequences, order)
    return _renamed(out, F.concat(F.lit(prefix), F.col(number).cast("string")), keep).select(*sequences.columns)


def numbered(rows: DataFrame, order: str) -> tuple[DataFrame, str]:
    """rows with a column of their numbers from 1 on in an order, and that column's name.

    Ranges are numbered by themselves, and those before one are counted: no task sees all
    rows. The ranges are kept (see rounds.cut), so that both speak of the same ones.
    """
    part, number, before = (unused(n, rows.columns) for n in ("part", "number", "before"))
    ranged = rows.repartitionByRange(F.col(order)).withColumn(part, F.spark_partition_id())
    ranged = cut(ranged.withColumn(number, F.row_number().over(Window.partitionBy(part).orderBy(order))))
    sizes = ranged.groupBy(part).agg(F.count(F.lit(1)).alias(before))  # a row a partition
    upto = sizes.select(part, (F.sum(before).over(Window.orderBy(part)) - F.col(before)).alias(before))
    out = ranged.join(F.broadcast(upto), part)
    return out.withColumn(number, F.col(number) + F.col(before)).drop(part, before), number


#: Bits of a draw that a pass decides, and of a whole draw.
DIGIT, DRAWN = 13, 52


def sample_exactly(rows: DataFrame, fraction: float, seed: int = 1, column: str = "id") -> DataFrame:
    """int(fraction x n) of the n rows, without replacement: those of the smallest draws of
    a column's values, the same for a seed on any partitioning.

    The bound is found digit by digit: a pass counts the draws by their next 13 bits, 8,192
    numbers at most. Of rows whose draw is the bound itself, the first ones by the column.
    """
    check_range("fraction", fraction, 0, 1)
    wanted = int(fraction * rows.count())
    if not wanted:
        return rows.where("false")
    drawn = F.floor(draw(column, seed) * float(1 << DRAWN)).cast("long")
    drawn = F.coalesce(drawn, F.lit((1 << DRAWN) - 1))
    left, bound = wanted, 0
    for shift in range(DRAWN - DIGIT, -1, -DIGIT):
        inside = rows.where(F.shiftright(drawn, shift + DIGIT) == bound)
        counts = inside.groupBy((F.shiftright(drawn, shift) % (1 << DIGIT)).alias("digit")).count().collect()
        for digit, n in sorted((r["digit"], r["count"]) for r in counts):
            if left <= n:
                bound = (bound << DIGIT) + digit
                break
            left -= n
    tied, number = numbered(rows.where(drawn == bound), column)
    return rows.where(drawn < bound).unionByName(tied.where(F.col(number) <= left).drop(number))


def abundance(sequences: DataFrame) -> Column:
    """The number in `;size=n` of an id, 1 without it."""
    n = F.regexp_extract(sequences["id"], r";size=([0-9]+)", 1)
    return F.when(n == "", F.lit(1)).otherwise(n.try_cast("long"))


def with_abundance(sequences: DataFrame, size: str) -> DataFrame:
    """ids with `;size=n` of a column, in place of one they have."""
    bare = F.regexp_replace("id", r";size=[0-9]+;?", "")
    return sequences.withColumn("id", F.concat(bare, F.lit(";size="), F.col(size).cast("string")))
