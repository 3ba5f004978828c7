"""Orientation of sequences and reads by the words they share with a reference."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeforge.functions.dust import dust_masked
from cladeforge.functions.sequence import kmers, reverse_complement, to_dna
from cladeforge.functions.words import shared_words, turned_bitmap, word_bitmap
from cladeforge.operators import sequences as S
from cladeforge.operators.rounds import cut
from cladeforge.schema import check_choice, unused

WORD = 12
#: Times as many words as on the other strand that a strand needs.
MARGIN = 4
#: Distinct words with other letters than A, C, G and T that are sent to all tasks.
SENT_WORDS = 2_000_000


def with_orientation(sequences: DataFrame, references: DataFrame, strand: str, forward: str, backward: str, key: str = "id", dbmask: str | None = None) -> DataFrame:
    """sequences with columns of those names: strand (+, - or ?), and the distinct words
    that each strand shares with the references.

    The references' words of A, C, G and T are a bitmap of all there can be (2 MB a strand),
    looked up inside the rows, so that no word of a sequence is shuffled, however large the
    references. Their words with other letters go along while they are at most SENT_WORDS, and
    then no sequence is shuffled; more meet by a join. An empty or null sequence shares
    none. dbmask: see masked().
    """
    letters = to_dna(F.col("seq"))
    refs = masked(references.select((letters if dbmask == "soft" else F.upper(letters)).alias("seq")), dbmask)
    plain = word_bitmap(refs, WORD)
    odd = F.filter(F.array_distinct(kmers(F.col("seq"), WORD)), lambda w: ~w.rlike("^[ACGT]*$"))
    known = cut(refs.where("not seq rlike '^[ACGT]*$'").select(F.explode(odd).alias("word")).distinct())
    if dbmask in ("soft", "dust"):
        known = known.where(~F.contains("word", F.lit(MASKED)))
    turned = known.select(reverse_complement(F.col("word")).alias("word"))  # a sequence turned, or the words: the same hits
    seq = F.upper(to_dna(F.col("seq")))
    sent = [r["word"] for r in known.limit(SENT_WORDS + 1).collect()]
    few = len(sent) <= SENT_WORDS
    back = [r["word"] for r in turned.collect()] if few else []
    shared = shared_words(seq, WORD, [plain, turned_bitmap(plain, WORD)], [sent if few else [], back])
    n = unused("n", [*sequences.columns, strand, forward, backward])
    told = sequences.select("*", shared.alias(n)).select(*sequences.columns, F.col(n)[0].alias(forward), F.col(n)[1].alias(backward))
    if not few:
        every = known.withColumn("strand", F.lit("+")).unionByName(turned.withColumn("strand", F.lit("-")))
        words = sequences.select(F.col(key).alias("key"), seq.alias("seq")).select("key", F.explode(odd).alias("word"))
        hits = words.join(every, "word").groupBy(F.col("key").alias(n)).agg(
            *[F.sum(F.when(F.col("strand") == s, 1).otherwise(0)).alias(f"{n}{s}") for s in "+-"]
        )
        more = lambda name, s: (F.col(name) + F.coalesce(f"{n}{s}", F.lit(0))).alias(name)
        told = told.join(hits, F.col(key) == F.col(n), "left").select(*sequences.columns, more(forward, "+"), more(backward, "-"))
    f, b = F.col(forward), F.col(backward)
    sign = F.when((f >= 1) & (f >= MARGIN * b), "+").when((b >= 1) & (b >= MARGIN * f), "-").otherwise("?")
    return told.withColumn(strand, sign)


def orientation(sequences: DataFrame, references: DataFrame, key: str = "id", dbmask: str | None = None) -> DataFrame:
    """key, strand (+, - or ?), forward, backward: distinct words shared by each strand; see with_orientation()."""
    told = with_orientation(sequences.select(key, "seq"), references, "strand", "forward", "backward", key, dbmask)
    return told.select(key, "strand", "forward", "backward")


#: The letter of masked places, which no word of a sequence has.
MASKED = "\x01"


def masked(references: DataFrame, dbmask: str | None) -> DataFrame:
    """References (seq, letters in upper case but for soft) whose masked letters match none:
    with dust the stretches of low complexity (see functions.dust), with none nothing."""
    check_choice("dbmask", dbmask or "none", ("none", "dust", "soft"))
    if dbmask in (None, "none"):
        return references
    if dbmask == "dust":
        return references.select(dust_masked(F.col("seq"), MASKED).alias("seq"))
    return references.select(F.upper(F.translate("seq", string.ascii_lowercase, MASKED * 26)).alias("seq"))


def orient_seqs(
    sequences: DataFrame,
    references: DataFrame | None = None,
    dbmask: str | None = None,
    relabel: str | None = None,
    relabel_keep: bool = False,
    relabel_md5: bool = False,
    relabel_self: bool = False,
    relabel_sha1: bool = False,
    sizein: bool = False,
    sizeout: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(oriented, unmatched); without references every sequence is reverse-complemented, and
    the other parameters have no part.

    dbmask (none, dust or soft: lower-case letters) masks the references. The oriented
    sequences get new ids: relabel and a number in the order of the ids, or their md5, sha1
    or letters; relabel_keep keeps the old id as description. sizeout gives ids their
    abundance, which is that of `;size=n` in the old id with sizein, else 1.
    """
    if sum([relabel is not None, relabel_md5, relabel_self, relabel_sha1]) > 1:
        raise ValueError("give one of relabel, relabel_md5, relabel_self and relabel_sha1")
    turned = reverse_complement(F.col("seq"))
    if references is None:
        return sequences.withColumn("seq", turned), sequences.where(F.lit(False))
    names = [unused(n, sequences.columns) for n in ("strand", "forward", "backward")]
    told, strand = with_orientation(sequences, references, *names, dbmask=dbmask), names[0]
    oriented = told.where(F.col(strand) != "?").withColumn("seq", F.when(F.col(strand) == "-", turned).otherwise(F.col("seq")))
    oriented, unmatched = oriented.select(*sequences.columns), told.where(F.col(strand) == "?").select(*sequences.columns)
    size = unused("size", sequences.columns)
    if sizeout:
        oriented = oriented.withColumn(size, S.abundance(oriented) if sizein else F.lit(1).cast("long"))
    by = "ticker" if relabel is not None else "md5" if relabel_md5 else "self" if relabel_self else "sha1" if relabel_sha1 else None
    if by is not None:
        oriented = S.relabel(oriented, by, relabel or "", relabel_keep)
    if sizeout:
        oriented = S.with_abundance(oriented, size).drop(size)
    return oriented, unmatched


def orient_reads(reads: DataFrame, references: DataFrame, dbmask: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(oriented, unmatched) of reads: sample_id, direction, read_no, header, seq, qual.

    The forward read of a pair decides; pairs on the other strand swap their reads, which
    are not turned. Reads of samples without a reverse direction are turned themselves,
    with their qualities.
    """
    key = F.struct("sample_id", "read_no")
    forward = reads.where("direction = 'forward'").select(key.alias("key"), "seq")
    told = orientation(forward, references, "key", dbmask).select("key.sample_id", "key.read_no", "strand")
    paired = reads.groupBy("sample_id").agg(F.max(F.col("direction") == "reverse").alias("paired"))
    every = reads.join(told, ["sample_id", "read_no"]).join(F.broadcast(paired), "sample_id")  # a row a sample
    minus, pair = F.col("strand") == "-", F.col("paired")
    other = F.when(F.col("direction") == "forward", "reverse").otherwise("forward")
    oriented = every.where("strand <> '?'").select(
        "sample_id",
        F.when(minus & pair, other).otherwise(F.col("direction")).alias("direction"),
        "read_no",
        "header",
        F.when(minus & ~pair, reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"),
        F.when(minus & ~pair, F.reverse("qual")).otherwise(F.col("qual")).alias("qual"),
    )
    return oriented, every.where("strand = '?'").select(*oriented.columns)
