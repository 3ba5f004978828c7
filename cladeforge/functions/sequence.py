"""Columns over nucleotide sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Degenerate IUPAC letters; letters a homopolymer may consist of; complements.
DEGENERATE = "RYSWKMBDHVN"
HOMOPOLYMER = "ACGTURYSWKMBDHVN"
BASES, COMPLEMENTS = "ACGTURYSWKMBDHVNacgturyswkmbdhvn", "TGCAAYRSWMKVHDBNtgcaayrswmkvhdbn"


def degapped(seq: Column) -> Column:
    return F.translate(seq, "-.", "")


def to_dna(seq: Column) -> Column:
    return F.translate(seq, "Uu", "Tt")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, BASES, COMPLEMENTS))


def n_degenerate(seq: Column) -> Column:
    return F.length(seq) - F.length(F.translate(seq, DEGENERATE, ""))


def has_homopolymer(seq: Column, length: int) -> Column:
    return seq.rlike(f"([{HOMOPOLYMER}])\\1{{{length - 1},}}")


#: Letters of the pieces that kmers() cuts a sequence into: finding a place in a string
#: takes time in proportion to it.
PIECE = 512


def kmers(seq: Column, k: int) -> Column:
    """All substrings of k letters, in order; none where the sequence is shorter."""
    n = F.length(seq) - k + 1

    def of_piece(start: Column) -> Column:
        piece = F.substring(seq, start, F.lit(PIECE + k - 1))
        last = F.least(n - start + 1, F.lit(PIECE))
        return F.transform(F.array(piece), lambda p: F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(p, i, F.lit(k))))[0]

    some = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(PIECE)), of_piece))
    return F.when(n >= 1, some).otherwise(F.array().cast("array<string>"))
