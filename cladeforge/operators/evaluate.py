"""Evaluation of taxonomies, classifications and sequences."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeforge.functions import lineage as L
from cladeforge.functions.words import unit_weights
from cladeforge.operators.sequences import missing_ids, sample_exactly
from cladeforge.schema import check_range

#: Labels that stand for no classification.
UNCLASSIFIED = ["Unclassified", "Unassigned", "No blast hit", "other"]
QUANTILES = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def _labels(n: int, labels: list[str] | None) -> list[str]:
    """Names of n tables: those given, numbers where they run out."""
    given = list(labels or [])[:n]
    if len(given) < n:
        warnings.warn(f"{n} tables and {len(given)} labels: the others are named by their numbers, which may meet a label", UserWarning, stacklevel=4)
    return given + [str(i + 1) for i in range(len(given), n)]


def _stacked(tables: list[DataFrame], labels: list[str] | None) -> DataFrame:
    named = [t.withColumn("dataset", F.lit(x)) for t, x in zip(tables, _labels(len(tables), labels), strict=True)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def numbered(results: DataFrame, *order: str) -> DataFrame:
    """A table of results (a row for each level and dataset) with a first column id, text,
    that counts from 1 in the given order."""
    number = F.row_number().over(Window.orderBy(*order)).cast("string")
    return results.select(number.alias("id"), *(c for c in results.columns if c != "id"))


def entropy(counts: DataFrame, by: list[str], n: str) -> DataFrame:
    """by, entropy (natural log), kinds of rows with counts n; a row a kind.

    -sum p ln p = ln N - sum n ln n / N, so one sum over the kinds does.
    """
    total = F.sum(n)
    value = F.log(total) - F.sum(F.col(n) * F.log(F.col(n))) / total
    return counts.where(F.col(n) > 0).groupBy(*by).agg(value.alias("entropy"), F.count(F.lit(1)).alias("kinds"))


def taxonomic_depth(taxonomy: DataFrame, handle_regex: str = "") -> DataFrame:
    """level, and numbers and shares of features that terminate, are classified and are
    unclassified there, for every level from 1 to the deepest."""
    depth = F.size(L.present(L.labels(F.col("taxon"), handle_regex)))
    sizes = taxonomy.groupBy(depth.alias("level")).agg(F.count(F.lit(1)).alias("n"))
    spine = sizes.agg(F.max("level").alias("top")).select(F.explode(F.sequence(F.lit(0), "top")).alias("level"))
    every = spine.join(sizes, "level", "left").fillna(0, ["n"])
    order = Window.orderBy("level")  # a row a level
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = every.select("level", "n", before.alias("before"), total.alias("total"))
    share = lambda c: (c / F.col("total")).cast("double")
    left = F.col("total") - F.col("before")
    return out.where("level > 0").select(
        "level",
        F.col("n").alias("n_terminating"),
        share(F.col("n")).alias("p_terminating"),
        left.alias("n_classified"),
        share(left).alias("p_classified"),
        F.col("before").alias("n_unclassified"),
        share(F.col("before")).alias("p_unclassified"),
    )


def taxonomic_entropy(taxonomy: DataFrame, handle_regex: str = "") -> DataFrame:
    """level, unique_labels, entropy over the lineages cut to that many labels.

    Empty labels are dropped first; a lineage with fewer labels counts whole at all deeper
    levels. Lineages are counted before they are cut, so only distinct ones multiply.
    """
    parts = L.present(L.labels(F.col("taxon"), handle_regex)).alias("parts")
    kinds = taxonomy.select(parts).groupBy("parts").agg(F.count(F.lit(1)).alias("n"))
    top = kinds.agg(F.max(F.size("parts")).alias("top"))
    levels = top.select(F.explode(F.sequence(F.lit(1), F.greatest("top", F.lit(1)))).alias("level")).join(top.where("top > 0"), F.lit(True), "left_semi")
    cut = kinds.join(F.broadcast(levels), F.lit(True)).withColumn("path", F.array_join(F.slice("parts", F.lit(1), F.col("level")), ";"))
    counts = cut.groupBy("level", "path").agg(F.sum("n").alias("n"))
    return entropy(counts, ["level"], "n").select("level", F.col("kinds").alias("unique_labels"), "entropy")


def evaluate_taxonomy(taxonomies: list[DataFrame], labels: list[str] | None = None, rank_handle_regex: str | None = None) -> DataFrame:
    """Depth and entropy by level of each taxonomy, named in the column dataset."""
    handle = rank_handle_regex or ""
    return _stacked([taxonomic_entropy(t, handle).join(taxonomic_depth(t, handle), "level") for t in taxonomies], labels)


def precision_recall(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """level, precision, recall, f_measure over the features of observed.

    Levels go to the most labels that are not empty. At each both lineages are cut to that
    many labels. Equal: a true positive. The
    observed a prefix (as characters) of the expected, or no classification: a false
    negative. Otherwise both a false positive and a false negative.
    """
    parts = lambda name: F.split("taxon", ";").alias(name)
    pairs = expected.select("feature_id", parts("e")).join(observed.select("feature_id", parts("o")), "feature_id")
    kinds = pairs.groupBy("e", "o").agg(F.count(F.lit(1)).alias("n"))
    deep = lambda c: F.size(L.present(L.labels(F.array_join(c, ";"))))
    top = kinds.agg(F.max(F.greatest(deep("e"), deep("o"))).alias("top"))
    levels = top.where("top > 0").select(F.explode(F.sequence(F.lit(1), "top")).alias("level"))
    cut = lambda c: F.array_join(F.slice(c, F.lit(1), F.col("level")), ";")
    each = kinds.join(F.broadcast(levels), F.lit(True)).select("level", "n", cut("e").alias("e"), cut("o").alias("o"))
    right = F.col("e") == F.col("o")
    under = F.startswith("e", "o") | F.col("o").isin(UNCLASSIFIED)
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    sums = each.groupBy("level").agg(count(right).alias("tp"), count(~right & ~under).alias("fp"), count(~right).alias("fn"))
    tp, wrong = F.col("tp"), lambda c: F.when(F.col("tp") == 0, F.lit(0.0)).otherwise(F.col("tp") / (F.col("tp") + F.col(c)))
    f = F.when(tp == 0, F.lit(0.0)).otherwise(2 * tp / (2 * tp + F.col("fp") + F.col("fn")))
    return sums.select("level", wrong("fp").alias("precision"), wrong("fn").alias("recall"), f.alias("f_measure"))


def evaluate_classifications(
    expected: list[DataFrame], observed: list[DataFrame], labels: list[str] | None = None, check_ids: bool = True
) -> DataFrame:
    """precision_recall() of each pair, named in the column dataset."""
    if len(expected) != len(observed):
        raise ValueError("expected and observed taxonomies differ in number")
    if check_ids:
        for e, o in zip(expected, observed, strict=True):
            missing_ids(o, "feature_id", e, "feature_id", "observed features without an expected lineage")
    return _stacked([precision_recall(e, o) for e, o in zip(expected, observed, strict=True)], labels)


def length_quantiles(sequences: DataFrame) -> DataFrame:
    names = ["min", "p1", "p25", "median", "p75", "p99", "max"]
    found = sequences.agg(F.percentile(F.length("seq"), F.array(*map(F.lit, QUANTILES))).alias("q"))
    return found.select(*[F.bround(F.col("q")[i], 2).alias(f"length_{n}") for i, n in enumerate(names)])


def sequence_entropy(sequences: DataFrame) -> DataFrame:
    counts = sequences.groupBy("seq").agg(F.count(F.lit(1)).alias("n"))
    return entropy(counts, [], "n").select(F.col("kinds").alias("n_unique"), F.bround("entropy", 2).alias("seq_entropy"))


def kmer_entropy(sequences: DataFrame, k: int, fraction: float = 1.0, seed: int = 1) -> DataFrame:
    """Entropy of the k-mers (lower case) of the sequences, each sequence's counts scaled
    to a vector of length one; of exactly int(fraction x n) sequences, drawn by the seed."""
    check_range("k", k, 1)
    check_range("fraction", fraction, 0, 1, open_low=True)
    some = sample_exactly(sequences, fraction, seed) if fraction < 1 else sequences
    weights = some.select(F.lower("seq")).mapInArrow(unit_weights(k), "word string, w double").groupBy("word").agg(F.sum("w").alias("w"))
    return entropy(weights, [], "w").select(F.bround("entropy", 2).alias(f"kmer_entropy_{k}"))


def evaluate_seqs(
    sequences: list[DataFrame], labels: list[str] | None = None, kmer_lengths: list[int] | None = None, subsample_kmers: float = 1.0
) -> DataFrame:
    """A row of length quantiles, distinct sequences and entropies for each table."""
    rows = []
    for s in sequences:
        parts = [length_quantiles(s), sequence_entropy(s), *[kmer_entropy(s, k, subsample_kmers) for k in kmer_lengths or ()]]
        rows.append(reduce(lambda a, b: a.join(b, F.lit(True)), parts))  # one row each
    return _stacked(rows, labels)
