"""Consensus lineages of groups.

Votes are counted by group, rank and label, so a group of any size is reduced by partial
sums before the shuffle, and no list of its members is ever built: what a group gathers
is one entry a rank (and, to collapse substrings, the distinct labels of a rank).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("lca", "super", "majority")


def _take_while(entries: Column, passes) -> Column:
    """Labels of the entries (pos, label, ...), in order, before the first that fails."""
    failed = F.array_min(F.transform(F.filter(entries, lambda x: ~passes(x)), lambda x: x["pos"]))
    kept = F.filter(entries, lambda x: failed.isNull() | (x["pos"] < failed))
    return F.transform(kept, lambda x: x["label"])


def consensus(rows: DataFrame, group: str, parts: str, mode: str) -> DataFrame:
    """group, parts: for each group one array of labels.

    lca: the leading ranks on which all members agree, up to the shortest. majority: by
    rank the label with strictly most votes, up to the first rank without one; empty
    labels have no vote, and a rank that has only such gives ''. super: the same once
    each label is replaced by the longest at its rank that contains it.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    each = rows.select(group, F.posexplode(parts).alias("pos", "label"))
    each = each.withColumn("label", F.coalesce("label", F.lit("")))
    votes = each.groupBy(group, "pos", "label").agg(F.count(F.lit(1)).alias("n"))
    if mode == "lca":
        ranks = votes.groupBy(group, "pos").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"), F.min("label").alias("label"))
        entries = F.array_sort(F.collect_list(F.struct("pos", "label", "n", "kinds")))
        found = ranks.groupBy(group).agg(entries.alias("entries"))
        agrees = lambda x: (x["kinds"] == 1) & (x["n"] == F.col("entries")[0]["n"])
        return found.select(group, _take_while(F.col("entries"), agrees).alias(parts))
    votes = votes.withColumn("n", F.when(F.col("label") == "", 0).otherwise(F.col("n")))
    if mode == "super":
        votes = _collapsed(votes, group)
    tied = votes.groupBy(group, "pos", "n").agg(F.count(F.lit(1)).alias("kinds"), F.max("label").alias("label"))
    top = tied.groupBy(group, "pos").agg(F.max(F.struct("n", "kinds", "label")).alias("top"))
    entries = F.array_sort(F.collect_list(F.struct("pos", F.col("top.label").alias("label"), F.col("top.kinds").alias("kinds"))))
    found = top.groupBy(group).agg(entries.alias("entries"))
    return found.select(group, _take_while(F.col("entries"), lambda x: x["kinds"] == 1).alias(parts))


def _collapsed(votes: DataFrame, group: str) -> DataFrame:
    known = votes.groupBy(group, "pos").agg(F.collect_list(F.struct("label", "n")).alias("all"))

    def longest(x: Column) -> Column:
        within = F.filter("all", lambda y: F.contains(y["label"], x["label"]))
        best = F.array_max(F.transform(within, lambda y: F.struct(F.length(y["label"]).alias("size"), y["label"].alias("label"))))
        return F.when(x["label"] == "", F.lit("")).otherwise(best["label"])

    moved = F.explode(F.transform("all", lambda x: F.struct(longest(x).alias("label"), x["n"].alias("n"))))
    every = known.select(group, "pos", moved.alias("x")).select(group, "pos", "x.label", "x.n")
    return every.groupBy(group, "pos", "label").agg(F.sum("n").alias("n"))


def most_common(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, value: the most frequent value of each group, the smallest of equally frequent."""
    counts = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(group).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value))
