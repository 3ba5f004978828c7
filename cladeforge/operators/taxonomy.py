"""Operators on taxonomies (feature_id, taxon, further columns)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeforge.functions import lineage as L
from cladeforge.functions.consensus import MODES, consensus
from cladeforge.functions.patterns import java_literal, java_regex, java_template
from cladeforge.operators.sequences import missing_ids
from cladeforge.schema import SEVEN_RANKS, handles, unused


def filter_taxa(
    taxonomy: DataFrame,
    ids_to_keep: DataFrame | None = None,
    include: list[str] | None = None,
    exclude: list[str] | None = None,
    check: bool = True,
) -> DataFrame:
    """Lineages that match a pattern of include, if given, and none of exclude, and those
    of ids_to_keep (column id) whatever they match; with that alone, just those.

    check raises ValueError if ids_to_keep has unknown ids or nothing is left (two jobs).
    """
    if ids_to_keep is None and not include and not exclude:
        raise ValueError("give at least one of ids_to_keep, include and exclude")
    taxon = F.coalesce("taxon", F.lit(""))
    passes = F.lit(bool(include or exclude))
    if include:
        passes = passes & taxon.rlike(java_regex("|".join(include)))
    if exclude:
        passes = passes & ~taxon.rlike(java_regex("|".join(exclude)))
    if ids_to_keep is None:
        out = taxonomy.where(passes)
    else:
        wanted = ids_to_keep.select(F.col("id").alias("feature_id")).distinct()
        if check:
            missing_ids(wanted, "feature_id", taxonomy, "feature_id", "unknown ids to keep")
        kept = unused("kept", taxonomy.columns)
        marked = taxonomy.join(wanted.withColumn(kept, F.lit(True)), "feature_id", "left")
        out = marked.where(passes | F.coalesce(kept, F.lit(False))).select(*taxonomy.columns)
    if check and out.isEmpty():
        raise ValueError("no lineage is left")
    return out


def edit_taxonomy(
    taxonomy: DataFrame,
    replacement_map: dict[str, str] | None = None,
    search_strings: list[str] | None = None,
    replacement_strings: list[str] | None = None,
    use_regex: bool = False,
) -> DataFrame:
    """Replaces, in order, what the search strings match in lineages that matched them
    before any edit. Replacements are templates with group references in either mode.

    The map comes first; a search string given again takes the later replacement.
    """
    searches, replacements = search_strings or [], replacement_strings or []
    if len(searches) != len(replacements):
        raise ValueError("search_strings and replacement_strings differ in length")
    pairs = dict(replacement_map or {}) | dict(zip(searches, replacements, strict=True))
    if not pairs:
        raise ValueError("give a replacement map or search and replacement strings")
    taxon = F.col("taxon")
    edited = taxon
    for search, template in pairs.items():
        pattern = java_regex(search) if use_regex else java_literal(search)
        found = re.compile(search if use_regex else "")
        new = java_template(template, found.groups, dict(found.groupindex))
        edited = F.when(taxon.rlike(pattern), F.regexp_replace(edited, pattern, F.lit(new))).otherwise(edited)
    return taxonomy.withColumn("taxon", edited)


def rank_count_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """feature_id of lineages whose number of labels an edit changed."""
    size = lambda df, name: df.select("feature_id", F.size(F.split("taxon", ";")).alias(name))
    return size(before, "a").join(size(after, "b"), "feature_id").where("a <> b").select("feature_id")


def merge_taxa(
    data: list[DataFrame],
    mode: str = "len",
    rank_handle_regex: str = "^[dkpcofgs]__",
    new_rank_handles: list[str] | None = None,
    unclassified_label: str = "Unassigned",
) -> DataFrame:
    """One lineage for each feature of any of the taxonomies.

    len: the one with most distinct labels; score: with the highest number in the first
    further column; the last taxonomy wins ties. Further columns (capitalized) come from
    the winner; where it has none of a name the value is null in len, 0 in score. lca,
    super, majority: the consensus of all, without further columns.
    """
    if mode not in (*MODES, "len", "score"):
        raise ValueError(f"unknown mode {mode!r}")
    prefixes = handles(SEVEN_RANKS if new_rank_handles is None else new_rank_handles)
    if mode in MODES:
        rows = [d.select("feature_id", L.labels(F.col("taxon"), rank_handle_regex).alias("parts")) for d in data]
        merged = consensus(reduce(DataFrame.unionByName, rows), "feature_id", "parts", mode)
    else:
        merged = _best(data, mode, rank_handle_regex)
    taxon = L.lineage(L.prefixed(F.col("parts"), prefixes))
    label = F.when(taxon == "", F.lit(unclassified_label)).otherwise(taxon).alias("taxon")
    others = [c for c in merged.columns if c not in ("feature_id", "parts")]
    return merged.select("feature_id", label, *others)


def _best(data: list[DataFrame], mode: str, handle_regex: str) -> DataFrame:
    rows, extra = [], {}
    worth_name, order_name = (unused(n, ["score", *(c for d in data for c in d.columns)]) for n in ("worth", "order"))
    for order, d in enumerate(data):
        names = [c for c in d.columns if c not in ("feature_id", "taxon")]
        if mode == "score" and not names:
            raise ValueError("score mode needs a column of scores after the taxon in every taxonomy")
        columns = [F.col(c).alias(c.capitalize()) for c in names]
        extra |= dict.fromkeys([c.capitalize() for c in names])
        if mode == "score":
            columns.append(F.col(names[0]).try_cast("double").alias("Score"))
            extra["Score"] = None
        parts = L.labels(F.col("taxon"), handle_regex)
        worth = L.n_distinct(parts) if mode == "len" else F.col(names[0]).try_cast("double")
        rows.append(d.select("feature_id", parts.alias("parts"), worth.alias(worth_name), F.lit(order).alias(order_name), *columns))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    kept = ["parts", *extra]
    best = every.groupBy("feature_id").agg(F.max_by(F.struct(*kept), F.struct(worth_name, order_name)).alias("x"))
    out = best.select("feature_id", "x.*")
    return out.fillna(0, [c for c in extra if mode == "score"]) if extra else out
