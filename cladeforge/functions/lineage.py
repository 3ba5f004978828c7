"""Columns over lineages: `;`-separated labels, with or without rank prefixes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cladeforge.functions.patterns import java_regex


def labels(taxon: Column, handle_regex: str = "") -> Column:
    """Trimmed labels of a lineage, each without what the pattern matches; null: ''."""
    split = F.split(F.coalesce(taxon, F.lit("")), ";")
    if not handle_regex:
        return F.transform(split, lambda x: F.trim(x))
    pattern = java_regex(handle_regex)
    return F.transform(split, lambda x: F.regexp_replace(F.trim(x), pattern, ""))


def lineage(parts: Column, separator: str = ";") -> Column:
    return F.array_join(F.transform(parts, lambda x: F.coalesce(x, F.lit(""))), separator)


def backfilled(parts: Column, prefixes: Sequence[str]) -> Column:
    """Labels with the bare prefixes of the missing last ranks appended."""
    if not prefixes:
        return parts
    known = F.array(*map(F.lit, prefixes))
    missing = F.slice(known, F.size(parts) + 1, F.greatest(F.lit(len(prefixes)) - F.size(parts), F.lit(0)))
    return F.concat(parts, missing)


def prefixed(parts: Column, prefixes: Sequence[str]) -> Column:
    """Labels with a prefix each, cut to the shorter of the two; unchanged without prefixes."""
    if not prefixes:
        return parts
    n = F.least(F.size(parts), F.lit(len(prefixes)))
    known = F.array(*map(F.lit, prefixes))
    return F.zip_with(F.slice(known, F.lit(1), n), F.slice(parts, F.lit(1), n), lambda p, x: F.concat(p, x))


def present(parts: Column) -> Column:
    """Labels that are not empty."""
    return F.filter(parts, lambda x: x != "")


def n_distinct(parts: Column) -> Column:
    return F.size(F.array_distinct(present(parts)))


def filled(columns: Sequence[Column]) -> list[Column]:
    """Each column, or the nearest one before it that is not null."""
    out: list[Column] = []
    for c in columns:
        out.append(F.coalesce(c, out[-1]) if out else c)
    return out


def clean_label(label: Column) -> Column:
    """White space to `_`, and only letters, digits and _ - [ ] ( ) / . \\ kept."""
    return F.regexp_replace(F.regexp_replace(F.trim(label), r"\s+", "_"), r"[^0-9A-Za-z_\-\[\]()/.\\]", "")


def first_words(name: Column, n: int = 2) -> Column:
    return F.array_join(F.slice(F.split(F.trim(name), r"\s+"), 1, n), "_")
