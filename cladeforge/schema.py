"""The two core schemas, rank tables and checks of parameters.

Sequences: id, description, seq. Taxonomies: feature_id, taxon, and any further columns.
Checks run before a plan is built and raise ValueError.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import types as T

SEQUENCES = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("description", T.StringType()), T.StructField("seq", T.StringType())]
)
TAXONOMY = T.StructType([T.StructField("feature_id", T.StringType()), T.StructField("taxon", T.StringType())])
SILVA_RANKS_FILE = T.StructType([T.StructField(n, T.StringType()) for n in ("path", "taxid", "rank", "remark", "release")])
SILVA_MAP_FILE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("primaryAccession", "start", "stop", "path", "organism_name", "taxid")]
)

#: Taxonomic ranks in canonical order with the prefix of their labels.
RANKS = {
    "domain": "d__",
    "superkingdom": "sk__",
    "kingdom": "k__",
    "subkingdom": "ks__",
    "superphylum": "sp__",
    "phylum": "p__",
    "subphylum": "ps__",
    "infraphylum": "pi__",
    "superclass": "sc__",
    "class": "c__",
    "subclass": "cs__",
    "infraclass": "ci__",
    "cohort": "co__",
    "superorder": "so__",
    "order": "o__",
    "suborder": "os__",
    "infraorder": "oi__",
    "parvorder": "op__",
    "superfamily": "sf__",
    "family": "f__",
    "subfamily": "fs__",
    "tribe": "t__",
    "subtribe": "ts__",
    "genus": "g__",
    "subgenus": "gs__",
    "species group": "ss__",
    "species subgroup": "sgs__",
    "species": "s__",
    "subspecies": "ssb__",
    "forma": "for__",
}
#: Ranks that a rank table of the SILVA releases may use (others are skipped).
SILVA_RANKS = [
    "domain", "superkingdom", "kingdom", "subkingdom", "superphylum", "phylum", "subphylum", "infraphylum", "superclass",
    "class", "subclass", "infraclass", "superorder", "order", "suborder", "superfamily", "family", "subfamily", "genus",
]
#: The ranks of PR2 lineages.
PR2_RANKS = {
    "domain": "d__", "supergroup": "sgr__", "division": "dv__", "subdivision": "dvs__", "class": "c__", "order": "o__",
    "family": "f__", "genus": "g__", "species": "s__",
}
SEVEN_RANKS = ["domain", "phylum", "class", "order", "family", "genus", "species"]
SIX_RANKS = SEVEN_RANKS[:-1]
#: Ranks of lineages made from NCBI and BV-BRC records unless others are asked for.
RECORD_RANKS = ["kingdom", *SEVEN_RANKS[1:]]


def handles(ranks: Sequence[str], allowed: dict[str, str] = RANKS) -> list[str]:
    """Prefixes of the given ranks in canonical order; 'disable' among them gives none."""
    if "disable" in ranks:
        return []
    check_subset("rank", ranks, allowed)
    return [prefix for rank, prefix in allowed.items() if rank in ranks]


def unused(base: str, names: Collection[str]) -> str:
    """base, or base with underscores where a column of that name (in any case) exists."""
    taken = {n.lower() for n in names}
    while base.lower() in taken:
        base += "_"
    return base


def check_subset(name: str, values: Collection[str], allowed: Collection[str]) -> None:
    if unknown := [v for v in values if v not in allowed]:
        raise ValueError(f"unknown {name}: {', '.join(map(str, unknown))}")


def check_choice(name: str, value: str, allowed: Collection[str]) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}; got {value!r}")


def check_range(name: str, value: float | None, low: float | None = None, high: float | None = None, open_low: bool = False) -> None:
    """Nothing to check if value is None; bounds are inclusive unless open_low."""
    if value is None:
        return
    if low is not None and (value < low or open_low and value == low) or high is not None and value > high:
        raise ValueError(f"{name} is out of range: {value}")
