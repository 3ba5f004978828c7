"""Lineages made from the records of public releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeforge.functions import lineage as L
from cladeforge.operators.rounds import cut
from cladeforge.schema import PR2_RANKS, RANKS, RECORD_RANKS, SILVA_RANKS, SIX_RANKS, check_subset, unused


def tree_ancestors(nodes: DataFrame) -> DataFrame:
    """node_id, ancestor_id, distance of every node of a tree (node_id, parent_id), itself
    (distance 0) and all above it.

    By pointer doubling: each round joins the known paths with jumps twice as long, so a
    tree of depth d takes log2(d) rounds. Raises ValueError where paths are longer than
    there are nodes, which takes a cycle.
    """
    size = nodes.count()
    paths = nodes.select("node_id", F.col("node_id").alias("ancestor_id"), F.lit(0).alias("distance"))
    jump = nodes.where("parent_id is not null").select(F.col("node_id").alias("at"), F.col("parent_id").alias("to"))
    reach = 1
    while not jump.isEmpty():
        if reach > size:
            raise ValueError("the tree has a cycle")
        above = paths.join(jump, paths.ancestor_id == jump["at"])
        above = above.select("node_id", F.col("to").alias("ancestor_id"), (F.col("distance") + reach).alias("distance"))
        paths = cut(paths.unionByName(above))
        far = jump.select(F.col("at").alias("mid"), F.col("to").alias("far"))
        jump = jump.join(far, F.col("to") == F.col("mid")).select("at", F.col("far").alias("to"))
        jump = cut(jump)
        reach *= 2
    return paths


def parse_silva_taxonomy(
    tree: DataFrame,
    taxmap: DataFrame,
    ranks_table: DataFrame,
    rank_propagation: bool = True,
    ranks: list[str] | None = None,
    include_species_labels: bool = False,
    check: bool = True,
) -> DataFrame:
    """feature_id (accession.start.stop), taxon for every row of taxmap.

    tree: node_id, parent_id, the root being '1'. Of the labels of a node and its
    ancestors below the root each rank takes the one nearest the root; propagation fills
    missing ranks from the one before, over all ranks, before the wanted ones are chosen.
    check raises ValueError where tree, rank table and map don't agree (three jobs).
    """
    wanted = SIX_RANKS if ranks is None else ranks
    check_subset("rank", wanted, SILVA_RANKS)
    label = L.clean_label(F.element_at(F.split("path", ";"), -2))
    labels = ranks_table.select(F.col("taxid").alias("ancestor_id"), "rank", label.alias("label"))
    if check:
        check_silva(tree, taxmap, ranks_table)
    below = tree_ancestors(tree.where("node_id <> '1'"))
    every = below.join(labels.where(F.col("rank").isin(SILVA_RANKS)), "ancestor_id")
    ranked = every.groupBy("node_id", "rank").agg(F.max_by("label", "distance").alias("label"))
    wide = ranked.groupBy("node_id").pivot("rank", SILVA_RANKS).agg(F.first("label"))
    columns = dict(zip(SILVA_RANKS, [F.col(f"`{r}`") for r in SILVA_RANKS], strict=True))
    if rank_propagation:
        columns = dict(zip(SILVA_RANKS, L.filled(list(columns.values())), strict=True))
    named = [F.concat(F.lit(RANKS[r]), F.coalesce(columns[r], F.lit(""))) for r in SILVA_RANKS if r in wanted]
    every_node = tree.where("node_id <> '1'").select("node_id").join(wide, "node_id", "left")
    taxa = every_node.select(F.col("node_id").alias("taxid"), F.concat_ws("; ", *named).alias("taxon"))
    species = F.concat(F.lit("; s__"), L.clean_label(L.first_words(F.col("organism_name")))) if include_species_labels else F.lit("")
    joined = taxmap.join(taxa, "taxid")
    return joined.select(F.concat_ws(".", "primaryAccession", "start", "stop").alias("feature_id"), F.concat("taxon", species).alias("taxon"))


def check_silva(tree: DataFrame, taxmap: DataFrame, ranks_table: DataFrame) -> None:
    nodes = tree.where("node_id <> '1'").select(F.col("node_id").alias("taxid")).distinct()
    known = ranks_table.select("taxid").distinct()
    mapped = taxmap.select("taxid").distinct()
    for a, b, what in (
        (nodes, known, "tree nodes without a rank"),
        (known, nodes, "ranked taxa that the tree lacks"),
        (mapped, nodes, "mapped taxa that the tree lacks"),
    ):
        if found := a.join(b, "taxid", "left_anti").orderBy("taxid").limit(10).collect():
            raise ValueError(f"{what}: {', '.join(r[0] for r in found)}")


def _rank_map(names: Column, ranks: Column) -> Column:
    """rank -> name of two `;`-joined lists, the last name of a rank winning."""
    pairs = F.arrays_zip(F.split(ranks, ";").alias("r"), F.split(names, ";").alias("n"))
    return F.filter(pairs, lambda p: p["r"].isNotNull() & p["n"].isNotNull())


def _named(pairs: Column, rank: str) -> Column:
    return F.try_element_at(F.filter(pairs, lambda p: p["r"] == rank), F.lit(-1))["n"]


def _joined(names: dict[str, Column]) -> Column:
    return F.concat_ws("; ", *[F.concat(F.lit(RANKS[r]), F.coalesce(c, F.lit(""))) for r, c in names.items()])


def ranked_lineage(
    names: Column, ranks: Column, wanted: list[str] | None = None, rank_propagation: bool = True
) -> Column:
    """Lineage of the wanted ranks, in their order, from `;`-joined names and ranks.

    A species that begins with its genus loses it; without a genus the first word of a
    species of several becomes the genus. Propagation fills a rank from the wanted one
    before it.
    """
    wanted = RECORD_RANKS if not wanted else wanted
    check_subset("rank", wanted, RANKS)
    pairs = _rank_map(names, ranks)
    found = {r: _named(pairs, r) for r in wanted}
    if "genus" in wanted and "species" in wanted:
        found["genus"], found["species"] = split_species(found["genus"], found["species"])
    if rank_propagation:
        found = dict(zip(found, L.filled(list(found.values())), strict=True))
    return _joined(found)


def split_species(genus: Column, species: Column) -> tuple[Column, Column]:
    begins = F.startswith(species, F.concat(genus, F.lit(" ")))
    shorter = F.when(begins, F.substring(species, F.length(genus) + 2, F.length(species))).otherwise(species)
    lone = genus.isNull() & F.contains(species, F.lit(" "))
    parts = F.split(species, " ", 2)
    return F.when(lone, parts[0]).otherwise(genus), F.when(lone, F.get(parts, F.lit(1))).otherwise(shorter)


def ncbi_lineages(records: DataFrame, ranks: list[str] | None = None, rank_propagation: bool = True) -> DataFrame:
    """taxid, taxon of taxonomy records: taxid, organism, division, lineage (an array of
    rank, name) and alternative ids aka (an array), each of which gets a row as well.

    With propagation all ranks are filled in canonical order, from the division on.
    Without, domain (or else kingdom) is the division unless the record names it, and the
    species loses its genus only if genus is wanted, too.
    Records without an organism or a lineage are dropped.
    """
    wanted = RECORD_RANKS if ranks is None else ranks
    check_subset("rank", wanted, RANKS)
    named = lambda r: F.try_element_at(F.filter("lineage", lambda x: x["rank"] == r), F.lit(-1))["name"]
    names = {r: named(r) for r in RANKS}
    names["species"] = F.col("organism")
    if rank_propagation or "genus" in wanted:
        names["genus"], names["species"] = split_species(names["genus"], F.col("organism"))
    if rank_propagation:
        filled = L.filled([F.col("division"), *names.values()])[1:]
        names = dict(zip(names, filled, strict=True))
    else:
        top = next((r for r in ("domain", "kingdom") if r in wanted), None)
        if top:
            names[top] = F.coalesce(names[top], "division")
    good = records.where("organism is not null and lineage is not null")
    ids = F.explode(F.array_distinct(F.concat(F.array("taxid"), F.coalesce("aka", F.array().cast("array<string>")))))
    return good.select(ids.alias("taxid"), _joined({r: names[r] for r in wanted}).alias("taxon"))


def with_lineages(accessions: DataFrame, lineages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(feature_id, taxon of the accessions (accession, taxid) whose taxid is known; the others)."""
    joined = accessions.join(lineages, "taxid")
    return joined.select(F.col("accession").alias("feature_id"), "taxon"), accessions.join(lineages, "taxid", "left_anti")


def pr2_taxonomy(rows: DataFrame, ranks: list[str] | None = None) -> DataFrame:
    """Lineages of nine labels with a closing `;`, as prefixed labels of the wanted ranks."""
    wanted = list(PR2_RANKS) if ranks is None else ranks
    check_subset("rank", wanted, PR2_RANKS)
    parts = F.split("taxon", ";")
    chosen = [F.concat(F.lit(p), F.get(parts, F.lit(i))) for i, (r, p) in enumerate(PR2_RANKS.items()) if r in wanted]
    return rows.select("feature_id", F.concat_ws(";", *chosen).alias("taxon"))


def gtdb_taxonomy(sequences: DataFrame) -> DataFrame:
    """feature_id, taxon from descriptions: what stands before the first `[`."""
    return sequences.select(F.col("id").alias("feature_id"), F.trim(F.split("description", r"\[")[0]).alias("taxon"))


def eukaryome_split(sequences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sequences, taxonomy) of records whose id is accession;lineage."""
    parts = F.split(F.concat_ws(" ", "id", F.when(F.col("description") != "", F.col("description"))), ";", 2)
    taxa = sequences.select(parts[0].alias("feature_id"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("taxon"))
    return sequences.withColumn("id", parts[0]).withColumn("description", F.lit("")), taxa


def blank_to_null(rows: DataFrame) -> DataFrame:
    """Strings of white space only become null."""
    kinds = dict(rows.dtypes)
    return rows.select(*[F.when(F.col(c).rlike(r"^\s*$"), None).otherwise(F.col(c)).alias(c) if kinds[c] == "string" else F.col(c) for c in rows.columns])


def features_with_sequences(features: DataFrame, sequences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(genes, proteins): genome_id, feature_id, seq of features by the md5 of either."""

    def joined(column: str) -> DataFrame:
        known = sequences.select(F.col("md5").alias(column), F.upper("sequence").alias("seq"))
        return features.join(known, column).select("genome_id", "feature_id", "seq")

    return joined("na_sequence_md5"), joined("aa_sequence_md5")


def gff_without_accession_prefix(lines: DataFrame) -> DataFrame:
    """GFF lines (column value) without the first five characters, comments unchanged."""
    value = F.col("value")
    return lines.withColumn("value", F.when(F.startswith(value, F.lit("#")), value).otherwise(F.substring(value, 6, 1 << 30)))


def chromosomes(report: DataFrame) -> DataFrame:
    """genome_id, molecule_id of the chromosomes of a sequence report, by either accession."""
    kept = report.where("assignedMoleculeLocationType = 'Chromosome'")
    ids = F.explode(F.array_compact(F.array("refseqAccession", "genbankAccession")))
    return kept.select(F.col("assemblyAccession").alias("genome_id"), ids.alias("molecule_id")).distinct()


def last_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key in the order of a column (later records replace earlier)."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    n = unused("n", rows.columns)
    return rows.withColumn(n, last).where(F.col(n) == 1).drop(n)
