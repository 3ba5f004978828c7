"""The tables of public releases from their files, once these are landed (releases.fetch()).

Each returns (sequences, taxonomy), or such a pair by gene, as the release's files say.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeforge.operators import lineages
from cladeforge.schema import PR2_RANKS, check_choice
from cladeforge.sources import files
from cladeforge.sources.archives import members

Tables = tuple[DataFrame, DataFrame]


def silva(spark: SparkSession, paths: dict[str, str], **options) -> Tables:
    """paths: by the names that releases.silva_urls() gives; without sequences the first
    table is empty. options go to lineages.parse_silva_taxonomy()."""
    newick = "".join(r["value"] for r in spark.read.text(paths["taxonomy tree"], wholetext=True).collect())  # one small file
    tree = files.read_newick(spark, newick)
    taxa = lineages.parse_silva_taxonomy(tree, files.read_silva_map(spark, paths["taxonomy map"]), files.read_silva_ranks(spark, paths["taxonomy ranks"]), **options)
    if "sequences" in paths:
        return files.read_fasta(spark, paths["sequences"]), taxa
    return spark.createDataFrame([], "id string, description string, seq string, ord long"), taxa


def gtdb(spark: SparkSession, paths: list[str]) -> Tables:
    """All domains together; a file is an archive with one FASTA file, or that itself."""
    packed = [p for p in paths if p.endswith((".tar.gz", ".tgz", ".tar"))]
    plain = [p for p in paths if p not in packed]
    parts = [files.read_fasta(spark, plain)] if plain else []
    if packed:
        parts.append(files.fasta_records(members(spark, packed, "*.fna", "\n>")))
    every = reduce(DataFrame.unionByName, parts)
    return every, lineages.gtdb_taxonomy(every)


def unite(spark: SparkSession, path: str, cluster_id: str = "99") -> Tables:
    """Of the developer files in the archive the two of a clustering; letters upper-cased.

    Raises ValueError where there aren't just two.
    """
    check_choice("cluster_id", cluster_id, ("97", "99", "dynamic"))
    # The fifth part of a name is the clustering.
    lines = members(spark, path, "*_dev*", "\n").where(F.get(F.split(F.substring_index("member", "/", -1), "_"), F.lit(4)) == cluster_id)
    names = sorted(r["member"] for r in lines.select("member").distinct().limit(3).collect())
    if [n.rsplit(".", 1)[-1] for n in names] != ["fasta", "txt"]:
        raise ValueError(f"not the two files of clustering {cluster_id}: {', '.join(names) or 'none'}")
    fasta, txt = names
    parts = F.split("value", "\t", 2)
    taxa = lines.where(F.col("member") == txt).where(F.trim("value") != "").select(parts[0].alias("feature_id"), F.regexp_replace(F.get(parts, F.lit(1)), "\r$", "").alias("taxon"))
    records = members(spark, path, f"*{fasta.rsplit('/', 1)[-1]}", "\n>")
    return files.fasta_records(records, upper=True), taxa.where("feature_id <> 'Feature ID'")


def pr2(spark: SparkSession, fasta: str, taxonomy: str, ranks: list[str] | None = None) -> Tables:
    """Raises ValueError naming up to ten lineages of other than nine labels (a job)."""
    rows = files.read_taxonomy(spark, taxonomy, header=False)
    labels = F.size(F.split(F.regexp_replace("taxon", "^;+|;+$", ""), ";"))
    if wrong := [r["feature_id"] for r in rows.where(labels != len(PR2_RANKS)).orderBy("feature_id").limit(10).collect()]:
        raise ValueError(f"lineages of other than {len(PR2_RANKS)} labels: {', '.join(wrong)}")
    return files.read_fasta(spark, fasta), lineages.pr2_taxonomy(rows, ranks)


def midori2(spark: SparkSession, paths: dict[str, dict[str, str]]) -> dict[str, Tables]:
    """By gene, of paths as releases.midori2_urls() gives them."""
    return {gene: (files.read_fasta(spark, p["fasta"]), files.read_taxonomy(spark, p["taxon"], header=False)) for gene, p in paths.items()}


def eukaryome(spark: SparkSession, paths: dict[str, str]) -> dict[str, Tables]:
    """By gene, of zip archives with a FASTA file of the archive's name, or that in a 7z
    archive. Raises ValueError where there is none (a job)."""
    out = {}
    for gene, path in paths.items():
        stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        found = files.fasta_records(members(spark, path, f"*{stem}.fasta", "\n>"))
        if found.isEmpty():
            raise ValueError(f"no {stem}.fasta in {path}")
        out[gene] = lineages.eukaryome_split(found)
    return out


def assemblies(spark: SparkSession, paths: list[str], only_genomic: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(genomes, loci, proteins) of packages of assemblies, zip archives of 20 or so each.

    genomes: genome_id, id, description, seq of the molecules in the assembly's sequence
    report, of chromosomes alone if only_genomic; loci: genome_id, ord, value, the lines of
    the GFF files; proteins: genome_id, id, description, seq.
    """
    folder = F.element_at(F.split("member", "/"), -2).alias("genome_id")
    keyed = lambda rows: files.fasta_records(rows.withColumn("genome_id", folder), "genome_id")
    reports = files.sequence_reports(members(spark, paths, "*/sequence_report.jsonl"))
    if only_genomic:
        reports = reports.where("assignedMoleculeLocationType = 'Chromosome'")
    ids = F.explode(F.array_compact(F.array("refseqAccession", "genbankAccession"))).alias("id")
    molecules = reports.select(F.col("assemblyAccession").alias("genome_id"), ids).distinct()
    genomes = keyed(members(spark, paths, "*_genomic.fna", "\n>")).withColumn("seq", F.upper("seq"))
    loci = members(spark, paths, "*/genomic.gff").select(folder, "ord", "value")
    return genomes.join(molecules, ["genome_id", "id"], "left_semi"), loci, keyed(members(spark, paths, "*/protein.faa", "\n>"))


def assembly_lineages(genomes: DataFrame, taxa: DataFrame) -> DataFrame:
    """feature_id (genome_id's molecule), taxon: lineages (feature_id: a genome) told to
    each molecule of it; genomes without a molecule and molecules without a lineage stay."""
    named = taxa.select(F.col("feature_id").alias("genome_id"), "taxon")
    every = named.join(genomes.select("genome_id", "id").distinct(), "genome_id", "full_outer")
    return every.select(F.col("id").alias("feature_id"), "taxon", "genome_id")
