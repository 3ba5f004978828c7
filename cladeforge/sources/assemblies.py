"""Genome assemblies of a taxon, by the service's reports and packages, as a Spark source.

Planning follows the reports page by page, each naming the next by a token, and deals the
assemblies out, 20 to a partition. A partition downloads one package; one that fails is
asked for again in halves, down to single assemblies.
"""

from __future__ import annotations

import io
import json
import urllib.parse
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cladeforge.operators import lineages
from cladeforge.operators.rounds import cut
from cladeforge.schema import check_choice, check_range, check_subset
from cladeforge.sources import entrez, files
from cladeforge.sources.landed import assembly_lineages
from cladeforge.sources.web import Client, Damaged, Refused

#: The service's address, what a package holds, assemblies of one.
HOST = "https://api.ncbi.nlm.nih.gov/datasets/v2"
PARTS = ("PROT_FASTA", "GENOME_GFF", "GENOME_FASTA", "SEQUENCE_REPORT")
PACKAGE = 20
SOURCES = ("all", "refseq", "genbank")
LEVELS = ("complete_genome", "chromosome", "scaffold", "contig")
#: kind: assembly, report, genome, locus or protein.
ROW = "kind string, genome_id string, taxid string, ord long, id string, description string, seq string, value string"


def _page(body: bytes) -> dict:
    try:
        return json.loads(body)
    except ValueError as error:
        raise Damaged(f"broken JSON: {error}") from None


def reports(client: Client, taxa: list[str], source: str, levels: list[str], only_reference: bool, exact: bool, page: int, host: str = HOST) -> Iterator[tuple[str, str]]:
    """(accession, taxid) of all annotated assemblies, over as many pages as there are."""
    given = [("page_size", page), ("filters.assembly_source", source), *(("filters.assembly_level", x) for x in levels)]
    given += [("filters.reference_only", str(only_reference).lower()), ("filters.has_annotation", "true"), ("tax_exact_match", str(exact).lower())]
    names, token = urllib.parse.quote(",".join(taxa), safe=","), ""
    while True:
        query = urllib.parse.urlencode([*given, *([("page_token", token)] if token else [])])
        found = client.ask(f"{host}/genome/taxon/{names}/dataset_report?{query}", _page)
        if not found.get("reports"):
            told = [m["error"]["message"] for m in found.get("messages") or [] if m.get("error")]
            raise LookupError("no genomes: " + (told[0] if told else "the query may be too narrow; widen the source, the levels, only_reference, the taxon or its exact match"))
        yield from ((r["accession"], str(r["organism"]["tax_id"])) for r in found["reports"])
        token = found.get("next_page_token") or ""
        if not token:
            return


def _package(body: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(body))
    except zipfile.BadZipFile as error:
        raise Damaged(f"broken package: {error}") from None


def packages(client: Client, accessions: list[str], host: str = HOST) -> Iterator[zipfile.ZipFile]:
    """The packages of the accessions: one, or those of its halves where it fails."""
    query = urllib.parse.urlencode([("include_annotation_type", p) for p in PARTS])
    try:
        yield client.ask(f"{host}/genome/accession/{','.join(accessions)}/download?{query}", _package)
    except (RuntimeError, Refused):
        if len(accessions) == 1:
            raise
        half = len(accessions) // 2
        for part in (accessions[:half], accessions[half:]):
            yield from packages(client, part, host)


def _fasta(lines: Iterator[str]) -> Iterator[tuple[str, str, str]]:
    head, letters = None, []
    for line in lines:
        if line.startswith(">"):
            if head is not None:
                yield (*head, "".join(letters))
            name, _, description = line[1:].partition(" ")
            head, letters = (name, description), []
        else:
            letters.append(line)
    if head is not None:
        yield (*head, "".join(letters))


def package_rows(package: zipfile.ZipFile) -> Iterator[tuple]:
    """Rows (see ROW) of a package, a member at a time, its lines streamed."""
    for member in sorted(package.namelist()):
        *_, genome, name = ["", *member.split("/")]
        with package.open(member) as raw:
            lines = (line.rstrip("\r\n") for line in io.TextIOWrapper(raw, "utf-8"))
            if name == "sequence_report.jsonl":
                yield from (("report", genome, None, i, None, None, None, x) for i, x in enumerate(lines) if x)
            elif name == "genomic.gff":
                yield from (("locus", genome, None, i, None, None, None, x) for i, x in enumerate(lines))
            elif name.endswith("_genomic.fna"):
                yield from (("genome", genome, None, i, n, d, s.upper(), None) for i, (n, d, s) in enumerate(_fasta(lines)))
            elif name == "protein.faa":
                yield from (("protein", genome, None, i, n, d, s, None) for i, (n, d, s) in enumerate(_fasta(lines)))


class _Package(InputPartition):
    def __init__(self, assemblies: list[tuple[str, str]]):
        super().__init__(json.dumps(assemblies))
        self.assemblies = assemblies


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.host = options, options.get("host", HOST)
        self.client = Client.of(options)

    def partitions(self) -> list[InputPartition]:
        o = self.options
        yes = lambda name, default: o.get(name, default) == "true"
        found = dict(
            reports(self.client, json.loads(o["taxa"]), o.get("source", "refseq"), json.loads(o.get("levels", '["complete_genome"]')), yes("only_reference", "true"), yes("exact", "false"), int(o.get("page", "20")), self.host)
        )
        every = list(found.items())
        return [_Package(every[k : k + PACKAGE]) for k in range(0, len(every), PACKAGE)]

    def read(self, partition: _Package) -> Iterator[tuple]:
        yield from (("assembly", name, taxid, 0, None, None, None, None) for name, taxid in partition.assemblies)
        for package in packages(self.client, [name for name, _ in partition.assemblies], self.host):
            yield from package_rows(package)


class AssembliesSource(DataSource):
    """spark.read.format("assemblies") with the options taxa, levels (lists in JSON), source,
    only_reference, exact (true or false), page, host, and those of web.Client."""

    NAMES = ("taxa", "levels", "source", "only_reference", "exact", "page", "host", "spacing", "parallel", "tries", "first", "most", "timeout")

    @classmethod
    def name(cls) -> str:
        return "assemblies"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k: self.options.get(k) for k in self.NAMES if self.options.get(k) is not None})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AssembliesSource)


def ncbi_genomes(
    spark: SparkSession,
    taxa: list[str],
    assembly_source: str = "refseq",
    assembly_levels: tuple[str, ...] = ("complete_genome",),
    only_reference: bool = True,
    only_genomic: bool = False,
    tax_exact_match: bool = False,
    page_size: int = 20,
    ranks: list[str] | None = None,
    rank_propagation: bool = True,
    client: Client | None = None,
    host: str = HOST,
    entrez_client: Client | None = None,
    entrez_host: str = entrez.ENTREZ_HOST,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(genomes, loci, proteins, taxonomy) of the assemblies of taxa.

    genomes: genome_id, id, description, seq of the molecules that the assembly's report
    lists (of chromosomes, if only_genomic); loci: genome_id, ord, value, the lines of the
    GFF files; proteins: genome_id, id, description, seq; taxonomy: feature_id (molecule),
    taxon, genome_id. All are read from one download, which is kept (see rounds.cut). A
    taxid without a lineage raises ValueError.
    """
    check_choice("assembly_source", assembly_source, SOURCES)
    check_subset("assembly_levels", assembly_levels, LEVELS)
    check_range("page_size", page_size, 20, 1000)
    register(spark)
    options = {"taxa": json.dumps(list(taxa)), "levels": json.dumps(list(assembly_levels)), "source": assembly_source, "page": str(page_size), "host": host}
    options |= {"only_reference": str(only_reference).lower(), "exact": str(tax_exact_match).lower()} | (client or Client()).options()
    rows = cut(spark.read.format("assemblies").options(**options).load())
    kind = lambda name: rows.where(F.col("kind") == name)

    molecules = files.sequence_reports(kind("report").select("value"))
    if only_genomic:
        molecules = molecules.where("assignedMoleculeLocationType = 'Chromosome'")
    ids = F.explode(F.array_compact(F.array("refseqAccession", "genbankAccession"))).alias("id")
    molecules = molecules.select(F.col("assemblyAccession").alias("genome_id"), ids).distinct()
    genomes = kind("genome").select("genome_id", "id", "description", "seq").join(molecules, ["genome_id", "id"], "left_semi")

    known = kind("assembly").select(F.col("genome_id").alias("accession"), "taxid")
    records = entrez.by_ids(known.select("taxid"), "taxonomy", entrez_client, entrez_host, whole=False)
    named, lost = lineages.with_lineages(known, lineages.ncbi_lineages(records, ranks, rank_propagation))
    if bad := [r["accession"] for r in lost.select("accession").orderBy("accession").limit(10).collect()]:
        raise ValueError(f"assemblies whose taxid has no lineage: {', '.join(bad)}")
    loci, proteins = kind("locus").select("genome_id", "ord", "value"), kind("protein").select("genome_id", "id", "description", "seq")
    return genomes, loci, proteins, assembly_lineages(genomes, named)
