"""Readers and writers of sequence, read and taxonomy files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cladeforge.operators.rounds import cut
from cladeforge.schema import SILVA_MAP_FILE, SILVA_RANKS_FILE, TAXONOMY


def read_fasta(spark: SparkSession, path: str | list[str], upper: bool = False) -> DataFrame:
    """id, description, seq, ord of FASTA files, gzipped or not.

    ord counts up in the order of the records of a file.
    """
    rows = spark.read.text(path, lineSep="\n>")
    return fasta_records(rows.withColumn("ord", F.monotonically_increasing_id()), upper=upper)


def fasta_records(rows: DataFrame, *keys: str, upper: bool = False) -> DataFrame:
    """keys, id, description, seq, ord of rows ord, value: FASTA text cut at each `\\n>`."""
    text = F.regexp_replace("value", "^>", "")
    head = F.regexp_replace(F.substring_index(text, "\n", 1), "\r$", "")
    body = F.when(F.contains(text, F.lit("\n")), F.regexp_replace(text, "^[^\n]*\n", "")).otherwise("")
    seq = F.translate(body, "\r\n \t", "")
    return rows.where(F.trim("value") != "").select(
        *keys,
        F.regexp_extract(head, r"^(\S*)", 1).alias("id"),
        F.regexp_replace(head, r"^\S*\s*", "").alias("description"),
        (F.upper(seq) if upper else seq).alias("seq"),
        "ord",
    )


def check_aligned(sequences: DataFrame) -> None:
    """Raises ValueError if the sequences of an alignment differ in length (a job)."""
    found = sequences.agg(F.min(F.length("seq")).alias("low"), F.max(F.length("seq")).alias("high")).first()
    if found["low"] != found["high"]:
        raise ValueError(f"aligned sequences of {found['low']} to {found['high']} letters")


def fasta_lines(sequences: DataFrame) -> DataFrame:
    head = F.concat_ws(" ", "id", F.when(F.col("description") != "", F.col("description"))) if "description" in sequences.columns else F.col("id")
    return sequences.select(F.concat(F.lit(">"), head, F.lit("\n"), "seq").alias("value"), *[c for c in sequences.columns if c == "genome_id"])


def write_fasta(sequences: DataFrame, path: str, by_genome: bool = False) -> None:
    """Text files of records; a folder for each genome_id if by_genome."""
    writer = fasta_lines(sequences).write
    (writer.partitionBy("genome_id") if by_genome else writer).text(path)


def read_taxonomy(spark: SparkSession, path: str | list[str], header: bool = True) -> DataFrame:
    """feature_id, taxon and further columns of tab-separated files, all as text."""
    if not header:
        return spark.read.csv(path, sep="\t", schema=TAXONOMY, quote="")
    rows = spark.read.csv(path, sep="\t", header=True, quote="")
    return rows.toDF("feature_id", "taxon", *rows.columns[2:])


def write_metadata(table: DataFrame, path: str) -> None:
    """Tab-separated files with a header, whose first column is named id; empty for null."""
    named = table.withColumnRenamed(table.columns[0], "id")
    named.write.csv(path, sep="\t", header=True, emptyValue="", quote="")


def write_loci(loci: DataFrame, path: str) -> None:
    """GFF lines (genome_id, ord, value), in order, as one file in a folder for each genome."""
    ordered = loci.repartition("genome_id").sortWithinPartitions("genome_id", "ord")
    ordered.select("value", "genome_id").write.partitionBy("genome_id").text(path)


def write_taxonomy(taxonomy: DataFrame, path: str) -> None:
    named = taxonomy.withColumnsRenamed({"feature_id": "Feature ID", "taxon": "Taxon"})
    named.write.csv(path, sep="\t", header=True, quote="")


def _silva_rows(lines: DataFrame, schema: StructType, path: str, taxid: str) -> DataFrame:
    """The columns of schema of tab-separated lines; empty cells are null.

    A line of another number of cells, without a `;` in the column path or without a number
    in the column taxid fails the job that reads it, whatever columns that needs.
    """
    cells = F.transform(F.split("value", "\t", -1), lambda x: F.nullif(F.trim(x), F.lit("")))
    cell = {name: F.get(cells, F.lit(i)) for i, name in enumerate(schema.names)}
    fault = (
        F.when(F.size(cells) != len(schema), F.lit(f"not {len(schema)} fields"))
        .when(~F.coalesce(F.contains(cell[path], F.lit(";")), F.lit(False)), F.lit(f"{path} is no lineage of labels that end in ;"))
        .when(cell[taxid].try_cast("double").isNull(), F.lit(f"{taxid} is no number"))
    )
    right = F.when(fault.isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(fault, F.lit(": "), "value")).cast("boolean"))
    return lines.where(right).select(*(cell[f.name].cast(f.dataType).alias(f.name) for f in schema))


def read_silva_ranks(spark: SparkSession, path: str) -> DataFrame:
    """Raises ValueError if the file is empty (a job over its first line)."""
    lines = spark.read.text(path)
    if lines.isEmpty():
        raise ValueError("a rank table of SILVA without records")
    return _silva_rows(lines, SILVA_RANKS_FILE, SILVA_RANKS_FILE.names[0], SILVA_RANKS_FILE.names[1])


def read_silva_map(spark: SparkSession, path: str) -> DataFrame:
    """Either spelling of the header of the organism's name is read.

    Raises ValueError if the header is another or nothing follows it (a job over the first
    two lines).
    """
    lines = spark.read.text(path)
    first = [r["value"] for r in lines.limit(2).collect()]
    header = [c.strip() for c in first[0].split("\t")] if first else []
    names = ["organism_name" if c == "organismName" else c for c in header]
    if lacking := [n for n in SILVA_MAP_FILE.names if n not in names]:
        raise ValueError(f"not a SILVA taxonomy map; it lacks {', '.join(lacking)}")
    if names != SILVA_MAP_FILE.names:
        raise ValueError(f"not a SILVA taxonomy map; its header is {', '.join(header)}")
    if len(first) == 1:
        raise ValueError("a taxonomy map of SILVA without records")
    return _silva_rows(lines.where(F.col("value") != first[0]), SILVA_MAP_FILE, "path", "taxid")


def read_replacements(spark: SparkSession, path: str) -> dict[str, str]:
    """A small table id, replacements, for edit_taxonomy()."""
    rows = spark.read.csv(path, sep="\t", header=True, quote="").toDF("id", "replacements")
    return {r["id"]: r["replacements"] or "" for r in rows.collect()}


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, comment="#").toDF("sample_id", "filename", "direction")


def read_fastq(spark: SparkSession, path: str, sample_id: str, direction: str) -> DataFrame:
    """sample_id, direction, read_no, header, seq, qual of one file of four-line records.

    A gzipped file is read by one task, in order; a plain one in splits, whose lines are
    numbered by what the splits before them have.
    """
    lines = spark.read.text(path).select("value", F.input_file_block_start().alias("part"), F.monotonically_increasing_id().alias("n"))
    lines = cut(lines)  # the numbers must not follow another split of the file
    sizes = lines.groupBy("part").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("first"))
    before = (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before")  # a row a split
    numbered = lines.join(F.broadcast(sizes.select("part", "first", before)), "part")
    numbered = numbered.select("value", (F.col("n") - F.col("first") + F.col("before")).alias("n"))
    each = numbered.select((F.col("n") / 4).cast("long").alias("read_no"), (F.col("n") % 4).alias("k"), "value")
    line = lambda k: F.max(F.when(F.col("k") == k, F.col("value")))
    reads = each.groupBy("read_no").agg(line(0).alias("header"), line(1).alias("seq"), line(3).alias("qual"))
    return reads.select(
        F.lit(sample_id).alias("sample_id"), F.lit(direction).alias("direction"), "read_no", F.substring("header", 2, 1 << 30).alias("header"), "seq", "qual"
    )


def write_fastq(reads: DataFrame, path: str) -> None:
    """Gzipped text of four-line records, in the order of reads, a folder a sample and direction."""
    record = F.concat(F.lit("@"), "header", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value")
    ordered = reads.repartition("sample_id", "direction").sortWithinPartitions("sample_id", "direction", "read_no")
    ordered.select(record, "sample_id", "direction").write.partitionBy("sample_id", "direction").option("compression", "gzip").text(path)


def read_newick(spark: SparkSession, text: str) -> DataFrame:
    """node_id, parent_id of a tree in Newick format whose nodes are all named."""
    return spark.createDataFrame(newick_edges(text), "node_id string, parent_id string")


def newick_edges(text: str) -> list[tuple[str, str | None]]:
    """(node, parent) of every node, the root's parent None. Lengths are ignored."""
    edges: list[tuple[str, str | None]] = []
    waiting: list[list[str]] = [[]]  # names of the finished children, by depth
    name, skip, last = "", False, []
    for c in text.strip():
        if c in "(),;":
            if name or last:
                node = name.strip("'\" ")
                edges += [(child, node) for child in last]
                waiting[-1].append(node)
            name, skip, last = "", False, []
            if c == "(":
                waiting.append([])
            elif c == ")":
                last = waiting.pop()
            elif c == ";":
                break
        elif c == ":":
            skip = True
        elif not skip:
            name += c
    return edges + [(root, None) for root in waiting[0]]


REPORT = "assemblyAccession string, assignedMoleculeLocationType string, chrName string, genbankAccession string, refseqAccession string, length long"


def read_sequence_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=REPORT)


def sequence_reports(lines: DataFrame) -> DataFrame:
    """The same of rows value, lines of JSON."""
    return lines.select(F.from_json("value", REPORT).alias("x")).select("x.*").where("assemblyAccession is not null")


NCBI_TAXON = (
    "TaxId string, ScientificName string, Division string, AkaTaxIds struct<TaxId: array<string>>, "
    "LineageEx struct<Taxon: array<struct<TaxId: string, ScientificName: string, Rank: string>>>"
)


def read_ncbi_taxa(spark: SparkSession, path: str) -> DataFrame:
    """taxid, organism, division, lineage, aka of a file of taxonomy records in XML."""
    rows = spark.read.format("xml").option("rowTag", "Taxon").schema(NCBI_TAXON).load(path)
    lineage = F.transform("LineageEx.Taxon", lambda x: F.struct(x["Rank"].alias("rank"), x["ScientificName"].alias("name")))
    return rows.where("LineageEx is not null").select(
        F.col("TaxId").alias("taxid"), F.col("ScientificName").alias("organism"), F.col("Division").alias("division"), lineage.alias("lineage"), F.col("AkaTaxIds.TaxId").alias("aka")
    )
