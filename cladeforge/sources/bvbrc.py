"""Tables, sequences and annotations of the BV-BRC service, as Spark sources.

A table is a Spark data source (format `bvbrc`). The service gives pages of 25,000 rows by
offset and doesn't say how many there are: partition k of n reads the pages k, k + n, ...
until one isn't full, so no partition waits for another and none knows the number. What is
asked by ids (sequences by genome or digest, annotations by genome) is a DataFrame of ids,
made distinct, of which each task asks for bounded lists.
"""

from __future__ import annotations

import csv
import io
import json
import urllib.parse
from collections.abc import Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cladeforge.operators import lineages
from cladeforge.operators.rounds import cut
from cladeforge.schema import check_choice
from cladeforge.sources.releases import BVBRC_HOST, bvbrc_query
from cladeforge.sources.web import Client, Damaged, Refused

#: Fixed value: rows of a page.
PAGE = 25_000
#: Ids of one request.
IDS = 500
#: Statuses worth a retry; 400 says what is wrong with the query.
RETRY = (403, 408, 425, 429, 500, 502, 503, 504)
#: The service's tables with those of their fields that are numbers (all
#: others are text).
NUMBERS = {
    "antibiotics": "",
    "enzyme_class_ref": "",
    "epitope": "end start total_assays",
    "epitope_assay": "end start",
    "experiment": "biosets samples",
    "bioset": "",
    "bioset_result": "counts fpkm log2_fc other_value p_value tpm z_score",
    "gene_ontology_ref": "",
    "genome": "cds cds_ratio checkm_completeness checkm_contamination chromosomes coarse_consistency collection_year contig_l50 contig_n50 contigs core_families core_family_ratio fine_consistency gc_content genome_length h_type hypothetical_cds hypothetical_cds_ratio mat_peptide n_type partial_cds partial_cds_ratio patric_cds plasmids plfam_cds plfam_cds_ratio refseq_cds rrna segments trna",
    "strain": "collection_year h_type n_type segment_count",
    "genome_amr": "testing_standard_year",
    "feature_sequence": "",
    "genome_feature": "aa_length classifier_round classifier_score codon_start end na_length start",
    "genome_sequence": "gc_content gi length",
    "id_ref": "",
    "misc_niaid_sgc": "",
    "pathway": "",
    "pathway_ref": "occurrence",
    "ppi": "",
    "protein_family_ref": "",
    "sequence_feature": "end length start",
    "sequence_feature_vt": "",
    "sp_gene": "identity query_coverage same_genome same_genus same_species subject_coverage",
    "sp_gene_ref": "",
    "spike_lineage": "growth_rate lineage_count prevalence total_isolates",
    "spike_variant": "growth_rate lineage_count prevalence total_isolates",
    "structured_assertion": "",
    "subsystem": "",
    "subsystem_ref": "",
    "taxonomy": "cds_mean cds_sd core_families genome_count genome_length_mean genome_length_sd genomes hypothetical_cds_ratio_mean hypothetical_cds_ratio_sd plfam_cds_ratio_mean plfam_cds_ratio_sd",
    "protein_structure": "",
    "protein_feature": "end length score start",
    "surveillance": "collection_latitude collection_longitude",
    "serology": "",
}
#: Texts of a table that stand for no value.
NO_VALUE = frozenset(["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"])


class NoData(LookupError):
    """The query found nothing, or isn't one."""


class UnknownField(ValueError):
    """The table has no such field."""


class UnknownOperator(ValueError):
    """The query uses an operator that the service doesn't have."""


def refusal(data_type: str, refused: Refused) -> Exception:
    """What a refused query is about."""
    if refused.status != 400:
        return ValueError(refused.text)
    if refused.text == "[]":
        return NoData("no data: the query may be wrong, or nothing matches it")
    if not refused.text.startswith("A Database Error Occured:"):
        return ValueError(refused.text)
    told = json.loads(refused.text[refused.text.index("{") :])
    said = f"error {told['code']}: {told['msg']}"
    if told["msg"].startswith("undefined field object"):
        return UnknownOperator(f"{said}; the query's operator is wrong")
    if told["msg"].startswith("undefined field"):
        return UnknownField(f"{said}; the table {data_type} has no such field")
    return ValueError(said)


def ask(client: Client, data_type: str, query: str, accept: str, read, host: str = BVBRC_HOST):
    headers = {"Content-Type": "application/rqlquery+x-www-form-urlencoded", "Accept": accept}
    try:
        return replace(client, retry=RETRY).ask(f"{host}/{data_type}/", read, query.encode(), headers)
    except Refused as refused:
        raise refusal(data_type, refused) from None


def _tsv(body: bytes) -> list[list[str]]:
    csv.field_size_limit(1 << 30)  # sequences are fields, too
    return list(csv.reader(io.StringIO(body.decode("utf-8"), newline=""), delimiter="\t"))


def _json(body: bytes) -> list[dict]:
    try:
        return json.loads(body)
    except ValueError as error:
        raise Damaged(f"broken JSON: {error}") from None


def field_type(data_type: str, field: str) -> T.DataType:
    return T.DoubleType() if field in NUMBERS[data_type].split() else T.StringType()


def _value(text: str | None, kind: T.DataType):
    if text is None or text in NO_VALUE:
        return None
    return float(text) if isinstance(kind, T.DoubleType) else text


def _plain(value, kind: T.DataType):
    """A value of JSON as the column has it; lists and objects stay JSON."""
    if value is None or isinstance(kind, T.DoubleType):
        return value if value is None else float(value)
    return value if isinstance(value, str) else json.dumps(value)


class _Pages(InputPartition):
    def __init__(self, k: int):
        super().__init__(k)
        self.k = k


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.data_type, self.query, self.schema = options["data_type"], options["query"], schema
        self.host, self.size = options.get("host", BVBRC_HOST), int(options.get("page", PAGE))
        self.client = Client.of(options)

    def partitions(self) -> list[InputPartition]:
        return [_Pages(k) for k in range(self.client.parallel)]

    def read(self, partition: _Pages) -> Iterator[tuple]:
        kinds = [(f.name, f.dataType) for f in self.schema.fields]
        fields = f"&select({','.join(n for n, _ in kinds)})"
        page = partition.k
        while True:
            query = f"{self.query}&limit({self.size},{page * self.size}){fields}"
            try:
                rows = ask(self.client, self.data_type, query, "text/tsv", _tsv, self.host)
            except NoData:
                if page == 0:
                    raise
                return
            header, rows = (rows[0], rows[1:]) if rows else ([], [])
            at = {n: i for i, n in enumerate(header)}
            for row in rows:
                yield tuple(_value(row[at[n]] if n in at and at[n] < len(row) else None, kind) for n, kind in kinds)
            if len(rows) < self.size:
                return
            page += self.client.parallel


class BvbrcSource(DataSource):
    """spark.read.format("bvbrc") with the options data_type, query, host, page, and those
    of web.Client; columns as given by schema(), or all that the service names, with the
    types that NUMBERS says."""

    NAMES = ("data_type", "query", "host", "page", "spacing", "parallel", "tries", "first", "most", "timeout")

    @classmethod
    def name(cls) -> str:
        return "bvbrc"

    def _options(self) -> dict[str, str]:
        given = {k: self.options.get(k) for k in self.NAMES if self.options.get(k) is not None}
        check_choice("data_type", given.get("data_type", ""), NUMBERS)
        if not given.get("query"):
            raise ValueError("the option query is needed")
        return given

    def schema(self) -> T.StructType:
        o = self._options()
        rows = ask(Client.of(o), o["data_type"], f"{o['query']}&limit(1,0)", "text/tsv", _tsv, o.get("host", BVBRC_HOST))
        if len(rows) < 2:
            raise NoData("no data: the query may be wrong, or nothing matches it")
        return T.StructType([T.StructField(n, field_type(o["data_type"], n)) for n in rows[0]])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self._options(), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BvbrcSource)


def table(spark: SparkSession, data_type: str, query: str, fields: list[str] | None = None, client: Client | None = None, host: str = BVBRC_HOST, page: int = PAGE) -> DataFrame:
    """The rows of a table that match a query (see releases.bvbrc_query()), fetched once and
    kept; all columns, or the fields."""
    check_choice("data_type", data_type, NUMBERS)
    register(spark)
    rows = spark.read.format("bvbrc").options(data_type=data_type, query=query, host=host, page=str(page), **(client or Client()).options())
    if fields is not None:
        rows = rows.schema(T.StructType([T.StructField(n, field_type(data_type, n)) for n in fields]))
    return cut(rows.load())


def by_ids(ids: DataFrame, data_type: str, field: str, fields: list[str], client: Client | None = None, host: str = BVBRC_HOST, page: int = PAGE) -> DataFrame:
    """The fields of the rows whose field is among the distinct ids (first column), kept."""
    check_choice("data_type", data_type, NUMBERS)
    client = client or Client()
    schema = T.StructType([T.StructField(n, field_type(data_type, n)) for n in fields])

    def asked(held: list[str]) -> Iterator[pa.RecordBatch]:
        listed, start = ",".join(urllib.parse.quote(i, safe="") for i in held), 0
        while True:
            query = f"in({field},({listed}))&limit({page},{start})&select({','.join(fields)})"
            rows = ask(client, data_type, query, "application/json", _json, host)
            columns = [pa.array([_plain(r.get(f.name), f.dataType) for r in rows], pa.float64() if isinstance(f.dataType, T.DoubleType) else pa.string()) for f in schema.fields]
            yield pa.RecordBatch.from_arrays(columns, fields)
            if len(rows) < page:
                return
            start += page

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        for batch in batches:
            held += batch.column(0).to_pylist()
            while len(held) >= IDS:
                yield from asked(held[:IDS])
                held = held[IDS:]
        if held:
            yield from asked(held)

    return cut(_distinct(ids).coalesce(client.parallel).mapInArrow(run, schema))


def _distinct(ids: DataFrame) -> DataFrame:
    return ids.select(F.col(ids.columns[0]).cast("string").alias("id")).where("id is not null").distinct()


def loci(genomes: DataFrame, client: Client | None = None, host: str = BVBRC_HOST) -> DataFrame:
    """genome_id, ord, value: the GFF lines of each of the distinct genomes (first column),
    without the prefix of sequence names, kept."""
    client = client or Client()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for genome in batch.column(0).to_pylist():
                query = f"eq(genome_id,{urllib.parse.quote(genome, safe='')})&limit({PAGE},0)"
                lines = ask(client, "genome_feature", query, "application/gff", lambda b: b.decode("utf-8").splitlines(), host)
                yield pa.RecordBatch.from_arrays([pa.array([genome] * len(lines), pa.string()), pa.array(range(len(lines)), pa.int64()), pa.array(lines, pa.string())], ["genome_id", "ord", "value"])

    lines = _distinct(genomes).coalesce(client.parallel).mapInArrow(run, "genome_id string, ord long, value string")
    return cut(lineages.gff_without_accession_prefix(lines))


def metadata(spark: SparkSession, data_type: str, rql_query: str | None = None, data_field: str | None = None, ids: list[str] | None = None, client: Client | None = None, host: str = BVBRC_HOST, page: int = PAGE) -> DataFrame:
    """All columns of the matching rows, texts of white space only as null. None match: NoData."""
    return lineages.blank_to_null(table(spark, data_type, bvbrc_query(rql_query, data_field, ids), None, client, host, page))


def _taxonomy(rows: DataFrame, key: str, ranks: list[str] | None, rank_propagation: bool, client: Client | None, host: str, page: int) -> DataFrame:
    """feature_id, taxon of rows (key, taxon_id); rows of an unknown taxon_id are left out."""
    taxa = by_ids(rows.select("taxon_id"), "taxonomy", "taxon_id", ["taxon_id", "lineage_names", "lineage_ranks"], client, host, page)
    named = taxa.select("taxon_id", lineages.ranked_lineage(_listed("lineage_names"), _listed("lineage_ranks"), ranks, rank_propagation).alias("taxon"))
    return rows.join(named, "taxon_id").select(F.col(key).alias("feature_id"), "taxon")


def _listed(column: str):
    """A list, which is JSON here, as the `;`-joined text that the service's tables have."""
    items = F.from_json(column, "array<string>")
    return F.when(F.startswith(F.col(column), F.lit("[")), F.concat_ws(";", items)).otherwise(F.col(column))


def genomes(spark: SparkSession, rql_query: str | None = None, data_field: str | None = None, ids: list[str] | None = None, ranks: list[str] | None = None, rank_propagation: bool = True, client: Client | None = None, host: str = BVBRC_HOST, page: int = PAGE) -> tuple[DataFrame, DataFrame]:
    """(sequences, taxonomy) of the matching genomes: genome_id, id, description, seq, and
    feature_id (a sequence), taxon."""
    found = table(spark, "genome", bvbrc_query(rql_query, data_field, ids), ["genome_id", "taxon_id"], client, host, page)
    parts = by_ids(found, "genome_sequence", "genome_id", ["accession", "description", "genome_name", "genome_id", "sequence"], client, host, page)
    title = F.concat(F.lit("  "), "description", F.lit("   ["), "genome_name", F.lit(" | "), "genome_id", F.lit("]"))
    sequences = parts.select("genome_id", F.col("accession").alias("id"), title.alias("description"), F.upper("sequence").alias("seq"))
    of = parts.select("accession", "genome_id").join(found.dropDuplicates(["genome_id"]), "genome_id")
    return sequences, _taxonomy(of.select("accession", "taxon_id"), "accession", ranks, rank_propagation, client, host, page)


def genome_features(spark: SparkSession, rql_query: str | None = None, data_field: str | None = None, ids: list[str] | None = None, ranks: list[str] | None = None, rank_propagation: bool = True, client: Client | None = None, host: str = BVBRC_HOST, page: int = PAGE) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(genes, proteins, taxonomy, loci) of the matching features: genome_id, feature_id, seq
    twice; feature_id, taxon; and the GFF lines of their genomes."""
    fields = ["genome_id", "feature_id", "aa_sequence_md5", "na_sequence_md5", "taxon_id"]
    found = table(spark, "genome_feature", bvbrc_query(rql_query, data_field, ids), fields, client, host, page)
    digests = found.select(F.explode(F.array_compact(F.array("aa_sequence_md5", "na_sequence_md5"))).alias("md5"))
    sequences = by_ids(digests, "feature_sequence", "md5", ["md5", "sequence"], client, host, page)
    genes, proteins = lineages.features_with_sequences(found, sequences)
    taxa = _taxonomy(found.select("feature_id", "taxon_id"), "feature_id", ranks, rank_propagation, client, host, page)
    return genes, proteins, taxa, loci(found.select("genome_id"), client, host)
