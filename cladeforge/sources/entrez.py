"""Records of the Entrez databases, by a query or by ids, as Spark sources.

A query is a Spark data source (format `entrez`): planning asks the service once for the
history's name and the number of records, and deals chunks of 5,000 out to `parallel`
partitions, each of which fetches its own. Ids are rows of a DataFrame: they are made
distinct, dealt to `parallel` tasks, and each task posts and fetches chunks of 5,000.
Tasks space their requests so that together they keep to the service's limit.
"""

from __future__ import annotations

import json
import logging
import urllib.parse
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cladeforge.operators import lineages
from cladeforge.operators.rounds import cut
from cladeforge.schema import check_choice
from cladeforge.sources.releases import ENTREZ_HOST, entrez_chunks
from cladeforge.sources.web import Client, Damaged

#: Seconds between requests, records of one, numbers from which the service
#: asks for nights and weekends.
SPACING, CHUNK = 0.334, 5000
MANY_IDS, MANY_HITS = 125_000, 166_666
SEQUENCE = "accession string, taxid string, description string, seq string"
TAXON = "taxid string, organism string, division string, lineage array<struct<rank: string, name: string>>, aka array<string>"

log = logging.getLogger(__name__)


def _sequence(record: ET.Element) -> tuple:
    text = lambda tag: record.findtext(f"TSeq_{tag}")
    name = text("accver") or text("sid")
    if not name or text("sequence") is None:
        raise Damaged("a record without a name or a sequence")
    if not text("accver"):
        log.warning("using %s as identifier: it came without a version", name)
    return name, text("taxid"), text("defline") or "", text("sequence")


def _taxon(record: ET.Element) -> tuple:
    line = [{"rank": t.findtext("Rank"), "name": t.findtext("ScientificName")} for t in record.findall("LineageEx/Taxon")]
    aka = [t.text for t in record.findall("AkaTaxIds/TaxId")]
    return record.findtext("TaxId"), record.findtext("ScientificName"), record.findtext("Division"), line or None, aka


#: Of each kind of record: the element that holds one, and the row that it gives.
KINDS = {"sequence": ("TSeq", _sequence, SEQUENCE), "taxonomy": ("Taxon", _taxon, TAXON)}


def kind_of(database: str) -> str:
    check_choice("database", database, ("nuccore", "protein", "taxonomy"))
    return "taxonomy" if database == "taxonomy" else "sequence"


def records(body: bytes, kind: str) -> list[tuple]:
    """Rows of an answer's records; Damaged where it isn't whole XML."""
    tag, row, _ = KINDS[kind]
    try:
        root = ET.fromstring(body)
    except ET.ParseError as error:
        raise Damaged(f"broken XML: {error}") from None
    found = root.findall(tag)
    if len(found) != len(root):
        raise Damaged("an answer with other elements than records")
    return [row(r) for r in found]


def history(body: bytes, root: str, without: str) -> tuple[str, str, int]:
    """The history's name, its query's number and how many records it has; the service's
    warnings are logged."""
    try:
        found = ET.fromstring(body)
    except ET.ParseError as error:
        raise Damaged(f"broken XML: {error}") from None
    if found.tag != root:
        raise Damaged(f"{found.tag} instead of {root}")
    for error in found.iter("ERROR"):
        log.warning("%s", error.text)
    if found.findtext("WebEnv") is None:
        raise LookupError(without)
    return found.findtext("WebEnv"), found.findtext("QueryKey"), int(found.findtext("Count") or 0)


def search(client: Client, database: str, query: str, host: str = ENTREZ_HOST) -> tuple[str, str, int]:
    given = urllib.parse.urlencode({"db": database, "term": query, "usehistory": "y", "retmax": 0})
    return client.ask(f"{host}/esearch.fcgi?{given}", lambda b: history(b, "eSearchResult", "no sequences for the query"))


def post(client: Client, database: str, ids: list[str], host: str = ENTREZ_HOST) -> tuple[str, str, int]:
    data = urllib.parse.urlencode({"db": database, "id": ",".join(ids)}).encode()
    return client.ask(f"{host}/epost.fcgi", lambda b: history(b, "ePostResult", "no data for the ids"), data)


def fetch(client: Client, database: str, web_env: str, query_key: str, start: int = 0, size: int = CHUNK, host: str = ENTREZ_HOST) -> list[tuple]:
    given = {"db": database, "WebEnv": web_env, "query_key": query_key, "retstart": start, "retmax": size, "retmode": "xml"}
    given |= {} if database == "taxonomy" else {"rettype": "fasta"}
    return client.ask(f"{host}/efetch.fcgi?{urllib.parse.urlencode(given)}", lambda b: records(b, kind_of(database)))


class _Chunks(InputPartition):
    def __init__(self, web_env: str, query_key: str, chunks: list[tuple[int, int]]):
        super().__init__(json.dumps([web_env, query_key, chunks]))
        self.web_env, self.query_key, self.chunks = web_env, query_key, chunks


class _QueryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.database, self.query = options.get("database", "nuccore"), options["query"]
        self.host, self.size = options.get("host", ENTREZ_HOST), int(options.get("chunk", CHUNK))
        self.client = Client.of(options, spacing=SPACING)

    def partitions(self) -> list[InputPartition]:
        web_env, key, count = search(self.client, self.database, self.query, self.host)
        if count > MANY_HITS:
            log.warning("%d records: the service asks for nights and weekends", count)
        chunks = entrez_chunks(count, self.size)
        n = max(1, min(self.client.parallel, len(chunks)))
        return [_Chunks(web_env, key, chunks[k::n]) for k in range(n)]

    def read(self, partition: _Chunks) -> Iterator[tuple]:
        for start, size in partition.chunks:
            rows = fetch(self.client, self.database, partition.web_env, partition.query_key, start, size, self.host)
            if len(rows) != size:
                log.warning("expected %d records from %d on, got %d", size, start, len(rows))
            yield from rows


class EntrezSource(DataSource):
    """spark.read.format("entrez") with the options query, database (nuccore, protein or
    taxonomy), host, chunk, and those of web.Client."""

    @classmethod
    def name(cls) -> str:
        return "entrez"

    def schema(self) -> str:
        return KINDS[kind_of(self.options.get("database", "nuccore"))][2]

    def reader(self, schema) -> DataSourceReader:
        if not self.options.get("query"):
            raise ValueError("the option query is needed")
        return _QueryReader({k: self.options.get(k) for k in ("database", "query", "host", "chunk", "spacing", "parallel", "tries", "first", "most", "timeout") if self.options.get(k) is not None})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EntrezSource)


def by_query(spark: SparkSession, query: str, database: str = "nuccore", client: Client | None = None, host: str = ENTREZ_HOST, chunk: int = CHUNK) -> DataFrame:
    """The records of a query, fetched once and kept (see rounds.cut); columns by SEQUENCE
    or TAXON. Nothing found raises."""
    register(spark)
    client = client or Client(spacing=SPACING)
    return cut(spark.read.format("entrez").options(query=query, database=database, host=host, chunk=str(chunk), **client.options()).load())


def missing(ids: list[str], got: list[tuple]) -> str:
    """What a partial download lacks: up to ten ids."""
    lost = sorted(set(ids) - {r[0] for r in got})
    named = f"more than 10 ids are missing, such as {', '.join(lost[:10])}" if len(lost) > 10 else f"missing: {', '.join(lost)}"
    return f"partial download: expected {len(ids)} records, got {len(got)}; {named}"


def _for_ids(database: str, client: Client, host: str, chunk: int, whole: bool):
    _, _, ddl = KINDS[kind_of(database)]
    names = [f.strip().split(" ")[0] for f in ddl.split(", ")] if database != "taxonomy" else ["taxid", "organism", "division", "lineage", "aka"]
    line = pa.list_(pa.struct([("rank", pa.string()), ("name", pa.string())]))
    kinds = [pa.string()] * 4 if database != "taxonomy" else [pa.string()] * 3 + [line, pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []

        def fetched() -> pa.RecordBatch:
            got = fetch(client, database, *post(client, database, held, host)[:2], 0, len(held), host)
            if len(got) != len(held):
                if whole:
                    raise RuntimeError(missing(held, got))
                log.warning("%s", missing(held, got))
            columns = zip(*got, strict=True) if got else [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for value in batch.column(0).to_pylist():
                held.append(value)
                if len(held) == chunk:
                    yield fetched()
                    held = []
        if held:
            yield fetched()

    return run, ddl


def by_ids(ids: DataFrame, database: str = "nuccore", client: Client | None = None, host: str = ENTREZ_HOST, chunk: int = CHUNK, whole: bool = True) -> DataFrame:
    """The records of the distinct ids (first column, as text; nulls are left out), fetched
    once and kept. With whole, ids without a record raise; else they are logged."""
    client = client or Client(spacing=SPACING)
    run, ddl = _for_ids(database, client, host, chunk, whole)
    distinct = ids.select(F.col(ids.columns[0]).cast("string").alias("id")).where("id is not null").distinct()
    return cut(distinct.coalesce(client.parallel).mapInArrow(run, ddl))


def ncbi_data(
    spark: SparkSession,
    query: str | None = None,
    accessions: DataFrame | None = None,
    database: str = "nuccore",
    ranks: list[str] | None = None,
    rank_propagation: bool = True,
    client: Client | None = None,
    host: str = ENTREZ_HOST,
    chunk: int = CHUNK,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sequences, taxonomy, dropped) of a query, of accessions (first column), or both.

    Accessions that the query already brought aren't fetched again; one without a record
    raises. dropped: accession, taxid of the sequences whose lineage has trouble, which
    neither table holds.
    """
    if query is None and accessions is None:
        raise ValueError("query or accessions are needed")
    check_choice("database", database, ("nuccore", "protein"))
    found = by_query(spark, query, database, client, host, chunk) if query is not None else None
    if accessions is not None:
        wanted = accessions.select(F.col(accessions.columns[0]).cast("string").alias("accession"))
        if found is not None:
            wanted = wanted.join(found.select("accession"), "accession", "left_anti")
        more = by_ids(wanted, database, client, host, chunk)
        found = more if found is None else found.unionByName(more)
    found = found.dropDuplicates(["accession"])
    taxa = by_ids(found.select("taxid"), "taxonomy", client, host, chunk, whole=False)
    named, dropped = lineages.with_lineages(found.select("accession", "taxid"), lineages.ncbi_lineages(taxa, ranks, rank_propagation))
    sequences = found.join(dropped.select("accession"), "accession", "left_anti")
    return sequences.select(F.col("accession").alias("id"), "description", "seq"), named, dropped.select("accession", "taxid")
