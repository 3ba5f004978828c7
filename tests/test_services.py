"""The services' sources against a stub that speaks their protocols on this machine."""

import io
import json
import threading
import time
import urllib.parse
import zipfile
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from cladeforge.sources import assemblies, bvbrc, entrez, web
from cladeforge.sources.web import Client

FAST = Client(first=0.01, tries=4, parallel=3, spacing=0.0)


class Stub:
    """Answers by path; asked holds what came, in turn."""

    def __init__(self):
        self.asked, self.fail, self.lock = [], [], threading.Lock()
        stub = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                self.answer("")

            def do_POST(self):
                self.answer(self.rfile.read(int(self.headers["Content-Length"])).decode())

            def answer(self, body):
                path, _, query = self.path.partition("?")
                with stub.lock:
                    stub.asked.append((path, urllib.parse.parse_qs(query), body, time.monotonic()))
                    fault = stub.fail.pop(0) if stub.fail else None
                if isinstance(fault, int):
                    status, out = fault, b"later"
                elif fault is not None:
                    status, out = 200, fault
                else:
                    status, out = stub.reply(path, urllib.parse.parse_qs(query), body, self.headers)
                self.send_response(status)
                self.send_header("Content-Length", str(len(out)))
                self.end_headers()
                self.wfile.write(out)

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.host = f"http://127.0.0.1:{self.server.server_port}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def reply(self, path, query, body, headers):
        raise NotImplementedError


SPECIES = {"9": ("Aus bus", "Bacteria", [("phylum", "P"), ("genus", "Aus")], ["91"]), "8": ("Cus dus", "Bacteria", [("phylum", "Q"), ("genus", "Cus")], []), "7": (None, "Bacteria", [], [])}


class Entrez(Stub):
    """Sequences S0, S1, ... with the taxids 9, 8, 9, 8, ...; X has one without a lineage."""

    def __init__(self, n=23):
        super().__init__()
        self.every = {f"S{i}.1": ("ACGT" + "A" * i, "98"[i % 2]) for i in range(n)} | {"X.1": ("GG", "7"), "Z.1": ("TT", "91")}
        self.posted = {}

    def reply(self, path, query, body, headers):
        name = path.rsplit("/", 1)[1]
        if name == "esearch.fcgi":
            term = query["term"][0]
            if term == "nothing":
                return 200, b"<eSearchResult><ERROR>empty</ERROR></eSearchResult>"
            found = [k for k in self.every if k[0] in term]
            with self.lock:
                self.posted[f"q{len(self.posted)}"] = found
                env = f"q{len(self.posted) - 1}"
            return 200, f"<eSearchResult><Count>{len(found)}</Count><QueryKey>1</QueryKey><WebEnv>{env}</WebEnv></eSearchResult>".encode()
        if name == "epost.fcgi":
            given = urllib.parse.parse_qs(body)
            with self.lock:
                env = f"p{len(self.posted)}"
                self.posted[env] = given["id"][0].split(",")
            return 200, f"<ePostResult><ERROR>some ids were left out</ERROR><QueryKey>1</QueryKey><WebEnv>{env}</WebEnv></ePostResult>".encode()
        ids = self.posted[query["WebEnv"][0]]
        start, size = int(query["retstart"][0]), int(query["retmax"][0])
        ids = ids[start : start + size]
        if query["db"][0] == "taxonomy":
            out = []
            for i in ids:
                if i in SPECIES:
                    name, division, line, aka = SPECIES[i]
                    line = "".join(f"<Taxon><TaxId>1</TaxId><ScientificName>{n}</ScientificName><Rank>{r}</Rank></Taxon>" for r, n in line)
                    aka = "".join(f"<TaxId>{a}</TaxId>" for a in aka)
                    named = f"<ScientificName>{name}</ScientificName>" if name else ""
                    out.append(f"<Taxon><TaxId>{i}</TaxId>{named}<AkaTaxIds>{aka}</AkaTaxIds><Division>{division}</Division>" + (f"<LineageEx>{line}</LineageEx>" if line else "") + "</Taxon>")
            return 200, f"<TaxaSet>{''.join(out)}</TaxaSet>".encode()
        rows = "".join(
            f"<TSeq><TSeq_seqtype value='n'/>{'' if i == 'S2.1' else f'<TSeq_accver>{i}</TSeq_accver>'}<TSeq_sid>sid|{i}</TSeq_sid><TSeq_taxid>{self.every[i][1]}</TSeq_taxid><TSeq_defline>about {i}</TSeq_defline><TSeq_sequence>{self.every[i][0]}</TSeq_sequence></TSeq>"
            for i in ids
            if i in self.every
        )
        return 200, f"<TSeqSet>{rows}</TSeqSet>".encode()


@pytest.fixture
def stub():
    s = Entrez()
    yield s
    s.server.shutdown()


def test_query_is_dealt_out_in_chunks(spark, stub):
    got = entrez.by_query(spark, "S", client=FAST, host=stub.host, chunk=5).collect()
    assert sorted(r.accession for r in got) == sorted("sid|S2.1" if k == "S2.1" else k for k in stub.every if k[0] == "S")
    assert {r.accession: r.seq for r in got}["S7.1"] == stub.every["S7.1"][0]
    fetched = [int(q["retstart"][0]) for p, q, _, _ in stub.asked if p.endswith("efetch.fcgi")]
    assert sorted(fetched) == [0, 5, 10, 15, 20]  # each chunk once
    assert sum(p.endswith("esearch.fcgi") for p, *_ in stub.asked) == 1


def test_failures_are_tried_again(spark, stub):
    stub.fail = [429, 400, b"<eSearchResult", 503 - 1]
    with pytest.raises(Exception, match="no answer after 4 tries"):
        entrez.by_query(spark, "X", client=FAST, host=stub.host)
    stub.fail = [429, b"<eSearchResult", b"<other/>"]
    assert [r.accession for r in entrez.by_query(spark, "X", client=FAST, host=stub.host).collect()] == ["X.1"]
    stub.fail = [404]
    with pytest.raises(Exception, match="404"):
        entrez.by_query(spark, "X", client=FAST, host=stub.host)
    with pytest.raises(Exception, match="no sequences"):
        entrez.by_query(spark, "nothing", client=FAST, host=stub.host)


def test_ids_are_posted_once_each_and_missing_ones_named(spark, stub):
    ids = spark.createDataFrame([(f"S{i % 20}.1", 1) for i in range(40) if i % 20 != 2] + [(None, 1)], "id string, n int")
    got = entrez.by_ids(ids, client=FAST, host=stub.host, chunk=4)
    assert sorted(r.accession for r in got.collect()) == sorted(f"S{i}.1" for i in range(20) if i != 2)
    posted = [x for v in stub.posted.values() for x in v]
    assert len(posted) == len(set(posted)) == 19 and all(len(v) <= 4 for v in stub.posted.values())
    bad = spark.createDataFrame([(f"no{i}",) for i in range(12)], "id string")
    with pytest.raises(Exception, match="expected 12 records, got 0; more than 10 ids are missing, such as no0, no1, no10"):
        entrez.by_ids(bad, client=Client(first=0.01, tries=2), host=stub.host).collect()


def test_ncbi_data_of_a_query_and_accessions(spark, stub):
    accessions = spark.createDataFrame([("S1.1",), ("X.1",), ("S3.1",)], "accession string")
    seqs, taxa, dropped = entrez.ncbi_data(spark, "Z", accessions, client=FAST, host=stub.host, chunk=2)
    assert sorted(r.id for r in seqs.collect()) == ["S1.1", "S3.1"]
    want = "k__Bacteria; p__Q; c__Q; o__Q; f__Q; g__Cus; s__dus"
    assert sorted(map(tuple, taxa.collect())) == [("S1.1", want), ("S3.1", want)]
    assert sorted(map(tuple, dropped.collect())) == [("X.1", "7"), ("Z.1", "91")]
    seqs, taxa, dropped = entrez.ncbi_data(spark, "S", ranks=["phylum", "species"], rank_propagation=False, client=FAST, host=stub.host)
    assert {r.feature_id: r.taxon for r in taxa.collect()}["S0.1"] == "p__P; s__Aus bus" and dropped.count() == 0
    with pytest.raises(ValueError):
        entrez.ncbi_data(spark)


def test_tasks_keep_the_spacing_together(stub):
    client = Client(spacing=0.05, parallel=3)
    start = time.monotonic()
    for _ in range(3):
        entrez.search(client, "nuccore", "X", stub.host)
    assert time.monotonic() - start >= 2 * 0.15
    assert Client.of({"parallel": "2", "spacing": "0.5"}, spacing=0.334) == Client(parallel=2, spacing=0.5)
    assert Client.of(Client(tries=3).options()) == Client(tries=3)


def packed(names, bad=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in names:
            folder = f"ncbi_dataset/data/{n}"
            lines = [{"assemblyAccession": n, "assignedMoleculeLocationType": t, "chrName": "1", "genbankAccession": g, "refseqAccession": r, "length": 4} for t, g, r in (("Chromosome", f"{n}c", None), ("Plasmid", None, f"{n}p"))]
            z.writestr(f"{folder}/sequence_report.jsonl", "\n".join(map(json.dumps, lines)))
            z.writestr(f"{folder}/{n}_x_genomic.fna", f">{n}c one two\nacg\nt\n>{n}p\nGG\n>{n}u unlisted\nA\n")
            z.writestr(f"{folder}/genomic.gff", "##gff\n\nline\n")
            z.writestr(f"{folder}/protein.faa", f">{n}q prot\nMK\nL\n")
        z.writestr("README.md", "no")
    return out.getvalue()


class Datasets(Entrez):
    names = [f"G{i}" for i in range(45)]
    broken: set = set()

    def reply(self, path, query, body, headers):
        if not path.startswith("/genome/"):
            return super().reply(path, query, body, headers)
        if path.endswith("dataset_report"):
            if "/none/" in path:
                return 200, json.dumps({"messages": [{"error": {"message": "no such taxon"}}]}).encode()
            if "/narrow/" in path:
                return 200, b"{}"
            at, n = int(query.get("page_token", ["0"])[0]), int(query["page_size"][0])
            page = {"reports": [{"accession": x, "organism": {"tax_id": 5 if "/lost" in path else 8 + k % 2}} for k, x in list(enumerate(self.names))[at : at + n]]}
            return 200, json.dumps(page | ({"next_page_token": str(at + n)} if at + n < len(self.names) else {})).encode()
        names = path.split("/")[3].split(",")
        if len(names) > 1 and self.broken & set(names):
            return 200, b"not a zip"
        return 200, packed(names)


def test_assemblies_by_pages_and_packages(spark):
    stub = Datasets()
    few = Client(first=0.01, tries=2)
    args = {"client": few, "host": stub.host, "entrez_client": few, "entrez_host": stub.host}
    genomes, loci, proteins, taxa = assemblies.ncbi_genomes(spark, ["some", "more"], **args)
    assert sorted(map(tuple, genomes.where("genome_id = 'G3'").collect())) == [("G3", "G3c", "one two", "ACGT"), ("G3", "G3p", "", "GG")]
    assert genomes.count() == 90 and proteins.count() == 45 and loci.count() == 135
    assert [tuple(r) for r in loci.where("genome_id = 'G44'").orderBy("ord").collect()] == [("G44", 0, "##gff"), ("G44", 1, ""), ("G44", 2, "line")]
    assert [tuple(r) for r in proteins.where("genome_id = 'G9'").collect()] == [("G9", "G9q", "prot", "MKL")]
    got = {r.feature_id: (r.taxon, r.genome_id) for r in taxa.collect()}
    assert len(got) == 90 and got["G1p"] == ("k__Bacteria; p__P; c__P; o__P; f__P; g__Aus; s__bus", "G1")
    pages = [q for p, q, *_ in stub.asked if p.endswith("dataset_report")]
    assert [q.get("page_token") for q in pages] == [None, ["20"], ["40"]] and pages[0]["filters.assembly_level"] == ["complete_genome"]
    sizes = [len(p.split("/")[3].split(",")) for p, *_ in stub.asked if p.endswith("download")]
    assert sorted(sizes) == [5, 20, 20]
    only = assemblies.ncbi_genomes(spark, ["some"], only_genomic=True, **args)[0]
    assert sorted(r.id for r in only.collect()) == sorted(f"{n}c" for n in stub.names)


def test_broken_packages_are_halved(spark):
    stub = Datasets()
    stub.broken = {"G7"}
    few = Client(first=0.01, tries=1)
    genomes, *_ = assemblies.ncbi_genomes(spark, ["some"], client=few, host=stub.host, entrez_client=few, entrez_host=stub.host)
    assert genomes.count() == 90
    assert any(p.split("/")[3] == "G7" for p, *_ in stub.asked if p.endswith("download"))


def test_assemblies_that_are_not_there(spark):
    stub = Datasets()
    few = Client(first=0.01, tries=1)
    args = {"client": few, "host": stub.host, "entrez_client": few, "entrez_host": stub.host}
    for taxon, told in (("none", "no such taxon"), ("narrow", "too narrow")):
        with pytest.raises(Exception, match=told):
            assemblies.ncbi_genomes(spark, [taxon], **args)
    with pytest.raises(ValueError, match="no lineage: G0, G1, G10"):
        assemblies.ncbi_genomes(spark, ["lost"], **args)
    for wrong in ({"assembly_source": "x"}, {"assembly_levels": ("x",)}, {"page_size": 5}):
        with pytest.raises(ValueError):
            assemblies.ncbi_genomes(spark, ["some"], **wrong)


class Bvbrc(Stub):
    tables = {
        "genome": [{"genome_id": f"{i}.1", "taxon_id": str(10 + i % 2), "gc_content": str(i / 2), "genome_name": " " if i == 3 else f'Name "{i}"', "isolate": "NA"} for i in range(11)],
        "genome_sequence": [{"accession": f"acc{i}{k}", "description": f"part {k}", "genome_name": f"Name {i}", "genome_id": f"{i}.1", "sequence": "acgt"[: k + 2]} for i in range(11) for k in range(2)],
        "genome_feature": [{"genome_id": f"{i % 2}.1", "feature_id": f"f{i}", "taxon_id": "10", **({"na_sequence_md5": "m1"} if i % 2 else {"aa_sequence_md5": "m2", "na_sequence_md5": "m3"})} for i in range(6)],
        "feature_sequence": [{"md5": f"m{i}", "sequence": f"ac{'g' * i}"} for i in range(5)],
        "taxonomy": [{"taxon_id": 10, "lineage_names": ["cellular", "Bac", "Phy", "Gen", "Gen spec"], "lineage_ranks": ["no rank", "superkingdom", "phylum", "genus", "species"]}],
    }

    def reply(self, path, query, body, headers):
        name = path.strip("/")
        if "bad_field" in body:
            return 400, b'A Database Error Occured: {"code": 400, "msg": "undefined field bad_field"}'
        if "bad_op" in body:
            return 400, b'A Database Error Occured: {"code": 400, "msg": "undefined field object"}'
        if "broken" in body:
            return 404, b"gone"
        if headers["Accept"] == "application/gff":
            return 200, f"##gff-version 3\naccn|{body[13:16]}\tx\n".encode()
        rows = self.tables[name]
        parts = body.split("&")
        if parts[0].startswith("in("):
            field, _, listed = parts[0][3:-2].partition(",(")
            wanted = {urllib.parse.unquote(x).strip('"') for x in listed.split(",")}
            rows = [r for r in rows if str(r.get(field)) in wanted]
        size, start = (int(x) for x in parts[1][6:-1].split(","))
        fields = parts[2][7:-1].split(",") if len(parts) > 2 else list(rows[0]) if rows else []
        if not rows:
            return 400, b"[]"
        rows = rows[start : start + size]
        if headers["Accept"] == "text/tsv":
            quoted = lambda v: '"' + v.replace('"', '""') + '"' if '"' in v else v
            lines = ["\t".join(fields), *("\t".join(quoted(str(r.get(f, ""))) for f in fields) for r in rows)]
            return 200, ("\n".join(lines) + "\n").encode()
        return 200, json.dumps([{f: r[f] for f in fields if f in r} for r in rows]).encode()


@pytest.fixture
def bv():
    s = Bvbrc()
    yield s
    s.server.shutdown()


def test_tables_by_strided_pages_with_types(spark, bv):
    got = bvbrc.metadata(spark, "genome", "eq(x,y)", client=FAST, host=bv.host, page=2)
    assert dict(got.dtypes) == {"genome_id": "string", "taxon_id": "string", "gc_content": "double", "genome_name": "string", "isolate": "string"}
    rows = {r.genome_id: r for r in got.collect()}
    assert len(rows) == 11 and rows["3.1"].genome_name is None and rows["4.1"].genome_name == 'Name "4"' and rows["5.1"].gc_content == 2.5 and rows["1.1"].isolate is None
    starts = sorted(int(b.split("limit(2,")[1].split(")")[0]) for _, _, b, _ in bv.asked if "limit(2," in b)
    assert starts == [0, 2, 4, 6, 8, 10, 12, 14]  # each page once, and one past the end a partition


def test_genomes_with_lineages(spark, bv):
    seqs, taxa = bvbrc.genomes(spark, data_field="genome_id", ids=["0.1", "2.1", "1.1"], client=FAST, host=bv.host, page=2)
    assert sorted(r.id for r in seqs.collect()) == ["acc00", "acc01", "acc10", "acc11", "acc20", "acc21"]
    row = seqs.where("id = 'acc21'").first()
    assert (row.genome_id, row.seq, row.description) == ("2.1", "ACG", "  part 1   [Name 2 | 2.1]")
    want = "k__; p__Phy; c__Phy; o__Phy; f__Phy; g__Gen; s__spec"
    assert sorted(map(tuple, taxa.collect())) == [(a, want) for a in ("acc00", "acc01", "acc20", "acc21")]  # taxon 11 is unknown


def test_features_with_their_loci(spark, bv):
    genes, proteins, taxa, gff = bvbrc.genome_features(spark, "eq(a,b)", client=FAST, host=bv.host)
    assert sorted((r.feature_id, r.seq) for r in genes.collect()) == [("f0", "ACGGG"), ("f1", "ACG"), ("f2", "ACGGG"), ("f3", "ACG"), ("f4", "ACGGG"), ("f5", "ACG")]
    assert sorted((r.feature_id, r.seq) for r in proteins.collect()) == [("f0", "ACGG"), ("f2", "ACGG"), ("f4", "ACGG")]
    assert taxa.count() == 6
    assert sorted(map(tuple, gff.collect())) == [("0.1", 0, "##gff-version 3"), ("0.1", 1, "0.1\tx"), ("1.1", 0, "##gff-version 3"), ("1.1", 1, "1.1\tx")]


def test_what_a_refusal_is_about(spark, bv):
    ask = lambda q: bvbrc.ask(FAST, "genome", q, "text/tsv", bvbrc._tsv, bv.host)
    for query, kind in (("bad_field&limit(1,0)", bvbrc.UnknownField), ("bad_op&limit(1,0)", bvbrc.UnknownOperator), ("broken", ValueError), ("in(genome_id,(no))&limit(1,0)", bvbrc.NoData)):
        with pytest.raises(kind):
            ask(query)
    with pytest.raises(Exception, match="no data"):
        bvbrc.metadata(spark, "genome", data_field="genome_id", ids=["none"], client=FAST, host=bv.host).collect()
    with pytest.raises(ValueError):
        bvbrc.metadata(spark, "nothing", "x", client=FAST, host=bv.host)


def test_client_gives_up_on_other_statuses(bv):
    with pytest.raises(web.Refused) as error:
        FAST.ask(f"{bv.host}/genome/", len, b"broken")
    assert error.value.status == 404 and error.value.text == "gone"
