"""Addresses of the files of public releases, and requests for records. Nothing here
needs a network but fetch(), which lands files where Spark reads them."""

from __future__ import annotations

import hashlib
import json
import random
import shutil
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from pathlib import Path

from cladeforge.schema import check_choice, check_range, check_subset

#: Targets of the SILVA versions, and parts of their file names.
SILVA_TARGETS = {
    "128": ("SSURef_NR99", "SSURef", "LSURef"),
    "132": ("SSURef_NR99", "SSURef", "LSURef"),
    "138": ("SSURef_NR99", "SSURef"),
    "138.1": ("SSURef_NR99", "SSURef", "LSURef_NR99", "LSURef"),
    "138.2": ("SSURef_NR99", "SSURef", "LSURef_NR99", "LSURef"),
}
SILVA_MAPS = {"SSURef_NR99": "ssu_ref_nr", "SSURef": "ssu_ref", "LSURef_NR99": "lsu_ref_nr", "LSURef": "lsu_ref"}
SILVA_HOST = "https://www.arb-silva.de/fileadmin/silva_databases"
#: GTDB versions, marker sets, hosts.
GTDB_VERSIONS = ("202.0", "207.0", "214.0", "214.1", "220.0", "226.0", "232.0")
#: The GTDB versions whose files are plain FASTA.
GTDB_FNA_VERSIONS = ("220.0", "226.0", "232.0")
GTDB_HOSTS = {
    "Primary": "https://data.gtdb.ecogenomic.org/releases",
    "Mirror": "https://data.ace.uq.edu.au/public/gtdb/data/releases",
}
#: UNITE identifiers by version and group, without and with singletons.
UNITE_DOIS = {
    "2025-02-19": {"fungi": ("10.15156/BIO/3301241", "10.15156/BIO/3301242"), "eukaryotes": ("10.15156/BIO/3301243", "10.15156/BIO/3301244")},
    "2024-04-04": {"fungi": ("10.15156/BIO/2959336", "10.15156/BIO/2959337"), "eukaryotes": ("10.15156/BIO/2959338", "10.15156/BIO/2959339")},
    "2023-07-18": {"fungi": ("10.15156/BIO/2938079", "10.15156/BIO/2938080"), "eukaryotes": ("10.15156/BIO/2938081", "10.15156/BIO/2938082")},
    "2022-10-16": {"fungi": ("10.15156/BIO/2483915", "10.15156/BIO/2483916"), "eukaryotes": ("10.15156/BIO/2483917", "10.15156/BIO/2483918")},
    "2021-05-10": {"fungi": ("10.15156/BIO/1264708", "10.15156/BIO/1264763"), "eukaryotes": ("10.15156/BIO/1264819", "10.15156/BIO/1264861")},
    "2020-02-20": {"fungi": ("10.15156/BIO/786385", "10.15156/BIO/786387"), "eukaryotes": ("10.15156/BIO/786386", "10.15156/BIO/786388")},
}
UNITE_API = "https://api.plutof.ut.ee/v1/public/dois/?format=vnd.api%2Bjson&identifier="
#: PR2 release folders and file stems.
PR2_FILES = {
    "5.0.0": "v5.0.0/pr2_version_5.0.0_SSU_mothur",
    "5.1.0": "v5.1.0.0/pr2_version_5.1.0_SSU_mothur",
    "5.1.1": "v5.1.1/pr2_version_5.1.1_SSU_mothur",
}
PR2_HOST = "https://github.com/pr2database/pr2database/releases/download"
#: Genes of MIDORI2 and Eukaryome.
MITO_GENES = ("A6", "A8", "CO1", "CO2", "CO3", "Cytb", "ND1", "ND2", "ND3", "ND4L", "ND4", "ND5", "ND6", "lrRNA", "srRNA")
RRNA_GENES = ("SSU", "LSU", "ITS", "longread")
#: Addresses of the services.
MIDORI2_HOST = "https://www.reference-midori.info/download/Databases"
EUKARYOME_HOST = "https://sisu.ut.ee/wp-content/uploads/sites/643"
ENTREZ_HOST = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils"
BVBRC_HOST = "https://www.bv-brc.org/api"


def silva_urls(version: str = "138.2", target: str = "SSURef_NR99", download_sequences: bool = True) -> dict[str, str]:
    check_choice("version", version, SILVA_TARGETS)
    check_choice("target", target, SILVA_TARGETS[version])
    exports = f"{SILVA_HOST}/release_{version.replace('.', '_')}/Exports"
    packed = ".gz" if version.startswith("138") else ""
    name = target if packed else target.replace("NR99", "Nr99")
    corrected = "-corrected" if (version, target) == ("132", "SSURef") else ""
    taxa = f"{exports}/taxonomy/tax_slv_{SILVA_MAPS[target][:3]}_{version}"
    urls = {"sequences": f"{exports}/SILVA_{version}_{name}_tax_silva.fasta.gz"} if download_sequences else {}
    return urls | {
        "taxonomy map": f"{exports}/taxonomy/taxmap_slv_{SILVA_MAPS[target]}_{version}{corrected}.txt.gz",
        "taxonomy tree": f"{taxa}.tre{packed}",
        "taxonomy ranks": f"{taxa}.txt{packed}",
    }


def gtdb_urls(version: str = "232.0", domain: str = "Both", db_type: str = "SpeciesReps", url_type: str = "Primary") -> dict[str, str]:
    check_choice("version", version, GTDB_VERSIONS)
    check_choice("domain", domain, ("Both", "Bacteria", "Archaea"))
    check_choice("db_type", db_type, ("SpeciesReps", "All"))
    check_choice("url_type", url_type, GTDB_HOSTS)
    release = version.split(".")[0]
    folder = f"{GTDB_HOSTS[url_type]}/release{release}/{version}"
    ending = f"r{release}.{'fna' if version in GTDB_FNA_VERSIONS else 'tar'}.gz"
    if db_type == "All":
        return {"All": f"{folder}/genomic_files_all/ssu_all_{ending}"}
    markers = {"Archaea": "ar122" if version == "202.0" else "ar53", "Bacteria": "bac120"}
    return {d: f"{folder}/genomic_files_reps/{m}_ssu_reps_{ending}" for d, m in markers.items() if domain in ("Both", d)}


def unite_query(version: str = "2025-02-19", taxon_group: str = "eukaryotes", singletons: bool = False) -> str:
    """Address of the record that names the file."""
    check_choice("version", version, UNITE_DOIS)
    check_choice("taxon_group", taxon_group, UNITE_DOIS[version])
    return f"{UNITE_API}{UNITE_DOIS[version][taxon_group][singletons]}"


def unite_file(record: str) -> str:
    """Address of the newest file in a record."""
    return json.loads(record)["data"][0]["attributes"]["media"][-1]["url"]


def unite_member(name: str, cluster_id: str = "99") -> bool:
    """Whether a member of the archive holds the developer files of a clustering."""
    check_choice("cluster_id", cluster_id, ("97", "99", "dynamic"))
    stem = Path(name).name
    return "_dev" in stem and stem.split("_")[4:5] == [cluster_id]


def pr2_urls(version: str = "5.1.1") -> dict[str, str]:
    check_choice("version", version, PR2_FILES)
    return {kind: f"{PR2_HOST}/{PR2_FILES[version]}.{kind}.gz" for kind in ("fasta", "tax")}


def _genes(wanted: list[str], known: tuple[str, ...]) -> list[str]:
    check_subset("gene", wanted, (*known, "all"))
    return list(known) if "all" in wanted else wanted


def midori2_urls(genes: list[str], version: str = "GenBank267_2025-06-19", ref_seq_type: str = "uniq", unspecified_species: bool = False):
    """By gene the addresses of sequences and lineages."""
    check_choice("ref_seq_type", ref_seq_type, ("uniq", "longest"))
    number = version.removeprefix("GenBank").split("_")[0]
    folder, mark = ("QIIME_sp", "SP_") if unspecified_species else ("QIIME", "")
    stem = f"{MIDORI2_HOST}/{version}/{folder}/{ref_seq_type}/MIDORI2_{ref_seq_type.upper()}_NUC_{mark}GB{number}"
    return {g: {k: f"{stem}_{g}_QIIME.{k}.gz" for k in ("fasta", "taxon")} for g in _genes(genes, MITO_GENES)}


def eukaryome_urls(genes: list[str], version: str = "2.0") -> dict[str, str]:
    return {g: f"{EUKARYOME_HOST}/General_EUK_{g}_v{version}.zip" for g in _genes(genes, RRNA_GENES)}


def entrez_chunks(count: int, size: int = 5000) -> list[tuple[int, int]]:
    """Start and number of the records of each request."""
    return [(start, min(size, count - start)) for start in range(0, count, size)]


def entrez_fetch_url(database: str, web_env: str, query_key: str, start: int, size: int = 5000) -> str:
    check_choice("database", database, ("nuccore", "protein", "taxonomy"))
    given = {"db": database, "WebEnv": web_env, "query_key": query_key, "retstart": start, "retmax": size, "retmode": "xml"}
    return f"{ENTREZ_HOST}/efetch.fcgi?{urllib.parse.urlencode(given | ({} if database == 'taxonomy' else {'rettype': 'fasta'}))}"


def bvbrc_query(rql_query: str | None = None, data_field: str | None = None, ids: list[str] | None = None, fields: set[str] | None = None) -> str:
    """The query: as given, or that a field is among ids, each quoted and percent-encoded."""
    if (rql_query is None) == (ids is None):
        raise ValueError("give either rql_query or data_field and ids")
    if rql_query is not None:
        return rql_query
    if data_field is None or not ids:
        raise ValueError("data_field and ids are needed together")
    if fields is not None:
        check_choice("data_field", data_field, sorted(fields))
    quoted = ",".join(urllib.parse.quote(f'"{i}"') for i in ids)
    return f"in({data_field},({quoted}))"


def bvbrc_pages(query: str, size: int = 25_000) -> Iterator[str]:
    """The query for page after page; the caller stops at a page that is not full."""
    start = 0
    while True:
        yield f"{query}&limit({size},{start})"
        start += size


def delays(tries: int = 10, most: float = 120, first: float = 0.5) -> list[float]:
    """Seconds to wait before each retry, doubling up to the most."""
    check_range("tries", tries, 1)
    return [min(most, first * 2**i) for i in range(tries - 1)]


RETRYABLE = (400, 403, 408, 425, 429, 500, 502, 503, 504)


def fetch(url: str, target: str, md5: str | None = None, tries: int = 10, get: Callable = urllib.request.urlopen, sleep: Callable = time.sleep) -> str:
    """Lands a file, retrying with growing delays; raises if its digest is another."""
    for wait in [*delays(tries), None]:
        try:
            with get(url, timeout=10) as source, open(target, "wb") as out:
                shutil.copyfileobj(source, out)
            break
        except (urllib.error.URLError, TimeoutError) as error:
            if wait is None or isinstance(error, urllib.error.HTTPError) and error.code not in RETRYABLE:
                raise
            sleep(wait * (1 + random.random() / 10))
    if md5 is not None:
        digest = hashlib.md5()
        with open(target, "rb") as landed:
            while block := landed.read(1 << 20):
                digest.update(block)
        if digest.hexdigest() != md5:
            raise ValueError(f"the file of {url} is damaged")
    return target


def fetch_checked(url: str, target: str, **options) -> str:
    """Lands a file and checks it against the digest in the file beside it, whose name ends
    in .md5 (a line: the digest, blanks, a name). options go to fetch()."""
    with open(fetch(f"{url}.md5", f"{target}.md5", **options)) as beside:
        words = beside.read().split()
    if not words:
        raise ValueError(f"no digest in {url}.md5")
    return fetch(url, target, md5=words[0], **options)
