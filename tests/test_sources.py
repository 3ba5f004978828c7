import gzip
import io
import re
import urllib.error

import pytest
from pyspark.sql import functions as F

from cladeforge.operators import evaluate
from cladeforge.functions.patterns import java_literal, java_regex, java_template
from cladeforge.schema import check_choice, check_range, check_subset, handles
from cladeforge.sources import files, releases
from cladeforge.streaming import stateless


def test_fasta_round_trip(spark, tmp_path):
    text = ">s1 first one\r\nACGT\r\nacg\n>s2\nGG\n\n>s3 x\n"
    (tmp_path / "a.fasta").write_text(text)
    with gzip.open(tmp_path / "b.fasta.gz", "wt") as f:
        f.write(text)
    for name in ("a.fasta", "b.fasta.gz"):
        rows = files.read_fasta(spark, str(tmp_path / name)).orderBy("ord").collect()
        assert [tuple(r)[:3] for r in rows] == [("s1", "first one", "ACGTacg"), ("s2", "", "GG"), ("s3", "x", "")]
    df = files.read_fasta(spark, str(tmp_path / "a.fasta"), upper=True)
    files.write_fasta(df, str(tmp_path / "out"))
    again = files.read_fasta(spark, str(tmp_path / "out"))
    assert sorted(tuple(r)[:3] for r in again.collect()) == [("s1", "first one", "ACGTACG"), ("s2", "", "GG"), ("s3", "x", "")]
    files.write_fasta(df.withColumn("genome_id", df.id), str(tmp_path / "by"), by_genome=True)
    assert (tmp_path / "by" / "genome_id=s1").is_dir()


def test_taxonomy_files(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("Feature ID\tTaxon\tConfidence\n0012\td__A; p__B\t0.5\n")
    df = files.read_taxonomy(spark, str(tmp_path / "t.tsv"))
    assert tuple(df.first()) == ("0012", "d__A; p__B", "0.5")
    files.write_taxonomy(df, str(tmp_path / "o"))
    assert files.read_taxonomy(spark, str(tmp_path / "o")).first().feature_id == "0012"
    (tmp_path / "n.tsv").write_text("x\ta;b\n")
    assert tuple(files.read_taxonomy(spark, str(tmp_path / "n.tsv"), header=False).first()) == ("x", "a;b")
    (tmp_path / "r.tsv").write_text("id\treplacements\nab\tcd\nxy\t\n")
    assert files.read_replacements(spark, str(tmp_path / "r.tsv")) == {"ab": "cd", "xy": ""}


def test_silva_files(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("primaryAccession\tstart\tstop\tpath\torganismName\ttaxid\nA\t1\t2\tp;\torg\t7\n")
    assert files.read_silva_map(spark, str(tmp_path / "m.tsv")).first().organism_name == "org"
    (tmp_path / "bad.tsv").write_text("a\tb\n1\t2\n")
    with pytest.raises(ValueError, match="lacks"):
        files.read_silva_map(spark, str(tmp_path / "bad.tsv"))
    (tmp_path / "k.tsv").write_text("A;\t2\tdomain\t\t\n")
    assert files.read_silva_ranks(spark, str(tmp_path / "k.tsv")).first().rank == "domain"


MAP_HEADER = "primaryAccession\tstart\tstop\tpath\torganism_name\ttaxid\n"


@pytest.mark.parametrize("line", ["A\t1\t2\tp;\torg", "A\t1\t2\tp;\torg\t7\t8", "A\t1\t2\tp\torg\t7", "A\t1\t2\tp;\torg\tx"])
def test_silva_map_lines_are_checked(spark, tmp_path, line):
    (tmp_path / "m.tsv").write_text(MAP_HEADER + "B\t1\t2\tp;\t\t7\n" + line + "\n")
    with pytest.raises(Exception, match="not 6 fields|no lineage|no number"):
        files.read_silva_map(spark, str(tmp_path / "m.tsv")).select("primaryAccession").collect()


def test_silva_files_of_another_shape(spark, tmp_path):
    for name, text, read, told in (
        ("empty.tsv", "", files.read_silva_ranks, "without records"),
        ("head.tsv", MAP_HEADER, files.read_silva_map, "without records"),
        ("more.tsv", "x\t" + MAP_HEADER, files.read_silva_map, "its header"),
    ):
        (tmp_path / name).write_text(text)
        with pytest.raises(ValueError, match=told):
            read(spark, str(tmp_path / name))
    for i, line in enumerate(["A;\t2\tdomain\t", "A\t2\tdomain\t\t", "A;\ttwo\tdomain\t\t"]):
        (tmp_path / f"k{i}.tsv").write_text(f"A;B;\t3\tphylum\t\t138\n{line}\n")
        with pytest.raises(Exception, match="not 5 fields|no lineage|no number"):
            files.read_silva_ranks(spark, str(tmp_path / f"k{i}.tsv")).collect()


def test_metadata_and_loci(spark, tmp_path):
    files.write_metadata(spark.createDataFrame([("a", 1.5, None)], "genome string, x double, y string").coalesce(1), str(tmp_path / "m"))
    (part,) = (tmp_path / "m").glob("*.csv")
    assert part.read_text() == "id\tx\ty\na\t1.5\t\n"
    rows = [("g1", 2, "b\tc"), ("g2", 1, "z"), ("g1", 1, "##gff-version 3")]
    files.write_loci(spark.createDataFrame(rows, "genome_id string, ord long, value string"), str(tmp_path / "l"))
    (part,) = (tmp_path / "l" / "genome_id=g1").glob("*.txt")
    assert part.read_text() == "##gff-version 3\nb\tc\n"


def test_results_are_numbered_and_labels_told(spark):
    levels = spark.createDataFrame([(2, "b"), (1, "b"), (1, "a")], "level int, dataset string")
    assert [tuple(r) for r in evaluate.numbered(levels, "dataset", "level").collect()] == [("1", 1, "a"), ("2", 1, "b"), ("3", 2, "b")]
    taxa = spark.createDataFrame([("f", "a;b")], "feature_id string, taxon string")
    with pytest.warns(UserWarning, match="2 tables and 1 labels"):
        evaluate.evaluate_taxonomy([taxa, taxa], ["one"])


def test_digest_beside_a_file(tmp_path):
    held = {"u": b"data", "u.md5": b"8d777f385d3dfec8815d20f7496026dc  f\n", "v": b"data", "v.md5": b"0  f\n"}
    get = lambda url, timeout: io.BytesIO(held[url])
    assert releases.fetch_checked("u", str(tmp_path / "f"), get=get) == str(tmp_path / "f")
    with pytest.raises(ValueError, match="damaged"):
        releases.fetch_checked("v", str(tmp_path / "f"), get=get)


def test_fastq(spark, tmp_path):
    with gzip.open(tmp_path / "r.fastq.gz", "wt") as f:
        f.write("@r1 a\nACGT\n+\nIIII\n@r2\nGG\n+\nJJ\n")
    df = files.read_fastq(spark, str(tmp_path / "r.fastq.gz"), "s", "forward")
    assert [tuple(r)[2:] for r in df.orderBy("read_no").collect()] == [(0, "r1 a", "ACGT", "IIII"), (1, "r2", "GG", "JJ")]
    files.write_fastq(df, str(tmp_path / "out"))
    (part,) = (tmp_path / "out" / "sample_id=s" / "direction=forward").glob("*.gz")
    assert gzip.open(part, "rt").read() == "@r1 a\nACGT\n+\nIIII\n@r2\nGG\n+\nJJ\n"
    (tmp_path / "MANIFEST").write_text("# direction is not meaningful\nsample-id,filename,direction\ns,r.fastq.gz,forward\n")
    assert tuple(files.read_manifest(spark, str(tmp_path / "MANIFEST")).first()) == ("s", "r.fastq.gz", "forward")


def test_newick():
    edges = files.newick_edges("((3:0.1,'4')2:1,5)1;")
    assert set(edges) == {("3", "2"), ("4", "2"), ("2", "1"), ("5", "1"), ("1", None)}


def test_ncbi_xml(spark, tmp_path):
    (tmp_path / "t.xml").write_text(
        "<TaxaSet><Taxon><TaxId>9</TaxId><ScientificName>Gen sp</ScientificName><Division>Bacteria</Division>"
        "<AkaTaxIds><TaxId>8</TaxId></AkaTaxIds><LineageEx><Taxon><TaxId>2</TaxId><ScientificName>P</ScientificName>"
        "<Rank>phylum</Rank></Taxon></LineageEx></Taxon></TaxaSet>"
    )
    r = files.read_ncbi_taxa(spark, str(tmp_path / "t.xml")).first()
    assert (r.taxid, r.organism, r.division, r.aka, r.lineage[0].name) == ("9", "Gen sp", "Bacteria", ["8"], "P")


def test_release_addresses():
    urls = releases.silva_urls("132", "SSURef")
    assert urls["taxonomy map"].endswith("release_132/Exports/taxonomy/taxmap_slv_ssu_ref_132-corrected.txt.gz")
    assert urls["taxonomy tree"].endswith("tax_slv_ssu_132.tre")
    assert releases.silva_urls("128")["sequences"].endswith("SILVA_128_SSURef_Nr99_tax_silva.fasta.gz")
    assert releases.silva_urls("138.1", "LSURef_NR99", False)["taxonomy ranks"].endswith("release_138_1/Exports/taxonomy/tax_slv_lsu_138.1.txt.gz")
    assert list(releases.gtdb_urls("202.0", "Archaea").values()) == [
        "https://data.gtdb.ecogenomic.org/releases/release202/202.0/genomic_files_reps/ar122_ssu_reps_r202.tar.gz"
    ]
    assert releases.gtdb_urls(db_type="All", url_type="Mirror")["All"].endswith("release232/232.0/genomic_files_all/ssu_all_r232.fna.gz")
    assert releases.unite_query("2020-02-20", "fungi", True).endswith("10.15156/BIO/786387")
    assert releases.unite_member("sh_refs_qiime_ver10_99_19.02.2025_dev.fasta") and not releases.unite_member("sh_refs_qiime_ver10_97_19.02.2025_dev.fasta")
    assert releases.pr2_urls("5.1.0")["tax"].endswith("v5.1.0.0/pr2_version_5.1.0_SSU_mothur.tax.gz")
    midori = releases.midori2_urls(["CO1"], unspecified_species=True)
    assert midori["CO1"]["taxon"].endswith("QIIME_sp/uniq/MIDORI2_UNIQ_NUC_SP_GB267_CO1_QIIME.taxon.gz")
    assert len(releases.midori2_urls(["all"])) == 15 == len(releases.midori2_urls(["all"]))
    assert releases.eukaryome_urls(["SSU"])["SSU"].endswith("General_EUK_SSU_v2.0.zip")
    for bad in (lambda: releases.silva_urls("138", "LSURef"), lambda: releases.midori2_urls(["x"]), lambda: releases.gtdb_urls("1")):
        with pytest.raises(ValueError):
            bad()


def test_record_requests():
    assert releases.entrez_chunks(12_000) == [(0, 5000), (5000, 5000), (10_000, 2000)]
    assert "retstart=5000" in releases.entrez_fetch_url("protein", "w", "1", 5000)
    assert releases.bvbrc_query(data_field="genome_id", ids=["1.2", "a b"], fields={"genome_id"}) == "in(genome_id,(%221.2%22,%22a%20b%22))"
    pages = releases.bvbrc_pages("eq(a,b)", 10)
    assert [next(pages), next(pages)] == ["eq(a,b)&limit(10,0)", "eq(a,b)&limit(10,10)"]
    for bad in ({}, {"rql_query": "x", "ids": ["1"]}, {"ids": ["1"]}, {"ids": ["1"], "data_field": "z", "fields": {"y"}}):
        with pytest.raises(ValueError):
            releases.bvbrc_query(**bad)


def test_fetch_retries_and_checks(tmp_path):
    tries, waits = [], []

    def get(url, timeout):
        tries.append(url)
        if len(tries) < 3:
            raise urllib.error.URLError("down")
        return io.BytesIO(b"data")

    releases.fetch("u", str(tmp_path / "f"), md5="8d777f385d3dfec8815d20f7496026dc", get=get, sleep=waits.append)
    assert (tmp_path / "f").read_bytes() == b"data" and len(waits) == 2 and waits[1] > waits[0]
    with pytest.raises(ValueError, match="damaged"):
        releases.fetch("u", str(tmp_path / "f"), md5="0", get=get)
    assert releases.delays()[-1] == 120


def test_patterns_and_checks():
    assert java_regex("(?P<a>x)(?P=a)") == "(?<a>x)\\k<a>"
    assert java_template(r"a$\1\\", 1) == "a\\$$1\\\\"
    assert java_literal("a.b") == "\\Qa.b\\E"
    for bad in (lambda: java_template(r"\2", 1), lambda: check_choice("x", "a", ["b"]), lambda: check_range("x", 0, 0, 1, open_low=True), lambda: check_subset("x", ["q"], ["a"])):
        with pytest.raises(ValueError):
            bad()
    assert handles(["species", "domain"]) == ["d__", "s__"] and handles(["disable"]) == []


PATTERNS = [
    r"\d+", r"[^\d_]+", r"\bé\w*", r"\Bb", r"a.c", r"(?s)a.c", r"c$", r"(?m)^b$", r"c\Z", r"\A\W", r"[\W\d]+", r"[^\W\d]{2,3}?", r"(?i)É", r"(?ai)k",
    r"(?P<one_x>[ab])(?P=one_x)", r"(?P<two>.)\1", r"(?:a|bc|)d", r"(?<=a)b(?!c)", r"(?<!\s)b", r"a(?i:B)c", r"(?i)a(?-i:b)c", r"[]\[&&^-]+", r"[a-c&&b]", r"(?>a+)b",
    r"a*+b", r"\s+", r"(?a:\s\w)", r"(?x) a  # first\n b", r"x{2}", "#|\\.", r"\$\{", r"[[:alpha:]]+", r"(a)(b)?\1", r"(?!)x|\u00e9",
]
TEXTS = ["", "abc", "aabbcc", "a\nb\nc", "a\nb\nc\n", "a\rc", "a\x85c", "éa ébc", "É ä_9", "٣4 five", "K k", "ABC aBc", "x]^&[-", "b&a", "bcd d", "xx#.${y}", "\u2003\x1c z", "[:al:]", "😀a😀"]


def test_patterns_mean_what_python_means(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "x string").coalesce(1)
    columns = [F.regexp_replace("x", java_regex(p), "<>").alias(f"c{i}") for i, p in enumerate(PATTERNS)]
    for row in df.select("x", *columns).collect():
        for i, p in enumerate(PATTERNS):
            assert row[f"c{i}"] == re.sub(p, "<>", row.x), (p, row.x)


def test_patterns_without_an_equal():
    for bad in (r"(a)?(?(1)b|c)", "(", r"(?P<a>x"):
        with pytest.raises(ValueError):
            java_regex(bad)
    assert java_template(r"\g<one_x>-\g<two>", 2, {"one_x": 1, "two": 2}) == "$1-${two}"
    with pytest.raises(ValueError):
        java_template(r"\g<three>", 2, {"one_x": 1, "two": 2})


def test_streams(spark, tmp_path):
    rows = [("a", "", "AC-GU"), ("b", "", "A" * 20), ("c", "", "--")]
    df = spark.createDataFrame(rows, "id string, description string, seq string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = stateless.write(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(60)
    want = sorted(map(tuple, stateless.curated(df).collect()))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == want == [("a", "", "ACGT")]
