import gzip
import io
import json
import tarfile
import zipfile

import pytest

from cladeforge.operators import lineages
from cladeforge.sources import archives, files, landed

FASTA = ">a;k__X;p__Y some\nACG\nT\n>b;k__Z\nGG-a\n"


def tar(path, files_by_name, mode="w:gz"):
    with tarfile.open(path, mode) as out:
        for name, text in files_by_name.items():
            info = tarfile.TarInfo(name)
            info.size = len(text.encode())
            out.addfile(info, io.BytesIO(text.encode()))
    return str(path)


def zipped(path, files_by_name):
    with zipfile.ZipFile(path, "w") as out:
        for name, text in files_by_name.items():
            out.writestr(name, text)
    return str(path)


def rows(df):
    return sorted(map(tuple, df.drop("ord").collect()), key=str)


def test_members_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "READ", 3)
    path = tar(tmp_path / "x.tar", {"d/one.txt": "a\nbb\n\nccc", "d/two.bin": "z"}, "w")
    got = archives.members(spark, path, "*.txt").orderBy("ord").collect()
    assert [(r.member, r.ord, r.value) for r in got] == [("d/one.txt", i, v) for i, v in enumerate(["a", "bb", "", "ccc"])]


@pytest.mark.parametrize("size", [1, 2, 3, 50])
@pytest.mark.parametrize("separator", ["\n", "\n>", "ab"])
def test_pieces_over_the_edges_of_blocks(monkeypatch, size, separator):
    monkeypatch.setattr(archives, "READ", size)
    for text in ("", "é", ">a\nab\n>b\n\n>", "abaab\n", "\n>", "aab\n\n>é>\nabb"):
        want = text.split(separator)
        assert list(archives._pieces(io.BytesIO(text.encode()), separator)) == (want if want[-1] else want[:-1])


def test_members_of_a_zip_archive_are_dealt_to_tasks(tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "TASK", 10)
    path = zipped(tmp_path / "x y.zip", {"a.txt": "1234", "b.txt": "123456", "c.txt": "1", "d.bin": "1", "e.txt": "x" * 50, "f/": "", "g.txt": ""})
    reader = archives._Reader({"archives": json.dumps([f"file://{path.replace(' ', '%20')}"]), "names": "*.txt"})
    planned = reader.partitions()
    assert [p.names for p in planned] == [["a.txt", "b.txt"], ["c.txt"], ["e.txt"], ["g.txt"]]
    assert [[(r["member"], r["ord"]) for b in reader.read(p) for r in b.to_pylist()] for p in planned] == [[("a.txt", 0), ("b.txt", 0)], [("c.txt", 0)], [("e.txt", 0)], []]


@pytest.mark.parametrize("mode", ["w", "w:gz", "w:bz2", "w:xz"])
def test_tar_archives_stream(tmp_path, mode):
    path = tar(tmp_path / "x.tar", {"a.txt": "é\nb\n", "n/c.txt": "\n", "d.bin": "1"}, mode)
    reader = archives._Reader({"archives": json.dumps([path]), "names": "*.txt"})
    (whole,) = reader.partitions()
    assert [(r["member"], r["ord"], r["value"]) for b in reader.read(whole) for r in b.to_pylist()] == [("a.txt", 0, "é"), ("a.txt", 1, "b"), ("n/c.txt", 0, "")]


def test_archives_by_pattern(spark, tmp_path):
    for i in range(3):
        zipped(tmp_path / f"p {i}.zip", {f"m{i}.txt": f"{i}\n{i}"})
    got = archives.members(spark, f"{tmp_path}/p*.zip").groupBy("member").count().collect()
    assert sorted(map(tuple, got)) == [("m0.txt", 2), ("m1.txt", 2), ("m2.txt", 2)]
    with pytest.raises(FileNotFoundError):
        archives.members(spark, f"{tmp_path}/none*.zip")
    zipped(tmp_path / "none.zip", {})
    assert archives.members(spark, f"{tmp_path}/none.zip").count() == 0


def test_gtdb_joins_domains(spark, tmp_path):
    packed = tar(tmp_path / "ar53_ssu_reps_r214.tar.gz", {"ar53_ssu_reps_r214.fna": ">g1 d__A;s__B [x=1]\nAC\nGT\n"})
    plain = tmp_path / "bac120_ssu_reps_r226.fna.gz"
    plain.write_bytes(gzip.compress(b">g2 d__B;s__C c [y]\nTT\n"))
    seqs, taxa = landed.gtdb(spark, [packed, str(plain)])
    assert rows(seqs.select("id", "seq")) == [("g1", "ACGT"), ("g2", "TT")]
    assert rows(taxa) == [("g1", "d__A;s__B"), ("g2", "d__B;s__C c")]


def test_unite_picks_developer_files_of_a_clustering(spark, tmp_path):
    stem = "sh_{}_qiime_ver10_{}_19.02.2025_dev"
    names = {f"dev/{stem.format(k, c)}.{e}": t for c in ("97", "99") for k, e, t in (("refs", "fasta", f">x{c} y\nacGt\n"), ("taxonomy", "txt", f"Feature ID\tTaxon\nx{c}\tk__F;p__{c}\n"))}
    path = tar(tmp_path / "u.tgz", names | {"sh_refs_qiime_ver10_99_19.02.2025.fasta": ">no\nA\n"})
    seqs, taxa = landed.unite(spark, path, "99")
    assert rows(seqs.select("id", "seq")) == [("x99", "ACGT")] and rows(taxa) == [("x99", "k__F;p__99")]
    with pytest.raises(ValueError):
        landed.unite(spark, path, "dynamic")


def test_pr2_needs_nine_labels(spark, tmp_path):
    (tmp_path / "a.tax").write_text("x\t" + ";".join("abcdefghi") + ";\n")
    (tmp_path / "b.tax").write_text("y\ta;b;\n")
    (tmp_path / "a.fasta").write_text(">x\nAC\n")
    _, taxa = landed.pr2(spark, str(tmp_path / "a.fasta"), str(tmp_path / "a.tax"), ["species", "domain"])
    assert rows(taxa) == [("x", "d__a;s__i")]
    with pytest.raises(ValueError, match="y"):
        landed.pr2(spark, str(tmp_path / "a.fasta"), str(tmp_path / "b.tax"))


def test_midori2_and_eukaryome_by_gene(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">x\nAC\n")
    (tmp_path / "a.taxon").write_text("x\tk__A\n")
    got = landed.midori2(spark, {"CO1": {"fasta": str(tmp_path / "a.fasta"), "taxon": str(tmp_path / "a.taxon")}})
    assert rows(got["CO1"][1]) == [("x", "k__A")]
    path = zipped(tmp_path / "General_EUK_SSU_v2.0.zip", {"General_EUK_SSU_v2.0.fasta": FASTA, "read.me": "x"})
    seqs, taxa = landed.eukaryome(spark, {"SSU": path})["SSU"]
    assert rows(seqs.select("id", "seq")) == [("a", "ACGT"), ("b", "GG-a")] and rows(taxa) == [("a", "k__X;p__Y some"), ("b", "k__Z")]
    with pytest.raises(ValueError):
        landed.eukaryome(spark, {"ITS": zipped(tmp_path / "General_EUK_ITS_v2.0.zip", {"other": "x"})})


def test_assemblies(spark, tmp_path):
    report = [{"assemblyAccession": "G1", "assignedMoleculeLocationType": k, "refseqAccession": r, "genbankAccession": g} for k, r, g in (("Chromosome", "NC1", "CM1"), ("Plasmid", "NC2", None))]
    folder = "ncbi_dataset/data/G1/"
    path = zipped(tmp_path / "p.zip", {
        folder + "G1_x_genomic.fna": ">NC1 c\nacgt\n>NC2 p\nAA\n>NC3 u\nCC\n", folder + "sequence_report.jsonl": "\n".join(map(json.dumps, report)),
        folder + "genomic.gff": "##gff\nNC1\tx\n", folder + "protein.faa": ">P1 q\nMK\n",
    })
    genomes, loci, proteins = landed.assemblies(spark, [path])
    assert rows(genomes.select("genome_id", "id", "seq")) == [("G1", "NC1", "ACGT"), ("G1", "NC2", "AA")]
    assert [r.value for r in loci.orderBy("ord").collect()] == ["##gff", "NC1\tx"] and rows(proteins.select("genome_id", "id", "seq")) == [("G1", "P1", "MK")]
    only = landed.assemblies(spark, [path], only_genomic=True)[0]
    assert rows(only.select("id")) == [("NC1",)]
    taxa = spark.createDataFrame([("G1", "d__B"), ("G9", "d__C")], "feature_id string, taxon string")
    assert rows(landed.assembly_lineages(only, taxa)) == [("NC1", "d__B", "G1"), (None, "d__C", "G9")]


def test_aligned_widths(spark):
    df = lambda *seqs: spark.createDataFrame([(s,) for s in seqs], "seq string")
    files.check_aligned(df("AC-", "ACG"))
    with pytest.raises(ValueError, match="2 to 3"):
        files.check_aligned(df("AC", "ACG"))


def test_plain_fastq_in_splits(spark, tmp_path):
    path = tmp_path / "r.fastq"
    path.write_text("".join(f"@r{i} x\nACG{'T' * (i % 7)}\n+\nIII{'I' * (i % 7)}\n" for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = {r.read_no: r for r in files.read_fastq(spark, str(path), "s", "forward").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 2000 and all(got[i].header == f"r{i} x" and got[i].seq == "ACG" + "T" * (i % 7) and got[i].qual == "III" + "I" * (i % 7) for i in range(2000))


def test_cycles_end(spark):
    nodes = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "node_id string, parent_id string")
    with pytest.raises(ValueError, match="cycle"):
        lineages.tree_ancestors(nodes)
