import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cladeforge.functions import dust, words
from cladeforge.operators import align, dereplicate, evaluate, lineages, orient
from cladeforge.operators import sequences as S
from cladeforge.operators import taxonomy as X


def seqs(spark, rows):
    return spark.createDataFrame([(i, "", s, n) for n, (i, s) in enumerate(rows)], "id string, description string, seq string, ord long")


def taxa(spark, rows):
    return spark.createDataFrame(rows, "feature_id string, taxon string")


def ids(df, name="id"):
    return sorted(r[name] for r in df.collect())


def lineage_map(df):
    return {r.feature_id: r.taxon for r in df.collect()}


CULL = [
    ("ambig6", "ACGTRYSWKMACGTACGT"),
    ("ambig2", "ACGTRYACGTACGTACGT"),
    ("hpoly8", "ACGAAAAAAAACGTACGT"),
    ("hpoly8ambig1", "ACGAAAAAAAACGTNCGT"),
    ("clean", "ACGTACGTACGTACGTAC"),
]


@pytest.mark.parametrize(
    "degenerates,run,kept",
    [(5, 8, ["ambig2", "clean"]), (7, 7, ["ambig2", "ambig6", "clean"]), (7, 9, [i for i, _ in CULL]), (1, 9, ["clean", "hpoly8"])],
)
def test_cull(spark, degenerates, run, kept):
    assert ids(S.cull_seqs(seqs(spark, CULL), degenerates, run)) == sorted(kept)


def test_cull_checks_its_parameters(spark):
    for bad in ({"num_degenerates": 0}, {"homopolymer_length": 1}):
        with pytest.raises(ValueError):
            S.cull_seqs(seqs(spark, CULL), **bad)


def test_degap_and_transcribe(spark):
    df = seqs(spark, [("a", "--AC..GU-"), ("b", "-G-"), ("c", "----")])
    assert {r.id: r.seq for r in S.degap_seqs(df).collect()} == {"a": "ACGU", "b": "G"}
    assert ids(S.degap_seqs(df, 2)) == ["a"]
    assert S.reverse_transcribe(df).first().seq == "--AC..GT-"


def test_length_filters_split_totally(spark):
    df = seqs(spark, [(str(n), "A" * n) for n in range(1, 9)])
    kept, lost = S.filter_seqs_length(df, 3, 6)
    assert ids(kept) == list("3456") and ids(lost) == list("1278")
    with pytest.raises(ValueError):
        S.filter_seqs_length(df)


def test_length_by_taxon_takes_the_strictest_bounds(spark):
    df = seqs(spark, [("a", "A" * 5), ("b", "A" * 9), ("c", "A" * 12), ("d", "A" * 2)])
    t = taxa(spark, [("a", "X; Y"), ("b", "X; Z"), ("c", "X; Y"), ("d", "Q")])
    kept, lost = S.filter_seqs_length_by_taxon(df, t, ["X", "Y"], [4, 6], [20, 11])
    assert ids(kept) == ["b", "d"] and ids(lost) == ["a", "c"]
    kept, _ = S.filter_seqs_length_by_taxon(df, t, ["X"], [4], None, global_min=3)
    assert ids(kept) == ["a", "b", "c"]
    with pytest.raises(ValueError, match="without taxonomy"):
        S.filter_seqs_length_by_taxon(df, t.where("feature_id <> 'a'"), ["X"], [1])


def test_subsample_is_repeatable(spark):
    df = seqs(spark, [(str(n), "A") for n in range(2000)])
    one, two = ids(S.subsample_fasta(df, 0.2, 3)), ids(S.subsample_fasta(df.repartition(7), 0.2, 3))
    assert one == two and 300 < len(one) < 500 and one != ids(S.subsample_fasta(df, 0.2, 4))


def test_relabel(spark):
    df = seqs(spark, [("b", "ACGT"), ("a", "GG")])
    assert ids(S.relabel(df, "self")) == ["ACGT", "GG"]
    out = {r.description: r.id for r in S.relabel(df, "ticker", "s", keep=True, order="ord").collect()}
    assert out == {"b": "s1", "a": "s2"}
    assert ids(S.with_abundance(df.withColumn("n", df.ord + 3), "n")) == ["a;size=4", "b;size=3"]


LINEAGES = [("1", "d__A; p__B; c__C1"), ("2", "d__A; p__B; c__C2"), ("3", "d__Z; p__; c__")]


def test_filter_taxa(spark):
    t = taxa(spark, LINEAGES)
    keep = spark.createDataFrame([("3",)], "id string")
    assert ids(X.filter_taxa(t, keep), "feature_id") == ["3"]
    assert ids(X.filter_taxa(t, keep, ["A"], ["C2"]), "feature_id") == ["1", "3"]
    assert ids(X.filter_taxa(t, exclude=["C[12]"]), "feature_id") == ["3"]
    for bad in ({"include": ["nothing"]}, {"ids_to_keep": spark.createDataFrame([("9",)], "id string")}, {}):
        with pytest.raises(ValueError):
            X.filter_taxa(t, **bad)


def test_edit_taxonomy(spark):
    t = taxa(spark, [("1", "a"), ("2", "b"), ("3", "xb"), ("4", "a.b$")])
    assert list(lineage_map(X.edit_taxonomy(t, {"a": "b", "b": "c"})).values()) == ["b", "c", "xc", "c.c$"]
    swapped = X.edit_taxonomy(t, search_strings=[r"(?P<x>a)\.(b)"], replacement_strings=[r"\2-\g<x>$"], use_regex=True)
    assert lineage_map(swapped)["4"] == "b-a$$"
    assert lineage_map(X.edit_taxonomy(t, {"a.b$": "plain"}))["4"] == "plain"
    with pytest.raises(ValueError):
        X.edit_taxonomy(t, {"a": r"\1"})


def test_merge_modes(spark):
    one = taxa(spark, [("x", "d__A; p__B; c__"), ("y", "d__A; p__B"), ("z", "d__Q")])
    two = taxa(spark, [("x", "d__A; p__B; c__C"), ("y", "d__A; p__C"), ("w", "")])
    run = lambda mode, **k: lineage_map(X.merge_taxa([one, two], mode, **k))
    assert run("len") == {"x": "d__A;p__B;c__C", "y": "d__A;p__C", "z": "d__Q", "w": "d__"}
    assert run("lca") == {"x": "d__A;p__B", "y": "d__A", "z": "d__Q", "w": "d__"}
    assert run("majority") == {"x": "d__A;p__B;c__C", "y": "d__A", "z": "d__Q", "w": "d__"}
    assert run("lca", new_rank_handles=["disable"])["w"] == "Unassigned"
    assert run("len", new_rank_handles=["domain"])["x"] == "d__A"


def test_merge_scores(spark):
    a = spark.createDataFrame([("x", "d__A", "0.5"), ("y", "d__B", "0.9")], "feature_id string, taxon string, confidence string")
    b = spark.createDataFrame([("x", "d__C", 0.7, 3.0)], "feature_id string, taxon string, Consensus double, other double")
    got = {r.feature_id: r.asDict() for r in X.merge_taxa([a, b], "score").collect()}
    assert got["x"]["taxon"] == "d__C" and got["x"]["Score"] == 0.7 and got["x"]["Other"] == 3.0
    assert got["y"]["taxon"] == "d__B" and got["y"]["Other"] == 0
    with pytest.raises(ValueError):
        X.merge_taxa([a, a.select("feature_id", "taxon")], "score")


A, B = "ACGTTGCAAC" * 5, "TTGACCATGA" * 6
CLUSTER = [("a2", A), ("a1", A.lower()), ("a3", A.replace("T", "U")), ("p", A[:40]), ("b1", B), ("short", "ACGT")]
CLUSTER_TAXA = [
    ("a2", "d__X; p__Y; c__Z"), ("a1", "d__X;p__Y; c__W"), ("a3", "d__X; p__Y;c__W"), ("p", "d__X; p__V"), ("b1", "d__Q; p__R"), ("short", "d__S"),
]


def derep(spark, mode, **k):
    s, t = dereplicate.dereplicate(seqs(spark, CLUSTER), taxa(spark, CLUSTER_TAXA), mode, rank_handles=["domain", "phylum", "class"], **k)
    return ids(s), lineage_map(t)


def test_dereplicate(spark):
    assert derep(spark, "lca") == (["a2", "b1", "p"], {"a2": "d__X;p__Y;c__", "b1": "d__Q;p__R;c__", "p": "d__X;p__V;c__"})
    assert derep(spark, "majority")[1]["a2"] == "d__X;p__Y;c__W"
    assert derep(spark, "super")[1]["a2"] == "d__X;p__Y;c__W"
    kept, lineages_ = derep(spark, "uniq")
    assert kept == ["a1", "a2", "b1", "p"] and lineages_["a1"].endswith("c__W")
    assert derep(spark, "lca", derep_prefix=True) == (["a2", "b1"], {"a2": "d__X;p__;c__", "b1": "d__Q;p__R;c__"})
    assert derep(spark, "lca", min_length=2)[0] == ["a2", "b1", "p", "short"]


def test_super_collapses_substrings(spark):
    t = taxa(spark, [("1", "A;sp"), ("2", "A;sp alvei"), ("3", "A;other"), ("4", "A;")])
    one = t.selectExpr("'g' AS g", "split(taxon, ';') AS parts")
    from cladeforge.functions.consensus import consensus

    assert consensus(one, "g", "parts", "super").first().parts == ["A", "sp alvei"]
    assert consensus(one, "g", "parts", "majority").first().parts == ["A"]
    assert consensus(one, "g", "parts", "lca").first().parts == ["A"]


def test_empty_ranks_count_for_lca(spark):
    from cladeforge.functions.consensus import consensus

    one = spark.createDataFrame([("g", ["B", "", "x"]), ("g", ["B", "", "y"])], "g string, parts array<string>")
    assert consensus(one, "g", "parts", "lca").first().parts == ["B", ""]
    assert consensus(one.limit(1), "g", "parts", "majority").first().parts == ["B", "", "x"]


def test_align():
    exact = align.align("TTTT" + A + "GGGG", A)
    assert exact == align.Alignment(1.0, 1.0, 4, 4 + len(A))
    changed = A[:20] + "G" + A[21:]
    assert align.align(A, changed).identity == pytest.approx(49 / 50) or A[20] == "G"
    gap = align.align(A[:25] + A[27:], A)
    assert gap.identity == pytest.approx(48 / 50)


def test_extract_segments(spark):
    rng = random.Random(1)
    base = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    seg, other = base(60), base(40)
    edited = seg[:30] + ("A" if seg[30] != "A" else "C") + seg[31:]
    df = seqs(spark, [("hit", base(150) + edited + base(100)), ("none", base(300)), ("two", base(50) + other + base(20))])
    refs = seqs(spark, [("s1", seg), ("s2", other)])
    segs, missed = align.extract_seq_segments(df, refs)
    assert {r.id: r.seq for r in segs.collect()} == {"hit": edited, "two": other} and ids(missed) == ["none"]
    segs, missed = align.extract_seq_segments(df, refs, min_seq_len=45)
    assert ids(segs) == ["hit"] and ids(missed) == ["none", "two"]


def test_greedy_clusters_follow_the_order(spark):
    rng = random.Random(2)
    root = [rng.choice("ACGT") for _ in range(200)]
    swap = lambda s, at: s[:at] + [{"A": "C", "C": "G", "G": "T", "T": "A"}[s[at]]] + s[at + 1 :]
    near, far = swap(root, 50), root
    for at in range(10, 190, 12):
        far = swap(far, at)
    rows = [("r", "".join(root)), ("n", "".join(near)), ("f", "".join(far)), ("n2", "".join(swap(near, 120)))]
    got = {r.id: r.centroid for r in dereplicate.clusters(seqs(spark, rows), perc_identity=0.97).collect()}
    assert got == {"r": "r", "n": "r", "f": "f", "n2": "r"}


def test_orientation(spark):
    from pyspark.sql import functions as F

    from cladeforge.functions.sequence import reverse_complement

    rng = random.Random(3)
    ref = seqs(spark, [("ref", "".join(rng.choice("ACGT") for _ in range(400)))])
    part = ref.select(F.lit("plus").alias("id"), "description", F.substring("seq", 50, 120).alias("seq"), "ord")
    turned = part.withColumn("id", F.lit("minus")).withColumn("seq", reverse_complement(F.col("seq")))
    junk = seqs(spark, [("junk", "".join(rng.choice("ACGT") for _ in range(120)))])
    oriented, missed = orient.orient_seqs(part.unionByName(turned).unionByName(junk), ref)
    got = {r.id: r.seq for r in oriented.collect()}
    assert got["plus"] == got["minus"] and ids(missed) == ["junk"]
    reads = [("s", d, 0, "h", r.seq, "I" * 119 + "J") for d, r in (("forward", turned.first()), ("reverse", part.first()))]
    reads += [("single", "forward", 0, "h", turned.first().seq, "I" * 119 + "J")]
    df = spark.createDataFrame(reads, "sample_id string, direction string, read_no long, header string, seq string, qual string")
    out = {(r.sample_id, r.direction): r for r in orient.orient_reads(df, ref)[0].collect()}
    assert out["s", "forward"].seq == part.first().seq and out["s", "reverse"].seq == turned.first().seq
    assert out["single", "forward"].seq == part.first().seq and out["single", "forward"].qual[0] == "J"


def test_evaluate_taxonomy(spark):
    rows = [("1", "k__A; p__B; c__"), ("2", "k__A; p__C; c__D"), ("3", "")]
    got = {r.level: r for r in evaluate.evaluate_taxonomy([taxa(spark, rows)], ["x"], "^[kpc]__").collect()}
    assert [got[i].unique_labels for i in (1, 2, 3)] == [2, 3, 3]
    assert got[1].n_classified == 2 and got[3].n_terminating == 1 and got[3].n_unclassified == 2
    assert got[1].entropy == pytest.approx(-(2 / 3 * math.log(2 / 3) + 1 / 3 * math.log(1 / 3)))
    assert got[1].dataset == "x"


def test_precision_recall(spark):
    e = taxa(spark, [("1", "A;B;C"), ("2", "A;B;C"), ("3", "A;B;C"), ("4", "A;B;C")])
    o = taxa(spark, [("1", "A;B;C"), ("2", "A;B"), ("3", "A;B;X"), ("4", "Unassigned")])
    got = {r.level: r for r in evaluate.evaluate_classifications([e], [o]).collect()}
    assert (got[1].precision, got[1].recall) == (1.0, 0.75)
    assert (got[3].precision, got[3].recall) == (0.5, 0.25) and got[3].f_measure == pytest.approx(1 / 3)
    with pytest.raises(ValueError):
        evaluate.evaluate_classifications([o.limit(1)], [e])


def test_evaluate_seqs(spark):
    rows = [("a", "A" * 11), ("b", "A" * 34), ("c", "A" * 34), ("d", "C" * 41)]
    r = evaluate.evaluate_seqs([seqs(spark, rows)], kmer_lengths=[2]).first()
    assert (r.length_min, r.length_median, r.length_max, r.n_unique, r.dataset) == (11, 34, 41, 3, "1")
    assert r.seq_entropy == 1.04 and r.kmer_entropy_2 == round(-(0.75 * math.log(0.75) + 0.25 * math.log(0.25)), 2)


def test_silva(spark):
    tree = spark.createDataFrame([("1", None), ("2", "1"), ("3", "2"), ("4", "3"), ("5", "4")], "node_id string, parent_id string")
    ranks = [("Archaea;", "2", "domain"), ("Archaea;Aenig mar!;", "3", "phylum"), ("A;B;Clade;", "4", "major_clade"), ("A;B;C;Ord (x);", "5", "order")]
    table = spark.createDataFrame([(*r, "", "") for r in ranks], "path string, taxid string, rank string, remark string, release string")
    tmap = spark.createDataFrame([("AB1", "1", "90", "", "Some small thing", "5")], "primaryAccession string, start string, stop string, path string, organism_name string, taxid string")
    run = lambda **k: lineage_map(lineages.parse_silva_taxonomy(tree, tmap, table, **k))
    assert run() == {"AB1.1.90": "d__Archaea; p__Aenig_mar; c__Aenig_mar; o__Ord_(x); f__Ord_(x); g__Ord_(x)"}
    assert run(rank_propagation=False, ranks=["order", "domain", "genus"], include_species_labels=True) == {"AB1.1.90": "d__Archaea; o__Ord_(x); g__; s__Some_small"}
    with pytest.raises(ValueError, match="without a rank"):
        lineages.parse_silva_taxonomy(tree, tmap, table.where("taxid <> '3'"))


def test_tree_ancestors_match_a_walk(spark):
    rng = random.Random(4)
    parent = {i: rng.randrange(max(0, i - 3), i) for i in range(1, 90)}
    df = spark.createDataFrame([("0", None)] + [(str(a), str(b)) for a, b in parent.items()], "node_id string, parent_id string")
    want = set()
    for i in range(90):
        at, n = i, 0
        want.add((str(i), str(i), 0))
        while at in parent:
            at, n = parent[at], n + 1
            want.add((str(i), str(at), n))
    assert {tuple(r) for r in lineages.tree_ancestors(df).collect()} == want


def test_record_lineages(spark):
    from pyspark.sql import functions as F

    rows = [("Bact;Ent;Escherichia;Escherichia coli", "superkingdom;family;genus;species"), ("Ent;Escherichia coli K", "family;species"), ("Ent", "family")]
    df = spark.createDataFrame(rows, "names string, ranks string")
    take = lambda **k: [r[0] for r in df.select(lineages.ranked_lineage(F.col("names"), F.col("ranks"), ["kingdom", "family", "genus", "species"], **k)).collect()]
    assert take() == ["k__; f__Ent; g__Escherichia; s__coli", "k__; f__Ent; g__Escherichia; s__coli K", "k__; f__Ent; g__Ent; s__Ent"]
    assert take(rank_propagation=False)[2] == "k__; f__Ent; g__; s__"
    schema = "taxid string, organism string, division string, lineage array<struct<rank: string, name: string>>, aka array<string>"
    recs = spark.createDataFrame([("9", "Gen sp", "Bacteria", [("phylum", "P"), ("genus", "Gen")], ["8"]), ("7", None, "x", [], None)], schema)
    got = {r.taxid: r.taxon for r in lineages.ncbi_lineages(recs, ["phylum", "kingdom", "species"]).collect()}
    assert got == {"9": "p__P; k__Bacteria; s__sp", "8": "p__P; k__Bacteria; s__sp"}
    got = lineages.ncbi_lineages(recs, ["domain", "class"], rank_propagation=False).first().taxon
    assert got == "d__Bacteria; c__"


def test_release_formats(spark):
    nine = taxa(spark, [("a", ";".join("ABCDEFGHI") + ";")])
    assert lineage_map(lineages.pr2_taxonomy(nine, ["species", "domain"])) == {"a": "d__A;s__I"}
    rows = spark.createDataFrame([("x;k__F;p__G", "extra", "AC")], "id string, description string, seq string")
    s, t = lineages.eukaryome_split(rows)
    assert s.first().id == "x" and lineage_map(t) == {"x": "k__F;p__G extra"}
    blank = spark.createDataFrame([(" ", 1, "v")], "a string, b int, c string")
    assert tuple(lineages.blank_to_null(blank).first()) == (None, 1, "v")
    lines = spark.createDataFrame([("##gff",), ("accn|X\t1",)], "value string")
    assert [r.value for r in lineages.gff_without_accession_prefix(lines).collect()] == ["##gff", "X\t1"]


def test_columns_of_any_name_stay(spark):
    names = "id string, description string, seq string, ord long, new string, taxon string, n long, number long, part long, before long, kept long, worth long"
    df = spark.createDataFrame([("b", "x", "ACGT", 2, "n", "t", 5, 6, 7, 8, 9, 1), ("a", "y", "GG", 1, "m", "u", 5, 6, 7, 8, 9, 1)], names)
    rest = lambda out: sorted(map(tuple, out.select(*df.columns[3:]).collect()))
    want = rest(df)
    for by in ("md5", "ticker"):
        out = S.relabel(df, by, keep=True, order="ord")
        assert out.columns == df.columns and rest(out) == want and sorted(r.description for r in out.collect()) == ["a", "b"]
    taxa = spark.createDataFrame([("a", "k__A", 1, "q"), ("b", "k__B", 2, "r")], "feature_id string, taxon string, kept long, worth string")
    kept, lost = S.filter_seqs_length_by_taxon(df, taxa, ["k__A"], min_lens=[3])
    assert kept.columns == df.columns and [r.id for r in kept.collect()] == ["b"] and [r.taxon for r in lost.collect()] == ["u"]
    out = X.filter_taxa(taxa, df.select("id").where("id = 'a'"), include=["k__B"])
    assert sorted(map(tuple, out.collect())) == [("a", "k__A", 1, "q"), ("b", "k__B", 2, "r")]
    merged = X.merge_taxa([taxa.drop("worth"), taxa.select("feature_id", "taxon", F.lit(3).alias("worth"))], "len")
    assert sorted(merged.columns) == ["Kept", "Worth", "feature_id", "taxon"]
    assert [tuple(r) for r in lineages.last_by(df, "n", "ord").select("n", "id").collect()] == [(5, "b")]


def test_sample_exactly(spark):
    rows = [(f"s{i % 90}", i) for i in range(200)] + [(None, 7)]
    df = spark.createDataFrame(rows, "id string, number long").repartition(7)
    for fraction in (0.0, 0.004, 0.31, 0.5, 1.0):
        got = S.sample_exactly(df, fraction, 3)
        assert got.columns == df.columns and got.count() == int(fraction * 201)
    one, two = (sorted(r.id or "" for r in S.sample_exactly(d, 0.4, 5).collect()) for d in (df, df.coalesce(2)))
    assert one == two != sorted(r.id or "" for r in S.sample_exactly(df, 0.4, 6).collect())


def test_sorted_prefixes_match_brute_force(spark):
    rng = random.Random(5)
    keys = {"a" * i for i in range(1, 60, 3)}
    for _ in range(40):
        base = "".join(rng.choice("ab") for _ in range(rng.randint(1, 30)))
        keys |= {base[: rng.randint(1, 30)] + "".join(rng.choice("ab") for _ in range(rng.randint(0, 3))) for _ in range(6)}
    rows = [(f"c{i}", i, rng.randint(1, 3), k) for i, k in enumerate(sorted(keys, key=lambda _: rng.random()))]
    want = {}
    for c, _, _, k in rows:
        longer = [r for r in rows if r[3] != k and r[3].startswith(k)]
        longer = [r for r in longer if not any(q[3] != r[3] and q[3].startswith(r[3]) for q in rows)]
        if longer:
            want[c] = min(longer, key=lambda r: (len(r[3]), -r[2], r[1]))[0]
    df = spark.createDataFrame(rows, "centroid string, ord long, n long, key string")
    for ranges in (1, 5, 60):  # ranges narrower than a key's extensions, too
        spark.conf.set("spark.sql.shuffle.partitions", ranges)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            assert {r.centroid: r.target for r in dereplicate._prefix_map(df).collect()} == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_prefixes_look_only_at_shared_beginnings(spark, monkeypatch):
    """Sequences whose first letters no other one has stay out of the order, and the clusters
    are those of all pairs."""
    rng = random.Random(6)
    some = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    bases = [some(80) for _ in range(3)]
    keys = [some(60) for _ in range(30)] + [b[:n] for b in bases for n in (33, 40, 40, 80)] + [bases[0][:35] + "AAAA", bases[1][:31] + "A", bases[2][:40].lower()]
    df = seqs(spark, [(f"k{i:02}", k) for i, k in enumerate(keys)])
    looked, whole = [], dereplicate._prefix_map
    monkeypatch.setattr(dereplicate, "_prefix_map", lambda kinds: looked.append(kinds.count()) or whole(kinds))
    for least, most in ((32, 11), (1, 41)):
        upper = [(k.upper(), f"k{i:02}") for i, k in enumerate(keys) if len(k) >= least]
        first, n = {}, {}
        for k, i in upper:
            first.setdefault(k, i)
            n[k] = n.get(k, 0) + 1
        longer = lambda k: [q for q in first if q != k and q.startswith(k)]
        to = {k: min((len(q), -n[q], first[q]) for q in longer(k) if not longer(q))[2] if longer(k) else first[k] for k in first}
        got = {r.id: r.centroid for r in dereplicate.clusters(df, derep_prefix=True, min_length=least).collect()}
        assert got == {i: to[k] for k, i in upper}
        assert looked.pop() <= most


def mutated(rng, seq, rate):
    out = []
    for c in seq:
        x = rng.random()
        if x >= rate / 3:
            out += [rng.choice("ACGT")] if x < 2 * rate / 3 else []
            out.append(rng.choice("ACGT") if x < rate else c)
    return "".join(out)


def test_band_and_whole_alignment_agree():
    rng = random.Random(1)
    some = lambda *n: "".join(rng.choice("ACGT") for _ in range(rng.choice(n)))
    for _ in range(120):
        core = some(5, 30, 80)
        a, b = some(0, 10, 40) + mutated(rng, core, 0.08) + some(0, 10, 40), some(0, 7, 30) + core + some(0, 7, 30)
        whole, band = align.align(a, b), align.align_band(a, b, -1000, 1000)
        assert whole.identity == pytest.approx(band.identity) and whole.covered == band.covered
    a = some(2000)
    b = mutated(rng, a, 0.05)
    assert align.align(a, b) == align.align_band(a, b, -80, 80)


def test_least_distances_match_brute_force():
    rng = random.Random(2)

    def least(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, d in enumerate(t, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
            row = new
        return min(row)

    for _ in range(60):
        text = "".join(rng.choice("ACGTN") for _ in range(rng.randint(0, 60)))
        patterns = ["".join(rng.choice("ACGTR") for _ in range(rng.randint(1, 70))) for _ in range(rng.randint(1, 5))]
        assert align.least_distances(text, patterns) == [least(p, text) for p in patterns]


def test_segments_lose_nothing_that_aligns(spark, monkeypatch):
    """All candidates, bounded by distance, against all pairs aligned; and in blocks."""
    rng = random.Random(7)
    refs = ["".join(rng.choice("ACGT") for _ in range(rng.randint(40, 90))) for _ in range(12)]
    rows = [(f"s{i:02}", "".join(rng.choice("ACGT") for _ in range(60)) + mutated(rng, rng.choice(refs), rng.choice((0.02, 0.1, 0.2))) + "ACGTAC") for i in range(40)]
    rows += [("none", "A" * 80), ("empty", ""), ("odd", "ACGTNNNNACGTRYACGT" * 5)]
    want = {}
    for i, s in rows:
        good = [(-x.identity, f"r{k:02}", s[x.low : x.high]) for k, r in enumerate(refs) if s and (x := align.align(s, r)).identity >= 0.8 and x.covered >= 0.9]
        if good:
            want[i] = min(good)[2]
    df, ref_df = seqs(spark, rows), seqs(spark, [(f"r{k:02}", r) for k, r in enumerate(refs)])
    segs, missed = align.extract_seq_segments(df, ref_df, 0.8, 0.9, most=None)
    assert {r.id: r.seq for r in segs.collect()} == want and ids(missed) == sorted({i for i, _ in rows} - set(want)) and len(want) > 20
    monkeypatch.setattr(align, "BLOCK", 200)
    got = {r.id: r.seq for r in align.extract_seq_segments(df, ref_df, 0.8, 0.9)[0].collect()}
    assert len(got) >= 0.9 * len(want) and got.items() <= want.items()


def test_segments_align_whole_texts_only_where_a_part_is_as_good(monkeypatch):
    """Long texts without a segment, and one with two: the segments found are those of all
    pairs aligned, and few pairs are."""
    rng = random.Random(11)
    some = lambda n: "".join(rng.choice("AACGTTACGR") for _ in range(n))
    refs = [(f"r{k:02}", some(60)) for k in range(30)] + [("long", some(90))]
    texts = [some(9000) for _ in range(4)]
    texts += [some(700) + mutated(rng, refs[3][1], 0.1) + some(300) + refs[4][1][:-5] + some(40), mutated(rng, refs[30][1], 0.05) + some(600), refs[5][1][3:], refs[6][1]]
    want = []
    for t, s in enumerate(texts):
        good = [(-x.identity, i, x.low, x.high) for i, r in refs if (x := align.align(s, r)).identity >= 0.8 and x.covered >= 0.9]
        want += [(f"t{t}", i, -y, low, high) for y, i, low, high in [min(good)] if good] if good else []
    batch = pa.RecordBatch.from_arrays([pa.array([f"t{t}" for t in range(len(texts))]), pa.array(texts)], ["id", "seq"])
    calls, whole = [], align.align
    monkeypatch.setattr(align, "align", lambda a, b: calls.append(len(a)) or whole(a, b))
    for most in (None, 32):
        got = pa.Table.from_batches(align._best_hits(align.References(refs), 0.8, 0.9, most)([batch])).to_pylist()
        assert [tuple(r.values()) for r in got] == want and len(want) == 4
    assert len(calls) <= 12 and max(calls) < 9000  # of 496 pairs, of which 31 x 4 are of the long texts


def test_parts_align_as_the_whole():
    rng = random.Random(12)
    some = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    seen = 0
    for _ in range(150):
        ref = some(rng.choice((20, 40, 60)))
        text = some(rng.choice((0, 2, 5, 40))) + mutated(rng, ref[rng.choice((0, 2)) : len(ref) - rng.choice((0, 3))], 0.12) + some(rng.choice((0, 1, 4, 50)))
        x = align.align(text, ref)
        if x.identity >= 0.75 and x.covered >= 0.85:
            most, left = align.most_edits(len(ref), 0.75, 0.85)
            ends = align.near_ends(text, [ref], [most])[0]
            _, _, same = align.Lanes([ref], [most]).ends([text], [np.array([0])])
            assert same.tolist() == [e for e in ends if e] and x.high in ends
            parts = align.near_parts(len(text), len(ref), ends, 0.75, left)
            (low, high), = [p for p in parts if p[0] <= x.low and x.high <= p[1]]
            y = align.align_parts([text[low:high]], [ref], np.array([low]), np.array([len(text) - high]))[0]
            assert y._replace(low=y.low + low, high=y.high + low) == x
            seen += 1
    assert seen > 60


def test_candidates_of_clusters_find_similar_records(spark):
    """Recall of the minimizers against all pairs, on copies with edits; hot words offer
    only their first records, so a large group costs no square of pairs."""
    rng = random.Random(3)
    bases = ["".join(rng.choice("ACGT") for _ in range(rng.randint(80, 160))) for _ in range(4)]
    rows = [(f"c{i:03}", mutated(rng, bases[i % 4], rng.choice((0.0, 0.02, 0.05)))) for i in range(48)]
    df = seqs(spark, rows).select("id", "ord", "seq")
    exact, got = ({r.centroid: r.target for r in align.greedy_clusters(df, 0.9, exact=e).collect()} for e in (True, False))
    assert len(exact) > 30
    assert sum(k in got for k in exact) >= 0.9 * len(exact) and len(got) <= 1.05 * len(exact)
    assert align.candidates(df, 0.9).count() <= align.TAKEN * len(rows)


def test_unit_weights_hold_few_words_of_a_large_batch():
    """What a task holds doesn't grow with its batch, and the sums are those of one count."""
    import tracemalloc

    rng = np.random.default_rng(3)
    seqs = ["".join(x) for x in rng.choice(list("acgtry"), (3000, 900))] + ["acgté" * 9, None, "ac"]
    peaks = []
    for rows in (600, len(seqs)):
        batch = pa.RecordBatch.from_arrays([pa.array(seqs[-rows:])], ["seq"])
        tracemalloc.start()
        found = pa.Table.from_batches(list(words.unit_weights(4)([batch])))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0]
    want = {}
    for s in seqs:
        kinds, n = words.word_counts(s or "", 4)
        for word, w in zip(kinds, n / np.sqrt((n * n).sum()), strict=True):
            want[word] = want.get(word, 0.0) + float(w)
    got = found.group_by("word").aggregate([("w", "sum")]).to_pylist()
    assert {r["word"]: r["w_sum"] for r in got} == pytest.approx(want)


def test_oriented_rows_stay_where_they_are(spark):
    """The strand is told in the row: one pass of Python, and no letters shuffled; words with
    other letters count once, and only true ones."""
    rng = random.Random(4)
    some = lambda n: "".join(rng.choice("AACGTTACGR") for _ in range(n))
    refs = [("r1", some(300)), ("r2", some(90) + "é" + some(20)), ("r3", "ACGTRYSWKMBDHVNACGT")]
    rows = [("a", refs[0][1][20:200] * 2), ("b", refs[1][1]), ("c", some(400)), ("d", ""), ("e", "ACGT" * 2), ("f", refs[1][1].replace("é", "ö")), ("g", refs[2][1])]
    turn = str.maketrans("ACGTURYSWKMBDHVN", "TGCAAYRSWMKVHDBN")
    rows += [(f"{i}-", s.translate(turn)[::-1]) for i, s in rows]
    own = lambda s: {s[i : i + 12] for i in range(len(s) - 11)}
    known = set().union(*(own(r) for _, r in refs))
    df, ref_df = seqs(spark, rows), seqs(spark, refs)
    got = {r.id: (r.forward, r.backward) for r in orient.orientation(df, ref_df).collect()}
    assert got == {i: (len(own(s) & known), len(own(s.translate(turn)[::-1]) & known)) for i, s in rows}
    plan = orient.orient_seqs(df, ref_df)[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_bitmaps_of_words():
    rng = random.Random(4)
    seq = "".join(rng.choice("ACGTN") for _ in range(300))
    codes, odd = words.base_codes(seq, 4)
    want = {seq[i : i + 4] for i in range(297)}
    named = {"".join("ACGT"[c >> s & 3] for s in (6, 4, 2, 0)) for c in codes.tolist()}
    assert named | set(odd) == want and not named & set(odd)
    bits = np.zeros(8 * words.PIECE, dtype=bool)
    bits[codes] = True
    back = np.flatnonzero(np.unpackbits(words.turned_bitmap(np.packbits(bits, bitorder="little"), 4), bitorder="little"))
    turned = {w[::-1].translate(str.maketrans("ACGT", "TGCA")) for w in named}
    assert {"".join("ACGT"[c >> s & 3] for s in (6, 4, 2, 0)) for c in back.tolist()} == turned


def test_dust_finds_low_complexity():
    rng = random.Random(8)
    some = "".join(rng.choice("ACGT") for _ in range(200))
    assert dust.low_complexity(some).mean() < 0.1
    masked = dust.low_complexity(some + "A" * 40 + some)
    assert masked[200:240].all() and masked[:190].sum() + masked[250:].sum() < 30
    assert dust.low_complexity("ACACACAC" * 8).all() and not dust.low_complexity("ACGT").any()

    def brute(t):
        best = (0, 0, 0)
        for i in range(len(t)):
            for j in range(i + 1, len(t)):
                counts = [t[i : j + 1].count(x) for x in set(t[i : j + 1])]
                best = max(best, (10 * sum(n * (n - 1) // 2 for n in counts) // (j - i), -i, -j))
        return best[0]

    for _ in range(20):
        part = [rng.choice((1, 2, 3)) for _ in range(rng.randint(2, 12))]
        assert dust.worst_part(np.array(part))[0] == brute(part)


def test_masked_references_orient_nothing(spark):
    rng = random.Random(6)
    plain, low = "".join(rng.choice("ACGT") for _ in range(80)), "AC" * 30
    df = seqs(spark, [("x", plain), ("y", low), ("z", plain[::-1].translate(str.maketrans("ACGT", "TGCA")))])
    refs = seqs(spark, [("r", plain + low), ("odd", "ACGTNNNNACGTACGTNACGT")])
    strands = lambda mask, r: {x.id: x.strand for x in orient.orientation(df, r, dbmask=mask).collect()}
    assert strands(None, refs) == {"x": "+", "y": "+", "z": "-"}
    assert strands("dust", refs) == {"x": "+", "y": "?", "z": "-"}
    soft = seqs(spark, [("r", plain.lower() + low)])
    assert strands("soft", soft) == {"x": "?", "y": "+", "z": "?"} and strands("none", soft)["x"] == "+"
    with pytest.raises(ValueError):
        orient.orientation(df, refs, dbmask="x")


def test_oriented_sequences_are_relabelled(spark, monkeypatch):
    rng = random.Random(6)
    plain = "".join(rng.choice("ACGT") for _ in range(80))
    df = seqs(spark, [("b;size=3", plain), ("a;size=5;", plain[10:]), ("q", "ACGT")])
    refs = seqs(spark, [("r", plain)])
    out, missed = orient.orient_seqs(df, refs, relabel="n", relabel_keep=True, sizein=True, sizeout=True)
    assert {r.id: r.description for r in out.collect()} == {"n1;size=5": "a;size=5;", "n2;size=3": "b;size=3"} and ids(missed) == ["q"]
    assert ids(orient.orient_seqs(df, refs, sizeout=True)[0]) == ["a;size=1", "b;size=1"]
    assert ids(orient.orient_seqs(df, refs, relabel_self=True)[0]) == sorted([plain, plain[10:]])
    with pytest.raises(ValueError):
        orient.orient_seqs(df, refs, relabel="x", relabel_md5=True)


def test_odd_words_meet_by_a_join_where_they_are_many(spark, monkeypatch):
    refs, df = seqs(spark, [("r", "ACGTNACGTNACGTRYACGTACGT")]), seqs(spark, [("x", "ACGTNACGTNACGTRYACGTACGT"), ("y", "ACGTACGTRYACGTNACGTNACGT"), ("z", None)])
    want = sorted(map(tuple, orient.orientation(df, refs).collect()))
    monkeypatch.setattr(orient, "SENT_WORDS", 2)
    assert sorted(map(tuple, orient.orientation(df, refs).collect())) == want and want[0][2] > 5
