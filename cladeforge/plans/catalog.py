"""Named queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeforge.functions import lineage as L
from cladeforge.functions.sequence import reverse_complement
from cladeforge.operators import align, dereplicate, evaluate, lineages, orient
from cladeforge.operators import sequences as S
from cladeforge.operators import taxonomy as X
from cladeforge.plans import views as V
from cladeforge.schema import SEVEN_RANKS, handles

_HANDLES = handles(SEVEN_RANKS)
_LABELS, _MIN, _MAX = ["d__en", "p__src1", "p__src0"], [100, 200, 40], [9000, 5000, 3000]


def _derep(mode, part, **more):
    def query(spark, sf_dir):
        seqs, taxa = V.sequences(spark, sf_dir), V.taxonomy(spark, sf_dir).drop("n_chars")
        out = dereplicate.dereplicate(seqs, taxa, mode, **more)[part]
        return out.select("id", "seq") if part == 0 else out

    return query


def _merge(mode):
    def query(spark, sf_dir):
        out = X.merge_taxa([V.taxonomy(spark, sf_dir), V.observed(spark, sf_dir)], mode)
        return out.select("feature_id", "taxon", *[c for c in ("N_chars",) if c in out.columns])

    return query


def _seqs(f):
    return lambda spark, sf_dir: f(V.sequences(spark, sf_dir)).select("id", "seq")


def _by_taxon(part):
    def query(spark, sf_dir):
        taxa = V.taxonomy(spark, sf_dir)
        return S.filter_seqs_length_by_taxon(V.sequences(spark, sf_dir), taxa, _LABELS, _MIN, _MAX, 20, 12000)[part].select("id", "seq")

    return query


def _rounded(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


def filter_taxa(spark, sf_dir):
    taxa = V.taxonomy(spark, sf_dir).select("feature_id", "taxon")
    keep = V.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"))
    return X.filter_taxa(taxa, keep, ["d__en", "p__src1$"], ["t1$", "q0"])


def edit_taxonomy(spark, sf_dir):
    taxa = V.customers(spark, sf_dir)
    return X.edit_taxonomy(taxa, {"NATION_(\\d)\\b": "N0\\1", "^r__A": "r__a"}, ["s__"], ["segment="], use_regex=True)


def taxonomy_depth(spark, sf_dir):
    return _rounded(evaluate.taxonomic_depth(V.taxonomy(spark, sf_dir)), "p_terminating", "p_classified", "p_unclassified")


def taxonomy_entropy(spark, sf_dir):
    return _rounded(evaluate.taxonomic_entropy(V.taxonomy(spark, sf_dir)), "entropy")


def precision_recall(spark, sf_dir):
    out = evaluate.evaluate_classifications([V.taxonomy(spark, sf_dir)], [V.observed(spark, sf_dir)], ["docs"])
    return _rounded(out, "precision", "recall", "f_measure")


def seq_stats(spark, sf_dir):
    return evaluate.evaluate_seqs([V.sequences(spark, sf_dir)], ["docs"], [4])


def rank_propagation(spark, sf_dir):
    rows = V.table(spark, sf_dir, "documents").join(V.table(spark, sf_dir, "labels"), "doc_id", "left")
    filled = L.filled([F.col("lang"), F.concat(F.lit("q"), "quality"), F.concat(F.lit("t"), "toxic"), F.lit(None).cast("string")])
    parts = F.array(*[F.concat(F.lit(h), c) for h, c in zip(_HANDLES, filled, strict=False)])
    return rows.select(F.col("doc_id").cast("string").alias("feature_id"), L.lineage(parts, "; ").alias("taxon"))


def backfill(spark, sf_dir):
    taxon = L.lineage(L.backfilled(L.labels(F.col("taxon")), _HANDLES))
    return V.taxonomy(spark, sf_dir).select("feature_id", taxon.alias("taxon"))


def pr2_split(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents")
    nine = F.concat(F.array_join(F.array_repeat(F.concat_ws("_", "lang", "source"), 9), ";"), F.lit(";"))
    return lineages.pr2_taxonomy(docs.select(F.col("doc_id").cast("string").alias("feature_id"), nine.alias("taxon")), ["domain", "class", "species"])


def gtdb_header(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents")
    head = F.concat(F.lit("d__"), "lang", F.lit(";s__"), "source", F.lit(" [n="), F.col("n_chars").cast("string"), F.lit("]"))
    return lineages.gtdb_taxonomy(docs.select(F.col("doc_id").cast("string").alias("id"), head.alias("description")))


def eukaryome_header(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents")
    head = F.concat(F.lit("EUK"), F.col("doc_id").cast("string"), F.lit(";k__"), "lang", F.lit(";p__"), "source")
    rows = docs.select(head.alias("id"), F.lit("").alias("description"), F.lit("A").alias("seq"))
    return lineages.eukaryome_split(rows)[1]


def genus_species_split(spark, sf_dir):
    parts = V.table(spark, sf_dir, "part")
    names = F.concat_ws(";", "p_type", F.split("p_name", " ")[0], F.when(F.col("p_size") > 25, F.col("p_name")).otherwise(F.concat("p_brand", F.lit(" "), "p_name")))
    ranks = F.when(F.col("p_size") > 25, "family;genus;species").otherwise("family;none;species")
    taxon = lineages.ranked_lineage(names, ranks, ["kingdom", "family", "genus", "species"])
    return parts.select(F.col("p_partkey").cast("string").alias("feature_id"), taxon.alias("taxon"))


def orient_hits(spark, sf_dir):
    out = orient.orientation(V.sequences(spark, sf_dir), V.segments(spark, sf_dir))
    return out.select("id", "strand", F.col("forward").cast("long").alias("forward"), F.col("backward").cast("long").alias("backward"))


def orient_seqs(spark, sf_dir):
    return orient.orient_seqs(V.sequences(spark, sf_dir), V.segments(spark, sf_dir))[0].select("id", "seq")


def parse_silva(spark, sf_dir):
    return lineages.parse_silva_taxonomy(*V.silva(spark, sf_dir), include_species_labels=True)


def evaluate_taxonomy(spark, sf_dir):
    out = evaluate.evaluate_taxonomy([V.taxonomy(spark, sf_dir), V.observed(spark, sf_dir)], ["whole", "observed"])
    return _rounded(out, "entropy", "p_terminating", "p_classified", "p_unclassified")


def _short_segments(spark, sf_dir):
    return V.segments(spark, sf_dir).withColumn("seq", F.substring("seq", 21, 60))


def extract_segments(spark, sf_dir):
    """Of every document the part that is most like a passage of the benchmark."""
    return align.extract_seq_segments(V.sequences(spark, sf_dir), _short_segments(spark, sf_dir), 0.8, 0.9)[0].select("id", "seq")


def segment_candidates(spark, sf_dir):
    return align.segment_candidates(V.sequences(spark, sf_dir), _short_segments(spark, sf_dir))


def derep_clustered(spark, sf_dir):
    return dereplicate.clusters(V.segments(spark, sf_dir), perc_identity=0.9)


def ncbi_lineages(spark, sf_dir):
    """Customers as taxonomy records: some without a genus, some named with it."""
    rows = V.table(spark, sf_dir, "customer").join(V.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.join(V.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rank = lambda name, value: F.struct(F.lit(name).alias("rank"), F.col(value).alias("name"))
    phylum, genus = rank("phylum", "n_name"), rank("genus", "c_mktsegment")
    records = rows.select(
        F.col("c_custkey").cast("string").alias("taxid"),
        F.when(F.col("c_custkey") % 2 == 0, F.concat_ws(" ", "c_mktsegment", "c_name")).otherwise(F.col("c_name")).alias("organism"),
        F.col("r_name").alias("division"),
        F.when(F.col("c_custkey") % 3 == 0, F.array(phylum)).otherwise(F.array(phylum, genus)).alias("lineage"),
        F.array(F.concat(F.lit("old"), F.col("c_custkey").cast("string"))).alias("aka"),
    )
    return lineages.ncbi_lineages(records, ["kingdom", "phylum", "genus", "species"], rank_propagation=False)


def features_with_sequences(spark, sf_dir):
    """Documents as features of seven genomes, with the letters that their digests stand for."""
    docs = V.sequences(spark, sf_dir).withColumn("md5", F.md5(F.col("seq").cast("binary")))
    features = docs.select((F.col("ord") % 7).cast("string").alias("genome_id"), F.col("id").alias("feature_id"), F.col("md5").alias("na_sequence_md5"), F.lit(None).cast("string").alias("aa_sequence_md5"))
    known = docs.where("ord % 3 <> 0").select("md5", F.lower("seq").alias("sequence")).distinct()
    return lineages.features_with_sequences(features, known)[0]


QUERIES = {
    "derep_lca": _derep("lca", 1),
    "derep_uniq": _derep("uniq", 1),
    "derep_super": _derep("super", 1),
    "derep_majority": _derep("majority", 1),
    "derep_prefix": _derep("lca", 1, derep_prefix=True),
    "derep_seqs": _derep("uniq", 0),
    **{f"merge_{m}": _merge(m) for m in ("len", "score", "lca", "super", "majority")},
    "cull_seqs": _seqs(S.cull_seqs),
    "degap_seqs": lambda spark, sf_dir: S.degap_seqs(V.gapped(spark, sf_dir), 5).select("id", "seq"),
    "reverse_transcribe": lambda spark, sf_dir: S.reverse_transcribe(V.gapped(spark, sf_dir)).select("id", "seq"),
    "orient_noref": _seqs(lambda df: orient.orient_seqs(df)[0]),
    "revcomp_relabel": _seqs(lambda df: S.relabel(df.withColumn("seq", reverse_complement(F.col("seq"))), "md5")),
    "filter_len": _seqs(lambda df: S.filter_seqs_length(df, 100, 3000)[0]),
    "discard_len": _seqs(lambda df: S.filter_seqs_length(df, 100, 3000)[1]),
    "filter_len_taxon": _by_taxon(0),
    "discard_len_taxon": _by_taxon(1),
    "filter_taxa": filter_taxa,
    "edit_taxonomy": edit_taxonomy,
    "taxonomy_depth": taxonomy_depth,
    "taxonomy_entropy": taxonomy_entropy,
    "precision_recall": precision_recall,
    "seq_stats": seq_stats,
    "rank_propagation": rank_propagation,
    "backfill": backfill,
    "pr2_split": pr2_split,
    "gtdb_header": gtdb_header,
    "eukaryome_header": eukaryome_header,
    "genus_species_split": genus_species_split,
    "tree_ancestors": lambda spark, sf_dir: lineages.tree_ancestors(V.tree(spark, sf_dir)),
    "orient_hits": orient_hits,
    "orient_seqs": orient_seqs,
    "parse_silva": parse_silva,
    "evaluate_taxonomy": evaluate_taxonomy,
    "extract_segments": extract_segments,
    "segment_candidates": segment_candidates,
    "ncbi_lineages": ncbi_lineages,
    "features_with_sequences": features_with_sequences,
    "derep_clustered": derep_clustered,
    "subsample": _seqs(lambda df: S.subsample_fasta(df, 0.3, 7)),
    "sample_exact": _seqs(lambda df: S.sample_exactly(df, 0.3, 7)),
}

# SQL ------------------------------------------------------------------------------------

_LIST = ", ".join(f"'{h}'" for h in _HANDLES)
_TIDY = "list_transform(string_split(taxon, ';'), lambda x: trim(x))"
_STRIP = "list_transform(string_split(taxon, ';'), lambda x: regexp_replace(trim(x), '^[dkpcofgs]__', ''))"
_BACKFILL = f"array_to_string(list_concat(parts, list_slice([{_LIST}], len(parts) + 1, 7)), ';')"
_CENTRES = """kinds AS (SELECT upper(replace(replace(seq, 'U', 'T'), 'u', 't')) AS key, arg_min(id, ord) AS centroid, min(ord) AS ord, count(*) AS n
 FROM sequences WHERE length(seq) >= 32 GROUP BY 1),
members AS (SELECT s.id, s.ord, k.centroid FROM sequences s JOIN kinds k ON upper(replace(replace(s.seq, 'U', 'T'), 'u', 't')) = k.key)"""
_PREFIX = """, links AS (SELECT a.centroid AS short, b.centroid AS target, length(b.key) AS size, b.n, b.ord FROM kinds a JOIN kinds b
 ON length(a.key) < length(b.key) AND starts_with(b.key, a.key)),
moves AS (SELECT short, arg_min(target, {'s': size, 'n': -n, 'o': ord}) AS target FROM links WHERE target NOT IN (SELECT short FROM links) GROUP BY 1),
moved AS (SELECT m.id, coalesce(v.target, m.centroid) AS centroid FROM members m LEFT JOIN moves v ON m.centroid = v.short)"""
#: By group and rank, in tables rows(g, parts) to out(g, parts).
_EACH = "each AS (SELECT g, unnest(parts) AS label, generate_subscripts(parts, 1) AS pos FROM rows)"
_LCA = f"""{_EACH}, ranks AS (SELECT g, pos, count(*) AS n, count(DISTINCT label) AS kinds, min(label) AS label FROM each GROUP BY 1, 2),
size AS (SELECT g, n AS total FROM ranks WHERE pos = 1),
marked AS (SELECT r.*, min(CASE WHEN kinds > 1 OR n < total THEN pos END) OVER (PARTITION BY r.g) AS stop FROM ranks r JOIN size s ON r.g = s.g),
out AS (SELECT g, coalesce(list(label ORDER BY pos) FILTER (WHERE stop IS NULL OR pos < stop), []) AS parts FROM marked GROUP BY 1)"""
_TOP = """tied AS (SELECT g, pos, n, count(*) AS kinds, max(label) AS label FROM votes GROUP BY 1, 2, 3),
best AS (SELECT g, pos, arg_max(kinds, n) AS kinds, arg_max(label, n) AS label FROM tied GROUP BY 1, 2),
marked AS (SELECT *, min(CASE WHEN kinds > 1 THEN pos END) OVER (PARTITION BY g) AS stop FROM best),
out AS (SELECT g, coalesce(list(label ORDER BY pos) FILTER (WHERE stop IS NULL OR pos < stop), []) AS parts FROM marked GROUP BY 1)"""
_VOTES = "SELECT g, pos, label, sum(CASE WHEN label = '' THEN 0 ELSE 1 END) AS n FROM each GROUP BY 1, 2, 3"
_MAJORITY = f"{_EACH}, votes AS ({_VOTES}), {_TOP}"
_SUPER = f"""{_EACH}, single AS ({_VOTES}),
moved AS (SELECT a.g, a.pos, a.n, a.label, CASE WHEN a.label = '' THEN '' ELSE
 (SELECT arg_max(b.label, {{'s': length(b.label), 'l': b.label}}) FROM single b WHERE b.g = a.g AND b.pos = a.pos AND contains(b.label, a.label)) END AS long FROM single a),
votes AS (SELECT g, pos, long AS label, sum(n) AS n FROM moved GROUP BY 1, 2, 3), {_TOP}"""


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


def _sql_derep(consensus: str, members: str = "members", extra: str = "") -> str:
    rows = f"rows AS (SELECT centroid AS g, {_TIDY} AS parts FROM {members} JOIN taxonomy ON feature_id = id)"
    return _with(V.SQL_SEQUENCES, V.SQL_TAXONOMY, _CENTRES + extra, rows, consensus) + f"SELECT g AS feature_id, {_BACKFILL} AS taxon FROM out"


_TAXA_ROWS = f"tidy AS (SELECT feature_id, array_to_string({_TIDY}, ';') AS taxon FROM taxonomy)"
_UNIQ = _with(
    V.SQL_SEQUENCES, V.SQL_TAXONOMY, _CENTRES, _TAXA_ROWS,
    "kept AS (SELECT arg_min(id, {'o': CASE WHEN id = centroid THEN 0 ELSE 1 END, 'p': ord}) AS id FROM members JOIN tidy ON feature_id = id GROUP BY centroid, taxon)",
)
_MERGE_ROWS = f"rows AS (SELECT feature_id AS g, {_STRIP} AS parts FROM taxonomy UNION ALL SELECT feature_id, {_STRIP} FROM observed)"
_PREFIXED = f"array_to_string(list_transform(list_zip([{_LIST}][1:len(parts)], parts[1:7]), lambda x: x[1] || x[2]), ';')"
_LABELLED = f"SELECT g AS feature_id, CASE WHEN len(parts) = 0 THEN 'Unassigned' ELSE {_PREFIXED} END AS taxon"


def _sql_merge(consensus: str) -> str:
    return _with(V.SQL_TAXONOMY, V.SQL_OBSERVED, _MERGE_ROWS, consensus) + _LABELLED + " FROM out"


def _sql_best(worth: str) -> str:
    both = f"""rows AS (SELECT feature_id AS g, {_STRIP} AS parts, n_chars, 0 AS o FROM taxonomy UNION ALL SELECT feature_id, {_STRIP}, n_chars, 1 FROM observed),
best AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY {worth} DESC, o DESC) AS r FROM rows)"""
    return _with(V.SQL_TAXONOMY, V.SQL_OBSERVED, both) + _LABELLED + ', n_chars AS "N_chars" FROM best WHERE r = 1'


def _sql_seq(where: str = "TRUE", seq: str = "seq", source: str = V.SQL_SEQUENCES, name: str = "sequences") -> str:
    return _with(source) + f"SELECT id, {seq} AS seq FROM {name} WHERE {where}"


_RUNS = "|".join(f"{c}{{8,}}" for c in "ACGTURYSWKMBDHVN")
_TURNED = "reverse(translate(seq, 'ACGTURYSWKMBDHVN', 'TGCAAYRSWMKVHDBN'))"


def _sql_by_taxon(negate: str) -> str:
    lows = ", ".join(f"CASE WHEN contains(taxon, '{x}') THEN {n} END" for x, n in zip(_LABELS, _MIN, strict=True))
    highs = ", ".join(f"CASE WHEN contains(taxon, '{x}') THEN {n} END" for x, n in zip(_LABELS, _MAX, strict=True))
    fits = f"length(seq) >= greatest({lows}, 20) AND length(seq) <= least({highs}, 12000)"
    return _with(V.SQL_SEQUENCES, V.SQL_TAXONOMY) + f"SELECT id, seq FROM sequences JOIN taxonomy ON id = feature_id WHERE {negate}({fits})"


_DEPTH = """, d AS (SELECT len(list_filter(string_split(taxon, ';'), lambda x: trim(x) <> '')) AS level, count(*) AS c FROM taxonomy GROUP BY 1),
s AS (SELECT unnest(generate_series(0, (SELECT max(level) FROM d))) AS level),
e AS (SELECT s.level, coalesce(c, 0) AS n FROM s LEFT JOIN d ON s.level = d.level),
w AS (SELECT level, n, coalesce(sum(n) OVER (ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM e)
SELECT level, CAST(n AS BIGINT) AS n_terminating, round(n / total, 6) AS p_terminating, CAST(total - before AS BIGINT) AS n_classified,
 round((total - before) / total, 6) AS p_classified, CAST(before AS BIGINT) AS n_unclassified, round(before / total, 6) AS p_unclassified FROM w WHERE level > 0"""
_ENTROPY = """, p AS (SELECT list_filter(list_transform(string_split(taxon, ';'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM taxonomy),
l AS (SELECT unnest(generate_series(1, (SELECT max(len(parts)) FROM p))) AS level),
c AS (SELECT level, array_to_string(parts[1:level], ';') AS path, count(*) AS n FROM p, l GROUP BY 1, 2)
SELECT level, count(*) AS unique_labels, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) AS entropy FROM c GROUP BY 1"""
_RECALL = """, pairs AS (SELECT string_split(t.taxon, ';') AS e, string_split(o.taxon, ';') AS o FROM taxonomy t JOIN observed o USING (feature_id)),
l AS (SELECT unnest(generate_series(1, (SELECT max(greatest(len(e), len(o))) FROM pairs))) AS level),
x AS (SELECT level, array_to_string(e[1:level], ';') AS e, array_to_string(o[1:level], ';') AS o FROM pairs, l),
y AS (SELECT level, sum(CASE WHEN e = o THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN e <> o THEN 1 ELSE 0 END) AS fn,
 sum(CASE WHEN e <> o AND NOT starts_with(e, o) AND o NOT IN ('Unclassified', 'Unassigned', 'No blast hit', 'other') THEN 1 ELSE 0 END) AS fp FROM x GROUP BY 1)
SELECT level, 'docs' AS dataset, CASE WHEN tp = 0 THEN 0.0 ELSE round(tp / (tp + fp), 6) END AS precision,
 CASE WHEN tp = 0 THEN 0.0 ELSE round(tp / (tp + fn), 6) END AS recall, CASE WHEN tp = 0 THEN 0.0 ELSE round(2 * tp / (2 * tp + fp + fn), 6) END AS f_measure FROM y"""
_STATS = """, q AS (SELECT quantile_cont(length(seq), [0, 0.01, 0.25, 0.5, 0.75, 0.99, 1]) AS q FROM sequences),
u AS (SELECT count(*) AS n FROM sequences GROUP BY seq),
k AS (SELECT id, lower(substr(seq, i, 4)) AS word, count(*) AS n FROM (SELECT id, seq, unnest(generate_series(1, length(seq) - 3)) AS i FROM sequences) GROUP BY 1, 2),
v AS (SELECT word, sum(n / norm) AS w FROM (SELECT word, n, sqrt(sum(n * n) OVER (PARTITION BY id)) AS norm FROM k) GROUP BY 1)
SELECT round_even(q[1], 2) AS length_min, round_even(q[2], 2) AS length_p1, round_even(q[3], 2) AS length_p25, round_even(q[4], 2) AS length_median,
 round_even(q[5], 2) AS length_p75, round_even(q[6], 2) AS length_p99, round_even(q[7], 2) AS length_max, (SELECT count(*) FROM u) AS n_unique,
 (SELECT round_even(ln(sum(n)) - sum(n * ln(n)) / sum(n), 2) FROM u) AS seq_entropy,
 (SELECT round_even(ln(sum(w)) - sum(w * ln(w)) / sum(w), 2) FROM v) AS kmer_entropy_4, 'docs' AS dataset FROM q"""
_HITS = """, ref AS (SELECT DISTINCT substr(seq, i, 12) AS word FROM (SELECT seq, unnest(generate_series(1, length(seq) - 11)) AS i FROM segments)),
strands AS (SELECT id, '+' AS strand, seq FROM sequences UNION ALL SELECT id, '-', reverse(translate(seq, 'ACGTURYSWKMBDHVN', 'TGCAAYRSWMKVHDBN')) FROM sequences),
words AS (SELECT DISTINCT id, strand, substr(seq, i, 12) AS word FROM (SELECT id, strand, seq, unnest(generate_series(1, length(seq) - 11)) AS i FROM strands)),
h AS (SELECT id, sum(CASE WHEN strand = '+' THEN 1 ELSE 0 END) AS f, sum(CASE WHEN strand = '-' THEN 1 ELSE 0 END) AS b FROM words SEMI JOIN ref USING (word) GROUP BY 1),
a AS (SELECT s.id, CAST(coalesce(f, 0) AS BIGINT) AS forward, CAST(coalesce(b, 0) AS BIGINT) AS backward FROM sequences s LEFT JOIN h ON s.id = h.id)
SELECT id, CASE WHEN forward >= 1 AND forward >= 4 * backward THEN '+' WHEN backward >= 1 AND backward >= 4 * forward THEN '-' ELSE '?' END AS strand, forward, backward FROM a"""
_GENUS = """WITH x AS (SELECT CAST(p_partkey AS VARCHAR) AS feature_id, p_type AS family, CASE WHEN p_size > 25 THEN string_split(p_name, ' ')[1] END AS genus,
 CASE WHEN p_size > 25 THEN p_name ELSE p_brand || ' ' || p_name END AS species FROM part),
y AS (SELECT feature_id, family, CASE WHEN genus IS NULL AND contains(species, ' ') THEN string_split(species, ' ')[1] ELSE genus END AS genus,
 CASE WHEN genus IS NULL AND contains(species, ' ') THEN substr(species, instr(species, ' ') + 1)
  WHEN starts_with(species, genus || ' ') THEN substr(species, length(genus) + 2) ELSE species END AS species FROM x)
SELECT feature_id, 'k__; f__' || family || '; g__' || coalesce(genus, family) || '; s__' || species AS taxon FROM y"""

_CLEAN = "regexp_replace({}, '\\s+', '_', 'g')"
_SILVA = f"""SELECT c_custkey || '.1.9' AS feature_id, 'd__' || {_CLEAN.format('r_name')} || '; p__' || {_CLEAN.format('n_name')} || '; c__' || {_CLEAN.format('n_name')}
 || '; o__' || {_CLEAN.format('n_name')} || '; f__' || {_CLEAN.format('c_mktsegment')} || '; g__' || {_CLEAN.format('c_mktsegment')}
 || '; s__' || regexp_replace(c_name, '[^0-9A-Za-z_\\-\\[\\]()/.]', '', 'g') AS taxon
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def _sql_evaluated(table: str, label: str) -> str:
    named = f"WITH {V.SQL_TAXONOMY}, {V.SQL_OBSERVED}, t AS (SELECT taxon FROM {table})"
    depth, kinds = (named + x.replace("FROM taxonomy", "FROM t") for x in (_DEPTH, _ENTROPY))
    return f"SELECT *, '{label}' AS dataset FROM ({kinds}) JOIN ({depth}) USING (level)"


ORACLE_SQL = {
    "derep_lca": _sql_derep(_LCA),
    "derep_super": _sql_derep(_SUPER),
    "derep_majority": _with(
        V.SQL_SEQUENCES, V.SQL_TAXONOMY, _CENTRES, _TAXA_ROWS,
        "c AS (SELECT centroid, taxon, count(*) AS n FROM members JOIN tidy ON feature_id = id GROUP BY 1, 2)",
        "m AS (SELECT centroid, arg_min(taxon, {'n': -n, 't': taxon}) AS taxon FROM c GROUP BY 1)",
        "p AS (SELECT centroid, string_split(taxon, ';') AS parts FROM m)",
    ) + f"SELECT centroid AS feature_id, {_BACKFILL} AS taxon FROM p",
    "derep_prefix": _sql_derep(_LCA, "moved", _PREFIX),
    "derep_uniq": _UNIQ + f"SELECT feature_id, {_BACKFILL} AS taxon FROM (SELECT feature_id, string_split(taxon, ';') AS parts FROM tidy SEMI JOIN kept ON id = feature_id)",
    "derep_seqs": _UNIQ + "SELECT id, seq FROM sequences SEMI JOIN kept USING (id)",
    "merge_len": _sql_best("len(list_distinct(list_filter(parts, lambda x: x <> '')))"),
    "merge_score": _sql_best("n_chars"),
    "merge_lca": _sql_merge(_LCA),
    "merge_super": _sql_merge(_SUPER),
    "merge_majority": _sql_merge(_MAJORITY),
    "cull_seqs": _sql_seq(f"length(regexp_replace(seq, '[^RYSWKMBDHVN]', '', 'g')) < 5 AND NOT regexp_matches(seq, '{_RUNS}')"),
    "degap_seqs": _sql_seq("length(replace(replace(seq, '-', ''), '.', '')) >= 5", "replace(replace(seq, '-', ''), '.', '')", V.SQL_GAPPED, "gapped"),
    "reverse_transcribe": _sql_seq("TRUE", "replace(replace(seq, 'U', 'T'), 'u', 't')", V.SQL_GAPPED, "gapped"),
    "orient_noref": _sql_seq("TRUE", _TURNED),
    "revcomp_relabel": _with(V.SQL_SEQUENCES) + f"SELECT md5({_TURNED}) AS id, {_TURNED} AS seq FROM sequences",
    "filter_len": _sql_seq("length(seq) BETWEEN 100 AND 3000"),
    "discard_len": _sql_seq("length(seq) NOT BETWEEN 100 AND 3000"),
    "filter_len_taxon": _sql_by_taxon(""),
    "discard_len_taxon": _sql_by_taxon("NOT "),
    "filter_taxa": _with(V.SQL_TAXONOMY) + """SELECT feature_id, taxon FROM taxonomy WHERE (regexp_matches(taxon, 'd__en|p__src1$') AND NOT regexp_matches(taxon, 't1$|q0'))
 OR feature_id IN (SELECT CAST(item_id AS VARCHAR) FROM benchmark)""",
    "edit_taxonomy": _with(V.SQL_CUSTOMERS) + r"""SELECT feature_id, replace(regexp_replace(regexp_replace(taxon, 'NATION_(\d)\b', 'N0\1', 'g'), '^r__A', 'r__a'), 's__', 'segment=') AS taxon
 FROM customers""",
    "taxonomy_depth": _with(V.SQL_TAXONOMY).rstrip() + _DEPTH,
    "taxonomy_entropy": _with(V.SQL_TAXONOMY).rstrip() + _ENTROPY,
    "precision_recall": _with(V.SQL_TAXONOMY, V.SQL_OBSERVED).rstrip() + _RECALL,
    "seq_stats": _with(V.SQL_SEQUENCES).rstrip() + _STATS,
    "rank_propagation": """SELECT CAST(doc_id AS VARCHAR) AS feature_id, 'd__' || lang || '; p__' || coalesce('q' || quality, lang) || '; c__' || coalesce('t' || toxic, 'q' || quality, lang)
 || '; o__' || coalesce('t' || toxic, 'q' || quality, lang) AS taxon FROM documents LEFT JOIN labels USING (doc_id)""",
    "backfill": _with(V.SQL_TAXONOMY) + f"SELECT feature_id, {_BACKFILL} AS taxon FROM (SELECT feature_id, {_TIDY} AS parts FROM taxonomy)",
    "pr2_split": "SELECT CAST(doc_id AS VARCHAR) AS feature_id, 'd__' || x || ';c__' || x || ';s__' || x AS taxon FROM (SELECT doc_id, lang || '_' || source AS x FROM documents)",
    "gtdb_header": "SELECT CAST(doc_id AS VARCHAR) AS feature_id, 'd__' || lang || ';s__' || source AS taxon FROM documents",
    "eukaryome_header": "SELECT 'EUK' || doc_id AS feature_id, 'k__' || lang || ';p__' || source AS taxon FROM documents",
    "genus_species_split": _GENUS,
    "tree_ancestors": "WITH RECURSIVE " + V.SQL_TREE + """, a AS (SELECT node_id, node_id AS ancestor_id, 0 AS distance FROM tree
 UNION ALL SELECT a.node_id, t.parent_id, a.distance + 1 FROM a JOIN tree t ON t.node_id = a.ancestor_id WHERE t.parent_id IS NOT NULL) SELECT * FROM a""",
    "orient_hits": _with(V.SQL_SEQUENCES, V.SQL_SEGMENTS).rstrip() + _HITS,
    "orient_seqs": f"WITH h AS ({_with(V.SQL_SEQUENCES, V.SQL_SEGMENTS).rstrip()}{_HITS}), {V.SQL_SEQUENCES} "
    f"SELECT id, CASE WHEN strand = '-' THEN {_TURNED} ELSE seq END AS seq FROM sequences JOIN h USING (id) WHERE strand <> '?'",
    "parse_silva": _SILVA,
    "evaluate_taxonomy": f"{_sql_evaluated('taxonomy', 'whole')} UNION ALL BY NAME {_sql_evaluated('observed', 'observed')}",
    "segment_candidates": _with(V.SQL_SEQUENCES, V.SQL_SEGMENTS).rstrip() + """,
w AS MATERIALIZED (SELECT id, unnest(list_distinct(list_transform(range(1, length(seq) - 6), lambda i: substr(seq, i, 8)))) AS word FROM sequences),
r AS MATERIALIZED (SELECT id AS b, unnest(list_distinct(list_transform(range(1, length(substr(seq, 21, 60)) - 6), lambda i: substr(substr(seq, 21, 60), i, 8)))) AS word FROM segments),
g AS (SELECT * FROM r WHERE regexp_full_match(word, '[ACGT]{8}')),
s AS (SELECT id, b, count(*) AS shared FROM w JOIN g USING (word) GROUP BY id, b),
n AS (SELECT b, count(*) AS n FROM g GROUP BY b)
SELECT id, b, shared FROM s JOIN n USING (b) WHERE shared >= least(12, n) QUALIFY row_number() OVER (PARTITION BY id ORDER BY shared DESC, b) <= 32""",
    "ncbi_lineages": """WITH r AS (SELECT c_custkey AS k, c_mktsegment AS m, r_name, n_name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || ' ' || c_name ELSE c_name END AS o
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
s AS (SELECT *, CASE WHEN k % 3 <> 0 THEN m WHEN contains(o, ' ') THEN substr(o, 1, strpos(o, ' ') - 1) ELSE '' END AS g,
 CASE WHEN k % 3 <> 0 AND starts_with(o, m || ' ') THEN substr(o, length(m) + 2) WHEN k % 3 = 0 AND contains(o, ' ') THEN substr(o, strpos(o, ' ') + 1) ELSE o END AS e FROM r),
t AS (SELECT k, 'k__' || r_name || '; p__' || n_name || '; g__' || g || '; s__' || e AS taxon FROM s)
SELECT CAST(k AS VARCHAR) AS taxid, taxon FROM t UNION ALL SELECT 'old' || k, taxon FROM t""",
    "features_with_sequences": _with(V.SQL_SEQUENCES) + """SELECT CAST(ord % 7 AS VARCHAR) AS genome_id, id AS feature_id, seq FROM sequences
WHERE md5(seq) IN (SELECT md5(seq) FROM sequences WHERE ord % 3 <> 0)""",
    "sample_exact": _with(V.SQL_SEQUENCES) + """SELECT id, seq FROM (SELECT id, seq, row_number() OVER (ORDER BY substr(md5('7:' || id), 1, 13), id) AS place, count(*) OVER () AS n FROM sequences)
WHERE place <= CAST(floor(0.3 * n) AS BIGINT)""",
    "subsample": _sql_seq("CAST('0x' || substr(md5('7:' || id), 1, 13) AS BIGINT) / 4503599627370496.0 < 0.3"),
}
