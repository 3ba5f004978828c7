"""The core schemas derived from the driver's tables, in Spark and as SQL.

Texts become sequences by a letter mapping that yields bases, degenerate letters and a
gap letter; languages, sources and labels become ranks. Whole tables, whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS, MAPPED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTANGTACGTRCGTACGYAW"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of long texts is dealt out to all cores where it lies in fewer files."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name in LONG and len(rows.inputFiles()) < cores else rows


#: Tables of long texts, whose rows are worth dealing out (a file is a task's at least).
LONG = ("documents",)


def _seq(column: str):
    return F.translate(F.upper(F.regexp_replace(column, "[^A-Za-z]", "")), LETTERS, MAPPED)


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("id"), F.lit("").alias("description"), _seq("text").alias("seq"), F.col("doc_id").alias("ord"))


def gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose blanks and points are the gaps of aligned RNA."""
    docs = table(spark, sf_dir, "documents")
    rna = F.translate(F.upper(F.regexp_replace("text", "[^A-Za-z .]", "")), LETTERS + " ", MAPPED.replace("T", "U") + "-")
    return docs.select(F.col("doc_id").cast("string").alias("id"), F.lit("").alias("description"), rna.alias("seq"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    return items.select(F.col("item_id").cast("string").alias("id"), F.lit("").alias("description"), _seq("text").alias("seq"), F.col("item_id").alias("ord"))


def _lineage(toxic):
    return F.concat_ws(
        "; ",
        F.concat(F.lit("d__"), "lang"),
        F.concat(F.lit("p__"), "source"),
        F.concat(F.lit("c__q"), F.col("quality").cast("string")),
        F.concat(F.lit("o__t"), toxic.cast("string")),
    )


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four ranks of the labelled documents, two of the others; a second column n_chars."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.select(F.col("doc_id").cast("string").alias("feature_id"), _lineage(F.col("toxic")).alias("taxon"), F.col("n_chars").cast("double").alias("n_chars"))


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the labelled documents another last rank, or two ranks where quality is 0."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    short = F.concat_ws("; ", F.concat(F.lit("d__"), "lang"), F.concat(F.lit("p__"), "source"))
    taxon = F.when(F.col("quality") == 0, short).otherwise(_lineage(1 - F.col("toxic")))
    score = F.col("n_chars") * F.when(F.col("toxic") == 1, 2).otherwise(1)
    return docs.select(F.col("doc_id").cast("string").alias("feature_id"), taxon.alias("taxon"), score.cast("double").alias("n_chars"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    taxon = F.concat(F.lit("r__"), "r_name", F.lit("; n__"), "n_name", F.lit("; s__"), "c_mktsegment")
    return rows.select(F.col("c_custkey").cast("string").alias("feature_id"), taxon.alias("taxon"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root 1, regions, nations, customers."""
    n, r, c = (table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    key = lambda prefix, col: F.concat(F.lit(prefix), F.col(col).cast("string"))
    return (
        spark.range(1).select(F.lit("1").alias("node_id"), F.lit(None).cast("string").alias("parent_id"))
        .unionByName(r.select(key("r", "r_regionkey").alias("node_id"), F.lit("1").alias("parent_id")))
        .unionByName(n.select(key("n", "n_nationkey").alias("node_id"), key("r", "n_regionkey").alias("parent_id")))
        .unionByName(c.select(key("c", "c_custkey").alias("node_id"), key("n", "c_nationkey").alias("parent_id")))
    )


def silva(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tree, map and rank table: regions, nations and customers as domains, phyla and families."""
    n, r, c = (table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    key = lambda prefix, col: F.concat(F.lit(prefix), F.col(col).cast("string")).alias("taxid")
    ranked = lambda rows, taxid, rank, name: rows.select(F.concat(F.lit("x;"), name, F.lit(";")).alias("path"), taxid, F.lit(rank).alias("rank"))
    ranks = ranked(r, key("r", "r_regionkey"), "domain", "r_name").union(ranked(n, key("n", "n_nationkey"), "phylum", "n_name"))
    ranks = ranks.union(ranked(c, key("c", "c_custkey"), "family", "c_mktsegment"))
    taxmap = c.select(
        F.col("c_custkey").cast("string").alias("primaryAccession"), F.lit("1").alias("start"), F.lit("9").alias("stop"),
        F.col("c_name").alias("organism_name"), key("c", "c_custkey"),
    )
    return tree(spark, sf_dir), taxmap, ranks


_SQL_SEQ = f"translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{MAPPED}')"
SQL_SEQUENCES = f"sequences AS (SELECT CAST(doc_id AS VARCHAR) AS id, {_SQL_SEQ} AS seq, doc_id AS ord FROM documents)"
SQL_GAPPED = (
    "gapped AS (SELECT CAST(doc_id AS VARCHAR) AS id, translate(upper(regexp_replace(text, '[^A-Za-z .]', '', 'g')), "
    f"'{LETTERS} ', '{MAPPED.replace('T', 'U')}-') AS seq FROM documents)"
)
SQL_SEGMENTS = f"segments AS (SELECT CAST(item_id AS VARCHAR) AS id, {_SQL_SEQ} AS seq, item_id AS ord FROM benchmark)"


def _sql_lineage(toxic: str) -> str:
    return f"concat_ws('; ', 'd__' || lang, 'p__' || source, 'c__q' || CAST(quality AS VARCHAR), 'o__t' || CAST({toxic} AS VARCHAR))"


SQL_TAXONOMY = (
    f"taxonomy AS (SELECT CAST(doc_id AS VARCHAR) AS feature_id, {_sql_lineage('toxic')} AS taxon, CAST(n_chars AS DOUBLE) AS n_chars "
    "FROM documents LEFT JOIN labels USING (doc_id))"
)
SQL_OBSERVED = (
    "observed AS (SELECT CAST(doc_id AS VARCHAR) AS feature_id, CASE WHEN quality = 0 THEN concat_ws('; ', 'd__' || lang, 'p__' || source) "
    f"ELSE {_sql_lineage('1 - toxic')} END AS taxon, CAST(n_chars * CASE WHEN toxic = 1 THEN 2 ELSE 1 END AS DOUBLE) AS n_chars "
    "FROM documents JOIN labels USING (doc_id))"
)
SQL_CUSTOMERS = (
    "customers AS (SELECT CAST(c_custkey AS VARCHAR) AS feature_id, 'r__' || r_name || '; n__' || n_name || '; s__' || c_mktsegment AS taxon "
    "FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
)
SQL_TREE = (
    "tree AS (SELECT '1' AS node_id, CAST(NULL AS VARCHAR) AS parent_id UNION ALL SELECT 'r' || r_regionkey, '1' FROM region "
    "UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"
)
