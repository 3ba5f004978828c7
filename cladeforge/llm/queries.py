"""One query per corpus operator, over its whole table, and the SQL that matches it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, centroids, crosstok, hmm, langid, linededup, minhash, packing, pii, quality, simhash, spm, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; documents are dealt out to all cores where they lie in fewer files."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name == "documents" and len(rows.inputFiles()) < cores else rows


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(_table(spark, sf_dir, "documents"), words=3, radius=2)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), k=20, every=20)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.extract(_table(spark, sf_dir, "documents"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), k=5, every=50)


def op5_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.round_trip(_table(spark, sf_dir, "documents"))


def op10_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(_table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"), k=40, rounds=5)


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.components(_table(spark, sf_dir, "documents"), words=5, percent=85)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstok.alignments(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash,
        op2_topk,
        op3_pii,
        op4_ann,
        op5_linededup,
        op6_quality,
        op7_langid,
        op8_packing,
        op9_sentencepiece,
        op10_hmm,
        op11_centroids,
        op12_minhash,
        op13_alignment,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op11_centroids": centroids.oracle(),
    "op12_minhash": minhash.oracle(),
    "op2_topk": """WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(floor(64 * CAST(v AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
 FROM x q JOIN x c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
}
