"""The corpus pipeline over the table documents.

Stages: quality selection, removal of repeated passages, one document of each group of
near copies, redaction of personal data, packing into training sequences. Each takes
(spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeforge.llm import linededup, packing, pii, quality, simhash
from cladeforge.llm.common import drop_since, write_table, written_tables

#: Jaccard similarity of five-word shingles from which texts are near copies.
SIMILARITY = 0.8


def _counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars, where there is one, as the length of the text as it is now."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.select(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(linededup.without_repeats(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(docs, similarity=SIMILARITY)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(pii.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("redact_pii", redact_pii),
    ("pack", pack),
]

#: Several stages have no form in SQL; tests/llm/test_pipeline.py has a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs the stages in turn; what one wrote for itself is removed when its result is
    written (but for the last, whose tables the returned rows are read from)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        mark = written_tables()
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = write_table(docs)
            drop_since(spark, mark if name == STAGES[0][0] else mark - 1, docs)  # the stage's input, too
    return docs
