"""What both vector searches share: usable rows, queries against rows in blocks, ranking."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import write_table

#: Rows of a block of queries, and of candidates, at most.
BLOCK_ROWS = 32_768
#: Candidates that are worth a block of their own where cores are free.
LEAST_ROWS = 1024


def usable(vectors: DataFrame, nonzero: bool = False) -> DataFrame:
    """row, vec_id, dim, v (array of double) of the rows that take part, written once.

    Rows with a null vec_id, a null vector, null or non-finite components take no part;
    nor do zero vectors if nonzero.
    """
    v = F.col("embedding").cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), v.alias("v")).where("vec_id is not null and v is not null")
    rows = rows.where(F.forall("v", fine))
    if nonzero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    return write_table(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.size("v").alias("dim"), "v"))


def matrix(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    column = table.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def in_blocks(queries: DataFrame, rows: DataFrame, k: int, score_type: str, block: Callable) -> DataFrame:
    """q_row, query_id, vec_id, c_row, score: of each query the k best of all rows of its
    length, and some more.

    Every query meets every such row exactly once, in a group of at most about BLOCK_ROWS
    x BLOCK_ROWS; rows are dealt to blocks by a hash of their place, so no value of any
    column can make a block larger than the others. block(queries, query_rows, candidates,
    candidate_ids, candidate_rows) returns query numbers, candidate numbers and scores of
    at least the k best candidates a query, ties to the smaller vec_id, itself (the same
    row) left out.
    """
    n, m = rows.count(), queries.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    q_blocks = max(1, math.ceil(m / BLOCK_ROWS))
    c_blocks = max(1, math.ceil(n / BLOCK_ROWS), min(cores, n // LEAST_ROWS))
    deal = lambda blocks: F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    spread = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = queries.select("dim", deal(q_blocks).alias("q"), spread(c_blocks).alias("c"), "row", "vec_id", "v")
    renamed = [F.col(name).alias(f"c_{name}") for name in ("row", "vec_id", "v")]
    right = rows.select("dim", deal(c_blocks).alias("c"), spread(q_blocks).alias("q"), *renamed)

    kind = pa.int64() if score_type == "long" else pa.float64()
    fields = [*((n, pa.int64()) for n in ("q_row", "query_id", "vec_id", "c_row")), ("score", kind)]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.schema(fields).empty_table()
        ids = lambda t, name: t.column(name).to_numpy()
        q_rows, c_rows, c_ids = ids(left, "row"), ids(right, "c_row"), ids(right, "c_vec_id")
        qi, ci, score = block(matrix(left, "v"), q_rows, matrix(right, "c_v"), c_ids, c_rows)
        values = q_rows[qi], ids(left, "vec_id")[qi], c_ids[ci], c_rows[ci], score
        return pa.table([pa.array(v, t) for v, (_, t) in zip(values, fields, strict=True)], schema=pa.schema(fields))

    key = ["dim", "q", "c"]
    schema = f"q_row long, query_id long, vec_id long, c_row long, score {score_type}"
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, schema)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: of each query's candidates the k best."""
    order = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id", "c_row")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def search(rows: DataFrame, is_query: Column, k: int, score_type: str, block: Callable) -> DataFrame:
    """query_id, rank, vec_id, score: of each query's candidates the k best."""
    return ranked(in_blocks(rows.where(is_query), rows, k, score_type, block), k)


def best(qi: np.ndarray, ci: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places, in the given arrays, of the k best of each query, ties to smaller ids."""
    order = np.lexsort((ids[ci], -score, qi))
    q = qi[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    return order[rank < k]
