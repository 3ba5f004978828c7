"""Exact k-means over whole numbers, screened in single precision.

Method: float32 screening with rigorous rounding-error intervals. The squared distance of
a vector x to a centroid c is |x|^2 - 2 x.c + |c|^2, and |x|^2 plays no part in which one
is nearest. One float32 product of matrices gives all x.c of a batch. By the standard bound
for a dot product of n terms, in any order of summation and with both sides rounded to
float32 before, each of them is off by at most g |x| |c| with g = (n + 4) u / (1 - (n + 4) u)
and u = 2**-24; so each |c|^2 - 2 x.c lies in an interval known beforehand. Centroids whose
interval begins beyond the least end of all intervals cannot be nearest. Where more than
one is left, their distances are computed anew in whole numbers, and the smallest number
wins a tie.

Vectors are dealt as Spark reads them; of each round the driver gets sums of k x dim whole
numbers, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_table
from .vectors import matrix

#: Magnitude at which components are held, so that a squared distance fits a long.
HELD = 1 << 27
#: Vectors screened together.
CHUNK = 4096


def screen(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which centroids can be nearest, a row of booleans for each vector (whole numbers)."""
    n = x.shape[1]
    g = (n + 4) * 2.0**-24
    g /= 1 - g
    xf, cf = x.astype(np.float64), c.astype(np.float64)
    norm_x, norm_c = np.sqrt((xf * xf).sum(1)), np.sqrt((cf * cf).sum(1))
    dot = (x.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    middle = norm_c**2 - 2 * dot
    # Twice the bound of the product; beside it, double precision errs by far less than 2**-40.
    width = norm_x[:, None] * norm_c * (2 * g + 2.0**-40) + norm_c**2 * 2.0**-40
    return middle - width <= (middle + width).min(axis=1)[:, None]


def nearest(x: np.ndarray, c: np.ndarray, counts: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The number of each vector's nearest centroid (ties: the smallest) and their squared
    distance; x and c are whole numbers below HELD in magnitude."""
    number, distance = np.empty(len(x), dtype=np.int32), np.empty(len(x), dtype=np.int64)
    for at in range(0, len(x), CHUNK):
        part = x[at : at + CHUNK]
        can = screen(part, c)
        alone = can.sum(axis=1) == 1
        best = can.argmax(axis=1)
        i, j = np.nonzero(can & ~alone[:, None])
        if len(i):
            exact = ((part[i] - c[j]) ** 2).sum(axis=1)
            order = np.lexsort((j, exact, i))
            first = order[np.r_[True, i[order][1:] != i[order][:-1]]]
            best[i[first]] = j[first]
        number[at : at + CHUNK] = best
        distance[at : at + CHUNK] = ((part - c[best]) ** 2).sum(axis=1)
        if counts is not None:
            counts["pairs"] = counts.get("pairs", 0) + can.size
            counts["exact"] = counts.get("exact", 0) + len(i)
    return number, distance


def _sums(c: np.ndarray):
    """Of each task, for every centroid its vectors' number and componentwise sums."""
    k, dim = c.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, dtype=np.int64), np.zeros((k, dim), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch, "v").astype(np.int64)
                number = nearest(x, c)[0]
                order = np.argsort(number, kind="stable")
                found, first = np.unique(number[order], return_index=True)
                n += np.bincount(number, minlength=k)
                total[found] += np.add.reduceat(x[order], first, axis=0)
        has = np.flatnonzero(n)
        place = np.tile(np.arange(dim, dtype=np.int32), len(has))
        columns = [np.repeat(has.astype(np.int32), dim), place, np.repeat(n[has], dim), total[has].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["cluster", "place", "n", "total"])

    return run


def _assigned(c: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                number, distance = nearest(matrix(batch, "v").astype(np.int64), c)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def kept(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """vec_id (long), v (array of int) of the vectors that take part, written once."""
    v = F.col("embedding").cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), v.alias("v")).where((F.size("v") == dim) & F.forall("v", fine))
    held = lambda x: F.least(F.greatest(F.floor(x * scale), F.lit(-HELD)), F.lit(HELD)).cast("int")
    return write_table(rows.select("vec_id", F.transform("v", held).alias("v")))


def starts(rows: DataFrame, k: int) -> np.ndarray:
    """The vectors of the k rows with the smallest sha256 of 2:<vec_id>."""
    key = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    first = rows.select(key.alias("key"), "v").orderBy(F.asc_nulls_last("key"), "v").limit(k).collect()
    return np.array([r["v"] for r in first], dtype=np.int64)


def fit(rows: DataFrame, c: np.ndarray, rounds: int) -> np.ndarray:
    """The centroids after so many rounds over rows (column v)."""
    for _ in range(rounds):
        parts = rows.select("v").mapInArrow(_sums(c), "cluster int, place int, n long, total long")
        sums = parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        c = c.copy()
        for r in sums.collect():  # k x dim rows at most
            c[r["cluster"], r["place"]] = int(r["total"]) // r["n"]
    return c


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256) -> DataFrame:
    """vec_id, cluster (int), distance (long, squared), cluster_inertia, inertia (long),
    centroid_sha256 of each vector that takes part.

    Vectors of exactly dim components, none null or non-finite, take part, with components
    floor(scale * x), held to 2**27 in magnitude. Centroids start as the k such rows of the
    smallest sha256 of `2:<vec_id>`, in that order (rows of one vec_id by their vectors; a
    null vec_id comes last); with fewer than k rows there are as many centroids. In each
    round every vector goes to its nearest centroid (ties: the smaller number) and every
    centroid that has vectors becomes the floor of their exact mean. Equal vectors are told
    apart by nothing: of equal centroids all but the first stay empty and as they are.
    Repeated rows are repeated; an empty table gives no rows; an inertia beyond a long is
    null; further columns are ignored.
    """
    rows = kept(vectors, dim, scale)
    c = starts(rows, k)
    schema = "vec_id long, cluster int, distance long"
    if not len(c):
        none = rows.where("false").select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return none.select("*", *(F.lit(0).cast("long").alias(n) for n in ("cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
    c = fit(rows, c, rounds)
    found = write_table(rows.mapInArrow(_assigned(c), schema))
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()  # k rows at most
    fits = lambda x: x if x < 1 << 63 else None
    whole = fits(sum(int(r["own"]) for r in sums))
    digest = lambda j: hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()
    facts = [(r["cluster"], fits(int(r["own"])), whole, digest(r["cluster"])) for r in sums]
    facts = found.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256) -> str:
    """SQL for cluster() over the table embeddings, one set of subqueries a round."""
    distance = "CAST(list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    parts = [
        f"""WITH x AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)) NULLS LAST, v) - 1 AS n, v FROM x
 QUALIFY n < {k})""",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, n := n)) AS best FROM (SELECT x.r, c.n, {distance} AS d FROM x, c{i} c) GROUP BY r)""")
        if i < rounds:
            parts.append(f"""m{i} AS (SELECT n, list((s - ((s % many) + many) % many) // many ORDER BY place) AS v FROM (
 SELECT n, place, sum(e) AS s, count(*) AS many FROM (SELECT a.best.n AS n, unnest(x.v) AS e, generate_subscripts(x.v, 1) AS place FROM x JOIN a{i} a USING (r)) GROUP BY n, place) GROUP BY n)""")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.n, coalesce(CAST(m.v AS BIGINT[]), c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (n))")
    return ",\n".join(parts) + f"""
SELECT vec_id, CAST(a.best.n AS INTEGER) AS cluster, a.best.d AS distance, CAST(sum(a.best.d) OVER (PARTITION BY a.best.n) AS BIGINT) AS cluster_inertia,
 CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM x JOIN a{rounds} a USING (r) JOIN c{rounds} c ON c.n = a.best.n"""
