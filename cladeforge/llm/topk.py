"""Exact top-k search by integer inner product.

Method: multi-resolution segment statistics. With the means m and deviations s of the
segments of two vectors (length L), the inner product is at most the sum over segments
of L (m m' + s s'). The bound is taken coarse to fine; candidates whose bound lies under
the k-th best score found so far are dropped, each level looks only at what the one before
left, and only the rest are compared exactly: pair by pair where few are left, and where
more than DENSE of a chunk are, by one product of it, of which the others' results are
thrown away. On vectors without structure (white noise), whose means and deviations say
little, the bounds leave most pairs at every level but the finest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors

#: Segments at each resolution.
LEVELS = (4, 16, 32)
#: Queries bounded together.
CHUNK = 128
#: Share of survivors from which pairs are bounded or compared as a product of matrices.
DENSE = 0.1


def _summary(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations, each times the root of its segment's length."""
    segments = min(segments, x.shape[1])
    edges = np.linspace(0, x.shape[1], segments + 1).astype(int)
    size = np.diff(edges)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / size
    square = np.add.reduceat(x * x, edges[:-1], axis=1) / size
    deviation = np.sqrt(np.maximum(square - mean * mean, 0))
    return np.hstack([mean, deviation]) * np.sqrt(np.hstack([size, size]))


def _pairwise(q: np.ndarray, c: np.ndarray, qi: np.ndarray, ci: np.ndarray) -> np.ndarray:
    out = np.empty(len(qi), dtype=q.dtype)
    for at in range(0, len(qi), 100_000):
        s = slice(at, at + 100_000)
        out[s] = np.einsum("ij,ij->i", q[qi[s]], c[ci[s]])
    return out


def block_search(q, q_rows, c, c_ids, c_rows, k: int, counts: dict | None = None):
    """The k best candidates of each query in one block; q and c are whole numbers."""
    qf, cf = q.astype(np.float64), c.astype(np.float64)
    largest = np.sqrt((qf**2).sum(1).max() * (cf**2).sum(1).max())
    slack = 1e-9 * largest + 1e-6
    whole = largest < 2**52  # then products and their sums are exact in double precision
    sums_q, sums_c = ([_summary(x, n) for n in LEVELS] for x in (qf, cf))
    means_q, means_c = (x[-1][:, : x[-1].shape[1] // 2] for x in (sums_q, sums_c))
    found = []
    seeds = min(len(c), 4 * k + 1)
    for at in range(0, len(q), CHUNK):
        part = slice(at, at + CHUNK)
        own = q_rows[part][:, None] == c_rows[None, :]
        likely = means_q[part] @ means_c.T
        likely[own] = -np.inf
        first = np.argpartition(-likely, seeds - 1, axis=1)[:, :seeds]
        score = _pairwise(q, c, np.repeat(np.arange(at, at + len(first)), seeds), first.ravel()).reshape(first.shape)
        score = np.where(np.take_along_axis(own, first, 1), np.iinfo(np.int64).min, score)
        floor = np.sort(score, axis=1)[:, -k] if seeds >= k else np.full(len(first), np.iinfo(np.int64).min)
        bound = sums_q[0][part] @ sums_c[0].T
        alive = (bound >= floor[:, None] - slack) & ~own
        for level in range(1, len(LEVELS)):
            if alive.mean() < DENSE:
                qi, ci = np.nonzero(alive)
                finer = _pairwise(sums_q[level][part], sums_c[level], qi, ci)
                alive[qi, ci] = finer >= floor[qi] - slack
            else:
                cols = np.flatnonzero(alive.any(axis=0))
                finer = sums_q[level][part] @ sums_c[level][cols].T
                alive[:, cols] &= finer >= floor[:, None] - slack
        if counts is not None:
            counts["exact"] = counts.get("exact", 0) + int(alive.sum())
            counts["pairs"] = counts.get("pairs", 0) + alive.size
        if not alive.any():
            continue
        if alive.mean() < DENSE:
            qi, ci = np.nonzero(alive)
            score = _pairwise(q, c, qi + at, ci)
        else:
            cols = np.flatnonzero(alive.any(axis=0))
            exact = (qf[part] @ cf[cols].T).astype(np.int64) if whole else q[part] @ c[cols].T
            alive = alive[:, cols]
            if len(cols) > k:
                least = np.partition(np.where(alive, exact, np.iinfo(np.int64).min), -k, axis=1)[:, -k]
                alive = alive & (exact >= least[:, None])
            qi, ci = np.nonzero(alive)
            score, ci = exact[qi, ci], cols[ci]
        qi = qi + at
        kept = vectors.best(qi, ci, score, c_ids, k)
        found.append((qi[kept], ci[kept], score[kept]))
    if not found:
        found = [(np.zeros(0, dtype=np.int64),) * 3]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def top_k(table: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score (long): the k highest inner products of each query.

    Components become floor(scale * x). Queries are the rows whose vec_id is divisible
    by `every`; candidates are all rows but the query's own, so a repeated vec_id is a
    query, and a candidate, once for each row. Ties go to the smaller vec_id. Rows that
    vectors.usable() drops take no part, and a query meets the candidates of its own
    length; an empty table gives no rows; further columns are ignored. |floor(scale * x)| must stay below 2**28 for scores to fit a long.
    """
    rows = vectors.usable(table).withColumn("v", F.transform("v", lambda x: F.floor(x * scale)))
    search = lambda q, qr, c, ids, cr: block_search(q, qr, c, ids, cr, k)
    return vectors.search(rows, F.col("vec_id") % every == 0, k, "long", search)
