"""Nearest neighbours by a block matrix join on int8 vectors.

Query blocks and candidate blocks meet in tiles. In a tile both sides are rounded to int8; their integer product gives every
score up to a proven error: |<x,y> - <x',y'>| <= |x - x'| |y| + |x'| |y - y'|. Only pairs whose upper bound reaches the
query's k-th largest lower bound are computed again in double precision, and a heap per query keeps the tile's k best. The tiles'
lists are merged by a per-query top-k. The result is exact.

Traffic: a candidate is sent once per query block, a query once per candidate block; memory in a task is one tile. Both block sizes are
parameters, so tiles stay the same size whatever the tables hold.

Defined results. Rows with a null id, and vectors that are null, empty, all zero or hold a null or non-finite number, take no
part. Components of any finite size are compared: tiles whose squares would leave the range of doubles are computed in full, and a score beyond that range
is infinite. Only vectors of equal length are compared. Equal scores go to the smaller id. Of repeated ids the best score counts, and a
query never meets rows of its own id. Fewer than k candidates give as many rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMALLEST, LARGEST = 1e-140, 1e140  # of a vector's largest component: squares and products between stay in the range of doubles
DIMENSIONS_AT_ONCE = 1_024  # a sum of so many products of int8 values is exact in float32
PAIRS_AT_ONCE = 200_000


def usable(rows: DataFrame, is_query: Column, row_id: str, vector: str) -> DataFrame:
    """(id, v, asks) of the distinct rows that take part."""
    v = F.col(vector)
    broken = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col(row_id).isNotNull() & v.isNotNull() & ~broken & F.exists(v, lambda x: x != 0)).select(F.col(row_id).alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).distinct()


def _rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, their scale, and the lengths of the rounded vector and of the rounding error."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    rounded = codes * scale[:, None]
    return codes, scale, np.linalg.norm(rounded, axis=1), np.linalg.norm(x - rounded, axis=1)


def _exponents(x: np.ndarray) -> np.ndarray:
    """Per row the power of two above its largest component."""
    return np.frexp(np.abs(x).max(axis=1))[1]


def _extreme(x: np.ndarray) -> bool:
    largest = np.abs(x).max(axis=1)
    return bool(largest.min() < SMALLEST or largest.max() > LARGEST)


def _whole_tile(k: int, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """As `_tile`, for numbers whose squares leave the range of doubles: every pair in double precision, of vectors scaled by powers of two."""
    up, across = _exponents(queries), _exponents(rows)
    scaled = np.ldexp(rows, -across[:, None])
    for query, vector, e in zip(query_ids.tolist(), np.ldexp(queries, -up[:, None]), up, strict=True):
        with np.errstate(over="ignore", under="ignore"):
            scores = np.ldexp(np.einsum("j,ij->i", vector, scaled), e + across)
        best: dict[int, float] = {}
        for score, row in zip(scores.tolist(), ids.tolist(), strict=True):
            if row != query:
                best[row] = max(best.get(row, -np.inf), score)
        for negative, row in heapq.nsmallest(k, ((-score, row) for row, score in best.items())):
            yield query, row, -negative


def _tile(k: int, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """The k best (query, candidate, score) of each query within a tile."""
    if _extreme(queries) or _extreme(rows):
        yield from _whole_tile(k, query_ids, queries, ids, rows)
        return
    qc, qs, ql, qe = _rounded(queries)
    cc, cs, cl, ce = _rounded(rows)
    product = np.zeros((len(queries), len(rows)), np.float64)
    for a in range(0, queries.shape[1], DIMENSIONS_AT_ONCE):
        part = slice(a, a + DIMENSIONS_AT_ONCE)
        product += qc[:, part].astype(np.float32) @ cc[:, part].astype(np.float32).T
    product *= qs[:, None]
    product *= cs
    error = (qe[:, None] * (cl + ce) + ql[:, None] * ce) * (1 + 1e-9) + 1e-12 * (ql + qe)[:, None] * (cl + ce)
    own = query_ids[:, None] == ids
    lower = np.where(own, -np.inf, product - error)
    if len(ids) > k and len(np.unique(ids)) == len(ids):
        bar = np.partition(lower, len(ids) - k, axis=1)[:, len(ids) - k]
    else:
        bar = np.full(len(queries), -np.inf)
    at, candidate = np.nonzero((product + error >= bar[:, None]) & ~own)
    scores = np.empty(len(at))
    for a in range(0, len(at), PAIRS_AT_ONCE):
        part = slice(a, a + PAIRS_AT_ONCE)
        scores[part] = np.einsum("ij,ij->i", queries[at[part]], rows[candidate[part]])
    begins = np.searchsorted(at, np.arange(len(queries) + 1))
    for q in range(len(queries)):
        part = slice(begins[q], begins[q + 1])
        best: dict[int, float] = {}
        for score, row in zip(scores[part].tolist(), ids[candidate[part]].tolist(), strict=True):
            best[row] = max(best.get(row, -np.inf), score)
        for negative, row in heapq.nsmallest(k, ((-score, row) for row, score in best.items())):
            yield int(query_ids[q]), row, -negative


def nearest(rows: DataFrame, is_query: Column, k: int = 20, row_id: str = "vec_id", vector: str = "embedding", query_block: int = 1_024, row_block: int = 4_096) -> DataFrame:
    """(query_id, rank, row_id, score): the k rows with the largest inner product for each row where `is_query` holds.

    `row_id` is a whole number; `is_query` a condition on the columns of `rows`, null meaning no.
    """
    marked = usable(rows, is_query, row_id, vector).withColumn("length", F.size("v"))
    n_rows, n_queries = marked.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    across, down = max(1, -(-n_queries // query_block)), max(1, -(-n_rows // row_block))
    queries = marked.filter("asks")
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("a", block(across)).withColumn("b", every(down))
    right = marked.withColumn("b", block(down)).withColumn("a", every(across))

    def compare(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(c):
            stacked = [np.stack(x["v"].to_numpy()).astype(np.float64) for x in (q, c)]
            found = list(_tile(k, q["id"].to_numpy(np.int64), stacked[0], c["id"].to_numpy(np.int64), stacked[1]))
        return pd.DataFrame(found, columns=["query_id", "row", "score"]).astype({"query_id": "int64", "row": "int64", "score": "float64"})

    tiles = left.groupBy("length", "a", "b").cogroup(right.groupBy("length", "a", "b")).applyInPandas(compare, "query_id long, row long, score double")
    once = tiles.groupBy("query_id", "row").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "row")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("row").alias(row_id), "score")
