"""Exact top-k search: exhaustive term-at-a-time accumulation.

Rows are sparse integer vectors (one term per component). Candidates are dealt
by hash into blocks of about ``BLOCK_ROWS``; every block meets every block of
``QUERY_ROWS`` queries in one task, which holds postings per term (rows and
weights) and one dense score array: each term of a query adds its weight times
the posting's weights into it, a partition selection keeps k rows, and the
blocks' results are merged per query. All candidates are scored, none is
pruned; memory per task is bounded by the two block sizes.

Vectors that are null or hold null or non-finite components take no part. Ties
go to the smaller id; repeated ids are candidates of their own, but no row is
found by a query of its own id. Query rows that repeat an id are ranked one by
one, so their id stands on several lists of ranks. Vectors of different lengths count as padded
with zeros. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import saved

BLOCK_ROWS = 8192
QUERY_ROWS = 2048


def usable(vector: str) -> Column:
    """Not null and all components finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True))


def quantized(vector: str, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def postings(vectors: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """term -> (rows, weights) of the weights that are not zero."""
    lengths = np.array([len(v) for v in vectors])
    rows = np.repeat(np.arange(len(vectors)), lengths)
    terms = np.concatenate([np.arange(n) for n in lengths]) if len(lengths) else np.zeros(0, np.int64)
    weights = np.concatenate(vectors).astype(np.int64) if len(vectors) else np.zeros(0, np.int64)
    order = np.argsort(terms, kind="stable")
    rows, terms, weights = rows[order], terms[order], weights[order]
    some = weights != 0
    rows, terms, weights = rows[some], terms[some], weights[some]
    names, first = np.unique(terms, return_index=True)
    bounds = np.append(first, len(terms))
    return {int(t): (rows[a:b], weights[a:b]) for t, a, b in zip(names, bounds[:-1], bounds[1:], strict=True)}


def top_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to smaller ids."""
    if len(scores) > k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= bar)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def search(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of every query row; both have (vec_id, terms)."""
    queries = saved(queries.withColumn("asked", F.monotonically_increasing_id()))
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    groups = max(1, -(-queries.count() // QUERY_ROWS))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = queries.withColumn("part", F.pmod(F.xxhash64("asked", F.lit(2)), F.lit(groups)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids = right["vec_id"].to_numpy(np.int64)
        lists = postings(list(right["terms"]))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for row, q, terms in zip(left["asked"], left["vec_id"], left["terms"], strict=True):
            scores = np.zeros(len(ids), np.int64)
            for t in np.flatnonzero(terms):
                if t in lists:
                    at, weights = lists[t]
                    if len(at) == len(scores):
                        scores += weights * terms[t]
                    else:
                        scores[at] += weights * terms[t]
            other = np.flatnonzero(ids != q)
            best = other[top_of(scores[other], ids[other], k)]
            out.append((np.full(len(best), row), np.full(len(best), q), ids[best], scores[best]))
        columns = [np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        return pd.DataFrame(dict(zip(("asked", "query_id", "vec_id", "score"), columns, strict=True)))

    found = asked.groupBy("block", "part").cogroup(dealt.groupBy("block", "part")).applyInPandas(one, "asked long, query_id long, vec_id long, score long")
    return ranked(found, k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query row (``asked``) over all blocks, ranked from 1."""
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("asked", "query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, is_query: Column, k: int, scale: int) -> DataFrame:
    """Top k by inner product of the components times ``scale``, rounded down."""
    rows = vectors.where(usable("embedding") & F.col("vec_id").isNotNull()).select("vec_id", quantized("embedding", scale).alias("terms"))
    return search(rows.where(is_query), rows, k).drop("asked")
