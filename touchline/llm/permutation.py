"""Approximate nearest neighbours: permutation index with pivot inverted files.

``PIVOTS`` rows chosen by hash are pivots. A vector is represented by the order
of its ``PREFIX`` nearest pivots (largest inner product, ties to the smaller
place) and posted in the inverted files of its ``POSTED`` nearest ones. A query
opens the files of its ``PROBED`` nearest pivots, ranks what they hold by the
footrule distance between the two orders (a pivot beyond the prefix stands at
place ``PREFIX``), and the nearest share ``RERANKED`` of each file, at least
``RERANKED_LEAST`` rows, is scored exactly in double precision on the original vectors.
A row that stands in several opened files is met only in the one nearest to the
query. The best k of all files are returned.

Every row is indexed; only the pivots are a bounded sample. Files are split
into blocks of at most about ``FILE_ROWS`` rows by hash, so a pivot that attracts a third of
all rows is spread over tasks; each block meets the queries in parts of
``QUERY_ROWS``. Queries that got fewer than k rows while there are more are
searched again exhaustively.

Vectors that are null, zero or hold null or non-finite components take no part.
Ties go to the smaller id; no row is found by a query of its own id; query rows
that repeat an id are ranked one by one. Vectors
shorter than the longest count as padded with zeros. An empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import saved
from .exhaustive import ranked, top_of, usable

PIVOTS = 128
PREFIX = 64
POSTED = 10
PROBED = 20
RERANKED = 0.5
RERANKED_LEAST = 64
FILE_ROWS = 8192
QUERY_ROWS = 4096
FOUND = "asked long, query_id long, vec_id long, score double"


def matrix(column, width: int) -> np.ndarray:  # noqa: ANN001
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def with_order(rows: DataFrame, pivots: np.ndarray, prefix: int) -> DataFrame:
    """``rows`` with the places of their nearest pivots, as bytes of 16-bit numbers."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            near = shared.value
            x = matrix(b.column(1).to_pylist(), near.shape[1])
            order = np.argsort(-(x @ near.T), axis=1, kind="stable")[:, :prefix].astype(np.uint16)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([o.tobytes() for o in order], pa.binary()), pa.array(order.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["vec_id", "embedding", "places", "near"])

    return rows.mapInArrow(run, f"vec_id long, embedding {rows.schema['embedding'].dataType.simpleString()}, places binary, near array<int>")


def search_block(left: pd.DataFrame, right: pd.DataFrame, width: int, pivots: int, prefix: int, posted: int, k: int, share: float) -> pd.DataFrame:
    """Best rows of one block of a file for each query that opens it."""
    ids = right["vec_id"].to_numpy(np.int64)
    x = matrix(right["embedding"], width)
    order = np.stack([np.frombuffer(p, np.uint16) for p in right["places"]]) if len(right) else np.zeros((0, prefix), np.uint16)
    place = np.full((pivots, len(ids)), prefix, np.int16)
    for j in range(order.shape[1]):
        place[order[:, j], np.arange(len(ids))] = j
    steps = np.arange(prefix, dtype=np.int16)
    out = []
    for row, q, vector, places, opened in zip(left["asked"], left["vec_id"], left["embedding"], left["places"], left["turn"], strict=True):
        own = np.frombuffer(places, np.uint16)
        at = np.flatnonzero(ids != q)
        if opened:  # met already in a file that is nearer to the query
            at = at[~(place[own[:opened]][:, at] < posted).any(0)]
        if not len(at):
            continue
        keep = max(RERANKED_LEAST, k, int(np.ceil(share * len(at))))
        if keep < len(at):
            far = np.abs(place[own][:, at] - steps[: len(own), None]).sum(0, dtype=np.int32)
            at = at[top_of(-far, ids[at], keep)]
        v = np.zeros(width)
        v[: len(vector)] = vector
        scores = (x[at] * v).sum(1)
        best = top_of(scores, ids[at], k)
        out.append((np.full(len(best), row), np.full(len(best), q), ids[at][best], scores[best]))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
    return pd.DataFrame({name: c.astype(float if name == "score" else np.int64) for name, c in zip(("asked", "query_id", "vec_id", "score"), columns, strict=True)})


def _meet(queries: DataFrame, files: DataFrame, one) -> DataFrame:  # noqa: ANN001
    """Every query part with every block of the files it opens."""
    sizes = files.groupBy("file").count().collect()  # a row per pivot
    blocks = {r["file"]: max(1, -(-r["count"] // FILE_ROWS)) for r in sizes}
    if not blocks:
        return files.sparkSession.createDataFrame([], FOUND)
    parts = max(1, -(-queries.select("asked").distinct().count() // QUERY_ROWS))
    split = F.create_map(*[F.lit(x) for item in blocks.items() for x in item])
    dealt = files.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(3)), split[F.col("file")])).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = queries.where(split[F.col("file")].isNotNull()).withColumn("part", F.pmod(F.xxhash64("asked", F.lit(4)), F.lit(parts)).cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), (split[F.col("file")] - 1).cast("long"))))
    keys = ["file", "block", "part"]
    return asked.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(one, FOUND)


def top_k(vectors: DataFrame, is_query: Column, k: int, pivots: int = PIVOTS, prefix: int = PREFIX, posted: int = POSTED, probed: int = PROBED, share: float = RERANKED) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows found for each query."""
    zero = F.forall("embedding", lambda x: x == 0)
    rows = vectors.where(usable("embedding") & F.col("vec_id").isNotNull()).where(~zero).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    chosen = rows.orderBy(F.xxhash64("vec_id", F.lit("pivot")), "vec_id").limit(pivots).collect()
    width = rows.agg(F.max(F.size("embedding"))).first()[0]
    if not chosen:
        return ranked(rows.sparkSession.createDataFrame([], FOUND), k).drop("asked")
    m = len(chosen)
    depth, posted, probed = min(prefix, m), min(posted, m), min(probed, m)
    index = saved(with_order(rows, matrix([r["embedding"] for r in chosen], width), depth))
    files = index.select("vec_id", "embedding", "places", F.explode(F.slice("near", 1, posted)).alias("file"))
    queries = saved(index.where(is_query).withColumn("asked", F.monotonically_increasing_id()))
    opened = queries.select("asked", "vec_id", "embedding", "places", F.posexplode(F.slice("near", 1, probed)).alias("turn", "file"))

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return search_block(left, right, width, m, depth, posted, k, share)

    def whole(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return search_block(left, right, width, m, depth, posted, k, 1.0)

    found = saved(ranked(_meet(opened, files, one), k))
    total = index.count()
    got = found.groupBy("asked").count()
    few = saved(queries.join(got, "asked", "left").where(F.coalesce("count", F.lit(0)) < min(k, total - 1)).select("asked", "vec_id", "embedding", "places").withColumn("turn", F.lit(0)).withColumn("file", F.lit(0)))
    if few.isEmpty():
        return found.drop("asked")
    rest = ranked(_meet(few, index.select("vec_id", "embedding", "places").withColumn("file", F.lit(0)), whole), k)
    return found.join(few, "asked", "left_anti").unionByName(rest).drop("asked")
