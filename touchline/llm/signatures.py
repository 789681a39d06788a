"""Ranked lexical search over bit-sliced Bloom signatures.

A term is a maximal run of ASCII letters, digits and all other characters from
U+0080 on; only A-Z are lower-cased. A document of n terms gets, for an item,
the sum over the item's terms (repeats included) of
``w * ((10^9 * tf) div (1000 * tf + 12 * m))`` with
``w = floor(1000 * ln((2N + 2) / (2df + 1)))`` and
``m = 75 + (25 * n * N) div L``; see ``weights`` and ``saturation``.

1. ``build``: every document becomes a Bloom signature of ``HASHES`` bits per
   term and level; a term has level j if it occurs 2^j times or more. Documents
   of like size share a block: one row of bits (slice) per place of the
   signature, one column per document. A block knows its ids and lengths.
2. A query reads the slices of its terms: their AND overestimates which
   documents hold a term, level by level, so the highest level found bounds tf.
   The weighted sum of the slices' saturated bounds is an upper bound of the
   score of every document of the block.
3. The ``CANDIDATES`` documents of largest bound of each item are scored on their
   texts; the k-th best of these scores is a score that the result surely reaches.
4. All documents whose bound reaches it are scored exactly. The others are
   provably not among the k best. Bounds only decide what is read again, so the
   result is that of the exhaustive search.

Items are taken in groups of about ``GROUP_TERMS`` terms, whose terms, weights
and places are the only things sent to all tasks. Ties go to the smaller id
(null last); documents without a term, and scores of 0, are not found. Rows that
repeat an id are ranked one by one, as are items that do. Null texts hold no
term. Empty tables give empty results. Columns besides ids and texts are not
read. Terms are compared by 64-bit hashes: among N different terms a collision has
probability N^2 / 2^65.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import CHUNK_BYTES, NGRAM_FACTOR, mixed, run_hashes, saved, text_chunks

BITS = 12  # of a signature per (term, level), rounded up to a power of two of them
HASHES = 4
LEVELS = 6  # a term that occurs 2^(LEVELS - 1) times or more has no bound on its tf
MATRIX = 1 << 22  # bits of a block, at least one document
CANDIDATES = 100  # documents per item that set its threshold
GROUP_TERMS = 1 << 18
DOCS_AT_ONCE = 1024  # columns of a block that are bounded together
SMALL_ROWS = 1 << 20  # wanted ids up to which they are sent to all tasks

_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, hash) of every term of some texts."""
    low = _LOWER[data]
    inside = _TERM[low]
    border = np.zeros(len(low) + 1, bool)
    border[offsets] = border[-1] = True
    before, after = np.append(False, inside[:-1]), np.append(inside[1:], False)
    starts = np.flatnonzero(inside & (~before | border[:-1]))
    ends = np.flatnonzero(inside & (~after | border[1:])) + 1
    hashes = run_hashes(low, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    return np.searchsorted(offsets, starts, "right") - 1, hashes


def _counted(rows: np.ndarray, hashes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((hashes, rows))
    rows, hashes, times = rows[order], hashes[order], times[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    return rows[first], hashes[first], np.add.reduceat(times, first) if len(first) else times


def term_counts(array: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, hash, tf) of the distinct terms of the texts, sorted by row and hash, for runs of whole texts.

    A long text is cut between terms, so that it takes no more working memory than a short one.
    """
    for first, _, data, offsets in text_chunks(array):
        if len(data) <= 2 * CHUNK_BYTES:
            rows, hashes = _hashed(data, offsets)
            yield _counted(rows + first, hashes, np.ones(len(rows), np.int64))
            continue
        parts, at = [], 0
        while at < len(data):
            end = min(at + CHUNK_BYTES, len(data))
            while end < len(data) and _TERM[data[end]]:
                end += 1
            _, hashes = _hashed(data[at:end], np.array([0, end - at]))
            parts.append(_counted(np.full(len(hashes), first), hashes, np.ones(len(hashes), np.int64)))
            at = end
        yield _counted(*[np.concatenate(c) for c in zip(*parts, strict=True)])


def places(keys: np.ndarray, size: int) -> np.ndarray:
    """The ``HASHES`` places of every key in a signature of ``size`` bits, one row per key."""
    step = mixed(keys + NGRAM_FACTOR) | np.uint64(1)
    return ((keys[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) % np.uint64(size)).astype(np.int64)


def level_keys(hashes: np.ndarray, level: int) -> np.ndarray:
    return mixed(hashes + np.uint64(level * 0xD1B54A32D192ED03 & (1 << 64) - 1))


class _Blocks:
    """Documents of like size waiting for a full block."""

    def __init__(self, id_type: pa.DataType) -> None:
        self.schema = pa.schema([("size", pa.int64()), ("ids", pa.list_(id_type)), ("lengths", pa.list_(pa.int64())), ("holders", pa.int64()), ("terms", pa.int64()), ("bits", pa.binary())])
        self.waiting: dict[int, tuple[list, list, list]] = {}

    def add(self, ids: pa.Array, rows: np.ndarray, hashes: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The blocks that these documents fill."""
        at, keys = [rows], [level_keys(hashes, 0)]
        for level in range(1, LEVELS):
            often = times >= 1 << level
            at.append(rows[often])
            keys.append(level_keys(hashes[often], level))
        at, keys = np.concatenate(at), np.concatenate(keys)
        order = np.argsort(at, kind="stable")
        at, keys = at[order], keys[order]
        docs, first = np.unique(at, return_index=True)
        bounds = np.append(first, len(at))
        lengths = np.add.reduceat(times, np.searchsorted(rows, docs)) if len(docs) else times
        for d, a, b, n in zip(docs, bounds[:-1], bounds[1:], lengths, strict=True):
            size = BITS << max(4, int(b - a - 1).bit_length())
            held = self.waiting.setdefault(size, ([], [], []))
            held[0].append(ids[int(d)].as_py())
            held[1].append(int(n))
            held[2].append(keys[a:b])
            if len(held[0]) * size >= MATRIX:
                yield self._block(size)

    def _block(self, size: int) -> pa.RecordBatch:
        ids, lengths, keys = self.waiting.pop(size)
        set_at = np.zeros((size, len(ids)), bool)
        column = np.repeat(np.arange(len(ids)), [len(k) for k in keys])
        for place in places(np.concatenate(keys), size).T:
            set_at[place, column] = True
        row = [size, ids, lengths, len(ids), sum(lengths), np.packbits(set_at, axis=1, bitorder="little").tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, self.schema, strict=True)], schema=self.schema)

    def rest(self) -> Iterator[pa.RecordBatch]:
        for size in list(self.waiting):
            yield self._block(size)


def build(docs: DataFrame) -> DataFrame:
    """The signature blocks of all documents with a term; one narrow pass, written to the shared folder."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = None
        for b in batches:
            blocks = blocks or _Blocks(b.column(0).type)
            for counts in term_counts(b.column(1)):
                yield from blocks.add(b.column(0), *counts)
        if blocks:
            yield from blocks.rest()

    made = docs.select("doc_id", "text").mapInArrow(run, f"size long, ids array<{kind}>, lengths array<long>, holders long, terms long, bits binary")
    return saved(made, {"parquet.block.size": 16 << 20})


def item_terms(items: DataFrame) -> DataFrame:
    """(item, hash, times) of the items' terms; ``items`` has (item, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, hashes, times in term_counts(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(hashes.view(np.int64)), pa.array(times)], names=["item", "hash", "times"])

    return items.select("item", "text").mapInArrow(run, "item long, hash long, times long")


def document_frequencies(docs: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How many documents hold each of ``terms`` (sorted hashes); counted in tasks, one row per term to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for b in batches:
            for _, hashes, _ in term_counts(b.column(0)):
                at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
                total += np.bincount(at[terms[at] == hashes], minlength=len(terms))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    out = np.zeros(len(terms), np.int64)
    for r in docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["term"]] = r["n"]
    return out


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def saturation(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Query:
    """A group of items: their distinct terms with weights, and each item's terms."""

    def __init__(self, rows: pd.DataFrame, documents: int, terms: int) -> None:
        self.documents, self.total = documents, max(terms, 1)
        self.terms, place = np.unique(rows["hash"].to_numpy(np.int64).view(np.uint64), return_inverse=True)
        self.items, item = np.unique(rows["item"].to_numpy(np.int64), return_inverse=True)
        order = np.argsort(item, kind="stable")
        self.place, self.times = place[order], rows["times"].to_numpy(np.int64)[order]
        self.bounds = np.searchsorted(item[order], np.arange(len(self.items) + 1))
        self.weight = np.zeros(0, np.int64)  # of each place of an item: its term's weight times its repeats

    def weigh(self, df: np.ndarray) -> None:
        self.weight = weights(df, self.documents)[self.place] * self.times

    def lengths(self, n: np.ndarray) -> np.ndarray:
        return 75 + (25 * n * self.documents) // self.total

    def sums(self, values: np.ndarray, items: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(item's number, weighted sum of its terms' values) for the items, all by default."""
        for i in range(len(self.items)) if items is None else items:
            a, b = self.bounds[i], self.bounds[i + 1]
            yield i, self.weight[a:b].astype(values.dtype) @ values[self.place[a:b]]

    def bound(self, size: int, bits: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Upper bounds (item, document) from the slices ``bits`` of documents of lengths ``n``; whole numbers below 2^53."""
        m, docs = self.lengths(n), len(n)
        values = np.zeros((len(self.terms), docs))
        alive, held, below = np.arange(len(self.terms)), None, np.zeros(docs, np.int64)
        for level in range(LEVELS):
            found = np.bitwise_and.reduce(bits[places(level_keys(self.terms[alive], level), size)], axis=1)
            found = found if held is None else found & held
            some = found.any(axis=1)
            alive, held = alive[some], found[some]
            if not len(alive):
                break
            most = saturation(np.minimum((2 << level) - 1, n), m) if level + 1 < LEVELS else saturation(n, m)
            values[alive] += np.unpackbits(held, axis=1, count=docs, bitorder="little") * (most - below).astype(np.float64)
            below = most
        out = np.zeros((len(self.items), docs))
        for i, total in self.sums(values):
            out[i] = total
        return out

    def score(self, hashes: np.ndarray, times: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Exact scores of one document for the items of these numbers."""
        at = np.minimum(np.searchsorted(hashes, self.terms), len(hashes) - 1)
        tf = np.where(hashes[at] == self.terms, times[at], 0)
        values = saturation(tf, self.lengths(times.sum()))
        return np.array([total for _, total in self.sums(values, items)], np.int64)


def _bounded(blocks: Iterator[pa.RecordBatch], query: Query) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, bounds) of the documents of blocks, some columns at a time."""
    for b in blocks:
        for i in range(len(b)):
            size, n = b.column(0)[i].as_py(), b.column(2)[i].values.to_numpy()
            bits = np.frombuffer(b.column(3)[i].as_buffer(), np.uint8).reshape(size, -1)
            for at in range(0, len(n), DOCS_AT_ONCE):
                part = bits[:, at // 8 : (at + DOCS_AT_ONCE) // 8]
                yield b.column(1)[i].values[at : at + DOCS_AT_ONCE], query.bound(size, part, n[at : at + DOCS_AT_ONCE])


def largest(index: DataFrame, query: Query, k: int) -> DataFrame:
    """(item, doc_id) of the k documents of largest bound of each item; tasks hand on k per item at most."""
    kind = index.schema["ids"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, best = None, np.zeros((len(query.items), 0))
        where = np.zeros((len(query.items), 0), np.int64)
        for new, bounds in _bounded(batches, query):
            start = len(ids) if ids is not None else 0
            ids = new if ids is None else pa.concat_arrays([ids, new])
            best = np.hstack([best, bounds])
            where = np.hstack([where, np.broadcast_to(np.arange(start, start + len(new)), bounds.shape)])
            if best.shape[1] > k:
                top = np.argpartition(-best, k - 1, axis=1)[:, :k]
                best, where = np.take_along_axis(best, top, 1), np.take_along_axis(where, top, 1)
                used, place = np.unique(where, return_inverse=True)  # ids that still stand somewhere
                ids, where = ids.take(pa.array(used)), place.reshape(where.shape)
        if ids is not None:
            item, at = np.nonzero(best > 0)
            yield pa.RecordBatch.from_arrays([pa.array(query.items[item]), ids.take(pa.array(where[item, at])), pa.array(best[item, at])], names=["item", "doc_id", "bound"])

    found = index.select("size", "ids", "lengths", "bits").mapInArrow(run, f"item long, doc_id {kind.simpleString()}, bound double")
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "doc_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("item", "doc_id")


def not_excluded(index: DataFrame, query: Query, least: np.ndarray) -> DataFrame:
    """(item, doc_id) of all documents whose bound reaches the item's least score."""
    kind = index.schema["ids"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, bounds in _bounded(batches, query):
            item, at = np.nonzero(bounds >= np.maximum(least, 1)[:, None])
            if len(item):
                yield pa.RecordBatch.from_arrays([pa.array(query.items[item]), ids.take(pa.array(at))], names=["item", "doc_id"])

    return index.select("size", "ids", "lengths", "bits").mapInArrow(run, f"item long, doc_id {kind.simpleString()}")


def rescored(docs: DataFrame, pairs: DataFrame, query: Query) -> DataFrame:
    """(item, doc_id, score), read from the texts, of the pairs (item, doc_id) and of all rows of these ids."""
    wanted = saved(pairs.groupBy("doc_id").agg(F.collect_set("item").alias("items")).withColumnRenamed("doc_id", "wanted_id"))
    few = wanted.count() <= SMALL_ROWS
    read = docs.select("doc_id", "text")
    if few:  # only the wanted texts meet their items by a shuffle
        ids = F.broadcast(wanted.select("wanted_id"))
        read = read.join(ids, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")
    joined = read.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted_id"))).select("doc_id", "text", "items")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, item, score = [], [], []
            for rows, hashes, times in term_counts(b.column(1)):
                docs, first = np.unique(rows, return_index=True)
                for d, a, z in zip(docs, first, np.append(first[1:], len(rows)), strict=True):
                    own = np.searchsorted(query.items, b.column(2)[int(d)].values.to_numpy())
                    at.append(np.full(len(own), d))
                    item.append(query.items[own])
                    score.append(query.score(hashes[a:z], times[a:z], own))
            if at:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(item)), b.column(0).take(pa.array(np.concatenate(at))), pa.array(np.concatenate(score))], names=["item", "doc_id", "score"])

    return joined.mapInArrow(run, f"item long, doc_id {kind}, score long").where("score > 0")


def best(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: DataFrame, docs: DataFrame, items: DataFrame, k: int, group_terms: int = GROUP_TERMS) -> DataFrame:
    """(item, rank, doc_id, score): the k best documents of every item (``items`` has item, a number, and text)."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    told = index.agg(F.sum("holders"), F.sum("terms")).first()
    asked = saved(item_terms(items))
    groups = max(1, -(-asked.count() // group_terms))
    group = F.pmod(F.xxhash64("item"), F.lit(groups))
    out = spark.createDataFrame([], f"item long, rank int, doc_id {kind}, score long")
    for g in range(groups):
        rows = asked.where(group == g).toPandas()
        if not len(rows) or not told[0]:
            continue
        query = Query(rows, told[0], told[1])
        query.weigh(document_frequencies(docs, query.terms))
        first = rescored(docs, saved(largest(index, query, max(k, CANDIDATES))), query)
        reached = best(first, k).groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
        least = np.zeros(len(query.items))
        for r in reached.collect():  # a row per item of the group
            least[np.searchsorted(query.items, r["item"])] = r["least"]
        found = best(rescored(docs, saved(not_excluded(index, query, least)), query), k)
        out = out.unionByName(saved(found.select("item", "rank", "doc_id", "score")))
    return out


def top_k(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every row of ``items`` (item_id, text)."""
    numbered = saved(items.select("item_id", "text", F.monotonically_increasing_id().alias("item")))
    found = search(build(docs), docs, numbered, k)
    return found.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
