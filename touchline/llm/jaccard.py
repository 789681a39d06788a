"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A text's set holds its distinct shingles of ``words`` words (A-Z lower-cased;
the whole sequence if it has fewer). Sets x, y link when
100 * |x & y| >= percent * |x | y|. Shingles are 64-bit hashes; texts with equal
sets form one class, named by a 64-bit hash of the set, and all work is on
classes.

1. One pass over the texts gives sizes, class names, the suffix profile (how
   many shingles fall into each of 32 ranges) and a count sketch of all
   shingles: ``2^SKETCH_BITS`` counters, summed in a tree, of fixed size.
2. A second pass orders each set by (counter, hash), rarest first, and emits
   its prefix: two sets that link share a shingle there. A class met before by
   the same task is not emitted again.
3. Shingles held by one class alone are dropped. Every posting list links its
   classes to its pivot, the class with the smallest name, so a list of m
   classes gives m - 1 pairs; those that pass the length and suffix filters are
   verified on the full sets. Verified links merge components.
4. Lists of more than ``CELL`` classes are dealt into cells of about that many,
   by ``ROUNDS`` different hashes, and classes of different components in a cell
   are compared. A large group of near copies grows together here, with pairs in
   proportion to its size.
5. The rest: in lists that still hold several components, pairs of classes of
   different components that pass the length, positional and suffix filters, all
   inside the join, are verified once. Pairs inside a component cannot change
   the result and are not made. So no link between components is lost.

The result has one row per document. Null and empty texts have an empty set and
link with nothing (also not with each other). Rows without an id make no link;
their component is that of an equal text with an id, else null. Repeated rows
are kept row by row. An empty table gives an empty result. Columns besides the id and the
text are not read. Hash collisions among N different sets or shingles have
probability N^2 / 2^65.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField

from .common import NGRAM_FACTOR, Scratch, append_columns, mixed, run_hashes, small_batches, text_chunks
from .components import components

SKETCH_BITS = 20
SKETCH_ROW = 1 << 14  # counters per row while summing
RANGES = 32  # of the suffix profile
PAIR_ROWS = 128  # pairs of whole texts in a batch
SMALL_ROWS = 1 << 20  # wanted rows up to which their ids are sent to all tasks
CLASS = "jaccard_class_of_text"  # helper column
CELL = 16  # classes of a long list that are compared with each other
ROUNDS = 3  # ways to deal a long list into cells
TREE = 64

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(array: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text."""
    for first, end, data, offsets in text_chunks(array):
        low = _LOWER[data]
        inside = np.zeros(len(low) + 1, bool)
        inside[:-1] = ~_SPACE[low]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        starts_here = offsets[:-1][offsets[:-1] < len(low)]
        begin[starts_here] = inside[starts_here]
        starts = np.flatnonzero(begin[: len(low)])
        stop = np.flatnonzero(~inside[1:] & inside[:-1]) + 1
        cut = offsets[1:-1]
        cut = np.unique(cut[(cut > 0) & (cut < len(low))])
        cut = cut[inside[cut - 1] & inside[cut]]  # a word that ends with its text while the next one begins
        ends = np.sort(np.concatenate([stop, cut]))
        h = run_hashes(low, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        bounds = np.searchsorted(starts, offsets)
        for i in range(end - first):
            own = h[bounds[i] : bounds[i + 1]]
            if not len(own):
                yield first + i, own
                continue
            k = min(words, len(own))
            n = len(own) - k + 1
            s = np.zeros(n, np.uint64)
            for j in range(k):
                s = s * NGRAM_FACTOR + own[j : j + n]
            yield first + i, np.unique(mixed(s + np.uint64(k)))


def class_name(values: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        total = mixed(values + NGRAM_FACTOR).sum(dtype=np.uint64) * np.uint64(2) + np.uint64(len(values))
    return int(mixed(np.array([total], np.uint64)).view(np.int64)[0])


def prefix_length(n: int, percent: int) -> int:
    """Two sets with the similarity share a shingle among this many first ones of either."""
    return n - -(-n * percent // 100) + 1


def profiles(docs: DataFrame, words: int, keep: Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, cls, profile) of all rows, and the summed sketch as (place, counters)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, n long, cls long, profile array<tinyint>, place int, counters binary"
    size = 1 << SKETCH_BITS
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            n, cls, profile = [], [], []
            for _, values in shingle_sets(b.column(1), words):
                n.append(len(values))
                cls.append(class_name(values) if len(values) else None)
                profile.append(np.minimum(np.bincount((values >> np.uint64(59)).astype(np.int64), minlength=RANGES), 127).astype(np.int8))
                np.add.at(total, (values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            m = len(b)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(profile, pa.list_(pa.int8())), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())],
                names=["doc_id", "n", "cls", "profile", "place", "counters"],
            )
        rows = [(i // SKETCH_ROW, zlib.compress(total[i : i + SKETCH_ROW].tobytes(), 1)) for i in range(0, size, SKETCH_ROW)] if total.any() else []
        m = len(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(m, id_type), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.int8())), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
            names=["doc_id", "n", "cls", "profile", "place", "counters"],
        )

    found = keep.saved(docs.select("doc_id", "text").mapInArrow(run, fields))
    sketch = found.where("place IS NOT NULL").select("place", "counters").withColumn("task", F.pmod(F.xxhash64("counters"), F.lit(TREE)))

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in frame["counters"])
        return pd.DataFrame({"place": [int(frame["place"].iloc[0])], "counters": [zlib.compress(total.tobytes(), 1)]})

    for keys in (["place", "task"], ["place"]):
        sketch = sketch.groupBy(*keys).applyInPandas(add, "place int, counters binary")
    return found.where("place IS NULL").drop("place", "counters"), sketch


def sketch_of(spark, sketch: DataFrame) -> Broadcast:  # noqa: ANN001
    """The counters, 8 * 2^SKETCH_BITS bytes whatever the data, for all tasks."""
    counters = np.zeros(1 << SKETCH_BITS, np.int64)
    for row in sketch.collect():
        counters[row["place"] * SKETCH_ROW : (row["place"] + 1) * SKETCH_ROW] = np.frombuffer(zlib.decompress(row["counters"]), np.int64)
    return spark.sparkContext.broadcast(counters)


def prefixes(docs: DataFrame, words: int, percent: int, sketch: Broadcast) -> DataFrame:
    """(h, cls, at): the rarest shingles of each class, once per task; at is size * 2^32 + place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for b in batches:
            h, cls, at = [], [], []
            for _, values in shingle_sets(b.column(0), words):
                if not len(values) or (name := class_name(values)) in met:
                    continue
                met.add(name)
                count = sketch.value[(values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                p = prefix_length(len(values), percent)
                first = values[np.lexsort((values, count))[:p]]
                h.append(first)
                cls.append(np.full(p, name))
                at.append((len(values) << 32) + np.arange(p))
            if h:
                columns = [np.concatenate(h).view(np.int64), np.concatenate(cls).astype(np.int64), np.concatenate(at).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "cls", "at"])

    return docs.select("text").mapInArrow(run, "h long, cls long, at long")


def _needed(a: Column, b: Column, percent: int) -> Column:
    """Least overlap of two sets of these sizes: ceil(percent * (a + b) / (100 + percent))."""
    return F.floor(((a + b) * percent + (100 + percent - 1)) / (100 + percent)).cast("long")


def _possible(percent: int) -> Column:
    """Length and positional filters of rows with n, pos and other_n, other_pos."""
    n, m = F.col("n").cast("long"), F.col("other_n").cast("long")
    rest = F.least(n - F.col("pos"), m - F.col("other_pos"))  # the shared shingle and what may follow
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (rest >= _needed(n, m, percent))


def _apart(p: str, q: str, n: Column, m: Column, percent: int) -> Column:
    """Suffix filter: whether two sets of sizes n and m with these profiles may link.

    They differ at least by the sum over the ranges of the differences of their
    (capped) profiles, and sets that link by at most both sizes less twice the
    overlap.
    """
    least = sum(F.abs(F.col(p)[i].cast("int") - F.col(q)[i].cast("int")) for i in range(RANGES))
    return least <= n + m - 2 * _needed(n, m, percent)


def filtered(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that pass the length and suffix filters."""
    one = classes.select(F.col("cls").alias("a"), F.col("n").alias("an"), F.col("profile").alias("ap"))
    two = classes.select(F.col("cls").alias("b2"), F.col("n").alias("bn"), F.col("profile").alias("bp"))
    alike = F.least("an", "bn") * 100 >= F.greatest("an", "bn") * percent
    fits = alike & _apart("ap", "bp", F.col("an"), F.col("bn"), percent)
    return pairs.join(one, "a").join(two, (F.col("b") == F.col("b2")) & fits).select("a", "b")


def verified(docs: DataFrame, classes: DataFrame, checked: DataFrame, words: int, percent: int, keep: Scratch) -> DataFrame:
    """The pairs (a, b) of ``checked`` that link, each checked once on full sets.

    Texts travel, not sets: they are smaller. The wanted ones are read once, with
    the classes whose side they take; b's text goes to a, which has few different
    values (the pivots), and a large group of copies is dealt by the join.
    """
    ends = checked.select(F.col("b").alias("cls"), "a").unionByName(checked.select(F.col("a").alias("cls"), "a").distinct())
    wanted = keep.saved(classes.select("cls", "doc_id").join(ends, "cls").withColumnRenamed("doc_id", "wanted_id"))
    read = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    if wanted.count() <= SMALL_ROWS:
        read = read.join(F.broadcast(wanted.select("wanted_id").distinct()), F.col("doc_id") == F.col("wanted_id"), "left_semi")
    told = keep.saved(read.join(wanted, F.col("doc_id") == F.col("wanted_id")).select("cls", "a", "text"))
    one = told.where("cls = a").select("a", F.col("text").alias("one"))
    two = told.where("cls <> a").select("a", F.col("cls").alias("b"), F.col("text").alias("two"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            texts = b.column(2).dictionary_encode()  # a pivot's text once a batch
            firsts = [v for _, v in shingle_sets(texts.dictionary, words)]
            link = []
            for a, c, at, (_, y) in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts.indices.to_pylist(), shingle_sets(b.column(3), words), strict=True):
                x = firsts[at]
                if not len(x) or not len(y) or class_name(x) != a or class_name(y) != c:
                    link.append(False)  # another text of the same id
                    continue
                place = np.searchsorted(x, y)
                common = int((x[np.minimum(place, len(x) - 1)] == y).sum())
                link.append(100 * common >= percent * (len(x) + len(y) - common))
            yield b.select(["a", "b"]).filter(pa.array(link, pa.bool_()))

    linked = one.join(two, "a").select("a", "b", "one", "two").mapInArrow(verify, "a long, b long").distinct()
    with small_batches(docs.sparkSession, PAIR_ROWS):
        return keep.saved(linked)


def join_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest id reachable by links."""
    keep = Scratch(docs.sparkSession)
    named, least = _grouped(docs, words, percent, keep)
    label = named.select("cls", "root").join(least, "root").select("cls", "component_id")
    rows = keep.rows.join(label, "cls", "left")
    return keep.result(rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))


def _grouped(docs: DataFrame, words: int, percent: int, keep: Scratch) -> tuple[DataFrame, DataFrame]:
    """(cls, doc_id, root) of all classes and (root, component_id); ``keep.rows`` has the rows with their classes."""
    keep.rows, sketch = profiles(docs, words, keep)
    sketch = sketch_of(docs.sparkSession, sketch)
    classes = keep.saved(keep.rows.where("cls IS NOT NULL AND doc_id IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min_by("profile", "n").alias("profile")))
    dealt = prefixes(docs.where("doc_id IS NOT NULL"), words, percent, sketch).repartition("h")
    # both readers of the shuffled rows name all columns, so that Spark shuffles them once
    lists = dealt.groupBy("h").agg(F.min("cls").alias("pivot"), F.max("cls").alias("high"), F.max("at").alias("top"))
    shared = lists.where("pivot <> high AND top >= 0").select("h", "pivot")
    posts = keep.saved(dealt.join(shared.hint("shuffle_hash"), "h").select("h", "cls", "at", "pivot").distinct())
    sketch.destroy()
    found = _Found(docs, classes, words, percent, keep)
    stars = posts.where("cls <> pivot").select(F.col("cls").alias("a"), F.col("pivot").alias("b")).distinct()
    found.check(filtered(stars, classes, percent))
    sizes = keep.saved(posts.groupBy("h").count().where(F.col("count") > CELL))
    hot = keep.saved(posts.join(sizes, "h").withColumn("cells", F.ceil(F.col("count") / CELL)).select("h", "cls", "at", "cells"))
    if not hot.isEmpty():
        turns = hot.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(ROUNDS - 1))))
        cell = F.pmod(F.xxhash64("cls", "turn"), F.col("cells")) * ROUNDS + F.col("turn")
        found.check(_rest(turns.withColumn("cell", cell), classes, found.roots, percent, keep))
    found.check(_rest(posts.withColumn("cell", F.lit(0).cast("long")), classes, found.roots, percent, keep))
    named = keep.saved(_with_root(classes.select("cls", "doc_id"), found.roots))
    return named, named.groupBy("root").agg(F.min("doc_id").alias("component_id"))


class _Found:
    """What has been verified: pairs tried and the component (root) of each linked class."""

    def __init__(self, docs: DataFrame, classes: DataFrame, words: int, percent: int, keep: Scratch) -> None:
        self.docs, self.classes, self.words, self.percent, self.keep = docs, classes, words, percent, keep
        self.tried = self.roots = None

    def check(self, candidates: DataFrame) -> None:
        """Verify the candidates not tried before and merge the components that they link."""
        checked = candidates.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        checked = self.keep.saved(checked if self.tried is None else checked.join(self.tried, ["a", "b"], "left_anti"))
        if checked.isEmpty():
            return
        self.tried = checked if self.tried is None else self.tried.unionByName(checked)
        links = verified(self.docs, self.classes, checked, self.words, self.percent, self.keep)
        if links.isEmpty():
            return
        if self.roots is not None:  # what is known are stars already
            links = links.unionByName(self.roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        self.roots = self.keep.saved(components(links, "a", "b", self.keep.saved))


def _with_root(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    """``rows`` with the component found so far of each class."""
    if known is None:
        return rows.withColumn("root", F.col("cls"))
    return rows.join(known.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))


def _rest(posts: DataFrame, classes: DataFrame, roots: DataFrame | None, percent: int, keep: Scratch) -> DataFrame:
    """Pairs (a, b) of different components that share a cell of a list and pass all filters."""
    rows = _with_root(posts.select("h", "cls", "at", "cell"), roots)
    # written first: so few lists that they need no shuffle of the rows, which would gather long ones, are known to be few
    lists = keep.saved(rows.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("h"))
    place = F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).alias("pos")
    rows = keep.saved(rows.join(lists, "h").join(classes.select("cls", "n", "profile"), "cls").select("h", "cell", "cls", "root", "n", place, "profile"))
    others = rows.select(*[F.col(c).alias(f"other_{c}") for c in rows.columns])
    fits = (F.col("root") < F.col("other_root")) & _possible(percent) & _apart("profile", "other_profile", F.col("n"), F.col("other_n"), percent)
    same = (F.col("h") == F.col("other_h")) & (F.col("cell") == F.col("other_cell"))
    return rows.join(others, same & fits).select(F.col("cls").alias("a"), F.col("other_cls").alias("b")).distinct()


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without near copies: of each component one row stays.

    It is the one with the smallest id, of equal ids the text with the smallest
    class name, of rows that repeat both any one. A row goes for its own text,
    whatever else carries its id. Rows without an id make no link: they go for an
    equal text only. Rows with an empty set all stay.
    """
    keep = Scratch(docs.sparkSession)
    named, _ = _grouped(docs.select("doc_id", "text"), words, percent, keep)
    copies = keep.rows.where("cls IS NOT NULL").groupBy("cls").agg(F.count("*").alias("copies"))
    first = named.groupBy("root").agg(F.min(F.struct("doc_id", "cls")).alias("first"))
    told = named.select("cls", "root").join(first, "root").join(copies, "cls")
    stay = F.when(F.col("cls") == F.col("first.cls"), F.col("first.doc_id")).alias("stay_id")
    leaving = keep.saved(told.where("cls <> first.cls OR copies > 1").select(F.col("cls").alias("left_cls"), stay))
    if leaving.count() <= SMALL_ROWS:
        leaving = F.broadcast(leaving)
    rows = append_columns(docs, [StructField(CLASS, LongType())], _namer(docs.columns.index("text"), words))
    out = rows.join(leaving, F.col(CLASS) == F.col("left_cls"), "left").where("left_cls IS NULL OR doc_id = stay_id").select(*docs.columns, CLASS)
    repeats = keep.saved(keep.rows.where("cls IS NOT NULL").groupBy("doc_id", "cls").count().where("count > 1").select(F.col("doc_id").alias("again_id"), F.col("cls").alias("again_cls")))
    if not repeats.isEmpty():
        again = F.col("doc_id").eqNullSafe(F.col("again_id")) & (F.col(CLASS) == F.col("again_cls"))
        out = keep.saved(out)
        out = out.join(repeats, again, "left_anti").unionByName(out.join(repeats, again, "left_semi").dropDuplicates(["doc_id", CLASS]))
    return keep.result(out.select(*docs.columns))


def _namer(at: int, words: int) -> Callable[[pa.RecordBatch], list[pa.Array]]:
    return lambda b: [pa.array([class_name(v) if len(v) else None for _, v in shingle_sets(b.column(at), words)], pa.int64())]
