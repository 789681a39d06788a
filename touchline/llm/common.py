"""Helpers shared by the operators: tables, written copies, Arrow passes over texts, presence models."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from touchline.session import shared_folder

CHUNK_BYTES = 1 << 20  # text handled at a time inside a task
NGRAM_FACTOR = np.uint64(0x9E3779B97F4A7C15)
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, options: dict | None = None, folder: str | None = None) -> DataFrame:
    """A written copy in the shared folder.

    It cuts the lineage, outlives lost executors, and gives later joins the true
    size of the table, so Spark broadcasts it only if it is small.
    """
    spark = df.sparkSession
    path = f"{folder or shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and the path in it of a folder's name as Spark writes it."""
    if folder.startswith("file:") and not folder.startswith("file://"):
        folder = "file://" + folder.removeprefix("file:")
    return pa.fs.FileSystem.from_uri(folder)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the jobs run inside, as rows that hold whole texts need."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Written copies of intermediate tables, dropped together once nothing reads them any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"

    def saved(self, df: DataFrame) -> DataFrame:
        return saved(df, folder=self.folder)

    def result(self, df: DataFrame) -> DataFrame:
        """A copy of ``df`` that stays; all others go."""
        out = saved(df)
        fs, path = filesystem(self.folder)
        if fs.get_file_info(path).type != pa.fs.FileType.NotFound:
            fs.delete_dir(path)
        return out


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32(doc_id as text) mod parts is ``part``; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def sample_of_labels(labels: DataFrame, label: str, parts: int, part: int, rows: int, salt: str) -> DataFrame:
    """At most about ``rows`` labelled ids outside the held-out fold, chosen by hash.

    Null ids and labels are left out; of repeated ids the largest label counts.
    The expected size is ``rows`` however many labels there are.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    known = known.where(~held_out(F.col("doc_id"), parts, part))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    total = known.count()
    share = min(1.0, rows / max(total, 1))
    chosen = F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    return known.where(chosen)


def append_columns(df: DataFrame, fields: list[StructField], batch_columns: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """``df`` with columns computed per Arrow batch; columns of the same names are replaced."""
    new = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in new]
    positions = [i for i, f in enumerate(df.schema.fields) if f.name not in new]
    schema = StructType(kept + fields)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = batch_columns(b)
            yield pa.RecordBatch.from_arrays([b.column(i) for i in positions] + made, names=names)

    return df.mapInArrow(run, schema)


def text_chunks(array: pa.Array, size: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows and the end) for runs of whole texts of about ``size`` bytes (``CHUNK_BYTES``); null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.fill_null("") if array.null_count else array
    wide = pa.types.is_large_string(array.type)
    buffers = array.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and len(array) else np.zeros(0, np.uint8)
    first = 0
    while first < len(array):
        end = max(int(np.searchsorted(offsets, offsets[first] + (size or CHUNK_BYTES), "right")) - 1, first + 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalizer with avalanche over 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * MIX_A
    h = (h ^ (h >> np.uint64(27))) * MIX_B
    return h ^ (h >> np.uint64(31))


def powers(n: int, base: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        factor = np.uint64(pow(base, done, 1 << 64))
        out[done : done + step] = out[:step] * factor
        done += step
    return out[:n]


POLY = 0xD6E8FEB86659FD93
POLY_INVERSE = pow(POLY, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _grown(key: str, base: int, n: int) -> np.ndarray:
    if n > 2 * CHUNK_BYTES + 1:  # one very long run; its powers are not kept
        return powers(n, base)
    if key not in _POWERS or len(_POWERS[key]) < n:
        _POWERS[key] = powers(n, base)
    return _POWERS[key]


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run data[start:end], by polynomial prefix sums; runs are sorted and apart.

    A long text is taken some runs at a time; the hashes do not depend on where.
    """
    if len(data) <= 2 * CHUNK_BYTES or len(starts) < 2:
        return _run_hashes(data, starts, ends)
    cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(data), CHUNK_BYTES)), len(starts)))
    return np.concatenate([_run_hashes(data[starts[a] : ends[z - 1]], starts[a:z] - starts[a], ends[a:z] - starts[a]) for a, z in zip(cuts[:-1], cuts[1:], strict=True)])


def _run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _grown("up", POLY, len(data) + 1)[: len(data)], out=sums[1:])
    back = _grown("down", POLY_INVERSE, len(data) + 1)
    return mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * NGRAM_FACTOR)


def document_of(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index of the text that holds each position (empty texts hold none)."""
    return np.searchsorted(offsets, positions, "right") - 1


class PresenceModel:
    """A linear model over hashed features that count once per text; only few weights are not zero."""

    def __init__(self, bits: int, weights: np.ndarray, bias: float) -> None:
        self.bits, self.weights, self.bias = bits, weights, bias

    def score(self, array: pa.Array, features: Callable[..., Iterator[tuple[np.ndarray, np.ndarray]]]) -> np.ndarray:
        """Probabilities of label 1; ``features`` yields (text index, feature index) per chunk."""
        out = np.zeros(len(array))
        live = self.weights != 0
        for first, end, data, offsets in text_chunks(array):
            keys = []
            for rows, index in features(data, offsets, self.bits):
                hit = live[index]
                keys.append((rows[hit].astype(np.int64) << self.bits) | index[hit].astype(np.int64))
            found = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
            w = self.weights[found & ((1 << self.bits) - 1)]
            out[first:end] = np.bincount(found >> self.bits, weights=w, minlength=end - first)
        return 1.0 / (1.0 + np.exp(-np.clip(out + self.bias, -60, 60)))


def presence_chunks(array: pa.Array, features: Callable, bits: int, live: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct (text, feature) pairs chunk by chunk, as (text index, feature index), sorted by text; only ``live`` features if given."""
    slot = np.zeros(1 << bits, np.int32)
    for first, end, data, offsets in text_chunks(array):
        parts = []
        for rows, index in features(data, offsets, bits):
            if live is not None:
                hit = live[index]
                rows, index = rows[hit], index[hit]
            parts.append((index, np.searchsorted(rows, np.arange(end - first + 1))))
        counts, out = np.zeros(end - first, np.int64), []
        for t in range(end - first):
            own = np.concatenate([index[bounds[t] : bounds[t + 1]] for index, bounds in parts]) if parts else np.zeros(0, np.int64)
            place = np.arange(len(own), dtype=np.int32)
            slot[own] = place  # the last occurrence stays
            own = own[slot[own] == place]
            counts[t] = len(own)
            out.append(own.astype(np.int32))
        yield np.repeat(np.arange(first, end, dtype=np.int32), counts), np.concatenate(out)


def presence_rows(array: pa.Array, features: Callable, bits: int, live: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of all texts."""
    rows, index = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for r, i in presence_chunks(array, features, bits, live):
        rows.append(r)
        index.append(i)
    return np.concatenate(rows), np.concatenate(index)


class ByteCache(dict):
    """Values by text in two generations of about ``limit`` bytes each."""

    ENTRY = 200  # bytes that an entry takes besides its text and value

    def __init__(self, make: Callable[[str], bytes], limit: int) -> None:
        super().__init__()
        self.make, self.limit, self.held, self.old = make, limit, 0, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            self.held += self.ENTRY + len(key) + len(value)
            if self.held > self.limit:
                self.old, self.held = dict(self), 0
                self.clear()
            self[key] = value
        return value


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
