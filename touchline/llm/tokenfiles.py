"""Token ids in Arrow stream files of fixed-size-list batches.

Every text becomes the ids of a tokenizer and one end id. Documents are ordered
by id (null first; rows of one id by a hash of the text), cut into shards by
range, and each shard is written by one task as a stream of record batches with
two columns without nulls:

- ``ids``: fixed-size lists of ``LENGTH`` unsigned ids (16 bits if the
  vocabulary allows it, else 32);
- ``mask``: fixed-size lists of as many bits: false for padding, which only
  stands behind the last document of a shard;
- ``last``: bits that are true for the end id of each document.

All batches of a file but the last hold ``ROWS`` sequences and so take the same
number of bytes; the place of any batch follows from the first one, and a mapped
file gives any sequence and its mask without a copy or a scan (``Sequences``).
A second stream file of the shard lists its documents (doc_id, start, length),
and a table of shards says which files belong to the result: a task that is lost
or run twice leaves files that no row of that table names.

Null and empty texts are the end id alone. Repeated rows are written one by one.
An empty table gives no file. Columns besides the id and the text are not read.
A shard streams through its task, so a long text or a hot id does not fill it.
Files are written with ``pyarrow.fs`` to any folder that it and all executors reach.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from touchline.session import shared_folder

from .common import ByteCache, filesystem

LENGTH = 2048  # ids of a sequence
ROWS = 64  # sequences of a batch
SHARD_CHARS = 24 << 20  # characters of text per shard, on average
END_ID = 0
CACHE_BYTES = 40 << 20  # of a generation of a worker's cache

SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _class(kind: str) -> str:
    """The Latin characters of a Unicode class, for patterns of ``re``."""
    found = [c for c in range(0x250) if regex.match(rf"\p{{{kind}}}", chr(c))]
    first = [c for c in found if c - 1 not in found]
    last = [c for c in found if c + 1 not in found]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(first, last, strict=True))


def _pattern(letters: str, digits: str) -> str:
    return rf"'(?:[sdmt]|ll|ve|re)| ?[{letters}]+| ?[{digits}]+| ?[^{SPACE}{letters}{digits}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


LATIN, COMMON = re.compile("[\x00-\u024f]*"), regex.compile("[\x00-\u02ff\u0400-\u045f\u2010-\u2027]*")  # others may be classed anew some day
PIECES, LATIN_PIECES = regex.compile(_pattern(r"\p{L}", r"\p{N}")), re.compile(_pattern(_class("L"), _class("N")))  # the second is faster


class ByteEncoder:
    """Ids of whole texts, equal to those of a byte-level tokenizer file.

    Merges never cross the pieces of the tokenizer's pattern, so a piece is
    merged once and remembered. Texts with special strings or rarer characters
    are encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size(True) <= 1 << 16 else "<u4")
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        others = [b for b in range(256) if b not in printable]
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.by_piece = ByteCache(self._piece, CACHE_BYTES)

    def _packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.type).tobytes()

    def _piece(self, piece: str) -> bytes:
        return self._packed([t.id for t in self.merge(piece.encode().decode("latin-1").translate(self.letters))])

    def encode(self, text: str) -> bytes:
        if "<|" not in text and (text.isascii() or LATIN.fullmatch(text)):
            pieces = LATIN_PIECES.findall(text)
        elif "<|" not in text and COMMON.fullmatch(text):
            pieces = PIECES.findall(text)
        else:
            return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        known = self.by_piece
        return b"".join([known[p] for p in pieces])


_ENCODERS: dict[str, ByteEncoder] = {}


def encoder(path: str) -> ByteEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteEncoder(path)
    return _ENCODERS[path]


class _Writer:
    """The two files of one shard."""

    def __init__(self, folder: str, shard: int, kind: np.dtype, id_type: pa.DataType, length: int, rows: int) -> None:
        self.fs, root = filesystem(folder)
        self.fs.create_dir(root, recursive=True)
        self.name = f"{shard:07d}-{uuid.uuid4().hex}"
        self.kind, self.length, self.rows = kind, length, rows
        value = pa.from_numpy_dtype(kind)
        self.schema = pa.schema([(name, pa.list_(pa.field("item", of, False), length)) for name, of in (("ids", value), ("mask", pa.bool_()), ("last", pa.bool_()))])
        self.schema = pa.schema([f.with_nullable(False) for f in self.schema])
        self.index_schema = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("length", pa.int64())])
        self.streams = [self.fs.open_output_stream(f"{root}/{self.name}.{x}.arrows") for x in ("ids", "docs")]
        self.sequences, self.index = pa.ipc.new_stream(self.streams[0], self.schema), pa.ipc.new_stream(self.streams[1], self.index_schema)
        self.waiting, self.held = [], 0  # ids not yet written
        self.ends: list[np.ndarray] = []  # places of end ids since the last batch
        self.docs = self.ids = self.written = 0

    def add(self, doc_ids: pa.Array, encoded: list[bytes]) -> None:
        size = np.array([len(x) // self.kind.itemsize for x in encoded], np.int64)
        ends = self.ids + np.cumsum(size)
        self.index.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(ends - size), pa.array(size)], schema=self.index_schema))
        self.docs += len(encoded)
        self.ids = int(ends[-1])
        self.ends.append(ends - 1)
        for x in encoded:
            self.waiting.append(x)
            self.held += len(x) // self.kind.itemsize
            if self.held >= self.rows * self.length:
                self._write(False)

    def _write(self, all_of_it: bool) -> None:
        ids, ends, step = np.frombuffer(b"".join(self.waiting), self.kind), np.concatenate(self.ends), self.rows * self.length
        stop = len(ids) if all_of_it else len(ids) // step * step
        for at in range(0, stop, step):
            part = ids[at : at + step]
            last = ends[np.searchsorted(ends, self.written) : np.searchsorted(ends, self.written + len(part))] - self.written
            self._batch(part, last)
            self.written += len(part)
        self.waiting, self.held, self.ends = [ids[stop:].tobytes()], len(ids) - stop, [ends[np.searchsorted(ends, self.written) :]]

    def _batch(self, ids: np.ndarray, last: np.ndarray) -> None:
        size = -(-len(ids) // self.length) * self.length
        columns = np.zeros(size, self.kind), np.arange(size) < len(ids), np.zeros(size, bool)
        columns[0][: len(ids)] = ids
        columns[2][last] = True
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip(columns, self.schema, strict=True)]
        self.sequences.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.held:
            self._write(True)
        for x in (self.sequences, self.index, *self.streams):
            x.close()


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, length: int = LENGTH, rows: int = ROWS, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Write the files of ``docs`` into ``folder``; (shard, name, docs, ids) of each shard, in order.

    Texts are shuffled once, by ranges of ids, and tokenized by the tasks that
    write. The table of shards is kept as Parquet in the same folder.
    """
    spark = docs.sparkSession
    told = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    total = told.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_chars))
    ordered = told.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text", F.spark_partition_id().alias("shard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, shard = None, 0
        for b in batches:
            if not len(b):
                continue
            if out is None:
                encode, kind = encoder(tokenizer).encode, encoder(tokenizer).type
                end, shard = np.array([end_id], kind).tobytes(), b.column(2)[0].as_py()
                out = _Writer(folder, shard, kind, b.column(0).type, length, rows)
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                out.add(part.column(0), [encode(x.as_py() or "") + end for x in part.column(1)])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "name": out.name, "docs": out.docs, "ids": out.ids}], schema=pa.schema([("shard", pa.int32()), ("name", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    made = ordered.mapInArrow(run, "shard int, name string, docs long, ids long")
    made.write.parquet(f"{folder}/shards")
    return spark.read.parquet(f"{folder}/shards")


def flat_ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).flatten().to_numpy(zero_copy_only=True)


class Sequences:
    """Random access to the sequences of one file; local files are mapped, others read in ranges."""

    def __init__(self, folder: str, name: str) -> None:
        fs, root = filesystem(folder)
        path = f"{root}/{name}.ids.arrows"
        self.source = pa.memory_map(path) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(path)
        self.schema = pa.ipc.read_schema(self.source)
        self.first = self.source.tell()
        batch = self._batch(self.first)
        self.rows, self.step = len(batch), self.source.tell() - self.first
        self.length = self.schema.field("ids").type.list_size

    def _batch(self, at: int) -> pa.RecordBatch:
        self.source.seek(at)
        return pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)

    def batch(self, k: int) -> pa.RecordBatch:
        """Batch k over the file's own bytes."""
        return self._batch(self.first + k * self.step)

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of sequence i, without a copy."""
        b, row = self.batch(i // self.rows), i % self.rows
        mask = b.column(1).flatten().slice(row * self.length, self.length)
        return flat_ids(b)[row * self.length : (row + 1) * self.length], mask

    def batches(self) -> Iterator[pa.RecordBatch]:
        k, size = 0, self.source.size()
        while self.first + k * self.step < size - 8:  # the end mark of a stream takes 8 bytes
            yield self.batch(k)
            k += 1

    def tokens(self, start: int, n: int) -> np.ndarray:
        """The ids of a document, given its place in the file."""
        parts, step = [], self.rows * self.length
        for k in range(start // step, (start + n - 1) // step + 1):
            flat = flat_ids(self.batch(k))
            parts.append(flat[max(0, start - k * step) : start + n - k * step])
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def documents(folder: str, name: str) -> pa.Table:
    """(doc_id, start, length) of the documents of one file."""
    fs, root = filesystem(folder)
    path = f"{root}/{name}.docs.arrows"
    with pa.memory_map(path) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(path) as source:
        return pa.ipc.open_stream(source).read_all()


def read(spark: SparkSession, folder: str, id_type: str = "long") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, from the files alone.

    ``start`` counts the ids of all documents before; the crc is taken over the
    ids as little-endian unsigned 32-bit integers. The driver gets one row per
    shard. A file whose marks disagree with its list of documents is an error.
    """
    shards = spark.read.parquet(f"{folder}/shards").orderBy("shard").toPandas()
    if not len(shards):
        return spark.createDataFrame([], f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")
    shards["base"] = shards["ids"].cumsum() - shards["ids"]
    files = spark.createDataFrame(shards[["name", "base"]]).repartition(len(shards))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield from _digests(folder, name, base)

    return files.mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def _digests(folder: str, name: str, base: int) -> Iterator[pa.RecordBatch]:
    listed, done, size, crc = documents(folder, name), 0, 0, 0
    for batch in Sequences(folder, name).batches():
        ids = flat_ids(batch).astype("<u4")
        mask, last = (c.flatten().to_numpy(zero_copy_only=False) for c in batch.columns[1:])
        sizes, crcs, at = [], [], 0
        for end in np.flatnonzero(last) + 1:
            sizes.append(size + int(end) - at)
            crcs.append(zlib.crc32(ids[at:end], crc))
            at, size, crc = int(end), 0, 0
        rest = int(mask[at:].sum())
        size, crc = size + rest, zlib.crc32(ids[at : at + rest], crc)
        own = listed.slice(done, len(sizes))
        if own.column("length").to_pylist() != sizes:
            raise ValueError(f"{name}: its marks disagree with its documents")
        done += len(sizes)
        if sizes:
            start = own.column("start").combine_chunks().to_numpy() + base
            columns = [own.column("doc_id").combine_chunks(), pa.array(start, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])
    if done != len(listed) or size:
        raise ValueError(f"{name}: it ends inside a document")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
