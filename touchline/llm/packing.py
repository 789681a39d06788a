"""Best-fit packing by sums of squares.

Texts become token ids, long ones are cut into pieces of ``capacity``, and the
pieces are placed into sequences. With N(g) the number of open sequences whose
residual gap is g, a piece goes where the sum of N(g)^2 becomes smallest: into
an open sequence or a new one. Full sequences leave the count.

Pieces are dealt by hash into parts of about ``PART_ROWS`` rows, each packed by
one task; a full part holds thousands of sequences, so what its last open ones
waste is small, and those are packed together once more: an unfilled sequence
acts as one piece of its content. Longest pieces are placed first.

A null or empty text is the end id alone. Repeated rows are packed one by one.
An empty table gives an empty result. Columns besides the id and the text are
not read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import ByteCache, saved, text_chunks

CAPACITY = 2048
END_ID = 0
PART_ROWS = 1 << 16
CACHE_BYTES = 40 << 20  # of a generation of a worker's cache
ENCODE_BYTES = 4 << 20  # text encoded at a time
SPACE, LETTER, DIGIT, OTHER, RARE = range(5)
LATIN = range(0x180)  # characters of one or two bytes that are told apart here
PLAIN = re.compile("[\t-\r -~¡-įı-ſ]*")  # characters that lower-case one by one


def _kind(c: str) -> int:
    if c in "\x85\xa0":
        return SPACE
    if not PLAIN.fullmatch(c):
        return RARE
    return next(k for k, pattern in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (DIGIT, r"\p{N}"), (OTHER, "")) if regex.match(pattern, c))


KINDS = np.array([_kind(chr(c)) for c in LATIN], np.uint8)
LOWER = np.array([ord(chr(c).lower()) if PLAIN.fullmatch(chr(c)) else c for c in LATIN], np.uint16)
BYTE_KINDS = np.append(KINDS[:128], np.full(128, RARE, np.uint8))
BYTE_LOWER = np.append(LOWER[:128], np.arange(128, 256)).astype(np.uint8)
ENDINGS = [b"s", b"t", b"m", b"d", b"re", b"ve", b"ll"]  # after an apostrophe


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased matches of the tokenizer's pattern in texts given as bytes, and the first match of each text and the end.

    A word with rarer characters or the start of a special string is one match, in its own case.
    """
    n, data = len(data), np.append(data, np.zeros(3, np.uint8))
    kinds, low = BYTE_KINDS[data], BYTE_LOWER[data]
    begins = np.zeros(n + 4, bool)
    begins[offsets] = True
    lead = np.flatnonzero((data >= 0xC2) & (data < 0xC6))
    lead = lead[(data[lead + 1] >> 6 == 2) & ~begins[lead + 1]]
    code = (data[lead] & np.uint16(31)) << np.uint16(6) | data[lead + 1] & np.uint16(63)
    kinds[lead] = kinds[lead + 1] = KINDS[code]
    low[lead], low[lead + 1] = 0xC0 | LOWER[code] >> 6, 0x80 | LOWER[code] & 63

    starts = begins.copy()
    starts[1 : n + 1] |= (kinds[1 : n + 1] != kinds[:n]) | (kinds[1 : n + 1] == DIGIT)
    starts[lead + 1] = False
    quote = np.flatnonzero((data[:n] == ord("'")) & starts[:n])
    for ending in ENDINGS:
        at = quote
        for k, c in enumerate(ending, 1):
            at = at[~begins[at + k] & (low[at + k] == c)]
        starts[at + 1], starts[at + len(ending) + 1] = False, True

    kept = kinds[:n] != SPACE
    special = (data[:n] == ord("<")) & (data[1 : n + 1] == ord("|")) & ~begins[1 : n + 1]
    rare = np.flatnonzero((kinds[:n] == RARE) | special)
    if len(rare):
        before = np.append(False, kept[:-1]) & ~begins[:n]  # whether a word goes on from the byte before
        first, last = np.flatnonzero(kept & ~before), np.flatnonzero(kept & ~np.append(before[1:] & kept[1:], False))
        for k in np.unique(np.searchsorted(first, rare, "right") - 1):
            a, z = first[k], last[k] + 1
            starts[a + 1 : z] = False
            low[a:z] = data[a:z]

    matches = np.flatnonzero(starts[:n] & kept)
    text, marks = low[:n][kept], starts[:n][kept]
    ends = np.append(np.flatnonzero(marks), len(text)).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(matches), [None, pa.py_buffer(ends), pa.py_buffer(text)])
    return found, np.searchsorted(matches, offsets)


class Encoder:
    """Ids of whole texts as little-endian bytes, equal to the tokenizer's own.

    The tokenizer drops white space and no match crosses it. Texts are split
    into matches as byte arrays, and each different match goes to the merges
    once and is remembered. Words with rarer characters or special strings are
    encoded whole.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.known = ByteCache(self._match, CACHE_BYTES)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        others = [b for b in range(256) if b not in printable]
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}

    def _match(self, match: bytes) -> bytes:
        text = match.decode()
        if not PLAIN.fullmatch(text) or "<|" in text:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = [t.id for t in self.merge(text if text.isascii() else match.decode("latin-1").translate(self.letters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Ids of the texts between ``offsets``; a long one is taken in runs of words."""
        if len(offsets) == 2 and len(data) > 2 * ENCODE_BYTES:
            return [b"".join([self._encode(run, np.array([0, len(run)]))[0] for run in _runs(data)])]
        return self._encode(data, offsets)

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        found, first = split(data, offsets)
        coded, known = found.dictionary_encode(), self.known
        ids = pa.array([known[m] for m in _values(coded.dictionary)], pa.binary()).take(coded.indices)
        at = np.frombuffer(ids.buffers()[1], np.int32)[: len(ids) + 1][first] if len(ids) else first
        joined = memoryview(ids.buffers()[2] or b"")
        return [bytes(joined[a:z]) for a, z in zip(at[:-1], at[1:], strict=True)]


def _values(array: pa.Array) -> list[bytes]:
    """The values of a binary array without nulls, faster than its own list."""
    if not len(array):
        return []
    data, at = array.buffers()[2].to_pybytes(), np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1].tolist()
    return [data[a:z] for a, z in zip(at[:-1], at[1:], strict=True)]


def _runs(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in runs of about ``ENCODE_BYTES`` that end at white space."""
    start = at = 0
    while at < len(data):
        at += ENCODE_BYTES
        space = np.flatnonzero(BYTE_KINDS[data[at : at + ENCODE_BYTES]] == SPACE)
        if len(space):
            at += int(space[0])
            yield data[start:at]
            start = at
    yield data[start:]


_ENCODERS: dict[str, Encoder] = {}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of all texts; one narrow pass."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _ENCODERS:
            _ENCODERS[tokenizer] = Encoder(tokenizer)
        encode, end, width = _ENCODERS[tokenizer].encode, struct.pack("<I", end_id), 4 * capacity
        for b in batches:
            for first, _, data, offsets in text_chunks(b.column(1), ENCODE_BYTES):
                at, number, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(encode(data, offsets), first):
                    ids += end
                    for k, s in enumerate(range(0, len(ids), width)):
                        part = ids[s : s + width]
                        at.append(i)
                        number.append(k)
                        start.append(s // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def place(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, placed in the given order by sums of squares."""
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]  # open sequences by gap
    n = np.zeros(capacity + 1, np.int64)
    sequence, offset, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i, size in enumerate(lengths):
        size = int(size)
        # change of the sum of squares, halved and without terms common to all choices
        after = np.zeros(capacity + 1 - size, np.float64)
        after[1:] = n[1 : capacity + 1 - size] + 0.5
        change = after - np.append(n[size:capacity] - 0.5, 0.0)
        change[:-1][n[size:capacity] == 0] = np.inf
        left = int(change.argmin())  # the smallest gap on ties
        gap = left + size
        if gap == capacity:
            where, made = made, made + 1
        else:
            where = open_at[gap].pop()
            n[gap] -= 1
        sequence[i], offset[i] = where, capacity - gap
        if left:
            open_at[left].append(where)
            n[left] += 1
    return sequence, offset


def _packed(frame: pd.DataFrame, keys: list[str], capacity: int) -> pd.DataFrame:
    """Full pieces stand alone; the others, longest first and then by ``keys``."""
    frame = frame.sort_values(["length", *keys], ascending=[False] + [True] * len(keys), kind="stable")
    full = int((frame["length"] >= capacity).sum())
    sequence, offset = place(frame["length"].to_numpy()[full:], capacity)
    return frame.assign(
        sequence=np.append(np.arange(full), sequence + full).astype(np.int64),
        offset=np.append(np.zeros(full), offset).astype(np.int64),
    )


def pack(rows: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS) -> DataFrame:
    """``rows`` of pieces with sequence_id and offset.

    Two rounds of parts; the second packs the unfilled sequences of the first.
    """
    rows = saved(rows)
    n = rows.count()
    columns = [f"{name} {kind}" for name, kind in rows.dtypes]
    first_parts = max(1, -(-n // part_rows))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(first_parts)))

    def first(frame: pd.DataFrame) -> pd.DataFrame:
        return _packed(frame, ["doc_id", "piece"], capacity)

    packed = saved(dealt.groupBy("part").applyInPandas(first, ", ".join([*columns, "part long", "sequence long", "offset long"])))
    filled = packed.groupBy("part", "sequence").agg(F.sum("length").alias("content"))
    loose = saved(filled.where(F.col("content") < capacity))
    second_parts = max(1, -(-loose.count() // part_rows))

    def second(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.rename(columns={"content": "length", "sequence": "unfilled"})
        out = _packed(frame, ["part", "unfilled"], capacity).rename(columns={"sequence": "joined", "unfilled": "sequence", "offset": "shift"})
        return out[["part", "sequence", "again", "joined", "shift"]]

    again = loose.withColumn("again", F.pmod(F.xxhash64("part", "sequence"), F.lit(second_parts)))
    moved = again.groupBy("again").applyInPandas(second, "part long, sequence long, again long, joined long, shift long")
    out = packed.join(moved, ["part", "sequence"], "left")
    own = F.col("part") * F.lit(1 << 32) + F.col("sequence")
    joint = F.lit(1 << 62) + F.col("again") * F.lit(1 << 32) + F.col("joined")
    return out.select(
        *[F.col(c) for c in rows.columns],
        F.coalesce(joint, own).alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )
