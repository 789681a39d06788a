"""Language identification by partial matching (PPM) over bytes with frozen statistics.

Every language owns a context tree of depth ``ORDER``: how often a symbol
followed each of the last three, two, one and zero symbols. Symbols are bytes
with A-Z lower-cased; every byte value of the training texts stands for itself,
of whatever language or script. The values that no training text has, so that
no tree can tell them apart, share one symbol and are told apart at a uniform cost.
In the deepest context that the language has seen, a symbol seen there costs
-log2(c / (T + d)), c its count, T the total and d the number of different
symbols; else an escape -log2(d / (T + d)) is paid and the context gets
shorter, down to a uniform choice among 64, 128 or 256 symbols, whichever
first holds all. Contexts never seen cost nothing to leave.
The costs are exact sums of these, no symbol is skipped, and scoring does not
change the statistics. A text belongs to the language with the shortest code;
its score is that language's share in the posterior with equal priors.

As the statistics are frozen, the code length of a symbol depends on four
symbols alone, so all costs are tabulated once: dense for contexts of at most
one symbol, and sorted tables with one row for each string of three or four
symbols seen. The model grows with the different strings of four bytes that the
texts hold and the number of languages, not with the number of texts.

A text that is null or has no letter is ``und`` with score 0; ties go to the
smaller name. Rows are judged one by one: repeated rows alike, an empty table
gives an empty result, extra columns pass through, columns called like the
results are replaced. Without training rows every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from .common import CHUNK_BYTES, append_columns, held_out, text_chunks

SYMBOLS = 256
OTHER = SYMBOLS - 1  # no byte of UTF-8
LEAST_UNIFORM = 6  # bits of the uniform choice at least
PAD = 32  # stands before every text
ORDER = 3
LETTER = regex.compile(r"\p{L}")
STRINGS_AT_ONCE = 1 << 20  # counted strings that a task keeps before it hands them on

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def alphabet(docs: DataFrame) -> np.ndarray:
    """Symbol of each byte: itself if any text of ``docs`` has it."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for b in batches:
            for _, _, data, _ in text_chunks(b.column(0)):
                total += np.bincount(_LOWER[data], minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total), pa.int32())], names=["byte"])

    found = docs.select("text").mapInArrow(count, "byte int").distinct().collect()  # at most 256 rows
    table = np.full(256, OTHER, np.uint8)
    for byte in {PAD, *(row["byte"] for row in found)}:
        table[byte] = byte
    table[65:91] = table[97:123]
    return table


def codes(symbols: np.ndarray, offsets: np.ndarray, pad: int) -> np.ndarray:
    """The last four symbols up to each place as one number; ``pad`` stands before every text."""
    s = np.concatenate([np.full(ORDER, pad, np.uint8), symbols]).astype(np.uint32)
    n = len(symbols)
    out = (s[:n] << 24) | (s[1 : n + 1] << 16) | (s[2 : n + 2] << 8) | s[3 : n + 3]
    starts = np.unique(offsets[:-1][np.diff(offsets) > 0])
    lengths = offsets[np.searchsorted(offsets, starts, "right")] - starts
    for k in range(ORDER):  # places whose context reaches over the start of the text
        at = starts[lengths > k] + k
        own = out[at] & ((1 << (8 * (k + 1))) - 1)
        before = sum(pad << (8 * j) for j in range(k + 1, ORDER + 1))
        out[at] = own | before
    return out


def added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, sorted, and the sum of ``n`` of each."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def counts(docs: DataFrame, table: np.ndarray, pad: int) -> DataFrame:
    """(lang, code, n): four-symbol strings of all texts, added up inside tasks first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []  # keys are the place of the language and the code, with counts
        size = 0

        def hand_on(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            langs = pa.array(list(names), pa.string())
            for i in range(0, len(keys), 1 << 16):
                part = keys[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(part >> 32)), pa.array(part & 0xFFFFFFFF), pa.array(n[i : i + (1 << 16)])], names=["lang", "code", "n"])

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return added(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))

        for b in batches:
            langs = np.array(b.column(1).to_pylist(), object)
            for lang in sorted(set(langs)):
                place = names.setdefault(lang, len(names))
                for _, _, data, offsets in text_chunks(b.column(0).filter(pa.array(langs == lang))):
                    found, n = np.unique(codes(table[data], offsets, pad), return_counts=True)
                    held.append((found.astype(np.int64) | (place << 32), n.astype(np.int64)))
                    size += len(found)
                    if size > 2 * STRINGS_AT_ONCE:
                        held = [merged()]
                        size = len(held[0][0])
                        if size > STRINGS_AT_ONCE:
                            yield from hand_on(*held.pop())
                            size = 0
        if held:
            yield from hand_on(*merged())

    return docs.select("text", "lang").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


class Model:
    """Cost tables in bits of all languages; ``code`` holds four symbols, ``lang`` the place in ``langs``."""

    def __init__(self, table: np.ndarray, pad: int, langs: list[str], lang: np.ndarray, code: np.ndarray, n: np.ndarray) -> None:
        self.table, self.pad, self.langs = table, pad, langs
        k, own = len(langs), len(set(table.tolist()) - {OTHER})
        self.known = np.unique(code.astype(np.uint32))  # sorted strings of four symbols, a row each
        self.known3 = np.unique(self.known & 0xFFFFFF)  # of three
        self.contexts = np.unique(self.known >> 8)  # contexts of three
        self.shorter = np.zeros((k, SYMBOLS**2), np.float32)  # cost with at most one symbol of context
        self.escape2 = np.zeros((k, SYMBOLS**2), np.float32)  # cost of leaving the context of two symbols
        self.cost3 = np.zeros((k, len(self.known3)), np.float32)
        self.escape3 = np.zeros((k, len(self.contexts) + 1), np.float32)  # the last is that of contexts never seen
        self.full = np.zeros((k, len(self.known)), np.float32)
        uniform = np.full(SYMBOLS, max(LEAST_UNIFORM, np.ceil(np.log2(own + 1))), float)
        uniform[OTHER] += np.log2(max(256 - own, 1))
        for i in range(k):
            mine = lang == i
            code4, n4 = code[mine].astype(np.uint32), n[mine].astype(float)
            cost, _ = self._deeper(np.bincount(code4 & 0xFF, weights=n4, minlength=SYMBOLS)[None, :], uniform[None, :])
            cells = np.bincount(code4 & 0xFFFF, weights=n4, minlength=SYMBOLS**2).reshape(-1, SYMBOLS)
            cost, _ = self._deeper(cells, np.broadcast_to(cost, cells.shape))
            self.shorter[i] = cost.reshape(-1)
            code3, n3 = added(code4 & 0xFFFFFF, n4)
            spent, self.escape2[i] = self._sparse(code3, n3, np.arange(SYMBOLS**2))
            self.cost3[i] = self.escape2[i][self.known3 >> 8] + self.shorter[i][self.known3 & 0xFFFF]
            self.cost3[i][np.searchsorted(self.known3, code3)] = spent
            spent, self.escape3[i, :-1] = self._sparse(code4, n4, self.contexts)
            self.full[i] = self.escape3[i][np.searchsorted(self.contexts, self.known >> 8)] + self.cost3[i][np.searchsorted(self.known3, self.known & 0xFFFFFF)]
            self.full[i][np.searchsorted(self.known, code4)] = spent

    @staticmethod
    def _deeper(cells: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total, kinds = cells.sum(1, keepdims=True), (cells > 0).sum(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
            return np.where(cells > 0, -np.log2(cells / (total + kinds)), escape + below), escape

    @staticmethod
    def _sparse(code: np.ndarray, n: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cost of each different string seen, and of leaving each of the sorted contexts."""
        at = np.searchsorted(contexts, code >> 8)
        total, kinds = np.bincount(at, weights=n, minlength=len(contexts)), np.bincount(at, minlength=len(contexts))
        escape = np.zeros(len(contexts))
        seen = total > 0
        escape[seen] = -np.log2(kinds[seen] / (total[seen] + kinds[seen]))
        return -np.log2(n / (total[at] + kinds[at])), escape

    @staticmethod
    def _places(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of each wanted string in a sorted table, and whether it is there."""
        at = np.minimum(np.searchsorted(known, wanted), max(len(known) - 1, 0))
        return at, known[at] == wanted if len(known) else np.zeros(len(wanted), bool)

    def lengths(self, array: pa.Array) -> np.ndarray:
        """Code length in bits of every text under every language; a very long text is summed part by part."""
        out = np.zeros((len(array), len(self.langs)))
        for first, end, data, offsets in text_chunks(array):
            if not len(data) or not len(self.known):
                continue
            code = codes(self.table[data], offsets, self.pad)
            if len(code) <= 2 * CHUNK_BYTES:
                out[first:end] = self._sums(code, offsets)
                continue
            for a in range(0, len(code), CHUNK_BYTES):
                part = code[a : a + CHUNK_BYTES]
                out[first:end] += self._sums(part, np.array([0, len(part)]))
        return out

    def _sums(self, code: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        slot, there = self._places(self.known, code)
        missing = np.flatnonzero(~there)
        code = code[missing]
        context, there = self._places(self.contexts, code >> 8)
        context[~there] = len(self.contexts)
        code &= 0xFFFFFF
        slot3, there = self._places(self.known3, code)
        short = np.flatnonzero(~there)
        code = code[short]
        full = np.flatnonzero(np.diff(offsets) > 0)
        for i in range(len(self.langs)):
            less = self.cost3[i][slot3]
            less[short] = self.escape2[i][code >> 8] + self.shorter[i][code & 0xFFFF]
            cost = self.full[i][slot]
            cost[missing] = self.escape3[i][context] + less
            out[full, i] = np.add.reduceat(cost, offsets[full], dtype=np.float64)
        return out


def fit(docs: DataFrame, parts: int = 4, part: int = 2) -> Model:
    """Trees of all rows with a language outside fold ``part`` of ``parts``; null texts count as empty."""
    rows = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), parts, part))
    table = alphabet(rows)
    found = counts(rows, table, PAD).toArrow()  # a row for each different string of a language
    names = found.column("lang").combine_chunks().dictionary_encode()
    langs = sorted(names.dictionary.to_pylist())
    rank = np.array([langs.index(x) for x in names.dictionary.to_pylist()], np.int64)
    code, n = (found.column(x).to_numpy() for x in ("code", "n"))
    order = np.argsort(code, kind="stable")
    return Model(table, PAD, langs, rank[names.indices.to_numpy()][order], code[order], n[order])


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score; one narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def judge(b: pa.RecordBatch) -> list[pa.Array]:
        m, texts = shared.value, b.column(at)
        letters = np.array([t is not None and LETTER.search(t) is not None for t in texts.to_pylist()], bool)
        if not m.langs:
            return [pa.array(["und"] * len(texts), pa.string()), pa.array(np.zeros(len(texts)), pa.float64())]
        bits = m.lengths(texts)
        best = bits.argmin(1)  # the first, so the smaller name, on ties
        odds = np.exp2(np.clip(bits.min(1, keepdims=True) - bits, -1000, 0)).sum(1)
        names = np.array(m.langs + ["und"], object)
        return [pa.array(names[np.where(letters, best, len(m.langs))], pa.string()), pa.array(np.where(letters, 1 / odds, 0.0), pa.float64())]

    return append_columns(docs, [StructField("lang_pred", StringType()), StructField("score", DoubleType())], judge)
