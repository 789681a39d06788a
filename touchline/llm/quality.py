"""Quality: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader.

Words are runs of letters, digits and bytes above ASCII, or runs of other
visible characters, with their case. A text is the set of its hashed words,
word pairs and word triples; a word equal to the one before stands as a mark
for repetition, so that the same mark is learned for every repeated word. The
proximal updates with L1 leave most weights at zero; a score is the sparse dot
product of the features present, through the logistic function.

Texts that are null or empty hold no feature and score the bias. Rows are
scored one by one: repeated rows score alike, an empty table gives an empty
result, extra columns pass through, and a column called like the score is
replaced. Without labelled rows every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField

from .common import NGRAM_FACTOR, PresenceModel, append_columns, mixed, presence_rows, run_hashes, sample_of_labels

SIZE = 3
BITS = 20
FIT_ROWS = 8000  # bound of the labelled sample
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.1, 1.0, 1.0, 1.0
REPEAT = np.uint64(0x51ED270B9F3C1D57)

_KIND = np.full(256, 2, np.uint8)  # 0: white space, 1: word, 2: other
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[0x80:] = 1
for _c in "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _KIND[ord(_c)] = 1


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text index, bucket) of every word n-gram of up to SIZE words inside one text."""
    if not len(data):
        return
    kind = _KIND[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    cut = np.flatnonzero(edge)
    starts, ends = cut[:-1], cut[1:]
    real = kind[starts] != 0
    starts, ends = starts[real], ends[real]
    if not len(starts):
        return
    words = run_hashes(data, starts, ends)
    rows = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(np.searchsorted(starts, offsets)))
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])
    words = np.where(again, REPEAT, words)
    h = np.zeros(len(words), np.uint64)
    for k in range(SIZE):
        n = len(words) - k
        if n <= 0:
            return
        h = h[:n] * NGRAM_FACTOR + words[k:]
        inside = rows[:n] == rows[k:]
        yield rows[:n][inside], (mixed(h[inside] + np.uint64(k)) >> np.uint64(64 - bits)).astype(np.int64)


def fit_texts(texts: pa.Array, labels: np.ndarray, bits: int = BITS) -> PresenceModel:
    """Per-coordinate proximal updates, one text after the other."""
    rows, index = presence_rows(texts, features, bits)
    ends = np.searchsorted(rows, np.arange(len(labels) + 1))
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)  # the last one is the bias
    for _ in range(EPOCHS):
        for i, y in enumerate(labels):
            at = np.append(index[ends[i] : ends[i + 1]], 1 << bits)
            zi, ni = z[at], n[at]
            l1 = np.full(len(at), L1)
            l1[-1] = 0
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -60, 60))) - y
            if abs(g) < 1e-6:
                continue
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + g * g
    l1 = np.full(len(z), L1)
    l1[-1] = 0
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return PresenceModel(bits, w[:-1].astype(np.float32), float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 5, part: int = 0, rows: int = FIT_ROWS) -> PresenceModel:
    """Fit on a sample of about ``rows`` labelled documents outside fold ``part`` of ``parts``.

    The sample's ids are bounded by ``rows``, so they are broadcast to the one
    scan of the texts; one task fits the bounded sample and returns the weights.
    """
    chosen = sample_of_labels(labels, label, parts, part, rows, label)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")

    def one_task(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        dealt = pd.util.hash_array(rows.column("doc_id").to_numpy()).argsort(kind="stable")  # no order of ids while learning
        rows = rows.take(pa.array(dealt))
        model = fit_texts(rows.column("text"), rows.column("label").to_numpy())
        return pa.table({"weights": pa.array([model.weights.tobytes()], pa.binary()), "bias": [model.bias]})

    found = sample.groupBy(F.lit(0).alias("all")).applyInArrow(one_task, "weights binary, bias double").collect()
    if not found:
        return PresenceModel(BITS, np.zeros(1 << BITS, np.float32), 0.0)
    return PresenceModel(BITS, np.frombuffer(found[0]["weights"], np.float32), found[0]["bias"])


def score(docs: DataFrame, model: PresenceModel, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability that each whole text is of good quality; one narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS weights
    at = docs.columns.index(text)
    return append_columns(docs, [StructField(out, DoubleType())], lambda b: [pa.array(shared.value.score(b.column(at), features), pa.float64())])
