"""Toxicity: linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its hashed character n-grams (``SIZES`` characters). Below
U+0250 letters and digits are lower-cased and every other character is a space;
characters from there on stay as they are. Feature f has the ratio
r_f = log((p_f + a) / (P + 2a)) - log((q_f + a) / (Q + 2a)), from the labelled
texts of either class that hold it; the classifier is a logistic regression
over presence times r, so that a weight of the scorer is w_f * r_f. Features
whose ratio is nearer to zero than ``MIN_RATIO``, or that fewer than ``LEAST_TEXTS``
texts of the sample hold, get weight zero. A very long text is read in windows
that overlap by an n-gram, so it takes no more working memory than others.

Texts that are null or empty hold no feature and score the bias alone. Rows are
scored one by one: repeated rows score alike, an empty table gives an empty
result, extra columns pass through, and a column called like the score is
replaced. Without labelled rows of both classes every score is the share of
label 1 (0 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField

from .common import CHUNK_BYTES, NGRAM_FACTOR, PresenceModel, append_columns, mixed, presence_chunks, presence_rows, sample_of_labels

SIZES = (3, 4, 5, 6)
BITS = 20
FIT_ROWS = 8000  # bound of the labelled sample
SMOOTHING = 1.0
LEAST_TEXTS = 3
PAIRS_AT_ONCE = 1 << 21  # of text and feature, in a step of the fit
MIN_RATIO = 1.0  # features whose ratio is nearer to zero weigh nothing
RIDGE = 5.0
STEPS = 80

_LOWER = np.arange(0x250, dtype=np.uint32)
for _i in range(0x250):
    _c = chr(_i).lower()
    _LOWER[_i] = ord(_c) if len(_c) == 1 and _c.isalnum() else 32


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of a chunk and the offsets of its texts among them."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return np.where(points < len(_LOWER), _LOWER[np.minimum(points, len(_LOWER) - 1)], points), before[offsets]


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text index, n-gram bucket) of every n-gram that lies inside one text."""
    if len(offsets) == 2 and len(data) > 2 * CHUNK_BYTES:
        first = np.flatnonzero((data & 0xC0) != 0x80)  # of the characters
        step, more = CHUNK_BYTES // 2, max(SIZES) - 1
        for a in range(0, len(first), step):
            part = data[first[a] : first[a + step + more] if a + step + more < len(first) else len(data)]
            yield from features(part, np.array([0, len(part)]), bits)
        return
    points, places = characters(data, offsets)
    padded = np.concatenate([points.astype(np.uint64), np.full(max(SIZES), 32, np.uint64)])
    n = len(points)
    if not n:
        return
    rows = np.repeat(np.arange(len(places) - 1, dtype=np.int32), np.diff(places))
    left = places[1:][rows] - np.arange(n)  # characters to the end of the text
    h = np.zeros(n, np.uint64)
    for k in range(max(SIZES)):
        h = h * NGRAM_FACTOR + padded[k : k + n]
        if k + 1 in SIZES:
            inside = left > k
            yield rows[inside], (mixed(h[inside]) >> np.uint64(64 - bits)).astype(np.int64)


def _parts(ends: np.ndarray) -> list[tuple[int, int]]:
    """Runs of texts of about ``PAIRS_AT_ONCE`` pairs together, at least one text each."""
    out, a = [], 0
    while a < len(ends) - 1:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + PAIRS_AT_ONCE, "right")) - 1)
        out.append((a, b))
        a = b
    return out


def fit_texts(texts: pa.Array, labels: np.ndarray, bits: int = BITS) -> PresenceModel:
    """Ratios and weights from the texts of the sample."""
    pos, neg = int((labels == 1).sum()), int((labels != 1).sum())
    if not pos or not neg:
        share = pos / max(pos + neg, 1)
        return PresenceModel(bits, np.zeros(1 << bits, np.float32), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    p, q = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
    for r, i in presence_chunks(texts, features, bits):
        positive = labels[r] == 1
        p += np.bincount(i[positive], minlength=1 << bits)
        q += np.bincount(i[~positive], minlength=1 << bits)
    ratio = np.log((p + SMOOTHING) / (pos + 2 * SMOOTHING)) - np.log((q + SMOOTHING) / (neg + 2 * SMOOTHING))
    ratio[(np.abs(ratio) < MIN_RATIO) | (p + q < LEAST_TEXTS)] = 0
    names = np.flatnonzero(ratio)
    rows, index = presence_rows(texts, features, bits, ratio != 0)  # a second pass keeps what weighs
    place = (np.cumsum(ratio != 0) - 1)[index].astype(np.int32)
    del index
    r, y = ratio[names], (labels == 1).astype(float)
    ends = np.searchsorted(rows, np.arange(len(y) + 1))  # rows are sorted
    del rows
    parts = _parts(ends)
    w, bias = np.zeros(len(names)), float(np.log(pos / neg))
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, STEPS + 1):  # Adam on the whole sample
        z, slope, scaled = np.full(len(y), bias), np.zeros(len(names)), w * r
        for a, b in parts:
            sums = np.append(0.0, np.cumsum(scaled[place[ends[a] : ends[b]]]))
            z[a:b] += np.diff(sums[ends[a : b + 1] - ends[a]])
        error = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - y
        for a, b in parts:
            slope += np.bincount(place[ends[a] : ends[b]], weights=np.repeat(error[a:b], np.diff(ends[a : b + 1])), minlength=len(names))
        gradient = np.append(slope * r / len(y) + RIDGE * w / len(y), error.mean())
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    weights = np.zeros(1 << bits, np.float32)
    weights[names] = w * ratio[names]
    return PresenceModel(bits, weights, float(bias))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 4, part: int = 2, rows: int = FIT_ROWS) -> PresenceModel:
    """Fit on a sample of about ``rows`` labelled documents outside fold ``part`` of ``parts``.

    The sample's ids are bounded by ``rows``, so they are broadcast to the one
    scan of the texts; one task fits the bounded sample and returns the weights.
    """
    chosen = sample_of_labels(labels, label, parts, part, rows, label)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")

    def one_task(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        model = fit_texts(rows.column("text"), rows.column("label").to_numpy())
        return pa.table({"weights": pa.array([model.weights.tobytes()], pa.binary()), "bias": [model.bias]})

    found = sample.groupBy(F.lit(0).alias("all")).applyInArrow(one_task, "weights binary, bias double").collect()
    if not found:
        return PresenceModel(BITS, np.zeros(1 << BITS, np.float32), -60.0)
    return PresenceModel(BITS, np.frombuffer(found[0]["weights"], np.float32), found[0]["bias"])


def score(docs: DataFrame, model: PresenceModel, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability that each whole text is toxic; one narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS weights
    at = docs.columns.index(text)
    return append_columns(docs, [StructField(out, DoubleType())], lambda b: [pa.array(shared.value.score(b.column(at), features), pa.float64())])
