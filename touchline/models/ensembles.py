"""Forests and boosted trees grown level by level from histograms.

Features become small bin numbers once and are written with the label and an
integer key per row. A level of all trees that grow together is one pass: tasks
find each row's node, add whole-number statistics into arrays per (tree, node,
feature, bin), and the arrays are summed chunk by chunk; the driver gets the sums, whose
size depends on trees, nodes, features and bins alone. Statistics are fixed-point
numbers, so sums do not depend on the order of rows, and draws are integer hashes
of (tree or round, key): a model depends on its rows alone, not on files,
partitions or cores.

If there are few different rows of bin numbers (cells), tasks sum per cell, and the
driver grows trees from the cells' sums, which are those of the rows: forests and
boosting without Huber's loss then need one pass over the rows, Huber's loss one
per round. With more cells rows are reduced level by level as above.

Thresholds are midpoints of neighboring values for features with up to ``bins``
different ones, else midpoints between values around quantiles, as is usual for
histogram methods. Missing values take the median of their column.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.hashing import PRIME, Draws, poisson_ones, uniforms  # noqa: F401
from ..session import shared_folder
from .lattice import Group, Lattice, boxes
from .prepare import median_impute

BINS = 256
CHUNK = 1 << 15  # numbers of a sum that travel together
LEVEL_NUMBERS = 1 << 22  # statistics of a level kept by a task; more trees grow in several passes
REFRESH = 20  # boosting rounds between written scores
RESIDUAL_BINS = 4096
DIRECT_BYTES = 1 << 25
SCALE_BITS = 61  # of a fixed-point sum
CELLS = 1 << 16  # different rows of bin numbers up to which rows are reduced to sums per such row
CELL_NUMBERS = 1 << 18  # bin numbers of all of them, which the driver keeps
BLOCK = 1 << 15  # rows whose whole numbers are summed at once
PACK = 256  # rows that are written as one where many passes read them
SLOTS = 1 << 12  # numbers of a table from bin numbers to open nodes


# -- binned rows -------------------------------------------------------------------


@dataclass
class Bins:
    """Thresholds of each feature; a value's bin is how many of them lie below it."""

    columns: list[str]
    edges: list[np.ndarray]
    medians: dict[str, float] = field(default_factory=dict)

    @property
    def most(self) -> int:
        return max((len(e) for e in self.edges), default=0) + 1


def bins_of(df: DataFrame, columns: Sequence[str], bins: int = BINS) -> Bins:
    """Two scans: how many values a column has about, then its values or its quantiles."""
    clean = df.select(*[F.nanvl(F.col(x).cast("double"), F.lit(None).cast("double")).alias(f"c{i}") for i, x in enumerate(columns)])
    told = clean.agg(*[F.approx_count_distinct(f"c{i}").alias(f"d{i}") for i in range(len(columns))], *[F.count_if(F.col(f"c{i}").isNull()).alias(f"n{i}") for i in range(len(columns))]).first()
    holes = [x for i, x in enumerate(columns) if told[f"n{i}"]]
    medians = median_impute(df, holes).medians if holes else {}
    few = [told[f"d{i}"] <= 1.3 * bins for i in range(len(columns))]
    shares = [k / bins for k in range(1, bins)]
    found = clean.agg(*[(F.sort_array(F.collect_set(f"c{i}")) if few[i] else F.percentile_approx(f"c{i}", shares, 100 * bins)).alias(f"v{i}") for i in range(len(columns))]).first()
    edges = []
    for i, x in enumerate(columns):
        values = np.unique(np.array([*(found[f"v{i}"] or []), *([medians[x]] if x in medians and few[i] else [])], dtype=float))
        if few[i] and len(values) > bins:
            values = values[np.linspace(0, len(values) - 1, bins).astype(int)]
        edges.append((values[:-1] + values[1:]) / 2 if len(values) > 1 else np.zeros(0))
    return Bins(list(columns), edges, medians)


def imputed(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    return df.withColumns({x: F.coalesce(F.nanvl(F.col(x).cast("double"), F.lit(None).cast("double")), F.lit(m)) for x, m in medians.items()}) if medians else df


def _saved(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/trees-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def binned_rows(df: DataFrame, bins: Bins, label: str, key: str, scores: Sequence[float] = ()) -> DataFrame:
    """(codes, y, k, s): bin numbers as bytes, label, key modulo PRIME, scores so far."""
    wide = bins.most > 256
    kind = np.dtype("<u2") if wide else np.dtype("u1")
    src = imputed(df, bins.medians).where(F.col(label).isNotNull())
    src = src.select(*[F.col(x).cast("double").alias(f"c{i}") for i, x in enumerate(bins.columns)], F.col(label).cast("double").alias("y"), F.coalesce(F.pmod(F.col(key).cast("long"), F.lit(PRIME)), F.lit(0)).alias("k"))
    edges, start = bins.edges, list(map(float, scores))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = np.empty((len(b), len(edges)), kind)
            for i, e in enumerate(edges):
                codes[:, i] = np.searchsorted(e, b.column(i).to_numpy(zero_copy_only=False), side="left")
            flat, step = codes.tobytes(), codes.shape[1] * kind.itemsize
            parts = pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer((np.arange(len(b) + 1) * step).astype(np.int32)), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([parts, b.column(len(edges)), b.column(len(edges) + 1), _score_lists(np.tile(start, (len(b), 1)))], names=["codes", "y", "k", "s"])

    return _saved(src.mapInArrow(run, "codes binary, y double, k long, s array<double>"))


def _score_lists(s: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array((np.arange(len(s) + 1) * s.shape[1]).astype(np.int32)), pa.array(s.reshape(-1).astype(float)))


def _flat(column: pa.Array, kind: str) -> np.ndarray:
    """The numbers of a binary column, which stand side by side."""
    if not len(column):
        return np.zeros(0, kind)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)
    whole = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return whole[offsets[column.offset] : offsets[column.offset + len(column)]].view(kind)


def _is_packed(b: pa.RecordBatch) -> bool:
    return not pa.types.is_floating(b.column(1).type)


def _arrays(b: pa.RecordBatch, features: int, wide: bool, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    codes = _flat(b.column(0), "<u2" if wide else "u1")
    if _is_packed(b):
        y, k, s = (_flat(b.column(i), kind) for i, kind in ((1, "<f8"), (2, "<i8"), (3, "<f8")))
    else:
        y, k, s = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(), b.column(3).flatten().to_numpy(zero_copy_only=False)
    return codes.reshape(len(y), features), y, k, s.reshape(len(y), classes)


def _packs(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    """Rows of ``values`` up to each of the ``ends`` as one binary value."""
    size = values.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    offsets = (np.concatenate([[0], ends]) * size).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _pack_ends(n: int) -> np.ndarray:
    return np.append(np.arange(PACK, n, PACK), n)


def packed_rows(rows: DataFrame, features: int, wide: bool, outputs: int) -> DataFrame:
    """Binned rows, ``PACK`` of them as one: passes then cost no time per row outside of Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                ends = _pack_ends(len(b))
                yield pa.RecordBatch.from_arrays([_packs(ends, x) for x in _arrays(b, features, wide, outputs)], names=["codes", "y", "k", "s"])

    return _saved(rows.mapInArrow(run, "codes binary, y binary, k binary, s binary"))


# -- cells ---------------------------------------------------------------------------


@dataclass
class Cells:
    """The different rows of bin numbers, in the order of their numbers in mixed radix."""

    codes: np.ndarray  # (cell, feature)
    radix: np.ndarray  # of each feature
    sorted: np.ndarray

    def of(self, codes: np.ndarray) -> np.ndarray:
        """Cell of each row."""
        return np.searchsorted(self.sorted, codes.astype(np.int64) @ self.radix)


def cells_of(rows: DataFrame, bins: Bins, different: int) -> Cells | None:
    """The cells of binned ``rows`` with about ``different`` ones; None if they are too many."""
    features, most = len(bins.columns), min(CELLS, CELL_NUMBERS // max(len(bins.columns), 1))
    sizes = [len(e) + 1 for e in bins.edges]
    if not features or different > 1.2 * most or float(np.prod(np.array(sizes, dtype=float))) >= 2.0**62:
        return None
    found = rows.select("codes").distinct().limit(most + 1).collect()
    if len(found) > most or not found:
        return None
    kind = np.dtype("<u2") if bins.most > 256 else np.dtype("u1")
    codes = np.frombuffer(b"".join(bytes(r["codes"]) for r in found), kind).reshape(len(found), features)
    radix = np.array([int(np.prod(sizes[f + 1 :], dtype=np.int64)) for f in range(features)], np.int64)
    numbers = codes.astype(np.int64) @ radix
    order = np.argsort(numbers)
    return Cells(codes[order].astype(np.int64), radix, numbers[order])


def _halves(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers as low and high parts whose sums over a block are exact in doubles."""
    low = values & 0x7FFFFFFF
    return low.astype(float), ((values - low) >> 31).astype(float)


def _add_halves(total: np.ndarray, place: np.ndarray, parts: tuple[np.ndarray, np.ndarray], weight: np.ndarray | None = None) -> None:
    """Add weighted whole numbers by place; weights are small whole numbers."""
    low, high = parts if weight is None else (parts[0] * weight, parts[1] * weight)
    total += np.bincount(place, low, len(total)).astype(np.int64) + (np.bincount(place, high, len(total)).astype(np.int64) << 31)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        step = BLOCK // PACK if _is_packed(b) else BLOCK
        for at in range(0, len(b), step):
            yield b.slice(at, step)


def _cell_histograms(cells: Cells, slot: np.ndarray, slots: int, width: int, stats: np.ndarray) -> np.ndarray:
    """(slot, feature, bin, stat) sums over cells of their sums (cell, stat); slot -1 is left out."""
    use = slot >= 0
    return _histogram(cells.codes[use], slot[use], slots, width, list(stats[use].T), cells.codes.shape[1])


# -- trees -------------------------------------------------------------------------


@dataclass
class Tree:
    """Nodes as parallel lists; feature -1 is a leaf. ``cut`` is the last bin that goes left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[list[float]] = field(default_factory=lambda: [[0.0]])
    cover: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, threshold: float) -> tuple[int, int]:
        a = len(self.feature)
        self.feature[node], self.cut[node], self.threshold[node], self.left[node], self.right[node] = feature, cut, threshold, a, a + 1
        for _ in range(2):
            for name, empty in (("feature", -1), ("cut", 0), ("threshold", 0.0), ("left", -1), ("right", -1), ("value", [0.0]), ("cover", 0.0)):
                getattr(self, name).append(empty)
        return a, a + 1

    def nodes_of(self, codes: np.ndarray) -> np.ndarray:
        """Node that each row of bin numbers reaches."""
        return self._walk(codes, np.array(self.cut))

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, np.array(self.threshold))

    def _walk(self, x: np.ndarray, bound: np.ndarray) -> np.ndarray:
        feature, left, right = np.array(self.feature), np.array(self.left), np.array(self.right)
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(rows):
            f = feature[at[rows]]
            rows, f = rows[f >= 0], f[f >= 0]
            here = at[rows]
            at[rows] = np.where(x[rows, f] <= bound[here], left[here], right[here])
        return at


def summed(rows: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], np.ndarray], numbers: int, tasks: int) -> np.ndarray:
    """The sum over ``tasks`` of the array of whole numbers that ``task`` makes of its batches.

    Arrays travel in chunks that are added up separately, and the driver gets one
    array. If the arrays of all tasks together stay below ``DIRECT_BYTES``, it adds
    them itself, which saves a shuffle; whole numbers give the same sums either way.
    """

    def partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = task(batches).reshape(-1)
        for c, at in enumerate(range(0, len(total), CHUNK)):
            part = total[at : at + CHUNK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["chunk", "sums"])

    def add(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        chunk = 0
        for b in tables:
            for c, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                values = np.frombuffer(x.as_buffer(), np.int64)
                total, chunk = (values.copy() if total is None else total + values), c
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["chunk", "sums"])

    parts = rows.mapInArrow(partial_sums, "chunk int, sums binary")
    if tasks * numbers * 8 > DIRECT_BYTES:
        parts = parts.groupBy("chunk").applyInArrow(lambda t: pa.Table.from_batches(add(iter(t.to_batches()))), "chunk int, sums binary")
    out = np.zeros(numbers, np.int64)
    for r in parts.collect():
        values = np.frombuffer(r["sums"], np.int64)
        out[r["chunk"] * CHUNK : r["chunk"] * CHUNK + len(values)] += values
    return out


def _histogram(codes: np.ndarray, slot: np.ndarray, slots: int, width: int, stats: list[np.ndarray], features: int) -> np.ndarray:
    """(slot, feature, bin, stat) sums of whole numbers; float64 keeps them exact below 2^53 per call."""
    out = np.zeros((slots, features, width, len(stats)), np.int64)
    for f in range(features):
        place = slot * width + codes[:, f]
        for j, s in enumerate(stats):
            out[:, f, :, j] += _whole_sums(place, s, slots * width).reshape(slots, width)
    return out


def _whole_sums(place: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Exact sums of whole numbers by place: two halves of 31 bits, each exact in doubles."""
    if values.dtype != np.int64 or (len(values) and np.abs(values).max() < 1 << 31):
        return np.rint(np.bincount(place, weights=values, minlength=size)).astype(np.int64)
    low = values & 0x7FFFFFFF
    high = (values - low) >> 31
    return np.bincount(place, weights=low, minlength=size).astype(np.int64) + (np.bincount(place, weights=high, minlength=size).astype(np.int64) << 31)


class _Growing:
    """Trees that grow together, level by level."""

    def __init__(self, bins: Bins, trees: int, least: float, allowed: Callable[[int, int], np.ndarray]) -> None:
        self.bins, self.least, self.allowed = bins, least, allowed
        self.trees = [Tree() for _ in range(trees)]
        self.open = [[0] for _ in range(trees)]  # nodes of the newest level

    def slots(self) -> list[np.ndarray]:
        """For each tree: node -> slot among all open nodes, -1 for the others."""
        out, at = [], 0
        for tree, nodes in zip(self.trees, self.open, strict=True):
            slot = np.full(len(tree.feature), -1)
            slot[nodes] = at + np.arange(len(nodes))
            at += len(nodes)
            out.append(slot)
        return out

    def finder(self) -> Callable[[np.ndarray], Iterator[tuple[int, int, int, np.ndarray]]]:
        """A function from bin numbers to (tree, first slot, slots, slot of each row among them) of all trees with open nodes.

        Rows that lie in no open node get the slot behind the last one.
        """
        told = []
        slots = self.slots()
        for t, tree in enumerate(self.trees):
            if self.open[t]:
                low, count = int(slots[t][self.open[t][0]]), len(self.open[t])
                own = np.where(slots[t] < 0, count, slots[t] - low)
                told.append((t, low, count, own, Lattice([tree], "cut", 1, partial(_fill_slots, tree=tree, own=own), self.bins.most, SLOTS, SLOTS, np.int64)))
        trees = self.trees

        def find(codes: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
            columns = {f: codes[:, f].astype(np.intp) for f in {f for x in told for g in x[4].groups if g.table is not None for f in g.features}}
            for t, low, count, own, lattice in told:
                g = lattice.groups[0]
                yield t, low, count, own[trees[t].nodes_of(codes)] if g.table is None else g.table[Lattice.rows(g, columns, len(codes)), 0]

        return find

    def grow(self, sums: np.ndarray, gain_of: Callable, value_of: Callable, weight_of: Callable, last: bool) -> None:
        """Split the open nodes by the sums (slot, feature, bin, stat); the last level only gets its values."""
        at = 0
        for t, tree in enumerate(self.trees):
            nodes, self.open[t] = self.open[t], []
            for node in nodes:
                own = sums[at]
                at += 1
                total = own[0].sum(axis=0) if len(own) else np.zeros(own.shape[-1])
                tree.value[node], tree.cover[node] = value_of(total), float(weight_of(total))
                if last:
                    continue
                best = self._best(own, total, gain_of, weight_of, self.allowed(t, node))
                if best is None:
                    continue
                f, cut = best
                a, b = tree.split(node, f, cut, float(self.bins.edges[f][cut]))
                left = own[f, : cut + 1].sum(axis=0)
                for child, part in ((a, left), (b, total - left)):
                    tree.value[child], tree.cover[child] = value_of(part), float(weight_of(part))
                self.open[t] += [a, b]

    def _best(self, own: np.ndarray, total: np.ndarray, gain_of, weight_of, allowed: np.ndarray) -> tuple[int, int] | None:  # noqa: ANN001
        left = np.cumsum(own, axis=1)[:, :-1]
        if not left.shape[1]:
            return None
        right = total - left
        gain = gain_of(left, right, total)
        ok = (weight_of(left) >= self.least) & (weight_of(right) >= self.least)
        for f, e in enumerate(self.bins.edges):
            ok[f, len(e) :] = False
        ok[~allowed] = False
        # a bin without rows of the node moves no row: the first of equal cuts stands
        gain = np.where(ok, gain, -np.inf)
        if not np.isfinite(gain).any() or gain.max() <= 1e-12 * max(1.0, abs(float(gain.max()))):
            return None
        return tuple(int(i) for i in np.unravel_index(int(gain.argmax()), gain.shape))


def _fill_slots(table: np.ndarray, group: Group, _: int, tree: Tree, own: np.ndarray) -> None:
    for leaf, box in boxes(tree, "cut", group):
        table[box] = own[leaf]


def _columns_of(share: float | str, features: int) -> int:
    if share == "sqrt":
        return max(1, int(features**0.5))
    return features if share in ("all", 1.0) else max(1, int(float(share) * features))


def _subset(features: int, count: int, seed: int) -> Callable[[int, int], np.ndarray]:
    """Features that a node may split on, by hash of (tree, node, feature)."""

    def allowed(tree: int, node: int) -> np.ndarray:
        out = np.ones(features, bool)
        if count < features:
            u = uniforms(tree * 65537 + node + 1, np.arange(features, dtype=np.int64) + 1, seed + 7)
            out[:] = False
            out[np.argsort(u, kind="stable")[:count]] = True
        return out

    return allowed


# -- models ------------------------------------------------------------------------


class TreeEnsemble:
    """Fitted trees. Scores are base + rate * the sum (boosting) or the mean (forests) of leaf values."""

    def __init__(self, columns: Sequence[str], trees: list[Tree], groups: list[int], base: Sequence[float], rate: float, link: str, medians: dict[str, float]) -> None:
        self.columns, self.trees, self.groups, self.base, self.rate, self.link, self.medians = list(columns), trees, groups, [float(b) for b in base], rate, link, medians

    @property
    def width(self) -> int:
        return len(self.base)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self._some(x, 0, len(self.trees))

    def outputs(self, x: np.ndarray, lattice: Lattice | None = None) -> np.ndarray:
        s = lattice.of(x, self._some) if lattice else self.scores(x)
        if self.link == "softmax":
            s = np.exp(s - s.max(axis=1, keepdims=True))
            s /= s.sum(axis=1, keepdims=True)
        return s

    def _some(self, x: np.ndarray, first: int, last: int) -> np.ndarray:
        out = np.tile(np.array(self.base if not first else [0.0] * self.width), (len(x), 1))
        for tree, group in zip(self.trees[first:last], self.groups[first:last], strict=True):
            values = np.array(tree.value)[tree.leaves_of(x)] * self.rate
            if group < 0:
                out += values
            else:
                out[:, group] += values[:, 0]
        return out

    def _fill(self, table: np.ndarray, group: Group, t: int) -> None:
        if not t:
            table += np.array(self.base)
        values, output = np.array(self.trees[t].value) * self.rate, self.groups[t]
        for leaf, box in boxes(self.trees[t], "threshold", group):
            if output < 0:
                table[box] += values[leaf]
            else:
                table[(*box, output)] += values[leaf, 0]

    def transform(self, df: DataFrame, names: Sequence[str] | str = "prediction") -> DataFrame:
        """``df`` with a column per output; one narrow Arrow pass."""
        lattice = Lattice(self.trees, "threshold", self.width, self._fill) if self.trees else None
        names = [names] if isinstance(names, str) else list(names)
        kept = [f for f in df.schema.fields if f.name not in names]
        at = [df.columns.index(c) for c in self.columns]
        places, medians = [df.columns.index(f.name) for f in kept], [self.medians.get(c, np.nan) for c in self.columns]
        schema = StructType(kept + [StructField(n, DoubleType()) for n in names])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = self.outputs(matrix(b, at, medians), lattice)
                yield pa.RecordBatch.from_arrays([b.column(i) for i in places] + [pa.array(out[:, j]) for j in range(len(names))], names=[f.name for f in schema.fields])

        return df.mapInArrow(run, schema)

    def nodes(self) -> list[dict]:
        """One row per node."""
        return [
            {"tree": t, "output": g, "node": i, "feature": self.columns[tree.feature[i]] if tree.feature[i] >= 0 else None, "threshold": tree.threshold[i] if tree.feature[i] >= 0 else None,
             "left": tree.left[i], "right": tree.right[i], "value": [float(v) for v in tree.value[i]], "cover": tree.cover[i]}
            for t, (tree, g) in enumerate(zip(self.trees, self.groups, strict=True)) for i in range(len(tree.feature))
        ]

    def save(self, spark: SparkSession, path: str) -> None:
        """Written as one JSON text; its size is that of the trees."""
        told = {k: getattr(self, k) for k in ("columns", "groups", "base", "rate", "link", "medians")} | {"trees": [vars(t) for t in self.trees]}
        spark.createDataFrame([(json.dumps(told),)], "value string").write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TreeEnsemble:
        told = json.loads(spark.read.option("wholetext", True).text(path).first()[0])
        return cls(told["columns"], [Tree(**t) for t in told["trees"]], told["groups"], told["base"], told["rate"], told["link"], told["medians"])


def matrix(b: pa.RecordBatch, at: Sequence[int], medians: Sequence[float]) -> np.ndarray:
    x = np.empty((len(b), len(at)))
    for j, i in enumerate(at):
        x[:, j] = b.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False)
    holes = np.isnan(x)
    return np.where(holes, np.array(medians, dtype=float), x) if holes.any() else x


# -- forests -----------------------------------------------------------------------


def _scale(bound: float, rows: int) -> float:
    """Power of two by which values up to ``bound`` are multiplied so that ``rows`` of them fit a fixed-point sum."""
    return 2.0 ** (SCALE_BITS - int(np.ceil(np.log2(max(rows, 1) * 16.0))) - max(0, int(np.ceil(np.log2(max(bound, 1e-300))))))


def random_forest(
    df: DataFrame, columns: Sequence[str], label: str, key: str, classes: int = 0, trees: int = 200, max_depth: int = 5, min_leaf: float = 3,
    column_share: float | str | None = None, bins: int = BINS, bootstrap: bool = True, seed: int = 42,
) -> TreeEnsemble:
    """A forest of classes 0..``classes``-1, or of numbers if ``classes`` is 0.

    A row's weight in a tree is a Poisson(1) draw of (tree, key), the bootstrap of
    an unbounded table. Splits minimize the Gini impurity or the squared error. Nodes
    see the square root of the number of features (classes) or all (numbers).
    """
    cuts = bins_of(df, columns, bins)
    rows = binned_rows(df, cuts, label, key)
    tasks = rows.rdd.getNumPartitions()
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("y")).alias("most"), F.approx_count_distinct("codes").alias("cells")).first()
    n, features, width, wide = told["n"], len(columns), cuts.most, cuts.most > 256
    stats = classes or 2
    scale = _scale(told["most"] or 1.0, n)
    count = _columns_of(column_share if column_share is not None else ("sqrt" if classes else "all"), features)
    cells = cells_of(rows, cuts, told["cells"])
    out: list[Tree] = []
    together = max(1, LEVEL_NUMBERS // (stats * (len(cells.codes) if cells else features * width * 2 ** max(max_depth - 1, 0))))
    for first in range(0, trees, together):
        members = range(first, min(first + together, trees))
        grown = _Growing(cuts, len(members), min_leaf, partial(_shifted, _subset(features, count, seed), first))
        weigh = partial(_bootstrap, first=first) if bootstrap else _ones
        task = partial(_drawn_sums, features=features, width=width, wide=wide, classes=classes, scale=scale, seed=seed, weigh=weigh)
        if cells:
            whole = summed(rows, partial(task, cells=cells, trees=len(members)), len(members) * len(cells.codes) * stats, tasks).reshape(len(members), -1, stats)
        for depth in range(max_depth + 1):
            slots = sum(len(o) for o in grown.open)
            if not slots or (depth == max_depth and depth):
                break  # the last level got its values with the split above it
            if cells:
                sums = _cell_level(cells, grown, width, whole)
            else:
                sums = summed(rows, partial(task, finder=grown.finder(), slots=slots), slots * features * width * stats, tasks).reshape(slots, features, width, stats)
            if classes:
                grown.grow(sums, _gini_gain, lambda s: (s / max(s.sum(), 1)).tolist(), lambda s: s.sum(axis=-1), max_depth == 0)
            else:
                grown.grow(sums, partial(_squared_gain, scale=scale), lambda s: [float(s[1]) / scale / max(int(s[0]), 1)], lambda s: s[..., 0], max_depth == 0)
        out += grown.trees
    return TreeEnsemble(columns, out, [-1 if classes else 0] * len(out), [0.0] * max(classes, 1), 1.0 / max(len(out), 1), "none", cuts.medians)


def _bootstrap(draws: Draws, tree: int, first: int) -> np.ndarray:
    return draws.poisson(first + tree + 1).astype(float)


def _ones(draws: Draws, tree: int) -> np.ndarray:
    return np.ones(len(draws.first))


def _below(draws: Draws, tree: int, first: int, share: float) -> np.ndarray:
    return draws.below(first + tree + 1, share).astype(float)


def _cell_level(cells: Cells, grown: _Growing, width: int, stats: Sequence[np.ndarray]) -> np.ndarray:
    """(slot, feature, bin, stat) of all open nodes from the sums (cell, stat) of each tree."""
    out = []
    for slots, tree, nodes, own in zip(grown.slots(), grown.trees, grown.open, stats, strict=True):
        if nodes:
            slot = slots[tree.nodes_of(cells.codes)]
            out.append(_cell_histograms(cells, np.where(slot < 0, -1, slot - slots[nodes[0]]), len(nodes), width, own))
    return np.concatenate(out)


def _drawn_sums(
    batches: Iterator[pa.RecordBatch], features: int, width: int, wide: bool, classes: int, scale: float, seed: int, weigh: Callable[[Draws, int], np.ndarray],
    finder: Callable | None = None, slots: int = 0, cells: Cells | None = None, trees: int = 0, scores: int = 0, start: float = 0.0,
) -> np.ndarray:
    """Weighted sums of whole numbers: per (tree, cell, stat) of ``trees`` trees, or per (slot, feature, bin, stat) of the open nodes.

    The stats are the rows of each class, or the rows and their labels less ``start``.
    """
    each = classes + 1 if classes else 2  # labels that are no class come behind the classes
    total = np.zeros((trees, each, len(cells.codes)) if cells else (features, slots, width, each), np.int64)
    if cells and classes:
        total = np.zeros((trees, len(cells.codes) * each), np.int64)
    for b in _blocks(batches):
        codes, y, k, _ = _arrays(b, features, wide, scores)
        draws = Draws(k, seed)
        if classes:
            label = np.full(len(y), classes)
            for c in range(classes):
                label[y == c] = c
        else:
            parts = _halves(np.rint((y - start) * scale).astype(np.int64))
        if cells:
            at = cells.of(codes) if not classes else cells.of(codes) * each + label
            for t in range(trees):
                w = weigh(draws, t)
                if classes:
                    total[t] += np.bincount(at, w, total.shape[1]).astype(np.int64)
                else:
                    total[t, 0] += np.bincount(at, w, total.shape[2]).astype(np.int64)
                    _add_halves(total[t, 1], at, parts, w)
            continue
        columns = [codes[:, f].astype(np.intp) for f in range(features)]
        for t, low, count, slot in finder(codes):
            w = weigh(draws, t)
            at, size = slot * width, (count + 1) * width  # the last slot is that of rows in closed leaves
            for f in range(features):
                place, own = at + columns[f], total[f, low : low + count]
                if classes:
                    own += np.bincount(place * each + label, w, size * each).astype(np.int64).reshape(count + 1, width, each)[:count]
                else:
                    own[:, :, 0] += np.bincount(place, w, size).astype(np.int64).reshape(count + 1, width)[:count]
                    summed_up = np.zeros(size, np.int64)
                    _add_halves(summed_up, place, parts, w)
                    own[:, :, 1] += summed_up.reshape(count + 1, width)[:count]
    if cells:
        return total.reshape(trees, -1, each)[:, :, :classes] if classes else total.transpose(0, 2, 1)
    return (total[..., :classes] if classes else total).transpose(1, 0, 2, 3)


def _shifted(allowed: Callable[[int, int], np.ndarray], first: int, tree: int, node: int) -> np.ndarray:
    return allowed(first + tree, node)


def _gini_gain(left: np.ndarray, right: np.ndarray, total: np.ndarray) -> np.ndarray:
    def squares(s: np.ndarray) -> np.ndarray:
        n = s.sum(axis=-1)
        return (s.astype(float) ** 2).sum(axis=-1) / np.maximum(n, 1)

    return (squares(left) + squares(right) - squares(total)) / max(float(total.sum()), 1.0)


def _squared_gain(left: np.ndarray, right: np.ndarray, total: np.ndarray, scale: float = 1.0) -> np.ndarray:
    def squares(s: np.ndarray) -> np.ndarray:
        return (s[..., 1] / scale) ** 2 / np.maximum(s[..., 0], 1)

    return (squares(left) + squares(right) - squares(total)) / max(float(total[0]), 1.0)


# -- boosting ----------------------------------------------------------------------


def boosted_trees(
    df: DataFrame, columns: Sequence[str], label: str, key: str, classes: int = 0, rounds: int = 100, rate: float = 0.04, max_depth: int = 2,
    loss: str | None = None, newton: bool = False, ridge: float = 1.0, least_curvature: float = 1.0, min_leaf: float = 1, row_share: float = 1.0,
    column_share: float | str = "all", quantile: float = 0.9, bins: int = BINS, seed: int = 42, history: list[float] | None = None,
) -> TreeEnsemble:
    """Gradient boosting; all classes take their step of a round in the same passes.

    ``loss`` is ``multinomial`` (with ``classes``), ``squared`` or ``huber``. Plain
    boosting splits by the squared error of the residuals; ``newton`` (histogram
    boosting) by gradient and curvature with the penalty ``ridge`` and children of
    ``least_curvature`` at least. Leaf values are Newton steps. Huber's bound in a
    round is the ``quantile`` of the absolute residuals before the round above it (the
    first round: of the start). Rows and columns of a round are drawn by hash.
    ``history`` takes the mean loss before each round.
    """
    loss = loss or ("multinomial" if classes else "squared")
    cuts = bins_of(df, columns, bins)
    features, width, wide, outputs = len(columns), cuts.most, cuts.most > 256, max(classes, 1)
    told = df.where(F.col(label).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.percentile(label, 0.5).alias("median") if loss == "huber" else F.lit(0.0).alias("median"),
        F.min(label).alias("low"), F.max(label).alias("high"), *[F.count_if(F.col(label) == c).alias(f"k{c}") for c in range(classes)],
    ).first()
    n = told["n"]
    if classes:
        start = [float(np.log(max(told[f"k{c}"], 1e-9) / max(n, 1))) for c in range(classes)]
        reach = 1.0
    else:
        exact = _scale(max(abs(float(told["low"] or 0)), abs(float(told["high"] or 0)), 1e-12), n)  # a mean that no order of rows changes
        start = [float(told["median"] or 0.0) if loss == "huber" else (df.agg(F.sum(F.rint(F.col(label) * exact).cast("long"))).first()[0] or 0) / exact / max(n, 1)]
        reach = max(float((told["high"] or 0) - (told["low"] or 0)), 1e-12)
    scale = _scale(reach, n)
    rows = binned_rows(df, cuts, label, key, start)
    tasks = rows.rdd.getNumPartitions()
    bound, kept, groups = reach, [], []
    fresh = _Fresh([], outputs, rate, width)  # since the scores were written
    cells = cells_of(rows, cuts, rows.agg(F.approx_count_distinct("codes")).first()[0])
    if cells and (not classes or sum(told[f"k{c}"] for c in range(classes)) == n):
        by_cell = _CellRounds(rows, cells, loss, classes, start, scale, reach, rounds, row_share, seed, features, wide, tasks, history is not None)
    else:
        by_cell, rows = None, packed_rows(rows, features, wide, outputs)
        tasks = rows.rdd.getNumPartitions()
    if loss == "huber":
        bound = _quantile(summed(rows, partial(_residuals, features=features, wide=wide, reach=reach), RESIDUAL_BINS, tasks), quantile, reach)
    columns_of_round = _subset(features, _columns_of(column_share, features), seed)
    for r in range(rounds):
        allowed = columns_of_round(r, 0)
        grown = _Growing(cuts, outputs, min_leaf, lambda t, node: allowed)  # noqa: B023
        next_bound = bound
        if by_cell:
            stats, tail = by_cell.sums(r, bound)
        for depth in range(max_depth):
            slots = sum(len(o) for o in grown.open)
            if not slots:
                break
            size = slots * features * width * 3
            if by_cell:
                sums = np.concatenate([_cell_level(cells, grown, width, stats).reshape(-1), tail])
            else:
                task = partial(
                    _boost_level, finder=grown.finder(), slots=slots, fresh=fresh, features=features, width=width, wide=wide, outputs=outputs, loss=loss, scale=scale,
                    bound=bound, reach=reach, draw=r + 1, row_share=row_share, seed=seed, first=depth == 0,
                )
                sums = summed(rows, task, size + RESIDUAL_BINS + 1, tasks)
            if depth == 0:
                if history is not None:
                    history.append(float(sums[size + RESIDUAL_BINS]) / _scale(64.0 * reach**2, n) / max(n, 1))
                if loss == "huber":
                    next_bound = _quantile(sums[size : size + RESIDUAL_BINS], quantile, reach)
            own = sums[:size].reshape(slots, features, width, 3)
            if newton:
                grown.least = 1
                gain = partial(_newton_gain, scale=scale, ridge=ridge, least=least_curvature)
                value = partial(_newton_value, scale=scale, ridge=ridge, factor=1.0)
            else:
                gain = partial(_residual_gain, scale=scale)
                value = partial(_newton_value, scale=scale, ridge=0.0, factor=(classes - 1) / classes if classes else 1.0)
            grown.grow(own, gain, value, lambda s: s[..., 2], False)
        bound = next_bound
        kept += grown.trees
        groups += list(range(outputs))
        if by_cell:
            by_cell.add(grown.trees, rate)
            continue
        fresh = _Fresh([*fresh.trees, *((t, g) for g, t in enumerate(grown.trees))], outputs, rate, width)
        if (r + 1) % REFRESH == 0 and r + 1 < rounds:
            rows, fresh = _saved(rows.mapInArrow(partial(_with_scores, fresh=fresh, features=features, wide=wide, outputs=outputs), rows.schema)), _Fresh([], outputs, rate, width)
            tasks = rows.rdd.getNumPartitions()
    return TreeEnsemble(columns, kept, groups, start, rate, "softmax" if classes else "none", cuts.medians)


class _Fresh:
    """Trees and what they add to the scores of binned rows."""

    def __init__(self, trees: list[tuple[Tree, int]], outputs: int, rate: float, width: int) -> None:
        self.trees, self.outputs, self.rate = trees, outputs, rate
        self.lattice = Lattice([t for t, _ in trees], "cut", outputs, self._fill, width) if trees else None

    def _fill(self, table: np.ndarray, group: Group, t: int) -> None:
        tree, output = self.trees[t]
        for leaf, box in boxes(tree, "cut", group):
            table[(*box, output)] += self.rate * tree.value[leaf][0]

    def _walked(self, codes: np.ndarray, first: int, last: int) -> np.ndarray:
        out = np.zeros((len(codes), self.outputs))
        for tree, output in self.trees[first:last]:
            out[:, output] += self.rate * np.array(tree.value)[tree.nodes_of(codes), 0]
        return out

    def scores(self, codes: np.ndarray, scores: np.ndarray) -> np.ndarray:
        return scores + self.lattice.of(codes, self._walked) if self.lattice else scores


def _with_scores(batches: Iterator[pa.RecordBatch], fresh: _Fresh, features: int, wide: bool, outputs: int) -> Iterator[pa.RecordBatch]:
    for b in _blocks(batches):
        codes, _, _, scores = _arrays(b, features, wide, outputs)
        ends = np.cumsum([len(x.as_buffer()) for x in b.column(1)]) // 8
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), _packs(ends, fresh.scores(codes, scores))], names=["codes", "y", "k", "s"])


class _CellRounds:
    """Sums of gradient, curvature and rows per cell for each round of boosting.

    Rows of a cell have the same scores. Classes and squared residuals then follow
    from the rows, classes and labels of the cells that the rounds draw, which one pass
    counts for many rounds. Huber's loss, and the squared loss if it is told, depend on each
    label: one pass per round over (cell, label, key).
    """

    def __init__(
        self, rows: DataFrame, cells: Cells, loss: str, classes: int, start: list[float], scale: float, reach: float, rounds: int, row_share: float, seed: int,
        features: int, wide: bool, tasks: int, told: bool,
    ) -> None:
        self.rows, self.cells, self.loss, self.classes, self.start, self.scale, self.reach = rows, cells, loss, classes, start, scale, reach
        self.rounds, self.row_share, self.seed, self.tasks, self.told = rounds, row_share, seed, tasks, told
        self.features, self.wide = features, wide
        self.scores = np.tile(np.array(start, dtype=float), (len(cells.codes), 1))
        self.drawn, self.first = None, 0  # counted sums from round ``first`` on
        self.counted = bool(classes) or (loss == "squared" and not told)
        if not self.counted:
            self.rows = _saved(rows.mapInArrow(self._placed, "cell binary, y binary, k binary"))
            self.tasks = self.rows.rdd.getNumPartitions()
        self.all = self._count(_ones, 1)[0] if classes and told and row_share < 1 else None

    def _placed(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                codes, y, k, _ = _arrays(b, self.features, self.wide, len(self.start))
                ends = _pack_ends(len(b))
                drawn = k if self.row_share < 1 else k[:0]
                yield pa.RecordBatch.from_arrays([
                    _packs(ends, self.cells.of(codes).astype("<i4")), _packs(ends, y.astype("<f8")), _packs(ends if len(drawn) else ends * 0, drawn),
                ], names=["cell", "y", "k"])

    def __getstate__(self) -> dict:
        return vars(self) | {"rows": None, "drawn": None, "all": None, "scores": None}

    def _count(self, weigh: Callable, rounds: int) -> np.ndarray:
        stats = self.classes or 2
        task = partial(
            _drawn_sums, features=self.features, width=0, wide=self.wide, classes=self.classes, scale=self.scale, seed=self.seed + 3, weigh=weigh, cells=self.cells,
            trees=rounds, scores=len(self.start), start=self.start[0],
        )
        return summed(self.rows, task, rounds * len(self.cells.codes) * stats, self.tasks).reshape(rounds, -1, stats)

    def _of_round(self, r: int) -> np.ndarray:
        """(cell, stat) of the rows that round ``r`` draws."""
        if self.drawn is None or (self.row_share < 1 and r >= self.first + len(self.drawn)):
            if self.row_share < 1:
                some = min(self.rounds - r, max(1, LEVEL_NUMBERS // (len(self.cells.codes) * (self.classes or 2))))
                self.drawn, self.first = self._count(partial(_below, first=r, share=self.row_share), some), r
            else:
                self.drawn = self._count(_ones, 1)
        return self.drawn[r - self.first if self.row_share < 1 else 0]

    def sums(self, r: int, bound: float) -> tuple[list[np.ndarray], np.ndarray]:
        """Per output the sums (cell, stat); the counts of residuals by size and the loss behind them."""
        whole = lambda x: np.rint(x).astype(np.int64)
        tail = np.zeros(RESIDUAL_BINS + 1, np.int64)
        if not self.counted:
            cells = len(self.cells.codes)
            task = partial(
                _cell_residuals, scores=self.scores[:, 0], loss=self.loss, bound=bound, scale=self.scale, reach=self.reach, draw=r, row_share=self.row_share, seed=self.seed, told=self.told,
            )
            out = summed(self.rows, task, 2 * cells + len(tail), self.tasks)
            g, n = out[:cells], out[cells : 2 * cells]
            return [np.stack([g, n * int(whole(self.scale)), n], axis=1)], out[2 * cells :]
        own = self._of_round(r)
        if not self.classes:
            n, y = own.T
            g = y - n * whole((self.scores[:, 0] - self.start[0]) * self.scale)
            return [np.stack([g, n * int(whole(self.scale)), n], axis=1)], tail
        p = np.exp(self.scores - self.scores.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        n = own.sum(axis=1)
        stats = [
            np.stack([own[:, t] * whole((1.0 - p[:, t]) * self.scale) + (n - own[:, t]) * whole((0.0 - p[:, t]) * self.scale), n * whole(p[:, t] * (1 - p[:, t]) * self.scale), n], axis=1)
            for t in range(self.classes)
        ]
        if self.told:
            lost = -np.log(np.maximum(p, 1e-15))
            tail[-1] = ((own if self.all is None else self.all) * whole(lost * _loss_scale(self.scale, self.reach))).sum()
        return stats, tail

    def add(self, trees: list[Tree], rate: float) -> None:
        for t, tree in enumerate(trees):
            self.scores[:, t] += rate * np.array(tree.value)[tree.nodes_of(self.cells.codes), 0]


def _cell_residuals(
    batches: Iterator[pa.RecordBatch], scores: np.ndarray, loss: str, bound: float, scale: float, reach: float, draw: int, row_share: float, seed: int, told: bool,
) -> np.ndarray:
    """Sums of residuals, cut at ``bound`` for Huber's loss, and rows per cell, then counts of residuals by size and the loss."""
    total, counts, spent = np.zeros((2, len(scores)), np.int64), np.zeros(RESIDUAL_BINS, np.int64), 0
    for b in _blocks(batches):
        cell, y = _flat(b.column(0), "<i4").astype(np.intp), _flat(b.column(1), "<f8")
        residual = y - scores[cell]
        w = _below(Draws(_flat(b.column(2), "<i8"), seed + 3), draw, 0, row_share) if row_share < 1 else None
        g = np.clip(residual, -bound, bound) if loss == "huber" else residual
        _add_halves(total[0], cell, _halves(np.rint(g * scale).astype(np.int64)), w)
        total[1] += np.bincount(cell, w, len(scores)).astype(np.int64)
        if loss == "huber":
            counts += _residual_counts(np.abs(residual), reach)
        if told:
            small = np.abs(residual) <= bound if loss == "huber" else np.ones(len(y), bool)
            lost = np.where(small, residual**2 / 2, bound * (np.abs(residual) - bound / 2))
            spent += int(np.rint(lost * _loss_scale(scale, reach)).astype(np.int64).sum())
    return np.concatenate([total.reshape(-1), counts, [spent]])


def _residuals(batches: Iterator[pa.RecordBatch], features: int, wide: bool, reach: float) -> np.ndarray:
    total = np.zeros(RESIDUAL_BINS, np.int64)
    for b in batches:
        if len(b):
            _, y, _, scores = _arrays(b, features, wide, 1)
            total += _residual_counts(np.abs(y - scores[:, 0]), reach)
    return total


def _residual_counts(size: np.ndarray, reach: float) -> np.ndarray:
    return np.bincount(np.minimum((size / reach * RESIDUAL_BINS).astype(np.int64), RESIDUAL_BINS - 1), minlength=RESIDUAL_BINS)


def _quantile(counts: np.ndarray, share: float, reach: float) -> float:
    """Upper end of the range that holds the quantile."""
    so_far = np.cumsum(counts)
    return float((np.searchsorted(so_far, share * so_far[-1]) + 1) / RESIDUAL_BINS * reach) if len(so_far) and so_far[-1] else reach


def _boost_level(
    batches: Iterator[pa.RecordBatch], finder: Callable, slots: int, fresh: _Fresh, features: int, width: int, wide: bool, outputs: int, loss: str, scale: float,
    bound: float, reach: float, draw: int, row_share: float, seed: int, first: bool,
) -> np.ndarray:
    """Sums of (gradient, curvature, count) per (slot, feature, bin), the residual counts and the loss."""
    total = np.zeros((features, slots, width, 3), np.int64)
    counts, spent = np.zeros(RESIDUAL_BINS, np.int64), 0
    for b in _blocks(batches):
        codes, y, k, scores = _arrays(b, features, wide, outputs)
        scores = fresh.scores(codes, scores)
        if loss == "multinomial":
            p = np.exp(scores - scores.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            actual = (y[:, None] == np.arange(outputs)).astype(float)
            g, h = actual - p, p * (1 - p)
            lost = -np.log(np.maximum(p[np.arange(len(y)), y.astype(np.int64)], 1e-15)) if first else None
        else:
            residual = y - scores[:, 0]
            small = np.abs(residual) <= bound if loss == "huber" else np.ones(len(y), bool)
            g, h = np.clip(residual, -bound, bound)[:, None] if loss == "huber" else residual[:, None], None
            lost = np.where(small, residual**2 / 2, bound * (np.abs(residual) - bound / 2))
            if first and loss == "huber":
                counts += _residual_counts(np.abs(residual), reach)
        if first:
            spent += int(np.rint(lost * _loss_scale(scale, reach)).astype(np.int64).sum())
        w = _below(Draws(k, seed + 3), draw - 1, 0, row_share) if row_share < 1 else None
        columns = [codes[:, f].astype(np.intp) for f in range(features)]
        for t, low, count, slot in finder(codes):
            start, size = slot * width, (count + 1) * width  # the last slot is that of rows in closed leaves
            parts = [_halves(np.rint(x[:, t] * scale).astype(np.int64)) if x is not None else None for x in (g, h)]
            for f in range(features):
                place, own = start + columns[f], np.zeros((3, size), np.int64)
                own[2] = np.bincount(place, w, size).astype(np.int64)
                _add_halves(own[0], place, parts[0], w)
                if h is None:
                    own[1] = own[2] * int(np.rint(scale))
                else:
                    _add_halves(own[1], place, parts[1], w)
                total[f, low : low + count] += own.reshape(3, count + 1, width)[:, :count].transpose(1, 2, 0)
    return np.concatenate([total.transpose(1, 0, 2, 3).reshape(-1), counts, [spent]])


def _loss_scale(scale: float, reach: float) -> float:
    """``_scale`` for losses up to 64 * reach^2, from that of the gradients."""
    return scale * 2.0 ** (max(0, int(np.ceil(np.log2(max(reach, 1e-300))))) - max(0, int(np.ceil(np.log2(64.0 * reach**2)))))


def _residual_gain(left: np.ndarray, right: np.ndarray, total: np.ndarray, scale: float) -> np.ndarray:
    def squares(s: np.ndarray) -> np.ndarray:
        return (s[..., 0] / scale) ** 2 / np.maximum(s[..., 2], 1)

    return squares(left) + squares(right) - squares(total)


def _newton_gain(left: np.ndarray, right: np.ndarray, total: np.ndarray, scale: float, ridge: float, least: float) -> np.ndarray:
    def part(s: np.ndarray) -> np.ndarray:
        return (s[..., 0] / scale) ** 2 / (s[..., 1] / scale + ridge)

    enough = (left[..., 1] / scale >= least) & (right[..., 1] / scale >= least)
    return np.where(enough, part(left) + part(right) - part(total), -np.inf)


def _newton_value(s: np.ndarray, scale: float, ridge: float, factor: float) -> list[float]:
    curvature = float(s[1]) / scale + ridge
    return [factor * float(s[0]) / scale / curvature if curvature > 1e-12 else 0.0]
