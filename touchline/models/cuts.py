"""Exact best cuts of many candidates from small histograms and bounds.

One pass sums, per (candidate, feature, bin), the rows, weights, residuals and
squared residuals, with the smallest and largest value. That settles all cuts
between bins. A cut inside a bin can at most turn the bin's whole sum of squares
into gain: with L and R the residual sums left and right of the bin, l and r
their weights and Q the squares inside, no cut there gains more than
``L^2/l + R^2/r + Q - T^2/t``. Only bins whose bound reaches the best gain so far
are looked into, by cutting their value range again, until no bound does: many bins
at once into few sub-bins each, few bins into many. Rows are never shuffled; what
leaves a task depends on candidates, features and bins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK = 1 << 15  # numbers that travel together
DIRECT_BYTES = 1 << 25  # of all tasks' arrays up to which the driver adds them itself
SUB_BINS = 256  # of a bin that is looked into, if there are few; at least LEAST_SUB_BINS
LEAST_SUB_BINS = 8
PLACES = 1 << 19  # sub-bins of all bins that are looked into in one pass
PURE = 1e-14  # a candidate with less variance than this cannot be split


@dataclass
class Nodes:
    """All trees as arrays; feature -1 is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray  # (node, output)
    roots: list[int]

    def leaf(self, root: int, x: np.ndarray) -> np.ndarray:
        at, rows = np.full(len(x), root), np.arange(len(x))
        while len(rows):
            f = self.feature[at[rows]]
            rows, f = rows[f >= 0], f[f >= 0]
            here = at[rows]
            at[rows] = np.where(x[rows, f] <= self.cut[here], self.left[here], self.right[here])
        return at


@dataclass
class Cut:
    gain: float
    feature: int
    value: float  # largest that goes left
    next_value: float
    left: np.ndarray  # rows, weight, squares, residuals
    total: np.ndarray


@dataclass
class Cells:
    """Value ranges of a candidate's feature from low to high, with the sums before them and the bound of their cuts."""

    slot: np.ndarray
    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    before: np.ndarray  # (cell, stat)
    bound: np.ndarray

    def __len__(self) -> int:
        return len(self.slot)

    def __getitem__(self, at) -> Cells:  # noqa: ANN001
        return Cells(*(x[at] for x in vars(self).values()))

    def joined(self, other: Cells) -> Cells:
        return Cells(*(np.concatenate(x) for x in zip(vars(self).values(), vars(other).values(), strict=True)))


def _gains(left: np.ndarray, total: np.ndarray, least: int) -> np.ndarray:
    """Mean gain over outputs of cuts with these sums to the left of ``total``, row by row; -inf where a side is too small."""
    right = total - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = ((left[:, 3:] ** 2).sum(axis=1) / left[:, 1] + (right[:, 3:] ** 2).sum(axis=1) / right[:, 1] - (total[:, 3:] ** 2).sum(axis=1) / total[:, 1]) / (total.shape[1] - 3)
    ok = (left[:, 0] >= least) & (right[:, 0] >= least) & (left[:, 1] > 0) & (right[:, 1] > 0)
    return np.where(ok, np.maximum(gain, 0.0), -np.inf)


def _bounds(before: np.ndarray, own: np.ndarray, total: np.ndarray) -> np.ndarray:
    after = total - before - own

    def part(s: np.ndarray) -> np.ndarray:
        squares = (s[:, 3:] ** 2).sum(axis=1)
        return np.divide(squares, s[:, 1], out=np.zeros(len(s)), where=s[:, 1] > 1e-12 * total[:, 1])

    return (part(before) + part(after) + np.maximum(own[:, 2], 0.0) - (total[:, 3:] ** 2).sum(axis=1) / total[:, 1]) / (total.shape[1] - 3)


class CutSearch:
    """Searches over rows (bins array<int>, vals array<double>, n, w, y0.., q) with weighted targets y and squares q."""

    def __init__(self, rows: DataFrame, features: int, outputs: int, bins: int, least: int) -> None:
        self.rows, self.d, self.k, self.bins, self.least = rows, features, outputs, bins, least
        self.stats = 3 + outputs
        self.tasks = rows.rdd.getNumPartitions()

    def best(self, nodes: Nodes, candidates: Sequence[int], allowed: dict[int, list[int]] | None = None) -> dict[int, Cut]:
        """The best cut of each candidate: a leaf of a tree, or -1 for a new root."""
        slots = {c: i for i, c in enumerate(candidates)}
        sums, low, high = self._pass(nodes, slots, None, (len(slots), self.d, self.bins))
        totals = sums[:, 0].sum(axis=1)
        found: dict[int, Cut] = {}
        wanted = [
            (i, f) for c, i in slots.items() if totals[i][1] > 0 and (totals[i][2] - (totals[i][3:] ** 2).sum() / totals[i][1]) / totals[i][1] > PURE
            for f in (range(self.d) if allowed is None else allowed[c])
        ]
        at, feature = (np.array([x[j] for x in wanted], dtype=int) for j in (0, 1))
        nothing = np.zeros(len(wanted))
        whole = Cells(at, feature, nothing, nothing, np.zeros((len(wanted), self.stats)), nothing)
        cells = self._cuts(found, whole, sums[at, feature], low[at, feature], high[at, feature], totals)
        while True:
            cells = cells[cells.bound >= self._reached(found, len(slots))[cells.slot] * (1 - 1e-12)]
            if not len(cells):
                break
            cells = cells[np.argsort(-cells.bound, kind="stable")]
            parts = min(SUB_BINS, max(LEAST_SUB_BINS, PLACES // len(cells)))
            now, cells = cells[: PLACES // parts], cells[PLACES // parts :]
            sums, low, high = self._pass(nodes, slots, now, (len(now), 1, parts))
            cells = cells.joined(self._cuts(found, now, sums[:, 0], low[:, 0], high[:, 0], totals))
        return {c: found[i] for c, i in slots.items() if i in found}

    @staticmethod
    def _reached(found: dict[int, Cut], slots: int) -> np.ndarray:
        return np.array([found[i].gain if i in found else 0.0 for i in range(slots)])

    def _cuts(self, found: dict[int, Cut], cells: Cells, sums: np.ndarray, low: np.ndarray, high: np.ndarray, totals: np.ndarray) -> Cells:
        """Take the best cuts between the bins (cell, bin) that hold rows; the bins with several values that may hide a better one are cells again."""
        j, bin_of = np.nonzero(sums[:, :, 0] > 0)
        upto = (cells.before[:, None, :] + np.cumsum(sums, axis=1))[j, bin_of]
        own, low, high, slot, feature = sums[j, bin_of], low[j, bin_of], high[j, bin_of], cells.slot[j], cells.feature[j]
        between = np.flatnonzero(j[1:] == j[:-1])
        gains = _gains(upto[between], totals[slot[between]], self.least)
        order = np.lexsort((high[between], feature[between], -gains, slot[between]))  # the first feature and the smallest value on ties
        for x in order[np.flatnonzero(np.diff(slot[between][order], prepend=-1))]:
            b = between[x]
            cut = Cut(float(gains[x]), int(feature[b]), float(high[b]), float(low[b + 1]), upto[b], totals[slot[b]])
            old = found.get(int(slot[b]))
            if np.isfinite(cut.gain) and (old is None or (cut.gain, -cut.feature, -cut.value) > (old.gain, -old.feature, -old.value)):
                found[int(slot[b])] = cut
        starts, several = upto - own, low < high
        out = Cells(slot, feature, low, high, starts, np.where(several, 0.0, -np.inf))[several]
        out.bound = _bounds(starts[several], own[several], totals[slot[several]])
        return out[out.bound >= self._reached(found, len(totals))[out.slot] * (1 - 1e-12)]

    # -- passes over the rows ------------------------------------------------------

    def _pass(self, nodes: Nodes, slots: dict[int, int], cells: Cells | None, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        places = None
        if cells is not None:  # per (candidate, feature): lows, highs and numbers of the ranges, from low to high
            order = np.lexsort((cells.low, cells.feature, cells.slot))
            pair = cells.slot[order] * self.d + cells.feature[order]
            runs = np.split(order, np.flatnonzero(np.diff(pair)) + 1)
            places = {(int(cells.slot[x[0]]), int(cells.feature[x[0]])): (cells.low[x], cells.high[x], x) for x in runs}
        size = int(np.prod(shape))
        d, k, stats = self.d, self.k, self.stats

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, low, high = np.zeros((*shape, stats)), np.full(shape, np.inf), np.full(shape, -np.inf)
            for b in batches:
                if len(b):
                    _add_batch(b, d, k, nodes, slots, places, sums, low, high)
            for kind, data in enumerate((sums, low, high)):
                flat = data.reshape(-1)
                for c, at in enumerate(range(0, len(flat), CHUNK)):
                    yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([c], pa.int32()), pa.array([flat[at : at + CHUNK].tobytes()], pa.binary())], names=["kind", "chunk", "data"])

        def merge(table: pa.Table) -> pa.Table:
            kind = table.column("kind")[0].as_py()
            parts = sorted(x.as_py() for x in table.column("data"))  # one order of adding, whatever arrived first
            total = _merged(kind, [np.frombuffer(x) for x in parts])
            return pa.table({"kind": pa.array([kind], pa.int32()), "chunk": table.column("chunk").slice(0, 1), "data": pa.array([total.tobytes()], pa.binary())})

        parts = self.rows.mapInArrow(run, "kind int, chunk int, data binary")
        if self.tasks * size * (stats + 2) * 8 > DIRECT_BYTES:
            parts = parts.groupBy("kind", "chunk").applyInArrow(merge, "kind int, chunk int, data binary")
        found: dict[tuple[int, int], list[bytes]] = {}
        for r in parts.collect():
            found.setdefault((r["kind"], r["chunk"]), []).append(bytes(r["data"]))
        out = [np.zeros(size * stats), np.full(size, np.inf), np.full(size, -np.inf)]
        for (kind, chunk), data in found.items():
            total = _merged(kind, [np.frombuffer(x) for x in sorted(data)])
            out[kind][chunk * CHUNK : chunk * CHUNK + len(total)] = total
        return out[0].reshape(*shape, stats), out[1].reshape(shape), out[2].reshape(shape)


def _merged(kind: int, arrays: list[np.ndarray]) -> np.ndarray:
    total = arrays[0].copy()
    for x in arrays[1:]:
        total = total + x if kind == 0 else (np.minimum if kind == 1 else np.maximum)(total, x)
    return total


def _add_batch(b: pa.RecordBatch, d: int, k: int, nodes: Nodes, slots: dict[int, int], ranges: dict | None, sums: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
    at = {name: i for i, name in enumerate(b.schema.names)}
    number = lambda name: b.column(at[name]).to_numpy(zero_copy_only=False).astype(float)
    x = b.column(at["vals"]).flatten().to_numpy(zero_copy_only=False).reshape(len(b), d)
    bins = b.column(at["bins"]).flatten().to_numpy(zero_copy_only=False).reshape(len(b), d) if ranges is None else None
    n, w, q = number("n"), number("w"), number("q")
    y = np.stack([number(f"y{c}") for c in range(k)], axis=1)
    slot_of = np.full(len(nodes.feature) + 1, -1)
    for c, i in slots.items():
        slot_of[c] = i  # -1 is the last place
    leaves = [nodes.leaf(r, x) for r in nodes.roots]
    values = [nodes.value[leaf] for leaf in leaves]
    whole = sum(values, np.zeros((len(b), k)))
    members = [(slot_of[leaf], whole - value) for leaf, value in zip(leaves, values, strict=True)]
    if slot_of[-1] >= 0:
        members.append((np.full(len(b), slot_of[-1]), whole))
    by_slot: dict[int, list] = {}
    for (s, i), wanted in (ranges or {}).items():
        by_slot.setdefault(s, []).append((i, *wanted))
    for slot, other in members:
        use = np.flatnonzero(slot >= 0)
        if not len(use):
            continue
        f, own = other[use], slot[use]
        rest = y[use] - f * w[use, None]
        squares = q[use] - 2.0 * (f * y[use]).sum(axis=1) + (f * f).sum(axis=1) * w[use]
        stats = [n[use], w[use], squares, *rest.T]
        if ranges is None:
            every = np.arange(sums.shape[0])
            for i in range(d):
                _put(sums[:, i], low[:, i], high[:, i], every, own, bins[use, i], stats, x[use, i])
            continue
        for s in np.unique(own):
            mine = np.flatnonzero(own == s)
            some = [z[mine] for z in stats]
            for i, lows, highs, js in by_slot.get(int(s), ()):
                v = x[use[mine], i]
                cell = np.maximum(np.searchsorted(lows, v, "right") - 1, 0)
                inside = np.flatnonzero((v >= lows[cell]) & (v <= highs[cell]))
                if not len(inside):
                    continue
                v, cell, parts = v[inside], cell[inside], sums.shape[2]
                sub = np.minimum(((v - lows[cell]) / (highs[cell] - lows[cell]) * parts).astype(np.int64), parts - 1)
                _put(sums[:, 0], low[:, 0], high[:, 0], js, cell, sub, [z[inside] for z in some], v)


def _put(sums: np.ndarray, low: np.ndarray, high: np.ndarray, rows: np.ndarray, cell: np.ndarray, sub: np.ndarray, stats: list[np.ndarray], v: np.ndarray) -> None:
    """Add to the tables (row, bin, stat) at ``rows[cell]`` and bin ``sub``; ``rows`` are different."""
    shape = len(rows), sums.shape[1]
    place = cell * shape[1] + sub
    for j, s in enumerate(stats):
        sums[rows, :, j] += np.bincount(place, s, shape[0] * shape[1]).reshape(shape)
    least, most = np.full(shape, np.inf), np.full(shape, -np.inf)
    np.minimum.at(least.reshape(-1), place, v)
    np.maximum.at(most.reshape(-1), place, v)
    low[rows], high[rows] = np.minimum(low[rows], least), np.maximum(high[rows], most)
