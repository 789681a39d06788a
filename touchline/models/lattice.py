"""Trees as tables over the intervals between their cuts.

A tree of few features is constant in every combination of intervals between its
own cuts. Neighboring trees share a table as long as it stays small; a row then
costs one lookup per table instead of a walk per tree. Sizes follow from the trees
alone, not from rows. Trees that split on too many features keep being walked.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np

SHARED = 1 << 15  # numbers of a table that several trees share
OWN = 1 << 16  # numbers of a table of one tree


@dataclass
class Group:
    first: int
    last: int
    features: list[int]
    cuts: list[np.ndarray]
    places: list[np.ndarray]  # per feature: code -> part of the table's row
    table: np.ndarray | None  # (row, entries); None if it would be too large

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(len(c) + 1 for c in self.cuts)


def _cuts(tree, bound: str) -> dict[int, np.ndarray]:  # noqa: ANN001
    own: dict[int, list[float]] = {}
    for f, b in zip(tree.feature, getattr(tree, bound), strict=True):
        if f >= 0:
            own.setdefault(f, []).append(b)
    return {f: np.unique(np.array(b)) for f, b in own.items()}


def _size(cuts: dict[int, np.ndarray]) -> int:
    out = 1
    for c in cuts.values():
        out *= len(c) + 1
    return out


class Lattice:
    """Tables of neighboring trees; ``entries`` numbers per combination of intervals.

    ``bound`` names the trees' cuts: ``threshold`` for values, ``cut`` for bin numbers
    below ``width``. ``fill(table, group, tree number)`` adds a tree to a table that has one
    axis per feature of the group and one for the entries.
    """

    def __init__(self, trees: Sequence, bound: str, entries: int, fill: Callable, width: int = 0, shared: int = SHARED, own: int = OWN, kind=float) -> None:  # noqa: ANN001
        each = [_cuts(t, bound) for t in trees]
        self.edges: dict[int, np.ndarray] = {}
        if not width:
            for c in each:
                for f, x in c.items():
                    self.edges[f] = np.union1d(self.edges[f], x) if f in self.edges else x
        self.width, self.groups, self.entries = width, [], entries
        at = 0
        while at < len(trees):
            cuts, end = each[at], at + 1
            while end < len(trees):
                both = dict(cuts)
                for f, x in each[end].items():
                    both[f] = np.union1d(both[f], x) if f in both else x
                if _size(both) * entries > shared:
                    break
                cuts, end = both, end + 1
            fits = _size(cuts) * entries <= (own if end == at + 1 else shared)
            self.groups.append(self._group(at, end, cuts, fill, kind) if fits else Group(at, end, [], [], [], None))
            at = end

    def _group(self, first: int, last: int, cuts: dict[int, np.ndarray], fill: Callable, kind) -> Group:  # noqa: ANN001
        features = sorted(cuts)
        own, places, step = [cuts[f] for f in features], [], 1
        for f, c in zip(reversed(features), reversed(own), strict=True):
            at = np.searchsorted(c, np.arange(self.width), "left") if self.width else np.concatenate([[0], np.searchsorted(c, self.edges[f], "right")])
            places.append((at * step).astype(np.int64))
            step *= len(c) + 1
        group = Group(first, last, features, own, places[::-1], None)
        table = np.zeros((*group.shape, self.entries), kind)
        for t in range(first, last):
            fill(table, group, t)
        group.table = table.reshape(-1, self.entries)
        return group

    def codes(self, x: np.ndarray) -> dict[int, np.ndarray]:
        """Per feature that the tables use: the interval of each row; missing values lie right of all cuts."""
        used = {f for g in self.groups if g.table is not None for f in g.features}
        return {f: np.searchsorted(self.edges[f], x[:, f], "left") if not self.width else x[:, f].astype(np.intp) for f in used}

    @staticmethod
    def rows(group: Group, codes: dict[int, np.ndarray], n: int) -> np.ndarray:
        """Row of the group's table for each of ``n`` rows."""
        at = None
        for f, place in zip(group.features, group.places, strict=True):
            at = place[codes[f]] if at is None else at + place[codes[f]]
        return np.zeros(n, np.int64) if at is None else at

    def of(self, x: np.ndarray, walked: Callable[[np.ndarray, int, int], np.ndarray]) -> np.ndarray:
        """The sum over all tables, and over ``walked(x, first, last)`` of the trees without one."""
        codes, out = self.codes(x), None
        for g in self.groups:
            part = walked(x, g.first, g.last) if g.table is None else g.table[self.rows(g, codes, len(x))]
            out = part if out is None else out + part
        return out


def boxes(tree, bound: str, group: Group):  # noqa: ANN001, ANN201
    """(leaf, slices of the group's axes that it covers)."""
    axis = {f: i for i, f in enumerate(group.features)}
    bounds = getattr(tree, bound)
    stack = [(0, tuple((0, n) for n in group.shape))]
    while stack:
        node, box = stack.pop()
        f = tree.feature[node]
        if f < 0:
            yield node, tuple(slice(*b) for b in box)
            continue
        i = axis[f]
        cut = int(np.searchsorted(group.cuts[i], bounds[node], "left")) + 1
        low, high = box[i]
        for child, part in ((tree.left[node], (low, min(high, cut))), (tree.right[node], (max(low, cut), high))):
            if part[0] < part[1]:
                stack.append((child, (*box[:i], part, *box[i + 1 :])))
