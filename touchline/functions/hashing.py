"""Deterministic uniforms from integer arithmetic.

Results depend only on the draw number and the row key, never on partitioning,
and the same formula runs in any SQL engine.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

PRIME = 2147483647


def uniform_hash(draw: Column, key: Column, seed: int = 42) -> Column:
    """Value in [0, 1) for a (draw, key) pair; two squared rounds mix both."""
    d = F.pmod(draw.cast("long"), F.lit(PRIME))
    k = F.pmod(key.cast("long"), F.lit(PRIME))
    x = (d * 1000003 + k * 7919 + seed) % PRIME
    x = ((x * x) % PRIME + d * 104729) % PRIME
    x = ((x * x) % PRIME + k * 15485863) % PRIME
    return ((x * x) % PRIME) / F.lit(float(PRIME))


# Cumulative Poisson(1) probabilities for counts 0, 1, 2, ...
POISSON_CDF = (
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
    0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253,
    0.999998874797402, 0.9999998885745217,
)


def poisson_one(u: Column) -> Column:
    """Poisson(1) count by inverting the distribution function."""
    out = F.when(u < POISSON_CDF[0], 0)
    for n, edge in enumerate(POISSON_CDF[1:], start=1):
        out = out.when(u < edge, n)
    return out.otherwise(len(POISSON_CDF))


def uniforms(draw, key: np.ndarray, seed: int = 42) -> np.ndarray:
    """``uniform_hash`` for arrays of draws and of keys that are already reduced modulo PRIME."""
    d = np.asarray(draw, np.int64) % PRIME
    x = (d * 1000003 + key * 7919 + seed) % PRIME
    x = ((x * x) % PRIME + d * 104729) % PRIME
    x = ((x * x) % PRIME + key * 15485863) % PRIME
    return ((x * x) % PRIME) / float(PRIME)


def poisson_ones(u: np.ndarray) -> np.ndarray:
    """``poisson_one`` for arrays."""
    return np.searchsorted(np.array(POISSON_CDF), u, side="right")


def whole_edge(share: float) -> int:
    """The smallest whole number whose uniform, itself divided by PRIME, is not below ``share``."""
    x = max(int(share * PRIME) - 2, 0)
    while x / float(PRIME) < share:
        x += 1
    return x


_POISSON_EDGES = tuple(whole_edge(c) for c in POISSON_CDF)


def _fold(x: np.ndarray) -> None:
    """A smaller number that is equal modulo PRIME, in place: 2^31 counts as 1."""
    high = x >> 31
    x &= PRIME
    x += high


class Draws:
    """``uniforms`` of one array of keys for many draws, without divisions."""

    def __init__(self, key: np.ndarray, seed: int = 42) -> None:
        self.first, self.last = key * 7919 + seed, key * 15485863
        for x in (self.first, self.last):
            _fold(x)
            _fold(x)

    def whole(self, draw: int) -> np.ndarray:
        """The uniforms times PRIME, as whole numbers below it."""
        d = draw % PRIME
        x = self.first + d * 1000003 % PRIME
        _fold(x)
        for add in (d * 104729 % PRIME, self.last):
            x *= x
            _fold(x)
            _fold(x)
            x += add
            _fold(x)
        x *= x
        _fold(x)
        _fold(x)
        x[x >= PRIME] -= PRIME
        return x.astype(np.int32)

    def poisson(self, draw: int) -> np.ndarray:
        """``poisson_ones`` of the uniforms, as bytes."""
        x = self.whole(draw)
        out = (x >= _POISSON_EDGES[0]).view(np.int8)
        for edge in _POISSON_EDGES[1:]:
            out += (x >= edge).view(np.int8)
        return out

    def below(self, draw: int, share: float) -> np.ndarray:
        """Which uniforms are smaller than ``share``."""
        return self.whole(draw) < whole_edge(share)
