"""DartMinHash signatures of weighted sets.

A set's element with weight w owns the strip [0, w) of a weight axis. Hashes throw darts at the strips, one a unit of
area on average: each has a rank, a coordinate and a value. A dart beyond the weight misses. For each coordinate the dart
with the lowest rank counts, and two sets agree there with the probability of their weighted Jaccard similarity. Only
ranks below a bound are thrown, which gives about as many darts whatever the set's weight; it grows until no coordinate
is empty, which changes none that has a dart.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
ODD1, ODD2, ODD3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
#: Cumulative Poisson distribution of mean 1: the darts in one unit of area.
CELL = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 16)]))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit permutation that scatters its argument."""
    x = x + ODD1
    x = (x ^ (x >> U64(30))) * ODD2
    x = (x ^ (x >> U64(27))) * ODD3
    return x ^ (x >> U64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """0 to 1 from the upper bits."""
    return (x >> U64(11)).astype(np.float64) * 2.0**-53


def strips(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each element's strip cut at whole weights: a key for each piece, and the part of it that the element owns."""
    pieces = np.ceil(weights).astype(np.int64)
    if (pieces == 1).all():
        return mixed(keys), weights.astype(float)
    owner = np.repeat(np.arange(len(keys)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return mixed(keys[owner] + mixed(nth.astype(U64)) * U64(2) * (nth > 0)), np.minimum(weights[owner] - nth, 1.0)


def signature(keys: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """`size` 64-bit values of a set with at least one element. keys: distinct uint64; weights: above 0."""
    key, own = strips(keys, weights)
    total = float(own.sum())
    bound, done = size * (np.log(size) + 1.5) / total, 0
    best, value = np.full(size, np.inf), np.zeros(size, U64)
    while True:
        rows = np.arange(done, max(done + 1, int(np.ceil(bound))), dtype=U64)
        last, done = done, done + len(rows)
        cell = mixed(key[:, None] ^ mixed(rows + U64(1))[None, :])
        level = unit(cell)
        n = np.searchsorted(CELL, level.ravel(), "right")
        hit = np.flatnonzero(n)
        of = np.repeat(hit, n[hit])
        nth = (np.arange(len(of)) - np.repeat(np.cumsum(n[hit]) - n[hit], n[hit])).astype(U64)
        dart = mixed(cell.ravel()[of] + (nth + U64(1)) * ODD3)
        rank = last + of % len(rows) + unit(dart)
        if part := last == 0 and bound < 1:  # a part of the first cells is enough for a heavy set
            near = rank < bound
            of, dart, rank = of[near], dart[near], rank[near]
        second = mixed(dart)
        inside = unit(second) < own[of // len(rows)]
        dart, rank, second = dart[inside], rank[inside], second[inside]
        at = (mixed(second) % U64(size)).astype(np.int64)
        order = np.argsort(-rank, kind="stable")  # the lowest rank is written last
        found = np.full(size, np.inf)
        names = np.zeros(size, U64)
        found[at[order]], names[at[order]] = rank[order], dart[order]
        better = found < best
        best[better], value[better] = found[better], names[better]
        if np.isfinite(best).all():
            return value
        if part:  # it wasn't: the first cells again, whole
            done, best = 0, np.full(size, np.inf)
        bound = 1.0 if part else 2 * max(bound, 1.0)
