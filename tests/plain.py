"""Plain forms of trims, on the arrays and texts of one alignment, that the tables' forms are held against."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from clademill.operators.msa import GAP, UNALIGNED, merged_slices, run_slices


def complement_slices(slices: list[tuple[int, int]], start: int = 0, stop: int | None = None) -> list[tuple[int, int | None]]:
    out = []
    for a, b in merged_slices(slices):
        if a > start:
            out.append((start, a))
        start = max(start, b)
    if stop is None or start < stop:
        out.append((start, stop))
    return out


def _reach(ok: np.ndarray, at: int, step: int) -> int:
    """The last position that is met from `at` in the direction of `step` while the next one is ok."""
    way = ok[at + 1 :] if step > 0 else ok[:at][::-1]
    return at + step * (len(way) if way.all() else int(np.argmin(way)))


def hulls(posterior: np.ndarray, grad: np.ndarray, core: float = 0.75, edge: float = 1e-3, slope: float = 1e-3) -> list[tuple[int, int]]:
    """Runs above `core`, grown while the posterior is above `edge` or rises towards them."""
    left, right = ((posterior >= edge) | (s * grad >= slope) for s in (1, -1))
    return merged_slices([(_reach(left, a, -1), _reach(right, b - 1, 1) + 1) for a, b in run_slices(posterior >= core)])


def hysteresis(posterior: np.ndarray, profile: np.ndarray, core: float = 0.75, edge: float = 1e-3, slope: float = 1e-3, grad: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Slices of runs above `core`, each end where posterior and profile change most within a margin.

    A margin extends outward as in hulls(), and inward while the posterior is still rising; its outermost column on the left
    and innermost on the right are no candidates, and outer columns win ties. An end without a margin (on the right: one
    that goes beyond the column after the core) stays, and so do both where they would cross.
    """
    if not len(posterior):
        return []
    if grad is None:
        grad = np.gradient(posterior) if len(posterior) > 1 else np.zeros(1)
    change = np.abs(grad * np.diff(profile, prepend=profile[:1]))
    up, down = grad >= slope, grad <= -slope
    out = []
    for a, b in run_slices(posterior >= core):
        low, high = _reach((posterior >= edge) | up, a, -1), _reach((posterior >= edge) | down, b - 1, 1)
        inner, outer = _reach(up, a, 1), _reach(down, b - 1, -1)
        left = low + 1 + int(np.argmax(change[low + 1 : inner + 1])) if low < inner else a
        right = high - int(np.argmax(change[outer + 1 : high + 1][::-1])) if high > b else b
        out.append((left, right) if left < right else (a, b))
    return merged_slices(out)


def region_trims(p2: np.ndarray, p3: np.ndarray, profile: np.ndarray, core3: float = 0.75, core: float = 0.9, edge: float = 1e-3, slope: float = 1e-3) -> list[tuple[int, int]]:
    """Slices that the second and third state take together, outside the hulls of the third one."""
    if not len(p3):
        return []
    rest = p3.copy()
    for a, b in hulls(p3, np.gradient(p3) if len(p3) > 1 else np.zeros(1), core3, edge, slope):
        rest[a:b] = 0
    return hysteresis(rest + p2, profile, core, edge, slope)


def segment_trims(rows: Sequence[str], slices: list[tuple[int, int]], threshold, weights: Sequence[float] | None = None, drop: int = 5) -> list[str]:
    """rows in which the residues of a slice are unaligned where a row has more of them than the others would suggest.

    threshold: from the weighted mean of all but the `drop` largest counts (2 at least) to the count that is too large.
    """
    out = [list(r) for r in rows]
    w = np.ones(len(rows)) if weights is None else np.asarray(weights, float)
    for a, b in slices:
        counts = np.array([sum(c not in GAP + UNALIGNED for c in r[a:b]) for r in rows])
        rest = np.argsort(counts, kind="stable")[: max(0, len(counts) - drop)]
        limit = threshold(max(2.0, float(counts[rest] @ w[rest] / w[rest].sum())) if len(rest) else 2.0)
        for row in np.flatnonzero(counts >= limit):
            out[row][a:b] = UNALIGNED * (b - a)
    return ["".join(r) for r in out]


def without_slices(rows: Sequence[str], slices: list[tuple[int, int]]) -> list[str]:
    """rows without the columns of the slices, and then without those that hold nothing but gaps."""
    kept = ["".join(r[a:b] for a, b in complement_slices(slices)) for r in rows]
    some = [j for j, column in enumerate(zip(*kept)) if any(c not in GAP + UNALIGNED for c in column)]
    return ["".join(r[j] for j in some) for r in kept]
