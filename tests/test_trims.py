"""Trims by window steps against the plain forms on arrays."""

import numpy as np
import plain
import pytest

from clademill.functions.special import geometric_threshold
from clademill.operators import trims


@pytest.fixture(scope="module")
def profiles():
    rng = np.random.default_rng(6)
    out = {}
    for k in range(60):
        n = int(rng.integers(1, 40))
        levels = rng.choice([0.0, 0.0004, 0.002, 0.3, 0.8, 0.95, 1.0], n)
        p3 = np.repeat(levels, 2)[:n] if k % 2 else levels
        p2 = np.minimum(1 - p3, rng.choice([0.0, 0.05, 0.4, 1.0], n))
        out[f"g{k}"] = (p2, p3, np.round(rng.random(n), int(rng.choice([1, 3]))))
    return out


@pytest.fixture(scope="module")
def columns(spark, profiles):
    rows = [(g, i, float(a), float(b), float(c)) for g, own in profiles.items() for i, (a, b, c) in enumerate(zip(*own))]
    return spark.createDataFrame(rows, "g string, pos int, p2 double, p3 double, gaps double")


def found(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r.g, []).append((r.start, r.stop))
    return {g: sorted(x) for g, x in out.items()}


def some(slices):
    return {g: x for g, x in slices.items() if x}


def test_trims(columns, profiles):
    assert found(trims.trim_slices(columns, ["g"], "p3", "gaps")) == some({g: plain.hysteresis(p3, c) for g, (_, p3, c) in profiles.items()})


def test_hulls(columns, profiles):
    want = {g: plain.hulls(p3, np.gradient(p3) if len(p3) > 1 else np.zeros(1)) for g, (_, p3, _) in profiles.items()}
    assert found(trims.hull_slices(columns, ["g"], "p3")) == some(want)


def test_regions(columns, profiles):
    want = some({g: plain.region_trims(*own) for g, own in profiles.items()})
    assert want and found(trims.region_slices(columns, ["g"], "p2", "p3", "gaps")) == want


def test_nothing(columns):
    assert trims.trim_slices(columns.where("false"), ["g"], "p3", "gaps").count() == 0


def test_masks_and_what_is_left(spark):
    rng = np.random.default_rng(9)
    alignments = {g: ["".join(rng.choice(["A", "-"], 70, p=[q, 1 - q])) for q in rng.choice([0.02, 0.1, 0.9], 8)] for g in range(12)}
    weights = {g: np.round(rng.random(8), 2) + 0.01 for g in alignments}
    symbols = spark.createDataFrame([(g, r, i, c, float(weights[g][r])) for g, rows in alignments.items() for r, text in enumerate(rows) for i, c in enumerate(text)], "g int, row int, pos int, sym string, w double")
    slices, regions = {g: [(2, 24), (30, 30 + 3 * g)] for g in alignments if g}, {g: [(5, 14)] for g in alignments if g % 3}
    table = lambda own: spark.createDataFrame([(g, a, b) for g, x in own.items() for a, b in x], "g int, start int, stop int")
    masks = trims.masked(symbols, table(slices), ["g"], "row", "w")
    left = {r.g: (r.columns, r.residues) for r in trims.left_over(symbols, masks, table(regions), ["g"], "row").collect()}
    hidden = set()
    for g, rows in alignments.items():
        own = plain.segment_trims(rows, slices.get(g, []), geometric_threshold, weights[g])
        hidden |= {(g, r, a, b) for r, text in enumerate(own) for a, b in slices.get(g, []) if "." in text[a:b]}
        rest = plain.without_slices(own, regions.get(g, []))
        assert left.get(g, (0, 0)) == (len(rest[0]), sum(t.count("A") for t in rest))
    assert {tuple(r) for r in masks.collect()} == hidden and hidden
