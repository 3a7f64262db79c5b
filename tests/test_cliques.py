"""Cliques, communities and cores against brute force, many components at once."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from clademill.operators import cliques


def graphs_of(seed, count=20, n=9, share=0.55):
    rng = np.random.default_rng(seed)
    return {g: [(a, b) for a, b in itertools.combinations(range(n), 2) if rng.random() < share] for g in range(count)}


def table(spark, every):
    # ends in both orders, repeats and loops; nodes of different components differ
    rows = [(f"g{g}", *(x + 100 * g for x in (e if i % 2 else e[::-1]))) for g, own in every.items() for i, e in enumerate([*own, *own[:2]])]
    return spark.createDataFrame(rows + [("g0", 3, 3), ("g0", None, 1)], "component_id string, src long, dst long")


def neighbours(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set()).add(a)
    return out


def communities(edges, k):
    near = neighbours(edges)
    every = [set(c) for c in itertools.combinations(sorted(near), k) if all(b in near[a] for a, b in itertools.combinations(c, 2))]
    parts = []
    for c in every:
        own = [p for p in parts if any(len(c & x) >= k - 1 for x in p)]
        parts = [p for p in parts if p not in own] + [[c, *itertools.chain(*own)]]
    return sorted(sorted({e for c in p for e in itertools.combinations(sorted(c), 2)}) for p in parts)


def core(edges, k):
    near = neighbours(edges)
    while low := [n for n, x in near.items() if len(x) < k]:
        for n in low:
            for o in near.pop(n):
                if o in near:
                    near[o].discard(n)
    return near


def clusters(found):
    out = {}
    for r in found.collect():
        out.setdefault((r.component_id, r.algorithm), {}).setdefault(r.cluster, []).append((r.src, r.dst))
    return {key: sorted(map(sorted, own.values())) for key, own in out.items()}


def shifted(edges, g):
    return sorted((a + 100 * g, b + 100 * g) for a, b in edges)


@pytest.mark.parametrize("k, faces", [(2, 2000), (3, 2000), (4, 2000), (4, 0), (5, 5)])
def test_communities(spark, monkeypatch, k, faces):
    every = graphs_of(k)
    if faces < 2000:  # cliques of many faces are compared by their nodes
        monkeypatch.setattr(cliques.communities, "__defaults__", (faces,))
    found = clusters(cliques.clique_clusters(table(spark, every), k, budget=None))
    want = {(f"g{g}", f"{k}clique"): sorted(shifted(p, g) for p in communities(own, k)) for g, own in every.items() if communities(own, k)}
    assert found == want


def test_cores(spark):
    every = graphs_of(11, count=12, n=14, share=0.35)
    frame = table(spark, every).where("src < dst").distinct()
    found = {r.node: r.core for r in cliques.core_numbers(frame).collect()}
    edges = [(r.src, r.dst) for r in frame.collect()]
    want = {n: 0 for n in neighbours(edges)}
    for k in range(1, 14):
        want |= dict.fromkeys(core(edges, k), k)
    assert found == want
    assert cliques.core_numbers(frame.where("false")).count() == 0


def test_core_edges(spark, monkeypatch):
    """Edges of the k-core without the other nodes' core numbers: rounds end when none of fewer than k neighbours is left."""
    every = graphs_of(11, count=12, n=14, share=0.35)
    frame = table(spark, every).where("src < dst").distinct()
    edges = [(r.src, r.dst) for r in frame.collect()]
    for k in (1, 3, 4, 14):
        inner = {*core(edges, k)}
        assert {(r.src, r.dst) for r in cliques.core_edges(frame, k).collect()} == {e for e in edges if inner.issuperset(e)}
    assert cliques.core_edges(frame.where("false"), 2).count() == 0
    # a triangle with a path of ten steps, each of which has one neighbour more than the path's end: all nodes of the 2-core in 11 rounds
    tail = spark.createDataFrame([("c", 0, 1), ("c", 0, 2), ("c", 1, 2), *(("c", i, i + 1) for i in range(2, 12))], "component_id string, src long, dst long")
    assert cliques.core_edges(tail, 2).count() == 3
    monkeypatch.setattr(cliques, "core_numbers", None)  # numbers aren't looked for
    assert cliques.clique_clusters(tail, 2, budget=0).count() == 3


def test_budget_and_names(spark):
    every = graphs_of(4, count=4)
    frame = table(spark, every)
    for options, cored in (({"budget": 0}, {0, 1, 2, 3}), ({"core_components": ("g1", "g3")}, {1, 3}), ({"budget": None, "core_components": ("g2",)}, {2}), ({"budget": 1}, {0, 1, 2, 3})):
        found = clusters(cliques.clique_clusters(frame, 3, **options))
        for g, own in every.items():
            if g in cored:
                left = core(own, 3)
                edges = shifted({tuple(sorted((a, b))) for a, x in left.items() for b in x}, g)
                assert sorted(e for p in found.get((f"g{g}", "3core"), []) for e in p) == edges and (f"g{g}", "3clique") not in found
            else:
                assert found[f"g{g}", "3clique"] == sorted(shifted(p, g) for p in communities(own, 3))


def test_no_group_per_component(spark):
    plan = cliques.clique_rows(spark.createDataFrame([("a", 1, 2)], "component_id string, src long, dst long"), 3)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan
    assert cliques.clique_clusters(spark.createDataFrame([], "component_id string, src long, dst long"), 3).count() == 0
    with pytest.raises(ValueError):
        cliques.clique_clusters(spark.createDataFrame([], "component_id string, src long, dst long"), 1)


def test_a_large_component(spark):
    """A ring of 20,000 triangles with a hub that all its nodes have: one component, all of it one community of triangles."""
    n = 20_000
    ring = spark.range(n).select(F.lit("r").alias("component_id"), F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
    hub = spark.range(n).select(F.lit("r").alias("component_id"), F.lit(-1).cast("long").alias("src"), F.col("id").alias("dst"))
    found = cliques.clique_clusters(ring.union(hub), 3)
    assert found.count() == 2 * n and found.select("cluster").distinct().count() == 1
