"""Communities are those of all cliques, whatever the size of a component and the number of its cliques."""

import itertools

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from clademill.operators import cliques
from clademill.plans import registry

COPIES = 10


@pytest.fixture(scope="module")
def blocks(tmp_path_factory):
    """Folder of a table of embeddings: two blocks of six labels each, a label's vectors in ten copies; in the graph, all vectors of a
    block but those of one label are neighbours (10^6 maximal cliques a block), and labels 5 and 6 connect the blocks."""
    rows = [(x, label) for x, labels in ((0, (0, 1, 2, 3, 4, 5)), (1, (0, 1, 2, 3, 4, 6))) for label in labels for _ in range(COPIES)]
    table = pa.table({"vec_id": range(len(rows)), "embedding": pa.array([[1.0 - x, float(x)] for x, _ in rows], pa.list_(pa.float32())), "label": pa.array([n for _, n in rows], pa.int32())})
    path = tmp_path_factory.mktemp("blocks")
    pq.write_table(table, path / "embeddings.parquet")
    return str(path)


def block_edges(at):
    return {(at + a, at + b) for a, b in itertools.combinations(range(6 * COPIES), 2) if a // COPIES != b // COPIES}


def test_clique_clusters_3(spark, blocks):
    found = registry.queries()["clique_clusters_3"](spark, blocks).collect()
    assert {r.algorithm for r in found} == {"3clique"}
    assert {(r.src, r.dst) for r in found if r.OGid == "0000"} == block_edges(60) and {(r.src, r.dst) for r in found if r.OGid == "0001"} == block_edges(0)
    assert len(found) == 2 * len(block_edges(0))


def test_every_clique_is_held(monkeypatch):
    """What a node's search gives holds all cliques of the size asked for and no others, by either way."""
    from test_cliques import graphs_of, neighbours

    for size, (some, most) in itertools.product((1, 2, 3, 4), ((1000, 20_000), (0, 0))):
        monkeypatch.setattr(cliques, "SOME", some)
        monkeypatch.setattr(cliques, "MOST", most)
        for edges in graphs_of(size, count=5, n=12, share=0.7).values():
            near = neighbours(edges)
            want = {c for c in itertools.combinations(sorted(near), size) if all(b in near[a] for a, b in itertools.combinations(c, 2))}
            found = [tuple(sorted(c)) for c in cliques.covering_cliques(near, size)[0]]
            assert len(found) == len({*found}) and {x for c in found for x in itertools.combinations(c, size)} == want
            assert {*found} == ({tuple(sorted(c)) for c in cliques.maximal_cliques(near, size)[0]} if most else want)


def test_twins(spark):
    """Nodes with the same neighbours have the least of them for a twin; degrees alone or neighbours of one another don't do."""
    edges = [(a, b) for a in (1, 2, 3) for b in (4, 5)] + [(4, 5), (6, 7), (8, 9), (8, 10)]
    found = cliques.twins(spark.createDataFrame(edges, "src long, dst long"))
    assert sorted(map(tuple, found.collect())) == [(2, 1), (3, 1), (10, 9)]


def test_a_component_of_millions_of_cliques(spark):
    """All pairs of 55 nodes but those next to one another in a ring: no twins and 5 million maximal cliques, but 300,000 of four nodes; and an edge to five nodes apart."""
    n = 55
    ring = {(a, b) for a, b in itertools.combinations(range(n), 2) if b - a not in (1, n - 1)}
    apart = {*itertools.combinations(range(100, 105), 2)}
    frame = spark.createDataFrame([("a", *e) for e in ring | apart | {(0, 100)}], "component_id string, src long, dst long")
    found = {}
    for r in cliques.clique_clusters(frame, 4).collect():
        assert r.algorithm == "4clique"
        found.setdefault(r.cluster, set()).add((r.src, r.dst))
    assert sorted(found.values(), key=len) == [apart, ring]


def test_clique_clusters_4(spark, blocks):
    found = registry.queries()["clique_clusters_4"](spark, blocks).collect()
    assert {r.algorithm for r in found} == {"4clique"}
    assert {(r.src, r.dst) for r in found if r.OGid == "0000"} == block_edges(60) and {(r.src, r.dst) for r in found if r.OGid == "0001"} == block_edges(0)
    assert len(found) == 2 * len(block_edges(0))


def test_cluster_lineage(spark, blocks):
    found = registry.queries()["cluster_lineage"](spark, blocks).collect()
    assert sorted(map(tuple, found)) == [("0/0000", "0/0000", True), ("0/0001", "0/0001", True)]


def test_cluster_types(spark, blocks):
    found = registry.queries()["cluster_types"](spark, blocks).collect()
    assert [(r.component_id, r.type) for r in found] == [("0", 3)]  # several communities without a common node
