"""Trees of many tips, and consensus of a table of trees, against plain versions."""

import numpy as np
import pytest

from clademill.operators import trees
from clademill.sources import newick


def random_tree(rng, names):
    parts = [f"{n}:{rng.integers(1, 50) / 10}" for n in names]
    while len(parts) > 1:
        i, j = sorted(rng.choice(len(parts), 2, replace=False))
        parts[i] = f"({parts[i]},{parts[j]}):{rng.integers(1, 50) / 10}" if rng.random() < 0.9 else f"({parts[i]},{parts[j]})"
        parts.pop(j)
    return parts[0].rpartition(")")[0] + ");"


def test_weights_are_those_of_the_covariance():
    rng = np.random.default_rng(1)
    for n in (2, 3, 9, 40):
        tree = newick.parse(random_tree(rng, [f"t{i}" for i in range(n)]))
        names, cov = trees.brownian_covariance(tree)
        rows = np.linalg.inv(cov).sum(1)
        assert trees.brownian_weights(tree) == pytest.approx(dict(zip(names, rows / rows.sum())), abs=1e-9)


def test_a_comb_of_ten_thousand_tips():
    text = "(" * 9999 + "t0:1" + "".join(f",t{i}:1):1" for i in range(1, 10_000)) + ";"
    found = trees.brownian_weights(newick.parse(text))
    assert len(found) == 10_000 and sum(found.values()) == pytest.approx(1) and found["t9999"] == max(found.values())


@pytest.mark.parametrize("text", ["(A,B)", "(A,B;", "A,B;", "(A,B));", "", "(A,B)(C);"])
def test_what_is_no_tree(text):
    with pytest.raises(ValueError):
        newick.parse(text)


def shape(node):
    return (node.name, None if node.length is None else round(node.length, 9), None if node.support is None else round(node.support, 9), sorted((shape(c) for c in node.children), key=str))


@pytest.mark.parametrize("cutoff", [0.5, 0.2, 0.0])
def test_consensus_of_a_table(spark, cutoff):
    rng = np.random.default_rng(7)
    base = [random_tree(rng, "ABCDEFG") for _ in range(4)]
    texts = [base[i] for i in rng.choice(4, 60, p=[0.6, 0.2, 0.1, 0.1])]
    # real trees have lengths of their own: no two texts are equal
    texts = [t.replace(":", f":{i % 50}") for i, t in enumerate(texts)]
    d = spark.createDataFrame([(t,) for t in texts] + [(None,)], "newick string")
    want = trees.consensus([newick.parse(t) for t in texts], cutoff)
    assert shape(trees.table_consensus(d, cutoff=cutoff)) == shape(want)


def test_consensus_of_nothing(spark):
    with pytest.raises(ValueError):
        trees.table_consensus(spark.createDataFrame([], "newick string"))
