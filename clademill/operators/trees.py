"""Computations on one tree: weights, contrasts, consensus. Trees are small; a table of trees is grouped by tree."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clademill.sources.newick import Node, parse
from clademill.storage import stored


def _two(node: Node) -> tuple[Node, Node]:
    if len(node.children) != 2:
        raise ValueError("the tree has to be binary")
    return node.children[0], node.children[1]


def brownian_covariance(tree: Node) -> tuple[list[str], np.ndarray]:
    """Tips in postorder and the length of path that each two of them share from the root."""
    names = tree.names()
    cov, at = np.zeros((len(names), len(names))), 0

    def fill(node: Node, root: bool) -> tuple[int, int]:
        nonlocal at
        if node.children:
            (first, _), (_, last) = (fill(c, False) for c in _two(node))
        else:
            first, at = at, at + 1
            last = at
        if not root:
            cov[first:last, first:last] += node.length or 0.0
        return first, last

    fill(tree, True)
    return names, cov


def brownian_weights(tree: Node) -> dict[str, float]:
    """Each tip's weight in the estimate of the root value: one pass up the tree for the lengths that its nodes stand for, one
    down for the shares that two children have of their node. A sum of two lengths that is 0 shares equally."""
    long, order = {}, list(tree.postorder())
    for node in order:
        own = node.length or 0.0
        if node.children:
            v, w = (long[id(c)] for c in _two(node))
            own += v * w / (v + w) if v + w else 0.0
        long[id(node)] = own
    share, out = {id(tree): 1.0}, {}
    for node in reversed(order):
        own = share[id(node)]
        if not node.children:
            out[node.name] = own
            continue
        one, two = node.children
        v, w = long[id(one)], long[id(two)]
        part = w / (v + w) if v + w else 0.5
        share[id(one)], share[id(two)] = own * part, own * (1 - part)
    return {name: out[name] for name in tree.names()}


def contrasts(tree: Node, values: dict[str, np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Root value and independent contrasts in postorder; values may be arrays over columns."""
    out = []

    def visit(node: Node) -> tuple[np.ndarray, float]:
        if not node.children:
            return np.asarray(values[node.name], float), node.length or 0.0
        (x, v), (y, w) = (visit(c) for c in _two(node))
        out.append((x - y) / np.sqrt(v + w))
        return (x / v + y / w) / (1 / v + 1 / w), (node.length or 0.0) + v * w / (v + w)

    return visit(tree)[0], out


def _mean(values: list[tuple[float, int]]) -> float | None:
    """Of values and how often they occur."""
    return float(np.average([x for x, _ in values], weights=[n for _, n in values])) if values else None


def clades(tree: Node) -> dict[frozenset, Node]:
    return {frozenset(n.names()): n for n in tree.postorder() if n.children}


def clade_counts(trees: DataFrame, newick: str = "newick") -> DataFrame:
    """clade (sorted tip names) and in how many rows of trees it occurs, counted where the trees are."""

    def split(batches):
        import pandas as pd

        for frame in batches:
            yield pd.DataFrame({"clade": [sorted(c) for text in frame[newick] for c in clades(parse(text))]})

    return trees.select(newick).mapInPandas(split, "clade array<string>").groupBy("clade").agg(F.count("*").alias("n"))


def _hashed(tree: Node) -> dict[int, tuple[bytes, int]]:
    """Key and number of tips of each inner node, by its id: the key is the sum of its tips' 128-bit hashes, so it takes one visit."""
    sums, out = {}, {}
    for node in tree.postorder():
        if node.children:
            total, n = (sum(x) for x in zip(*(sums[id(c)] for c in node.children)))
            out[id(node)] = ((total % 2**128).to_bytes(16, "big"), n)
        else:
            total, n = int.from_bytes(blake2b(node.name.encode(), digest_size=16).digest(), "big"), 1
        sums[id(node)] = (total, n)
    return out


def _by_tree(trees: DataFrame, newick: str, rows: Callable[[Node], Iterator[tuple]], schema: str) -> DataFrame:
    """What `rows` gives for each tree."""
    import pandas as pd

    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for frame in batches:
            yield pd.DataFrame([r for text in frame[newick] for r in rows(parse(text))], columns=names)

    return trees.select(newick).mapInPandas(run, schema)


def table_consensus(trees: DataFrame, newick: str = "newick", cutoff: float = 0.5) -> Node:
    """consensus() of a table of trees, which stay where they are.

    Clades are counted by their keys; those in a share `cutoff` of the trees, of which there are fewer than tips / cutoff,
    reach the driver with their names, and the sums of lengths of those that stand.
    """
    kept = trees.where(F.col(newick).isNotNull())
    total = kept.count()
    if not total:
        raise ValueError("a consensus needs a tree")
    found = stored(_by_tree(kept, newick, lambda t: iter(_hashed(t).values()), "key binary, size long").groupBy("key", "size").agg(F.count("*").alias("n")), "clades")
    every = bytes(found.orderBy(F.col("size").desc(), F.col("n").desc(), "key").first().key)
    counts = {bytes(r.key): r.n for r in found.where((F.col("n") >= cutoff * total) | (F.col("key") == F.lit(every))).collect()}

    def named(tree: Node) -> Iterator[tuple]:
        keys = _hashed(tree)
        for node in tree.postorder():
            key = keys.get(id(node), (None,))[0]
            if key in counts:
                yield key, sorted(node.names())

    names = _by_tree(kept, newick, named, "key binary, names array<string>").groupBy("key").agg(F.first("names").alias("names")).collect()
    clade_of = {frozenset(r.names): bytes(r.key) for r in names}
    whole = next(c for c, key in clade_of.items() if key == every)
    shares = {c: counts[key] / total for c, key in clade_of.items()}
    standing = _standing(whole, shares, cutoff)
    homes = {name: _home(standing, name) for name in whole}
    wanted = {clade_of[c] for c in standing}
    beside = {name: frozenset(clade_of[k] for k in inner) for name, (_, inner) in homes.items()}

    def lengths(tree: Node) -> Iterator[tuple]:
        keys = _hashed(tree)
        shown = {k for k, _ in keys.values()}
        for node in tree.postorder():
            if node.length is None:
                continue
            if node.children:
                if keys[id(node)][0] in wanted:
                    yield keys[id(node)][0], None, node.length
            elif node.name in beside and beside[node.name] <= shown:
                yield None, node.name, node.length

    sums = _by_tree(kept, newick, lengths, "key binary, name string, length double").groupBy("key", "name").agg(F.avg("length").alias("length")).collect()
    of_clade, of_tip = ({k: r.length for r in sums if (k := r[i]) is not None} for i in (0, 1))
    return _built(standing, shares, homes, {c: of_clade.get(clade_of[c]) for c in standing}, of_tip)


def _standing(every: frozenset, shares: dict[frozenset, float], cutoff: float) -> list[frozenset]:
    """The clades that fit those before them, the most frequent first, then larger ones."""
    kept = [every]
    for clade in sorted(shares, key=lambda c: (-shares[c], -len(c), sorted(c))):
        if clade != every and shares[clade] >= cutoff and all(clade <= k or k <= clade or not clade & k for k in kept):
            kept.append(clade)
    return kept


def _home(standing: list[frozenset], name: str) -> tuple[frozenset, list[frozenset]]:
    """The least clade with a tip, and the clades right below it."""
    home = min((k for k in standing if name in k), key=len)
    return home, [k for k in standing if k < home and not any(k < o < home for o in standing)]


def _built(standing: list[frozenset], shares: dict[frozenset, float], homes: dict, of_clade: dict, of_tip: dict) -> Node:
    nodes = {c: Node(support=shares[c]) for c in standing}
    for clade in standing[1:]:
        nodes[clade].length = of_clade.get(clade)
        nodes[min((k for k in standing if clade < k), key=len)].children.append(nodes[clade])
    for name in sorted(standing[0]):
        nodes[homes[name][0]].children.append(Node(name, of_tip.get(name)))
    nodes[standing[0]].support = None
    return nodes[standing[0]]


def consensus(trees: list[Node], cutoff: float = 0.5, times: list[int] | None = None) -> Node:
    """The clades in at least a share `cutoff` of the trees (each one counting `times`), most frequent first, as long as they fit what stands.

    Supports are shares; a length is the mean over the trees that show the clade, a tip's over the trees that show all
    clades beside it.
    """
    shown, times = [clades(t) for t in trees], times or [1] * len(trees)
    total, counts = sum(times), Counter()
    for s, n in zip(shown, times):
        counts.update(dict.fromkeys(s, n))
    shares = {c: n / total for c, n in counts.items()}
    kept = _standing(max(counts, key=len), shares, cutoff)
    of_clade = {c: _mean([(s[c].length, n) for s, n in zip(shown, times) if c in s and s[c].length is not None]) for c in kept}
    lengths_of = [{t.name: t.length for t in tree.tips()} for tree in trees]
    homes = {name: _home(kept, name) for name in kept[0]}
    of_tip = {name: _mean([(x[name], n) for x, s, n in zip(lengths_of, shown, times) if x[name] is not None and all(k in s for k in beside)]) for name, (_, beside) in homes.items()}
    return _built(kept, shares, homes, of_clade, of_tip)
