"""Maximal cliques, their percolation and k-cores, over all tasks at once: no component is one group.

Cliques are looked for from each node among its later neighbours, those of higher degree; it has few of these (the square
root of twice the edges at most), however many neighbours a hub has. What two cliques have in common is found through their
faces, and the classes of faces through connected components.

Communities need any cliques that hold all k-cliques between them. Therefore one of several nodes with the same neighbours
stands for all, and a node whose maximal cliques are more work than its k-cliques is searched for these: neither changes a result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb, factorial

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from clademill.operators.components import components
from clademill.storage import stored

#: Steps after which one node's maximal cliques may be given up for its k-cliques, and steps after which they are.
SOME, MOST = 1000, 20_000
#: A clique with more faces than this is compared with others by the nodes they have in common.
FACES = 2000
#: Rows after which a worker sends what it has.
MANY = 50_000


def maximal_cliques(adjacent: dict, least: int = 1, budget: int | None = None) -> tuple[list[frozenset], int]:
    """All maximal cliques of `least` nodes or more, by pivoting, and the steps taken; none after `budget` steps."""
    out, steps = [], 0
    todo = [(frozenset(), set(adjacent), set())]
    while todo:
        steps += 1
        if budget is not None and steps > budget:
            return [], steps
        clique, more, done = todo.pop()
        if not more and not done:
            out.append(clique)
            continue
        if len(clique) + len(more) < least:
            continue
        pivot = max(more | done, key=lambda n: len(adjacent[n] & more))
        for node in sorted(more - adjacent[pivot]):
            todo.append((clique | {node}, more & adjacent[node], done & adjacent[node]))
            more.remove(node)
            done.add(node)
    return [c for c in out if len(c) >= least], steps


def every_clique(adjacent: dict, size: int, among: set | None = None) -> Iterator[tuple]:
    """All cliques of so many nodes (of those in `among`), one at a time, each once and in order."""
    if not size:
        yield ()
        return
    for node in adjacent if among is None else among:
        for rest in every_clique(adjacent, size - 1, {n for n in adjacent[node] if n > node and (among is None or n in among)}):
            yield node, *rest


def covering_cliques(adjacent: dict, size: int) -> tuple[Iterable, int]:
    """Cliques of `size` nodes or more that hold all cliques of `size` nodes, and the steps taken.

    They are the maximal ones, unless these take more steps or have more faces than the cliques of `size` nodes can have,
    of which there are (2 * edges) ** (size / 2) / size! at most; these are not held in memory.
    """
    most = max(SOME, int(sum(map(len, adjacent.values())) ** (size / 2)) // factorial(size))
    limit = min(MOST, most)
    found, steps = maximal_cliques(adjacent, size, limit)
    if steps > limit or sum(comb(len(c) + 1, size) for c in found) > (size + 1) * most:
        return every_clique(adjacent, size), steps
    return found, steps


def twins(edges: DataFrame) -> DataFrame:
    """node and twin, the least node with the same neighbours (by 128 bits of their hashes), of nodes that aren't the least.

    edges: src, dst, distinct. Twins are no neighbours. With a twin in its place a k-clique is one that has k - 1 nodes in
    common with it, so that the edges of twins belong to the same communities.
    """
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("near")).union(edges.select("dst", "src"))
    sums = [F.sum(h.cast("decimal(38,0)")).alias(name) for name, h in (("one", F.xxhash64("near")), ("two", F.xxhash64(F.lit(1), "near")))]
    marks = stored(both.groupBy("node").agg(F.count("*").alias("n"), *sums), "marks")
    first = marks.groupBy("n", "one", "two").agg(F.min("node").alias("twin"), F.count("*").alias("same")).where("same > 1")
    return marks.join(first, ["n", "one", "two"]).where("node <> twin").select("node", "twin")


def with_twins(edges: DataFrame, same: DataFrame) -> DataFrame:
    """edges (src < dst) and, for either end or both, those of its twins. same: node, twin."""
    out = edges
    for end in ("src", "dst"):
        more = out.join(same.select(F.col("twin").alias(end), F.col("node").alias("__node")), end)
        out = out.unionByName(more.drop(end).withColumnRenamed("__node", end))
    return out.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})


def later(edges: DataFrame) -> DataFrame:
    """edges (src < dst, distinct) with u and v: its end of lower degree (ties: the lesser) and the other."""
    degree = edges.select(F.col("src").alias("n")).union(edges.select("dst")).groupBy("n").agg(F.count("*").alias("d"))
    ranked = edges.join(degree.withColumnsRenamed({"n": "src", "d": "__a"}), "src").join(degree.withColumnsRenamed({"n": "dst", "d": "__b"}), "dst")
    up = F.col("__a") <= F.col("__b")
    return ranked.withColumn("u", F.when(up, F.col("src")).otherwise(F.col("dst"))).withColumn("v", F.when(up, F.col("dst")).otherwise(F.col("src"))).drop("__a", "__b")


def clique_rows(edges: DataFrame, k: int, budget: int | None = None) -> DataFrame:
    """component_id, clique (its nodes in order; k or more) and, in rows without a clique, the steps of one node's search.

    edges: component_id, src < dst, distinct. Every k-clique is in one of the rows' cliques, some of which others contain.
    """
    out = stored(later(edges).select("component_id", "u", "v"), "later")
    kind = dict(edges.dtypes)["src"]
    wedges = out.join(out.select("u", F.col("v").alias("w")), "u").where("v < w")
    closed = wedges.join(edges.select(F.col("src").alias("v"), F.col("dst").alias("w")), ["v", "w"], "left_semi").select("component_id", "u", "v", "w")
    around = closed if k > 2 else closed.union(out.select("component_id", "u", "v", F.lit(None).cast(kind)))
    packed = around.groupBy("component_id", "u").agg(F.collect_list(F.struct("v", "w")).alias("pairs"))

    def record(rows: list, batch: pa.RecordBatch) -> pa.RecordBatch:
        kinds = (batch.schema.field("component_id").type, pa.list_(batch.schema.field("u").type), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names=["component_id", "clique", "steps"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for component, u, pairs in zip(*(batch.column(c) for c in ("component_id", "u", "pairs"))):
                adjacent = defaultdict(set)
                for a, b in zip(*(pairs.values.field(i).to_pylist() for i in (0, 1))):
                    adjacent[a]
                    if b is not None:
                        adjacent[a].add(b)
                        adjacent[b].add(a)
                component, u = component.as_py(), u.as_py()
                found, steps = covering_cliques(adjacent, k - 1) if budget is None else maximal_cliques(adjacent, k - 1, budget)
                rows.append((component, None, steps))
                for clique in found:
                    rows.append((component, sorted((u, *clique)), None))
                    if len(rows) > MANY:
                        yield record(rows, batch)
                        rows = []
            if rows:
                yield record(rows, batch)

    return packed.mapInArrow(run, f"component_id {dict(edges.dtypes)['component_id']}, clique array<{kind}>, steps long")


def communities(cliques: DataFrame, k: int, faces: int = FACES) -> DataFrame:
    """id and cluster: the least clique that a chain of cliques, each with k - 1 nodes in common with the next, reaches.

    cliques: id, clique (k or more nodes).
    """
    most = next((m for m in range(k, 10_000) if comb(m, k - 1) > faces), 10_000)
    few, many = cliques.where(F.size("clique") < most), cliques.where(F.size("clique") >= most)
    kind = dict(cliques.dtypes)["clique"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = [], []
            for i, clique in zip(batch.column("id").to_pylist(), batch.column("clique")):
                own = [*combinations(clique.values.to_pylist(), k - 1)]
                ids += [i] * len(own)
                lists += own
                if len(ids) > MANY:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lists, clique.type)], names=["id", "face"])
                    ids, lists = [], []
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lists, clique.type)], names=["id", "face"])

    own = stored(few.select("id", "clique").mapInArrow(run, f"id long, face {kind}"), "faces")
    shared = own.groupBy("face").agg(F.min("id").alias("top"), F.count("*").alias("n")).where("n > 1")
    links = own.join(shared, "face").where("id <> top").select("id", "top")
    nodes = cliques.select("id", F.explode("clique").alias("node"))
    large = many.select(F.col("id").alias("top"), F.explode("clique").alias("node"))
    common = large.join(nodes, "node").where("id <> top").groupBy("id", "top").agg(F.count("*").alias("n")).where(F.col("n") >= k - 1)
    found = components(links.union(common.select("id", "top")), "id", "top").withColumnRenamed("node", "id")
    return cliques.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))


def core_numbers(edges: DataFrame) -> DataFrame:
    """node and core: the greatest k of a part, in which each node has k neighbours or more, that holds the node.

    edges: src < dst, distinct. Bounds, at first the degrees, fall to the greatest h such that h neighbours have h or more,
    until a round changes none; a node's neighbours count by value, so that a hub is no list.
    """
    both = stored(edges.select("src", "dst").union(edges.select("dst", "src")), "both")

    def written(df: DataFrame) -> tuple[DataFrame, int]:
        seen = Observation()
        return stored(df.observe(seen, F.coalesce(F.sum("core"), F.lit(0)).alias("sum")), "cores"), seen.get["sum"]

    now, mark = written(both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("core")))
    before = None
    while mark != before:
        before = mark
        near = both.join(now.select(F.col("node").alias("dst"), F.col("core").alias("theirs")), "dst").join(now.select(F.col("node").alias("src"), "core"), "src")
        values = near.groupBy("src", F.least("core", "theirs").alias("h")).agg(F.count("*").alias("n"))
        above = F.sum("n").over(Window.partitionBy("src").orderBy(F.col("h").desc()))
        now, mark = written(values.withColumn("above", above).groupBy(F.col("src").alias("node")).agg(F.max(F.least("h", "above")).alias("core")))
    return now


def core_edges(edges: DataFrame, k: int) -> DataFrame:
    """edges between nodes whose core number is k or more, stored: nodes of fewer than k neighbours go, round by round, until none does.

    edges: src < dst, distinct. A round reads only what the one before has left.
    """
    def written(df: DataFrame) -> tuple[DataFrame, int]:
        seen = Observation()
        return stored(df.observe(seen, F.count("*").alias("n")), "core"), seen.get["n"]

    now, n = written(edges)
    before = None
    while n and n != before:
        before = n
        inner = now.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("node")
        left = now.join(inner.withColumnRenamed("node", "src"), "src", "left_semi").join(inner.withColumnRenamed("node", "dst"), "dst", "left_semi")
        now, n = written(left.select(*edges.columns))
    return now


def core_clusters(edges: DataFrame, k: int) -> DataFrame:
    """component_id, cluster (the least node of a connected part of the k-core, as text), src, dst."""
    left = core_edges(edges.select("component_id", "src", "dst"), k)
    return left.join(components(left).withColumnRenamed("node", "src"), "src").select("component_id", F.concat(F.lit("n"), "component").alias("cluster"), "src", "dst")


def clique_clusters(edges: DataFrame, k: int, budget: int | None = None, core_components: tuple = ()) -> DataFrame:
    """component_id, cluster (a text), algorithm, src < dst of the k-clique communities of each component.

    edges: component_id, src, dst; loops, repeats and null ends don't count. All communities are found, however large a
    component is. The connected parts of its k-core stand for the communities of a component that is named. Only a caller
    who passes a `budget` has them stand for components whose search takes more steps, too, or for all (0: no search).
    """
    if k < 2:
        raise ValueError("k has to be 2 or more")
    own = edges.where("src <> dst").select("component_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    own = stored(own, "edges")
    named = F.col("component_id").isin(*core_components) if core_components else F.lit(False)
    if budget == 0:
        return core_clusters(own, k).withColumn("algorithm", F.lit(f"{k}core")).select("component_id", "cluster", "algorithm", "src", "dst")
    searched = own.where(~named)
    same = stored(twins(searched), "twins")
    merged = bool(same.take(1))
    if merged:
        for end in ("src", "dst"):
            searched = searched.join(same.select(F.col("node").alias(end)), end, "left_anti")
    rows = stored(clique_rows(searched, k, budget), "cliques")
    out = []
    over = None
    if budget is not None:
        over = rows.groupBy("component_id").agg(F.sum("steps").alias("steps")).where(F.col("steps") > budget).select("component_id")
        over = stored(over.union(own.where(named).select("component_id").distinct()), "over")
    elif core_components:
        over = own.where(named).select("component_id").distinct()
    if over is not None and over.take(1):
        out.append(core_clusters(own.join(over, "component_id", "left_semi"), k).withColumn("algorithm", F.lit(f"{k}core")))
        rows = rows.join(over, "component_id", "left_anti")
    cliques = stored(rows.where("clique is not null").select("component_id", "clique", F.monotonically_increasing_id().alias("id")), "found")
    ends = cliques.join(communities(cliques, k), "id").withColumn("src", F.explode("clique")).withColumn("dst", F.explode(F.filter("clique", lambda x: x > F.col("src"))))
    own = ends.select("component_id", F.concat(F.lit("c"), "cluster").alias("cluster"), "src", "dst").distinct()
    if merged:
        own = with_twins(stored(own, "ends"), same)
    out.append(own.withColumn("algorithm", F.lit(f"{k}clique")))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found.select("component_id", "cluster", "algorithm", "src", "dst")
