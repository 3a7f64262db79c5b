"""Graphs: triangles and their clusters, cluster ids, overlap graphs, paralogs, lineages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clademill.operators.components import components
from clademill.operators.ranks import hex_id, with_rank
from clademill.storage import stored


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct edges with src < dst; loops go."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """node and degree of an undirected edge table."""
    both = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    return both.groupBy("node").agg(F.count("*").alias("degree"))


def triangles(edges: DataFrame) -> DataFrame:
    """a < b < c of every triangle.

    Edges point from the node of lower degree to the other, so that a hub has few outgoing edges to pair.
    """
    own = undirected(edges)
    d = degrees(own)
    ranked = own.join(d.withColumnsRenamed({"node": "src", "degree": "__a"}), "src").join(d.withColumnsRenamed({"node": "dst", "degree": "__b"}), "dst")
    up = (F.col("__a") < F.col("__b")) | (F.col("__a") == F.col("__b")) & (F.col("src") < F.col("dst"))
    out = ranked.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("v"))
    wedges = out.join(out.select("u", F.col("v").alias("w")), "u").where("v < w")
    closed = wedges.join(own.select(F.col("src").alias("v"), F.col("dst").alias("w")), ["v", "w"], "left_semi")
    corners = F.array_sort(F.array("u", "v", "w"))
    return closed.select(corners[0].alias("a"), corners[1].alias("b"), corners[2].alias("c"))


def triangle_clusters(edges: DataFrame) -> DataFrame:
    """cluster, src, dst: edges that chains of triangles with common edges connect; other edges are in no cluster.

    A cluster is named by its least edge. Edges are nodes of a second graph, which has two links for each triangle.
    """
    def name(x: str, y: str):
        return F.struct(F.col(x).alias("src"), F.col(y).alias("dst"))

    t = triangles(edges)
    links = t.select(name("a", "b").alias("src"), name("a", "c").alias("dst")).union(t.select(name("a", "b"), name("b", "c")))
    found = components(links)
    return found.select(F.col("component").alias("cluster"), "node.src", "node.dst")


def cluster_ids(clusters: DataFrame, keys: tuple[str, ...] = ("component_id", "cluster")) -> DataFrame:
    """clusters with OGid: more edges first, ties by the descending sorted list of their edges' ends.

    A list is kept as its nodes and how often each occurs, and only of clusters that another one equals in size.
    """
    sizes = stored(clusters.groupBy(*keys).agg(F.count("*").alias("__n")), "sizes")
    tied = sizes.groupBy("__n").agg(F.count("*").alias("__same")).where("__same > 1").select("__n")
    again = clusters.join(sizes.join(tied, "__n", "left_semi").select(*keys), list(keys), "left_semi")
    # of two lists that differ first in how often a node occurs, the one with fewer goes on with a larger node
    nodes = again.select(*keys, F.explode(F.array("src", "dst")).alias("__node")).groupBy(*keys, "__node").agg((-F.count("*")).alias("__minus"))
    ends = nodes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__node", "__minus"))).alias("__ends"))
    order = sizes.join(ends, list(keys), "left")
    ids = with_rank(order, F.col("__n").desc(), F.col("__ends").desc(), *(F.col(k) for k in keys)).withColumn("OGid", hex_id("rank"))
    return clusters.join(ids.select(*keys, "OGid"), list(keys))


def with_paralogs(edges: DataFrame, paralogs: DataFrame) -> DataFrame:
    """Each edge between all paralogs of one end (with itself) and all of the other. paralogs: node, paralog; repeats stay."""
    own = paralogs.groupBy("node").agg(F.collect_set("paralog").alias("__more"))
    out = edges
    for end in ("src", "dst"):
        out = out.join(own.withColumnRenamed("node", end), end, "left")
        out = out.withColumn(f"__{end}", F.concat(F.array(end), F.coalesce("__more", F.array().cast(own.schema["__more"].dataType)))).drop("__more")
    return out.withColumn("src", F.explode("__src")).withColumn("dst", F.explode("__dst")).drop("__src", "__dst").select(*edges.columns)


def inparalogs(hits: DataFrame, best: DataFrame, cover: float = 0.5) -> DataFrame:
    """Reciprocal in-paralogs. hits: within genomes (qppid, sppid, sgnid, qgnid, bitscore, cnqa, qlen); best: qppid, best.

    Of each query and gene the highest-scoring hits stay if they beat the query's best hit in another genome.
    """
    own = hits.where("qgnid <> sgnid").join(best, "qppid", "left")
    top = F.max("bitscore").over(Window.partitionBy("qppid", "sgnid"))
    kept = own.withColumn("__top", top).where("bitscore = __top and bitscore > coalesce(best, 0)").where(F.col("cnqa") / F.col("qlen") >= cover)
    pairs = kept.select(F.col("qppid").alias("node"), F.col("sppid").alias("paralog")).distinct()
    return pairs.join(pairs.select(F.col("paralog").alias("node"), F.col("node").alias("paralog")), ["node", "paralog"], "left_semi")


#: Sets of at most this many items go with each of their rows; pairs of larger ones are counted by joins.
INLINE = 64


def _ranked_sets(sets: DataFrame, group: str, item: str, least: float) -> DataFrame:
    """g, i, n (items of the group) and place (of the item among the group's, rarest first), stored."""
    if least <= 0:
        raise ValueError("least has to be above 0")
    own = sets.select(F.col(group).alias("g"), F.col(item).alias("i")).where("g is not null and i is not null").distinct()
    often = own.groupBy("i").agg(F.count("*").alias("often"))
    place = F.row_number().over(Window.partitionBy("g").orderBy("often", "i"))
    return stored(own.join(often.hint("merge"), "i").withColumns({"n": F.count("*").over(Window.partitionBy("g")), "place": place}).select("g", "i", "n", "place"), "sets")


def _overlaps(all_: DataFrame, least: float, without: DataFrame | None = None, inline: int = INLINE) -> DataFrame:
    """src < dst of groups with a share `least` of the smaller one's items in common; not those that are met by no item but `without`.

    Where both sets are small they are compared where they meet, at the first item that they have in common, so that no
    candidate is shuffled.
    """
    def rarest(rows: DataFrame) -> DataFrame:
        own = rows.where(F.col("place") <= F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1)
        return own if without is None else own.join(without.hint("merge"), "i", "left_anti")

    lists = all_.where(F.col("n") <= inline).groupBy("g", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "i"))), lambda x: x["i"]).alias("items"))
    small = lists.select("g", "n", "items", F.posexplode("items").alias("place", "i")).withColumn("place", F.col("place") + 1)
    met = rarest(small).select("g", "n", "i", "items").join(small.select(F.col("g").alias("h"), F.col("n").alias("m"), "i", F.col("items").alias("theirs")).hint("merge"), "i")
    both = F.array_intersect("items", "theirs")  # in the order of the first
    near = met.where("n < m or n = m and g < h").where((F.size(both) >= least * F.col("n")) & (both[0] == F.col("i"))).select("g", "h")
    large = all_.where(F.col("n") > inline).select(F.col("g").alias("h"), "i", F.col("n").alias("m"))
    pairs = rarest(all_).select("g", "i", "n").join(large.hint("merge"), "i").where("n < m or n = m and g < h").select("g", "h", "n").distinct()
    common = pairs.join(all_.select("g", "i").hint("merge"), "g").join(large.select("h", "i").hint("merge"), ["h", "i"], "left_semi").groupBy("g", "h", "n").agg(F.count("*").alias("common"))
    found = near.union(common.where(F.col("common") >= least * F.col("n")).select("g", "h"))
    return found.select(F.least("g", "h").alias("src"), F.greatest("g", "h").alias("dst"))


def overlap_graph(sets: DataFrame, group: str, item: str, least: float = 0.5) -> DataFrame:
    """src < dst of groups that have at least a share `least` (above 0) of the smaller one's items in common.

    A group of n items that has c = ceil(least * n) of them in common with another has one of any n - c + 1 in common:
    its rarest ones are looked up, so that an item that most groups have makes pairs only of groups with little else. Null groups and items don't count.
    """
    return _overlaps(_ranked_sets(sets, group, item, least), least)


def overlap_links(sets: DataFrame, group: str, item: str, least: float = 0.5) -> DataFrame:
    """Edges of overlap_graph that connect what all of them connect.

    A group for which a single common item is enough is linked to whatever has its item: one such group stands for all groups
    of the item, which makes no pairs. Other groups are compared only where they meet by items without such a group.
    """
    all_ = _ranked_sets(sets, group, item, least)
    hubs = stored(all_.where(least * F.col("n") <= 1).groupBy("i").agg(F.min("g").alias("hub")), "hubs")
    star = all_.select("g", "i").join(hubs.hint("merge"), "i").where("g <> hub")
    return star.select(F.least("g", "hub").alias("src"), F.greatest("g", "hub").alias("dst")).union(_overlaps(all_, least, hubs.select("i"))).distinct()


def groups_with_singletons(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """node and component, nodes without an edge being components of their own."""
    return nodes.select(node).distinct().join(components(edges).withColumnRenamed("node", node), node, "left").withColumn("component", F.coalesce("component", node))


def lineage(children: DataFrame, parents: DataFrame) -> DataFrame:
    """child, parent and heir: the first parent with all of a child's nodes, and whether the child is its largest.

    Both: cluster, node.
    """
    size = children.groupBy("cluster").agg(F.countDistinct("node").alias("n"))
    both = children.distinct().join(parents.distinct().withColumnRenamed("cluster", "parent"), "node").groupBy("cluster", "parent").agg(F.count("*").alias("common"))
    inside = both.join(size, "cluster").where("common = n").groupBy("cluster", "n").agg(F.min("parent").alias("parent"))
    first = F.row_number().over(Window.partitionBy("parent").orderBy(F.col("n").desc(), "cluster"))
    return inside.select(F.col("cluster").alias("child"), "parent", (first == 1).alias("heir"))


def edge_weights(edges: DataFrame, score: str = "bitscore") -> DataFrame:
    """src < dst and the summed score of both directions."""
    ends = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), score)
    return ends.groupBy("src", "dst").agg(F.sum(score).alias("weight"))
