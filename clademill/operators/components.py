"""Connected components of an edge table, by alternating large and small stars.

Every round halves the length of long paths, so chains need a logarithmic number of rounds. Each round's edges are
written to the shared folder: lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from clademill.storage import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the least of these. edges: u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()


def _written(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The edges as stored, with their number and the sum of their hashes, which the write observes."""
    seen = Observation()
    return stored(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "edges"), seen.get


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node and component (the least node that it reaches) of every node that occurs in an edge.

    Nodes may be of any ordered type. Self-loops keep a node as its own component; null ends are ignored.
    """
    ends = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    loops = ends.where("u = v").select("u").distinct()
    now, mark = _written(ends.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while mark["n"] and mark != before:
        before = mark
        now, mark = _written(_small_star(_large_star(now)))
    roots = now.select(F.col("v").alias("u")).distinct()
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("u", "u"))
    return out.union(loops.join(out.select(F.col("node").alias("u")), "u", "left_anti").select("u", "u"))
