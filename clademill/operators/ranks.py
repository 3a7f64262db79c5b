"""Ranks over a whole table without a single task: sorted ranges, and the sizes of the ranges before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clademill.storage import stored

POSITION = (1 << 33) - 1


def with_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """df with its row's place (from 0) in the given order; the order has to be total."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(sorted_.withColumn("__id", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumn("__part", F.shiftrightunsigned("__id", 33)).withColumn("__at", F.col("__id").bitwiseAND(POSITION))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))  # one row a range
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    return placed.join(F.broadcast(before), "__part").withColumn(name, F.col("__at") + F.col("__before")).drop("__id", "__part", "__at", "__before")


def hex_id(rank: str) -> Column:
    """Four or more upper-case hexadecimal digits."""
    digits = F.hex(F.col(rank).cast("long"))
    return F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)


def component_ids(members: DataFrame, node: str = "node", component: str = "component") -> DataFrame:
    """members with component_id: larger components first, ties by descending members.

    Components share no node, so the comparison of their sorted members ends at the least one.
    """
    sizes = members.groupBy(component).agg(F.count("*").alias("__size"), F.min(node).alias("__least"))
    ids = with_rank(sizes, F.col("__size").desc(), F.col("__least").desc()).withColumn("component_id", hex_id("rank"))
    return members.join(ids.select(component, "component_id"), component)
