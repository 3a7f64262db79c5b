"""Intervals: union, merging, complement, runs. Closed intervals have both ends inside; half-open ones end before stop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _islands(df: DataFrame, keys: Sequence[str], start: str, stop: str, touching: int) -> DataFrame:
    """df with __island: intervals of one island overlap or are at most `touching` apart."""
    order = Window.partitionBy(*keys).orderBy(start, stop)
    reach = F.max(stop).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col(start) > reach + touching), 1).otherwise(0)
    return df.withColumn("__opens", opens).withColumn("__island", F.sum("__opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__opens")


def merged(df: DataFrame, keys: Sequence[str], start: str = "start", stop: str = "stop") -> DataFrame:
    """Half-open intervals, overlapping or touching ones made one."""
    return _islands(df, keys, start, stop, 0).groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(stop).alias(stop)).drop("__island")


def complement(df: DataFrame, keys: Sequence[str], start: str = "start", stop: str = "stop") -> DataFrame:
    """What lies between the merged intervals and before the first (from 0) and after the last (stop null)."""
    whole = merged(df, keys, start, stop)
    order = Window.partitionBy(*keys).orderBy(start)
    after = whole.select(*keys, F.col(stop).alias(start), F.lead(start).over(order).alias(stop))
    first = whole.groupBy(*keys).agg(F.min(start).alias(stop)).where(F.col(stop) > 0).select(*keys, F.lit(0).cast(dict(df.dtypes)[start]).alias(start), stop)
    return first.unionByName(after)


def coverage(df: DataFrame, keys: Sequence[str], start: str, stop: str, name: str = "covered") -> DataFrame:
    """Positions in the union of closed intervals, for each key."""
    one = _islands(df, keys, start, stop, 1).groupBy(*keys, "__island").agg((F.max(stop) - F.min(start) + 1).alias("n"))
    return one.groupBy(*keys).agg(F.sum("n").alias(name))


def union_length(intervals: Column, start: str = "start", stop: str = "stop") -> Column:
    """Positions in the union of an array of closed intervals, as one expression."""
    zero = F.struct(F.lit(None).cast("long").alias("reach"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, x: Column) -> Column:
        a, b = x[start].cast("long"), x[stop].cast("long")
        low = F.when(acc["reach"].isNull(), a).otherwise(F.greatest(a, acc["reach"] + 1))
        return F.struct(F.greatest(b, acc["reach"]).alias("reach"), (acc["n"] + F.greatest(b - low + 1, F.lit(0))).alias("n"))

    pairs = F.array_sort(F.transform(intervals, lambda x: F.struct(x[start].alias(start), x[stop].alias(stop))))
    return F.aggregate(pairs, zero, step, lambda acc: acc["n"])


def runs(df: DataFrame, keys: Sequence[str], pos: str, state: str) -> DataFrame:
    """Runs of equal state over consecutive positions: keys, state, start and stop (half-open)."""
    order = Window.partitionBy(*keys).orderBy(pos)
    new = (~F.col(state).eqNullSafe(F.lag(state).over(order))) | (F.col(pos) != F.lag(pos).over(order) + 1) | F.lag(pos).over(order).isNull()
    marked = df.withColumn("__new", F.when(new, 1).otherwise(0)).withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "__run", state).agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("stop")).drop("__run")
