"""Trims of alignments as window steps over tables of columns and slices: no alignment becomes one task's array.

Columns are rows (keys, pos from 0, none missing); slices are half-open. The states that a slice's ends look for, the last
column that stops a margin on the left and the first one on the right, are carried along the order of the columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clademill.operators import intervals
from clademill.operators.msa import GAP, UNALIGNED, gradient

CORE, EDGE, SLOPE = 0.75, 1e-3, 1e-3


def _stopped(keys: Sequence[str], ok: Column, before: bool) -> Column:
    """The nearest column before (or after) that is not ok."""
    order = Window.partitionBy(*keys).orderBy(F.col("pos") if before else F.col("pos").desc())
    return F.last(F.when(~ok, F.col("pos")), True).over(order.rowsBetween(Window.unboundedPreceding, -1))


def _cores(columns: DataFrame, keys: Sequence[str], p: str, core: float, edge: float, slope: float) -> DataFrame:
    """start and stop of each run above `core`, and how far its margins reach: low and high outward, inner and outer inward."""
    up, down, above = F.col("gradient") >= slope, F.col("gradient") <= -slope, F.col(p) >= edge
    whole, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("pos")
    last = F.max("pos").over(whole)
    marked = gradient(columns, p, keys).select(
        *keys, "pos", (F.col(p) >= core).alias("core"),
        (F.coalesce(_stopped(keys, above | up, True), F.lit(-1)) + 1).alias("low"), (F.coalesce(_stopped(keys, above | down, False), last + 1) - 1).alias("high"),
        (F.coalesce(_stopped(keys, up, False), last + 1) - 1).alias("inner"), (F.coalesce(_stopped(keys, down, True), F.lit(-1)) + 1).alias("outer"),
    )
    opens = F.col("core") & ~F.coalesce(F.lag("core").over(order), F.lit(False))
    runs = marked.withColumn("run", F.sum(opens.cast("int")).over(order)).where("core").groupBy(*keys, "run")
    return runs.agg(
        F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop"), F.min_by("low", "pos").alias("low"), F.min_by("inner", "pos").alias("inner"), F.max_by("high", "pos").alias("high"), F.max_by("outer", "pos").alias("outer"),
    )


def hull_slices(columns: DataFrame, keys: Sequence[str], p: str, core: float = CORE, edge: float = EDGE, slope: float = SLOPE) -> DataFrame:
    """Runs of p above `core`, grown while p is above `edge` or rises towards them; those that touch made one."""
    grown = _cores(columns, keys, p, core, edge, slope).select(*keys, F.col("low").alias("start"), (F.col("high") + 1).alias("stop"))
    return intervals.merged(grown, keys)


def trim_slices(columns: DataFrame, keys: Sequence[str], p: str, profile: str, core: float = CORE, edge: float = EDGE, slope: float = SLOPE) -> DataFrame:
    """Slices of runs of p above `core`, each end where p and the profile change most within its margin.

    A margin extends outward as in hull_slices(), and inward while p still rises; its outermost column on the left and innermost
    on the right are no candidates, and outer columns win ties. An end without a margin (on the right: one that goes beyond the
    column after the core) stays, and so do both where they would cross.
    """
    order = Window.partitionBy(*keys).orderBy("pos")
    step = F.coalesce(F.col(profile) - F.lag(profile).over(order), F.lit(0.0))
    change = gradient(columns.withColumn("step", step), p, keys).select(*keys, "pos", F.abs(F.col("gradient") * F.col("step")).alias("change"))
    runs = _cores(columns, keys, p, core, edge, slope)
    none = F.array().cast("array<int>")
    left = F.when(F.col("low") < F.col("inner"), F.sequence(F.col("low") + 1, F.col("inner"))).otherwise(none)
    right = F.when(F.col("high") > F.col("stop"), F.sequence(F.col("outer") + 1, F.col("high"))).otherwise(none)
    sides = F.concat(F.transform(left, lambda x: F.struct(x.alias("pos"), F.lit(True).alias("left"))), F.transform(right, lambda x: F.struct(x.alias("pos"), F.lit(False).alias("left"))))
    asked = runs.select(*keys, "run", F.inline(sides)).join(change, [*keys, "pos"])
    best = asked.groupBy(*keys, "run").agg(
        F.max_by(F.when(F.col("left"), F.col("pos")), F.when(F.col("left"), F.struct("change", -F.col("pos")))).alias("from"),
        F.max_by(F.when(~F.col("left"), F.col("pos")), F.when(~F.col("left"), F.struct("change", "pos"))).alias("to"),
    )
    ends = runs.join(best, [*keys, "run"], "left").withColumns({"from": F.coalesce("from", "start"), "to": F.coalesce("to", "stop")})
    fits = F.col("from") < F.col("to")
    return intervals.merged(ends.select(*keys, F.when(fits, F.col("from")).otherwise(F.col("start")).alias("start"), F.when(fits, F.col("to")).otherwise(F.col("stop")).alias("stop")), keys)


def within(slices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """pos of every column in slices that don't overlap."""
    return slices.select(*keys, "start", "stop", F.explode(F.sequence(F.col("start").cast("int"), F.col("stop").cast("int") - 1)).alias("pos"))


def region_slices(columns: DataFrame, keys: Sequence[str], p2: str, p3: str, profile: str, core3: float = CORE, core: float = 0.9, edge: float = EDGE, slope: float = SLOPE) -> DataFrame:
    """Slices that the second and third state take together, outside the hulls of the third one."""
    hulls = within(hull_slices(columns, keys, p3, core3, edge, slope), keys).select(*keys, "pos", F.lit(True).alias("__in"))
    both = columns.join(hulls, [*keys, "pos"], "left").withColumn("__both", F.when(F.col("__in"), F.lit(0.0)).otherwise(F.col(p3)) + F.col(p2))
    return trim_slices(both, keys, "__both", profile, core, edge, slope)


def masked(symbols: DataFrame, slices: DataFrame, keys: Sequence[str], row: str, weight: str, drop: int = 5, least: float = 2.0, alpha: float = 0.01) -> DataFrame:
    """keys, row, start and stop of the slices in which a row has more residues than the others would suggest.

    The limit is the count that a geometric variable exceeds with probability alpha; its mean is the weighted mean of all but the
    `drop` largest counts of the slice, `least` at least. Rows that tie are ordered by their name.
    """
    own = symbols.join(within(slices, keys), [*keys, "pos"])
    counts = own.groupBy(*keys, "start", "stop", row).agg(F.count_if(~F.col("sym").isin(GAP, UNALIGNED)).alias("n"), F.first(weight).alias("w"))
    each = Window.partitionBy(*keys, "start", "stop")
    placed = counts.withColumn("place", F.row_number().over(each.orderBy("n", row))).withColumn("rest", F.col("place") <= F.count("*").over(each) - drop)
    mean = F.try_divide(F.sum(F.when(F.col("rest"), F.col("n") * F.col("w"))).over(each), F.sum(F.when(F.col("rest"), F.col("w"))).over(each))
    limited = placed.withColumn("mean", F.greatest(F.lit(least), F.coalesce(mean, F.lit(least))))
    limit = F.log(F.lit(alpha)) / F.log(1 - 1 / (F.col("mean") + 1)) - 1
    return limited.where(F.col("n") >= limit).select(*keys, row, "start", "stop")


def left_over(symbols: DataFrame, unaligned: DataFrame, regions: DataFrame, keys: Sequence[str], row: str) -> DataFrame:
    """keys, columns and residues that stay when residues in `unaligned` slices of their rows are none, and the regions' columns go."""
    residues = symbols.where(~F.col("sym").isin(GAP, UNALIGNED))
    hidden = within(unaligned, [*keys, row]).select(*keys, row, "pos")
    gone = within(regions, keys).select(*keys, "pos")
    stay = residues.join(hidden, [*keys, row, "pos"], "left_anti").join(gone, [*keys, "pos"], "left_anti")
    by_column = stay.groupBy(*keys, "pos").agg(F.count("*").alias("n"))
    return by_column.groupBy(*keys).agg(F.count("*").alias("columns"), F.sum("n").alias("residues"))
