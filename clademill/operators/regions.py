"""Regions of alignments: weights of rows, well-occupied regions, scores of rows, counts in slices, stitching.

Tables are long (group, row, pos, sym), slices half-open (group, start, stop).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clademill.operators.intervals import merged, runs
from clademill.operators.msa import GAP, UNALIGNED, closed
from clademill.operators.stats import spread


def row_weights(rows: DataFrame, weights: DataFrame, group: str = "OGid", species: str = "spid") -> DataFrame:
    """rows (one for each group and row) with weight: the species' weight, shared evenly by the group's rows of it."""
    return rows.join(weights, species).withColumn("weight", F.col("weight") / F.count("*").over(Window.partitionBy(group, species)))


def occupancy(symbols: DataFrame, weight: Column, group: str = "OGid") -> DataFrame:
    """Summed weight of the residues in each column."""
    return symbols.groupBy(group, "pos").agg(F.sum(F.when(F.col("sym") != GAP, weight).otherwise(F.lit(0.0))).alias("occupancy"))


def regions(profile: DataFrame, good: Column, least: int, group: str = "OGid") -> DataFrame:
    """Slices of at least `least` columns that are good once small holes are closed."""
    own = closed(profile.withColumn("__good", good.cast("int")), "__good", [group])
    return runs(own, [group], "pos", "closed").where((F.col("closed") == 1) & (F.col("stop") - F.col("start") >= least)).select(group, "start", "stop")


def other_regions(profile: DataFrame, good: Column, least: int, group: str = "OGid") -> DataFrame:
    """What regions() leaves between the first and the last column: the slices to align again."""
    own = closed(profile.withColumn("__good", good.cast("int")), "__good", [group])
    rest = runs(own, [group], "pos", "closed").where((F.col("closed") == 0) | (F.col("stop") - F.col("start") < least))
    return merged(rest, [group]).select(group, "start", "stop")


def _inside(symbols: DataFrame, slices: DataFrame, group: str) -> DataFrame:
    """symbols with the start and stop of the slice that they are in: a join on group and column, of each slice's columns."""
    each = slices.where("start < stop").select(group, "start", "stop", F.explode(F.sequence("start", F.col("stop") - 1)).alias("pos"))
    return symbols.join(each, [group, "pos"])


def row_scores(symbols: DataFrame, slices: DataFrame, group: str = "OGid", row: str = "ppid", weight: str = "weight") -> DataFrame:
    """score of each row: summed logarithms of its symbols' weighted shares in the columns of the slices; 0 without any.

    Unaligned symbols count as gaps.
    """
    own = symbols.withColumn("sym", F.when(F.col("sym") == UNALIGNED, GAP).otherwise(F.col("sym")))
    columns = _inside(own, slices, group)
    shares = columns.groupBy(group, "pos", "sym").agg(F.sum(weight).alias("__w"))
    shares = shares.withColumn("__log", F.log(F.col("__w") / F.sum("__w").over(Window.partitionBy(group, "pos"))))
    sums = columns.select(group, row, "pos", "sym").join(shares.select(group, "pos", "sym", "__log"), [group, "pos", "sym"]).groupBy(group, row).agg(F.sum("__log").alias("score"))
    return symbols.select(group, row).distinct().join(sums, [group, row], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def deviations(scores: DataFrame, group: str = "OGid") -> DataFrame:
    """scores with x, the distance to the group's mean, and the group's population deviation (std) and iqr."""
    return scores.join(spread(scores, "score", [group]), group).withColumn("x", F.col("score") - F.col("mean"))


def outliers(scores: DataFrame, group: str = "OGid", a: float = 2e-3, b: float = -1.0) -> DataFrame:
    """Rows far below their group's mean, where the rest of the group lies together: x < 0 and iqr < a x^2 + b."""
    return deviations(scores, group).where((F.col("x") < 0) & (F.col("iqr") < a * F.col("x") * F.col("x") + b))


def slice_counts(symbols: DataFrame, slices: DataFrame, group: str = "OGid", row: str = "ppid") -> DataFrame:
    """For each slice and row: its residues (sym_count), and the residues of other rows beside them (align_count)."""
    columns = _inside(symbols, slices, group).withColumn("__on", (~F.col("sym").isin(GAP, UNALIGNED)).cast("long"))
    columns = columns.withColumn("__all", F.sum("__on").over(Window.partitionBy(group, "start", "stop", "pos")))
    return columns.groupBy(group, "start", "stop", row).agg(F.sum("__on").alias("sym_count"), F.sum(F.col("__on") * (F.col("__all") - 1)).alias("align_count"))


def trim_ratios(trims: DataFrame) -> DataFrame:
    """Length of a trim, its share of the columns, and its mean posteriors where they are given."""
    length = F.col("stop") - F.col("start")
    norms = {f"norm{k}": F.col(f"posterior{k}") / length for k in (2, 3) if f"posterior{k}" in trims.columns}
    return trims.withColumns({"length": length, "length_ratio": length / F.col("colnum"), **norms})


def contrast_norms(totals: DataFrame) -> DataFrame:
    """Total of contrasts by gene, and by gene and mean length (null where there is none)."""
    return totals.withColumns({"norm1": F.try_divide("total", "gnidnum"), "norm2": F.try_divide("total", F.col("gnidnum") * F.col("len2"))})


def binary(symbols: DataFrame) -> DataFrame:
    """Gaps as 0, residues as 1."""
    return symbols.withColumn("sym", F.when(F.col("sym").isin(GAP, UNALIGNED), "0").otherwise("1"))


def binary_flags(symbols: DataFrame, group: str = "OGid") -> DataFrame:
    """Pools of the columns of a binary alignment: `all`, and `NI` for columns with a 0."""
    zero = symbols.groupBy(group, "pos").agg(F.bool_or(F.col("sym") == "0").alias("__zero"))
    return zero.select(group, "pos", F.when(F.col("__zero"), F.array(F.lit("all"), F.lit("NI"))).otherwise(F.array(F.lit("all"))).alias("pools"))


def stitched(rows: DataFrame, again: DataFrame, group: str = "OGid", row: str = "ppid") -> DataFrame:
    """rows (group, row, seq) with the slices that were aligned again put in place of what they were.

    again: group, row, start, stop, seq; all rows of a slice have one length, and the slices of a group don't overlap. A row
    without residues in a slice isn't in it and gets gaps. Columns outside the slices stay.
    """
    widths = again.groupBy(group, "start", "stop").agg(F.max(F.length("seq")).alias("__width"))
    new = rows.select(group, row).join(widths, group).join(again.select(group, row, "start", F.col("seq").alias("__new")), [group, row, "start"], "left")
    new = new.withColumn("__new", F.coalesce("__new", F.expr(f"repeat('{GAP}', __width)")))
    parts = new.groupBy(group, row).agg(F.array_sort(F.collect_list(F.struct("start", "stop", F.col("__new").alias("seq")))).alias("__parts"))
    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))

    def step(acc: Column, x: Column) -> Column:
        before = F.substring("seq", acc["at"] + 1, x["start"].cast("int") - acc["at"])
        return F.struct(x["stop"].cast("int").alias("at"), F.concat(acc["text"], before, x["seq"]).alias("text"))

    whole = F.aggregate("__parts", empty, step, lambda acc: F.concat(acc["text"], F.substring("seq", acc["at"] + 1, F.length("seq"))))
    return rows.join(parts, [group, row], "left").withColumn("seq", F.coalesce(whole, "seq")).drop("__parts")


def in_tip_order(rows: DataFrame, tips: Sequence[str], species: str = "spid") -> DataFrame:
    """rows with tip_rank, the place of their species among the tips of a tree (null if it isn't there)."""
    names = F.array(*(F.lit(t) for t in tips))
    place = F.array_position(names, F.col(species).cast("string"))
    return rows.withColumn("tip_rank", F.when(place > 0, place - 1).cast("int"))
