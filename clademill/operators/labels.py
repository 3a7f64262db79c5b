"""Labelled intervals of sequences: their validity and totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def violations(labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, start, stop, label and problem, one row for each rule that an interval breaks.

    A sequence's intervals begin at 0 (`start`), have columns (`empty`), follow each other without gap or overlap (`break`)
    and change their label (`repeat`).
    """
    order = Window.partitionBy(*keys).orderBy("start", "stop", "label")
    before, label = F.lag("stop").over(order), F.lag("label").over(order)
    found = {
        "start": before.isNull() & (F.col("start") != 0), "empty": F.col("stop") <= F.col("start"),
        "break": before.isNotNull() & (before != F.col("start")), "repeat": label == F.col("label"),
    }
    problems = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in found.items())), lambda x: x.isNotNull())
    return labels.withColumn("__problems", problems).select(*keys, "start", "stop", "label", F.explode("__problems").alias("problem"))


def totals(labels: DataFrame) -> DataFrame:
    """Columns and intervals of each label."""
    return labels.groupBy("label").agg(F.sum(F.col("stop") - F.col("start")).alias("columns"), F.count("*").alias("intervals"))
