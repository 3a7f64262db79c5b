"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clademill.storage import shared_dir, stored

#: White space as the word and line rules know it: space and U+0009 to U+000D.
WS = " \t\n\x0b\x0c\r"

#: Rows of a join's key beyond which it is dealt over several tasks, and rows that each of these then gets, whatever the input.
HOT_ROWS = 2000

__all__ = ["WS", "arrow_batches", "hot_keys", "python", "read", "remainder", "runs", "shared_dir", "spread_join", "stored"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def remainder(col: str, n: int) -> Column:
    """crc32 of the id as text, mod n; null for a null id."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def arrow_batches(df: DataFrame) -> DataFrame:
    """df, with Arrow batches of a bounded number of bytes on their way to Python, however long the texts are."""
    if not df.sparkSession.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None):
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    return df


def python(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow with bounded batches."""
    return arrow_batches(df).mapInArrow(function, schema)


def hot_keys(counts: DataFrame, n: str, rows: int | None = None) -> DataFrame:
    """The keys with `rows` (HOT_ROWS) rows or more, and over how many parts they are dealt (__parts): a stored table of a key for each `rows` rows at most."""
    rows = rows or HOT_ROWS
    return stored(counts.where(F.col(n) >= rows).withColumn("__parts", F.ceil(F.col(n) / rows).cast("int")).drop(n), "hot")


def spread_join(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame, by: str, how: str = "inner") -> DataFrame:
    """left joined (inner or left) with right, which has a row for each key. Rows of hot keys are dealt by the hash of `by`, and their row of right goes to each part.

    hot comes by a join, which Spark broadcasts if the stored table is small, and else splits where a key has many rows of left.
    """
    few = hot.select(*on, "__parts")
    dealt = left.join(few, on, "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(by), F.col("__parts")), F.lit(0)).cast("int")).drop("__parts")
    copied = right.join(few, on, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return dealt.join(copied, [*on, "__part"], how).drop("__part")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, one after another, of batches that are sorted by key."""
    held, last = [], None
    for batch in batches:
        names = list(zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys)))
        at = 0
        for i, name in enumerate(names):
            if name != last:
                if i > at:
                    held.append(batch.slice(at, i - at))
                if held:
                    yield pa.Table.from_batches(held)
                held, last, at = [], name, i
        if at < len(names):
            held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)
