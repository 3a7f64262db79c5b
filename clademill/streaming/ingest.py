"""Incremental ingest: new files of hits join a table as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def ingest_hits(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str) -> StreamingQuery:
    """Append what new Parquet files hold to a table split by genome pair, each file once, then stop."""

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("append").partitionBy("qspid", "sspid").parquet(target)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
