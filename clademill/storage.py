"""Tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="clademill-")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset and Spark runs in one process (tests), below a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _local_dir()
    return f"{base.rstrip('/')}/clademill/{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: it cuts the lineage and fixes what was computed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
