"""The engine's tables as views of the supplied ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clademill.operators.products import top_products


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hsps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as local alignments: users are queries, event types subjects, minutes positions, values scores."""
    e = table(spark, sf_dir, "events").where("user_id is not null and value is not null")
    start = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000).cast("long")
    return e.select("event_id", F.col("user_id").alias("qppid"), F.col("event_type").alias("sppid"), start.alias("start"), (start + F.ceil("value").cast("long")).alias("stop"), F.col("value").alias("bitscore"))


HSPS_SQL = """hsps AS (SELECT event_id, user_id AS qppid, event_type AS sppid, (epoch_us(ts) // 60000000)::BIGINT AS start,
  (epoch_us(ts) // 60000000)::BIGINT + ceil(value)::BIGINT AS stop, value AS bitscore FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as whole numbers, so that products are exact."""
    v = table(spark, sf_dir, "embeddings").where("vec_id is not null and label is not null and embedding is not null")
    return v.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("int").alias("label"), F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("int")).alias("e"))


def top_hits(spark: SparkSession, sf_dir: str, k: int = 1) -> DataFrame:
    """src, dst, dst_label, score: for each vector and each other label, the k highest scores with all ties."""
    return top_products(vectors(spark, sf_dir), k)


SCORES_SQL = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: round(x::DOUBLE * 1000)::BIGINT) AS e FROM embeddings),
scores AS (SELECT a.vec_id AS src, b.vec_id AS dst, b.label AS dst_label, list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2]))::BIGINT AS score FROM v a JOIN v b ON a.label <> b.label),
ranked AS (SELECT *, rank() OVER (PARTITION BY src, dst_label ORDER BY score DESC) AS r FROM scores)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as members of groups: an order is a group, parts are genes, suppliers are species."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("OGid"), F.col("l_partkey").alias("gnid"), F.col("l_suppkey").alias("spid"), F.col("l_linenumber").alias("ppid"), F.col("l_extendedprice").cast("decimal(18,2)").alias("bitscore"), F.col("l_quantity").alias("length"))


LINES_SQL = "lines AS (SELECT l_orderkey AS OGid, l_partkey AS gnid, l_suppkey AS spid, l_linenumber AS ppid, l_extendedprice::DECIMAL(18,2) AS bitscore, l_quantity AS length FROM lineitem)"


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as column profiles: a supplier's lines by date are positions, a returned line is a gap."""
    li = table(spark, sf_dir, "lineitem")
    pos = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")) - 1
    return li.select(F.col("l_suppkey").alias("OGid"), pos.alias("pos"), (F.col("l_returnflag") == "R").cast("int").alias("gap"), F.col("l_quantity").cast("long").alias("x"))


PROFILE_SQL = "profile AS (SELECT l_suppkey AS OGid, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1)::INT AS pos, (l_returnflag = 'R')::INT AS gap, l_quantity::BIGINT AS x FROM lineitem)"


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as alignments: suppliers are groups, line numbers rows, dates positions; a returned line is a gap, else its status and flag choose the symbol."""
    li = table(spark, sf_dir, "lineitem")
    pos = F.row_number().over(Window.partitionBy("l_suppkey", "l_linenumber").orderBy("l_shipdate", "l_orderkey")) - 1
    sym = F.when(F.col("l_returnflag") == "R", "-").when(F.col("l_linestatus") == "F", "X").otherwise(F.substring("l_returnflag", 1, 1))
    return li.select(F.col("l_suppkey").alias("OGid"), F.col("l_linenumber").alias("ppid"), F.pmod(F.col("l_linenumber"), F.lit(3)).alias("gnid"), pos.alias("pos"), sym.alias("sym"))


SYMBOLS_SQL = """symbols AS (SELECT l_suppkey AS OGid, l_linenumber AS ppid, (l_linenumber % 3)::INT AS gnid,
  (row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_shipdate, l_orderkey) - 1)::INT AS pos,
  CASE WHEN l_returnflag = 'R' THEN '-' WHEN l_linestatus = 'F' THEN 'X' ELSE l_returnflag END AS sym FROM lineitem)"""
