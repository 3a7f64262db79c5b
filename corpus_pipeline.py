"""A training corpus from documents: quality rules, line dedup, near-dedup, redaction, packing.

Each stage takes the documents that its predecessor kept and returns documents with the same columns; the last one
returns the pieces that fill training sequences. Stages are written as Parquet to the shared folder in between.

Null and empty texts have too few words for the quality rules and go there. Documents that line dedup empties have no word
left, so they are near none and stay, copies of one another included, as one end id each. Of rows with one id and one text
one stays, that with the least hash of its columns; rows with one id and different texts are documents of their own. Ties:
the least doc_id of a class stays, a null id counting last. An empty table, or one from which the rules take all, gives an
empty result. Columns beyond those of documents stay as they are until packing, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clademill.llm import common, line_dedup, near_dups, packing, pii, rules


def with_text(docs: DataFrame, like: DataFrame) -> DataFrame:
    """docs with the columns of like, and n_chars of the text that they now have."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(dict(like.dtypes)["n_chars"]))
    return docs.select(*like.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.kept_documents(docs, rules.fit(docs, common.read(spark, sf_dir, "labels")))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_text(line_dedup.drop_lines(docs, counts=False), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.one_of_each(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_text(pii.redacted(docs, pii.fit(spark)), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digest(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", drop_shared_lines),
    ("near_dedup", drop_near_duplicates),
    ("pii", redact),
    ("packing", pack),
]

#: SQL can express neither the forest nor the signatures nor the packing; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
