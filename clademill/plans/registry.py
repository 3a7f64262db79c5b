"""The registered queries of the engine, and SQL that gives their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clademill.plans import alignment_queries, file_queries, graph_queries, model_queries, table_queries

flagship = graph_queries.hit_components
PARTS = (graph_queries, table_queries, alignment_queries, model_queries, file_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for part in PARTS for k, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for part in PARTS for k, sql in part.SQL.items()}
