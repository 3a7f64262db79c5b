"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, huffman, language, line_dedup, near_dups, packing, pair_bpe, pii, quality, rules, transport, valid_time, vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        packing.op1_best_fit_packing, byte_bpe.op2_byte_bpe, line_dedup.op3_line_dedup, language.op4_language_id, transport.op5_media_transport,
        rules.op6_quality_rules, near_dups.op7_minhash_near_dups, pii.op8_pii, quality.op9_quality_classifier, huffman.op10_token_files,
        valid_time.op11_valid_time_sales, pair_bpe.op12_pair_tree_bpe, vector_codes.op13_vector_codes,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": line_dedup.OP3_SQL, "op11_valid_time_sales": valid_time.OP11_SQL, "op13_vector_codes": vector_codes.OP13_SQL}
