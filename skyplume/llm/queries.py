"""The subpackage's queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skyplume.llm import binary_ids, embedding_dedup, exact_dedup, filter_audit, hard_negatives, mixing, packing, quality, secrets, sharding, simhash, substring_dedup, topk_search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": mixing.op1_mix,
    "op2_substring_dedup": substring_dedup.op2_substrings,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_simhash": simhash.op4_simhash,
    "op5_sharding": sharding.op5_shard,
    "op6_binary_ids": binary_ids.op6_binary_ids,
    "op7_secrets": secrets.op7_secrets,
    "op8_packing": packing.op8_packing,
    "op9_quality": quality.op9_quality,
    "op10_embedding_dedup": embedding_dedup.op10_embedding_dedup,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_topk_search": topk_search.op13_topk_search,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": mixing.OP1_SQL,
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op7_secrets": secrets.OP7_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
    "op13_topk_search": topk_search.OP13_SQL,
}
