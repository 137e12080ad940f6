"""The queries of the corpus operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import exact, mixing, near, pieces, pii, quality, scoring, secrets, substrings, topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": quality.op1,
        "op2_sentencepiece": pieces.op2,
        "op3_source_mixing": mixing.op3,
        "op4_substring_dedup": substrings.op4,
        "op5_lm_scoring": scoring.op5,
        "op6_pii": pii.op6,
        "op7_secret_scan": secrets.op7,
        "op8_near_dedup": near.op8,
        "op9_exact_topk": topk.op9,
        "op10_exact_dedup": exact.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_source_mixing": mixing.OP3_SQL,
        "op9_exact_topk": topk.OP9_SQL,
        "op10_exact_dedup": exact.OP10_SQL,
    }
