"""Queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilframe.llm import chat, compression, cross_entropy, decontaminate, language, line_dedup, minhash, pieces, quality_rules, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_format": chat.op1_chat_format,
        "op2_compression_quality": compression.op2_compression_quality,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_language_id": language.op4_language_id,
        "op5_decontaminate": decontaminate.op5_decontaminate,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_pieces": pieces.op7_pieces,
        "op8_minhash": minhash.op8_minhash,
        "op9_cross_entropy": cross_entropy.op9_cross_entropy,
        "op10_quality_rules": quality_rules.op10_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": chat.ORACLE,
        "op3_line_dedup": line_dedup.ORACLE,
    }
