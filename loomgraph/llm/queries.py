"""The registered queries of this subpackage: opN_<name> over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    op1_token_counts,
    op2_secret_scan,
    op3_sharding,
    op4_mixing,
    op5_simhash,
    op6_chat_format,
    op7_sentencepiece,
    op8_quality_rules,
    op9_exact_dedup,
    op10_quality_classifier,
)
from .common import table


def op1_token_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_token_counts.token_counts(table(spark, sf_dir, "documents"))


def op2_secret_scan_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_secret_scan.scan(table(spark, sf_dir, "documents"))


def op3_sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_sharding.place(table(spark, sf_dir, "documents").select("doc_id"))


def op4_mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_mixing.copies(table(spark, sf_dir, "documents"))


def op5_simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_simhash.near_copies(table(spark, sf_dir, "documents"))


def op6_chat_format_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_chat_format.format_chats(table(spark, sf_dir, "conversations"))


def op7_sentencepiece_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_sentencepiece.encode(table(spark, sf_dir, "documents"))


def op8_quality_rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_quality_rules.judge(table(spark, sf_dir, "documents"))


def op9_exact_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_exact_dedup.kept_documents(table(spark, sf_dir, "documents"))


def op10_quality_classifier_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts_query,
        "op2_secret_scan": op2_secret_scan_query,
        "op3_sharding": op3_sharding_query,
        "op4_mixing": op4_mixing_query,
        "op5_simhash": op5_simhash_query,
        "op6_chat_format": op6_chat_format_query,
        "op7_sentencepiece": op7_sentencepiece_query,
        "op8_quality_rules": op8_quality_rules_query,
        "op9_exact_dedup": op9_exact_dedup_query,
        "op10_quality_classifier": op10_quality_classifier_query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_sharding": op3_sharding.oracle(),
        "op6_chat_format": op6_chat_format.ORACLE,
        "op9_exact_dedup": op9_exact_dedup.ORACLE,
    }
