"""The corpus pipeline: documents through five of the training-data operators in turn.

Each stage takes what the one before wrote, and all but the last return the columns of documents. On
rows with nulls, ties, repeats and so on each stage does what its operator says (see the modules).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import op4_mixing, op5_simhash, op7_sentencepiece, op8_quality_rules, op9_exact_dedup
from loomgraph.llm.common import discard, scratch, shared_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat themselves too much go.

    Null, empty and blank texts stay. Rows are judged one by one, repeats and null doc_ids too; a
    value at a limit stays. All columns go along; an empty table stays empty.
    """
    return op8_quality_rules.keep_documents(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays, that of the least doc_id.

    Null texts are copies of nothing and stay; empty ones are copies of each other. A null doc_id
    loses to any other; rows that tie on both are decided by their other columns, which go along.
    """
    return op9_exact_dedup.exact_dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays, that of the least doc_id.

    Null texts, texts without words and rows without doc_id stay. Of rows that share a doc_id only
    the near copies go. All columns go along; an empty table stays empty.
    """
    return op5_simhash.drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the flattened weights of the sources ask; once at least.

    A null source is a source. Texts without tokens, null or empty, stay once. Repeated rows get the
    same copies each. All columns go along; an empty table stays empty.
    """
    return op4_mixing.mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, lossless) for each copy of each document.

    A null text has null ids, an empty one none. Null and repeated doc_ids are passed on as they are.
    """
    return op7_sentencepiece.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: Suffix arrays, fingerprints, Newton's method and the tokenizer have no SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; between stages a Parquet table in the shared folder.

    What a stage has read, and what it wrote for itself, is deleted once its own table is written. The
    table that the last stage reads stays, as the result is not computed yet.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            discard(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
