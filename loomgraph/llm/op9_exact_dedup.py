"""Exact dedup by skew-safe combining.

Copies are combined three times, on the digest and the full content each time: within a scan
partition before anything moves, then within salted digest groups, then among the winners of all
salts. A salt is that of the scan partition, so a text with any number of copies sends one row for
each partition to one of SALTS tasks, and SALTS rows to the last. Of equal texts the document with
the least doc_id stays.

Cases: texts are equal if all their bytes are; of texts that only share a digest each stays. Empty
texts are copies of each other; a null text is no copy of anything, so its document stays. A
document without doc_id loses to any with one. Of repeated rows one stays, and of rows that differ
elsewhere but tie on text and doc_id the least in the order of the remaining columns; columns without
an order of their own (maps, variants) are ordered as their strings. An empty table gives an empty
result. Further columns go along unchanged, whatever their names and types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import named

SALTS = 16


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType, T.CalendarIntervalType))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of df that stay, with its columns."""
    others = [f for f in df.schema.fields if f.name not in (id_col, text_col)]
    odd = [f.name for f in others if not _orderable(f.dataType)]
    own = lambda f: named(f.name).cast("string") if f.name in odd else named(f.name)
    order = F.struct(named(id_col).isNull().alias("a"), named(id_col).alias("b"), *[own(f).alias(f"c{i}") for i, f in enumerate(others)])
    rows = df.where(named(text_col).isNotNull()).select(named(text_col).alias("t"), F.xxhash64(named(text_col)).alias("h"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("s"), order.alias("w"), *([F.struct(*map(named, odd)).alias("m")] if odd else []))
    if not others:  # a long alone is combined in a hash table
        rows = rows.withColumn("w", F.col("w.b"))
    least = [*([F.min_by("m", "w").alias("m")] if odd else []), F.min("w").alias("w")]  # what has no order follows the rest
    salted = rows.groupBy("h", "s", "t").agg(*least)
    best = salted.groupBy("h", "t").agg(*least)
    value = {id_col: F.col("w.b") if others else F.col("w"), text_col: F.col("t")}
    value |= {f.name: F.col("m").getField(f.name) if f.name in odd else F.col(f"w.c{i}") for i, f in enumerate(others)}
    kept = best.select(*[value[c].alias(c) for c in df.columns])
    return kept.unionAll(df.where(named(text_col).isNull()))


def kept_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """(doc_id, digest) of the documents that stay; digest is the MD5 of the text."""
    kept = exact_dedup(df.select(named(id_col), named(text_col)), id_col, text_col, salts)
    return kept.select(named(id_col), F.md5(named(text_col)).alias("digest"))


ORACLE = """
SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents WHERE text IS NOT NULL GROUP BY text
UNION ALL
SELECT doc_id, NULL AS digest FROM documents WHERE text IS NULL"""
