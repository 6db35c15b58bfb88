"""What several operators share: reading tables, cutting lineage, walking Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import cut, discard, shared_dir, ship

__all__ = ["cut", "digest_int", "discard", "named", "scratch", "shared_dir", "store", "table", "text_chunks"]

#: Bytes of text that the vectorised kernels take at a time, so that a batch of long documents
#: never holds more than a few arrays of this length.
CHUNK_BYTES = 1 << 21
CHUNK_ROWS = 8192


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_scratch: ContextVar[str] = ContextVar("scratch", default="")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What store() writes within is deleted at the end; results that read it must be written by then."""
    folder = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    token = _scratch.set(folder)
    try:
        yield
    finally:
        _scratch.reset(token)
        discard(spark, folder)


def store(df: DataFrame) -> DataFrame:
    """As cut(), but as a Parquet table, for what is read again by column or is large."""
    path = f"{_scratch.get() or shared_dir(df.sparkSession)}/loomgraph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def named(name: str) -> Column:
    """The column of this very name, dots in it included."""
    return F.col("`" + name.replace("`", "``") + "`")


def digest_int(key: Column) -> Column:
    """A non-negative 60-bit integer from the MD5 of a string; the same in any SQL engine with md5()."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def text_chunks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about CHUNK_BYTES of text each (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        start = size = 0
        for i, k in enumerate(lengths.tolist()):
            if size and size + k > CHUNK_BYTES or i - start == CHUNK_ROWS:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += k
        yield batch.slice(start)
