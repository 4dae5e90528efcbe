"""Shared folder, stored tables, and batches of texts for the operators of this subpackage."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

CHECKPOINT = "spark.checkpoint.dir"
TEXT_BYTES = 1 << 23
"""Bytes of text that a task holds at once, apart from a single longer text."""
ROWS_AT_ONCE = 256
"""Rows of an Arrow batch whose texts become Python strings together."""


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    A temporary folder serves only a one-machine session that names none, as in tests.
    """
    named = spark.conf.get(CHECKPOINT, None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"{CHECKPOINT} must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="credalis-shared-")
        spark.conf.set(CHECKPOINT, named)
    return named.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def trim() -> None:
    """Give freed memory back to the system: workers serve many tasks, and what one held would stay beside the next."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if release:
        release(0)


def column_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each string; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def row_chunks(batches: Iterator[pa.RecordBatch], limit: int = TEXT_BYTES) -> Iterator[tuple[int, pa.RecordBatch, list[bytes]]]:
    """(chunk number, rows, their texts) of bounded size from batches of (id, text, any other columns).

    The number is unique over the tasks of a stage: partition and position within it, over all batches.
    """
    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 32
    for batch in batches:
        column, start, held, texts = batch.column(1), 0, 0, []
        for k in range(0, batch.num_rows, ROWS_AT_ONCE):
            for text in column_bytes(column.slice(k, ROWS_AT_ONCE)):
                texts.append(text)
                held += len(text) + 64
                if held >= limit:
                    yield number, batch.slice(start, len(texts)), texts
                    number, start, held, texts = number + 1, start + len(texts), 0, []
        if texts:
            yield number, batch.slice(start), texts
            number += 1
        del column, texts
        trim()


def text_chunks(batches: Iterator[pa.RecordBatch], limit: int = TEXT_BYTES) -> Iterator[tuple[int, pa.Array, list[bytes]]]:
    """(chunk number, ids, texts) of ``row_chunks``."""
    for number, rows, texts in row_chunks(batches, limit):
        yield number, rows.column(0), texts


def with_text(batches: Iterator[pa.RecordBatch], text: str | None) -> Iterator[pa.RecordBatch]:
    """Batches of (row, its text field), so that a carried row holds its text once; unchanged without ``text``."""
    for batch in batches:
        row = batch.column(0)
        yield pa.RecordBatch.from_arrays([row, row.field(text)], names=["i", "t"]) if text else batch


def id_type(df: DataFrame, column: str) -> str:
    """SQL name of a column's type."""
    return df.schema[column].dataType.simpleString()


def arrow_of(ddl: str) -> pa.Schema:
    """Arrow schema of a result that a task builds."""
    return to_arrow_schema(StructType.fromDDL(ddl))


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A result batch from lists, numpy or Arrow arrays in the schema's order."""
    arrays = [c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
