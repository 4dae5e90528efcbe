"""Row files and result tables."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_SCHEMA = (
    "unit string, `set` string, month string, gold string, dist map<string,double>, p_max double, "
    "top string, correct boolean, p_gold double, norm_entropy double, rep_tv double, "
    "p_known double, models array<string>"
)
"""Scored rows of the usual item sets; pass a wider schema for others."""


def read_rows(spark: SparkSession, path: str | Sequence[str], schema: str | T.StructType = ROW_SCHEMA) -> DataFrame:
    """Scored rows from JSON lines with an explicit schema; missing keys are null."""
    return spark.read.schema(schema).json(path)


def rows_from_lines(lines: DataFrame, schema: str | T.StructType = ROW_SCHEMA) -> DataFrame:
    """Scored rows from a column ``value`` of JSON text."""
    return lines.select(F.from_json("value", schema).alias("_r")).select("_r.*")


def read_table(spark: SparkSession, path: str, fmt: str, schema: str | None = None, **options) -> DataFrame:
    """A question table: csv, tsv, json, jsonl or parquet."""
    reader = spark.read.schema(schema) if schema else spark.read
    if fmt in ("csv", "tsv"):
        # Quoted questions may span lines; a fixed schema avoids an inference pass.
        return reader.options(
            header=True, multiLine=True, escape='"', sep="\t" if fmt == "tsv" else ",", **options
        ).csv(path)
    if fmt == "json":
        return reader.options(multiLine=True, **options).json(path)
    if fmt == "jsonl":
        return reader.options(**options).json(path)
    return reader.options(**options).parquet(path)


def prepare_table(df: DataFrame, json_lists: Sequence[str] = (), date: str | None = None) -> DataFrame:
    """Parse JSON list columns and derive ``month`` from a date column."""
    for c in json_lists:
        df = df.withColumn(c, F.from_json(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("[]")), "array<string>"))
    return df.withColumn("month", F.substring(F.col(date).cast("string"), 1, 7)) if date else df


def with_subject(df: DataFrame, out: str = "subject") -> DataFrame:
    """File name without extension as a column, for one-file-per-subject folders."""
    return df.withColumn(out, F.regexp_replace(F.col("_metadata.file_name"), r"\.[A-Za-z]+$", ""))


def _walk(c: Column, dtype: T.DataType, leaf) -> Column:
    """Rebuild a nested column with ``leaf`` applied to scalars."""
    if isinstance(dtype, T.StructType):
        fields = [_walk(c[f.name], f.dataType, leaf).alias(f.name) for f in dtype.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: _walk(x, dtype.elementType, leaf))
    if isinstance(dtype, T.MapType):
        return F.transform_values(c, lambda k, v: _walk(v, dtype.valueType, leaf))
    return leaf(c, dtype)


def _holds_float(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_holds_float(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _holds_float(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _holds_float(dtype.valueType)
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def strict(df: DataFrame) -> DataFrame:
    """NaN and infinities at any depth become null; other columns stay as they are."""

    def leaf(c: Column, dtype: T.DataType) -> Column:
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        return c

    return df.withColumns(
        {f.name: _walk(F.col(f.name), f.dataType, leaf) for f in df.schema.fields if _holds_float(f.dataType)}
    )


def write_rows(df: DataFrame, path: str, fmt: str = "json", partition_by: Sequence[str] = ()) -> None:
    """Write strictly valid rows as JSON lines or Parquet."""
    writer = strict(df).write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(fmt).save(path)


@F.pandas_udf(T.StringType())
def _file_sha256(paths: pd.Series) -> pd.Series:
    """SHA-256 of each file, read in blocks so that memory stays flat."""
    from pyarrow import fs

    def digest(path: str) -> str:
        store, name = fs.FileSystem.from_uri(path)
        h = hashlib.sha256()
        with store.open_input_stream(name) as f:
            while block := f.read(8 << 20):
                h.update(block)
        return h.hexdigest()

    return paths.map(digest)


def file_manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Path, bytes and SHA-256 of every file; only names and sizes are listed first."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true").load(path).select("path", "length")
    )
    uri = F.regexp_replace("path", "^file:/+", "file:///")
    return files.select("path", F.col("length").alias("bytes"), _file_sha256(uri).alias("sha256"))


def rows_per_file(df: DataFrame) -> DataFrame:
    """Row count per source file of a file-based frame."""
    return df.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("rows"))

