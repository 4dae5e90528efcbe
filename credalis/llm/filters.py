"""Fixed-size filter over key hashes: what it excludes is surely not among the keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 24


def key_filter(keys: DataFrame) -> np.ndarray:
    """A bit for each 64-bit hash in the only column of ``keys``. At most 2**FILTER_BITS bits are collected, packed."""
    h = F.shiftrightunsigned(F.col(keys.columns[0]), 64 - FILTER_BITS)
    bit = F.expr("shiftleft(1L, cast(h % 64 as int))")
    got = keys.select(h.alias("h")).groupBy(F.shiftright("h", 6).alias("w")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[got.column("w").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint64)


def passes(bits: np.ndarray, keys: pa.Array) -> np.ndarray:
    """Whether each key may be among those of the filter."""
    h = keys.to_numpy().view(np.uint64) >> np.uint64(64 - FILTER_BITS)
    return (bits[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) > 0


def filtered(df: DataFrame, held: Broadcast, passed: bool = True) -> DataFrame:
    """Rows whose last column, a 64-bit hash, passes the filter, or those whose does not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(held.value, batch.column(batch.num_columns - 1)) == passed))

    return df.mapInArrow(run, df.schema)
