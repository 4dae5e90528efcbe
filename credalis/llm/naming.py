"""Exact copies by block naming.

A text is cut into blocks of fixed size. The blocks of all texts are sorted and named by
integers, then adjacent names are paired and the pairs sorted and named again, until one
name is left. With the number of blocks it identifies the text without collisions.

Copies inside a task share one entry, so a text that holds a third of all rows meets the
sorts as one row per task. Block bytes are shuffled once; all later shuffles move integers.

Null text counts as empty; all empty texts are one group. A repeated row is a copy of
itself: exactly one row of a group stays, also where ids repeat. A null id is below every
other id. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credalis.llm.frames import arrow_of, batch_of, id_type, stored, text_chunks

BLOCK_BYTES = 1024
SORT_ROWS = 50_000
"""Rows of one sorted bucket, on average."""


def _local_entries(block_bytes: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, ids, texts in text_chunks(batches):
            blocks: dict[bytes, int] = {}
            entries: dict[bytes, list] = {}
            for doc, text in zip(ids.to_pylist(), texts, strict=True):
                entries.setdefault(text.lower(), []).append(doc)
            rows = []
            for i, (text, docs) in enumerate(entries.items()):
                cut = [text[k : k + block_bytes] for k in range(0, len(text), block_bytes)]
                rows.append((chunk, i, None, [blocks.setdefault(b, len(blocks)) for b in cut], hashlib.sha256(text).hexdigest(), docs))
            rows += [(chunk, i, b, None, None, None) for b, i in blocks.items()]
            yield batch_of(schema, *(list(c) for c in zip(*rows, strict=True)))

    return run


def _named(df: DataFrame, *by: str) -> Column:
    """Integer name of the columns ``by``: rank among the sorted values of a hash bucket."""
    n = max(1, -(-df.count() // SORT_ROWS))
    bucket = F.pmod(F.xxhash64(*by), F.lit(n))
    w = Window.partitionBy(bucket).orderBy(*by)
    return (bucket * F.lit(1 << 40) + F.dense_rank().over(w)).cast("long")


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per (chunk, entry): members, sha256, and the identity (n_blocks, name).

    Texts are equal when identical after lower-casing A-Z only.
    """
    kind = id_type(docs, id_col)
    ddl = f"chunk long, entry int, block binary, blocks array<int>, text_sha256 string, members array<{kind}>"
    pairs = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    local = stored(pairs.mapInArrow(_local_entries(block_bytes, arrow_of(ddl)), ddl))
    texts = local.where(F.col("blocks").isNotNull()).select("chunk", "entry", "text_sha256", "members", F.size("blocks").alias("n_blocks"))
    blocks = local.where(F.col("block").isNotNull()).select("chunk", F.col("entry").alias("b"), "block")
    names = stored(blocks.withColumn("name", _named(blocks, "block")).drop("block"))
    at = local.where(F.col("blocks").isNotNull()).select("chunk", "entry", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "b"))
    level = stored(at.join(names, ["chunk", "b"]).drop("b"))
    most = level.agg(F.max("n")).first()[0] or 0
    done, width = level.where("n = 1"), 1
    while width < most:
        width *= 2
        even = F.col("pos") % 2 == 0
        pair = stored(
            level.where(F.col("n") > width // 2)
            .groupBy("chunk", "entry", "n", F.floor(F.col("pos") / 2).cast("int").alias("pos"))
            .agg(F.max(F.when(even, F.col("name"))).alias("a"), F.max(F.when(~even, F.col("name"))).alias("b"))
        )
        level = stored(pair.withColumn("name", _named(pair, "a", "b")).drop("a", "b"))
        done = done.unionByName(level.where(F.col("n") <= width))
    found = done.select("chunk", "entry", "name")
    return texts.join(found, ["chunk", "entry"], "left").withColumn("name", F.coalesce("name", F.lit(0)))


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: id, ``keep_id`` (the largest id among equal texts), ``group_size``, ``kept``, ``text_sha256``."""
    entry = identities(docs, id_col, text_col, block_bytes).withColumn("top", F.array_max("members"))
    groups = entry.groupBy("n_blocks", "name").agg(
        F.sum(F.size("members")).cast("long").alias("group_size"), F.max(F.struct("top", "chunk", "entry")).alias("best")
    )
    rows = entry.join(groups, ["n_blocks", "name"])
    first = F.coalesce(F.array_position("members", F.col("top")) - 1, F.lit(0))
    here = (F.col("best.chunk") == F.col("chunk")) & (F.col("best.entry") == F.col("entry"))
    return rows.select(
        F.posexplode("members").alias("at", id_col), F.col("best.top").alias("keep_id"), "group_size",
        F.when(here, first).otherwise(-1).alias("first"), "text_sha256",
    ).select(id_col, "keep_id", "group_size", (F.col("at") == F.col("first")).alias("kept"), "text_sha256")
