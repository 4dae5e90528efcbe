"""Shards by rendezvous hashing of stable record keys, with DataFrame functions only.

Each (key, shard) pair draws a score from its hash, scaled by the shard's weight, and the
best shard takes the record. A further shard only takes records into itself; no other moves.

Null text has no bytes. A null key is a key like any other. Repeated keys share a shard; rows
that agree in key, checksum and size are interchangeable, so their slots are too. Columns
beside key and text are carried only where ``keep`` names them and no result has their name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESULT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
SLOT_ROWS = 100_000
"""Rows of one slot range, on average."""


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard 0 .. len(weights)-1 of a key: the largest of -weight / ln(u), u hashed from key and shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    name = F.coalesce(key.cast("string"), F.lit("\0"))

    def score(shard: int, weight: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(name, F.lit(f"shard {shard}")), 11)
        u = (bits.cast("double") + 0.5) / F.lit(float(1 << 53))
        return F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(-shard).alias("shard"))

    return (-F.greatest(*[score(i, w) for i, w in enumerate(weights)])["shard"]).cast("int")


def shards(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: Sequence[float] = (1.0,) * 8, grown_weight: float = 1.0, keep: Sequence[str] = (),
) -> DataFrame:
    """Per row: id, size, text_crc32, law, shard, slot, grown_shard (with one more shard of ``grown_weight``).

    Slots are gapless from 0 in each shard, in order of a key hash. They are numbered inside
    ranges of that hash and shifted by the ranges' counts, so no task holds a whole shard.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keep = [c for c in keep if c not in (id_col, *RESULT)]
    rows = docs.select(
        *keep, F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("key").alias("law"),
        rendezvous(F.col(id_col), weights).alias("shard"), rendezvous(F.col(id_col), [*weights, grown_weight]).alias("grown_shard"),
    )
    ranges = max(1, -(-docs.count() // (SLOT_ROWS * len(weights))))
    crowd = F.pmod(F.xxhash64("text_crc32", "size"), F.lit(16))  # a key that holds many rows is split too
    rows = rows.withColumn("_range", (F.pmod(F.xxhash64(F.col(id_col)), F.lit(ranges)) * 16 + crowd).cast("int"))
    counts = rows.groupBy("shard", "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "_range", before.alias("_start"))
    place = F.row_number().over(Window.partitionBy("shard", "_range").orderBy(id_col, "text_crc32", "size")) - 1
    numbered = rows.withColumn("_place", place).join(starts, ["shard", "_range"])
    slot = (F.col("_start") + F.col("_place")).cast("long").alias("slot")
    return numbered.select(*keep, id_col, "size", "text_crc32", "law", "shard", slot, "grown_shard")
