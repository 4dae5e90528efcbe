"""Dose-response designs: slopes, contrasts and growing evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credalis.operators.prefix import attach


def within_item_slope(df: DataFrame, keys: Sequence[str], x: Column, y: Column) -> DataFrame:
    """Least-squares slope per item with at least two distinct ``x`` values."""
    t = df.select(*keys, x.cast("double").alias("_x"), y.cast("double").alias("_y"))
    s = t.groupBy(*keys).agg(
        F.regr_slope("_y", "_x").alias("slope"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")
    )
    return s.filter(F.col("_lo") < F.col("_hi")).drop("_lo", "_hi")


def complete_items(df: DataFrame, item: str, dose: str, doses: Sequence[int]) -> DataFrame:
    """Rows of the listed doses for items that have all of them."""
    want = [int(d) for d in doses]
    have = df.filter(F.col(dose).isin(want))
    # one bit per dose: the union of bits needs no distinct set
    bit = F.lit(0)
    for i, d in enumerate(want):
        bit = F.when(F.col(dose) == d, 1 << i).otherwise(bit)
    full = have.groupBy(item).agg(F.bit_or(bit).alias("_bits")).filter(F.col("_bits") == (1 << len(want)) - 1)
    return have.join(full.select(item), item, "left_semi")


def first_last_contrast(df: DataFrame, keys: Sequence[str], k: str, value: Column) -> DataFrame:
    """Value at the first ``k``, at the middle ``ceil(n/2)`` and at the last, per group."""
    t = df.select(*keys, F.col(k).alias("_k"), value.cast("double").alias("_v"))
    size = t.groupBy(*keys).agg(F.max("_k").alias("_n"))
    j = attach(t, size, keys)
    mid = F.max(F.when(F.col("_k") == F.ceil(F.col("_n") / 2), F.col("_v")))
    return j.groupBy(*keys).agg(
        F.min_by("_v", "_k").alias("first"), mid.alias("middle"), F.max_by("_v", "_k").alias("last"),
        (F.min_by("_v", "_k") - F.max_by("_v", "_k")).alias("first_minus_last"), F.max("_n").alias("n"),
    )


def prefix_reveal(df: DataFrame, key: str, position: str, text: str) -> DataFrame:
    """One row per prefix length ``k`` of a text's ordered sentences."""
    per = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.trim(text).alias("t")))).alias("_s"))
    parts = per.select(key, F.transform("_s", lambda s: s["t"]).alias("_t"))
    n = F.size("_t")
    out = parts.select(key, "_t", n.alias("n_sentences"), F.explode(F.sequence(F.lit(1), n)).alias("k"))
    return out.select(
        key, "k", "n_sentences", (F.col("k") / F.col("n_sentences")).alias("fraction"),
        F.array_join(F.slice("_t", 1, F.col("k")), " ").alias("clues"),
    )
