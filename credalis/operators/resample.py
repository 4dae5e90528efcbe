"""Resample weights and draws as tables: the resample number ``b`` is a column.

A bootstrap is then the metric itself with ``b`` among its keys, and the loop
over resamples is one shuffle. Schemes:

- ``item_weights``: Poisson(1) per row and resample, from the row's hash. The
  weights are drawn and partially aggregated inside the map tasks, so only
  (resample x level) sums are shuffled, never rows x resamples.
- ``cluster_weights``: exact multinomial draw over a small table of clusters.
- ``operators.tree``: resamples of a bounded table of score buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credalis.operators.prefix import attach, hash_rank, key_sizes
from credalis.functions.seeded import DRAWS_PER_HASH, key_hash, pick, poisson1, uniform


def resample_index(spark, b: int) -> DataFrame:
    """One row per resample."""
    return spark.range(b).select(F.col("id").cast("int").alias("b"))


def item_weights(df: DataFrame, unit: Sequence[str], b: int, seed: str = "boot") -> DataFrame:
    """Rows times resamples with a positive Poisson(1) weight ``w``."""
    chunks = -(-b // DRAWS_PER_HASH)
    drawn = df.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    drawn = drawn.withColumn("_h", key_hash(seed, *unit, "_c"))
    drawn = drawn.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(DRAWS_PER_HASH - 1))))
    drawn = drawn.withColumn("b", F.col("_c") * DRAWS_PER_HASH + F.col("_j"))
    drawn = drawn.filter(F.col("b") < b)
    w = poisson1(F.col("_h").substr(F.col("_j") * 4 + 1, F.lit(4)))
    return drawn.withColumn("w", w.cast("double")).filter(F.col("w") > 0).drop("_c", "_h", "_j")


def dense_index(clusters: DataFrame, keys: Sequence[str], cluster: str) -> DataFrame:
    """Distinct clusters with position ``idx`` 0.. and cluster count ``m`` per key.

    Clusters are months, questions or domains: a table far smaller than the rows.
    """
    ids = clusters.select(*keys, cluster).distinct()
    w = Window.partitionBy(*keys)
    return ids.withColumn("idx", F.row_number().over(w.orderBy(cluster)) - 1).withColumn(
        "m", F.count(F.lit(1)).over(w)
    )


def cluster_weights(
    clusters: DataFrame, keys: Sequence[str], cluster: str, b: int, seed: str = "boot"
) -> DataFrame:
    """Draw as many clusters as there are, with replacement: ``(keys, cluster, b, w)``."""
    index = dense_index(clusters, keys, cluster)
    draws = index.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(b - 1))))
    draws = draws.select(
        *keys, "b", pick(F.col("m"), seed, *keys, "b", "idx").alias("idx")
    )
    counts = draws.groupBy(*keys, "b", "idx").agg(F.count(F.lit(1)).cast("double").alias("w"))
    return counts.join(index.drop("m"), [*keys, "idx"]).select(*keys, cluster, "b", "w")


def month_block_weights(
    months: DataFrame, period: str, month: str, b: int, block: int, seed: str = "block"
) -> DataFrame:
    """Moving blocks of consecutive months inside each period, cut to the month count."""
    index = dense_index(months, [period], month)
    size = index.select(period, "m").distinct()
    length = F.least(F.lit(block), F.col("m"))
    plan = size.withColumn("len", length).withColumn(
        "b", F.explode(F.sequence(F.lit(0), F.lit(b - 1)))
    )
    blocks = plan.withColumn(
        "i", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("m") / F.col("len")) - 1).cast("int")))
    )
    blocks = blocks.withColumn("start", pick(F.col("m") - F.col("len") + 1, seed, period, "b", "i"))
    drawn = blocks.withColumn("off", F.explode(F.sequence(F.lit(0), (F.col("len") - 1).cast("int"))))
    drawn = drawn.withColumn("pos", F.col("i") * F.col("len") + F.col("off"))
    drawn = drawn.filter(F.col("pos") < F.col("m"))
    return drawn.select(
        period, "b", "pos", (F.col("start") + F.col("off")).alias("idx")
    ).join(index.drop("m"), [period, "idx"]).select(period, month, "b", "pos")


def block_counts(drawn: DataFrame, period: str, month: str) -> DataFrame:
    """Times each month was drawn."""
    return drawn.groupBy(period, month, "b").agg(F.count(F.lit(1)).cast("double").alias("w"))


def half_sample(df: DataFrame, keys: Sequence[str], unit: Sequence[str], b: int, seed: str = "half") -> DataFrame:
    """Half-samples without replacement: hash rank at most ``n // 2`` per resample."""
    drawn = df.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(b - 1))))
    drawn = drawn.withColumn("_key", key_hash(seed, *unit, "b"))
    ranked = hash_rank(drawn, [*keys, "b"], "_key", digits=3)
    joined = attach(ranked, key_sizes(df, keys, "_size"), keys)
    return joined.filter(F.col("rank") <= F.floor(F.col("_size") / 2)).drop("_key", "rank", "_size")


def signs(df: DataFrame, unit: Sequence[str], b: int, seed: str = "flip") -> DataFrame:
    """Rows times patterns with a random sign ``s``."""
    drawn = df.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(b - 1))))
    return drawn.withColumn("s", F.when(uniform(seed, *unit, "b") < 0.5, -1.0).otherwise(1.0))


def interval(draws: DataFrame, keys: Sequence[str], value: str, level: float = 0.95, out: str = "") -> list[Column]:
    """Aggregate columns ``<out>lo`` and ``<out>hi``: linear percentiles, NaN and null ignored."""
    v = F.when(~F.isnan(value), F.col(value))
    q = [(1 - level) / 2, (1 + level) / 2]
    return [F.percentile(v, q[0]).alias(f"{out}lo"), F.percentile(v, q[1]).alias(f"{out}hi")]


def percentile_interval(draws: DataFrame, keys: Sequence[str], value: str, level: float = 0.95) -> DataFrame:
    """``lo`` and ``hi`` per key over the resamples."""
    return draws.groupBy(*keys).agg(*interval(draws, keys, value, level))
