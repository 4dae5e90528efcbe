"""Running sums in score order that never funnel a large table into one task.

A window without partition keys runs in one task, and a group holding a third
of the rows would run in one task too. So the order is cut into value buckets:

1. one cheap pass finds bucket edges (``percentile_approx``) and the number of
   distinct values; the edges come back as a bounded array of literals, so a
   recomputed task puts every row into the same bucket;
2. bucket totals are aggregated (map-side first) and their running sum, at most
   ``MAX_BUCKETS`` rows per key, gives each bucket's offset;
3. a window inside (key, bucket) adds the local part.

Small inputs (few distinct values) skip all of it and use one plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLAIN_LEVELS = 50_000
"""Up to this many ordered rows per key a plain window is used."""
MAX_BUCKETS = 4096
"""Largest number of value buckets (and of literals sent to the tasks)."""


def small_groups(df: DataFrame, keys: Sequence[str], limit: int = PLAIN_LEVELS) -> bool:
    """Whether no key holds more than ``limit`` rows (reads the key columns only)."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return (sizes.agg(F.max("n").alias("n")).first()["n"] or 0) <= limit


FEW_VALUES = 16
"""Up to this many values of a column are told apart by columns instead of rows."""


def few_values(df: DataFrame, column: Column | str, limit: int = FEW_VALUES) -> list | None:
    """Distinct values of a column, null included, in order; None beyond ``limit`` (each task sends its own distinct values)."""
    c = F.col(column) if isinstance(column, str) else column
    found = [r[0] for r in df.select(c.alias("_c")).distinct().limit(limit + 1).collect()]
    return None if len(found) > limit else sorted(found, key=lambda v: (v is None, "" if v is None else v))


def score_edges(
    df: DataFrame, score: str, rows_per_bucket: int = PLAIN_LEVELS, distinct: bool = True,
    keys: Sequence[str] = (),
) -> list[float]:
    """Bucket edges of a numeric column; empty when a plain window is enough.

    A plain window is enough when the largest key holds few rows, or the column
    few values. A value that holds more than one bucket's share of the rows gets a
    bucket of its own, ``[v, next double)``.
    """
    if keys and small_groups(df, keys, rows_per_bucket):
        return []
    size = F.approx_count_distinct(score, 0.02) if distinct else F.count(score)
    n = df.agg(size.alias("n")).first()["n"]
    if n <= rows_per_bucket:
        return []
    buckets = int(min(MAX_BUCKETS, max(2, -(-n // (rows_per_bucket // 4)))))
    cuts = [i / buckets for i in range(1, buckets)]
    found = df.agg(F.percentile_approx(score, cuts, 20 * buckets).alias("q")).first()["q"]
    edges: set[float] = set()
    seen: set[float] = set()
    for v in found or []:
        v = float(v)
        if v in seen:
            edges.add(float(np.nextafter(v, np.inf)))
        seen.add(v)
        edges.add(v)
    return sorted(edges)


def with_bucket(df: DataFrame, score: str, edges: Sequence[float], out: str = "_bucket") -> DataFrame:
    """Add the bucket number of ``score`` (binary search in the JVM)."""
    if not edges:
        return df.withColumn(out, F.lit(0.0))
    splits = [-float("inf"), *edges, float("inf")]
    return Bucketizer(splits=splits, inputCol=score, outputCol=out, handleInvalid="keep").transform(df)


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Sequence[str],
    edges: Sequence[float] | None = None,
) -> DataFrame:
    """Add ``before_<s>``: the sum of ``s`` over rows earlier in the order.

    ``order`` is ascending: the leading column is numeric and bucketed. Further
    columns break ties; a hash tie-break (a hex string) also splits one hot value
    into 256 sub-buckets, so equal scores do not end in one task.
    """
    keys = list(keys)
    head = order[0]
    if edges is None:
        edges = score_edges(df, head, distinct=len(order) == 1, keys=keys)
    asc = [F.col(o).asc() for o in order]
    if not edges:
        w = Window.partitionBy(*keys).orderBy(*asc)
        w = w.rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns(
            {f"before_{s}": F.coalesce(F.sum(s).over(w), F.lit(0.0)) for s in sums}
        )
    b = with_bucket(df, head, edges)
    part = ["_bucket"]
    if len(order) > 1:
        hot = [float(i) for i in hot_buckets(edges)]
        sub = F.when(F.col("_bucket").isin(hot), F.substring(order[1], 1, 2)).otherwise("")
        b = b.withColumn("_sub", sub if hot else F.lit(""))
        part.append("_sub")
    totals = b.groupBy(*keys, *part).agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    wt = Window.partitionBy(*keys).orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, *part,
        *[F.coalesce(F.sum(f"_t_{s}").over(wt), F.lit(0.0)).alias(f"_o_{s}") for s in sums],
    )
    wl = Window.partitionBy(*keys, *part).orderBy(*asc).rowsBetween(Window.unboundedPreceding, -1)
    local = b.withColumns({f"_l_{s}": F.coalesce(F.sum(s).over(wl), F.lit(0.0)) for s in sums})
    joined = null_safe_join(local, offsets, [*keys, *part])
    return joined.withColumns(
        {f"before_{s}": F.col(f"_l_{s}") + F.col(f"_o_{s}") for s in sums}
    ).drop(*part, *[f"_l_{s}" for s in sums], *[f"_o_{s}" for s in sums])


def hot_buckets(edges: Sequence[float]) -> list[int]:
    """Buckets that hold exactly one value."""
    return [
        i + 1 for i in range(len(edges) - 1)
        if edges[i + 1] == float(np.nextafter(edges[i], np.inf))
    ]


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join where null keys match, keeping the left columns plus the new ones."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in on],
        *[c for c in right.columns if c not in on],
    )
    cond = F.lit(True)
    for k in on:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in on])


def attach(df: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join one row per key back; without keys, the single row goes to every task."""
    if keys:
        return null_safe_join(df, per_key, list(keys), how)
    return df.join(F.broadcast(per_key), F.lit(True), "left" if how == "left" else "inner")


FEW_KEYS = 10_000
"""Up to this many distinct keys, one row per key is broadcast to the rows."""


def attach_rows(df: DataFrame, per_key: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Like :func:`attach` for row-sized ``df``: the key count is checked first.

    With few keys the per-key rows are broadcast, so a hot key does not draw its
    rows through one exchange; with many keys the join is left to the optimizer.
    """
    if not keys:
        return attach(df, per_key, keys)
    few = df.select(*keys).distinct().limit(FEW_KEYS + 1).count() <= FEW_KEYS
    return null_safe_join(df, F.broadcast(per_key) if few else per_key, list(keys))


def hash_rank(df: DataFrame, keys: Sequence[str], hash_col: str, out: str = "rank", digits: int = 4) -> DataFrame:
    """Exact 1-based rank by a hex hash inside each key, with no group in one task.

    Hashes are uniform, so their first digits are equal buckets by construction
    and no edges are needed.
    """
    keys = list(keys)
    b = df.withColumn("_h", F.substring(hash_col, 1, digits))
    sizes = b.groupBy(*keys, "_h").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_h", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    local = b.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_h").orderBy(hash_col)))
    ranked = null_safe_join(local, offsets, [*keys, "_h"])
    return ranked.withColumn(out, F.col("_before") + F.col("_rn")).drop("_h", "_rn", "_before")


def key_sizes(df: DataFrame, keys: Sequence[str], out: str = "n") -> DataFrame:
    """Rows per key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def flag(c: Column | str) -> Column:
    """Boolean as 0.0 / 1.0."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("double")
