"""Calibration of confidence against correctness."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credalis.operators.prefix import attach, null_safe_join
from credalis.operators.selection import numbered_groups
from credalis.session import checkpointed

LEVEL_DIGITS = 9
"""Score values are grouped after rounding to this many digits (fixed value)."""
COARSE_BANDS = (0.5, 0.6, 0.7, 0.8, 0.9, 1.0001)
FINE_BANDS = (*[round(0.5 + 0.025 * i, 3) for i in range(20)], 1.0001)
SMOOTH_GRID = 2000
"""Cells of the smooth calibration grid; its error is bounded by the cell width."""


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ece(
    df: DataFrame, keys: Sequence[str], confidence: str, correct: Column | str,
    bins: int = 15, weight: str | None = None,
) -> DataFrame:
    """Equal-width binned calibration error; confidence 1 falls in the last bin."""
    w = F.col(weight) if weight else F.lit(1.0)
    b = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1))
    per = df.groupBy(*keys, b.alias("_bin")).agg(
        F.sum(w).alias("_n"),
        F.sum(w * (_col(correct).cast("double") - F.col(confidence))).alias("_gap"),
    )
    return per.groupBy(*keys).agg((F.sum(F.abs("_gap")) / F.sum("_n")).alias("ece"))


def reliability_bins(
    df: DataFrame, keys: Sequence[str], confidence: str, correct: Column | str, bins: int, tie: str
) -> DataFrame:
    """Equal-mass bins by rank: the first ``n mod bins`` bins hold one row more."""
    # sizes, cuts and bins each read the rows, which may be costly to derive
    df = checkpointed(df.select(*keys, confidence, _col(correct).cast("double").alias("_ok"), tie))
    size = checkpointed(df.groupBy(*keys).agg(F.count(confidence).alias("_n")))
    ends = F.array(*[F.expr(f"{i + 1} * (_n div {bins}) + least({i + 1}, _n % {bins})") for i in range(bins - 1)])
    v = F.col(confidence).cast("double")
    j = numbered_groups(df.where(v.isNotNull()), keys, v, tie, size, ends)
    return j.groupBy(*keys, F.col("group").alias("bin")).agg(
        F.avg(v).alias("confidence"), F.avg("_ok").alias("accuracy"), F.count(F.lit(1)).alias("n"),
    )


def merge_tied_bins(bins: DataFrame, keys: Sequence[str], digits: int = 3) -> DataFrame:
    """Pool neighbouring bins whose running mean confidence rounds to the same value.

    A fold over the (few) bins of a key: each bin is compared with the pooled
    mean of the run so far.
    """
    b = F.struct(
        F.col("bin").alias("bin"), F.col("confidence").cast("double").alias("confidence"),
        F.col("accuracy").cast("double").alias("accuracy"), F.col("n").cast("double").alias("n"),
    )
    per = bins.groupBy(*keys).agg(F.array_sort(F.collect_list(b)).alias("_bins"))
    empty = F.array().cast("array<struct<confidence:double,accuracy:double,n:double>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        same = last.isNotNull() & (F.bround(last["confidence"], digits) == F.bround(x["confidence"], digits))
        n = last["n"] + x["n"]
        pooled = F.struct(
            ((last["confidence"] * last["n"] + x["confidence"] * x["n"]) / n).alias("confidence"),
            ((last["accuracy"] * last["n"] + x["accuracy"] * x["n"]) / n).alias("accuracy"),
            n.alias("n"),
        )
        fresh = F.struct(x["confidence"].alias("confidence"), x["accuracy"].alias("accuracy"), x["n"].alias("n"))
        size = F.size(acc)
        return F.when(same, F.concat(F.slice(acc, 1, F.greatest(size - 1, F.lit(0))), F.array(pooled))).otherwise(
            F.concat(acc, F.array(fresh))
        )

    merged = F.aggregate(F.col("_bins"), empty, step)
    out = per.select(*keys, F.posexplode(merged).alias("bin", "_b"))
    return out.select(*keys, "bin", "_b.confidence", "_b.accuracy", F.col("_b.n").cast("long").alias("n"))


def band_of(value: Column, edges: Sequence[float]) -> Column:
    """Index of the left-closed band; null outside."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        out = F.when((value >= edges[i]) & (value < edges[i + 1]), i).otherwise(out)
    return out


def bands_table(spark, edges: Sequence[float]) -> DataFrame:
    """The bands as a small dimension table."""
    rows = [(i, float(edges[i]), float(edges[i + 1])) for i in range(len(edges) - 1)]
    return spark.createDataFrame(rows, "band int, low double, high double")


def band_table(
    df: DataFrame, keys: Sequence[str], edges: Sequence[float], confidence: str = "p_max",
    correct: str = "correct", post: str = "post", weight: str | None = None,
) -> DataFrame:
    """Per band and period: count, accuracy and mean confidence; empty bands kept."""
    w = F.col(weight) if weight else F.lit(1.0)
    per = df.withColumn("band", band_of(F.col(confidence), edges)).filter("band is not null")

    def side(is_post: bool) -> list[Column]:
        m = F.col(post) if is_post else ~F.col(post)
        s = "post" if is_post else "pre"
        n = F.sum(F.when(m, w).otherwise(0.0))

        def mean(c: Column) -> Column:
            return F.when(n > 0, F.sum(F.when(m, w * c).otherwise(0.0)) / n)

        return [
            n.cast("long").alias(f"n_{s}"),
            mean(F.col(correct).cast("double")).alias(f"acc_{s}"),
            mean(F.col(confidence)).alias(f"conf_{s}"),
        ]

    agg = per.groupBy(*keys, "band").agg(*side(False), *side(True))
    dim = bands_table(df.sparkSession, edges)
    if keys:
        dim = df.select(*keys).distinct().join(F.broadcast(dim), F.lit(True))
    out = dim.join(agg, [*keys, "band"], "left")
    return out.fillna(0, ["n_pre", "n_post"])


def single_map_gaps(
    df: DataFrame, keys: Sequence[str], edges: Sequence[float], confidence: str = "p_max",
    correct: str = "correct", post: str = "post", weight: str | None = None,
) -> DataFrame:
    """Gaps per period when every band is mapped to its pooled accuracy.

    Band sums are pooled over periods with a window on the band table only.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    per = df.withColumn("band", band_of(F.col(confidence), edges)).filter("band is not null")
    agg = per.groupBy(*keys, "band", post).agg(
        F.sum(w).alias("_n"), F.sum(w * F.col(correct).cast("double")).alias("_k")
    )
    pool = Window.partitionBy(*keys, "band")
    agg = agg.withColumn("_map", F.sum("_k").over(pool) / F.sum("_n").over(pool))
    gap = F.col("_n") * F.col("_map") - F.col("_k")
    out = agg.groupBy(*keys, post).agg(
        (F.sum(gap) / F.sum("_n")).alias("g"), (F.sum(F.abs(gap)) / F.sum("_n")).alias("a")
    )

    def side(value: str, is_post: bool) -> Column:
        return F.max(F.when(F.col(post) == is_post, F.col(value)))

    return out.groupBy(*keys).agg(
        side("g", False).alias("mean_gap_pre"), side("g", True).alias("mean_gap_post"),
        side("a", False).alias("weighted_abs_band_gap_pre"),
        side("a", True).alias("weighted_abs_band_gap_post"),
    )


def level_table(
    df: DataFrame, keys: Sequence[str], confidence: str = "p_max", correct: str = "correct",
    post: str = "post", weight: str | None = None, digits: int = LEVEL_DIGITS,
) -> DataFrame:
    """Counts and correct counts per distinct (rounded) score value and period."""
    w = F.col(weight) if weight else F.lit(1.0)
    ok, late = F.col(correct).cast("double"), F.col(post)
    zero = F.lit(0.0)
    return df.groupBy(*keys, F.round(confidence, digits).alias("v")).agg(
        F.sum(F.when(late, zero).otherwise(w)).alias("n_pre"),
        F.sum(F.when(late, zero).otherwise(w * ok)).alias("k_pre"),
        F.sum(F.when(late, w).otherwise(zero)).alias("n_post"),
        F.sum(F.when(late, w * ok).otherwise(zero)).alias("k_post"),
    )


def group_cost() -> Column:
    """``min(n_pre, n_post) |a_pre - a_post|`` of one level or group."""
    both = (F.col("n_pre") > 0) & (F.col("n_post") > 0)
    gap = F.abs(F.col("k_pre") / F.col("n_pre") - F.col("k_post") / F.col("n_post"))
    return F.when(both, F.least("n_pre", "n_post") * gap).otherwise(0.0)


def every_map_lower_bound(levels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lower bound on the mean absolute gap of any function of the score."""
    return levels.groupBy(*keys).agg(
        (F.sum(group_cost()) / F.sum(F.col("n_pre") + F.col("n_post"))).alias("lower_bound")
    )


def apply_levels(fit: DataFrame, held: DataFrame, keys: Sequence[str], group: str) -> DataFrame:
    """Held-out mean absolute gap of a grouping fitted on other rows.

    Both inputs have counts per (keys, group). A group without fitting rows maps
    to the overall fitted accuracy.
    """
    counts = ["n_pre", "k_pre", "n_post", "k_post"]
    f = fit.groupBy(*keys, group).agg(*[F.sum(c).alias(f"f_{c}") for c in counts])
    h = held.groupBy(*keys, group).agg(*[F.sum(c).alias(c) for c in counts])
    overall = fit.groupBy(*keys).agg(
        (F.sum(F.col("k_pre") + F.col("k_post")) / F.greatest(F.sum(F.col("n_pre") + F.col("n_post")), F.lit(1.0))).alias("_all")
    )
    j = attach(null_safe_join(h, f, [*keys, group], "left"), overall, keys)
    j = j.fillna(0.0, [f"f_{c}" for c in counts])
    a_pre = F.when(F.col("f_n_pre") > 0, F.col("f_k_pre") / F.col("f_n_pre")).otherwise(F.col("f_k_post") / F.col("f_n_post"))
    a_post = F.when(F.col("f_n_post") > 0, F.col("f_k_post") / F.col("f_n_post")).otherwise(a_pre)
    value = F.when(F.col("f_n_pre") + F.col("f_n_post") == 0, F.col("_all")).when(
        F.col("f_n_pre") >= F.col("f_n_post"), a_pre
    ).otherwise(a_post)
    err = F.lit(0.0)
    for s in ("pre", "post"):
        n, k = F.col(f"n_{s}"), F.col(f"k_{s}")
        err = err + F.when(n > 0, n * F.abs(value - k / n)).otherwise(0.0)
    return j.groupBy(*keys).agg((F.sum(err) / F.sum(F.col("n_pre") + F.col("n_post"))).alias("held_out_gap"))


# --- smooth calibration error --------------------------------------------------


def residual_grid(
    df: DataFrame, keys: Sequence[str], confidence: str, correct: Column | str,
    weight: Column | str | None = None, grid: int = SMOOTH_GRID,
) -> DataFrame:
    """Residual mass ``sum(y - p)`` and count per grid cell: the whole input of smooth ECE."""
    w = F.lit(1.0) if weight is None else _col(weight)
    cell = F.least(F.floor(F.col(confidence) * grid), F.lit(grid - 1)).cast("int")
    return df.groupBy(*keys, cell.alias("cell")).agg(
        F.sum(w * (_col(correct).cast("double") - F.col(confidence))).alias("r"),
        F.sum(w).alias("n"),
    )


def grid_sides(df: DataFrame, keys: Sequence[str], confidence: str, correct: Column | str, grid: int = SMOOTH_GRID) -> DataFrame:
    """Per grid cell ``x``: count and mean confidence of wrong (0) and right (1) answers."""
    p, ok = F.col(confidence).cast("double"), _col(correct).cast("boolean")
    base = df.select(*keys, p.alias("_p"), ok.alias("_ok")).where("_p is not null and _ok is not null")
    aggs = []
    for k, on in ((0, ~F.col("_ok")), (1, F.col("_ok"))):
        v = F.when(on, F.col("_p"))
        aggs += [F.count(v).alias(f"n{k}"), F.coalesce(F.avg(v), F.lit(0.0)).alias(f"m{k}")]
    return base.groupBy(*keys, F.least(F.floor(F.col("_p") * grid), F.lit(grid - 1)).cast("double").alias("x")).agg(*aggs)


NARROWEST = 1e-3 / 2
LADDER = 65
"""Kernel widths, in equal ratios from the narrowest to 1, whose transforms are made once."""
CLOSE = 1e-11


def kernel_spectrum(sigma: np.ndarray, grid: int) -> np.ndarray:
    """Transforms of Gaussians of these widths on a circle of twice the grid, one a row.

    A kernel that repeats on the circle has the transform of the Gaussian itself, repeated at
    the sampling rate; widths of one cell and more leave three terms.
    """
    s = (np.asarray(sigma, float) * grid)[:, None]
    w = np.pi * np.arange(grid + 1) / grid
    top = sum(np.exp(-0.5 * (s * (w + 2 * np.pi * j)) ** 2) for j in (-1, 0, 1))
    return top / (1 + 2 * np.exp(-0.5 * (2 * np.pi * s) ** 2))


def smooth_errors(transform: np.ndarray, spectrum: np.ndarray) -> np.ndarray:
    """Integral of the absolute smoothed residual for each row of transformed residuals."""
    grid = transform.shape[1] - 1
    return np.abs(np.fft.irfft(transform * spectrum, 2 * grid)[:, :grid]).sum(axis=1)


def smooth_eces(residuals: np.ndarray) -> np.ndarray:
    """Fixed point ``error(s) = s`` for each row of residuals on a grid (the error falls with ``s``).

    All rows search the ladder of widths together, then close in on their own widths by
    secants that keep the sign change inside.
    """
    rows, grid = residuals.shape
    # Mirroring makes reflection at 0 and 1 a circular convolution.
    transform = np.fft.rfft(np.concatenate([residuals, residuals[:, ::-1]], axis=1))
    widths = np.geomspace(NARROWEST, 1.0, LADDER)
    ladder = kernel_spectrum(widths, grid)
    gap = lambda k: smooth_errors(transform, ladder[k]) - widths[k]
    low, high = np.zeros(rows, int), np.full(rows, LADDER - 1)
    at_low, at_high = gap(low), gap(high)
    flat = at_low <= 0
    while (high - low > 1).any():
        mid = (low + high) // 2
        at = gap(mid)
        up = at >= 0
        low, at_low = np.where(up, mid, low), np.where(up, at, at_low)
        high, at_high = np.where(up, high, mid), np.where(up, at_high, at)
    a, b = widths[low], widths[high]
    out = np.where(flat, at_low + a, 0.0)
    live = np.flatnonzero(~flat)
    a, b, fa, fb = a[live], b[live], at_low[live], at_high[live]
    kept = np.zeros(len(live), int)
    for _ in range(60):
        if not len(live):
            break
        c = np.clip(np.where(fa > fb, a + (b - a) * fa / np.where(fa > fb, fa - fb, 1), (a + b) / 2), a, b)
        error = smooth_errors(transform[live], kernel_spectrum(c, grid))
        f = error - c
        out[live] = error
        up = f >= 0
        # the end that stays twice running counts half, so that the other one moves as well
        fb = np.where(up & (kept == 1), fb / 2, np.where(up, fb, f))
        fa = np.where(~up & (kept == -1), fa / 2, np.where(up, f, fa))
        kept = np.where(up, 1, -1)
        a, b = np.where(up, c, a), np.where(up, b, c)
        open_ = (np.abs(f) > CLOSE) & (b - a > CLOSE)
        live, a, b, fa, fb, kept = live[open_], a[open_], b[open_], fa[open_], fb[open_], kept[open_]
    return out


def smece_of_grid(cells: DataFrame, keys: Sequence[str], grid: int = SMOOTH_GRID) -> DataFrame:
    """Smooth ECE per key; each group is a grid of at most ``grid`` rows."""
    keys = list(keys)
    src = cells if keys else cells.withColumn("_all", F.lit(0))
    group = keys or ["_all"]
    fields = [f for f in src.schema.fields if f.name in group]
    schema = T.StructType([*fields, T.StructField("smece", T.DoubleType()), T.StructField("n", T.DoubleType())])

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        r = np.zeros(grid)
        np.add.at(r, pdf["cell"].to_numpy(int), pdf["r"].to_numpy(float))
        n = float(pdf["n"].sum())
        row = {k: pdf[k].iloc[0] for k in group}
        return pd.DataFrame([{**row, "smece": float(smooth_eces(r[None] / n)[0]), "n": n}])

    out = src.groupBy(*group).applyInPandas(finish, schema)
    return out if keys else out.drop("_all")


def smece(
    df: DataFrame, keys: Sequence[str], confidence: str, correct: Column | str,
    weight: Column | str | None = None, grid: int = SMOOTH_GRID,
) -> DataFrame:
    """Smooth calibration error of a confidence column."""
    return smece_of_grid(residual_grid(df, keys, confidence, correct, weight, grid), keys, grid)
