"""Fits on level tables: one row per panel and distinct score value, never rows of data.

A panel of up to ``BLOCK`` values is solved in its own group. A larger one is cut into blocks
of neighbouring values that many tasks work on:

* the best grouping into intervals is a shortest path over the gaps between values. Costs of
  the best paths to one block's gaps, combined with the costs of all groups from there to
  another block's gaps, are a min-plus product of a vector and a matrix. A finished block is
  multiplied into all later blocks at the same time, and the next one is finished in a task;
* isotonic fits pool neighbours inside each block first; only the pooled parts of all blocks
  meet, and pools are never cut again, so each value finds its mean by the part it is in.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credalis.functions.seeded import key_hash
from credalis.operators import calibration as C
from credalis.operators import inference as I
from credalis.operators.prefix import attach, null_safe_join, running_sums
from credalis.session import checkpointed

BLOCK = 4096
"""Values of a panel that one task takes."""
TILE = 512
"""Side of the matrices that a product is made of."""
COUNTS = ("n_pre", "k_pre", "n_post", "k_post")


def pool_adjacent(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Isotonic least squares of values in order."""
    means: list[float] = []
    weights: list[float] = []
    sizes: list[int] = []
    for yi, wi in zip(y, w, strict=True):
        means.append(float(yi))
        weights.append(float(wi))
        sizes.append(1)
        while len(means) > 1 and means[-2] >= means[-1]:
            m, wt, n = means.pop(), weights.pop(), sizes.pop()
            total = weights[-1] + wt
            means[-1] = (means[-1] * weights[-1] + m * wt) / total
            weights[-1] = total
            sizes[-1] += n
    return np.repeat(means, sizes)


def isotonic_predict(v: np.ndarray, n: np.ndarray, k: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Isotonic fit of ``k / n`` on ``v``, linear between fitted values, clipped outside."""
    has = n > 0
    if not has.any():
        return np.full(len(at), np.nan)
    return np.interp(at, v[has], pool_adjacent(k[has] / n[has], n[has]))


def _schema(df: DataFrame, keys: Sequence[str], extra: str) -> T.StructType:
    fields = [f for f in df.schema.fields if f.name in keys]
    return T.StructType([*fields, *T.StructType.fromDDL(extra).fields])


def _split(levels: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """Panels that fit one task, and the others (None when there are none)."""
    sizes = checkpointed(levels.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")))
    if (sizes.agg(F.max("_size")).first()[0] or 0) <= BLOCK:
        return levels, None
    j = attach(levels, sizes, keys)
    return j.where(F.col("_size") <= BLOCK).drop("_size"), j.where(F.col("_size") > BLOCK).drop("_size")


def _grouped(df: DataFrame, keys: Sequence[str]):
    """``df`` grouped by the keys; without keys, as one group."""
    return df.groupBy(*keys) if keys else df.withColumn("_all", F.lit(0)).groupBy("_all")


# --- the cheapest partition into intervals -----------------------------------------


def group_errors(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Error of the groups between all pairs of gaps, from running sums of ``n_pre, k_pre, n_post, k_post``.

    The smaller period's size times the gap of the accuracies is a difference of products over the larger size.
    """
    n0, k0, n1, k1 = (end[None, :, c] - begin[:, None, c] for c in range(4))
    return np.abs(k0 * n1 - k1 * n0) / np.maximum(np.maximum(n0, n1), 1)


def multiply_in(sums: np.ndarray, cost: np.ndarray, first: int, to: np.ndarray, best: np.ndarray, back: np.ndarray) -> None:
    """Min-plus product of ``cost`` at the gaps ``sums`` with the errors to the gaps ``to``: ``best`` and ``back`` improve in place."""
    for i in range(0, len(sums), TILE):
        for j in range(0, len(to), TILE):
            total = group_errors(sums[i : i + TILE], to[j : j + TILE]) + cost[i : i + TILE, None]
            least = total.argmin(axis=0)
            value = total[least, np.arange(total.shape[1])]
            better = value < best[j : j + TILE]
            best[j : j + TILE] = np.where(better, value, best[j : j + TILE])
            back[j : j + TILE] = np.where(better, first + i + least, back[j : j + TILE])


def finish(sums: np.ndarray, best: np.ndarray, back: np.ndarray, first: int) -> None:
    """Settle a block that all earlier ones are multiplied into: halves, the former multiplied into the latter."""
    n = len(sums)
    if n == 1:
        return
    half = n // 2
    finish(sums[:half], best[:half], back[:half], first)
    multiply_in(sums[:half], best[:half], first, sums[half:], best[half:], back[half:])
    finish(sums[half:], best[half:], back[half:], first + half)


def group_numbers(back: np.ndarray) -> np.ndarray:
    """Group of each value, from the gap before the group that ends at each gap."""
    starts = np.zeros(len(back) - 1, int)
    gap = len(back) - 1
    while gap:
        gap = back[gap]
        starts[gap] = 1
    return np.cumsum(starts) - 1


def cheapest_intervals(counts: np.ndarray) -> tuple[float, np.ndarray]:
    """Least total error over all groupings into intervals, and the group of each value."""
    sums = np.concatenate([np.zeros((1, 4)), counts.cumsum(axis=0)])
    best, back = np.full(len(sums), np.inf), np.zeros(len(sums), int)
    best[0] = 0
    finish(sums, best, back, 0)
    return float(best[-1]), group_numbers(back)


GAPS = "_block int, _first long, sums array<double>, best array<double>, back array<long>, v array<double>"


def _gap_blocks(levels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Gaps before each value, and after the last, as one row of arrays a block."""
    end = levels.groupBy(*keys).agg(F.lit(float("inf")).alias("v"), *[F.lit(0.0).alias(c) for c in COUNTS])
    rows = running_sums(levels.unionByName(end).withColumn("one", F.lit(1.0)), keys, ["v"], [*COUNTS, "one"])
    place = F.col("before_one").cast("long")
    rows = rows.withColumns({"_block": F.floor(place / BLOCK).cast("int"), "_first": place})
    packed = F.array_sort(F.collect_list(F.struct("_first", F.array(*[F.col(f"before_{c}") for c in COUNTS]).alias("s"), "v")))
    out = rows.groupBy(*keys, "_block").agg(F.min("_first").alias("_first"), packed.alias("p"))
    start = F.transform("p.v", lambda _, k: F.when((F.col("_first") == 0) & (k == 0), 0.0).otherwise(float("inf")))
    return out.select(
        *keys, "_block", "_first", F.flatten("p.s").alias("sums"), start.alias("best"), F.transform("p.v", lambda _: F.lit(0).cast("long")).alias("back"), F.col("p.v").alias("v")
    )


def _advance(keys: Sequence[str], done: int):
    """Multiply the finished block ``done`` into a later one, and finish the one right after it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        own = pdf.iloc[-1]
        sums, best, back = np.array(own["sums"]).reshape(-1, 4), np.array(own["best"]), np.array(own["back"])
        if done >= 0:
            src = pdf.iloc[0]
            multiply_in(np.array(src["sums"]).reshape(-1, 4), np.array(src["best"]), int(src["_first"]), sums, best, back)
        if own["_block"] == done + 1:
            finish(sums, best, back, int(own["_first"]))
        out = pdf.iloc[[-1]].drop(columns="_to").copy()
        out["best"], out["back"] = [best], [back]
        return out

    return run


def _large_partition(levels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Partitions of panels that are larger than a block."""
    open_ = checkpointed(_gap_blocks(levels, keys))
    schema, cores = open_.schema, levels.sparkSession.sparkContext.defaultParallelism
    last = open_.agg(F.max("_block")).first()[0]
    finished = []
    source: DataFrame | None = None
    for done in range(-1, last):
        pairs = open_.withColumn("_to", F.col("_block"))
        if source is not None:
            ends = open_.groupBy(*keys).agg(F.max("_block").alias("_end"))
            copies = attach(source, ends, keys).withColumn("_to", F.explode(F.sequence(F.lit(done + 1), F.col("_end")))).drop("_end")
            pairs = pairs.unionByName(copies)
        dealt = pairs.repartition(4 * cores, *keys, "_to")  # one block a group; a given number is not merged
        open_ = checkpointed(dealt.groupBy(*keys, "_to").applyInPandas(_advance(keys, done), schema))
        source = open_.where(F.col("_block") == done + 1)
        finished.append(source)
        open_ = open_.where(F.col("_block") > done + 1)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        group = group_numbers(np.concatenate(pdf["back"].to_list()))
        v, sums = np.concatenate(pdf["v"].to_list())[:-1], pdf["sums"].iloc[-1][-4:]
        row = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame({**row, "v": v, "grp": group, "bound": pdf["best"].iloc[-1][-1] / (sums[0] + sums[2]), "groups": group[-1] + 1})

    whole = reduce(DataFrame.unionByName, finished)
    return _grouped(whole, keys).applyInPandas(solve, _schema(levels, keys, "v double, grp long, bound double, groups long"))


def interval_partition(levels: DataFrame, keys: Sequence[str], prefix: str = "") -> DataFrame:
    """Group of every level and the partition's mean cost, per panel."""
    keys = list(keys)
    levels = checkpointed(levels.select(*keys, F.col("v").cast("double").alias("v"), *[F.col(f"{prefix}{c}").cast("double").alias(c) for c in COUNTS]))
    small, large = _split(levels, keys)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v")
        counts = pdf[list(COUNTS)].to_numpy(float)
        cost, group = cheapest_intervals(counts)
        total = counts[:, 0].sum() + counts[:, 2].sum()
        return pdf[[*keys, "v"]].assign(grp=group, bound=cost / total, groups=int(group.max()) + 1)

    out = _grouped(small, keys).applyInPandas(solve, _schema(levels, keys, "v double, grp long, bound double, groups long"))
    return out if large is None else out.unionByName(_large_partition(large, keys))


# --- isotonic maps -------------------------------------------------------------------


def _fit_large(levels: DataFrame, keys: Sequence[str], n: str, k: str, out: str) -> DataFrame:
    """Add the isotonic fit of ``k / n`` at each value of panels that are larger than a block."""
    place = running_sums(levels.withColumn("_one", F.lit(1.0)), keys, ["v"], ["_one"])
    rows = checkpointed(place.withColumn("_block", F.floor(F.col("before__one") / BLOCK).cast("int")).drop("_one", "before__one"))
    fields = ", ".join(f"{c} double" for c in ("_rows", "_right", "low", "high"))

    def pool(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf[n] > 0].sort_values("v")
        row = {c: pdf[c].iloc[0] for c in [*keys, "_block"]}
        if not len(own):
            return pd.DataFrame()
        mean = pool_adjacent((own[k] / own[n]).to_numpy(), own[n].to_numpy(float))
        part = np.cumsum(np.append(0, np.diff(mean) != 0))
        g = own.assign(part=part).groupby("part").agg(_rows=(n, "sum"), _right=(k, "sum"), low=("v", "min"), high=("v", "max"))
        return g.reset_index().assign(**row)

    parts = rows.groupBy(*keys, "_block").applyInPandas(pool, _schema(rows, [*keys, "_block"], f"part long, {fields}"))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("low")
        mean = pool_adjacent((pdf["_right"] / pdf["_rows"]).to_numpy(), pdf["_rows"].to_numpy(float))
        return pdf[[*keys, "_block", "low", "high"]].assign(mean=mean)

    fitted = checkpointed(_grouped(parts, keys).applyInPandas(merge, _schema(rows, [*keys, "_block"], "low double, high double, mean double")))
    # a block also needs the nearest parts before and after it
    blocks = rows.select(*keys, "_block").distinct()
    ends = fitted.groupBy(*keys, "_block").agg(
        F.min_by(F.struct("low", "high", "mean"), "low").alias("_a"), F.max_by(F.struct("low", "high", "mean"), "low").alias("_z")
    )
    w = Window.partitionBy(*keys).orderBy("_block")
    near = null_safe_join(blocks, ends, [*keys, "_block"], "left").withColumns({
        "_before": F.last("_z", True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "_after": F.first("_a", True).over(w.rowsBetween(1, Window.unboundedFollowing)),
    }).select(*keys, "_block", F.explode(F.array("_before", "_after")).alias("p"))
    knots = fitted.unionByName(near.where("p is not null").select(*keys, "_block", "p.low", "p.high", "p.mean"))
    both = rows.withColumns({c: F.lit(None).cast("double") for c in ("low", "high", "mean")}).unionByName(knots, allowMissingColumns=True)
    columns = levels.columns

    def predict(pdf: pd.DataFrame) -> pd.DataFrame:
        own, knot = pdf[pdf["mean"].isna()], pdf[pdf["mean"].notna()].sort_values("low")
        at, mean = knot[["low", "high"]].to_numpy().ravel(), np.repeat(knot["mean"].to_numpy(), 2)
        v = own["v"].to_numpy(float)
        return own[columns].assign(**{out: np.interp(v, at, mean) if len(at) else np.full(len(v), np.nan)})

    schema = T.StructType([*[f for f in rows.schema.fields if f.name in columns], T.StructField(out, T.DoubleType())])
    return both.groupBy(*keys, "_block").applyInPandas(predict, schema)


def isotonic_fits(levels: DataFrame, keys: Sequence[str], fits: dict[str, tuple[str, str]]) -> DataFrame:
    """Add, for each name, the isotonic fit of ``k / n`` at every value of a panel; null where a panel has no rows to fit."""
    keys = list(keys)
    levels = checkpointed(levels.withColumn("v", F.col("v").cast("double")))
    small, large = _split(levels, keys)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v")
        v = pdf["v"].to_numpy(float)
        found = {name: isotonic_predict(v, pdf[n].to_numpy(float), pdf[k].to_numpy(float), v) for name, (n, k) in fits.items()}
        return pdf.assign(**found)[schema.names]

    schema = T.StructType([*levels.schema.fields, *[T.StructField(c, T.DoubleType()) for c in fits]])
    found = _grouped(small, keys).applyInPandas(solve, schema)
    if large is not None:
        for name, (n, k) in fits.items():
            large = _fit_large(large, keys, n, k, name)
        found = found.unionByName(large)
    return found.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in fits})


def month_level_counts(df: DataFrame, confidence: str = "p_max", correct: str = "correct", post: str = "post", month: str = "month") -> DataFrame:
    """Counts per (month, period, score value): the input of every panel."""
    return df.groupBy(month, post, F.round(confidence, C.LEVEL_DIGITS).alias("v")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(correct).cast("double")).alias("k")
    )


def half_month_panels(counts: DataFrame, splits: int, seed: str = "cross", month: str = "month", post: str = "post") -> DataFrame:
    """Panels ``(split_no, direction, v)`` with fitting and held-out counts.

    Half of each period's months is drawn per split and used in both directions.
    """
    months = counts.select(post, month).distinct()
    t = months.withColumn("split_no", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    w = Window.partitionBy("split_no", post)
    rank = F.row_number().over(w.orderBy(key_hash(seed, month, "split_no"), month))
    t = t.withColumn("_a", rank <= F.floor(F.count(F.lit(1)).over(w) / 2))
    t = t.withColumn("direction", F.explode(F.array(F.lit(0), F.lit(1))))
    t = t.select(post, month, "split_no", "direction", (F.col("_a") == (F.col("direction") == 0)).alias("_fit"))
    j = counts.join(t, [post, month])
    aggs = []
    for name, fit in (("f_", True), ("h_", False)):
        for c, late, col in (("n_pre", False, "n"), ("k_pre", False, "k"), ("n_post", True, "n"), ("k_post", True, "k")):
            m = (F.col("_fit") == fit) & (F.col(post) == late)
            aggs.append(F.sum(F.when(m, F.col(col)).otherwise(0.0)).alias(f"{name}{c}"))
    return j.groupBy("split_no", "direction", "v").agg(*aggs)


def cross_fitted_maps(panels: DataFrame) -> DataFrame:
    """Held-out gaps per panel of a common map and of a map that knows the period."""
    keys = ["split_no", "direction"]
    both = panels.withColumns({"_n": F.col("f_n_pre") + F.col("f_n_post"), "_k": F.col("f_k_pre") + F.col("f_k_post")})
    t = isotonic_fits(both, keys, {"common": ("_n", "_k"), "aware_pre": ("f_n_pre", "f_k_pre"), "aware_post": ("f_n_post", "f_k_post")})
    t = t.withColumn("common", F.when(F.col("_n") > 0, F.col("_k") / F.col("_n")).otherwise(F.col("common")))
    gaps = []
    for s in ("pre", "post"):
        n, k = F.sum(f"h_n_{s}"), F.sum(f"h_k_{s}")
        for name, pred in (("common", "common"), ("aware", f"aware_{s}")):
            gaps.append(F.when(n > 0, (F.sum(F.col(f"h_n_{s}") * F.col(pred)) - k) / n).alias(f"{name}_{s}"))
    return t.groupBy(*keys).agg(*gaps)


def gap_summary(gaps: DataFrame) -> DataFrame:
    """Mean, smallest and largest held-out gap over the panels, one row per map and period."""
    names = ("common_pre", "common_post", "aware_pre", "aware_post")
    pairs = F.array(*[F.struct(F.lit(n).alias("map"), F.col(n).alias("gap")) for n in names])
    return gaps.select(F.inline(pairs)).groupBy("map").agg(
        F.avg("gap").alias("mean"), F.min("gap").alias("min"), F.max("gap").alias("max"), F.count(F.lit(1)).alias("splits")
    )


def partition_crossfit(df: DataFrame, splits: int, null_reps: int) -> DataFrame:
    """Value-wise and interval groupings: in sample, random-month null, month-half cross-fit."""
    counts = month_level_counts(df)
    fake = I.random_months(df, null_reps, "post", "month", "nullmonths")
    lv = C.level_table(df, []).withColumns({"panel": F.lit("in_sample"), "b": F.lit(0)})
    j = counts.join(fake, "month")

    def s(c: str, late: bool):
        return F.sum(F.when(F.col("fake") == late, F.col(c)).otherwise(0.0))

    null = j.groupBy("b", "v").agg(
        s("n", False).alias("n_pre"), s("k", False).alias("k_pre"), s("n", True).alias("n_post"), s("k", True).alias("k_post")
    ).withColumn("panel", F.lit("null"))
    both = lv.select("panel", "b", "v", *COUNTS).unionByName(null.select("panel", "b", "v", *COUNTS))
    bounds = interval_partition(both, ["panel", "b"]).groupBy("panel", "b").agg(F.max("bound").alias("bound"))
    obs = bounds.filter("panel = 'in_sample'").select(F.col("bound").alias("obs"))
    part = bounds.filter("panel = 'null'").join(F.broadcast(obs), F.lit(True)).agg(
        F.first("obs").alias("in_sample"), F.avg("bound").alias("null_mean"), F.percentile("bound", 0.95).alias("null_p95"),
        ((1 + F.count_if(F.col("bound") >= F.col("obs"))) / F.lit(float(null_reps + 1))).alias("p"),
    )
    panels = half_month_panels(counts, splits, "partition")
    keys = ["split_no", "direction"]
    grouped = panels.join(interval_partition(panels, keys, "f_").select(*keys, "v", "grp"), [*keys, "v"])

    def side(p: str, group: str) -> DataFrame:
        return grouped.select(*keys, F.col(group).cast("double").alias("g"), *[F.col(f"{p}{c}").alias(c) for c in COUNTS])

    def held(group: str, out: str) -> DataFrame:
        gaps = C.apply_levels(side("f_", group), side("h_", group), keys, "g")
        return gaps.agg(
            F.avg("held_out_gap").alias(f"{out}_mean"), F.min("held_out_gap").alias(f"{out}_min"), F.max("held_out_gap").alias(f"{out}_max")
        )

    return part.join(held("v", "valuewise"), F.lit(True)).join(held("grp", "interval"), F.lit(True))


def forward_chaining(df: DataFrame, min_train: int = 12) -> DataFrame:
    """Isotonic map of the earlier months tested on each later month, and the map frozen at the cutoff."""
    counts = month_level_counts(df)
    months = counts.select("month", "post").distinct()
    order = months.withColumn("_i", F.row_number().over(Window.orderBy("month")) - 1)
    tests = order.filter(F.col("_i") >= min_train).select(F.col("month").alias("t"), F.col("post").alias("late"))
    fit_to = F.array(
        F.struct(F.lit("expanding").alias("kind"), F.lit(True).alias("use")), F.struct(F.lit("frozen").alias("kind"), F.col("late").alias("use"))
    )
    tests = tests.select("t", "late", F.inline(fit_to)).filter("use").drop("use")
    j = counts.join(F.broadcast(tests), F.col("month") <= F.col("t"))
    train = (F.col("month") < F.col("t")) & ((F.col("kind") == "expanding") | ~F.col("post"))
    now = F.col("month") == F.col("t")
    panels = j.groupBy("kind", "t", "late", "v").agg(
        *[F.sum(F.when(m, F.col(c)).otherwise(0.0)).alias(f"{p}{c}") for p, m in (("f_", train), ("h_", now)) for c in ("n", "k")]
    )
    keys = ["kind", "t", "late"]
    t = isotonic_fits(panels, keys, {"pred": ("f_n", "f_k")})
    n, right = F.sum("h_n"), F.sum("h_k")
    return t.groupBy(*keys).agg(
        ((F.sum(F.col("h_n") * F.col("pred")) - right) / n).alias("gap"), ((F.sum(F.col("h_n") * F.col("v")) - right) / n).alias("raw_gap"), n.alias("n")
    )
