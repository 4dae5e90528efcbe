"""Resampling intervals, tests and multiplicity adjustment.

``scheme`` chooses how rows are drawn: ``tree`` (resamples of a bounded table of score
buckets, ``operators.tree``, whose cost does not grow with the rows) or ``item`` (one
Poisson weight per row and resample, a check that plain SQL can repeat).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credalis.functions.seeded import key_hash
from credalis.functions.statfn import normal_cdf, normal_quantile, t_cdf
from credalis.operators import calibration as C
from credalis.operators import ranking as R
from credalis.operators import resample as B
from credalis.operators import tree
from credalis.operators.prefix import attach, hash_rank, null_safe_join, score_edges
from credalis.session import checkpointed

Metric = Callable[..., DataFrame]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def read_once(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns as a stored table: buckets, edges and estimates each read the rows, which may be costly to derive."""
    return checkpointed(df.select(*dict.fromkeys(columns)))


def item_draws(df: DataFrame, keys: Sequence[str], unit: Sequence[str], columns: Sequence[str], b: int, seed: str = "boot") -> DataFrame:
    """Resampled ``columns`` with weight ``w`` and resample ``b``."""
    return B.item_weights(df.select(*dict.fromkeys([*keys, *unit, *columns])), unit, b, seed)


def mean_draws(
    df: DataFrame, keys: Sequence[str], value: str, unit: Sequence[str], b: int,
    seed: str = "boot", scheme: str = "tree",
) -> DataFrame:
    """Bootstrap means ``(keys, b, stat)``."""
    if scheme == "tree":
        return tree.mean_draws(df, keys, value, b, seed)
    w = item_draws(df, keys, unit, [value], b, seed)
    return w.groupBy(*keys, "b").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("stat"))


def moved(draws: DataFrame, est: DataFrame, keys: Sequence[str], names: dict[str, str]) -> DataFrame:
    """Draws of bucketed statistics, moved by what bucketing changes in the estimate; ``names``: statistic -> its value on the buckets."""
    j = attach(draws, est.select(*keys, *[F.col(n).alias(f"_e_{n}") for n in names]), keys)
    return j.withColumns({n: F.col(n) + F.col(f"_e_{n}") - F.col(h) for n, h in names.items()}).drop(*[f"_e_{n}" for n in names], *names.values())


def tail_share(value: str, threshold: float, side: str = "ge") -> Column:
    """Share of replicates at or beyond a threshold; null replicates count as no."""
    hit = F.col(value) >= threshold if side == "ge" else F.col(value) <= threshold
    return F.avg(F.coalesce(hit, F.lit(False)).cast("double"))


def bootstrap_mean(
    df: DataFrame, keys: Sequence[str], value: str, unit: Sequence[str], b: int,
    threshold: float = 0.0, side: str = "ge", level: float = 0.95, seed: str = "boot", scheme: str = "tree",
) -> DataFrame:
    """Mean, percentile interval and tail share at a threshold."""
    if scheme == "tree":
        df = read_once(df, *keys, value)
    draws = mean_draws(df, keys, value, unit, b, seed, scheme)
    est = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    iv = draws.groupBy(*keys).agg(
        *B.interval(draws, keys, "stat", level), tail_share("stat", threshold, side).alias("tail")
    )
    return attach(est, iv, keys)


def bootstrap_stat(
    df: DataFrame, keys: Sequence[str], metric: Metric, value: str, unit: Sequence[str], columns: Sequence[str],
    b: int, seed: str = "boot", scheme: str = "tree", level: float = 0.95,
) -> DataFrame:
    """Interval of any metric: ``metric(rows, keys, weight)`` run with ``b`` among its keys.

    The tree scheme takes a score and a flag as ``columns``.
    """
    est = metric(df.withColumn("w", F.lit(1.0)), list(keys), "w").select(*keys, value)
    if scheme == "tree":
        table = tree.buckets(df, keys, *columns)
        here = metric(tree.bucket_rows(table, keys, *columns), list(keys), "w").select(*keys, F.col(value).alias("_here"))
        draws = metric(tree.weighted_draws(table, keys, *columns, b, seed), [*keys, "b"], "w")
        draws = moved(attach(draws, here, keys), est, keys, {value: "_here"})
    else:
        draws = metric(item_draws(df, keys, unit, columns, b, seed), [*keys, "b"], "w")
    return attach(est, B.percentile_interval(draws, keys, value, level), keys)


def cluster_mean_draws(df: DataFrame, keys: Sequence[str], value: str, cluster: str, b: int, seed: str = "boot") -> DataFrame:
    """Bootstrap means of pooled rows when whole clusters are drawn."""
    sums = df.groupBy(*keys, cluster).agg(F.count(value).alias("_n"), F.sum(value).alias("_s"))
    w = B.cluster_weights(sums, keys, cluster, b, seed)
    return null_safe_join(w, sums, [*keys, cluster]).groupBy(*keys, "b").agg(
        (F.sum(F.col("w") * F.col("_s")) / F.sum(F.col("w") * F.col("_n"))).alias("stat")
    )


def cluster_bootstrap(df: DataFrame, keys: Sequence[str], value: str, cluster: str, b: int, seed: str = "boot") -> DataFrame:
    """Mean with a cluster bootstrap interval."""
    draws = cluster_mean_draws(df, keys, value, cluster, b, seed)
    est = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count_distinct(cluster).alias("clusters"))
    return attach(est, B.percentile_interval(draws, keys, "stat"), keys)


def auroc_draws(
    df: DataFrame, keys: Sequence[str], score: str, positive: str, b: int, unit: Sequence[str] = (),
    cluster: str | None = None, seed: str = "boot", scheme: str = "tree", est: DataFrame | None = None,
) -> DataFrame:
    """AUROC per resample of items or whole clusters, from weighted score levels."""
    if cluster is None and scheme == "tree":
        est = R.auroc(df, keys, score, positive) if est is None else est
        return moved(tree.auroc_draws(df, keys, score, positive, b, seed), est, keys, {"auroc": "of_buckets"})
    edges = score_edges(df, score, keys=keys)
    if cluster is None:
        w = item_draws(df, keys, unit, [score, positive], b, seed)
        lv = R.levels(w, [*keys, "b"], score, positive, "w")
    else:
        base = R.levels(df, [*keys, cluster], score, positive)
        w = B.cluster_weights(base, keys, cluster, b, seed)
        lv = null_safe_join(base, w, [*keys, cluster]).groupBy(*keys, "b", "score").agg(
            F.sum(F.col("w") * F.col("pos")).alias("pos"), F.sum(F.col("w") * F.col("neg")).alias("neg")
        )
    return R.auroc_of_levels(lv, [*keys, "b"], edges)


def auroc_interval(
    df: DataFrame, keys: Sequence[str], score: str, positive: str, b: int, unit: Sequence[str] = (),
    cluster: str | None = None, threshold: float = 0.5, level: float = 0.95, seed: str = "boot", scheme: str = "tree",
) -> DataFrame:
    """AUROC, interval, counts and the share of replicates at or below a threshold."""
    if cluster is None and scheme == "tree":
        df = read_once(df, *keys, score, positive)
    est = R.auroc(df, keys, score, positive)
    draws = auroc_draws(df, keys, score, positive, b, unit, cluster, seed, scheme, est)
    iv = draws.groupBy(*keys).agg(
        *B.interval(draws, keys, "auroc", level), tail_share("auroc", threshold, "le").alias("tail")
    )
    return attach(est, iv, keys).withColumns(
        {"n": F.col("n").cast("long"), "n_positive": F.col("n_positive").cast("long")}
    )


def stack_scores(df: DataFrame, scores: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per score: ``(keep, name, score)``."""
    pairs = F.array(*[F.struct(F.lit(s).alias("name"), F.col(s).cast("double").alias("score")) for s in scores])
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.name", "_p.score")


def detection_interval(
    df: DataFrame, keys: Sequence[str], score: str, positive: str, unit: Sequence[str], b: int,
    seed: str = "boot", scheme: str = "tree",
) -> DataFrame:
    """AUROC and FPR at 95 % TPR with intervals; one-class resamples are skipped."""
    df = read_once(df, *keys, score, positive, *(unit if scheme == "item" else ()))
    edges = score_edges(df, score, keys=keys)
    est = attach(
        R.auroc(df, keys, score, positive, edges=edges).select(*keys, "auroc"),
        R.fpr_at_tpr(df, keys, score, positive, edges=edges), keys,
    )
    if scheme == "tree":
        both = tree.detection_draws(df, keys, score, positive, b, seed=seed)
        both = moved(both, est, keys, {"auroc": "auroc_buckets", "fpr": "fpr_buckets"})
    else:
        w = item_draws(df, keys, unit, [score, positive], b, seed)
        w = w.groupBy(*keys, "b", score, positive).agg(F.sum("w").alias("w"))
        kb = [*keys, "b"]
        both = null_safe_join(R.auroc(w, kb, score, positive, "w", edges), R.fpr_at_tpr(w, kb, score, positive, weight="w", edges=edges), kb)
    both = both.filter("auroc is not null")
    iv = both.groupBy(*keys).agg(
        *B.interval(both, keys, "auroc", out="auroc_"), *B.interval(both, keys, "fpr", out="fpr_")
    )
    return attach(est, iv, keys)


def paired_auroc_difference(
    df: DataFrame, keys: Sequence[str], a: str, c: str, positive: str, b: int, unit: Sequence[str] = (),
    cluster: str | None = None, seed: str = "boot", scheme: str = "tree",
) -> DataFrame:
    """AUROC(a) - AUROC(c) on the same resamples, with 95 % and 90 % intervals.

    Both scores ride on one set of draws.
    """
    kb = [*keys, "b", "name"]
    edges = score_edges(stack_scores(df, [a, c], keys), "score", keys=keys)

    def minus(t: DataFrame, by: Sequence[str]) -> DataFrame:
        def one(s: str) -> Column:
            return F.max(F.when(F.col("name") == s, F.col("auroc")))

        return t.groupBy(*by).agg((one(a) - one(c)).alias("diff"))

    est = minus(R.auroc(stack_scores(df, [a, c], [*keys, positive]), [*keys, "name"], "score", positive, edges=edges), keys)
    if cluster is not None:
        base = R.levels(stack_scores(df, [a, c], [*keys, cluster, positive]), [*keys, cluster, "name"], "score", positive)
        w = B.cluster_weights(df, keys, cluster, b, seed)
        lv = null_safe_join(base, w, [*keys, cluster]).groupBy(*kb, "score").agg(
            F.sum(F.col("w") * F.col("pos")).alias("pos"), F.sum(F.col("w") * F.col("neg")).alias("neg")
        )
        dd = minus(R.auroc_of_levels(lv, kb, edges), [*keys, "b"])
    elif scheme == "tree":
        dd = moved(tree.paired_auroc_draws(df, keys, a, c, positive, b, seed), est, keys, {"diff": "of_buckets"})
    else:
        w = item_draws(df, keys, unit, [a, c, positive], b, seed)
        stacked = stack_scores(w, [a, c], [*keys, "b", positive, "w"])
        dd = minus(R.auroc(stacked, kb, "score", positive, "w", edges), [*keys, "b"])
    iv = dd.groupBy(*keys).agg(*B.interval(dd, keys, "diff", 0.95), *B.interval(dd, keys, "diff", 0.90, "r90_"),
                               tail_share("diff", 0.0, "le").alias("tail"))
    return attach(est, iv, keys)


def mean_difference(
    df: DataFrame, keys: Sequence[str], value: str, group: str, unit: Sequence[str], b: int,
    seed: str = "boot", scheme: str = "tree",
) -> DataFrame:
    """Mean of ``group`` = true minus false with independent resamples of both."""
    draws = mean_draws(df, [*keys, group], value, unit, b, seed, scheme)

    def side(t: str, g: bool) -> Column:
        return F.max(F.when(F.col(group) == g, F.col(t)))

    d = draws.groupBy(*keys, "b").agg((side("stat", True) - side("stat", False)).alias("diff"))
    est = df.groupBy(*keys, group).agg(F.avg(value).alias("_m")).groupBy(*keys).agg(
        side("_m", True).alias("mean_a"), side("_m", False).alias("mean_b"),
        (side("_m", True) - side("_m", False)).alias("diff"),
    )
    iv = d.groupBy(*keys).agg(*B.interval(d, keys, "diff"), tail_share("diff", 0.0).alias("tail"))
    return attach(est, iv, keys)


def equivalence(
    df: DataFrame, keys: Sequence[str], value: str, margin: float, unit: Sequence[str], b: int,
    seed: str = "boot", scheme: str = "tree",
) -> DataFrame:
    """Bootstrap two one-sided check that a mean lies within a margin."""
    if scheme == "tree":
        df = read_once(df, *keys, value)
    draws = mean_draws(df, keys, value, unit, b, seed, scheme)
    iv = draws.groupBy(*keys).agg(
        *B.interval(draws, keys, "stat", 0.90),
        F.greatest(tail_share("stat", margin), tail_share("stat", -margin, "le")).alias("p"),
    )
    est = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return attach(est, iv, keys)


def spearman_interval(
    df: DataFrame, keys: Sequence[str], x: str, y: str, unit: Sequence[str], b: int,
    threshold: float = 0.0, seed: str = "boot", scheme: str = "tree",
) -> DataFrame:
    """Rank correlation with a bootstrap interval."""
    edges = (score_edges(df, x, keys=keys), score_edges(df, y, keys=keys))
    est = R.spearman(df, keys, x, y, edges=edges)
    if scheme == "tree":
        d = moved(tree.spearman_draws(df, keys, x, y, b, seed), est, keys, {"rho": "of_buckets"})
    else:
        d = R.spearman(item_draws(df, keys, unit, [x, y], b, seed), [*keys, "b"], x, y, "w", edges)
    iv = d.groupBy(*keys).agg(*B.interval(d, keys, "rho"), tail_share("rho", threshold, "le").alias("tail"))
    return attach(est, iv, keys)


def spearman_test(df: DataFrame, keys: Sequence[str], x: str, y: str, threshold: float = 0.0) -> DataFrame:
    """One-sided Fisher z test that the rank correlation exceeds a threshold."""
    r = R.spearman(df, keys, x, y)
    se = F.sqrt((1 + F.col("rho") * F.col("rho") / 2) / (F.col("n") - 3))
    z = (F.atanh("rho") - math.atanh(threshold)) / se
    return r.withColumn("z", z).withColumn("p", normal_cdf(-F.col("z")))


def t_tests(df: DataFrame, keys: Sequence[str], value: str, threshold: float, margin: float) -> DataFrame:
    """One-sided t-tests below and above a threshold, and two one-sided tests of a margin."""
    a = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("_sd")
    ).withColumn("se", F.col("_sd") / F.sqrt(F.col("n").cast("double")))
    dfree = (F.col("n") - 1).cast("double")

    def t(at: float, sign: int) -> Column:
        diff = sign * (F.col("mean") - at)
        return F.when(F.col("se") > 0, diff / F.col("se")).otherwise(float("-inf"))

    out = a.withColumns(
        {
            "p_below": t_cdf(t(threshold, 1), dfree), "p_above": t_cdf(t(threshold, -1), dfree),
            "_u": t_cdf(t(margin, 1), dfree), "_l": t_cdf(t(-margin, -1), dfree),
        }
    )
    return out.withColumn("p_equivalence", F.greatest("_u", "_l")).drop("_sd", "_u", "_l")


def sign_flip_test(
    df: DataFrame, keys: Sequence[str], diff: str, unit: Sequence[str], b: int, threshold: float = 0.0, seed: str = "flip",
    scheme: str = "tree",
) -> DataFrame:
    """Paired sign-flip permutation test that the mean difference is below a threshold."""
    base = df.select(*keys, *unit, (F.col(diff) - threshold).alias("_d"))
    if scheme == "tree":
        null = tree.flip_draws(base, keys, "_d", b, seed).withColumnRenamed("stat", "_null")
    else:
        null = B.signs(base, unit, b, seed).groupBy(*keys, "b").agg(F.avg(F.col("s") * F.col("_d")).alias("_null"))
    obs = base.groupBy(*keys).agg(F.count("_d").alias("n"), F.avg("_d").alias("_obs"))
    j = attach(null, obs, keys)
    return j.groupBy(*keys).agg(
        F.max("n").alias("n"), (F.max("_obs") + threshold).alias("mean"),
        ((1 + F.count_if(F.col("_null") <= F.col("_obs") + 1e-12)) / F.lit(float(b + 1))).alias("p"),
    )


def bca_bound(
    df: DataFrame, keys: Sequence[str], value: str, unit: Sequence[str], b: int, alpha: float = 0.05,
    side: str = "upper", seed: str = "boot", scheme: str = "tree",
) -> DataFrame:
    """One-sided BCa bound of a mean.

    The jackknife acceleration of a mean is ``sum d^3 / (6 (sum d^2)^1.5)`` with
    ``d = mean - x``: three moments, no leave-one-out pass. The percentile level
    follows from the bias share, so it is read off the sorted replicates.
    """
    draws = mean_draws(df, keys, value, unit, b, seed, scheme)
    x = F.col(value).cast("double")
    mom = df.groupBy(*keys).agg(
        F.avg(x).alias("mean"), F.count(x).alias("n"), F.sum(x).alias("_s1"), F.sum(x * x).alias("_s2"), F.sum(x * x * x).alias("_s3")
    )
    m, n = F.col("mean"), F.col("n")
    d2 = F.col("_s2") - n * m * m
    d3 = -(F.col("_s3") - 3 * m * F.col("_s2") + 3 * m * m * F.col("_s1") - n * m * m * m)
    est = mom.select(*keys, "mean", "n", F.when(d2 > 0, -d3 / (6 * F.pow(d2, F.lit(1.5)))).otherwise(0.0).alias("acc"))
    z_alpha = normal_quantile(1 - alpha if side == "upper" else alpha)
    j = attach(draws, est, keys)
    fields = [f for f in j.schema.fields if f.name in keys]
    keyed = j if keys else j.withColumn("_all", F.lit(0))
    group = list(keys) or ["_all"]
    schema = T.StructType([*fields, T.StructField("mean", T.DoubleType()), T.StructField("bound", T.DoubleType())])

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        v, mean, acc = np.sort(pdf["stat"].to_numpy(float)), float(pdf["mean"].iloc[0]), float(pdf["acc"].iloc[0])
        share = ((v < mean).sum() + 0.5 * (v == mean).sum()) / len(v)
        z0 = normal_quantile(min(max(share, 1e-9), 1 - 1e-9))
        z = z0 + (z0 + z_alpha) / (1 - acc * (z0 + z_alpha))
        q = 0.5 * math.erfc(-z / math.sqrt(2))
        row = {f.name: pdf[f.name].iloc[0] for f in fields}
        return pd.DataFrame([{**row, "mean": mean, "bound": float(np.quantile(v, q))}])

    return keyed.groupBy(*group).applyInPandas(finish, schema)


def holm(df: DataFrame, family: Sequence[str], p: str, out: str = "p_holm", order: Sequence[str] = ()) -> DataFrame:
    """Step-down adjusted p-values inside each family of results."""
    w = Window.partitionBy(*family).orderBy(p, *order)
    m = F.count(F.lit(1)).over(Window.partitionBy(*family))
    step = F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p))
    stepped = df.withColumn("_step", step)
    return stepped.withColumn(out, F.max("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


# --- nulls of the every-map bound ------------------------------------------------


def within_value_permutation(
    df: DataFrame, keys: Sequence[str], unit: Sequence[str], perms: int, confidence: str = "p_max",
    correct: str = "correct", post: str = "post", seed: str = "perm",
) -> DataFrame:
    """Bound per permutation with periods shuffled inside each value, row by row.

    Rows are ranked by hash inside (permutation, value); the first ``n_post``
    become the later period.
    """
    base = df.select(*keys, *unit, F.round(confidence, C.LEVEL_DIGITS).alias("v"), F.col(correct).alias("_ok"), F.col(post).alias("_post"))
    n_post = base.groupBy(*keys, "v").agg(F.count_if("_post").alias("_np"))
    drawn = base.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(perms - 1))))
    drawn = drawn.withColumn("_key", key_hash(seed, *unit, "b"))
    ranked = attach(hash_rank(drawn, [*keys, "b", "v"], "_key", digits=3), n_post, [*keys, "v"])
    shuffled = ranked.withColumn("_fake", F.col("rank") <= F.col("_np"))
    lv = C.level_table(shuffled, [*keys, "b"], "v", "_ok", "_fake")
    return C.every_map_lower_bound(lv, [*keys, "b"])


def _permuted_bound(t: dict[str, np.ndarray], draws: int, rng: np.random.Generator) -> list[np.ndarray]:
    n0, n1, right = t["n_pre"], t["n_post"], t["k_pre"] + t["k_post"]
    k1 = tree.without_replacement(right.astype(np.int64), (n0 + n1 - right).astype(np.int64), np.tile(n1.astype(np.int64), (draws, 1)), rng)
    gap = np.abs((right - k1) / np.maximum(n0, 1) - k1 / np.maximum(n1, 1))
    return [(np.minimum(n0, n1) * gap).sum(axis=1) / (n0 + n1).sum()]


def within_value_permutation_levels(levels: DataFrame, keys: Sequence[str], perms: int, seed: str = "perm") -> DataFrame:
    """The same null from the level table: correct answers per period are hypergeometric."""
    fields = ("v", "n_pre", "k_pre", "n_post", "k_post")
    return tree.draw(levels, keys, perms, seed, _permuted_bound, "lower_bound double", fields)


def random_months_null(
    df: DataFrame, perms: int, confidence: str = "p_max", correct: str = "correct", post: str = "post",
    month: str = "month", seed: str = "months",
) -> DataFrame:
    """Bound per permutation with a random set of months as the later period."""
    counts = df.groupBy(month, F.round(confidence, C.LEVEL_DIGITS).alias("v")).agg(
        F.count(F.lit(1)).cast("double").alias("_n"), F.sum(F.col(correct).cast("double")).alias("_k")
    )
    fake = random_months(df, perms, post, month, seed)
    j = counts.join(fake, month)
    lv = j.groupBy("b", "v").agg(
        F.sum(F.when(F.col("fake"), 0.0).otherwise(F.col("_n"))).alias("n_pre"),
        F.sum(F.when(F.col("fake"), 0.0).otherwise(F.col("_k"))).alias("k_pre"),
        F.sum(F.when(F.col("fake"), F.col("_n")).otherwise(0.0)).alias("n_post"),
        F.sum(F.when(F.col("fake"), F.col("_k")).otherwise(0.0)).alias("k_post"),
    )
    return C.every_map_lower_bound(lv, ["b"])


def random_months(df: DataFrame, perms: int, post: str, month: str, seed: str = "months") -> DataFrame:
    """Months times permutations with a flag for the randomly later months."""
    months = df.groupBy(month).agg(F.max(post).alias("_late"))
    size = months.agg(F.count_if("_late").alias("_k"))
    t = months.select(month, F.explode(F.sequence(F.lit(0), F.lit(perms - 1))).alias("b"))
    w = Window.partitionBy("b").orderBy(key_hash(seed, month, "b"), month)
    return attach(t.withColumn("_r", F.row_number().over(w)), size, []).select(
        month, "b", (F.col("_r") <= F.col("_k")).alias("fake")
    )


# --- smooth calibration error intervals ------------------------------------------


def _smece_stat(half: bool) -> tree.Stat:
    def stat(t: dict[str, np.ndarray], draws: int, rng: np.random.Generator) -> list[np.ndarray]:
        n = int(t["n0"].sum() + t["n1"].sum())
        size = n // 2 if half else n
        zero, one = tree.drawn_sides(t, draws, rng, size, not half)
        residual = np.zeros((draws, C.SMOOTH_GRID))
        residual[:, t["x"].astype(int)] = (one * (1 - t["m1"]) - zero * t["m0"]) / max(size, 1)
        return [C.smooth_eces(residual), np.full(draws, float(size))]

    return stat


def smece_draws(
    df: DataFrame, keys: Sequence[str], confidence: str, correct: str, b: int, unit: Sequence[str] = (),
    subsample: bool = False, seed: str = "smece", scheme: str = "tree",
) -> DataFrame:
    """Smooth ECE per resample; a half-sample draws ``n // 2`` without replacement.

    The tree scheme draws the cells of the calibration grid and solves a block of draws as one matrix.
    """
    if scheme == "tree":
        cells = C.grid_sides(df, keys, confidence, correct)
        return tree.draw(cells, keys, b, f"{seed} half" if subsample else seed, _smece_stat(subsample), "smece double, n double", ("x", "n0", "m0", "n1", "m1"))
    if subsample:
        w = B.half_sample(df.select(*keys, *unit, confidence, correct), keys, unit, b, seed).withColumn("w", F.lit(1.0))
    else:
        w = item_draws(df, keys, unit, [confidence, correct], b, seed)
    return C.smece(w, [*keys, "b"], confidence, correct, "w")


def smece_interval(
    df: DataFrame, keys: Sequence[str], confidence: str, correct: str, b: int, unit: Sequence[str] = (),
    threshold: float = 0.05, seed: str = "smece", scheme: str = "tree",
) -> DataFrame:
    """Smooth ECE with a bias-recentred interval; every group uses all ``b`` resamples."""
    est = C.smece(df, keys, confidence, correct).withColumnRenamed("smece", "est")
    draws = attach(smece_draws(df, keys, confidence, correct, b, unit, False, seed, scheme).drop("n"), est, keys)
    bias = draws.groupBy(*keys).agg((F.avg("smece") - F.first("est")).alias("bias"), F.count(F.lit(1)).alias("resamples"))
    centred = attach(draws, bias, keys).withColumn("stat", F.col("smece") - F.col("bias"))
    iv = centred.groupBy(*keys).agg(
        F.first("est").alias("smece"), F.first("n").cast("long").alias("n"), F.first("bias").alias("bias"),
        F.first("resamples").alias("resamples"), *B.interval(centred, keys, "stat"), tail_share("stat", threshold).alias("tail"),
    )
    base = df.groupBy(*keys).agg(
        F.avg(confidence).alias("mean_confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy")
    )
    return attach(iv, base, keys)


def smece_bounds(
    df: DataFrame, keys: Sequence[str], confidence: str, correct: str, b: int, unit: Sequence[str],
    alpha: float = 0.05, reference: float = 0.05, seed: str = "smece",
) -> DataFrame:
    """Upper bounds and tail shares under four schemes, one row per scheme."""
    est = C.smece(df, keys, confidence, correct).withColumnRenamed("smece", "est")
    boot = attach(smece_draws(df, keys, confidence, correct, b, unit, False, seed).drop("n"), est, keys)
    mean = boot.groupBy(*keys).agg(F.avg("smece").alias("_mean"))
    boot = checkpointed(attach(boot, mean, keys))  # few numbers, read by three schemes
    sub = attach(smece_draws(df, keys, confidence, correct, b, unit, True, seed).drop("n"), est, keys)
    e, s = F.col("est"), F.col("smece")
    shrink = F.sqrt(F.floor(F.col("n") / 2) / F.col("n"))
    shift = F.col("_mean") - e
    schemes = {
        "percentile": (boot, s, s), "recentred": (boot, s - shift, s - shift), "basic": (boot, 2 * e - s, 2 * e - s),
        "subsample": (sub, e - (s - e) * shrink, e - (s - e) * shrink),
    }
    out: DataFrame | None = None
    for name, (t, value, tail) in schemes.items():
        v = t.withColumns({"_v": value, "_t": tail})
        row = v.groupBy(*keys).agg(
            F.percentile("_v", 1 - alpha).alias("upper"), F.percentile("_v", alpha).alias("low"),
            F.avg((F.col("_t") >= reference).cast("double")).alias("tail"), F.first("est").alias("smece"),
        ).withColumn("scheme", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out
