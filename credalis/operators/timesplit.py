"""Change points, cutoffs and matched coverage over monthly sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credalis.functions.seeded import key_hash
from credalis.operators import calibration as C
from credalis.operators import ranking as R
from credalis.operators import resample as B
from credalis.operators import tree
from credalis.operators.prefix import attach, hash_rank, key_sizes, null_safe_join

SENSITIVITY = tuple(f"1999-{m:02d}" for m in range(3, 12))
"""Cutoffs around the later period of the derived rows."""


def monthly(
    df: DataFrame, keys: Sequence[str], month: str = "month", correct: str = "correct",
    confidence: str = "p_max", weight: str | None = None,
) -> DataFrame:
    """Monthly count ``n``, correct ``k`` and confidence sum ``s``."""
    w = F.col(weight) if weight else F.lit(1.0)
    return df.groupBy(*keys, F.col(month).alias("month")).agg(
        F.sum(w).alias("n"), F.sum(w * F.col(correct).cast("double")).alias("k"), F.sum(w * F.col(confidence)).alias("s")
    )


def change_point(series: DataFrame, keys: Sequence[str], min_side: int = 6) -> DataFrame:
    """Best weighted two-mean split of a monthly series with ``n`` and ``k`` (sum of values).

    The within-side sum of squares is ``sum k^2/n - (sum k)^2 / sum n``, so running
    sums over the months of a key suffice. The earliest of equal splits wins;
    fewer than ``2 min_side`` months is an error.
    """
    w = Window.partitionBy(*keys).orderBy("month")
    back = w.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*keys)
    sq = F.col("k") * F.col("k") / F.col("n")
    t = series.withColumns(
        {
            "_i": F.row_number().over(w) - 1, "_m": F.count(F.lit(1)).over(everything),
            "_ln": F.sum("n").over(back), "_lk": F.sum("k").over(back),
            "_tn": F.sum("n").over(everything), "_tk": F.sum("k").over(everything), "_tq": F.sum(sq).over(everything),
        }
    )
    few = F.raise_error(F.lit(f"need at least {2 * min_side} months"))
    t = t.withColumn("_i", F.when(F.col("_m") < 2 * min_side, few.cast("int")).otherwise(F.col("_i")))
    t = t.filter((F.col("_i") >= min_side) & (F.col("_i") <= F.col("_m") - min_side))
    rn, rk = F.col("_tn") - F.col("_ln"), F.col("_tk") - F.col("_lk")
    sse = F.col("_tq") - F.col("_lk") * F.col("_lk") / F.col("_ln") - rk * rk / rn
    best = F.struct(
        F.round(sse, 9).alias("sse"), F.col("_i").alias("split"), F.col("month").alias("first_post_month"),
        (F.col("_lk") / F.col("_ln")).alias("pre_accuracy"), (rk / rn).alias("post_accuracy"),
    )
    found = t.groupBy(*keys).agg(F.min(best).alias("_b")).select(*keys, "_b.*").drop("sse")
    return found.withColumn("drop", F.col("pre_accuracy") - F.col("post_accuracy"))


def cutoff_stats(series: DataFrame, cutoffs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts, accuracies, later gap and confidence change per cutoff.

    ``cutoffs`` has ``cutoff`` and, when the cutoff depends on them, the keys.
    """
    shared = [k for k in keys if k in cutoffs.columns]
    j = null_safe_join(series, cutoffs, shared) if shared else series.join(F.broadcast(cutoffs), F.lit(True))
    late = F.col("month") >= F.col("cutoff")

    def side(c: str, is_post: bool) -> Column:
        return F.sum(F.when(late if is_post else ~late, F.col(c)).otherwise(0.0))

    n0, n1 = side("n", False), side("n", True)
    return j.groupBy(*keys, "cutoff").agg(
        n0.cast("long").alias("n_pre"), n1.cast("long").alias("n_post"),
        F.when(n0 > 0, side("k", False) / n0).alias("accuracy_pre"),
        F.when(n1 > 0, side("k", True) / n1).alias("accuracy_post"),
        F.when(n1 > 0, (side("s", True) - side("k", True)) / n1).alias("post_gap"),
        F.when((n0 > 0) & (n1 > 0), side("s", True) / n1 - side("s", False) / n0).alias("post_minus_pre_confidence"),
    )


def cutoff_table(spark, cutoffs: Sequence[str]) -> DataFrame:
    """Cutoffs as a small dimension table."""
    return spark.createDataFrame([(c,) for c in cutoffs], "cutoff string")


def within_month_draws(df: DataFrame, unit: Sequence[str], b: int, seed: str = "month", scheme: str = "tree") -> DataFrame:
    """Rows resampled inside each month: monthly sums per resample.

    Each month keeps its own resample, so only (month, b) sums are shuffled.
    """
    if scheme == "tree":
        return tree.sum_draws(df, ["month"], "p_max", "correct", b, seed).select("b", "month", "n", "k", "s")
    return monthly(B.item_weights(df.select(*unit, "month", "correct", "p_max"), unit, b, seed), ["b"], weight="w")


def selection_bootstrap(df: DataFrame, unit: Sequence[str], b: int, seed: str = "month", scheme: str = "tree") -> DataFrame:
    """Re-select the change point in every resample: month, drop and later gap per ``b``."""
    series = within_month_draws(df, unit, b, seed, scheme)
    found = change_point(series, ["b"])
    stats = cutoff_stats(series, found.select("b", F.col("first_post_month").alias("cutoff")), ["b"])
    return found.join(stats.withColumnRenamed("cutoff", "first_post_month"), ["b", "first_post_month"])


def block_selection_bootstrap(df: DataFrame, b: int, block: int = 6, seed: str = "block") -> DataFrame:
    """Month blocks drawn inside each period, joined end to end, split re-selected; band differences per ``b``."""
    months = df.select("post", "month").distinct()
    drawn = B.month_block_weights(months, "post", "month", b, block, seed)
    n_pre = months.agg(F.count_if(~F.col("post")).alias("_pre"))
    drawn = attach(drawn, n_pre, []).withColumn("t", F.col("pos") + F.when(F.col("post"), F.col("_pre")).otherwise(0))
    sums = monthly(df, ["post"])
    series = null_safe_join(drawn, sums, ["post", "month"]).select("b", F.lpad(F.col("t").cast("string"), 6, "0").alias("month"), "n", "k", "s")
    found = change_point(series, ["b"]).select("b", F.col("split").cast("int").alias("split"))
    bands = df.groupBy("post", "month", C.band_of(F.col("p_max"), C.COARSE_BANDS).alias("band")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col("correct").cast("double")).alias("_k")
    )
    j = null_safe_join(drawn, bands, ["post", "month"]).join(found, "b")
    late = F.col("t") >= F.col("split")
    per = j.groupBy("b", "band").agg(
        *[F.sum(F.when(m, F.col(c)).otherwise(0.0)).alias(f"{c}{s}") for s, m in (("0", ~late), ("1", late)) for c in ("_n", "_k")],
        F.first("split").alias("split"), F.first("_pre").alias("_pre"),
    )
    return per.select(
        "b", "band", (F.col("split") - F.col("_pre")).alias("shift"),
        F.when((F.col("_n0") > 0) & (F.col("_n1") > 0), F.col("_k0") / F.col("_n0") - F.col("_k1") / F.col("_n1")).alias("difference"),
    )


def split_selection(df: DataFrame, unit: Sequence[str], splits: int, seed: str = "split", scheme: str = "tree") -> DataFrame:
    """Select on half of each month, measure on the other half, per split."""
    if scheme == "tree":
        halves = tree.half_draws(df, ["month"], "p_max", "correct", splits, seed)
        return _measured(halves.select(F.col("b").alias("split_no"), F.col("half").alias("_find"), "month", "n", "k", "s"))
    base = df.select(*unit, "month", "correct", "p_max")
    t = base.withColumn("split_no", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    t = t.withColumn("_key", key_hash(seed, *unit, "split_no"))
    ranked = hash_rank(t, ["split_no", "month"], "_key", digits=2)
    halves = attach(ranked, key_sizes(base, ["month"], "_size"), ["month"]).withColumn(
        "_find", F.col("rank") <= F.floor(F.col("_size") / 2)
    )
    return _measured(monthly(halves, ["split_no", "_find"]))


def _measured(sums: DataFrame) -> DataFrame:
    """Selected on the half ``_find``, measured on the other."""
    found = change_point(sums.filter("_find").drop("_find"), ["split_no"])
    stats = cutoff_stats(
        sums.filter(~F.col("_find")).drop("_find"),
        found.select("split_no", F.col("first_post_month").alias("cutoff")), ["split_no"],
    )
    return stats.join(found.select("split_no", "drop"), "split_no")


def month_band_counts(df: DataFrame, edges: Sequence[float], keep: Sequence[str] = ("post",)) -> DataFrame:
    """Counts, correct and confidence sums per month and band."""
    return df.withColumn("band", C.band_of(F.col("p_max"), edges)).groupBy(*keep, "month", "band").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col("correct").cast("double")).alias("k"), F.sum("p_max").alias("s")
    )


def equal_confidence(df: DataFrame, b: int, edges: Sequence[float] = C.COARSE_BANDS, seed: str = "eq") -> DataFrame:
    """Band accuracy before and after with intervals from months drawn inside each period."""
    counts = month_band_counts(df, edges)
    w = B.cluster_weights(counts, ["post"], "month", b, seed)
    j = null_safe_join(counts, w, ["post", "month"])

    def acc(n: Column, k: Column, late: bool) -> Column:
        m = F.col("post") == late
        size = F.sum(F.when(m, n).otherwise(0.0))
        return F.when(size > 0, F.sum(F.when(m, k).otherwise(0.0)) / size)

    wn, wk = F.col("w") * F.col("n"), F.col("w") * F.col("k")
    draws = j.groupBy("b", "band").agg(acc(wn, wk, False).alias("pre"), acc(wn, wk, True).alias("post_acc"))
    draws = draws.withColumn("difference", F.col("pre") - F.col("post_acc"))
    iv = draws.groupBy("band").agg(
        *B.interval(draws, ["band"], "pre", out="pre_"), *B.interval(draws, ["band"], "post_acc", out="post_"),
        *B.interval(draws, ["band"], "difference", out="difference_"),
    )
    n, k = F.col("n"), F.col("k")
    est = counts.groupBy("band").agg(
        F.sum(F.when(~F.col("post"), n).otherwise(0.0)).cast("long").alias("n_pre"),
        F.sum(F.when(F.col("post"), n).otherwise(0.0)).cast("long").alias("n_post"),
        acc(n, k, False).alias("accuracy_pre"), acc(n, k, True).alias("accuracy_post"),
    )
    return est.join(iv, "band")


def alternative_cutoffs(df: DataFrame, cutoffs: Sequence[str], edges: Sequence[float] = C.COARSE_BANDS) -> DataFrame:
    """Band differences at fixed cutoffs, all from one table of (month, band) counts."""
    counts = month_band_counts(df, edges, ())
    j = counts.join(F.broadcast(cutoff_table(df.sparkSession, cutoffs)), F.lit(True))
    late = F.col("month") >= F.col("cutoff")

    def acc(m: Column) -> Column:
        n = F.sum(F.when(m, F.col("n")).otherwise(0.0))
        return F.when(n > 0, F.sum(F.when(m, F.col("k")).otherwise(0.0)) / n)

    return j.groupBy("cutoff", "band").agg((acc(~late) - acc(late)).alias("difference"))


def range_band_join(df: DataFrame, edges: Sequence[float] = C.FINE_BANDS, min_items: int = 30) -> DataFrame:
    """Every union of adjacent bands: counts per period and accuracy difference.

    Only the band table (one row per band, with running sums) meets itself.
    """
    lv = C.level_table(df.withColumn("band", C.band_of(F.col("p_max"), edges)).filter("band is not null"), [], "band", digits=0)
    dim = C.bands_table(df.sparkSession, edges).join(lv.withColumnRenamed("v", "band"), "band", "left").fillna(0.0)
    cols = ("n_pre", "k_pre", "n_post", "k_post")
    w = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    cum = dim.withColumns({f"_{c}": F.coalesce(F.sum(c).over(w), F.lit(0.0)) for c in cols})
    a = cum.select(F.col("band").alias("i"), F.col("low").alias("from"), *[F.col(f"_{c}").alias(f"a_{c}") for c in cols])
    b = cum.select(F.col("band").alias("j"), F.least("high", F.lit(1.0)).alias("to"), *[(F.col(f"_{c}") + F.col(c)).alias(f"b_{c}") for c in cols])
    u = a.join(b, F.col("i") <= F.col("j")).select("from", "to", *[(F.col(f"b_{c}") - F.col(f"a_{c}")).alias(c) for c in cols])
    u = u.filter((F.col("n_pre") >= min_items) & (F.col("n_post") >= min_items))
    return u.withColumn("difference", F.col("k_pre") / F.col("n_pre") - F.col("k_post") / F.col("n_post"))


def matched_coverage(
    df: DataFrame, keys: Sequence[str], shares: Sequence[float], scores: Sequence[str] = ("p_max", "p_known"),
    weight: str | None = None,
) -> DataFrame:
    """An abstention option against score thresholds at the option's own coverage.

    Rows have ``post``, ``base_ok``, ``answered``, ``opt_ok`` and the scores.
    ``shares`` are shares of the later period; each reweights two-period sums, so
    the rows are read once for all shares.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    late = F.col("post")

    def s(cond: Column | None, is_post: bool) -> Column:
        m = late if is_post else ~late
        if cond is not None:
            m = m & cond
        return F.sum(F.when(m, w).otherwise(0.0))

    answered, good = F.col("answered"), F.col("answered") & F.col("opt_ok")
    tot = df.groupBy(*keys).agg(
        s(None, False).alias("n0"), s(None, True).alias("n1"), s(answered, False).alias("a0"), s(answered, True).alias("a1"),
        s(good, False).alias("o0"), s(good, True).alias("o1"),
    )
    dim = df.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    share = F.col("share")
    u1, u0 = share / F.greatest("n1", F.lit(1.0)), (1 - share) / F.greatest("n0", F.lit(1.0))
    plan = tot.join(F.broadcast(dim), F.lit(True)).withColumns({"u0": u0, "u1": u1})
    mass = F.col("u1") * F.col("n1") + F.col("u0") * F.col("n0")
    took = F.col("u1") * F.col("a1") + F.col("u0") * F.col("a0")
    plan = plan.withColumns(
        {"coverage": took / mass, "option": (F.col("u1") * F.col("o1") + F.col("u0") * F.col("o0")) / F.greatest(took, F.lit(1e-12))}
    )
    out = plan.select(*keys, "share", "coverage", "option")
    for name in scores:
        ok = F.col("base_ok")
        lv = df.groupBy(*keys, F.col(name).alias("_score")).agg(
            s(None, False).alias("ln0"), s(None, True).alias("ln1"), s(ok, False).alias("lk0"), s(ok, True).alias("lk1")
        )
        use = attach(lv, plan.select(*keys, "share", "u0", "u1", "coverage"), keys)
        use = use.withColumns(
            {
                "_wt": F.col("u1") * F.col("ln1") + F.col("u0") * F.col("ln0"),
                "_gd": F.col("u1") * F.col("lk1") + F.col("u0") * F.col("lk0"),
            }
        )
        acc = R.weighted_accuracy_at(use, [*keys, "share"], "_score", "_wt", "_gd", "coverage")
        acc = acc.select(*keys, "share", F.col("accuracy").alias(name), F.col("achieved").alias(f"achieved_{name}"))
        out = null_safe_join(out, acc, [*keys, "share"])
    return out


def matched_coverage_interval(df: DataFrame, shares: Sequence[float], b: int, block: int = 6, scores: Sequence[str] = ("p_max", "p_known")) -> DataFrame:
    """Option minus threshold accuracy with month-block intervals, per share.

    Rows collapse to (month, scores, flags) counts before they meet the draws.
    """
    drawn = B.block_counts(B.month_block_weights(df, "post", "month", b, block), "post", "month")
    cols = ["post", "month", "base_ok", "answered", "opt_ok", *scores]
    counts = df.groupBy(*cols).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    rows = null_safe_join(counts, drawn, ["post", "month"]).withColumn("_w", F.col("_n") * F.col("w"))
    d = matched_coverage(rows, ["b"], shares, scores, "_w")
    aggs = []
    for s in scores:
        d = d.withColumn(f"d_{s}", F.col("option") - F.col(s))
        aggs += B.interval(d, ["share"], f"d_{s}", out=f"{s}_")
    return matched_coverage(df, [], shares, scores).join(d.groupBy("share").agg(*aggs), "share")
