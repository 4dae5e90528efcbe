"""How well a score ranks items: discrimination and selective prediction.

All metrics aggregate rows to (key, score) levels first. Ties collapse, the
shuffle carries levels instead of rows, and no hot score can skew a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credalis.functions.seeded import key_hash
from credalis.operators.prefix import (
    MAX_BUCKETS, attach, attach_rows, hot_buckets, null_safe_join, running_sums, score_edges, with_bucket,
)
from credalis.operators.selection import numbered_groups, take_first
from credalis.session import checkpointed


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def levels(
    df: DataFrame, keys: Sequence[str], score: str, positive: Column | str, weight: Column | str | None = None
) -> DataFrame:
    """Weight of positives and negatives per key and score value.

    Rows without a score or a label weigh nothing. They are not filtered out: a
    filter on a derived score would be pushed below its projection and compute
    the score twice.
    """
    w = F.lit(1.0) if weight is None else _col(weight).cast("double")
    y = _col(positive).cast("boolean")
    scored = F.col(score).isNotNull()
    return df.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(
        F.sum(F.when(scored & y, w).otherwise(0.0)).alias("pos"),
        F.sum(F.when(scored & ~y, w).otherwise(0.0)).alias("neg"),
    )


def auroc_of_levels(lv: DataFrame, keys: Sequence[str], edges: Sequence[float] | None = None) -> DataFrame:
    """AUROC from a level table with ``score``, ``pos`` and ``neg``."""
    cum = running_sums(lv, keys, ["score"], ["neg"], edges)
    won = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2))
    p, n = F.sum("pos"), F.sum("neg")
    return cum.groupBy(*keys).agg(
        F.when((p > 0) & (n > 0), won / (p * n)).alias("auroc"),
        (p + n).alias("n"), p.alias("n_positive"),
    )


def auroc(
    df: DataFrame, keys: Sequence[str], score: str, positive: Column | str,
    weight: Column | str | None = None, edges: Sequence[float] | None = None,
) -> DataFrame:
    """Mann-Whitney AUROC, ties half; null for a single class."""
    lv = levels(df, keys, score, positive, weight)
    if edges is None:
        lv = checkpointed(lv)  # edges, totals and running sums read the levels; the rows are read once
        edges = score_edges(lv, "score", keys=keys)
    return auroc_of_levels(lv, keys, edges)


def stratified_auroc(
    df: DataFrame, keys: Sequence[str], score: str, positive: Column | str, stratum: str
) -> DataFrame:
    """Size-weighted mean of the AUROCs of strata with both classes."""
    per = auroc(df, [*keys, stratum], score, positive)
    used = F.col("auroc").isNotNull()
    weight = F.sum(F.when(used, F.col("n")).otherwise(0.0))
    return per.groupBy(*keys).agg(
        F.when(weight > 0, F.sum(F.col("auroc") * F.col("n")) / weight).alias("auroc"),
        F.count_if(used).alias("strata_used"),
        weight.cast("long").alias("rows_covered"),
        F.sum("n").cast("long").alias("rows"),
    )


def weighted_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, weight: str | None, qs: Sequence[float],
    edges: Sequence[float] | None = None,
) -> DataFrame:
    """Linear percentiles ``q0, q1, ...`` of values repeated ``weight`` (whole) times.

    The exact ``percentile`` aggregate holds every distinct value of a group in
    one task; this one walks the level table, so a group may be of any size.
    """
    if edges is None:
        edges = score_edges(df, value, keys=keys)
    w = F.sum(weight) if weight else F.count(F.lit(1)).cast("double")
    lv = df.filter(F.col(value).isNotNull())
    lv = lv.groupBy(*keys, F.col(value).cast("double").alias("v")).agg(w.alias("w"))
    total = lv.groupBy(*keys).agg(F.sum("w").alias("total"))
    j = attach(running_sums(lv, keys, ["v"], ["w"], edges), total, keys)

    def at(rank: Column) -> Column:
        inside = (F.col("before_w") <= rank) & (rank < F.col("before_w") + F.col("w"))
        return F.max(F.when(inside, F.col("v")))

    picked, out = [], []
    for i, q in enumerate(qs):
        pos = F.lit(q) * (F.col("total") - 1)
        picked += [at(F.floor(pos)).alias(f"_lo{i}"), at(F.ceil(pos)).alias(f"_hi{i}")]
        picked.append(F.first(pos - F.floor(pos)).alias(f"_f{i}"))
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append((lo + (hi - lo) * F.col(f"_f{i}")).alias(f"q{i}"))
    return j.groupBy(*keys).agg(*picked).select(*keys, *out)


def fpr_at_tpr(
    df: DataFrame, keys: Sequence[str], score: str, positive: Column | str, tpr: float = 0.95,
    weight: str | None = None, edges: Sequence[float] | None = None,
) -> DataFrame:
    """Share of negatives at or above the score that catches ``tpr`` of positives."""
    if edges is None:
        edges = score_edges(df, score, keys=keys)
    y = _col(positive)
    base = df.select(*keys, F.col(score).alias("s"), y.alias("y"), (F.col(weight) if weight else F.lit(1.0)).alias("w"))
    base = base.groupBy(*keys, "s", "y").agg(F.sum("w").alias("w"))
    cut = weighted_percentiles(base.filter("y"), keys, "s", "w", [1 - tpr], edges).withColumnRenamed("q0", "q")
    neg = base.filter(~F.col("y"))
    j = attach(neg, cut, keys, "left")
    return j.groupBy(*keys).agg(
        F.when(
            F.count("q") > 0,
            F.sum(F.when(F.col("s") >= F.col("q"), F.col("w")).otherwise(0.0)) / F.sum("w"),
        ).alias("fpr")
    )


def falling_edges(df: DataFrame, score: str, keys: Sequence[str]) -> list[float]:
    """Bucket edges for descending order, found on the input rather than on its levels."""
    return score_edges(df.select(*keys, (-F.col(score).cast("double")).alias("_s")), "_s", keys=keys)


def ordered_rows(
    df: DataFrame, keys: Sequence[str], score: str, sums: dict[str, Column], tie: str
) -> DataFrame:
    """Rows by descending score then ``tie`` with 1-based ``k`` and inclusive ``cum_*``.

    ``tie`` is a hash string, e.g. of the unit: an explicit, stable stand-in for
    the input order a DataFrame does not have.
    """
    base = df.select(*df.columns, (-F.col(score)).alias("_neg"), F.lit(1.0).alias("_one"), *[c.alias(n) for n, c in sums.items()])
    cum = running_sums(base, keys, ["_neg", tie], ["_one", *sums])
    return cum.withColumns(
        {"k": F.col("before__one") + 1, **{f"cum_{s}": F.col(f"before_{s}") + F.col(s) for s in sums}}
    ).drop("_neg", "_one", "before__one", *[f"before_{s}" for s in sums])


def average_precision(
    df: DataFrame, keys: Sequence[str], score: str, positive: Column | str,
    ties: str = "average", tie: str | None = None, weight: Column | str | None = None,
) -> DataFrame:
    """Average precision; one threshold per tie group, or rows in ``tie`` order."""
    if ties == "input_order":
        rows = ordered_rows(df, keys, score, {"_hit": _col(positive).cast("double")}, tie)
        hits = F.sum("_hit")
        ap = F.sum(F.col("_hit") * F.col("cum__hit") / F.col("k")) / hits
        return rows.groupBy(*keys).agg(F.when(hits > 0, ap).alias("average_precision"))
    lv = levels(df, keys, score, positive, weight).withColumn("score", -F.col("score"))
    lv = lv.withColumn("all", F.col("pos") + F.col("neg"))
    cum = running_sums(lv, keys, ["score"], ["pos", "all"], falling_edges(df, score, keys))
    tp = F.col("before_pos") + F.col("pos")
    hits = F.sum("pos")
    ap = F.sum(F.col("pos") * tp / (F.col("before_all") + F.col("all"))) / hits
    return cum.groupBy(*keys).agg(F.when(hits > 0, ap).alias("average_precision"))


def _harmonic(n: Column) -> Column:
    """Harmonic number: exact sum for small n, asymptotic series above."""
    exact = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(30.0)).cast("int"), F.lit(1))),
        F.lit(0.0), lambda a, i: a + F.lit(1.0) / i,
    )
    series = (
        F.ln(n) + 0.5772156649015329 + 1 / (2 * n) - 1 / (12 * n * n) + 1 / (120 * F.pow(n, F.lit(4)))
        - 1 / (252 * F.pow(n, F.lit(6)))
    )
    return F.when(n < 1, 0.0).when(n <= 30, exact).otherwise(series)


def risk_coverage(
    df: DataFrame, keys: Sequence[str], confidence: str, correct: Column | str,
    coverages: Sequence[float] = (0.8, 0.9, 0.95), ties: str = "average", tie: str | None = None,
) -> DataFrame:
    """AURC, AUGRC and the risk at each coverage (``k = max(1, ceil(c n))``).

    Under ``average`` the risk inside a tie group of ``c`` rows after ``k0`` rows
    with ``e0`` errors is ``(e0 + r j) / (k0 + j)``; its sum over ``j`` is
    ``r c + (e0 - r k0)(H(k0 + c) - H(k0))``, so no tie group is ever expanded.
    """
    err = (~_col(correct).cast("boolean")).cast("double")
    if ties == "input_order":
        rows = ordered_rows(df, keys, confidence, {"_err": err}, tie)
        total = rows.groupBy(*keys).agg(F.max("k").alias("_n"))
        j = attach_rows(rows, total, keys)
        risk = F.col("cum__err") / F.col("k")
        out = [
            F.avg(risk).alias("aurc"),
            F.avg(F.col("cum__err") / F.col("_n")).alias("augrc"),
        ]
        for c in coverages:
            want = F.greatest(F.lit(1.0), F.ceil(F.lit(c) * F.col("_n")).cast("double"))
            out.append(F.max(F.when(F.col("k") == want, risk)).alias(f"risk_at_{int(c * 100)}"))
        return j.groupBy(*keys).agg(*out)
    lv = levels(df, keys, confidence, err.cast("boolean")).withColumn("score", -F.col("score"))
    lv = lv.withColumn("c", F.col("pos") + F.col("neg"))
    cum = running_sums(lv, keys, ["score"], ["pos", "c"], falling_edges(df, confidence, keys))
    total = lv.groupBy(*keys).agg(F.sum("c").alias("_n"))
    j = attach(cum, total, keys)
    c, e0, k0, n = F.col("c"), F.col("before_pos"), F.col("before_c"), F.col("_n")
    r = F.col("pos") / c
    risk_sum = r * c + (e0 - r * k0) * (_harmonic(k0 + c) - _harmonic(k0))
    gen_sum = e0 * c + r * c * (c + 1) / 2
    out = [
        (F.sum(risk_sum) / F.first("_n")).alias("aurc"),
        (F.sum(gen_sum) / (F.first("_n") * F.first("_n"))).alias("augrc"),
    ]
    for cov in coverages:
        want = F.greatest(F.lit(1.0), F.ceil(F.lit(cov) * n).cast("double"))
        inside = (k0 < want) & (want <= k0 + c)
        out.append(
            F.max(F.when(inside, (e0 + r * (want - k0)) / want)).alias(f"risk_at_{int(cov * 100)}")
        )
    return j.groupBy(*keys).agg(*out)


def selective_at(
    df: DataFrame, keys: Sequence[str], score: str, correct: Column | str, coverage: Column | float,
    confidence: str, tie: str, confident: float = 0.9,
) -> DataFrame:
    """Answer the ``coverage`` share with the highest score (half-even rounding).

    ``coverage`` may be a column that is constant inside each key.
    """
    cov = coverage if isinstance(coverage, Column) else F.lit(float(coverage))
    base = df.withColumns({"_ok": _col(correct).cast("boolean"), "_cov": cov})
    size = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max("_cov").alias("_share"))
    size = size.withColumn("_want", F.bround(F.col("_share") * F.col("_n"), 0).cast("long"))
    j = take_first(base, keys, -F.col(score), tie, checkpointed(size), "_want")
    answered = F.count_if("taken")
    return j.groupBy(*keys).agg(
        answered.alias("answered"),
        (answered / F.first("_n")).alias("coverage"),
        F.avg(F.when(F.col("taken"), F.col("_ok").cast("double"))).alias("selective_accuracy"),
        F.count_if(F.col("taken") & ~F.col("_ok")).alias("errors"),
        F.count_if(F.col("taken") & ~F.col("_ok") & (F.col(confidence) >= confident)).alias("confident_errors"),
    )


def weighted_accuracy_at(
    lv: DataFrame, keys: Sequence[str], score: str, weight: str, good: str, coverage: str,
    edges: Sequence[float] | None = None,
) -> DataFrame:
    """Weighted accuracy at an exact coverage, the crossing tie group taken in part.

    ``lv`` has one or more rows per (keys, score) with summed weight ``weight``,
    weight of right answers ``good`` and the target share ``coverage`` (constant
    inside a key). Zero weights are dropped.
    """
    used = lv.filter(F.col(weight) > 0)
    agg = used.groupBy(*keys, (-F.col(score)).alias("_neg")).agg(
        F.sum(weight).alias("_w"), F.sum(good).alias("_g"), F.max(coverage).alias("_cov")
    )
    cum = running_sums(agg, keys, ["_neg"], ["_w"], edges)
    total = agg.groupBy(*keys).agg(F.sum("_w").alias("_total"))
    j = attach(cum, total, keys)
    target = F.col("_cov") * F.col("_total")
    part = F.greatest(F.lit(0.0), F.least(F.col("_w"), target - F.col("before__w"))) / F.col("_w")
    taken = F.sum(part * F.col("_w"))
    return j.groupBy(*keys).agg(
        F.when(taken > 0, F.sum(part * F.col("_g")) / taken).alias("accuracy"),
        (taken / F.first("_total")).alias("achieved"),
    )


def average_ranks(
    df: DataFrame, keys: Sequence[str], value: str, out: str, weight: str | None = None,
    edges: Sequence[float] | None = None,
) -> DataFrame:
    """Average rank of each distinct value (ties share their mean rank)."""
    w = F.sum(weight) if weight else F.count(F.lit(1)).cast("double")
    lv = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(w.alias("_c"))
    lv = lv.withColumn("_v", F.col(value).cast("double"))
    cum = running_sums(lv, keys, ["_v"], ["_c"], edges)
    return cum.select(*keys, value, (F.col("before__c") + (F.col("_c") + 1) / 2).alias(out))


def _bucket_ranks(df: DataFrame, keys: Sequence[str], value: str, other: str, edges: Sequence[float], out: str) -> DataFrame:
    """Add the average rank of ``value`` under weights ``_w``: each row moves once, to its bucket.

    All rows of a bucket of one value share a rank that follows from the bucket sizes, so such a
    bucket is dealt by ``other`` and a hot value is no single task.
    """
    hot = [float(i) for i in hot_buckets(edges)]
    b = with_bucket(df.withColumn("_v", F.col(value).cast("double")), "_v", edges, "_b")
    sizes = b.groupBy(*keys, "_b").agg(F.sum("_w").alias("_size"))
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = checkpointed(sizes.withColumn("_before", F.coalesce(F.sum("_size").over(w), F.lit(0.0))))
    b = b.withColumn("_part", F.when(F.col("_b").isin(hot), F.pmod(F.xxhash64(other), F.lit(256))).otherwise(F.lit(0)) if hot else F.lit(0))
    at = Window.partitionBy(*keys, "_b", "_part")
    upto = at.orderBy("_v").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy(*keys, "_b", "_part", "_v")
    b = b.withColumns({"_upto": F.sum("_w").over(upto), "_same": F.sum("_w").over(same)})
    j = attach(b, F.broadcast(sizes) if sizes.count() <= MAX_BUCKETS * 32 else sizes, [*keys, "_b"])
    inside = F.col("_upto") - (F.col("_same") - 1) / 2
    rank = F.when(F.col("_b").isin(hot), (F.col("_size") + 1) / 2).otherwise(inside) if hot else inside
    return j.withColumn(out, F.col("_before") + rank).drop("_v", "_b", "_part", "_upto", "_same", "_size", "_before")


def spearman(
    df: DataFrame, keys: Sequence[str], x: str, y: str, weight: str | None = None,
    edges: tuple[Sequence[float], Sequence[float]] | None = None,
) -> DataFrame:
    """Pearson correlation of average ranks; null when either side is constant.

    Rows collapse to (x, y) pairs before ranks are joined. Where both scores have many values, pairs
    hardly collapse: each row then moves to its bucket of ``x`` and to its bucket of ``y``, and no rank is joined.
    """
    ex, ey = edges if edges is not None else (score_edges(df, x, keys=keys), score_edges(df, y, keys=keys))
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    if ex and ey:
        rows = both.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"))
        j = _bucket_ranks(_bucket_ranks(rows, keys, "_x", "_y", ex, "_rx"), keys, "_y", "_x", ey, "_ry")
    else:
        w = F.sum(weight) if weight else F.count(F.lit(1)).cast("double")
        pairs = both.groupBy(*keys, x, y).agg(w.alias("_w"))
        rx = average_ranks(pairs, keys, x, "_rx", "_w", ex)
        ry = average_ranks(pairs, keys, y, "_ry", "_w", ey)
        j = null_safe_join(null_safe_join(pairs, rx, [*keys, x]), ry, [*keys, y])
    n = F.sum("_w")
    mean = (n + 1) / 2
    wx, wy, c = F.col("_rx"), F.col("_ry"), F.col("_w")
    sxx = F.sum(c * wx * wx) - n * mean * mean
    syy = F.sum(c * wy * wy) - n * mean * mean
    sxy = F.sum(c * wx * wy) - n * mean * mean
    return j.groupBy(*keys).agg(
        F.when((sxx > 1e-9) & (syy > 1e-9), sxy / F.sqrt(sxx * syy)).alias("rho"), n.cast("long").alias("n")
    )


def rank_groups(df: DataFrame, keys: Sequence[str], value: str, groups: int, tie: str) -> DataFrame:
    """Equal-count groups by first-rank: group ``q`` holds ranks up to edge ``1 + (n-1)(q+1)/groups``."""
    size = checkpointed(df.groupBy(*keys).agg(F.count(value).alias("_n")))
    ends = F.array(*[1 + F.expr(f"{q + 1} * (_n - 1) div {groups}") for q in range(groups - 1)])
    return numbered_groups(df, keys, F.col(value).cast("double"), tie, size, ends).drop("_n")


def value_groups(df: DataFrame, keys: Sequence[str], value: str, groups: int) -> DataFrame:
    """Groups by percentile edges of the value itself: equal values share a group."""
    cuts = [i / groups for i in range(1, groups)]
    names = [f"q{i}" for i in range(groups - 1)]
    j = attach_rows(df, weighted_percentiles(df, keys, value, None, cuts), keys)
    above = sum(((F.col(value) > F.col(n)).cast("int") for n in names), F.lit(0))
    return j.withColumn("group", above).drop(*names)


def quantile_filter(df: DataFrame, keys: Sequence[str], value: str, q: float) -> DataFrame:
    """Rows at or below their group's ``q``-quantile."""
    cut = weighted_percentiles(df, keys, value, None, [q])
    return attach_rows(df, cut, keys).filter(F.col(value) <= F.col("q0")).drop("q0")


def with_tie(df: DataFrame, *unit: str) -> DataFrame:
    """Add ``tie``: the md5 of the unit, the explicit order of equal scores."""
    return df.withColumn("tie", key_hash("tie", *unit))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows per key; the limit is applied before the shuffle as well."""
    if not keys:
        return df.orderBy(*order).limit(k)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")
