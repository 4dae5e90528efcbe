"""Grouped summaries: plain conditional aggregates in one pass per table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credalis.functions import dist as D
from credalis.functions.seeded import key_hash
from credalis.operators.prefix import FEW_KEYS, attach, few_values, hash_rank, null_safe_join, score_edges
from credalis.operators.ranking import weighted_percentiles
from credalis.session import checkpointed


def _f(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def mean_if(value: Column | str, cond: Column) -> Column:
    """Mean over the rows that meet a condition; null when there are none."""
    return F.avg(F.when(cond, _f(value)))


def group_summary(df: DataFrame, sets: Sequence[Sequence[str]], means: Sequence[str] = ("p_max", "p_known")) -> DataFrame:
    """Count, accuracy, means and gap for several key sets in one pass (grouping sets)."""
    cols = list(dict.fromkeys(c for s in sets for c in s))
    base = df.select(*cols, _f("correct").alias("_ok"), *means)
    out = base.groupingSets([tuple(F.col(c) for c in s) for s in sets], *[F.col(c) for c in cols]).agg(
        F.grouping_id().cast("long").alias("grouping"), F.count(F.lit(1)).alias("n"), F.avg("_ok").alias("accuracy"),
        *[F.avg(m).alias(f"mean_{m}") for m in means], F.avg(F.col(means[0]) - F.col("_ok")).alias("gap"),
    )
    return out


def proper_scores(df: DataFrame, keys: Sequence[str], eps: float = D.TEMPER_FLOOR) -> DataFrame:
    """Brier, log loss, zero-on-answer share and uniform references."""
    k = F.size("dist").cast("double")
    p = D.prob("dist", F.col("gold"))
    return df.filter(F.col("gold").isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(_f("correct")).alias("accuracy"), F.avg(D.brier("dist", "gold")).alias("brier"),
        F.avg(D.log_score("dist", "gold", eps)).alias("log_loss"), F.avg(_f(p == 0)).alias("zero_on_answer"),
        F.avg(1 - 1 / k).alias("uniform_brier"), F.avg(F.ln(k)).alias("uniform_log_loss"),
    )


def coverage_table(df: DataFrame, keys: Sequence[str], declined: str, confident: float = 0.9) -> DataFrame:
    """Coverage, accuracy of answered rows and confident errors, per condition and period."""
    answered = F.col("top") != declined
    wrong = answered & ~F.col("correct") & (F.col("p_max") >= confident)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(_f(answered)).alias("coverage"),
        mean_if("correct", answered).alias("accuracy_answered"), F.avg(_f(wrong)).alias("confident_errors_of_all"),
        mean_if(wrong, answered).alias("confident_errors_of_answered"),
    )


def label_balance(df: DataFrame, min_items: int = 30) -> DataFrame:
    """Answer mix by period, by category and period, and by month, as one long table.

    Rows have ``gold_no``, ``pred_no``, ``correct``, ``post``, ``category``, ``month``.
    """
    no, said = F.col("gold_no"), F.col("pred_no")
    base = df.select("post", "category", "month", "gold_no", "pred_no", "correct")
    sets = [("post",), ("post", "category"), ("post", "month")]
    out = base.groupingSets([tuple(F.col(c) for c in s) for s in sets], F.col("post"), F.col("category"), F.col("month")).agg(
        F.grouping_id().cast("long").alias("grouping"), F.count(F.lit(1)).alias("n"), F.avg(_f(no)).alias("true_no"),
        F.avg(_f(said)).alias("predicted_no"), F.avg(_f("correct")).alias("accuracy"),
        mean_if("correct", said).alias("accuracy_predicting_no"), mean_if("correct", ~said).alias("accuracy_predicting_yes"),
        mean_if("correct", no).alias("accuracy_on_no"), mean_if("correct", ~no).alias("accuracy_on_yes"),
    )
    by_category = F.col("grouping") == 1
    return out.filter(~by_category | (F.col("n") >= min_items))


def mix_shift(df: DataFrame) -> DataFrame:
    """Category mix distance between periods and the within-category drop weighted by later rows."""
    late = F.col("post")
    c = df.groupBy("category").agg(
        F.count_if(~late).cast("double").alias("n0"), F.count_if(late).cast("double").alias("n1"),
        mean_if("correct", ~late).alias("a0"), mean_if("correct", late).alias("a1"),
    )
    tot = c.agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"))
    j = attach(c, tot, [])
    both = (F.col("n0") > 0) & (F.col("n1") > 0)
    w = F.sum(F.when(both, F.col("n1")))
    return j.agg(
        (F.sum(F.abs(F.col("n0") / F.col("t0") - F.col("n1") / F.col("t1"))) / 2).alias("category_share_tv"),
        (F.sum(F.when(both, (F.col("a0") - F.col("a1")) * F.col("n1"))) / w).alias("within_category_drop"),
    )


def month_ranges(balance: DataFrame) -> DataFrame:
    """Range of the monthly share of true "no", per period."""
    return balance.filter("grouping = 2").groupBy("post").agg(
        F.min("true_no").alias("low"), F.max("true_no").alias("high"), F.count(F.lit(1)).alias("months")
    )


def threshold_coverage(df: DataFrame, keys: Sequence[str], thresholds: Sequence[float] = (0.5, 0.7, 0.9)) -> DataFrame:
    """Coverage and accuracy at fixed thresholds, and the confident-wrong rate."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for t in thresholds:
        keep = F.col("p_max") >= t
        aggs += [F.avg(_f(keep)).alias(f"coverage_{int(t * 100)}"), mean_if("correct", keep).alias(f"accuracy_{int(t * 100)}")]
    wrong = (F.col("p_max") >= thresholds[-1]) & ~F.col("correct")
    return df.groupBy(*keys).agg(*aggs, F.avg(_f(wrong)).alias("confident_wrong"))


def scope_rates(df: DataFrame, keys: Sequence[str], outside: str = "out_of_scope") -> DataFrame:
    """In-scope accuracy, out-of-scope recall and false alarms under two rules."""
    oos = F.col("oos")
    rejected, unfit = F.col("with_oos_choice") == outside, F.col("p_fits") < 0.5
    return df.groupBy(*keys).agg(
        F.count_if(~oos).alias("n_in_scope"), F.count_if(oos).alias("n_oos"),
        mean_if(F.col("closed_choice") == F.col("gold"), ~oos).alias("accuracy_closed"),
        mean_if(F.col("with_oos_choice") == F.col("gold"), ~oos).alias("accuracy_with_oos"),
        mean_if(rejected, oos).alias("recall_with_oos"), mean_if(rejected, ~oos).alias("false_alarm_with_oos"),
        mean_if(unfit, oos).alias("recall_fits"), mean_if(unfit, ~oos).alias("false_alarm_fits"),
    )


MID = (0.05, 0.95)
REFERENCE_N = 100
"""Mid-range bounds and the reference sample size of the binomial ratio (fixed values)."""


def replicate_variance(long: DataFrame, keys: Sequence[str], series: Sequence[str], dist_options: Sequence[str] = ()) -> DataFrame:
    """Pooled effective sample size ``sum p(1-p) / sum var`` and variance ratio range.

    ``long`` is (keys, series, option, p), one row per replicate. With few options in all, a
    series is one row of the exchange, with a column of sums for each option. With ``dist_options``,
    rows are (keys, series, dist) over exactly these: no pass looks for options, no row is repeated for each.
    """
    options = dist_options or few_values(long, "option")
    if dist_options:
        rows = long.select(*keys, *series, *[x.alias(f"_p{i}") for i, x in enumerate(D.exactly("dist", options))])
        k = range(len(options))
        wide = rows.groupBy(*keys, *series).agg(*[a for i in k for a in (F.avg(f"_p{i}").alias(f"_m{i}"), F.var_samp(f"_p{i}").alias(f"_v{i}"))])
        per = wide.select(*keys, F.inline(F.array(*[F.struct(F.col(f"_m{i}").alias("m"), F.col(f"_v{i}").alias("v")) for i in k])))
    elif options is None:
        per = long.groupBy(*keys, *series, "option").agg(F.avg("p").alias("m"), F.var_samp("p").alias("v"))
    else:
        own = [F.when(F.col("option").eqNullSafe(F.lit(o)), F.col("p")) for o in options]
        wide = long.groupBy(*keys, *series).agg(*[a for i, x in enumerate(own) for a in (F.avg(x).alias(f"_m{i}"), F.var_samp(x).alias(f"_v{i}"))])
        per = wide.select(*keys, F.inline(F.array(*[F.struct(F.col(f"_m{i}").alias("m"), F.col(f"_v{i}").alias("v")) for i in range(len(options))])))
    mid = per.filter((F.col("m") >= MID[0]) & (F.col("m") <= MID[1]))
    pq = F.col("m") * (1 - F.col("m"))
    ratio = F.col("v") / (pq / REFERENCE_N)
    return mid.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("options"), F.when(F.sum("v") > 0, F.sum(pq) / F.sum("v")).alias("pooled_n"),
        F.min(ratio).alias("ratio_min"), F.max(ratio).alias("ratio_max"), F.avg(ratio).alias("ratio_mean"),
    )


def top2_correlation(answers: DataFrame, series: Sequence[str]) -> DataFrame:
    """Correlation across replicates of the two options with the highest mean.

    Means come from a first aggregate; the two winners are joined back, so no
    series is collected, and one with most of the rows is not dealt to one task.
    """
    long = answers.select(*series, "dist", F.posexplode("options").alias("pos", "option"))
    means = long.groupBy(*series, "option").agg(F.avg(D.prob("dist", F.col("option"))).alias("m"), F.min("pos").alias("pos"))
    order = F.struct(F.col("m"), (-F.col("pos")).alias("pos"), F.col("option"))
    # the two largest per series without a sort of the whole series
    best = means.groupBy(*series).agg(F.max(order).alias("_b1"))
    rest = null_safe_join(means, best, series).filter(F.col("option") != F.col("_b1.option"))
    two = rest.groupBy(*series).agg(F.first("_b1.option").alias("_o1"), F.max(order)["option"].alias("_o2"))
    two = checkpointed(two)
    # with few series, their answers stay where they are
    j = attach(answers.select(*series, "dist"), F.broadcast(two) if two.count() <= FEW_KEYS else two, series)
    a, b = D.prob("dist", F.col("_o1")), D.prob("dist", F.col("_o2"))
    return j.groupBy(*series).agg(
        F.when((F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.corr(a, b)).alias("top2_corr")
    )


def cost_latency_summary(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """n, min, median, max and mean of each column per group, long format."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), _f(c).alias("value")) for c in columns])
    long = df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.metric", "_p.value").filter("value is not null")
    k = [*keys, "metric"]
    agg = long.groupBy(*k).agg(
        F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean")
    )
    med = weighted_percentiles(long, k, "value", None, [0.5], score_edges(long, "value")).withColumnRenamed("q0", "median")
    return null_safe_join(agg, med, k)


def order_averaged_tv(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distance of the mean distribution over orders from the ideal, per key.

    Rows have ``dist``, ``ideal`` (constant per key) and ``options`` in shown order.
    """
    long = df.select(*keys, "dist", F.explode("ideal").alias("label", "q"))
    mean = long.groupBy(*keys, "label").agg(F.avg(D.prob("dist", F.col("label"))).alias("p"), F.first("q").alias("q"))
    return mean.groupBy(*keys).agg((F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("tv_of_mean"))


def by_label_and_position(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean probability and top counts by label and by shown position, long format."""
    top = D.top_option("dist", "options")
    long = df.select(*keys, "dist", top.alias("_top"), F.posexplode("options").alias("position", "label"))
    p = D.prob("dist", F.col("label"))
    sets = [(*keys, "label"), (*keys, "position")]
    base = long.select(*keys, "label", "position", p.alias("p"), (F.col("_top") == F.col("label")).alias("is_top"))
    return base.groupingSets([tuple(F.col(c) for c in s) for s in sets], *[F.col(c) for c in (*keys, "label", "position")]).agg(
        F.avg("p").alias("mean_p"), F.count_if("is_top").alias("top_count")
    )


def averaging_curve(df: DataFrame, keys: Sequence[str], unit: Sequence[str], sizes: Sequence[int], draws: int, seed: str = "orders") -> DataFrame:
    """Mean distance from the ideal when ``k`` random orders are averaged.

    A draw takes the ``k`` smallest hashes of a key; nested sizes share a draw,
    so each draw is ranked once for all sizes. Hashes above a bound that leaves enough of
    them are dropped where they are made, so neither a sort nor a shuffle sees every row.
    """
    keys, most = list(keys), max(sizes)
    base = df.select(*keys, *unit, "dist", "ideal")
    rows = checkpointed(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    sized = attach(df.select(*keys, *unit), F.broadcast(rows) if rows.count() <= FEW_KEYS else rows, keys)
    sized = sized.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_key", key_hash(seed, *unit, "draw"))
    w = Window.partitionBy(*keys, "draw").orderBy("_key")
    room = 4 * most
    while True:
        # hashes are uniform: only those below a share of their range can be among the smallest
        cut = F.lpad(F.lower(F.hex((F.lit(room * 2.0**32) / F.col("_n")).cast("long"))), 8, "0")
        low = sized.filter((F.col("_n") <= room) | (F.col("_key") < cut)).drop("_n")
        t = checkpointed(low.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_key"))
        got = attach(rows, t.groupBy(*keys).agg(F.count(F.lit(1)).alias("_got")), keys, "left")
        if got.filter(F.coalesce("_got", F.lit(0)) < draws * F.least("_n", F.lit(most))).isEmpty():
            break
        room *= 16  # many rows of one unit share their hash
    t = null_safe_join(base, t, [*keys, *unit])
    ks = F.array(*[F.lit(int(k)) for k in sizes])
    t = t.withColumn("k", F.explode(F.filter(ks, lambda k: k >= F.col("_r"))))
    long = t.select(*keys, "draw", "k", "dist", F.explode("ideal").alias("label", "q"))
    mean = long.groupBy(*keys, "draw", "k", "label").agg(F.avg(D.prob("dist", F.col("label"))).alias("p"), F.first("q").alias("q"))
    tv = mean.groupBy(*keys, "draw", "k").agg((F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("tv"))
    return tv.groupBy(*keys, "k").agg(F.avg("tv").alias("mean_tv"))


def mode_share(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mass on the ideal's modes and how often the top option is a mode or is listed first."""
    peak = F.array_max(F.map_values("ideal"))
    modes = F.map_keys(F.map_filter("ideal", lambda k, q: q >= peak - 1e-12))
    top = D.top_option("dist", "options")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(D.subset_mass("dist", modes)).alias("mass_on_modes"),
        F.avg(_f(F.array_contains(modes, top))).alias("top_is_mode"), F.avg(_f(top == F.element_at("options", 1))).alias("top_is_first"),
        F.avg(F.array_max(F.map_values("dist"))).alias("mean_p_max"),
    )


def human_agreement(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distances to the annotators' distribution, with uniform, majority and small-panel baselines."""
    uniform = F.transform_values("human", lambda k, v: F.lit(1.0) / F.size("human"))
    majority = F.array_max(F.transform(F.map_entries("human"), lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k"))))["k"]
    one_hot = F.create_map(majority, F.lit(1.0))
    panel = F.col("panel").isNotNull()
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(D.tv_distance("dist", "human")).alias("model_tv"),
        F.avg(D.js_divergence("dist", "human")).alias("model_js"), F.avg(D.tv_distance(uniform, F.col("human"))).alias("uniform_tv"),
        F.avg(D.tv_distance(one_hot, F.col("human"))).alias("majority_tv"), F.avg(D.tv_distance("panel", "human")).alias("panel_tv"),
        F.avg(F.when(panel, D.tv_distance("dist", "human"))).alias("model_tv_same_items"),
    )


def paired_proposals(df: DataFrame, keys: Sequence[str], item: Sequence[str]) -> DataFrame:
    """Two opposite proposals per item: sums, rejecting or accepting both, implied answer.

    Rows are (item, proposed yes/no, p_correct, p_wrong, gold_yes).
    """
    def pick(c: str, v: str) -> Column:
        return F.max(F.when(F.col("proposed") == v, F.col(c)))

    wide = df.groupBy(*keys, *item).agg(
        pick("p_correct", "yes").alias("py"), pick("p_correct", "no").alias("pn"), pick("p_wrong", "yes").alias("wy"),
        pick("p_wrong", "no").alias("wn"), F.bool_or("gold_yes").alias("gold_yes"),
    )
    py, pn, wy, wn = (F.col(c) for c in ("py", "pn", "wy", "wn"))
    implied, negated = py > pn, wn > wy
    return wide.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(py + pn).alias("mean_sum"), F.avg(_f((py < 0.5) & (pn < 0.5))).alias("rejects_both"),
        F.avg(_f((py > 0.5) & (pn > 0.5))).alias("accepts_both"), F.avg(_f(implied)).alias("implied_yes"),
        F.avg(_f(implied == F.col("gold_yes"))).alias("implied_accuracy"), F.avg(py + wy).alias("coherence_yes"),
        F.avg(pn + wn).alias("coherence_no"), F.avg(_f(implied == negated)).alias("implied_agree"), F.avg(wy - wn).alias("wrong_yes_minus_no"),
    )


def arm_contrast(df: DataFrame, keys: Sequence[str], item: Sequence[str], value: str, arms: tuple[str, str]) -> DataFrame:
    """Means per arm, paired difference and share higher in the first arm."""
    def pick(a: str) -> Column:
        return F.avg(F.when(F.col("arm") == a, F.col(value)))

    wide = df.groupBy(*keys, *item).agg(pick(arms[0]).alias("a"), pick(arms[1]).alias("b")).filter("a is not null and b is not null")
    return wide.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"),
        F.avg(F.col("a") - F.col("b")).alias("difference"), F.avg(_f(F.col("a") > F.col("b"))).alias("share_higher"),
    )


def length_profile(df: DataFrame, keys: Sequence[str], cell: str, item: Sequence[str], words: str) -> tuple[DataFrame, DataFrame]:
    """Word mean and spread per cell; range of words inside each item."""
    by_cell = df.groupBy(*keys, cell).agg(
        F.count(F.lit(1)).alias("n"), F.avg(words).alias("words_mean"), F.stddev_samp(words).alias("words_sd")
    )
    within = df.groupBy(*keys, *item).agg((F.max(words) - F.min(words)).alias("word_range"))
    return by_cell, within


def length_shift(df: DataFrame, keys: Sequence[str], item: Sequence[str], words: str, base: str, variant: str) -> DataFrame:
    """Shares of items whose variant is shorter, equal or longer than its base."""
    def pick(v: str) -> Column:
        return F.avg(F.when(F.col("variant") == v, F.col(words)))

    wide = df.groupBy(*keys, *item).agg(pick(variant).alias("v"), pick(base).alias("b")).filter("v is not null and b is not null")
    return wide.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("v") - F.col("b")).alias("mean_difference"),
        F.avg(_f(F.col("v") < F.col("b"))).alias("shorter"), F.avg(_f(F.col("v") == F.col("b"))).alias("equal"),
        F.avg(_f(F.col("v") > F.col("b"))).alias("longer"),
    )


def contrast_variants(df: DataFrame, keys: Sequence[str], item: Sequence[str], fallback: str, base: str) -> DataFrame:
    """Fallback mass, P(gold) and distance to the base variant, per variant."""
    # the guessed size of exploded rows is far too small: no broadcast
    ref = df.filter(F.col("variant") == base).select(*item, F.col("dist").alias("_base")).hint("merge")
    j = null_safe_join(df, ref, item, "left")
    return j.groupBy(*keys, "variant").agg(
        F.count(F.lit(1)).alias("n"), F.avg(D.prob("dist", F.lit(fallback))).alias("mean_fallback"),
        F.avg(D.prob("dist", F.col("gold"))).alias("mean_p_gold"), F.avg(D.tv_distance("dist", "_base")).alias("tv_to_base"),
    )


def hash_sample(df: DataFrame, keys: Sequence[str], unit: Sequence[str], seed: str) -> DataFrame:
    """Rows with their exact hash rank per key (see :func:`hash_rank`)."""
    return hash_rank(df.withColumn("_key", key_hash(seed, *unit)), keys, "_key").drop("_key")
