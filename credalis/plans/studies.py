"""Composed queries: one per study, each a composition of the operators.

The studies read the derived views, so the same code runs on any scored rows with
those columns. Results are long tables of (part, group, metric values). Intervals
come from resamples of the count tree, whose cost does not grow with the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credalis.functions import dist as D
from credalis.functions.text import latest_date, mask_dates
from credalis.operators import calibration as C
from credalis.operators import crossfit as X
from credalis.operators import doses as DO
from credalis.operators import inference as I
from credalis.operators import joins as J
from credalis.operators import panels as P
from credalis.operators import ranking as R
from credalis.operators import recalibration as RC
from credalis.operators import replicates as RP
from credalis.operators import scoring as S
from credalis.operators import summaries as SU
from credalis.operators import timesplit as TS
from credalis.operators import trend as TR
from credalis.operators.prefix import null_safe_join
from credalis.plans.catalog import query
from credalis.plans.q_join import sides
from credalis.plans.q_rank import paired
from credalis.plans.q_recal import errors
from credalis.plans.q_resample import RESAMPLES as B
from credalis.plans.q_resample import CALL_DRAWS, NULLS, SPLITS, gap_rows
from credalis.plans.q_score import _balance, _orders, proposals, scope
from credalis.plans.views import CUTOFF, OPTIONS, Tables
from credalis.session import checkpointed

REFERENCE = 0.05
"""Smooth calibration error that draws are counted below (fixed value)."""


def long(df: DataFrame, part: str, group: Sequence[str] = ()) -> DataFrame:
    """Melt a result to ``(part, group, metric, value)``."""
    name = F.concat_ws("|", *[F.col(g).cast("string") for g in group]) if group else F.lit("all")
    cols = [c for c, t in df.dtypes if c not in group and t in ("double", "bigint", "int", "float")]
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols])
    out = df.select(F.lit(part).alias("part"), name.alias("group"), F.inline(pairs))
    return out.withColumn("value", F.round("value", 6))


def stack(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def holm_parts(results: DataFrame, p: str) -> DataFrame:
    """Holm over a family of one-row results ``(part, p)``."""
    return long(I.holm(results.select(F.lit("all").alias("family"), "name", F.col(p).alias("p")), ["family"], "p", order=["name"]).drop("family"), "holm", ["name"])


def level_mean(df: DataFrame, keys: Sequence[str], value: str, threshold: float, side: str = "ge") -> DataFrame:
    return I.bootstrap_mean(df, keys, value, [], B, threshold, side)


def cells(t: Tables) -> DataFrame:
    rows = t.answers.withColumns({"first_listed": F.lit("A"), "swap_target": F.lit("B")})
    return S.aggregate_cells(rows, ["set_name", "month", "post", "unit"])


@query("probability_checks")
def probability_checks(t: Tables) -> DataFrame:
    a = t.answers
    resid = F.abs((4 * F.array_max(F.map_values("dist")) - 1) / 3 - D.choice_confidence("dist"))
    formula = a.agg(F.max(resid).alias("residual_max"), F.min(D.mass("dist")).alias("sum_min"), F.max(D.mass("dist")).alias("sum_max"))
    diff = S.max_abs_diff(a, ["set_name", "unit"], OPTIONS).groupBy("set_name").agg(F.avg("max_abs_diff").alias("mean"), F.max("max_abs_diff").alias("max"))
    order = S.order_invariance(a, ["set_name", "unit"], OPTIONS).groupBy("set_name").agg(F.avg("mean_js").alias("mean_js"), F.avg(F.col("agree").cast("double")).alias("agreement"))
    cost = SU.cost_latency_summary(t.events, ["event_type"], ["value"])
    return stack(long(formula, "formula"), long(diff, "determinism", ["set_name"]), long(order, "order", ["set_name"]), long(cost, "cost", ["event_type", "metric"]))


@query("sampling_noise")
def sampling_noise(t: Tables) -> DataFrame:
    v = SU.replicate_variance(t.answers, ["set_name"], ["unit"], OPTIONS)
    c = SU.top2_correlation(t.answers, ["set_name", "replicate"])
    return stack(long(v, "variance", ["set_name"]), long(c, "top2", ["set_name", "replicate"]))


@query("dose_response")
def dose_response(t: Tables) -> DataFrame:
    full = DO.complete_items(t.cells, "item", "dose", (1, 2, 4))
    slopes = DO.within_item_slope(full, ["item"], F.log2("dose"), F.col("value"))
    by_dose = SU.arm_contrast(t.cells.withColumn("arm", F.col("dose").cast("string")), [], ["item"], "value", ("1", "5"))
    mean = I.bootstrap_mean(slopes, [], "slope", ["item"], B, 0.0)
    cal = C.smece(cells(t).select("set_name", "p_max", "correct"), ["set_name"], "p_max", "correct")
    return stack(long(mean, "slope"), long(by_dose, "first_minus_last"), long(cal, "calibration", ["set_name"]))


@query("scope_detection")
def scope_detection(t: Tables) -> DataFrame:
    s = scope(t).select(
        "unit", "set_name", "gold", (F.col("gold") == "D").alias("oos"), F.col("top").alias("closed_choice"), F.col("top").alias("with_oos_choice"),
        F.round("known", 2).alias("p_fits"), F.round(1 - F.col("p_max"), 2).alias("unsure"), F.round(1 - F.col("known"), 2).alias("unfit"),
    )
    d = I.stack_scores(s, ["unsure", "unfit"], ["set_name", "oos"])
    det = I.detection_interval(d, ["set_name", "name"], "score", "oos", [], B)
    return stack(long(SU.scope_rates(s, ["set_name"], "D"), "rates", ["set_name"]), long(det, "detection", ["set_name", "name"]))


@query("ensemble_compare")
def ensemble_compare(t: Tables) -> DataFrame:
    e = S.ensemble_decompose(t.answers, ["set_name", "unit", "gold"], OPTIONS).withColumn("correct", F.col("top") == F.col("gold"))
    e = checkpointed(e.select("set_name", "unit", "mi", "total", "correct"))  # one row a unit, read by both parts
    one = scope(t).select("replicate", "unit", "correct", D.norm_entropy("dist").alias("mi"))
    # the ensemble beside each of its members: the replicate comes with the member
    agree = J.model_agreement(e.select("set_name", "unit", "mi", "correct"), one, ["unit"], ["replicate", "set_name"], "mi")
    summary = e.groupBy("set_name").agg(F.avg("mi").alias("mi"), F.avg("total").alias("total"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
    return stack(long(summary, "ensemble", ["set_name"]), long(agree, "agreement", ["replicate", "set_name"]))


@query("classifier_compare")
def classifier_compare(t: Tables) -> DataFrame:
    s = scope(t).withColumn("cond", F.col("replicate").cast("string"))
    both = RP.every_pair(s.withColumn("ok", F.col("correct").cast("double")), 3)
    w = J.pair_conditions(both, ["pair", "set_name", "unit"], "side", "a", "b", ["ok", "p_max"])
    w = w.withColumn("gain", F.col("ok_a") - F.col("ok_b"))
    rel = C.reliability_bins(R.with_tie(s.select("cond", "unit", F.round("p_max", 4).alias("p_max"), "correct"), "unit"), ["cond"], "p_max", "correct", 10, "tie")
    cal = C.smece(s, ["cond"], "p_max", "correct")
    return stack(long(level_mean(w, ["pair", "set_name"], "gain", 0.0), "paired", ["pair", "set_name"]), long(rel, "reliability", ["cond", "bin"]), long(cal, "calibration", ["cond"]))


@query("error_detection")
def error_detection(t: Tables) -> DataFrame:
    e = errors(t).withColumns({"unsure": 1 - F.col("p_max"), "correct": ~F.col("error")})
    a = I.auroc_interval(e, ["set_name"], "unsure", "error", B)
    ap = R.average_precision(e, ["set_name"], "unsure", "error")
    rc = R.risk_coverage(e, ["set_name"], "p_max", "correct")
    over = J.confused_pair_overlap(*sides(scope(t)), ["pair", "set_name"])
    gain = X.combined_signal(errors(t), "p_known", "month", ["unit"], B)
    c = replicate_cells(t.answers)
    bins = C.reliability_bins(R.with_tie(c, "unit"), ["set_name"], "p_max", "correct", 10, "tie")
    return stack(
        long(a, "auroc", ["set_name"]), long(ap, "auprc", ["set_name"]), long(rc, "selective", ["set_name"]), long(over, "confusions", ["pair", "set_name"]), long(gain, "gain", ["name"]),
        replicate_signal(c), long(bins, "reliability", ["set_name", "bin"]), error_structure(t.answers),
    )


MIN_ERRORS = 10
"""Sets with fewer errors have no model of the replicate signal (fixed value)."""


def replicate_cells(answers: DataFrame) -> DataFrame:
    """Cells beside their replicate features: spread of the answers, and whether their top options differ."""
    k = ["set_name", "unit"]
    cell = S.aggregate_cells(answers.withColumns({"first_listed": F.lit(None).cast("string"), "swap_target": F.lit(None).cast("string")}), k)
    feats = null_safe_join(S.replicate_spread(answers, k), S.top_flips(answers, k), k)
    # sizes guessed before rows are exploded are far too small for a broadcast
    j = null_safe_join(cell, feats.hint("merge"), k)
    return checkpointed(j.select(*k, "gold", "p_max", "correct", (~F.col("correct")).alias("error"), "norm_entropy", "rep_tv", "rep_flip"))


def replicate_signal(c: DataFrame, b: int = B) -> DataFrame:
    """Does replicate spread flag errors beyond confidence? Folds keep a gold answer whole; every set has models of its own."""
    k = ["set_name"]
    about = c.groupBy(*k).agg(
        F.count_if("error").alias("errors"), F.avg("rep_tv").alias("mean_rep_tv"), F.avg(F.col("rep_flip").cast("double")).alias("rep_flip_rate")
    )
    used = [r["set_name"] for r in about.filter(F.col("errors") >= MIN_ERRORS).select("set_name").collect()]
    out = [long(about, "replicates", k)]
    if used:
        c = c.filter("error is not null").withColumn("x_p", 1 - F.col("p_max"))
        scored = []
        for s in used:
            own = X.grouped_cv_scores(c.filter(F.col("set_name").eqNullSafe(F.lit(s))), ["x_p"], "error", "gold", "s_p")
            scored.append(X.grouped_cv_scores(own, ["x_p", "rep_tv"], "error", "gold", "s_b"))
        c = checkpointed(reduce(DataFrame.unionByName, scored).select("set_name", "error", "rep_tv", "norm_entropy", "s_p", "s_b"))
        auc = R.auroc(I.stack_scores(c, ["rep_tv", "s_p", "s_b"], ["set_name", "error"]), ["set_name", "name"], "score", "error")
        gain = I.paired_auroc_difference(c, k, "s_b", "s_p", "error", b)
        out += [long(auc, "replicate_auroc", ["set_name", "name"]), long(gain, "replicate_gain", k), long(R.spearman(c, k, "rep_tv", "norm_entropy"), "spread_entropy", k)]
    return stack(*out)


def error_structure(answers: DataFrame, top: int = 8) -> DataFrame:
    """Where the errors of single answers lie, against the ensemble of a unit's answers."""
    k, by = ["set_name", "unit"], ["replicate", "set_name"]
    ranked = D.ranked_options("dist", "options")
    own = answers.select(*k, "replicate", "gold", F.explode(F.array(ranked)).alias("_o"))
    own = own.select(*k, "replicate", "gold", F.col("_o")[0]["option"].alias("top"), F.get("_o", F.lit(1))["option"].alias("second"), D.runner_up_share(F.col("_o")).alias("share"), F.size("_o").alias("_k"))
    both = S.ensemble_decompose(answers, k, OPTIONS).select(*k, F.col("top").alias("e_top"), F.col("second").alias("e_second"))
    j = checkpointed(null_safe_join(own, both.hint("merge"), k).drop("unit"))
    wrong = F.col("top") != F.col("gold")

    def share(c: Column) -> Column:
        return F.avg(F.when(wrong, c.cast("double")))

    shape = j.groupBy(*by).agg(
        F.count_if(wrong).alias("errors"), F.avg("share").alias("runner_up_share"), share(F.col("second") == F.col("gold")).alias("gold_is_second"),
        share(F.col("top").isin(F.col("e_top"), F.col("e_second"))).alias("in_ensemble_top2"), (2 / (F.max("_k") - 1)).alias("chance_in_top2"),
    )
    a, b = j.select(*by, "gold", "top"), j.select(*by, "gold", F.col("e_top").alias("top"))
    pairs = J.confused_pairs(a, by, "n").join(J.confused_pairs(b, by, "ensemble"), [*by, "gold", "chosen"], "left").fillna(0, ["ensemble"])
    most = R.top_k(pairs, by, [F.col("n").desc(), F.col("gold"), F.col("chosen")], top)
    return stack(long(shape, "structure", by), long(J.confused_pair_overlap(a, b, by), "ensemble_confusions", by), long(most, "most_confused", [*by, "gold", "chosen"]))


@query("synthetic_scores")
def synthetic_scores(t: Tables) -> DataFrame:
    o = _orders(t)
    exp = o.select("set_name", "replicate", D.expected_scores("dist", "ideal").alias("e")).groupBy("set_name", "replicate").agg(
        *[F.avg(f"e.{c}").alias(c) for c in ("brier", "log_loss", "ideal_brier", "ideal_log_loss")]
    )
    modes = SU.mode_share(o, ["set_name", "replicate"])
    valid = o.select("set_name", F.round(D.subset_mass("dist", F.array(F.lit("A"), F.lit("B"))), 3).alias("mass"))
    eq = I.equivalence(valid.withColumn("d", F.col("mass") - 0.5), ["set_name"], "d", 0.05, [], B)
    return stack(long(exp, "expected", ["set_name", "replicate"]), long(modes, "modes", ["set_name", "replicate"]), long(eq, "valid_mass", ["set_name"]))


@query("knowledge_boundary")
def knowledge_boundary(t: Tables) -> DataFrame:
    g = R.rank_groups(R.with_tie(gap_rows(t).withColumn("pop", F.col("supp").cast("double")), "unit"), [], "pop", 5, "tie")
    eq = I.equivalence(g, ["group"], "gap", 0.05, [], B)
    ends = I.mean_difference(g.filter(F.col("group").isin(0, 4)).withColumn("low", F.col("group") == 0), [], "p_max", "low", [], B)
    cp = TS.change_point(TS.monthly(t.rows, []), []).drop("first_post_month")
    cal = I.smece_interval(t.rows, ["set_name"], "p_max", "correct", B)
    by = R.auroc(g, ["group"], "p_known", "correct")
    fam = eq.select(F.concat(F.lit("quintile "), F.col("group").cast("string")).alias("name"), "p")
    return stack(long(eq, "quintiles", ["group"]), long(ends, "ends"), long(cp, "change_point"), long(cal, "calibration", ["set_name"]), long(by, "known", ["group"]), holm_parts(fam, "p"))


@query("evidence")
def evidence(t: Tables) -> DataFrame:
    s = DO.within_item_slope(t.conversations, ["conv_id"], F.col("turn"), F.length("text") / 1000)
    fl = DO.first_last_contrast(t.conversations, ["conv_id"], "turn", F.length("text") / 1000)
    cal = I.smece_interval(cells(t).select("set_name", F.round("p_max", 4).alias("p_max"), "correct"), ["set_name"], "p_max", "correct", B)
    return stack(
        long(I.bootstrap_mean(s, [], "slope", ["conv_id"], B), "slope"), long(I.bootstrap_mean(fl, [], "first_minus_last", ["conv_id"], B), "first_last"),
        long(cal, "calibration", ["set_name"]), long(SU.group_summary(t.rows, [["set_name"], ["post"]]), "summary", ["set_name", "post"]),
    )


@query("benchmarks")
def benchmarks(t: Tables) -> DataFrame:
    a = I.auroc_interval(t.rows, ["set_name"], "p_known", "correct", B, threshold=0.6)
    cal = I.smece_interval(t.rows, ["set_name"], "p_max", "correct", B)
    opts = F.array(*[F.lit(o) for o in "ABCD"])
    human = F.map_from_arrays(opts, F.reverse(F.map_values("dist")))
    agree = SU.human_agreement(t.answers.withColumns({"human": human, "panel": F.lit(None).cast("map<string,double>")}), ["set_name"])
    rho = I.spearman_interval(t.rows, ["set_name"], "p_max", "p_known", [], B)
    fam = a.select(F.col("set_name").alias("name"), F.col("tail").alias("p"))
    return stack(
        long(a, "auroc", ["set_name"]), long(cal, "calibration", ["set_name"]), long(SU.threshold_coverage(t.rows, ["set_name"]), "selective", ["set_name"]),
        long(agree, "human", ["set_name"]), long(rho, "entropy_agreement", ["set_name"]), holm_parts(fam, "p"),
    )


@query("follow_up")
def follow_up(t: Tables) -> DataFrame:
    a = I.auroc_interval(t.rows, ["post"], "p_known", "correct", B, threshold=0.5)
    cov = SU.coverage_table(scope(t), ["replicate", "post"], "D", 0.5)
    read = t.answers.select("set_name", F.abs(D.percent_reading("level") - F.col("known")).alias("e")).groupBy("set_name").agg(F.avg("e").alias("reading_error"))
    return stack(long(a, "known", ["post"]), long(cov, "coverage", ["replicate", "post"]), long(read, "readings", ["set_name"]), long(level_mean(gap_rows(t), ["post"], "gap", 0.05), "gap", ["post"]))


@query("second_look")
def second_look(t: Tables) -> DataFrame:
    e = errors(t).withColumns({"s1": 1 - F.col("p_max"), "s2": 1 - F.col("p_known"), "ok": (~F.col("error")).cast("double")})
    gain = I.paired_auroc_difference(e, ["set_name"], "s2", "s1", "error", B)
    by = e.groupBy("set_name").agg(F.corr("p_max", "ok").alias("r_first"), F.corr("p_known", "ok").alias("r_second"), F.avg("ok").alias("accuracy"))
    cal = C.smece(t.rows, ["set_name"], "p_known", "correct")
    return stack(long(gain, "gain", ["set_name"]), long(by, "tracking", ["set_name"]), long(cal, "calibration", ["set_name"]))


@query("contrast_cases")
def contrast_cases(t: Tables) -> DataFrame:
    v = SU.contrast_variants(t.answers.withColumn("variant", F.col("replicate")), ["set_name"], ["unit"], "D", 0)
    p = t.answers.select("replicate", F.round(D.prob("dist", F.col("gold")), 3).alias("p_gold"))
    m = level_mean(p, ["replicate"], "p_gold", 0.5, "le")
    s = scope(t).select("unit", F.round(1 - F.col("known"), 2).alias("doubt"), (F.col("gold") == "D").alias("undecidable"))
    a = I.auroc_interval(s, [], "doubt", "undecidable", B)
    fam = m.select(F.concat(F.lit("variant "), F.col("replicate").cast("string")).alias("name"), F.col("tail").alias("p"))
    return stack(long(v, "variants", ["set_name", "variant"]), long(m, "p_gold", ["replicate"]), long(a, "enough"), holm_parts(fam, "p"))


@query("option_count")
def option_count(t: Tables) -> DataFrame:
    k = t.rows.withColumn("K", F.col("line"))
    cal = I.smece_interval(k, ["K"], "p_max", "correct", B)
    a = R.auroc(k, ["K"], "p_max", "correct")
    fam = cal.select(F.concat(F.lit("K "), F.col("K").cast("string")).alias("name"), F.col("tail").alias("p"))
    return stack(long(cal, "calibration", ["K"]), long(a, "auroc", ["K"]), long(SU.group_summary(k, [["K"]]), "summary", ["K"]), holm_parts(fam, "p"))


@query("stated_odds")
def stated_odds(t: Tables) -> DataFrame:
    o = _orders(t)
    first = o.withColumn("hit", (D.top_option("dist", "options") == F.element_at("options", 1)).cast("double"))
    m = level_mean(first.select("set_name", "hit"), ["set_name"], "hit", 0.25, "le")
    curve = SU.averaging_curve(o, ["set_name"], ["unit", "replicate"], (1, 4, 16, 64), 4)
    return stack(
        long(SU.order_averaged_tv(o, ["set_name"]), "tv_of_mean", ["set_name"]), long(SU.by_label_and_position(o, ["set_name"]), "label_position", ["set_name", "label", "position"]),
        long(curve, "averaging", ["set_name", "k"]), long(m, "first_shown", ["set_name"]),
    )


@query("open_answers")
def open_answers(t: Tables) -> DataFrame:
    keys = F.array(F.lit("A"), F.lit("C"))
    s = t.answers.select(
        "set_name", F.round(D.valid_spread("dist", keys), 3).alias("spread"), F.round(D.verification_confidence("known"), 3).alias("conf"),
        ((F.col("known") >= 0.5) == F.col("gold").isin("A", "B")).alias("right"), F.round(D.prob("dist", F.lit("D")), 3).alias("p_idk"), (F.col("gold") == "D").alias("wrong"),
    )
    a = I.auroc_interval(s, ["set_name"], "p_idk", "wrong", B)
    cal = I.smece_interval(s, ["set_name"], "conf", "right", B)
    sp = level_mean(s, ["set_name"], "spread", 0.5, "le")
    fam = sp.select(F.col("set_name").alias("name"), F.col("tail").alias("p"))
    return stack(long(a, "idk", ["set_name"]), long(cal, "verification", ["set_name"]), long(sp, "spread", ["set_name"]), holm_parts(fam, "p"))


@query("settledness")
def settledness(t: Tables) -> DataFrame:
    a = I.auroc_interval(t.rows, ["set_name"], "p_known", "post", B, cluster="month", threshold=0.55)
    by = R.stratified_auroc(t.rows, ["set_name"], "p_known", "post", "line")
    return stack(long(a, "separation", ["set_name"]), long(by, "by_kind", ["set_name"]), long(SU.group_summary(t.rows, [["set_name", "post"]]), "means", ["set_name", "post"]))


@query("surface_controls")
def surface_controls(t: Tables) -> DataFrame:
    q = t.questions.withColumn("masked", mask_dates("question"))
    date = q.withColumns({"date": F.coalesce(latest_date("question"), F.lit(0.0)), "date_masked": F.coalesce(latest_date("masked"), F.lit(0.0)), "post": F.col("month") >= CUTOFF})
    auc = R.auroc(I.stack_scores(date, ["date", "date_masked"], ["post"]), ["name"], "score", "post")
    obscure = R.quantile_filter(t.questions, ["relation"], "value", 0.2).groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))
    return stack(
        long(auc, "date_cue", ["name"]), long(obscure, "obscure", ["relation"]), long(SU.paired_proposals(proposals(t), ["pair", "post"], ["unit"]), "polarity", ["pair", "post"]),
        long(SU.arm_contrast(t.answers.withColumn("arm", F.concat(F.lit("r"), F.col("replicate").cast("string"))), ["set_name"], ["unit"], "known", ("r0", "r1")), "arms", ["set_name"]),
    )


@query("cutoff_calibration")
def cutoff_calibration(t: Tables) -> DataFrame:
    eq = TS.equal_confidence(t.rows, B)
    gaps = stack(long(C.single_map_gaps(t.rows, [], C.COARSE_BANDS), "map_coarse"), long(C.single_map_gaps(t.rows, [], C.FINE_BANDS), "map_fine"))
    mix = TS.matched_coverage_interval(paired(t), (0.05, 0.25, 0.5, 0.8), B)
    return stack(long(eq, "bands", ["band"]), gaps, long(mix, "mix", ["share"]))


@query("knowledge_cutoff")
def knowledge_cutoff(t: Tables) -> DataFrame:
    m = TS.monthly(t.rows, [])
    cp = TS.change_point(m, [])
    at = TS.cutoff_stats(m, cp.select(F.col("first_post_month").alias("cutoff")), [])
    boot = TS.selection_bootstrap(t.rows, [], B)
    sel = boot.groupBy("first_post_month").agg((F.count(F.lit(1)) / float(B)).alias("share"), F.avg("post_gap").alias("post_gap"))
    halves = TS.split_selection(t.rows, [], SPLITS).agg(F.min("post_gap").alias("gap_min"), F.max("post_gap").alias("gap_max"), F.avg("drop").alias("drop"))
    shape = TR.item_ols_interval(t.rows, "p_known", CUTOFF, B)
    return stack(long(at, "selected", ["cutoff"]), long(sel, "selection", ["first_post_month"]), long(halves, "halves"), long(shape, "shape"), long(TS.cutoff_stats(m, TS.cutoff_table(t.spark, TS.SENSITIVITY), []), "sensitivity", ["cutoff"]))


@query("recalibration")
def recalibration(t: Tables) -> DataFrame:
    lv = C.level_table(t.rows, [])
    nulls = I.within_value_permutation_levels(lv, [], B).agg(F.avg("lower_bound").alias("mean"), F.percentile("lower_bound", 0.95).alias("p95"))
    months = I.random_months_null(t.rows, NULLS).agg(F.avg("lower_bound").alias("mean"), F.percentile("lower_bound", 0.95).alias("p95"))
    cross = P.gap_summary(P.cross_fitted_maps(P.half_month_panels(P.month_level_counts(t.rows), SPLITS)))
    blocks = TS.block_selection_bootstrap(t.rows, B).groupBy("band").agg(F.avg("difference").alias("difference"), F.avg((F.col("shift") == 0).cast("double")).alias("at_boundary"))
    bands = TS.range_band_join(t.rows).agg(F.count(F.lit(1)).alias("intervals"), F.min("difference").alias("min_difference"), F.avg((F.col("difference") > 0).cast("double")).alias("share_positive"))
    return stack(
        long(C.every_map_lower_bound(lv, []), "bound"), long(nulls, "null_within_value"), long(months, "null_random_months"), long(cross, "cross_fitted", ["map"]),
        long(RC.interaction_glm(t.rows), "interaction", ["term"]), long(bands, "band_unions"), long(TS.alternative_cutoffs(t.rows, TS.SENSITIVITY), "cutoffs", ["cutoff", "band"]), long(blocks, "blocks", ["band"]),
    )


@query("combined_signals")
def combined_signals(t: Tables) -> DataFrame:
    pools = {"early": errors(t).filter(F.col("month") < CUTOFF), "late": errors(t).filter(F.col("month") >= CUTOFF)}
    return stack(*[long(X.combined_signal(df, "p_known", "month", ["unit"], B), name, ["name"]) for name, df in pools.items()])


@query("abstention")
def abstention(t: Tables) -> DataFrame:
    p = R.with_tie(paired(t), "unit")
    cov = p.groupBy("post").agg(F.avg(F.col("answered").cast("double")).alias("cov"), F.avg(F.when(F.col("answered"), F.col("opt_ok").cast("double"))).alias("option_accuracy"))
    j = p.join(F.broadcast(cov), "post")
    sel = stack(*[long(R.selective_at(j, ["post"], s, "base_ok", F.col("cov"), "p_max", "tie"), f"threshold_{s}", ["post"]) for s in ("p_max", "p_known")])
    area = stack(*[long(R.risk_coverage(p, ["post"], s, "base_ok", ()), f"aurc_{s}", ["post"]) for s in ("p_max", "p_known")])
    sep = I.auroc_interval(t.rows.withColumn("unknown", 1 - F.col("p_known")), [], "unknown", "post", B, cluster="month")
    return stack(long(cov, "option", ["post"]), sel, area, long(sep, "separability"), long(TR.step_trend(t.rows, [], "p_known", CUTOFF, B), "trend", ["spec"]))


@query("popularity_dose")
def popularity_dose(t: Tables) -> DataFrame:
    g = R.rank_groups(R.with_tie(t.rows.withColumn("pop", F.col("supp").cast("double")), "unit"), [], "pop", 5, "tie")
    bounds = I.smece_bounds(g.select("group", "unit", "p_max", "correct"), ["group"], "p_max", "correct", B, [])
    full = DO.complete_items(t.cells, "item", "dose", (1, 2, 3, 4, 5))
    slopes = {"per_unit": F.log2(F.col("dose") + 1), "per_doubling": F.log2("dose")}
    parts = [long(I.bootstrap_mean(DO.within_item_slope(full, ["item"], x, F.col("value")), [], "slope", ["item"], B), n) for n, x in slopes.items()]
    return stack(long(bounds, "bounds", ["group", "scheme"]), *parts)


@query("replicate_averaging")
def replicate_averaging(t: Tables) -> DataFrame:
    """Modes, the mean over pairs, single calls against the mean of three, bounds and repeated draws of a random call."""
    k, item = ["mode", "frame", "set_name"], ["set_name", "gold", "unit"]
    m = RP.replicate_modes(t.answers, item, 3).withColumn("correct", F.col("top") == F.col("gold"))
    m = checkpointed(m.select("mode", "frame", *item, "p_max", "correct"))  # every part below reads the modes
    ok = F.col("correct").cast("double")
    agg = m.groupBy(*k).agg(F.avg(ok).alias("accuracy"), F.avg("p_max").alias("mean_confidence"), (F.avg("p_max") - F.avg(ok)).alias("gap"))
    cal = checkpointed(C.smece(m, k, "p_max", "correct"))
    per = null_safe_join(agg, cal, k)
    pairs = per.filter("mode = 'mean2'").groupBy("set_name").agg(*[F.avg(c).alias(c) for c in ("n", "accuracy", "mean_confidence", "gap", "smece")])

    def smece_of(mode: str):
        return F.when(F.col("mode") == mode, F.col("smece"))

    calls = per.groupBy("set_name").agg(
        F.min(smece_of("single")).alias("smece_min"), F.max(smece_of("single")).alias("smece_max"),
        (F.max(smece_of("single_random")) - F.max(smece_of("mean3"))).alias("smece_increase"),
    )
    bounds = I.smece_bounds(m.filter("mode = 'single_random'"), ["set_name"], "p_max", "correct", B, [])
    singles = m.filter("mode = 'single'").withColumn("replicate", F.substring("frame", 2, 9).cast("int"))
    drawn = checkpointed(RP.call_draws(singles, ["set_name"], item, 3, CALL_DRAWS))
    spread = stack(*[
        long(drawn.groupBy("set_name").agg(
            F.avg(c).alias("mean"), F.percentile(c, 0.025).alias("lo"), F.percentile(c, 0.975).alias("hi"), F.min(c).alias("min"), F.max(c).alias("max"),
            *([F.avg((F.col(c) < REFERENCE).cast("double")).alias("share_below")] if c == "smece" else []),
        ), f"draws_{c}", ["set_name"]) for c in ("smece", "accuracy")
    ])
    saved = cells(t).select("unit", "p_max")
    wrong = J.mismatch_count(m.filter("mode = 'mean3'").select("set_name", "unit", "p_max"), saved, ["set_name"])
    return stack(
        long(agg, "modes", k), long(cal, "calibration", k), long(pairs, "mean2", ["set_name"]), long(calls, "single_calls", ["set_name"]),
        long(bounds, "single_random_bounds", ["set_name", "scheme"]), spread, long(wrong, "mean3_against_rows", ["set_name"]),
    )


@query("shortcut_baselines")
def shortcut_baselines(t: Tables) -> DataFrame:
    cov = SU.coverage_table(scope(t), ["replicate", "post"], "D", 0.5)
    prop = SU.proper_scores(t.answers.withColumn("correct", D.top_option("dist", "options") == F.col("gold")), ["set_name"])
    within = R.stratified_auroc(t.rows, ["post"], "p_known", "correct", "month")
    pair = I.paired_auroc_difference(t.rows, [], "p_known", "p_max", "correct", B, cluster="month")
    acc = RC.heldout_acceptance(t.rows, "supp", ["p_max", "p_known"], "correct", SPLITS)
    return stack(
        long(prop, "proper", ["set_name"]), long(cov, "coverage", ["replicate", "post"]), long(within, "within_period", ["post"]), long(pair, "paired"),
        long(SU.label_balance(_balance(t)).filter("grouping < 2"), "balance", ["post", "category", "month"]), long(P.partition_crossfit(t.rows, SPLITS, NULLS), "partition"),
        long(P.forward_chaining(t.rows).groupBy("kind", "late").agg(F.avg("gap").alias("gap"), F.avg("raw_gap").alias("raw_gap")), "forward", ["kind", "late"]), long(acc, "acceptance", ["name", "coverage"]),
    )
