"""Recalibration, cross-fitting, panel and trend queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credalis.functions import dist as D
from credalis.functions import statfn
from credalis.operators import calibration as C
from credalis.operators import crossfit as X
from credalis.operators import panels as P
from credalis.operators import ranking as R
from credalis.operators import recalibration as RC
from credalis.operators import trend as TR
from credalis.plans.catalog import query
from credalis.plans.q_rank import rnd
from credalis.plans.q_resample import NULLS, RESAMPLES, SPLITS
from credalis.plans.q_score import scope
from credalis.plans.views import CUTOFF, Tables, spread
from credalis.session import checkpointed


@query("fit_temperature")
def fit_temperature(t: Tables) -> DataFrame:
    """Temperature of all answers, and their log loss before and after."""
    df = t.answers
    temp = RC.fit_temperature(df)
    return rnd(df.agg(
        F.lit(temp).alias("temperature"), F.avg(D.log_score("dist", "gold")).alias("log_loss"),
        F.avg(D.log_score(D.temper("dist", temp), "gold")).alias("log_loss_tempered"),
    ), digits=5)


@query("fit_platt")
def fit_platt(t: Tables) -> DataFrame:
    """Logistic maps of confidence and of confidence with a follow-up answer."""
    a, b = RC.fit_platt(t.rows)
    m = RC.logistic_map(t.rows, ["p_max", "p_known"], "correct")
    c = [float(x) for x in m.coefficients]
    g = t.rows.agg(F.count(F.lit(1)).alias("n"), F.avg(D.apply_platt("p_max", a, b)).alias("mean_platt"))
    return rnd(g.withColumns({
        "slope": F.lit(a), "intercept": F.lit(b), "coef_p_max": F.lit(c[0]), "coef_p_known": F.lit(c[1]), "joint_intercept": F.lit(float(m.intercept)),
    }), digits=4)


@query(
    "split_half",
    """WITH k AS (SELECT supp, row_number() OVER (ORDER BY md5('half|' || supp)) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT supp FROM rows))
       SELECT r <= n // 2 AS fit, count(*) AS n, count(DISTINCT supp) AS "keys" FROM rows JOIN k USING (supp) GROUP BY 1""",
    "rows",
)
def split_half(t: Tables) -> DataFrame:
    s = RC.split_half(t.rows, "supp")
    return s.groupBy("fit").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("supp").alias("keys"))


def heldout(t: Tables) -> DataFrame:
    """Fit on half of the earlier units, evaluate on the other half and on the later period."""
    s = scope(t).select("unit", "post", "dist", "gold", "p_max", "correct", "known")
    h = checkpointed(RC.split_half(s, "unit").drop("unit"))
    fit = h.filter(F.col("fit") & ~F.col("post"))
    temp, ab = RC.fit_temperature(fit), RC.fit_platt(fit)
    m = RC.logistic_map(fit, ["p_max", "known"], "correct")
    known = RC.apply_logistic(m, [F.col("p_max"), F.col("known")])
    test = h.filter(~F.col("fit") | F.col("post"))
    return RC.evaluate_maps(test, ["post"], temp, ab, known)


@query("heldout_recalibration")
def heldout_recalibration(t: Tables) -> DataFrame:
    return rnd(heldout(t), digits=4)


@query("recalibration_maps")
def recalibration_maps(t: Tables) -> DataFrame:
    """Pooled and period-aware isotonic maps, fitted on and applied to all rows."""
    fit = t.rows
    c = RC.common_map(fit, t.rows).select("post", F.lit("common").alias("map"), "recalibrated", "correct")
    p = RC.period_map(fit, t.rows).select("post", F.lit("period").alias("map"), "recalibrated", "correct")
    return rnd(c.unionByName(p).groupBy("map", "post").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("recalibrated") - F.col("correct").cast("double")).alias("gap")
    ), digits=6)


@query("cross_fitted_maps")
def cross_fitted_maps(t: Tables) -> DataFrame:
    panels = P.half_month_panels(P.month_level_counts(t.rows), SPLITS)
    return rnd(P.gap_summary(P.cross_fitted_maps(panels)), digits=6)


@query("forward_chaining")
def forward_chaining(t: Tables) -> DataFrame:
    return rnd(P.forward_chaining(t.rows), digits=6)


@query("interval_partition")
def interval_partition(t: Tables) -> DataFrame:
    """Best contiguous grouping of score levels, per set."""
    return rnd(P.interval_partition(C.level_table(t.rows, ["set_name"]), ["set_name"]), digits=6)


@query("partition_crossfit")
def partition_crossfit(t: Tables) -> DataFrame:
    return rnd(P.partition_crossfit(t.rows, SPLITS, NULLS), digits=6)


def errors(t: Tables) -> DataFrame:
    return t.rows.select("unit", "month", (~F.col("correct")).alias("error"), "p_max", "p_known", "set_name")


@query("grouped_cv_scores")
def grouped_cv_scores(t: Tables) -> DataFrame:
    """Out-of-fold error probabilities, months kept whole."""
    df = errors(t).withColumns({"x_p": 1 - F.col("p_max"), "x_m": 1 - F.col("p_known")})
    s = X.grouped_cv_scores(df, ["x_p", "x_m"], "error", "month")
    return rnd(R.auroc(s.withColumn("g", F.lit("all")), ["g"], "oof", "error"), digits=5)


@query("stratified_oof_scores")
def stratified_oof_scores(t: Tables) -> DataFrame:
    """Two classes of vectors told apart by all their coordinates."""
    df = t.embeddings.select("vec_id", (F.col("label") < 5).alias("low"), F.col("embedding").cast("array<double>").alias("x"))
    s = X.stratified_oof_scores(df, "x", "low", ["vec_id"])
    return rnd(R.auroc(s, [], "oof", "low"), digits=5)


@query("text_oof_scores")
def text_oof_scores(t: Tables) -> DataFrame:
    """How much of the quality label can be read off the text alone."""
    df = spread(t.scores_binary.select("doc_id", "text", "positive"), "doc_id")
    s = X.text_oof_scores(df, "text", "positive", ["doc_id"], features=1 << 16)
    return rnd(R.auroc(s, [], "oof", "positive"), digits=4)


@query("boosted_oof")
def boosted_oof(t: Tables) -> DataFrame:
    """Length features with boosted trees, sources kept whole."""
    df = t.scores_binary.select("doc_id", "source", "positive", "score", F.log1p("score").alias("log_score"), "ratio")
    s = X.boosted_oof(df, ["score", "log_score", "ratio"], "positive", "source")
    return rnd(R.auroc(s, [], "oof", "positive"), digits=4)


@query("combined_signal")
def combined_signal(t: Tables) -> DataFrame:
    return rnd(X.combined_signal(errors(t), "p_known", "month", [], RESAMPLES), digits=4)


@query("interaction_glm")
def interaction_glm(t: Tables) -> DataFrame:
    return rnd(RC.interaction_glm(t.rows), digits=4)


@query("step_trend")
def step_trend(t: Tables) -> DataFrame:
    """A step in monthly accuracy under four trends."""
    df = t.rows.withColumn("ok", F.col("correct").cast("double"))
    return rnd(TR.step_trend(df, ["set_name"], "ok", CUTOFF, RESAMPLES), digits=5)


@query(
    "item_ols",
    f"""WITH d AS (SELECT correct::INT::DOUBLE AS y, CAST(substr(month, 1, 4) AS INT) - 2020 + (CAST(substr(month, 6, 2) AS INT) - 1) / 12.0::DOUBLE AS t, (month >= '{CUTOFF}')::INT::DOUBLE AS d FROM rows),
       s AS (SELECT var_pop(t) AS tt, var_pop(d) AS dd, covar_pop(t, d) AS td, covar_pop(t, y) AS ty, covar_pop(d, y) AS dy FROM d)
       SELECT round((ty * dd - dy * td) / (tt * dd - td * td), 7) AS slope_per_year, round((dy * tt - ty * td) / (tt * dd - td * td), 7) AS step FROM s""",
    "rows",
)
def item_ols(t: Tables) -> DataFrame:
    df = t.rows.withColumn("ok", F.col("correct").cast("double"))
    return rnd(TR.item_ols(df, [], "ok", CUTOFF), digits=7)


@query("item_ols_interval")
def item_ols_interval(t: Tables) -> DataFrame:
    df = t.rows.withColumn("ok", F.col("correct").cast("double"))
    return rnd(TR.item_ols_interval(df, "ok", CUTOFF, RESAMPLES), digits=6)


ACC = "h AS (SELECT split_no, supp, row_number() OVER (PARTITION BY split_no ORDER BY md5('accept|' || split_no || '|' || supp)) <= count(*) OVER (PARTITION BY split_no) // 2 AS fit FROM (SELECT DISTINCT supp FROM rows), (SELECT unnest(range(0, 4)) AS split_no))"


@query(
    "heldout_acceptance",
    f"""WITH {ACC}, x AS (SELECT split_no, fit, 'p_max' AS name, p_max AS score, correct FROM rows JOIN h USING (supp) UNION ALL SELECT split_no, fit, 'p_known', p_known, correct FROM rows JOIN h USING (supp)),
       c AS (SELECT unnest([0.25, 0.5, 0.75, 0.9]::DOUBLE[]) AS coverage),
       q AS (SELECT split_no, name, quantile_cont(score, [0.75, 0.5, 0.25, 0.1]) AS q FROM x WHERE fit GROUP BY 1, 2),
       p AS (SELECT x.split_no, x.name, coverage, avg(correct::INT) FILTER (score >= q[i]) AS a, count(*) FILTER (score >= q[i]) / count(*) AS cov FROM x JOIN q USING (split_no, name), (SELECT unnest([0.25, 0.5, 0.75, 0.9]::DOUBLE[]) AS coverage, unnest([1, 2, 3, 4]) AS i) WHERE NOT fit GROUP BY 1, 2, 3)
       SELECT name, coverage, round(avg(a), 8) AS accuracy, round(min(a), 8) AS accuracy_min, round(max(a), 8) AS accuracy_max, round(avg(cov), 8) AS achieved FROM p GROUP BY 1, 2""",
    "rows",
)
def heldout_acceptance(t: Tables) -> DataFrame:
    return rnd(RC.heldout_acceptance(t.rows, "supp", ["p_max", "p_known"], "correct", 4))


@query("heldout_acceptance_full")
def heldout_acceptance_full(t: Tables) -> DataFrame:
    """50 splits."""
    return rnd(RC.heldout_acceptance(t.rows, "supp", ["p_max", "p_known"], "correct", SPLITS))


@query("t_distribution")
def t_distribution(t: Tables) -> DataFrame:
    """The vectorised t distribution on monthly statistics (checked against tables in the tests)."""
    g = t.rows.groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.avg("p_max").alias("m"), F.stddev_samp("p_max").alias("s"))
    stat = (F.col("m") - 0.75) / (F.col("s") / F.sqrt(F.col("n").cast("double")))
    return rnd(g.select("month", statfn.t_cdf(stat, (F.col("n") - 1).cast("double")).alias("p")), digits=7)
