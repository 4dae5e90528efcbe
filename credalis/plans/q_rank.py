"""Queries over ranking, order and calibration metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credalis.functions.statfn import normal_interval, wilson
from credalis.operators import calibration as C
from credalis.operators import doses as DO
from credalis.operators import inference as I
from credalis.operators import ranking as R
from credalis.operators import timesplit as TS
from credalis.plans.catalog import query
from credalis.plans.views import Tables

TIE = "md5('tie|' || {u})"


def rnd(df: DataFrame, *skip: str, digits: int = 8) -> DataFrame:
    """Round every floating column, so both engines agree on the last digits."""
    return df.select(
        *[F.round(c, digits).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes]
    )


def auroc_sql(src: str, key: str, score: str, pos: str) -> str:
    return f"""SELECT {key}, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (before + neg / 2.0)) / (sum(pos) * sum(neg)) END AS auroc,
       (sum(pos) + sum(neg))::BIGINT AS n, sum(pos)::BIGINT AS n_positive FROM (
       SELECT *, coalesce(sum(neg) OVER (PARTITION BY {key} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
       FROM (SELECT {key}, {score} AS s, count(*) FILTER ({pos}) AS pos, count(*) FILTER (NOT {pos}) AS neg FROM {src} GROUP BY {key}, {score})) GROUP BY {key}"""


@query("auroc", f"SELECT lang, round(auroc, 8) AS auroc, n, n_positive FROM ({auroc_sql('scores_binary', 'lang', 'score', 'positive')})", "scores_binary")
def auroc(t: Tables) -> DataFrame:
    a = R.auroc(t.scores_binary, ["lang"], "score", "positive")
    return rnd(a.withColumns({"n": F.col("n").cast("long"), "n_positive": F.col("n_positive").cast("long")}))


@query(
    "auroc_pooled",
    f"SELECT round(auroc, 8) AS auroc, n FROM ({auroc_sql('(SELECT *, 0 AS g FROM answers)', 'g', 'pa', 'post')})", "answers",
)
def auroc_pooled(t: Tables) -> DataFrame:
    """One AUROC over every answer, with as many levels as rows: the bucketed path."""
    df = t.answers.select(F.element_at("dist", F.lit("A")).alias("pa"), "post")
    return rnd(R.auroc(df, [], "pa", "post").select("auroc", F.col("n").cast("long").alias("n")))


@query(
    "stratified_auroc",
    f"""SELECT set_name, round(sum(auroc * n) FILTER (auroc IS NOT NULL) / sum(n) FILTER (auroc IS NOT NULL), 8) AS auroc,
       count(*) FILTER (auroc IS NOT NULL) AS strata_used, sum(n) FILTER (auroc IS NOT NULL)::BIGINT AS rows_covered, sum(n)::BIGINT AS rows
       FROM ({auroc_sql('rows', 'set_name, month', 'p_max', 'correct')}) GROUP BY 1""",
    "rows",
)
def stratified_auroc(t: Tables) -> DataFrame:
    return rnd(R.stratified_auroc(t.rows, ["set_name"], "p_max", "correct", "month"))


@query(
    "fpr_at_tpr",
    """WITH q AS (SELECT lang, quantile_cont(score, 0.05) AS q FROM scores_binary WHERE positive GROUP BY 1)
       SELECT lang, round(avg((score >= q)::INT), 8) AS fpr FROM scores_binary JOIN q USING (lang) WHERE NOT positive GROUP BY 1""",
    "scores_binary",
)
def fpr_at_tpr(t: Tables) -> DataFrame:
    return rnd(R.fpr_at_tpr(t.scores_binary, ["lang"], "score", "positive"))


@query(
    "average_precision",
    f"""WITH l AS (SELECT lang, score, sum(positive::INT) AS pos, count(*) AS n FROM scores_binary GROUP BY 1, 2),
       a AS (SELECT lang, sum(pos * tp / k) / sum(pos) AS average FROM (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS k FROM l
             WINDOW w AS (PARTITION BY lang ORDER BY score DESC)) GROUP BY 1),
       o AS (SELECT lang, sum(hit * tp / k) / sum(hit) AS ordered FROM (SELECT lang, positive::INT AS hit, sum(positive::INT) OVER w AS tp, row_number() OVER w AS k
             FROM scores_binary WINDOW w AS (PARTITION BY lang ORDER BY score DESC, {TIE.format(u='doc_id')} ROWS UNBOUNDED PRECEDING)) GROUP BY 1)
       SELECT lang, round(average, 8) AS average, round(ordered, 8) AS ordered FROM a JOIN o USING (lang)""",
    "scores_binary",
)
def average_precision(t: Tables) -> DataFrame:
    df = R.with_tie(t.scores_binary, "doc_id")
    a = R.average_precision(df, ["lang"], "score", "positive").withColumnRenamed("average_precision", "average")
    o = R.average_precision(df, ["lang"], "score", "positive", "input_order", "tie")
    return rnd(a.join(o.withColumnRenamed("average_precision", "ordered"), "lang"))


def _risk_sql(key: str, rule: str) -> str:
    if rule == "average":
        cum = f"e0 + (k - k0) * e / c FROM (SELECT *, sum(bad) OVER (PARTITION BY {key}, p_max) AS e, count(*) OVER (PARTITION BY {key}, p_max) AS c, min(k) OVER (PARTITION BY {key}, p_max) - 1 AS k0, min(cb - bad) OVER (PARTITION BY {key}, p_max) AS e0 FROM o)"
    else:
        cum = "cb FROM o"
    return f"""WITH o AS (SELECT {key}, p_max, (NOT correct)::INT AS bad, row_number() OVER w AS k, sum((NOT correct)::INT) OVER w AS cb, count(*) OVER (PARTITION BY {key}) AS n
         FROM rows WINDOW w AS (PARTITION BY {key} ORDER BY p_max DESC, {TIE.format(u='unit')} ROWS UNBOUNDED PRECEDING)),
       r AS (SELECT {key}, k, n, {cum})
       SELECT {key}, round(avg(cum / k), 8) AS aurc, round(avg(cum / n), 8) AS augrc,
         round(max(cum / k) FILTER (k = greatest(1, ceil(0.8::DOUBLE * n))), 8) AS risk_at_80, round(max(cum / k) FILTER (k = greatest(1, ceil(0.9::DOUBLE * n))), 8) AS risk_at_90,
         round(max(cum / k) FILTER (k = greatest(1, ceil(0.95::DOUBLE * n))), 8) AS risk_at_95 FROM (SELECT * FROM r) AS x({key}, k, n, cum) GROUP BY 1"""


@query("risk_coverage", _risk_sql("set_name", "average"), "rows")
def risk_coverage(t: Tables) -> DataFrame:
    return rnd(R.risk_coverage(t.rows, ["set_name"], "p_max", "correct"))


@query("risk_coverage_ordered", _risk_sql("set_name", "input_order"), "rows")
def risk_coverage_ordered(t: Tables) -> DataFrame:
    return rnd(R.risk_coverage(R.with_tie(t.rows, "unit"), ["set_name"], "p_max", "correct", ties="input_order", tie="tie"))


@query(
    "selective_at",
    f"""WITH o AS (SELECT set_name, p_max, correct, row_number() OVER (PARTITION BY set_name ORDER BY p_known DESC, {TIE.format(u='unit')}) AS k,
         count(*) OVER (PARTITION BY set_name) AS n FROM rows)
       SELECT set_name, count(*) AS answered, round(count(*) / any_value(n), 8) AS coverage, round(avg(correct::INT), 8) AS selective_accuracy,
         count(*) FILTER (NOT correct) AS errors, count(*) FILTER (NOT correct AND p_max >= 0.9) AS confident_errors
       FROM o WHERE k <= round_even(0.3333::DOUBLE * n, 0) GROUP BY 1""",
    "rows",
)
def selective_at(t: Tables) -> DataFrame:
    return rnd(R.selective_at(R.with_tie(t.rows, "unit"), ["set_name"], "p_known", "correct", 0.3333, "p_max", "tie"))


@query(
    "weighted_accuracy_at",
    """WITH l AS (SELECT set_name, p_max, sum(p_known) AS w, sum(p_known * correct::INT) AS g FROM rows WHERE p_known > 0 GROUP BY 1, 2),
       c AS (SELECT *, sum(w) OVER (PARTITION BY set_name ORDER BY p_max DESC) - w AS before, sum(w) OVER (PARTITION BY set_name) AS total FROM l),
       f AS (SELECT *, greatest(0, least(w, 0.4::DOUBLE * total - before)) / w AS part FROM c)
       SELECT set_name, round(sum(part * g) / sum(part * w), 8) AS accuracy, round(sum(part * w) / any_value(total), 8) AS achieved FROM f GROUP BY 1""",
    "rows",
)
def weighted_accuracy_at(t: Tables) -> DataFrame:
    lv = t.rows.groupBy("set_name", "p_max").agg(
        F.sum("p_known").alias("w"), F.sum(F.col("p_known") * F.col("correct").cast("double")).alias("g"), F.lit(0.4).alias("cov")
    )
    return rnd(R.weighted_accuracy_at(lv, ["set_name"], "p_max", "w", "g", "cov"))


def paired(t: Tables) -> DataFrame:
    """An abstention option beside the forced answer, from the rows view."""
    return t.rows.select(
        "unit", "month", "post", "p_max", "p_known", F.col("correct").alias("base_ok"),
        (F.col("p_known") >= 0.5).alias("answered"), (F.col("correct") | (F.col("p_max") > 0.93)).alias("opt_ok"),
    )


SHARES = (0.05, 0.25, 0.5, 0.8)


def _matched_sql() -> str:
    parts = []
    for s in ("p_max", "p_known"):
        parts.append(f"""{s}_acc AS (SELECT share, sum(part * g) / sum(part * w) AS {s}, sum(part * w) / any_value(total) AS achieved_{s} FROM (
          SELECT *, greatest(0, least(w, coverage * total - before)) / w AS part FROM (
          SELECT share, coverage, w, g, sum(w) OVER (PARTITION BY share ORDER BY score DESC) - w AS before, sum(w) OVER (PARTITION BY share) AS total FROM (
          SELECT share, any_value(coverage) AS coverage, {s} AS score, sum(wt) AS w, sum(wt * base_ok::INT) AS g FROM x JOIN o USING (share) GROUP BY share, {s}))) GROUP BY share)""")
    return f"""WITH p AS (SELECT *, correct AS base_ok, p_known >= 0.5 AS answered, (correct OR p_max > 0.93) AS opt_ok FROM rows),
      x AS (SELECT p.*, s.share, CASE WHEN post THEN share / (SELECT count(*) FROM p WHERE post) ELSE (1 - share) / (SELECT count(*) FROM p WHERE NOT post) END AS wt
            FROM p, (SELECT unnest([{', '.join(str(s) + '::DOUBLE' for s in SHARES)}]) AS share) s),
      o AS (SELECT share, sum(wt * answered::INT) / sum(wt) AS coverage, sum(wt * (answered AND opt_ok)::INT) / sum(wt * answered::INT) AS option FROM x GROUP BY share),
      {', '.join(parts)}
      SELECT share, round(coverage, 7) AS coverage, round(option, 7) AS option, round(p_max, 7) AS p_max, round(achieved_p_max, 7) AS achieved_p_max,
             round(p_known, 7) AS p_known, round(achieved_p_known, 7) AS achieved_p_known FROM o JOIN p_max_acc USING (share) JOIN p_known_acc USING (share)"""


@query("matched_coverage", _matched_sql(), "rows")
def matched_coverage(t: Tables) -> DataFrame:
    return rnd(TS.matched_coverage(paired(t), [], SHARES), "share", digits=7)


@query(
    "spearman",
    """WITH r AS (SELECT set_name, rank() OVER (PARTITION BY set_name ORDER BY p_max) + (count(*) OVER (PARTITION BY set_name, p_max) - 1) / 2.0 AS rx,
         rank() OVER (PARTITION BY set_name ORDER BY p_known) + (count(*) OVER (PARTITION BY set_name, p_known) - 1) / 2.0 AS ry FROM rows)
       SELECT set_name, round(corr(rx, ry), 8) AS rho, count(*) AS n FROM r GROUP BY 1""",
    "rows",
)
def spearman(t: Tables) -> DataFrame:
    return rnd(R.spearman(t.rows, ["set_name"], "p_max", "p_known"))


@query(
    "quantile_groups",
    f"""WITH r AS (SELECT o_orderkey, o_orderstatus, o_totalprice, row_number() OVER (PARTITION BY o_orderstatus ORDER BY round(o_totalprice / 1000), {TIE.format(u='o_orderkey')}) AS rk,
         count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders),
       g AS (SELECT *, greatest(0, least(4, ceil(round((rk - 1) * 5 / (n - 1)::DOUBLE, 9)) - 1))::INT AS grp FROM r),
       e AS (SELECT o_orderstatus, quantile_cont(round(o_totalprice / 1000), [0.2, 0.4, 0.6, 0.8]) AS e FROM orders GROUP BY 1),
       v AS (SELECT o_orderkey, len(list_filter(e, lambda x: round(o_totalprice / 1000) > x))::INT AS vgrp FROM orders JOIN e USING (o_orderstatus))
       SELECT o_orderstatus, grp, vgrp, count(*) AS n, round(avg(o_totalprice), 6) AS mean FROM g JOIN v USING (o_orderkey) GROUP BY 1, 2, 3""",
)
def quantile_groups(t: Tables) -> DataFrame:
    """Quintiles by first rank and by value, side by side."""
    df = R.with_tie(t.orders, "o_orderkey").withColumn("v", F.round(F.col("o_totalprice") / 1000))
    g = R.rank_groups(df, ["o_orderstatus"], "v", 5, "tie").withColumnRenamed("group", "grp")
    v = R.value_groups(g, ["o_orderstatus"], "v", 5).withColumnRenamed("group", "vgrp")
    return rnd(v.groupBy("o_orderstatus", "grp", "vgrp").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean")), digits=6)


@query(
    "quantile_filter",
    """WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.2) AS q FROM orders GROUP BY 1)
       SELECT o_orderpriority, count(*) AS n, round(max(o_totalprice), 6) AS largest FROM orders JOIN q USING (o_orderpriority) WHERE o_totalprice <= q GROUP BY 1""",
)
def quantile_filter(t: Tables) -> DataFrame:
    kept = R.quantile_filter(t.orders, ["o_orderpriority"], "o_totalprice", 0.2)
    return rnd(kept.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("largest")), digits=6)


CHANGE_SQL = """{m} AS (SELECT {key}, month, count(*)::DOUBLE AS n, sum(correct::INT)::DOUBLE AS k FROM {src} GROUP BY {key}, month),
  {m}c AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY {key}) AS months, sum(n) OVER w - n AS ln, sum(k) OVER w - k AS lk,
       sum(n) OVER (PARTITION BY {key}) AS tn, sum(k) OVER (PARTITION BY {key}) AS tk, sum(k * k / n) OVER (PARTITION BY {key}) AS tq FROM {m} WINDOW w AS (PARTITION BY {key} ORDER BY month)),
  {m}b AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY round(tq - lk*lk/ln - (tk-lk)*(tk-lk)/(tn-ln), 9), i) AS best FROM {m}c WHERE i BETWEEN 6 AND months - 6),
  {m}f AS (SELECT {key}, i AS split, month AS first_post_month, lk / ln AS pre_accuracy, (tk-lk)/(tn-ln) AS post_accuracy FROM {m}b WHERE best = 1)"""


@query(
    "change_point",
    "WITH " + CHANGE_SQL.format(m="s", key="set_name", src="rows") + """
    SELECT set_name, first_post_month, split, round(pre_accuracy, 8) AS pre_accuracy, round(post_accuracy, 8) AS post_accuracy,
           round(pre_accuracy - post_accuracy, 8) AS "drop" FROM sf""",
    "rows",
)
def change_point(t: Tables) -> DataFrame:
    return rnd(TS.change_point(TS.monthly(t.rows, ["set_name"]), ["set_name"]))


@query(
    "within_item_slope",
    """SELECT item, round(regr_slope(value, log2(dose + 1)), 8) AS slope FROM cells GROUP BY item HAVING min(dose) < max(dose)""", "cells",
)
def within_item_slope(t: Tables) -> DataFrame:
    return rnd(DO.within_item_slope(t.cells, ["item"], F.log2(F.col("dose") + 1), F.col("value")))


@query(
    "complete_dose_slope",
    """WITH c AS (SELECT item FROM cells WHERE dose IN (1, 2, 4) GROUP BY item HAVING count(DISTINCT dose) = 3)
       SELECT item, round(regr_slope(ln(value), log2(dose)), 8) AS slope FROM cells JOIN c USING (item) WHERE dose IN (1, 2, 4) GROUP BY item""", "cells",
)
def complete_dose_slope(t: Tables) -> DataFrame:
    full = DO.complete_items(t.cells, "item", "dose", (1, 2, 4))
    return rnd(DO.within_item_slope(full, ["item"], F.log2("dose"), F.ln("value")))


@query(
    "first_last_contrast",
    """WITH n AS (SELECT conv_id, max(turn) AS n FROM conversations GROUP BY 1)
       SELECT conv_id, arg_min(length(text), turn)::DOUBLE AS first, max(length(text)) FILTER (turn = ceil(n / 2.0))::DOUBLE AS middle, arg_max(length(text), turn)::DOUBLE AS last,
         (arg_min(length(text), turn) - arg_max(length(text), turn))::DOUBLE AS first_minus_last, any_value(n) AS n FROM conversations JOIN n USING (conv_id) GROUP BY 1""",
)
def first_last_contrast(t: Tables) -> DataFrame:
    return DO.first_last_contrast(t.conversations, ["conv_id"], "turn", F.length("text"))


@query(
    "prefix_reveal",
    """WITH s AS (SELECT conv_id, list(trim(text) ORDER BY turn) AS t FROM conversations GROUP BY 1)
       SELECT conv_id, k, len(t) AS n_sentences, round(k / len(t), 8) AS fraction, md5(array_to_string(t[1:k], ' ')) AS h FROM (SELECT conv_id, t, unnest(range(1, len(t) + 1)) AS k FROM s)""",
)
def prefix_reveal(t: Tables) -> DataFrame:
    p = DO.prefix_reveal(t.conversations, "conv_id", "turn", "text")
    return p.select("conv_id", "k", "n_sentences", F.round("fraction", 8).alias("fraction"), F.md5("clues").alias("h"))


@query(
    "holm",
    """WITH p AS (SELECT set_name, month, avg(correct::INT) / 20 AS p FROM rows GROUP BY 1, 2),
       s AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY set_name) - row_number() OVER (PARTITION BY set_name ORDER BY p, month) + 1) * p) AS step FROM p)
       SELECT set_name, month, round(max(step) OVER (PARTITION BY set_name ORDER BY p, month), 8) AS p_holm FROM s""",
    "rows",
)
def holm(t: Tables) -> DataFrame:
    p = t.rows.groupBy("set_name", "month").agg((F.avg(F.col("correct").cast("double")) / 20).alias("p"))
    return rnd(I.holm(p, ["set_name"], "p", order=["month"]).select("set_name", "month", "p_holm"))


@query(
    "ece",
    """SELECT set_name, round(sum(abs(d)) / sum(n), 8) AS ece FROM (SELECT set_name, least(floor(p_max * 15), 14) AS bin, count(*) AS n, sum(correct::INT - p_max) AS d FROM rows GROUP BY 1, 2) GROUP BY 1""",
    "rows",
)
def ece(t: Tables) -> DataFrame:
    return rnd(C.ece(t.rows, ["set_name"], "p_max", "correct"))


BINS_SQL = f"""b AS (SELECT set_name, (ntile(10) OVER (PARTITION BY set_name ORDER BY p_max, {TIE.format(u='unit')}) - 1)::INT AS bin, p_max, correct FROM rows),
   g AS (SELECT set_name, bin, avg(p_max) AS confidence, avg(correct::INT) AS accuracy, count(*) AS n FROM b GROUP BY 1, 2)"""


@query("reliability_bins", f"WITH {BINS_SQL} SELECT set_name, bin, round(confidence, 8) AS confidence, round(accuracy, 8) AS accuracy, n FROM g", "rows")
def reliability_bins(t: Tables) -> DataFrame:
    return rnd(C.reliability_bins(R.with_tie(t.rows, "unit"), ["set_name"], "p_max", "correct", 10, "tie"))


@query(
    "merge_tied_bins",
    f"""WITH RECURSIVE {BINS_SQL},
       walk AS (SELECT set_name, bin, 0 AS island, confidence, accuracy, n::DOUBLE AS n FROM g WHERE bin = 0
         UNION ALL SELECT g.set_name, g.bin,
           CASE WHEN round_even(w.confidence, 1) = round_even(g.confidence, 1) THEN w.island ELSE w.island + 1 END,
           CASE WHEN round_even(w.confidence, 1) = round_even(g.confidence, 1) THEN (w.confidence * w.n + g.confidence * g.n) / (w.n + g.n) ELSE g.confidence END,
           CASE WHEN round_even(w.confidence, 1) = round_even(g.confidence, 1) THEN (w.accuracy * w.n + g.accuracy * g.n) / (w.n + g.n) ELSE g.accuracy END,
           CASE WHEN round_even(w.confidence, 1) = round_even(g.confidence, 1) THEN w.n + g.n ELSE g.n END
         FROM walk w JOIN g ON g.set_name = w.set_name AND g.bin = w.bin + 1)
       SELECT set_name, island AS bin, round(arg_max(confidence, bin), 8) AS confidence, round(arg_max(accuracy, bin), 8) AS accuracy, arg_max(n, bin)::BIGINT AS n FROM walk GROUP BY 1, 2""",
    "rows",
)
def merge_tied_bins(t: Tables) -> DataFrame:
    bins = C.reliability_bins(R.with_tie(t.rows, "unit"), ["set_name"], "p_max", "correct", 10, "tie")
    return rnd(C.merge_tied_bins(bins, ["set_name"], 1))


@query(
    "fixed_width_reliability",
    """WITH b AS (SELECT floor(round((p_max - 0.5) * 10, 6))::INT AS band, avg(p_max) AS confidence, avg(correct::INT) AS p, count(*)::DOUBLE AS n FROM (SELECT least(p_max, 0.9999999) AS p_max, correct FROM rows) GROUP BY 1 HAVING count(*) >= 30)
       SELECT band, round(p, 8) AS accuracy, n::BIGINT AS n, round(((p + 1.96*1.96/(2*n)) - 1.96 * sqrt(p*(1-p)/n + 1.96*1.96/(4*n*n))) / (1 + 1.96*1.96/n), 8) AS lo,
         round(((p + 1.96*1.96/(2*n)) + 1.96 * sqrt(p*(1-p)/n + 1.96*1.96/(4*n*n))) / (1 + 1.96*1.96/n), 8) AS hi FROM b""",
    "rows",
)
def fixed_width_reliability(t: Tables) -> DataFrame:
    edges = (0.5, 0.6, 0.7, 0.8, 0.9, 1.0001)
    df = t.rows.withColumn("band", C.band_of(F.col("p_max"), edges))
    g = df.groupBy("band").agg(F.avg(F.col("correct").cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n")).filter("n >= 30")
    w = wilson(F.col("accuracy"), F.col("n"))
    return rnd(g.select("band", "accuracy", "n", w["lo"].alias("lo"), w["hi"].alias("hi")))


BAND_SQL = "CASE WHEN p_max < 0.6 THEN 0 WHEN p_max < 0.7 THEN 1 WHEN p_max < 0.8 THEN 2 WHEN p_max < 0.9 THEN 3 ELSE 4 END"


@query(
    "band_table",
    f"""SELECT {BAND_SQL}::INT AS band, count(*) FILTER (NOT post) AS n_pre, count(*) FILTER (post) AS n_post,
       round(avg(correct::INT) FILTER (NOT post), 8) AS acc_pre, round(avg(correct::INT) FILTER (post), 8) AS acc_post,
       round(avg(p_max) FILTER (NOT post), 8) AS conf_pre, round(avg(p_max) FILTER (post), 8) AS conf_post FROM rows GROUP BY 1
       UNION ALL SELECT 5, 0, 0, NULL, NULL, NULL, NULL""",
    "rows",
)
def band_table(t: Tables) -> DataFrame:
    """The last band lies above every score and stays, empty."""
    out = C.band_table(t.rows, [], (*C.COARSE_BANDS, 2.0))
    return rnd(out.drop("low", "high"))


@query(
    "single_map_gaps",
    f"""WITH b AS (SELECT {BAND_SQL} AS band, post, count(*) AS n, sum(correct::INT) AS k FROM rows GROUP BY 1, 2),
       m AS (SELECT *, sum(k) OVER (PARTITION BY band) / sum(n) OVER (PARTITION BY band) AS m FROM b)
       SELECT round(sum(n * m - k) FILTER (NOT post) / sum(n) FILTER (NOT post), 8) AS mean_gap_pre, round(sum(n * m - k) FILTER (post) / sum(n) FILTER (post), 8) AS mean_gap_post,
         round(sum(abs(n * m - k)) FILTER (NOT post) / sum(n) FILTER (NOT post), 8) AS weighted_abs_band_gap_pre,
         round(sum(abs(n * m - k)) FILTER (post) / sum(n) FILTER (post), 8) AS weighted_abs_band_gap_post FROM m""",
    "rows",
)
def single_map_gaps(t: Tables) -> DataFrame:
    return rnd(C.single_map_gaps(t.rows, [], C.COARSE_BANDS))


LEVEL_SQL = """SELECT p_max AS v, (count(*) FILTER (NOT post))::DOUBLE AS n_pre, (count(*) FILTER (NOT post AND correct))::DOUBLE AS k_pre,
       (count(*) FILTER (post))::DOUBLE AS n_post, (count(*) FILTER (post AND correct))::DOUBLE AS k_post FROM rows GROUP BY 1"""


@query("level_table", LEVEL_SQL, "rows")
def level_table(t: Tables) -> DataFrame:
    return C.level_table(t.rows, [])


@query(
    "every_map_lower_bound",
    f"SELECT round(sum(least(n_pre, n_post) * abs(k_pre / n_pre - k_post / n_post)) / sum(n_pre + n_post), 8) AS lower_bound FROM ({LEVEL_SQL})", "rows",
)
def every_map_lower_bound(t: Tables) -> DataFrame:
    return rnd(C.every_map_lower_bound(C.level_table(t.rows, []), []))


@query(
    "apply_levels",
    """WITH l AS (SELECT set_name = 'A' AS fitted, floor(p_max * 5) AS g, (count(*) FILTER (NOT post))::DOUBLE AS n0, (count(*) FILTER (NOT post AND correct))::DOUBLE AS k0,
          (count(*) FILTER (post))::DOUBLE AS n1, (count(*) FILTER (post AND correct))::DOUBLE AS k1 FROM rows GROUP BY 1, 2),
       f AS (SELECT g, CASE WHEN n0 >= n1 THEN k0 / n0 ELSE k1 / n1 END AS c FROM l WHERE fitted)
       SELECT round(sum(n0 * abs(c - k0 / n0) + n1 * abs(c - k1 / n1)) / sum(n0 + n1), 8) AS held_out_gap FROM l JOIN f USING (g) WHERE NOT fitted""",
    "rows",
)
def apply_levels(t: Tables) -> DataFrame:
    """A five-group map fitted on one set and held out on the others."""
    rows = t.rows.withColumns({"g": F.floor(F.col("p_max") * 5), "fitted": F.col("set_name") == "A"})
    lv = C.level_table(rows, ["fitted", "g"])
    fit, held = lv.filter("fitted"), lv.filter("NOT fitted")
    return rnd(C.apply_levels(fit, held, [], "g"))


@query(
    "closed_form_intervals",
    """SELECT month, round(m - 1.96 * s / sqrt(n), 8) AS mean_lo, round(m + 1.96 * s / sqrt(n), 8) AS mean_hi,
         round(greatest(0, ((p + 1.96*1.96/(2*n)) - 1.96 * sqrt(p*(1-p)/n + 1.96*1.96/(4*n*n))) / (1 + 1.96*1.96/n)), 8) AS p_lo,
         round(least(1, ((p + 1.96*1.96/(2*n)) + 1.96 * sqrt(p*(1-p)/n + 1.96*1.96/(4*n*n))) / (1 + 1.96*1.96/n)), 8) AS p_hi
       FROM (SELECT month, avg(p_max) AS m, stddev_samp(p_max) AS s, avg(correct::INT) AS p, count(*)::DOUBLE AS n FROM rows GROUP BY 1)""",
    "rows",
)
def closed_form_intervals(t: Tables) -> DataFrame:
    g = t.rows.groupBy("month").agg(
        F.avg("p_max").alias("m"), F.stddev_samp("p_max").alias("s"), F.avg(F.col("correct").cast("double")).alias("p"), F.count(F.lit(1)).alias("n")
    )
    a, w = normal_interval(F.col("m"), F.col("s"), F.col("n")), wilson(F.col("p"), F.col("n"))
    return rnd(g.select("month", a["lo"].alias("mean_lo"), a["hi"].alias("mean_hi"), w["lo"].alias("p_lo"), w["hi"].alias("p_hi")))


@query("smece")
def smece(t: Tables) -> DataFrame:
    """Smooth calibration error per set and period."""
    return rnd(C.smece(t.rows, ["set_name", "post"], "p_max", "correct"), digits=6)
