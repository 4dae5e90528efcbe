"""Queries that score answers and summarise rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credalis.functions import dist as D
from credalis.operators import scoring as S
from credalis.operators import summaries as SU
from credalis.operators.replicates import every_pair
from credalis.plans.catalog import query
from credalis.plans.q_rank import rnd
from credalis.plans.views import OPTIONS, Tables

REP_TV = """(SELECT a.unit, avg(0.5 * (abs(a.pa-b.pa) + abs(a.pb-b.pb) + abs(a.pc-b.pc) + abs(a.pd-b.pd))) AS rep_tv
   FROM answers a JOIN answers b ON a.unit = b.unit AND a.replicate < b.replicate GROUP BY a.unit)"""


@query(
    "replicate_mean",
    """SELECT set_name, gold, count(*) AS n, round(avg(pa), 8) AS a, round(avg(pb), 8) AS b, round(avg(pc), 8) AS c, round(avg(pd), 8) AS d FROM unit_mean GROUP BY 1, 2""",
    "unit_mean",
)
def replicate_mean(t: Tables) -> DataFrame:
    m = S.distribution_of(S.replicate_mean(t.answers, ["set_name", "gold", "unit"]), ["set_name", "gold", "unit"])
    p = {o.lower(): D.prob("dist", F.lit(o)) for o in OPTIONS}
    return rnd(m.groupBy("set_name", "gold").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(k) for k, c in p.items()]))


@query(
    "score_items",
    f"""SELECT set_name, count(*) AS n, round(avg((top = gold)::INT), 8) AS accuracy, round(avg(p_max), 8) AS p_max, round(avg(p_gold), 8) AS p_gold,
       round(avg(norm_entropy), 8) AS norm_entropy, round(avg(rep_tv), 8) AS rep_tv, round(avg(p_known), 8) AS p_known, round(avg(s_level), 8) AS s_level, sum(models)::BIGINT AS models
       FROM unit_mean JOIN {REP_TV} USING (unit) JOIN (SELECT unit, count(DISTINCT model) AS models FROM answers GROUP BY 1) USING (unit) GROUP BY 1""",
    ("unit_mean", "answers"),
)
def score_items(t: Tables) -> DataFrame:
    a = t.answers
    items = a.filter("replicate = 0").select("unit", "set_name", "options", "gold")
    rows = S.score_items(a.select("unit", "dist", "model", "known", "level"), items, yes_no=["known"], scores=["level"])
    return rnd(rows.groupBy("set_name").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg("p_max").alias("p_max"),
        F.avg("p_gold").alias("p_gold"), F.avg("norm_entropy").alias("norm_entropy"), F.avg("rep_tv").alias("rep_tv"),
        F.avg("p_known").alias("p_known"), F.avg("s_level").alias("s_level"), F.sum(F.size("models")).alias("models"),
    ))


@query(
    "aggregate_cells",
    """WITH g AS (SELECT unit, stddev_samp(CASE gold WHEN 'A' THEN pa WHEN 'B' THEN pb WHEN 'C' THEN pc ELSE pd END) AS sd FROM answers GROUP BY 1)
       SELECT set_name, count(*) AS n, round(avg(p_gold), 8) AS p_gold, round(avg(p_max), 8) AS p_max, round(avg((top = gold)::INT), 8) AS accuracy,
       round(avg((top = 'A')::INT), 8) AS first_listed, round(avg((top = 'B')::INT), 8) AS swap_target, round(avg(norm_entropy), 8) AS norm_entropy,
       round(avg(-ln(greatest(p_gold, 1e-12))), 8) AS nll, round(avg(pa*pa + pb*pb + pc*pc + pd*pd - 2*p_gold + 1), 8) AS brier, round(avg(sd), 8) AS rep_sd
       FROM unit_mean JOIN g USING (unit) GROUP BY 1""",
    ("unit_mean", "answers"),
)
def aggregate_cells(t: Tables) -> DataFrame:
    rows = t.answers.withColumns({"first_listed": F.lit("A"), "swap_target": F.lit("B")})
    c = S.aggregate_cells(rows, ["set_name", "unit"])
    return rnd(c.groupBy("set_name").agg(
        F.count(F.lit(1)).alias("n"), F.avg("p_gold").alias("p_gold"), F.avg("p_max").alias("p_max"),
        F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg(F.col("chose_first_listed").cast("double")).alias("first_listed"),
        F.avg(F.col("chose_swap_target").cast("double")).alias("swap_target"), F.avg("norm_entropy").alias("norm_entropy"),
        F.avg("nll").alias("nll"), F.avg("brier").alias("brier"), F.avg("rep_sd_p_gold").alias("rep_sd"),
    ))


@query(
    "replicate_spread",
    f"""WITH f AS (SELECT unit, any_value(set_name) AS set_name, count(DISTINCT CASE greatest(pa,pb,pc,pd) WHEN pa THEN 'A' WHEN pb THEN 'B' WHEN pc THEN 'C' ELSE 'D' END) > 1 AS flip FROM answers GROUP BY 1)
       SELECT set_name, count(*) AS n, round(avg(rep_tv), 8) AS rep_tv, round(avg(flip::INT), 8) AS flip_rate FROM f JOIN {REP_TV} USING (unit) GROUP BY 1""",
    "answers",
)
def replicate_spread(t: Tables) -> DataFrame:
    k = ["set_name", "unit"]
    j = S.replicate_spread(t.answers, k).join(S.top_flips(t.answers, k), k)
    return rnd(j.groupBy("set_name").agg(
        F.count(F.lit(1)).alias("n"), F.avg("rep_tv").alias("rep_tv"), F.avg(F.col("rep_flip").cast("double")).alias("flip_rate")
    ))


@query(
    "group_summary",
    """SELECT set_name, month, post, grouping(set_name, month, post)::BIGINT AS "grouping", count(*) AS n, round(avg(correct::INT), 8) AS accuracy,
       round(avg(p_max), 8) AS mean_p_max, round(avg(p_known), 8) AS mean_p_known, round(avg(p_max - correct::INT), 8) AS gap
       FROM rows GROUP BY GROUPING SETS ((set_name), (month), (set_name, post), ())""",
    "rows",
)
def group_summary(t: Tables) -> DataFrame:
    return rnd(SU.group_summary(t.rows, [["set_name"], ["month"], ["set_name", "post"], []]))


@query(
    "proper_scores",
    """SELECT set_name, replicate, count(*) AS n, round(avg((CASE greatest(pa,pb,pc,pd) WHEN pa THEN 'A' WHEN pb THEN 'B' WHEN pc THEN 'C' ELSE 'D' END = gold)::INT), 8) AS accuracy,
       round(avg(pa*pa+pb*pb+pc*pc+pd*pd - 2*p + 1), 8) AS brier, round(avg(-ln(greatest(p, 1e-4))), 8) AS log_loss, round(avg((p = 0)::INT), 8) AS zero_on_answer,
       round(0.75, 8)::DOUBLE AS uniform_brier, round(ln(4), 8) AS uniform_log_loss
       FROM (SELECT *, CASE gold WHEN 'A' THEN pa WHEN 'B' THEN pb WHEN 'C' THEN pc ELSE pd END AS p FROM answers) GROUP BY 1, 2""",
    "answers",
)
def proper_scores(t: Tables) -> DataFrame:
    df = t.answers.withColumn("correct", D.top_option("dist", "options") == F.col("gold"))
    return rnd(SU.proper_scores(df, ["set_name", "replicate"]))


def scope(t: Tables) -> DataFrame:
    """Replicate 0 plays the closed question, with option D as "none fits".

    A generator is a barrier: the top option is worked out once per answer, whatever is
    filtered or derived from it above.
    """
    kept = ["unit", "set_name", "month", "post", "replicate", "dist", "options", "gold"]
    best = F.struct(D.top_option("dist", "options").alias("top"), F.array_max(F.map_values("dist")).alias("p_max"))
    s = t.answers.select(*kept, "known", F.inline(F.array(best)))
    return s.select(*kept, "top", "p_max", (F.col("top") == F.col("gold")).alias("correct"), "known")


TOP_CTE = """t AS (SELECT *, CASE greatest(pa,pb,pc,pd) WHEN pa THEN 'A' WHEN pb THEN 'B' WHEN pc THEN 'C' ELSE 'D' END AS top, greatest(pa,pb,pc,pd) AS p_max FROM answers)"""


def _top_from(opts: str) -> str:
    whens = " ".join(f"WHEN p{o.lower()} THEN '{o}'" for o in opts)
    return f"CASE greatest(pa,pb,pc,pd) {whens} END"


# Ties go to the option shown first, and replicate r shows the options rotated by r.
ROTATED_CTE = f"""t AS (SELECT *, CASE replicate WHEN 0 THEN {_top_from('ABCD')} WHEN 1 THEN {_top_from('BCDA')} ELSE {_top_from('CDAB')} END AS top,
   greatest(pa,pb,pc,pd) AS p_max FROM answers)"""


@query(
    "coverage_table",
    f"""WITH {TOP_CTE} SELECT replicate, post, count(*) AS n, round(avg((top <> 'D')::INT), 8) AS coverage, round(avg((top = gold)::INT) FILTER (top <> 'D'), 8) AS accuracy_answered,
       round(avg((top <> 'D' AND top <> gold AND p_max >= 0.5)::INT), 8) AS confident_errors_of_all, round(avg((top <> gold AND p_max >= 0.5)::INT) FILTER (top <> 'D'), 8) AS confident_errors_of_answered
       FROM t GROUP BY 1, 2""",
    "answers",
)
def coverage_table(t: Tables) -> DataFrame:
    return rnd(SU.coverage_table(scope(t), ["replicate", "post"], "D", 0.5))


def _balance(t: Tables) -> DataFrame:
    return t.rows.select(
        "post", F.col("set_name").alias("category"), "month", (F.col("p_known") < 0.5).alias("gold_no"),
        (F.col("p_max") < 0.75).alias("pred_no"), ((F.col("p_known") < 0.5) == (F.col("p_max") < 0.75)).alias("correct"),
    )


BALANCE_CTE = "b AS (SELECT post, set_name AS category, month, p_known < 0.5 AS no, p_max < 0.75 AS said, (p_known < 0.5) = (p_max < 0.75) AS ok FROM rows)"


@query(
    "label_balance",
    f"""WITH {BALANCE_CTE} SELECT * FROM (SELECT post, category, month, grouping(post, category, month)::BIGINT AS "grouping", count(*) AS n, round(avg(no::INT), 8) AS true_no, round(avg(said::INT), 8) AS predicted_no,
       round(avg(ok::INT), 8) AS accuracy, round(avg(ok::INT) FILTER (said), 8) AS accuracy_predicting_no, round(avg(ok::INT) FILTER (NOT said), 8) AS accuracy_predicting_yes,
       round(avg(ok::INT) FILTER (no), 8) AS accuracy_on_no, round(avg(ok::INT) FILTER (NOT no), 8) AS accuracy_on_yes FROM b GROUP BY GROUPING SETS ((post), (post, category), (post, month)))
       WHERE "grouping" <> 1 OR n >= 30""",
    "rows",
)
def label_balance(t: Tables) -> DataFrame:
    return rnd(SU.label_balance(_balance(t)))


@query(
    "mix_shift",
    f"""WITH {BALANCE_CTE}, c AS (SELECT category, count(*) FILTER (NOT post) AS n0, count(*) FILTER (post) AS n1, avg(ok::INT) FILTER (NOT post) AS a0, avg(ok::INT) FILTER (post) AS a1 FROM b GROUP BY 1)
       SELECT round(sum(abs(n0 / (SELECT sum(n0) FROM c) - n1 / (SELECT sum(n1) FROM c))) / 2, 8) AS category_share_tv, round(sum((a0 - a1) * n1) / sum(n1), 8) AS within_category_drop FROM c""",
    "rows",
)
def mix_shift(t: Tables) -> DataFrame:
    return rnd(SU.mix_shift(_balance(t)))


@query(
    "month_ranges",
    f"""WITH {BALANCE_CTE}, m AS (SELECT post, month, avg(no::INT) AS x FROM b GROUP BY 1, 2) SELECT post, round(min(x), 8) AS low, round(max(x), 8) AS high, count(*) AS months FROM m GROUP BY 1""",
    "rows",
)
def month_ranges(t: Tables) -> DataFrame:
    return rnd(SU.month_ranges(SU.label_balance(_balance(t))))


@query(
    "threshold_coverage",
    """SELECT set_name, count(*) AS n, """ + ", ".join(
        f"round(avg((p_max >= {x})::INT), 8) AS coverage_{int(x * 100)}, round(avg(correct::INT) FILTER (p_max >= {x}), 8) AS accuracy_{int(x * 100)}" for x in (0.5, 0.7, 0.9)
    ) + ", round(avg((p_max >= 0.9 AND NOT correct)::INT), 8) AS confident_wrong FROM rows GROUP BY 1",
    "rows",
)
def threshold_coverage(t: Tables) -> DataFrame:
    return rnd(SU.threshold_coverage(t.rows, ["set_name"]))


@query(
    "scope_rates",
    f"""WITH {TOP_CTE}, s AS (SELECT *, gold = 'D' AS oos FROM t)
       SELECT set_name, count(*) FILTER (NOT oos) AS n_in_scope, count(*) FILTER (oos) AS n_oos, round(avg((top = gold)::INT) FILTER (NOT oos), 8) AS accuracy_closed, round(avg((top = gold)::INT) FILTER (NOT oos), 8) AS accuracy_with_oos,
       round(avg((top = 'D')::INT) FILTER (oos), 8) AS recall_with_oos, round(avg((top = 'D')::INT) FILTER (NOT oos), 8) AS false_alarm_with_oos, round(avg((known < 0.5)::INT) FILTER (oos), 8) AS recall_fits,
       round(avg((known < 0.5)::INT) FILTER (NOT oos), 8) AS false_alarm_fits FROM s GROUP BY 1""",
    "answers",
)
def scope_rates(t: Tables) -> DataFrame:
    s = scope(t).select(
        "set_name", "gold", (F.col("gold") == "D").alias("oos"), F.col("top").alias("closed_choice"),
        F.col("top").alias("with_oos_choice"), F.col("known").alias("p_fits"),
    )
    return rnd(SU.scope_rates(s, ["set_name"], "D"))


@query(
    "replicate_variance",
    """WITH o AS (SELECT set_name, unit, option, avg(p) AS m, var_samp(p) AS v FROM answers_long GROUP BY 1, 2, 3), k AS (SELECT * FROM o WHERE m BETWEEN 0.05 AND 0.95)
       SELECT set_name, count(*) AS options, round(sum(m * (1 - m)) / sum(v), 7) AS pooled_n, round(min(v / (m * (1 - m) / 100)), 7) AS ratio_min, round(max(v / (m * (1 - m) / 100)), 7) AS ratio_max,
       round(avg(v / (m * (1 - m) / 100)), 7) AS ratio_mean FROM k GROUP BY 1""",
    "answers_long",
)
def replicate_variance(t: Tables) -> DataFrame:
    return rnd(SU.replicate_variance(t.answers, ["set_name"], ["unit"], OPTIONS), digits=7)


@query(
    "top2_correlation",
    """WITH m AS (SELECT set_name, replicate, avg(pa) AS a, avg(pb) AS b, avg(pc) AS c, avg(pd) AS d FROM answers GROUP BY 1, 2),
       r AS (SELECT set_name, replicate, option, pos, avg(p) AS m FROM answers_long GROUP BY ALL),
       k AS (SELECT *, row_number() OVER (PARTITION BY set_name, replicate ORDER BY m DESC, pos) AS rk FROM r),
       two AS (SELECT set_name, replicate, max(option) FILTER (rk = 1) AS o1, max(option) FILTER (rk = 2) AS o2 FROM k GROUP BY 1, 2)
       SELECT set_name, replicate, round(corr(x.p, y.p), 8) AS top2_corr FROM two JOIN answers_long x USING (set_name, replicate) JOIN answers_long y USING (set_name, replicate, unit)
       WHERE x.option = o1 AND y.option = o2 GROUP BY 1, 2""",
    ("answers", "answers_long"),
)
def top2_correlation(t: Tables) -> DataFrame:
    """A series is a (set, replicate): hundreds of thousands of draws in one group."""
    return rnd(SU.top2_correlation(t.answers, ["set_name", "replicate"]))


@query(
    "order_invariance",
    f"""WITH {TOP_CTE}, j AS (SELECT a.unit, avg((a.pa*ln(2*a.pa/(a.pa+b.pa)) + b.pa*ln(2*b.pa/(a.pa+b.pa)) + a.pb*ln(2*a.pb/(a.pb+b.pb)) + b.pb*ln(2*b.pb/(a.pb+b.pb))
         + a.pc*ln(2*a.pc/(a.pc+b.pc)) + b.pc*ln(2*b.pc/(a.pc+b.pc)) + a.pd*ln(2*a.pd/(a.pd+b.pd)) + b.pd*ln(2*b.pd/(a.pd+b.pd))) / 2) AS js FROM answers a JOIN answers b ON a.unit = b.unit AND a.replicate < b.replicate GROUP BY 1),
       g AS (SELECT unit, any_value(set_name) AS set_name, count(DISTINCT top) = 1 AS agree FROM t GROUP BY 1)
       SELECT set_name, count(*) AS n, round(avg(js), 8) AS mean_js, round(max(js), 8) AS max_js, round(avg(agree::INT), 8) AS agreement FROM g JOIN j USING (unit) GROUP BY 1""",
    "answers",
)
def order_invariance(t: Tables) -> DataFrame:
    o = S.order_invariance(t.answers, ["set_name", "unit"])
    return rnd(o.groupBy("set_name").agg(
        F.count(F.lit(1)).alias("n"), F.avg("mean_js").alias("mean_js"), F.max("mean_js").alias("max_js"), F.avg(F.col("agree").cast("double")).alias("agreement")
    ))


@query(
    "cost_latency_summary",
    """WITH l AS (SELECT event_type, 'value' AS metric, value FROM events UNION ALL SELECT event_type, 'k', CAST(json_extract(props, '$.k') AS DOUBLE) FROM events)
       SELECT event_type, metric, count(*) AS n, round(min(value), 8) AS min, round(median(value), 8) AS median, round(max(value), 8) AS max, round(avg(value), 8) AS mean FROM l GROUP BY 1, 2""",
)
def cost_latency_summary(t: Tables) -> DataFrame:
    df = t.events.select("event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    return rnd(SU.cost_latency_summary(df, ["event_type"], ["value", "k"]))


def _orders(t: Tables) -> DataFrame:
    """Answers as listings: the option order is rotated by the replicate."""
    rot = F.concat(F.slice("options", F.col("replicate") + 1, 4 - F.col("replicate")), F.slice("options", 1, F.col("replicate")))
    ideal = F.create_map(*[x for o, p in zip(OPTIONS, (0.4, 0.3, 0.2, 0.1), strict=True) for x in (F.lit(o), F.lit(p))])
    return t.answers.withColumn("options", rot).withColumn("ideal", ideal)


@query(
    "order_averaged_tv",
    """SELECT set_name, round(0.5 * (abs(avg(pa) - 0.4) + abs(avg(pb) - 0.3) + abs(avg(pc) - 0.2) + abs(avg(pd) - 0.1)), 8) AS tv_of_mean FROM answers GROUP BY 1""", "answers",
)
def order_averaged_tv(t: Tables) -> DataFrame:
    return rnd(SU.order_averaged_tv(_orders(t), ["set_name"]))


@query(
    "by_label_and_position",
    f"""WITH {ROTATED_CTE}, l AS (SELECT set_name, o.opt AS label, (o.pos - replicate + 4) % 4 AS position, CASE o.opt WHEN 'A' THEN pa WHEN 'B' THEN pb WHEN 'C' THEN pc ELSE pd END AS p, top = o.opt AS hit
         FROM t, (SELECT unnest(['A','B','C','D']) AS opt, unnest([0,1,2,3]) AS pos) o)
       SELECT set_name, label, position, round(avg(p), 8) AS mean_p, count(*) FILTER (hit) AS top_count FROM l GROUP BY GROUPING SETS ((set_name, label), (set_name, position))""",
    "answers",
)
def by_label_and_position(t: Tables) -> DataFrame:
    return rnd(SU.by_label_and_position(_orders(t), ["set_name"]))


@query("averaging_curve")
def averaging_curve(t: Tables) -> DataFrame:
    """Random orders of every set averaged in nested sizes."""
    return rnd(SU.averaging_curve(_orders(t), ["set_name"], ["unit", "replicate"], (1, 2, 4, 8, 16, 64), 8))


@query(
    "mode_share",
    f"""WITH {ROTATED_CTE} SELECT set_name, replicate, count(*) AS n, round(avg(pa + pb), 8) AS mass_on_modes, round(avg((top IN ('A', 'B'))::INT), 8) AS top_is_mode,
       round(avg((top = ['A','B','C'][replicate + 1])::INT), 8) AS top_is_first, round(avg(p_max), 8) AS mean_p_max FROM t GROUP BY 1, 2""",
    "answers",
)
def mode_share(t: Tables) -> DataFrame:
    two = F.create_map(*[x for o, p in zip(OPTIONS, (0.4, 0.4, 0.1, 0.1), strict=True) for x in (F.lit(o), F.lit(p))])
    return rnd(SU.mode_share(_orders(t).withColumn("ideal", two), ["set_name", "replicate"]))


@query(
    "human_agreement",
    """WITH h AS (SELECT set_name, pa, pb, pc, pd, pd AS ha, pc AS hb, pb AS hc, pa AS hd, known FROM answers)
       SELECT set_name, count(*) AS n, round(avg(abs(pa - pd) + abs(pb - pc)), 8) AS model_tv,
       round(avg(pa*ln(2*pa/(pa+pd)) + pd*ln(2*pd/(pa+pd)) + pb*ln(2*pb/(pb+pc)) + pc*ln(2*pc/(pb+pc))), 8) AS model_js,
       round(avg(0.5 * (abs(ha-0.25)+abs(hb-0.25)+abs(hc-0.25)+abs(hd-0.25))), 8) AS uniform_tv, round(avg(1 - greatest(ha,hb,hc,hd)), 8) AS majority_tv,
       round(avg(0.5 * (abs(ha-0.6)+abs(hb-0.4)+hc+hd)) FILTER (known >= 0.5), 8) AS panel_tv, round(avg(abs(pa - pd) + abs(pb - pc)) FILTER (known >= 0.5), 8) AS model_tv_same_items FROM h GROUP BY 1""",
    "answers",
)
def human_agreement(t: Tables) -> DataFrame:
    opts = F.array(*[F.lit(o) for o in OPTIONS])
    human = F.map_from_arrays(opts, F.reverse(F.map_values("dist")))
    panel = F.when(F.col("known") >= 0.5, F.create_map(F.lit("A"), F.lit(0.6), F.lit("B"), F.lit(0.4)))
    return rnd(SU.human_agreement(t.answers.withColumns({"human": human, "panel": panel}), ["set_name"]))


@query(
    "paired_proposals",
    """WITH p AS (SELECT unnest([0, 0, 1]) AS i, unnest([1, 2, 2]) AS j),
       w AS (SELECT i || '-' || j AS pair, unit, any_value(post) AS post, max(known) FILTER (replicate = i) AS py, max(known) FILTER (replicate = j) AS pn, max(level / 9) FILTER (replicate = i) AS wy, max(level / 9) FILTER (replicate = j) AS wn, bool_or(gold = 'A') AS g
         FROM answers, p WHERE replicate IN (i, j) GROUP BY 1, 2)
       SELECT pair, post, count(*) AS n, round(avg(py + pn), 8) AS mean_sum, round(avg((py < 0.5 AND pn < 0.5)::INT), 8) AS rejects_both, round(avg((py > 0.5 AND pn > 0.5)::INT), 8) AS accepts_both, round(avg((py > pn)::INT), 8) AS implied_yes,
       round(avg(((py > pn) = g)::INT), 8) AS implied_accuracy, round(avg(py + wy), 8) AS coherence_yes, round(avg(pn + wn), 8) AS coherence_no, round(avg(((py > pn) = (wn > wy))::INT), 8) AS implied_agree, round(avg(wy - wn), 8) AS wrong_yes_minus_no FROM w GROUP BY 1, 2""",
    "answers",
)
def paired_proposals(t: Tables) -> DataFrame:
    return rnd(SU.paired_proposals(proposals(t), ["pair", "post"], ["unit"]))


def proposals(t: Tables) -> DataFrame:
    """Every pair of answers to a unit as a proposal and its opposite."""
    return every_pair(t.answers, 3).select(
        "pair", "post", "unit", F.when(F.col("side") == "a", "yes").otherwise("no").alias("proposed"), F.col("known").alias("p_correct"),
        (F.col("level") / 9).alias("p_wrong"), (F.col("gold") == "A").alias("gold_yes"),
    )


@query(
    "arm_contrast",
    """WITH w AS (SELECT unit, any_value(set_name) AS set_name, avg(known) FILTER (replicate = 0) AS a, avg(known) FILTER (replicate = 1) AS b FROM answers GROUP BY 1)
       SELECT set_name, count(*) AS n, round(avg(a), 8) AS mean_a, round(avg(b), 8) AS mean_b, round(avg(a - b), 8) AS difference, round(avg((a > b)::INT), 8) AS share_higher FROM w GROUP BY 1""",
    "answers",
)
def arm_contrast(t: Tables) -> DataFrame:
    df = t.answers.withColumn("arm", F.concat(F.lit("r"), F.col("replicate").cast("string")))
    return rnd(SU.arm_contrast(df, ["set_name"], ["unit"], "known", ("r0", "r1")))


WORDS_SQL = "len(string_split(text, ' '))"


@query(
    "length_profile",
    f"""WITH w AS (SELECT conv_id, turn, role, {WORDS_SQL} AS words FROM conversations)
       SELECT 'cell ' || role AS part, count(*) AS n, round(avg(words), 8) AS mean, round(stddev_samp(words), 8) AS sd FROM w GROUP BY role
       UNION ALL SELECT 'range', count(*), round(avg(r), 8), round(stddev_samp(r), 8) FROM (SELECT max(words) - min(words) AS r FROM w GROUP BY conv_id)""",
)
def length_profile(t: Tables) -> DataFrame:
    df = t.conversations.withColumn("words", F.size(F.split("text", " ")))
    cell, within = SU.length_profile(df, [], "role", ["conv_id"], "words")
    a = cell.select(F.concat(F.lit("cell "), F.col("role")).alias("part"), "n", F.col("words_mean").alias("mean"), F.col("words_sd").alias("sd"))
    b = within.agg(F.lit("range").alias("part"), F.count(F.lit(1)).alias("n"), F.avg("word_range").alias("mean"), F.stddev_samp("word_range").alias("sd"))
    return rnd(a.unionByName(b))


@query(
    "length_shift",
    f"""WITH w AS (SELECT conv_id, avg({WORDS_SQL}) FILTER (role = 'assistant') AS v, avg({WORDS_SQL}) FILTER (role = 'user') AS b FROM conversations GROUP BY 1), k AS (SELECT * FROM w WHERE v IS NOT NULL AND b IS NOT NULL)
       SELECT count(*) AS n, round(avg(v - b), 8) AS mean_difference, round(avg((v < b)::INT), 8) AS shorter, round(avg((v = b)::INT), 8) AS equal, round(avg((v > b)::INT), 8) AS longer FROM k""",
)
def length_shift(t: Tables) -> DataFrame:
    df = t.conversations.select("conv_id", F.col("role").alias("variant"), F.size(F.split("text", " ")).alias("words"))
    return rnd(SU.length_shift(df, [], ["conv_id"], "words", "user", "assistant"))


@query(
    "contrast_variants",
    """SELECT x.set_name, x.replicate AS variant_no, count(*) AS n, round(avg(x.pd), 8) AS mean_fallback, round(avg(CASE x.gold WHEN 'A' THEN x.pa WHEN 'B' THEN x.pb WHEN 'C' THEN x.pc ELSE x.pd END), 8) AS mean_p_gold,
       round(avg(0.5 * (abs(x.pa-b.pa) + abs(x.pb-b.pb) + abs(x.pc-b.pc) + abs(x.pd-b.pd))), 8) AS tv_to_base FROM answers x JOIN answers b ON x.unit = b.unit AND b.replicate = 0 GROUP BY 1, 2""",
    "answers",
)
def contrast_variants(t: Tables) -> DataFrame:
    df = t.answers.withColumn("variant", F.col("replicate"))
    return rnd(SU.contrast_variants(df, ["set_name"], ["unit"], "D", 0).withColumnRenamed("variant", "variant_no"))
