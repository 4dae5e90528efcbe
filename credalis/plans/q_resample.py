"""Resampling, inference and time-split queries.

Item draws with checking SQL use few resamples, as a check of the draws only. For
results, each has a sibling at full counts, ``_levels`` (from the count tree) or ``_full``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credalis.functions.seeded import poisson_thresholds
from credalis.operators import calibration as C
from credalis.operators import inference as I
from credalis.operators import ranking as R
from credalis.operators import resample as B
from credalis.operators import timesplit as TS
from credalis.plans.catalog import query
from credalis.plans.q_rank import BAND_SQL, CHANGE_SQL, auroc_sql, paired, rnd
from credalis.plans.q_score import scope
from credalis.plans.views import Tables

NB = 8
"""Resamples of a query whose SQL repeats every draw; its sibling ``_levels`` or ``_full`` takes the counts below."""
RESAMPLES, CALL_DRAWS, SPLITS, NULLS = 2000, 500, 50, 200


def weights_sql(src: str, unit: str, seed: str, b: int = NB) -> str:
    """Poisson(1) weights per row and resample, as the item scheme draws them."""
    hx = "substr(h, j * 4 + 1, 4)"
    w = " + ".join(f"({hx} >= '{x}')::INT" for x in poisson_thresholds())
    return f"""(SELECT * FROM (SELECT *, c * 8 + j AS b, ({w})::DOUBLE AS w FROM (SELECT *, md5('{seed}|' || {unit} || '|' || c) AS h FROM {src}, (SELECT unnest(range(0, {-(-b // 8)})) AS c)), (SELECT unnest(range(0, 8)) AS j)) WHERE w > 0 AND b < {b})"""


def ci_sql(v: str, prefix: str = "", lo: float = 0.025, hi: float = 0.975) -> str:
    return f"round(quantile_cont({v}, {lo}), 8) AS {prefix}lo, round(quantile_cont({v}, {hi}), 8) AS {prefix}hi"


def gap_rows(t: Tables) -> DataFrame:
    return t.rows.withColumn("gap", F.col("p_max") - F.col("correct").cast("double"))


GAPS = "g AS (SELECT *, p_max - correct::INT AS gap FROM rows)"


@query(
    "bootstrap_mean",
    f"""WITH {GAPS}, d AS (SELECT set_name, b, sum(w * gap) / sum(w) AS stat FROM {weights_sql('g', 'unit', 'boot')} GROUP BY 1, 2),
       i AS (SELECT set_name, {ci_sql('stat')}, round(avg((stat >= 0.1)::INT), 8) AS tail FROM d GROUP BY 1)
       SELECT set_name, count(*) AS n, round(avg(gap), 8) AS mean, any_value(lo) AS lo, any_value(hi) AS hi, any_value(tail) AS tail FROM g JOIN i USING (set_name) GROUP BY 1""",
    "rows",
)
def bootstrap_mean(t: Tables) -> DataFrame:
    return rnd(I.bootstrap_mean(gap_rows(t), ["set_name"], "gap", ["unit"], NB, 0.1, scheme="item"))


@query("bootstrap_mean_levels")
def bootstrap_mean_levels(t: Tables) -> DataFrame:
    """The same interval from 2,000 resamples of the count tree, at a cost independent of the rows."""
    return rnd(I.bootstrap_mean(gap_rows(t), ["set_name"], "gap", [], RESAMPLES, 0.1))


@query(
    "percentile_ci",
    """SELECT event_type, round(quantile_cont(value, 0.025), 8) AS lo, round(quantile_cont(value, 0.975), 8) AS hi FROM events WHERE event_id % 9 <> 0 GROUP BY 1""",
)
def percentile_ci(t: Tables) -> DataFrame:
    """Linear percentiles; NaN values are ignored."""
    v = F.when(F.col("event_id") % 9 == 0, float("nan")).otherwise(F.col("value"))
    df = t.events.select("event_type", v.alias("v")).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    q = R.weighted_percentiles(df, ["event_type"], "v", None, [0.025, 0.975])
    return rnd(q.select("event_type", F.col("q0").alias("lo"), F.col("q1").alias("hi")))


@query(
    "bootstrap_stat",
    f"""WITH e AS (SELECT set_name, b, sum(abs(d)) / sum(n) AS ece FROM (SELECT set_name, b, least(floor(p_max * 10), 9) AS bin, sum(w) AS n, sum(w * (correct::INT - p_max)) AS d FROM {weights_sql('rows', 'unit', 'boot')} GROUP BY 1, 2, 3) GROUP BY 1, 2),
       p AS (SELECT set_name, sum(abs(d)) / sum(n) AS ece FROM (SELECT set_name, least(floor(p_max * 10), 9) AS bin, count(*) AS n, sum(correct::INT - p_max) AS d FROM rows GROUP BY 1, 2) GROUP BY 1)
       SELECT set_name, round(any_value(p.ece), 8) AS ece, {ci_sql('e.ece')} FROM e JOIN p USING (set_name) GROUP BY 1""",
    "rows",
)
def bootstrap_stat(t: Tables) -> DataFrame:
    """Any metric on resamples: here the binned calibration error."""
    def metric(df: DataFrame, keys, w: str) -> DataFrame:
        return C.ece(df, keys, "p_max", "correct", 10, w)

    return rnd(I.bootstrap_stat(t.rows, ["set_name"], metric, "ece", ["unit"], ["p_max", "correct"], NB, scheme="item"))


@query("bootstrap_stat_levels")
def bootstrap_stat_levels(t: Tables) -> DataFrame:
    """The same interval from 2,000 resamples of the count tree."""
    return rnd(
        I.bootstrap_stat(t.rows, ["set_name"], lambda df, keys, w: C.ece(df, keys, "p_max", "correct", 10, w), "ece", [], ["p_max", "correct"], RESAMPLES)
    )


CLUSTER_W = """idx AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS idx, count(*) OVER () AS m FROM (SELECT DISTINCT month FROM rows)),
   dr AS (SELECT b, floor(m * (('0x' || substr(md5('boot|' || b || '|' || idx), 1, 8))::BIGINT / 4294967296.0::DOUBLE))::BIGINT AS idx FROM idx, (SELECT unnest(range(0, 2000)) AS b)),
   cw AS (SELECT month, b, count(*)::DOUBLE AS w FROM dr JOIN idx USING (idx) GROUP BY 1, 2)"""


@query(
    "cluster_bootstrap",
    f"""WITH {CLUSTER_W}, s AS (SELECT month, count(*) AS n, sum(p_max) AS s FROM rows GROUP BY 1), d AS (SELECT b, sum(w * s) / sum(w * n) AS stat FROM cw JOIN s USING (month) GROUP BY 1)
       SELECT (SELECT round(avg(p_max), 8) FROM rows) AS mean, (SELECT count(DISTINCT month) FROM rows) AS clusters, {ci_sql('stat')} FROM d""",
    "rows",
)
def cluster_bootstrap(t: Tables) -> DataFrame:
    return rnd(I.cluster_bootstrap(t.rows, [], "p_max", "month", 2000))


@query(
    "auroc_interval",
    f"""WITH d AS (SELECT set_name, b, sum(pos * (before + neg / 2)) / (sum(pos) * sum(neg)) AS auroc FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY set_name, b ORDER BY p_max ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
         FROM (SELECT set_name, b, p_max, sum(w * correct::INT) AS pos, sum(w * (NOT correct)::INT) AS neg FROM {weights_sql('rows', 'unit', 'boot')} GROUP BY 1, 2, 3)) GROUP BY 1, 2),
       i AS (SELECT set_name, {ci_sql('auroc')}, round(avg((auroc <= 0.7)::INT), 8) AS tail FROM d GROUP BY 1)
       SELECT set_name, round(auroc, 8) AS auroc, n, n_positive, lo, hi, tail FROM ({auroc_sql('rows', 'set_name', 'p_max', 'correct')}) JOIN i USING (set_name)""",
    "rows",
)
def auroc_interval(t: Tables) -> DataFrame:
    return rnd(I.auroc_interval(t.rows, ["set_name"], "p_max", "correct", NB, ["unit"], threshold=0.7, scheme="item"))


@query("auroc_interval_levels")
def auroc_interval_levels(t: Tables) -> DataFrame:
    """The same interval from 2,000 resamples of the count tree."""
    return rnd(I.auroc_interval(t.rows, ["set_name"], "p_max", "correct", RESAMPLES, threshold=0.7))


SEP = """SELECT b, sum(pos * (before + neg / 2)) / (sum(pos) * sum(neg)) AS auroc FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY b ORDER BY {s} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
   FROM (SELECT b, {s}, sum(w * post::INT) AS pos, sum(w * (NOT post)::INT) AS neg FROM (SELECT *, 1 - p_known AS unknown FROM rows) JOIN cw USING (month) GROUP BY 1, 2)) GROUP BY 1"""


@query(
    "separability",
    f"""WITH {CLUSTER_W} SELECT 'p_max' AS name, (SELECT round(auroc, 8) FROM ({auroc_sql('(SELECT *, 0 AS g FROM rows)', 'g', 'p_max', 'post')})) AS auroc, {ci_sql('auroc')} FROM ({SEP.format(s='p_max')})
       UNION ALL SELECT 'unknown', (SELECT round(auroc, 8) FROM ({auroc_sql('(SELECT *, 0 AS g, 1 - p_known AS unknown FROM rows)', 'g', 'unknown', 'post')})), {ci_sql('auroc')} FROM ({SEP.format(s='unknown')})""",
    "rows",
)
def separability(t: Tables) -> DataFrame:
    """Later against earlier period for two scores, months drawn as clusters."""
    df = t.rows.withColumn("unknown", 1 - F.col("p_known"))
    out = None
    for s in ("p_max", "unknown"):
        a = I.auroc_interval(df, [], s, "post", 2000, cluster="month").select(F.lit(s).alias("name"), "auroc", "lo", "hi")
        out = a if out is None else out.unionByName(a)
    return rnd(out)


@query("detection_interval")
def detection_interval(t: Tables) -> DataFrame:
    """Out-of-scope detection by low confidence."""
    df = scope(t).select(
        "unit", "replicate", "set_name", F.round(1 - F.col("p_max"), 3).alias("score"), (F.col("gold") == "D").alias("oos")
    )
    return rnd(I.detection_interval(df, ["set_name"], "score", "oos", [], RESAMPLES))


@query(
    "paired_auroc_difference",
    f"""WITH w AS (SELECT * FROM {weights_sql('rows', 'unit', 'boot')}),
       l AS (SELECT b, 'p_max' AS name, p_max AS s, sum(w * correct::INT) AS pos, sum(w * (NOT correct)::INT) AS neg FROM w GROUP BY 1, 3 UNION ALL SELECT b, 'p_known', p_known, sum(w * correct::INT), sum(w * (NOT correct)::INT) FROM w GROUP BY 1, 3
             UNION ALL SELECT -1, 'p_max', p_max, sum(correct::INT), sum((NOT correct)::INT) FROM rows GROUP BY 3 UNION ALL SELECT -1, 'p_known', p_known, sum(correct::INT), sum((NOT correct)::INT) FROM rows GROUP BY 3),
       a AS (SELECT b, name, sum(pos * (before + neg / 2.0)) / (sum(pos) * sum(neg)) AS auroc FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY b, name ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l) GROUP BY 1, 2),
       d AS (SELECT b, max(auroc) FILTER (name = 'p_max') - max(auroc) FILTER (name = 'p_known') AS diff FROM a GROUP BY 1)
       SELECT round(max(diff) FILTER (b = -1), 8) AS diff, round(quantile_cont(diff, 0.025) FILTER (b >= 0), 8) AS lo, round(quantile_cont(diff, 0.975) FILTER (b >= 0), 8) AS hi,
         round(quantile_cont(diff, 0.05) FILTER (b >= 0), 8) AS r90_lo, round(quantile_cont(diff, 0.95) FILTER (b >= 0), 8) AS r90_hi, round(avg((diff <= 0)::INT) FILTER (b >= 0), 8) AS tail FROM d""",
    "rows",
)
def paired_auroc_difference(t: Tables) -> DataFrame:
    return rnd(I.paired_auroc_difference(t.rows, [], "p_max", "p_known", "correct", NB, ["unit"], scheme="item"))


@query("paired_auroc_difference_levels")
def paired_auroc_difference_levels(t: Tables) -> DataFrame:
    """The same intervals from 2,000 resamples of the count tree."""
    return rnd(I.paired_auroc_difference(t.rows, [], "p_max", "p_known", "correct", RESAMPLES))


@query("best_score_paired")
def best_score_paired(t: Tables) -> DataFrame:
    """Best score per family by AUROC, then the paired difference of the two winners."""
    df = t.rows.withColumns({"flat": F.round("p_max", 1), "noise": F.col("line").cast("double"), "coarse": F.round("p_known", 1)})
    families = {"confidence": ["p_max", "flat"], "other": ["p_known", "coarse", "noise"]}
    best = []
    for names in families.values():
        a = R.auroc(I.stack_scores(df, names, ["correct"]), ["name"], "score", "correct")
        best.append(a.agg(F.max_by("name", "auroc").alias("n")).first()["n"])
    d = I.paired_auroc_difference(df, [], best[0], best[1], "correct", RESAMPLES)
    return rnd(d.select(F.lit(best[0]).alias("best_a"), F.lit(best[1]).alias("best_b"), "diff", "lo", "hi"))


BLOCK_W = """ix AS (SELECT post, month, row_number() OVER (PARTITION BY post ORDER BY month) - 1 AS idx, count(*) OVER (PARTITION BY post) AS m FROM (SELECT DISTINCT post, month FROM rows)),
   sz AS (SELECT DISTINCT post, m, least(6, m) AS len FROM ix),
   bl AS (SELECT post, m, len, b, unnest(range(0, CAST(ceil(m / len::DOUBLE) AS BIGINT))) AS i FROM sz, (SELECT unnest(range(0, 2000)) AS b)),
   st AS (SELECT *, floor((m - len + 1) * (('0x' || substr(md5('block|' || post || '|' || b || '|' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE))::BIGINT AS start FROM bl),
   dw AS (SELECT post, b, i * len + o AS pos, start + o AS idx, m FROM (SELECT *, unnest(range(0, len)) AS o FROM st) WHERE i * len + o < m),
   bw AS (SELECT ix.post, ix.month, b, count(*)::DOUBLE AS w FROM dw JOIN ix ON ix.post = dw.post AND ix.idx = dw.idx GROUP BY ALL)"""


@query(
    "month_block_bootstrap",
    f"""WITH {BLOCK_W}, s AS (SELECT post, month, count(*) AS n, sum(correct::INT) AS k FROM rows GROUP BY 1, 2), d AS (SELECT post, b, sum(w * k) / sum(w * n) AS stat FROM bw JOIN s USING (post, month) GROUP BY 1, 2)
       SELECT post, {ci_sql('stat')}, count(*) AS resamples FROM d GROUP BY 1""",
    "rows",
)
def month_block_bootstrap(t: Tables) -> DataFrame:
    drawn = B.block_counts(B.month_block_weights(t.rows, "post", "month", 2000, 6), "post", "month")
    sums = TS.monthly(t.rows, ["post"])
    d = drawn.join(sums, ["post", "month"]).groupBy("post", "b").agg(
        (F.sum(F.col("w") * F.col("k")) / F.sum(F.col("w") * F.col("n"))).alias("stat")
    )
    return rnd(d.groupBy("post").agg(*B.interval(d, ["post"], "stat"), F.count(F.lit(1)).alias("resamples")))


@query(
    "stratified_resample",
    f"""SELECT month, b, round(sum(w * correct::INT) / sum(w), 8) AS accuracy FROM {weights_sql('rows', 'unit', 'month')} GROUP BY 1, 2""", "rows",
)
def stratified_resample(t: Tables) -> DataFrame:
    """Each month resampled on its own."""
    s = TS.within_month_draws(t.rows, ["unit"], NB, scheme="item")
    return rnd(s.select("month", "b", (F.col("k") / F.col("n")).alias("accuracy")))


@query("stratified_resample_levels")
def stratified_resample_levels(t: Tables) -> DataFrame:
    """Each month resampled on its own, 2,000 times by the count tree."""
    return rnd(TS.within_month_draws(t.rows, [], RESAMPLES).select("month", "b", (F.col("k") / F.col("n")).alias("accuracy")))


@query(
    "mean_difference",
    f"""WITH d AS (SELECT b, sum(w * p_max) FILTER (post) / sum(w) FILTER (post) - sum(w * p_max) FILTER (NOT post) / sum(w) FILTER (NOT post) AS diff FROM {weights_sql('rows', 'unit', 'boot')} GROUP BY 1)
       SELECT (SELECT round(avg(p_max), 8) FROM rows WHERE post) AS mean_a, (SELECT round(avg(p_max), 8) FROM rows WHERE NOT post) AS mean_b,
         (SELECT round(avg(p_max) FILTER (post) - avg(p_max) FILTER (NOT post), 8) FROM rows) AS diff, {ci_sql('diff')}, round(avg((diff >= 0)::INT), 8) AS tail FROM d""",
    "rows",
)
def mean_difference(t: Tables) -> DataFrame:
    return rnd(I.mean_difference(t.rows, [], "p_max", "post", ["unit"], NB, scheme="item"))


@query("mean_difference_levels")
def mean_difference_levels(t: Tables) -> DataFrame:
    """The same interval from 2,000 resamples of the count tree."""
    return rnd(I.mean_difference(t.rows, [], "p_max", "post", [], RESAMPLES))


@query(
    "equivalence",
    f"""WITH {GAPS}, d AS (SELECT set_name, b, sum(w * gap) / sum(w) AS stat FROM {weights_sql('g', 'unit', 'boot')} GROUP BY 1, 2),
       i AS (SELECT set_name, {ci_sql('stat', lo=0.05, hi=0.95)}, greatest(avg((stat >= 0.09)::INT), avg((stat <= -0.09)::INT))::DOUBLE AS p FROM d GROUP BY 1)
       SELECT set_name, count(*) AS n, round(avg(gap), 8) AS mean, any_value(lo) AS lo, any_value(hi) AS hi, round(any_value(p), 8) AS p FROM g JOIN i USING (set_name) GROUP BY 1""",
    "rows",
)
def equivalence(t: Tables) -> DataFrame:
    return rnd(I.equivalence(gap_rows(t), ["set_name"], "gap", 0.09, ["unit"], NB, scheme="item"))


@query("equivalence_levels")
def equivalence_levels(t: Tables) -> DataFrame:
    """The same check from 2,000 resamples of the count tree."""
    return rnd(I.equivalence(gap_rows(t), ["set_name"], "gap", 0.09, [], RESAMPLES))


@query("spearman_interval")
def spearman_interval(t: Tables) -> DataFrame:
    """Bootstrap interval and Fisher z test of the rank correlation."""
    a = I.spearman_interval(t.rows, ["set_name"], "p_max", "p_known", [], RESAMPLES)
    z = I.spearman_test(t.rows, ["set_name"], "p_max", "p_known").select("set_name", "z", "p")
    return rnd(a.join(z, "set_name"), digits=6)


@query("t_tests")
def t_tests(t: Tables) -> DataFrame:
    return rnd(I.t_tests(gap_rows(t), ["month"], "gap", 0.1, 0.05), digits=7)


@query(
    "sign_flip_test",
    """WITH d AS (SELECT month, unit, p_max - correct::INT - 0.1::DOUBLE AS d FROM rows), o AS (SELECT month, count(*) AS n, avg(d) AS obs FROM d GROUP BY 1),
       x AS (SELECT month, b, avg(CASE WHEN ('0x' || substr(md5('flip|' || unit || '|' || b), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.5 THEN -d ELSE d END) AS nul FROM d, (SELECT unnest(range(0, 10)) AS b) GROUP BY 1, 2)
       SELECT month, any_value(n) AS n, round(any_value(obs) + 0.1, 8) AS mean, round((1 + count(*) FILTER (nul <= obs + 1e-12)) / 11.0::DOUBLE, 8) AS p FROM x JOIN o USING (month) GROUP BY 1""",
    "rows",
)
def sign_flip_test(t: Tables) -> DataFrame:
    return rnd(I.sign_flip_test(gap_rows(t), ["month"], "gap", ["unit"], 10, 0.1, scheme="item"))


@query("sign_flip_test_levels")
def sign_flip_test_levels(t: Tables) -> DataFrame:
    """2,000 sign patterns, whose sums are binomial by bucket."""
    return rnd(I.sign_flip_test(gap_rows(t), ["month"], "gap", [], RESAMPLES, 0.1))


@query("bca_bound")
def bca_bound(t: Tables) -> DataFrame:
    return rnd(I.bca_bound(gap_rows(t), ["set_name"], "gap", [], RESAMPLES), digits=6)


@query(
    "within_value_permutation",
    """WITH r AS (SELECT b, p_max, correct, row_number() OVER (PARTITION BY b, p_max ORDER BY md5('perm|' || unit || '|' || b)) <= count(*) FILTER (post) OVER (PARTITION BY b, p_max) AS fake FROM rows, (SELECT unnest(range(0, 3)) AS b)),
       l AS (SELECT b, p_max, (count(*) FILTER (NOT fake))::DOUBLE AS n0, (count(*) FILTER (NOT fake AND correct))::DOUBLE AS k0, (count(*) FILTER (fake))::DOUBLE AS n1, (count(*) FILTER (fake AND correct))::DOUBLE AS k1 FROM r GROUP BY 1, 2)
       SELECT b, round(sum(least(n0, n1) * abs(k0 / n0 - k1 / n1)) / sum(n0 + n1), 8) AS lower_bound FROM l GROUP BY 1""",
    "rows",
)
def within_value_permutation(t: Tables) -> DataFrame:
    return rnd(I.within_value_permutation(t.rows, [], ["unit"], 3))


@query("within_value_permutation_levels")
def within_value_permutation_levels(t: Tables) -> DataFrame:
    """2,000 permutations drawn from the level table."""
    null = I.within_value_permutation_levels(C.level_table(t.rows, []), [], RESAMPLES)
    obs = C.every_map_lower_bound(C.level_table(t.rows, []), []).withColumnRenamed("lower_bound", "obs")
    j = null.join(F.broadcast(obs), F.lit(True))
    return rnd(j.agg(
        F.first("obs").alias("observed"), F.avg("lower_bound").alias("null_mean"), F.percentile("lower_bound", 0.95).alias("null_p95"),
        ((1 + F.count_if(F.col("lower_bound") >= F.col("obs"))) / F.lit(float(RESAMPLES + 1))).alias("p"),
    ), digits=6)


@query(
    "random_months_null",
    """WITH m AS (SELECT month, bool_or(post) AS post FROM rows GROUP BY 1), f AS (SELECT month, b, row_number() OVER (PARTITION BY b ORDER BY md5('months|' || month || '|' || b), month) <= (SELECT count(*) FILTER (post) FROM m) AS fake FROM m, (SELECT unnest(range(0, 200)) AS b)),
       l AS (SELECT b, p_max, (count(*) FILTER (NOT fake))::DOUBLE AS n0, (count(*) FILTER (NOT fake AND correct))::DOUBLE AS k0, (count(*) FILTER (fake))::DOUBLE AS n1, (count(*) FILTER (fake AND correct))::DOUBLE AS k1 FROM rows JOIN f USING (month) GROUP BY 1, 2)
       SELECT b, round(sum(least(n0, n1) * abs(k0 / n0 - k1 / n1)) / sum(n0 + n1), 8) AS lower_bound FROM l GROUP BY 1""",
    "rows",
)
def random_months_null(t: Tables) -> DataFrame:
    return rnd(I.random_months_null(t.rows, NULLS))


@query("smece_interval")
def smece_interval(t: Tables) -> DataFrame:
    return rnd(I.smece_interval(t.rows, ["set_name"], "p_max", "correct", RESAMPLES), digits=6)


@query("smece_bounds")
def smece_bounds(t: Tables) -> DataFrame:
    """Four schemes per set; the half-samples draw rows without replacement."""
    return rnd(I.smece_bounds(t.rows, ["set_name"], "p_max", "correct", RESAMPLES, []), digits=6)


@query(
    "random_call_draws",
    """WITH x AS (SELECT set_name, d, (CASE greatest(pa,pb,pc,pd) WHEN pa THEN 'A' WHEN pb THEN 'B' WHEN pc THEN 'C' ELSE 'D' END = gold)::INT AS ok, greatest(pa,pb,pc,pd) AS p FROM answers, (SELECT unnest(range(0, 5)) AS d)
         WHERE replicate = floor(3 * (('0x' || substr(md5('call|' || unit || '|' || d), 1, 8))::BIGINT / 4294967296.0::DOUBLE)))
       SELECT set_name, d, count(*) AS n, round(avg(ok), 8) AS accuracy, round(avg(p), 8) AS mean_confidence FROM x GROUP BY 1, 2""",
    "answers",
)
def random_call_draws(t: Tables) -> DataFrame:
    from credalis.operators.replicates import random_calls

    picked = random_calls(scope(t).select("unit", "set_name", "replicate", "p_max", "correct"), ["unit"], 3, 5, "call")
    return rnd(picked.groupBy("set_name", "d").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg("p_max").alias("mean_confidence")
    ))


@query("random_call_draws_full")
def random_call_draws_full(t: Tables) -> DataFrame:
    """500 draws of one answer a unit, the first of them those of ``random_call_draws``."""
    from credalis.operators.replicates import call_sums

    return rnd(call_sums(scope(t).select("unit", "set_name", "replicate", "p_max", "correct"), ["set_name"], ["unit"], 3, CALL_DRAWS, "call"))


@query(
    "replicate_modes",
    """WITH modes AS (SELECT * FROM (VALUES ('mean3', 'all', [0,1,2]), ('single', 'r0', [0]), ('single', 'r1', [1]), ('single', 'r2', [2]), ('mean2', 'r01', [0,1]), ('mean2', 'r02', [0,2]), ('mean2', 'r12', [1,2]), ('single_random', 'random', NULL)) v(mode, frame, reps)),
       m AS (SELECT mode, frame, unit, any_value(set_name) AS set_name, any_value(gold) AS gold, avg(pa) AS pa, avg(pb) AS pb, avg(pc) AS pc, avg(pd) AS pd FROM answers, modes
         WHERE CASE WHEN reps IS NULL THEN replicate = floor(3 * (('0x' || substr(md5('mode|' || coalesce(set_name, chr(0)) || '|' || gold || '|' || unit), 1, 8))::BIGINT / 4294967296.0::DOUBLE)) ELSE list_contains(reps, replicate) END GROUP BY 1, 2, 3),
       s AS (SELECT mode, frame, set_name, (CASE greatest(pa,pb,pc,pd) WHEN pa THEN 'A' WHEN pb THEN 'B' WHEN pc THEN 'C' ELSE 'D' END = gold)::INT AS ok, greatest(pa,pb,pc,pd) AS p FROM m)
       SELECT mode, frame, set_name, count(*) AS n, round(avg(ok), 8) AS accuracy, round(avg(p), 8) AS mean_confidence, round(avg(p) - avg(ok), 8) AS gap FROM s GROUP BY 1, 2, 3""",
    "answers",
)
def replicate_modes(t: Tables) -> DataFrame:
    from credalis.operators.replicates import replicate_modes as modes

    m = modes(t.answers, ["set_name", "gold", "unit"], 3)
    ok = (F.col("top") == F.col("gold")).cast("double")
    return rnd(m.groupBy("mode", "frame", "set_name").agg(
        F.count(F.lit(1)).alias("n"), F.avg(ok).alias("accuracy"), F.avg("p_max").alias("mean_confidence"), (F.avg("p_max") - F.avg(ok)).alias("gap")
    ))


# --- time splits -------------------------------------------------------------------

STATS_SQL = """count(*) FILTER (month < cutoff) AS n_pre, count(*) FILTER (month >= cutoff) AS n_post, round(avg(correct::INT) FILTER (month < cutoff), 8) AS accuracy_pre, round(avg(correct::INT) FILTER (month >= cutoff), 8) AS accuracy_post,
   round(avg(p_max - correct::INT) FILTER (month >= cutoff), 8) AS post_gap, round(avg(p_max) FILTER (month >= cutoff) - avg(p_max) FILTER (month < cutoff), 8) AS post_minus_pre_confidence"""
CUTS = "c AS (SELECT unnest([" + ",".join(f"'{c}'" for c in TS.SENSITIVITY) + "]) AS cutoff)"


@query("cutoff_stats", f"WITH {CUTS} SELECT set_name, cutoff, {STATS_SQL} FROM rows, c GROUP BY 1, 2", "rows")
def cutoff_stats(t: Tables) -> DataFrame:
    cuts = TS.cutoff_table(t.spark, TS.SENSITIVITY)
    return rnd(TS.cutoff_stats(TS.monthly(t.rows, ["set_name"]), cuts, ["set_name"]))


@query("selection_bootstrap")
def selection_bootstrap(t: Tables) -> DataFrame:
    """The change point re-selected in resamples inside months."""
    d = TS.selection_bootstrap(t.rows, [], RESAMPLES)
    return rnd(d.groupBy("first_post_month").agg(
        (F.count(F.lit(1)) / float(RESAMPLES)).alias("share"), F.avg("post_gap").alias("post_gap"), F.avg("drop").alias("drop")
    ))


@query("block_selection_bootstrap")
def block_selection_bootstrap(t: Tables) -> DataFrame:
    """Blocks of months joined end to end; the split is re-selected per resample."""
    d = TS.block_selection_bootstrap(t.rows, RESAMPLES)
    return rnd(d.groupBy("band").agg(
        *B.interval(d, ["band"], "difference"), F.avg((F.col("shift") == 0).cast("double")).alias("share_at_boundary")
    ))


@query(
    "split_selection",
    """WITH h AS (SELECT split_no, month, p_max, correct, row_number() OVER (PARTITION BY split_no, month ORDER BY md5('split|' || unit || '|' || split_no)) <= floor(count(*) OVER (PARTITION BY split_no, month) / 2) AS find FROM rows, (SELECT unnest(range(0, 3)) AS split_no)),
       hs AS (SELECT * FROM h WHERE find), """ + CHANGE_SQL.format(m="s", key="split_no", src="hs") + f""",
       x AS (SELECT h.*, first_post_month AS cutoff FROM h JOIN sf USING (split_no) WHERE NOT find)
       SELECT split_no, cutoff, {STATS_SQL}, (SELECT round(pre_accuracy - post_accuracy, 8) FROM sf WHERE sf.split_no = x.split_no) AS "drop" FROM x GROUP BY 1, 2""",
    "rows",
)
def split_selection(t: Tables) -> DataFrame:
    return rnd(TS.split_selection(t.rows, ["unit"], 3, scheme="item"))


@query("split_selection_levels")
def split_selection_levels(t: Tables) -> DataFrame:
    """50 splits, whose halves are hypergeometric by bucket."""
    return rnd(TS.split_selection(t.rows, [], SPLITS))


EQ_W = f"""ix AS (SELECT post, month, row_number() OVER (PARTITION BY post ORDER BY month) - 1 AS idx, count(*) OVER (PARTITION BY post) AS m FROM (SELECT DISTINCT post, month FROM rows)),
   dr AS (SELECT post, b, floor(m * (('0x' || substr(md5('eq|' || post || '|' || b || '|' || idx), 1, 8))::BIGINT / 4294967296.0::DOUBLE))::BIGINT AS idx FROM ix, (SELECT unnest(range(0, {RESAMPLES})) AS b)),
   ew AS (SELECT ix.post, ix.month, b, count(*)::DOUBLE AS w FROM dr JOIN ix ON ix.post = dr.post AND ix.idx = dr.idx GROUP BY ALL)"""


@query(
    "equal_confidence",
    f"""WITH {EQ_W}, m AS (SELECT post, month, {BAND_SQL}::INT AS band, count(*) AS n, sum(correct::INT) AS k FROM rows GROUP BY 1, 2, 3),
       d AS (SELECT b, band, sum(w * k) FILTER (NOT post) / sum(w * n) FILTER (NOT post) AS pre, sum(w * k) FILTER (post) / sum(w * n) FILTER (post) AS pst FROM m JOIN ew USING (post, month) GROUP BY 1, 2),
       i AS (SELECT band, {ci_sql('pre', 'pre_')}, {ci_sql('pst', 'post_')}, {ci_sql('pre - pst', 'difference_')} FROM d GROUP BY 1)
       SELECT band, (sum(n) FILTER (NOT post))::BIGINT AS n_pre, (sum(n) FILTER (post))::BIGINT AS n_post, round(sum(k) FILTER (NOT post) / sum(n) FILTER (NOT post), 8) AS accuracy_pre, round(sum(k) FILTER (post) / sum(n) FILTER (post), 8) AS accuracy_post,
         any_value(pre_lo) AS pre_lo, any_value(pre_hi) AS pre_hi, any_value(post_lo) AS post_lo, any_value(post_hi) AS post_hi, any_value(difference_lo) AS difference_lo, any_value(difference_hi) AS difference_hi FROM m JOIN i USING (band) GROUP BY 1""",
    "rows",
)
def equal_confidence(t: Tables) -> DataFrame:
    return rnd(TS.equal_confidence(t.rows, RESAMPLES))


@query(
    "alternative_cutoffs",
    f"WITH {CUTS} SELECT cutoff, {BAND_SQL}::INT AS band, round(avg(correct::INT) FILTER (month < cutoff) - avg(correct::INT) FILTER (month >= cutoff), 8) AS difference FROM rows, c GROUP BY 1, 2",
    "rows",
)
def alternative_cutoffs(t: Tables) -> DataFrame:
    return rnd(TS.alternative_cutoffs(t.rows, TS.SENSITIVITY))


@query("matched_coverage_interval")
def matched_coverage_interval(t: Tables) -> DataFrame:
    return rnd(TS.matched_coverage_interval(paired(t), (0.25, 0.5), RESAMPLES), digits=6)


@query(
    "within_period_tracking",
    f"""WITH p AS (SELECT post, auroc FROM ({auroc_sql('rows', 'post', 'p_known', 'correct')})),
       m AS (SELECT post, sum(auroc * n) FILTER (auroc IS NOT NULL) / sum(n) FILTER (auroc IS NOT NULL) AS within_month FROM ({auroc_sql('rows', 'post, month', 'p_known', 'correct')}) GROUP BY 1),
       r AS (SELECT post, rank() OVER (PARTITION BY post ORDER BY p_known) + (count(*) OVER (PARTITION BY post, p_known) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY post ORDER BY month) + (count(*) OVER (PARTITION BY post, month) - 1) / 2.0 AS ry FROM rows)
       SELECT post, round(any_value(auroc), 8) AS auroc, round(any_value(within_month), 8) AS within_month, round(corr(rx, ry), 8) AS rho FROM r JOIN p USING (post) JOIN m USING (post) GROUP BY 1""",
    "rows",
)
def within_period_tracking(t: Tables) -> DataFrame:
    """Score against correctness inside each period and month, and against time."""
    df = t.rows.withColumn("time", F.datediff(F.to_date(F.concat("month", F.lit("-01"))), F.lit("1970-01-01")).cast("double"))
    a = R.auroc(df, ["post"], "p_known", "correct").select("post", "auroc")
    s = R.stratified_auroc(df, ["post"], "p_known", "correct", "month").select("post", F.col("auroc").alias("within_month"))
    r = R.spearman(df, ["post"], "p_known", "time").select("post", "rho")
    return rnd(a.join(s, "post").join(r, "post"))
