"""Hand-computed answers for the metrics."""

import math

import pytest
from pyspark.sql import functions as F

from credalis.functions import dist as D
from credalis.functions.statfn import t_cdf_array, wilson
from credalis.operators import calibration as C
from credalis.operators import inference as I
from credalis.operators import ranking as R


def one(df):
    return df.first().asDict()


def scored(spark, scores, labels, **extra):
    rows = [(i, float(s), bool(y)) for i, (s, y) in enumerate(zip(scores, labels, strict=True))]
    df = spark.createDataFrame(rows, "i int, s double, y boolean")
    for k, v in extra.items():
        df = df.withColumn(k, v)
    return df


def test_brier_and_log_score(spark):
    df = spark.sql("SELECT map('a', 0.8D, 'b', 0.2D) AS d, 'a' AS g, 'z' AS missing")
    r = one(df.select(D.brier("d", "g").alias("b"), D.brier("d", "missing").alias("bm"), D.log_score("d", "g").alias("l"), D.log_score("d", "missing").alias("lm")))
    assert r["b"] == pytest.approx(0.08)
    assert r["bm"] == pytest.approx(0.68)
    assert r["l"] == pytest.approx(-math.log(0.8))
    assert r["lm"] == pytest.approx(-math.log(1e-12))


def test_entropy_edge_cases(spark):
    df = spark.sql("SELECT map('a', 1.0D) AS one, map('a', 0.5D, 'b', 0.5D) AS two, map('a', 1.0D, 'b', 0.0D) AS sure")
    r = one(df.select(D.norm_entropy("one").alias("k1"), D.norm_entropy("two").alias("k2"), D.entropy("sure").alias("s"), D.choice_confidence("one").alias("c1"), D.choice_confidence("two").alias("c2")))
    assert r["k1"] is None and r["c1"] is None
    assert r["k2"] == pytest.approx(1.0) and r["c2"] == pytest.approx(0.0)
    assert r["s"] == 0.0


def test_normalise_rejects_bad_input(spark):
    bad = spark.sql("SELECT map('a', -0.1D, 'b', 1.0D) AS d")
    with pytest.raises(Exception, match="non-negative"):
        bad.select(D.normalise("d")).collect()
    assert one(bad.select(D.normalise("d", "null").alias("n")))["n"] is None


def test_js_needs_equal_options(spark):
    df = spark.sql("SELECT map('a', 1.0D, 'b', 0.0D) AS p, map('a', 0.0D, 'b', 1.0D) AS q, map('a', 1.0D, 'c', 0.0D) AS r")
    r = one(df.select(D.js_divergence("p", "q").alias("pq"), D.js_divergence("p", "r").alias("pr")))
    assert r["pq"] == pytest.approx(math.log(2)) and r["pr"] is None


def test_top_option_takes_first_listed(spark):
    df = spark.sql("SELECT map('a', 0.4D, 'b', 0.4D, 'c', 0.2D) AS d, array('b', 'a', 'c') AS o")
    assert one(df.select(D.top_option("d", "o").alias("t")))["t"] == "b"


def test_ece(spark):
    df = scored(spark, [0.95, 0.95, 0.55, 0.55], [1, 1, 1, 0])
    assert one(C.ece(df, [], "s", "y", 10))["ece"] == pytest.approx(0.05)
    assert one(C.ece(scored(spark, [1.0], [1]), [], "s", "y", 10))["ece"] == pytest.approx(0.0)


def test_reliability_and_merge(spark):
    df = scored(spark, [0.2, 0.4, 1, 1, 1, 1], [0, 1, 1, 1, 1, 0]).withColumn("tie", F.format_string("%03d", "i"))
    bins = C.reliability_bins(df, [], "s", "y", 3, "tie")
    assert [r["n"] for r in bins.orderBy("bin").collect()] == [2, 2, 2]
    last = C.merge_tied_bins(bins, []).orderBy("bin").collect()[-1]
    assert (last["confidence"], last["accuracy"], last["n"]) == (1.0, 0.75, 4)


def test_wilson(spark):
    r = one(spark.range(1).select(wilson(F.lit(0.5), F.lit(100)).alias("w"), wilson(F.lit(0.5), F.lit(0)).alias("z")))
    assert r["w"]["lo"] == pytest.approx(0.4038, abs=1e-4) and r["w"]["hi"] == pytest.approx(0.5962, abs=1e-4)
    assert r["z"] is None


def test_auroc(spark):
    assert one(R.auroc(scored(spark, [1, 1, 1, 1], [1, 0, 1, 0]), [], "s", "y"))["auroc"] == 0.5
    assert one(R.auroc(scored(spark, [1, 2], [1, 1]), [], "s", "y"))["auroc"] is None
    assert one(R.auroc(scored(spark, [1, 2, 3, 4], [0, 1, 0, 1]), [], "s", "y"))["auroc"] == 0.75


def test_stratified_auroc(spark):
    df = spark.createDataFrame(
        [("a", 1.0, False), ("a", 2.0, True), ("b", 2.0, False), ("b", 1.0, True), ("c", 1.0, True)], "g string, s double, y boolean"
    )
    r = one(R.stratified_auroc(df, [], "s", "y", "g"))
    assert (r["auroc"], r["strata_used"], r["rows_covered"], r["rows"]) == (0.5, 2, 4, 5)


def test_average_precision(spark):
    df = scored(spark, [0.9, 0.8, 0.7, 0.1], [1, 0, 1, 0])
    assert one(R.average_precision(df, [], "s", "y"))["average_precision"] == pytest.approx((1 + 2 / 3) / 2)


def test_average_precision_tie_rules(spark):
    df = scored(spark, [0.5, 0.5], [0, 1]).withColumn("tie", F.format_string("%03d", "i"))
    assert one(R.average_precision(df, [], "s", "y"))["average_precision"] == 0.5
    assert one(R.average_precision(df, [], "s", "y", "input_order", "tie"))["average_precision"] == 0.5
    flipped = df.withColumn("tie", F.format_string("%03d", 9 - F.col("i")))
    assert one(R.average_precision(flipped, [], "s", "y", "input_order", "tie"))["average_precision"] == 1.0


@pytest.mark.parametrize("ties", ["average", "input_order"])
def test_risk_coverage(spark, ties):
    df = scored(spark, [0.9, 0.8, 0.7, 0.6], [1, 1, 0, 0]).withColumn("tie", F.format_string("%03d", "i"))
    r = one(R.risk_coverage(df, [], "s", "y", (0.5, 1.0), ties, "tie"))
    assert r["aurc"] == pytest.approx((0 + 0 + 1 / 3 + 1 / 2) / 4)
    assert r["risk_at_50"] == 0 and r["risk_at_100"] == 0.5


def test_selective_at(spark):
    df = scored(spark, [0.95, 0.92, 0.7, 0.6], [1, 0, 1, 0]).withColumn("tie", F.format_string("%03d", "i"))
    r = one(R.selective_at(df, [], "s", "y", 0.5, "s", "tie"))
    assert (r["answered"], r["errors"], r["confident_errors"], r["selective_accuracy"]) == (2, 1, 1, 0.5)


def test_weighted_accuracy_takes_part_of_a_tie(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0, 0.5), (0.5, 3.0, 0.0, 0.5), (0.1, 0.0, 0.0, 0.5)], "s double, w double, g double, cov double")
    r = one(R.weighted_accuracy_at(df, [], "s", "w", "g", "cov"))
    assert r["accuracy"] == pytest.approx(0.5) and r["achieved"] == pytest.approx(0.5)


def test_fpr_at_tpr_and_percentiles(spark):
    df = scored(spark, [1, 2, 3, 4, 0, 5], [1, 1, 1, 1, 0, 0])
    assert one(R.fpr_at_tpr(df, [], "s", "y", 0.95))["fpr"] == 0.5
    q = one(R.weighted_percentiles(df, [], "s", None, [0.025, 0.5, 0.975]))
    assert q["q0"] == pytest.approx(0.125) and q["q1"] == pytest.approx(2.5) and q["q2"] == pytest.approx(4.875)


def test_spearman(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 4.0), (4.0, 3.0)], "x double, y double")
    assert one(R.spearman(df, [], "x", "y"))["rho"] == pytest.approx(0.6)
    assert one(R.spearman(df.withColumn("y", F.lit(1.0)), [], "x", "y"))["rho"] is None


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p double").withColumn("f", F.lit(0))
    got = {r["name"]: r["p_holm"] for r in I.holm(df, ["f"], "p").collect()}
    assert got == pytest.approx({"a": 0.03, "b": 0.06, "c": 0.06})


def test_lower_bound_and_map_gaps(spark):
    rows = [(0.7, False, True)] * 2 + [(0.7, True, False)] * 2
    df = spark.createDataFrame(rows, "p_max double, post boolean, correct boolean")
    assert one(C.every_map_lower_bound(C.level_table(df, []), []))["lower_bound"] == 0.5
    g = one(C.single_map_gaps(df, [], C.COARSE_BANDS))
    assert g["mean_gap_pre"] == -0.5 and g["mean_gap_post"] == 0.5


def test_smooth_ece_limits(spark):
    calibrated = spark.range(20000).select(((F.col("id") % 100 + 0.5) / 100).alias("p"), (F.floor(F.col("id") / 100) + 0.5 < 200 * (F.col("id") % 100 + 0.5) / 100).alias("y"))
    assert one(C.smece(calibrated, [], "p", "y"))["smece"] < 0.01
    sure = spark.range(1000).select(F.lit(0.9).alias("p"), (F.col("id") % 2 == 0).alias("y"))
    assert one(C.smece(sure, [], "p", "y"))["smece"] == pytest.approx(0.4, abs=0.02)


def test_t_distribution():
    got = t_cdf_array([0.0, 2.228138852, -1.812461123, float("-inf")], [5, 10, 10, 3])
    assert list(got) == pytest.approx([0.5, 0.975, 0.05, 0.0], abs=1e-6)
