"""Recalibration maps fitted with Spark: temperature, logistic, isotonic, interaction."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression, IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credalis.functions import dist as D
from credalis.functions.seeded import key_hash
from credalis.operators import calibration as C
from credalis.operators.prefix import attach, attach_rows, hash_rank, null_safe_join
from credalis.operators.ranking import weighted_percentiles
from credalis.session import checkpointed

UNPENALISED = 1e6
"""Inverse penalty of the scalar maps (fixed value)."""


def split_half(df: DataFrame, key: str, seed: str = "half", by: Sequence[str] = ()) -> DataFrame:
    """Add ``fit``: whether the row's key falls in the random half of the distinct keys.

    Only the keys' hashes are ranked. The hash in the middle is the cut, and every row
    compares its own with it, so rows are not moved. Rows with a null key are left out.
    """
    h = key_hash(seed, *by, key)
    ids = checkpointed(df.select(*by, key).distinct().select(*by, h.alias("_key")))
    n = ids.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    ranked = attach(hash_rank(ids, list(by), "_key"), n, by)
    middle = ranked.where(F.col("rank") == F.floor(F.col("_n") / 2)).select(*by, F.col("_key").alias("_cut"))
    cut = checkpointed(attach(n, middle, by, "left").select(*by, "_cut"))  # one row for each of ``by``
    keyed = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*by, key)]))
    rest = [c for c in df.columns if c not in (*by, key)]
    return attach_rows(keyed, cut, by).select(*by, key, *rest, F.coalesce(h <= F.col("_cut"), F.lit(False)).alias("fit"))


def _stepper(step, x: float):
    """Bind ``x``; Spark lambdas may not have default arguments."""
    return lambda acc, l: step(x, acc, l)


def fit_temperature(df: DataFrame, dist: str = "dist", gold: str = "gold", steps: int = 12, tol: float = 1e-7) -> float:
    """Temperature minimising the log loss of the gold option, ``ln t`` in [-3, 3].

    In ``beta = 1 / t`` the loss ``ln sum exp(beta l) - beta l_gold`` is convex, with
    ``l`` the floored log-probabilities. Bracketed Newton steps on its derivative
    each need one aggregation that returns two numbers.
    """
    logs = F.transform(F.map_values(dist), lambda p: F.ln(F.greatest(p, F.lit(D.TEMPER_FLOOR))))
    own = F.ln(F.greatest(D.prob(dist, F.col(gold)), F.lit(D.TEMPER_FLOOR)))
    base = df.select(logs.alias("l"), own.alias("g"))
    lo, hi = math.exp(-3), math.exp(3)
    beta = 1.0
    zero = F.struct(*[F.lit(0.0).alias(f"s{i}") for i in range(3)])

    def step(x: Column, acc: Column, l: Column) -> Column:
        e = F.exp(F.lit(x) * l)
        return F.struct((acc["s0"] + e).alias("s0"), (acc["s1"] + e * l).alias("s1"), (acc["s2"] + e * l * l).alias("s2"))

    def slopes(*betas: float):
        sums = [F.aggregate("l", zero, _stepper(step, v)).alias(f"m{i}") for i, v in enumerate(betas)]
        out = []
        for i in range(len(betas)):
            mean = F.col(f"m{i}.s1") / F.col(f"m{i}.s0")
            out += [F.avg(mean - F.col("g")).alias(f"d1_{i}"), F.avg(F.col(f"m{i}.s2") / F.col(f"m{i}.s0") - mean * mean).alias(f"d2_{i}")]
        return base.select("g", *sums).agg(*out).first()

    ends = slopes(lo, beta, hi)
    if ends["d1_0"] >= 0:
        return 1.0 / lo
    if ends["d1_2"] <= 0:
        return 1.0 / hi
    d = {"d1": ends["d1_1"], "d2": ends["d2_1"]}
    for _ in range(steps):
        if d["d1"] > 0:
            hi = beta
        else:
            lo = beta
        new = beta - d["d1"] / d["d2"] if d["d2"] > 0 else math.sqrt(lo * hi)
        if not lo < new < hi:
            new = math.sqrt(lo * hi)
        done = abs(math.log(new / beta)) < tol
        beta = new
        if done:
            break
        got = slopes(beta)
        d = {"d1": got["d1_0"], "d2": got["d2_0"]}
    return 1.0 / beta


def _features(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(df).select("features", *keep)


def fit_logistic(
    df: DataFrame, columns: Sequence[str], label: str, weight: str | None = None, c: float = 1.0,
) -> LogisticRegressionModel:
    """Logistic regression with inverse penalty ``c`` on the summed loss.

    Spark penalises the mean loss, so ``regParam = 1 / (c n)``.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    base = df.select(*columns, F.col(label).cast("double").alias("label"), w.alias("_w"))
    n = base.agg(F.sum("_w").alias("n")).first()["n"]
    lr = LogisticRegression(
        regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9, weightCol="_w"
    )
    return lr.fit(_features(base, columns, ["label", "_w"]))


def logistic_map(df: DataFrame, scores: Sequence[str], label: str) -> LogisticRegressionModel:
    """Near-unpenalised map from the log-odds of scores, fitted on distinct score values.

    The likelihood only needs counts per (scores, label), so the optimiser's passes
    run over levels rather than rows.
    """
    lv = df.groupBy(*scores, F.col(label).cast("double").alias("_y")).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    logits = lv.select(*[D.clipped_logit(s, D.TEMPER_FLOOR).alias(f"x{i}") for i, s in enumerate(scores)], "_y", "_n")
    return fit_logistic(logits, [f"x{i}" for i in range(len(scores))], "_y", "_n", UNPENALISED)


def fit_platt(df: DataFrame, score: str = "p_max", label: str = "correct") -> tuple[float, float]:
    """Slope and intercept of the logistic map of one score."""
    m = logistic_map(df, [score], label)
    return float(m.coefficients[0]), float(m.intercept)


def apply_logistic(model: LogisticRegressionModel, scores: Sequence[Column]) -> Column:
    """The fitted map as a plain column expression."""
    z = F.lit(float(model.intercept))
    for b, s in zip(model.coefficients, scores, strict=True):
        z = z + float(b) * D.clipped_logit(s, D.TEMPER_FLOOR)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def evaluate_maps(df: DataFrame, keys: Sequence[str], t: float, ab: tuple[float, float], known: Column | None = None) -> DataFrame:
    """Confidence, accuracy, gap and smooth ECE before and after each map, long format."""
    maps = {
        "raw": F.col("p_max"), "temperature": F.array_max(F.map_values(D.temper("dist", t))),
        "platt": D.apply_platt("p_max", *ab),
    }
    if known is not None:
        maps["platt_plus_known"] = known
    pairs = F.array(*[F.struct(F.lit(n).alias("map"), c.alias("conf")) for n, c in maps.items()])
    long = df.select(*keys, F.col("correct").cast("double").alias("ok"), F.explode(pairs).alias("_m"))
    long = long.select(*keys, "ok", "_m.map", "_m.conf")
    k = [*keys, "map"]
    agg = long.groupBy(*k).agg(
        F.count(F.lit(1)).alias("n"), F.avg("conf").alias("mean_confidence"), F.avg("ok").alias("accuracy"),
        F.avg(F.col("conf") - F.col("ok")).alias("gap"),
    )
    return null_safe_join(agg, C.smece(long, k, "conf", "ok").drop("n"), k)


def isotonic(levels: DataFrame, value: str, rate: str, weight: str) -> IsotonicRegressionModel:
    """Isotonic map fitted on a weighted level table."""
    src = levels.select(F.col(value).alias("features"), F.col(rate).alias("label"), F.col(weight).alias("weight"))
    return IsotonicRegression(weightCol="weight", isotonic=True).fit(src)


def common_map(fit: DataFrame, rows: DataFrame, score: str = "p_max", label: str = "correct") -> DataFrame:
    """Add ``recalibrated``: pooled accuracy of the score value, else isotonic."""
    lv = fit.groupBy(F.round(score, C.LEVEL_DIGITS).alias("v")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.col(label).cast("double")).alias("a")
    )
    model = isotonic(lv, "v", "a", "n").setFeaturesCol(score).setPredictionCol("_iso")
    j = model.transform(rows).withColumn("_v", F.round(score, C.LEVEL_DIGITS))
    j = j.join(lv.select(F.col("v").alias("_v"), "a"), "_v", "left")
    return j.withColumn("recalibrated", F.coalesce("a", "_iso")).drop("_v", "a", "_iso")


def period_map(fit: DataFrame, rows: DataFrame, score: str = "p_max", label: str = "correct", post: str = "post") -> DataFrame:
    """Add ``recalibrated``: one isotonic map per period."""
    lv = fit.groupBy(post, F.round(score, C.LEVEL_DIGITS).alias("v")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.col(label).cast("double")).alias("a")
    )
    out: DataFrame | None = None
    for side in (False, True):
        model = isotonic(lv.filter(F.col(post) == side), "v", "a", "n").setFeaturesCol(score).setPredictionCol("recalibrated")
        part = model.transform(rows.filter(F.col(post) == side))
        out = part if out is None else out.unionByName(part)
    return out


def interaction_glm(df: DataFrame, score: str = "p_max", post: str = "post", correct: str = "correct", cluster: str = "month") -> DataFrame:
    """``correct ~ logit(p) * post`` with cluster-robust errors and a Wald test of the period terms.

    The model is fitted on score levels; scores and the information matrix are sums
    by cluster and overall, so only 4 x 4 numbers per cluster reach the end.
    """
    lp = D.clipped_logit(score, D.TEMPER_FLOOR)
    late = F.col(post).cast("double")
    lv = df.groupBy(cluster, lp.alias("x1"), late.alias("x2")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.col(correct).cast("double")).alias("label")
    ).withColumn("x3", F.col("x1") * F.col("x2"))
    pooled = lv.groupBy("x1", "x2", "x3").agg((F.sum(F.col("n") * F.col("label")) / F.sum("n")).alias("label"), F.sum("n").alias("n"))
    glm = GeneralizedLinearRegression(family="binomial", link="logit", weightCol="n", maxIter=100, tol=1e-12)
    fit = glm.fit(_features(pooled, ["x1", "x2", "x3"], ["label", "n"]))
    beta = np.r_[fit.intercept, fit.coefficients.toArray()]
    x = [F.lit(1.0), F.col("x1"), F.col("x2"), F.col("x3")]
    eta = F.lit(0.0)
    for b, c in zip(beta, x, strict=True):
        eta = eta + float(b) * c
    mu = F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))
    sums = lv.withColumn("_mu", mu).groupBy(cluster).agg(
        F.sum("n").alias("n"),
        *[F.sum(F.col("n") * (F.col("label") - F.col("_mu")) * x[i]).alias(f"s{i}") for i in range(4)],
        *[F.sum(F.col("n") * F.col("_mu") * (1 - F.col("_mu")) * x[i] * x[j]).alias(f"h{i}{j}") for i in range(4) for j in range(i, 4)],
    )
    tot = sums.agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("g"),
        *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}{j}") for i in range(4) for j in range(i, 4)],
        *[F.sum(f"h{i}{j}").alias(f"h{i}{j}") for i in range(4) for j in range(i, 4)],
    ).first()
    sym = lambda p: np.array([[tot[f"{p}{min(i, j)}{max(i, j)}"] for j in range(4)] for i in range(4)], float)
    bread = np.linalg.inv(sym("h"))
    scale = tot["g"] / (tot["g"] - 1) * (tot["n"] - 1) / (tot["n"] - 4)
    cov = bread @ sym("m") @ bread * scale
    period = beta[2:]
    chi2 = float(period @ np.linalg.solve(cov[2:, 2:], period))
    names = ("intercept", "logit_p", "post", "logit_p:post")
    rows = [(n, float(b), float(math.sqrt(v))) for n, b, v in zip(names, beta, np.diag(cov), strict=True)]
    rows.append(("wald_period_terms", chi2, math.exp(-chi2 / 2)))
    return df.sparkSession.createDataFrame(rows, "term string, value double, error_or_p double")


def heldout_acceptance(
    df: DataFrame, key: str, scores: Sequence[str], correct: str, splits: int,
    coverages: Sequence[float] = (0.25, 0.5, 0.75, 0.9), seed: str = "accept",
) -> DataFrame:
    """Threshold from one half's quantile, accuracy and coverage on the other half.

    Rows collapse to counts per (split, half, score value) before anything else.
    """
    ids = df.select(key).distinct().withColumn("split_no", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    halves = split_half(ids, key, seed, ["split_no"])
    pairs = F.array(*[F.struct(F.lit(s).alias("name"), F.col(s).cast("double").alias("score")) for s in scores])
    per_key = df.select(key, F.col(correct).cast("double").alias("_ok"), F.explode(pairs).alias("_p"))
    per_key = per_key.groupBy(key, "_p.name", "_p.score").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("_ok").alias("k"))
    lv = per_key.join(halves, key).groupBy("split_no", "name", "fit", "score").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    cuts = weighted_percentiles(lv.filter("fit"), ["split_no", "name"], "score", "n", [1 - c for c in coverages])
    table = F.array(*[F.struct(F.lit(c).alias("coverage"), F.col(f"q{i}").alias("cut")) for i, c in enumerate(coverages)])
    cuts = cuts.select("split_no", "name", F.inline(table))
    held = lv.filter(~F.col("fit")).join(cuts, ["split_no", "name"])
    kept = F.col("score") >= F.col("cut")
    taken = F.sum(F.when(kept, F.col("n")).otherwise(0.0))
    per = held.groupBy("split_no", "name", "coverage").agg(
        (F.sum(F.when(kept, F.col("k")).otherwise(0.0)) / taken).alias("accuracy"), (taken / F.sum("n")).alias("achieved")
    )
    return per.groupBy("name", "coverage").agg(
        F.avg("accuracy").alias("accuracy"), F.min("accuracy").alias("accuracy_min"), F.max("accuracy").alias("accuracy_max"),
        F.avg("achieved").alias("achieved"),
    )
