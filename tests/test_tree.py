"""Resamples from the count tree: laws, agreement with item draws, and the batched kernel."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from credalis.operators import calibration as C
from credalis.operators import inference as I
from credalis.operators import ranking as R
from credalis.operators import timesplit as TS
from credalis.operators import tree


def chi_square(got, want, draws):
    """Squared distance of counts from their expectations, over its degrees of freedom; rare outcomes together."""
    common = [k for k, p in want.items() if p * draws >= 5]
    rest = (draws - sum(got[k] for k in common), draws * (1 - sum(want[k] for k in common)))
    parts = [(got[k], want[k] * draws) for k in common] + ([rest] if rest[1] >= 5 else [])
    return sum((a - b) ** 2 / b for a, b in parts) / (len(parts) - 1)


@pytest.mark.parametrize("n", [[2, 1, 1], [1, 0, 3, 1, 1], [4], [1, 1, 1, 1, 1, 1]])
def test_multinomial_law(n):
    """Every outcome as often as the exact multinomial says."""
    draws, total = 40_000, sum(n)
    rng = np.random.default_rng(len(n))
    got = Counter(map(tuple, tree.split_counts(np.array(n), total, draws, rng).tolist()))
    want = {
        c: math.factorial(total) / math.prod(map(math.factorial, c)) * math.prod((a / total) ** k for a, k in zip(n, c, strict=True))
        for c in itertools.product(range(total + 1), repeat=len(n)) if sum(c) == total
    }
    want = {k: p for k, p in want.items() if p}
    assert set(got) <= set(want) and (len(want) == 1 or chi_square(got, want, draws) < 1.7)


@pytest.mark.parametrize("limit", [10**9, 3])
def test_hypergeometric_law(monkeypatch, limit):
    """Draws without replacement, also where nodes are beyond numpy's limit."""
    monkeypatch.setattr(tree, "HYPERGEOMETRIC", limit)
    n, take, draws = [4, 2, 1, 5], 6, 20_000
    got = Counter(map(tuple, tree.split_counts(np.array(n), take, draws, np.random.default_rng(3), False).tolist()))
    want = {
        c: math.prod(math.comb(a, k) for a, k in zip(n, c, strict=True)) / math.comb(sum(n), take)
        for c in itertools.product(*[range(a + 1) for a in n]) if sum(c) == take
    }
    assert set(got) <= set(want) and chi_square(got, want, draws) < 1.7


@pytest.fixture(scope="module")
def continuous(spark):
    """Scores without ties, one far outlier, a hot value, two keys of very different size."""
    rng = np.random.default_rng(5)
    rows = []
    for k, n in (("big", 6_000), ("small", 40)):
        x = rng.beta(5, 2, n)
        ok = rng.random(n) < x
        x[: n // 3] = np.where(ok[: n // 3], 0.8, 0.3)
        x[-1] = 500.0
        noise = rng.normal(size=n)
        rows += [(k, f"{k}{i}", float(a), float(a + c * 0.1), bool(b), f"m{i % 8}") for i, (a, b, c) in enumerate(zip(x, ok, noise, strict=True))]
    return spark.createDataFrame(rows, "k string, unit string, x double, y double, ok boolean, month string").repartition(6).cache()


def test_buckets_are_bounded_and_whole(continuous):
    t = tree.buckets(continuous, ["k"], "x", "ok").toPandas()
    raw = continuous.toPandas()
    for k, part in t.groupby("k"):
        own = raw[raw["k"] == k]
        assert part["n0"].sum() + part["n1"].sum() == len(own) and part["n1"].sum() == own["ok"].sum()
        assert (part["n0"] * part["m0"]).sum() + (part["n1"] * part["m1"]).sum() == pytest.approx(own["x"].sum())
        second = (part["n0"] * (part["v0"] + part["m0"] ** 2)).sum() + (part["n1"] * (part["v1"] + part["m1"] ** 2)).sum()
        assert second == pytest.approx((own["x"] ** 2).sum())
        assert len(part) <= min(len(own), (1 << tree.DEPTH) + 512 * 32)
    # the outlier does not push all others into one bucket
    assert len(t[t["k"] == "big"]) > 300


def test_means_as_item_draws(continuous):
    """Mean and spread of resampled means equal those of the bootstrap of rows."""
    raw = continuous.toPandas()
    d = tree.mean_draws(continuous, ["k"], "x", 3000).toPandas()
    for k, own in raw.groupby("k"):
        s = d[d["k"] == k]["stat"]
        sd = own["x"].std(ddof=0) / math.sqrt(len(own))
        assert len(s) == 3000 and s.mean() == pytest.approx(own["x"].mean(), abs=4 * sd / math.sqrt(3000)) and s.std() == pytest.approx(sd, rel=0.08)


def test_intervals_as_item_draws(continuous):
    """AUROC, paired and rank intervals near those of 600 draws of every row."""
    big = continuous.where("k = 'big' and x < 400")
    for f, cols in (
        (lambda **a: I.auroc_interval(big, [], "x", "ok", unit=["unit"], **a), ("auroc", "lo", "hi")),
        (lambda **a: I.paired_auroc_difference(big, [], "x", "y", "ok", unit=["unit"], **a), ("diff", "lo", "hi", "r90_lo")),
        (lambda **a: I.spearman_interval(big, [], "x", "y", ["unit"], **a), ("rho", "lo", "hi")),
        (lambda **a: I.detection_interval(big.withColumn("bad", ~F.col("ok")).withColumn("u", -F.col("x")), [], "u", "bad", ["unit"], **a), ("auroc", "auroc_lo", "auroc_hi", "fpr", "fpr_lo", "fpr_hi")),
        (lambda **a: I.bootstrap_stat(big, [], lambda df, k, w: C.ece(df, k, "x", "ok", 10, w), "ece", ["unit"], ["x", "ok"], **a), ("ece", "lo", "hi")),
    ):
        a, b = f(b=2000).first(), f(b=100, scheme="item").first()
        width = abs(b[cols[2]] - b[cols[1]])
        assert a[cols[0]] == pytest.approx(b[cols[0]])
        assert all(abs(a[c] - b[c]) < 0.3 * width for c in cols), (cols, a, b)


def test_same_draws_on_any_partitioning(continuous):
    one = I.auroc_interval(continuous, ["k"], "x", "ok", 200).orderBy("k").collect()
    other = I.auroc_interval(continuous.repartition(17), ["k"], "x", "ok", 200).orderBy("k").collect()
    for a, b in zip(one, other, strict=True):
        assert a["auroc"] == pytest.approx(b["auroc"]) and a["lo"] == pytest.approx(b["lo"], abs=1e-9) and a["hi"] == pytest.approx(b["hi"], abs=1e-9)


def test_auroc_of_one_class_and_empty(spark, continuous):
    one = I.auroc_interval(continuous.withColumn("ok", F.lit(True)), ["k"], "x", "ok", 50).first()
    assert one["auroc"] is None and one["lo"] is None
    assert I.auroc_interval(continuous.limit(0), ["k"], "x", "ok", 50).count() == 0
    nulls = continuous.withColumn("x", F.when(F.col("k") == "big", F.col("x")))
    assert {r["k"] for r in tree.mean_draws(nulls, ["k"], "x", 10).collect()} == {"big"}


def test_exact_interval_of_a_small_table(spark):
    """The 2.5 and 97.5 percentiles of all 5**5 resamples of five rows."""
    x = [0.0, 1.0, 2.0, 4.0, 8.0]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    all_means = np.array([np.mean(c) for c in itertools.product(x, repeat=5)])
    got = I.bootstrap_mean(df, [], "x", [], 6000, 3.0).first()
    assert got["lo"] == pytest.approx(np.quantile(all_means, 0.025), abs=0.21) and got["hi"] == pytest.approx(np.quantile(all_means, 0.975), abs=0.21)
    assert got["tail"] == pytest.approx((all_means >= 3).mean(), abs=0.02)


def test_halves(spark):
    """Both halves together are the month; means and variances of draws without replacement."""
    rows = [("a", 0.5 + (i % 7) / 20, i % 3 == 0) for i in range(31)]
    df = spark.createDataFrame(rows, "month string, p_max double, correct boolean")
    got = tree.half_draws(df, ["month"], "p_max", "correct", 4000, "s").toPandas()
    find, rest = got[got["half"]], got[~got["half"]]
    assert (find["n"] == 15).all() and (rest["n"] == 16).all()
    merged = find.merge(rest, on="b")
    assert (merged["k_x"] + merged["k_y"] == 11).all() and np.allclose(merged["s_x"] + merged["s_y"], sum(p for _, p, _ in rows))
    p = np.array([p for _, p, _ in rows])
    assert find["s"].mean() == pytest.approx(15 * p.mean(), rel=0.003)
    assert find["s"].var() == pytest.approx(15 * p.var() * 16 / 30, rel=0.1)
    assert find["k"].var() == pytest.approx(15 * 11 / 31 * 20 / 31 * 16 / 30, rel=0.1)


def test_month_sums(continuous):
    got = TS.within_month_draws(continuous.where("k = 'small'").withColumnsRenamed({"x": "p_max", "ok": "correct"}), [], 300).toPandas()
    assert got.groupby("month")["n"].nunique().eq(1).all() and len(got) == 8 * 300 and (got["k"] <= got["n"]).all()


def smooth_error(residual, sigma):
    """Kernel by kernel: a reflected Gaussian at each cell, summed over its images."""
    m = len(residual)
    at = (np.arange(m) + 0.5) / m
    gap = at[:, None] - at[None, :]
    far = at[:, None] + at[None, :]
    kernel = sum(np.exp(-0.5 * ((g + 2 * j) / sigma) ** 2) for j in range(-6, 7) for g in (gap, far))
    full = np.arange(-12 * m, 12 * m)  # the weights of one cell over the whole line
    return np.abs(kernel @ residual).sum() / np.exp(-0.5 * (full / m / sigma) ** 2).sum()


def test_batched_kernel_against_direct_sums():
    rng = np.random.default_rng(1)
    m = 2000
    residuals = np.zeros((7, m))
    for k in range(5):
        cells = rng.choice(m, 1 + 40 * k)
        residuals[k, cells] = rng.normal(0.3 * (k - 2), 1, len(cells)) / (30 + 60 * k)
    residuals[5, -1] = 0.4
    got = C.smooth_eces(residuals)
    assert got[6] == 0 and got[5] == pytest.approx(0.4, abs=1e-6)
    for r, v in zip(residuals[:5], got, strict=False):
        low, high = C.NARROWEST, 1.0
        if smooth_error(r, low) <= low:
            assert v == pytest.approx(smooth_error(r, low), abs=1e-6)
            continue
        for _ in range(24):
            mid = (low + high) / 2
            low, high = (mid, high) if smooth_error(r, mid) >= mid else (low, mid)
        assert v == pytest.approx(smooth_error(r, (low + high) / 2), abs=1e-6)


def test_smooth_intervals_as_item_draws(spark):
    rng = np.random.default_rng(8)
    rows = [(f"u{i}", round(float(p), 2), bool(rng.random() < p - 0.1)) for i, p in enumerate(rng.uniform(0.4, 1, 1500))]
    df = spark.createDataFrame(rows, "unit string, p_max double, correct boolean").repartition(5)
    for half in (False, True):
        a = I.smece_draws(df, [], "p_max", "correct", 1200, ["unit"], half).toPandas()
        b = I.smece_draws(df, [], "p_max", "correct", 150, ["unit"], half, scheme="item").toPandas()
        assert len(a) == 1200 and (a["n"] == (750 if half else 1500)).all()
        assert a["smece"].mean() == pytest.approx(b["smece"].mean(), rel=0.03) and a["smece"].std() == pytest.approx(b["smece"].std(), rel=0.2)
    got = {r["scheme"]: r for r in I.smece_bounds(df, [], "p_max", "correct", 400, []).collect()}
    assert set(got) == {"percentile", "recentred", "basic", "subsample"} and got["percentile"]["smece"] == pytest.approx(C.smece(df, [], "p_max", "correct").first()["smece"])


def test_permuted_bound(spark):
    """The null of the lower bound against every arrangement of one level's answers."""
    lv = spark.createDataFrame([(0.5, 4.0, 3.0, 3.0, 1.0)], "v double, n_pre double, k_pre double, n_post double, k_post double")
    got = I.within_value_permutation_levels(lv, [], 6000).toPandas()["lower_bound"]
    every = [3 * abs((4 - k) / 4 - k / 3) / 7 for k in (sum(c) for c in itertools.permutations([1, 1, 1, 1, 0, 0, 0], 3))]
    assert got.mean() == pytest.approx(np.mean(every), abs=0.01) and got.std() == pytest.approx(np.std(every), abs=0.01)


def test_auroc_needs_mixed_buckets_only():
    t = {"n0": np.array([3, 1, 0, 0, 2, 0]), "n1": np.array([0, 0, 2, 1, 2, 4])}
    small = tree.told_apart(t)
    assert small["n0"].tolist() == [4, 0, 2, 0] and small["n1"].tolist() == [0, 3, 2, 4]
    assert tree.auroc_of(small["n0"][None], small["n1"][None]) == tree.auroc_of(t["n0"][None], t["n1"][None])


def test_ranks_match_operators(continuous):
    """On the buckets themselves the draws' formulas give the operators' values."""
    few = continuous.select("k", F.round("x", 2).alias("x"), F.round("y", 1).alias("y"), "ok").where("x < 1")
    d = tree.spearman_draws(few, ["k"], "x", "y", 1).toPandas().set_index("k")["of_buckets"]
    r = R.spearman(few, ["k"], "x", "y").toPandas().set_index("k")["rho"]
    assert d["small"] == pytest.approx(r["small"], abs=0.01) and d["big"] == pytest.approx(r["big"], abs=0.01)
    d = tree.detection_draws(few, ["k"], "x", "ok", 1).toPandas().set_index("k")
    f = R.fpr_at_tpr(few, ["k"], "x", "ok").toPandas().set_index("k")["fpr"]
    assert d["fpr_buckets"]["big"] == pytest.approx(f["big"], abs=0.005)
