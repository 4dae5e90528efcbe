"""The bucketed and the plain path agree, hot keys and values included."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from credalis.functions.seeded import key_hash
from credalis.operators import calibration as C
from credalis.operators import inference as I
from credalis.operators import prefix as P
from credalis.operators import ranking as R
from credalis.operators import resample as B
from credalis.operators import scoring as S


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one score and one key."""
    hot = F.col("id") % 3 == 0
    u = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("double") / 4294967296
    return spark.range(3000).select(
        F.col("id").cast("string").alias("unit"), F.when(hot, 0.5).otherwise(u).alias("s"), (u + F.when(hot, 0.1).otherwise(0.0) > 0.5).alias("y"),
        F.when(hot, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("k"), key_hash("tie", F.col("id")).alias("tie"),
    )


def edges(df, n=50):
    return P.score_edges(df, "s", rows_per_bucket=n)


def test_hot_value_gets_its_own_bucket(skewed):
    e = edges(skewed)
    assert len(e) > 10 and 0.5 in e and float(np.nextafter(0.5, np.inf)) in e


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_auroc_bucketed_equals_plain(skewed, keys):
    a = {tuple(r[k] for k in keys): r["auroc"] for r in R.auroc(skewed, keys, "s", "y", edges=[]).collect()}
    b = {tuple(r[k] for k in keys): r["auroc"] for r in R.auroc(skewed, keys, "s", "y", edges=edges(skewed)).collect()}
    assert a == pytest.approx(b)


def test_row_order_bucketed_equals_plain(skewed):
    base = skewed.withColumn("one", F.lit(1.0))
    for order in (["s"], ["s", "tie"]):
        src = base if len(order) == 2 else base.groupBy("s").agg(F.sum("one").alias("one"))
        plain = P.running_sums(src, [], order, ["one"], [])
        cut = P.running_sums(src, [], order, ["one"], edges(skewed))
        key = order
        a = {tuple(r[c] for c in key): r["before_one"] for r in plain.collect()}
        b = {tuple(r[c] for c in key): r["before_one"] for r in cut.collect()}
        assert a == b


def test_metrics_do_not_depend_on_partitions(skewed):
    for n in (1, 17):
        d = skewed.repartition(n)
        got = (
            R.risk_coverage(d, [], "s", "y", (0.8,), "input_order", "tie").first().asDict(),
            I.bootstrap_mean(d, [], "s", ["unit"], 8).first().asDict(),
            I.bootstrap_mean(d, [], "s", [], 20).first().asDict(),
        )
        if n == 1:
            want = got
    for a, b in zip(want, got, strict=True):
        assert a == pytest.approx(b)


def test_hash_rank_is_a_permutation_inside_hot_keys(skewed):
    r = P.hash_rank(skewed.withColumn("h", F.md5("unit")), ["k"], "h", digits=1).toPandas()
    for _, g in r.groupby("k"):
        assert sorted(g["rank"]) == list(range(1, len(g) + 1))
        assert list(g.sort_values("rank")["h"]) == sorted(g["h"])


def test_risk_coverage_average_equals_brute_force(skewed):
    p = skewed.toPandas().sort_values("s", ascending=False)
    err = (~p["y"]).to_numpy(float)
    s = p["s"].to_numpy()
    cum, before, i = np.zeros(len(s)), 0.0, 0
    while i < len(s):
        j = i
        while j < len(s) and s[j] == s[i]:
            j += 1
        rate = err[i:j].mean()
        cum[i:j] = before + rate * np.arange(1, j - i + 1)
        before, i = cum[j - 1], j
    want = (cum / np.arange(1, len(s) + 1)).mean()
    assert R.risk_coverage(skewed, [], "s", "y").first()["aurc"] == pytest.approx(want)


def test_replicate_spread_equals_all_pairs(spark):
    rng = np.random.default_rng(0)
    rows = []
    for u in range(4):
        for _ in range(5):
            p = rng.dirichlet([1, 1, 1]).round(2)
            rows.append((f"u{u}", {"a": float(p[0]), "b": float(p[1]), "c": float(p[2])}, ["a", "b", "c"]))
    df = spark.createDataFrame(rows, "unit string, dist map<string,double>, options array<string>")
    got = {r["unit"]: r["rep_tv"] for r in S.replicate_spread(df, ["unit"]).collect()}
    for u in got:
        ds = [r[1] for r in rows if r[0] == u]
        pairs = [0.5 * sum(abs(a[k] - b[k]) for k in a) for i, a in enumerate(ds) for b in ds[i + 1 :]]
        assert got[u] == pytest.approx(np.mean(pairs))


def test_clusters_stay_whole(spark):
    df = spark.range(60).select((F.col("id") % 6).cast("string").alias("c"))
    w = B.cluster_weights(df, [], "c", 30)
    assert {r["t"] for r in w.groupBy("b").agg(F.sum("w").alias("t")).collect()} == {6.0}


def test_month_blocks_fill_each_period(spark):
    df = spark.range(20).select(F.format_string("m%02d", "id").alias("month"), (F.col("id") >= 13).alias("post"))
    w = B.block_counts(B.month_block_weights(df, "post", "month", 25, 6), "post", "month")
    got = w.groupBy("post", "b").agg(F.sum("w").alias("t")).collect()
    assert {(r["post"], r["t"]) for r in got} == {(False, 13.0), (True, 7.0)} and len(got) == 50


def test_within_value_nulls_agree(skewed):
    df = skewed.select("unit", F.round("s", 1).alias("p_max"), F.col("y").alias("correct"), (F.col("unit").cast("int") % 4 == 0).alias("post"))
    rows = I.within_value_permutation(df, [], ["unit"], 40).agg(F.avg("lower_bound")).first()[0]
    lv = I.within_value_permutation_levels(C.level_table(df, []), [], 400).agg(F.avg("lower_bound")).first()[0]
    assert rows == pytest.approx(lv, rel=0.15)


def three_answers(spark, n: int = 3):
    """Units of up to ``n`` answers over three options, one question each."""
    rng = np.random.default_rng(4)
    rows = []
    for u in range(30):
        for r in range(1 + u % n):
            p = rng.dirichlet([1, 1, 1]).round(2)
            rows.append((f"u{u}", r, f"m{rng.integers(3)}" if u % 7 else None, float(p[2]), {"a": float(p[0]), "b": float(p[1]), "c": float(p[2])}, ["a", "b", "c"], "abc"[u % 3]))
    return spark.createDataFrame(rows, "unit string, replicate int, model string, known double, dist map<string,double>, options array<string>, gold string")


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("n", [3, 5])
def test_fixed_width_sums_equal_collected_answers(spark, monkeypatch, n):
    """units on the same options are sums, largest and smallest values, with the figures of whole answers."""
    df = three_answers(spark, n)
    items = df.filter("replicate = 0").select("unit", "options", "gold")
    jobs = {
        "items": lambda: S.score_items(df, items, yes_no=["known"]), "spread": lambda: S.replicate_spread(df, ["unit"]),
        "mean": lambda: S.replicate_mean(df, ["unit"]), "flips": lambda: S.top_flips(df, ["unit"]),
    }
    short = {k: f() for k, f in jobs.items()}
    collected = {k for k, x in short.items() if "collect_list" in plan_of(x)}
    assert collected == (set() if n == 3 else {"items", "spread"})
    got = {k: x.collect() for k, x in short.items()}
    monkeypatch.setattr(S, "common_options", lambda *_: None)
    for k, f in jobs.items():
        other = f()
        order = ["unit", *[c for c in ("pos",) if c in other.columns]]
        a, b = (sorted((r.asDict() for r in rows), key=lambda r: [r[c] for c in order]) for rows in (got[k], other.collect()))
        assert len(a) == len(b) > 0
        for x, y in zip(a, b, strict=True):
            assert set(x) == set(y)
            for c in x:
                assert x[c] == (pytest.approx(y[c]) if isinstance(y[c], float | dict) else y[c]), (k, c)


def test_other_lists_are_told_apart(spark):
    """A unit that lists its options in another order, or others, is not summed by place."""
    rows = [("u", {"a": 0.7, "b": 0.3}, ["a", "b"]), ("u", {"a": 0.5, "b": 0.5}, ["a", "b"]), ("v", {"a": 0.6, "b": 0.4}, ["b", "a"]), ("w", {"d": 1.0}, ["d"])]
    df = spark.createDataFrame(rows, "unit string, dist map<string,double>, options array<string>")
    got = {(r["unit"], r["pos"], r["option"]): r["p"] for r in S.replicate_mean(df, ["unit"]).collect()}
    want = {("u", 0, "a"): 0.6, ("u", 1, "b"): 0.4, ("v", 0, "b"): 0.4, ("v", 1, "a"): 0.6, ("w", 0, "d"): 1.0}
    assert got == pytest.approx(want)
