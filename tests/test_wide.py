"""A unit with known options is one row of the exchange, with the numbers of the general path."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from credalis.functions.md5 import Heads
from credalis.operators import calibration as C
from credalis.operators import ranking as R
from credalis.operators import replicates as RP
from credalis.operators import scoring as S
from credalis.operators import summaries as SU

OPTIONS = ("b", "a", "c")


def exchanges(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]


@pytest.fixture(scope="module")
def answers(spark):
    rng = np.random.default_rng(5)
    rows = []
    for u in range(40):
        for r in range(1 + u % 4):
            p = rng.dirichlet([1, 1, 1]).tolist() if u % 5 else [0.4, 0.4, 0.2]
            rows.append((None if u == 3 else f"u{u}", ["s", None][u % 7 == 0], r, dict(zip(OPTIONS, p))))
    return spark.createDataFrame(rows, "unit string, set_name string, replicate int, dist map<string,double>")


def close(a, b, keys):
    def table(df):
        return sorted((tuple(r[k] for k in keys), r) for r in df.collect()) if not keys else {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}

    x, y = table(a), table(b)
    assert x.keys() == y.keys() and len(x) > 1
    for k in x:
        assert x[k] == pytest.approx(y[k], nan_ok=True)


def test_ensemble_of_known_labels(answers):
    k = ["set_name", "unit"]
    wide = S.ensemble_decompose(answers, k, OPTIONS)
    assert len(exchanges(wide)) == 1
    close(wide.drop("second"), S.ensemble_decompose(answers.select(*k, F.explode("dist").alias("label", "p")), k), k)


def test_spread_of_known_options(answers):
    k = ["set_name", "unit"]
    close(S.max_abs_diff(answers, k, OPTIONS), S.max_abs_diff(answers, k), k)
    long = answers.select(*k, F.explode("dist").alias("option", "p"))
    close(SU.replicate_variance(answers, ["set_name"], ["unit"], OPTIONS), SU.replicate_variance(long, ["set_name"], ["unit"]), ["set_name"])


@pytest.mark.parametrize("dist", [{"b": 0.5, "a": 0.5}, {"b": 0.5, "a": 0.5, "c": 0.0, "d": 0.0}, {"b": 0.5, "a": 0.5, "c": None}, None])
def test_other_options_are_refused(spark, dist):
    df = spark.createDataFrame([("u", dist)], "unit string, dist map<string,double>")
    for out in (S.ensemble_decompose(df, ["unit"], OPTIONS), S.max_abs_diff(df, ["unit"], OPTIONS), SU.replicate_variance(df, [], ["unit"], OPTIONS)):
        with pytest.raises(Exception, match="other options"):
            out.collect()


def test_ranks_by_bucket(spark):
    rng = np.random.default_rng(2)
    rows = [(["k", None][i % 3 == 0], float(rng.integers(0, 40)) if i % 4 else 7.0, None if i % 50 == 0 else float(rng.random()), float(i % 3 + 1)) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, x double, y double, w double")
    hot = [3.0, 7.0, float(np.nextafter(7.0, np.inf)), 20.0]
    for weight in (None, "w"):
        plain = R.spearman(df, ["k"], "x", "y", weight, ([], []))
        cut = R.spearman(df, ["k"], "x", "y", weight, (hot, [0.2, 0.5, 0.9]))
        assert cut.columns == plain.columns and len(exchanges(cut)) < len(exchanges(plain))
        close(cut, plain, ["k"])


def test_orders_as_numbers(answers):
    rows = answers.withColumn("options", F.array(*[F.lit(o) for o in OPTIONS]))
    rows = rows.unionByName(rows.where("unit = 'u7'"))  # more than three orders
    close(S.order_invariance(rows, ["set_name", "unit"], OPTIONS), S.order_invariance(rows, ["set_name", "unit"]), ["set_name", "unit"])


@pytest.fixture
def graded(answers):
    consts = {"options": F.array(*[F.lit(o) for o in OPTIONS]), "gold": F.lit("a"), "first_listed": F.lit("b"), "swap_target": F.lit(None).cast("string")}
    empty = answers.where("unit = 'u8'").withColumn("dist", F.expr("map('z', 1.0D)"))  # nothing on any listed option
    short = answers.where("unit = 'u9'").withColumns({"unit": F.lit("few"), "dist": F.expr("map('a', 0.25D)")})
    return answers.where("unit <> 'u8' or unit is null").unionByName(empty).unionByName(short).withColumns(consts)


def test_cells_of_sums(graded, monkeypatch):
    k = ["set_name", "unit"]
    wide = S.aggregate_cells(graded, k)
    assert len(exchanges(wide)) == 1
    monkeypatch.setattr(S, "common_options", lambda *_: None)
    general = S.aggregate_cells(graded, k)
    assert wide.columns == general.columns and wide.dtypes == general.dtypes
    close(wide, general, k)


def test_modes_of_sums(graded, monkeypatch):
    """Every mode, the random call among them, with repeated, missing and unasked replicates."""
    k = ["set_name", "gold", "unit"]
    rows = graded.unionByName(graded.where("unit = 'u5'")).where("not (unit = 'u6' and replicate = 0)")
    wide = RP.replicate_modes(rows, k, 3)
    assert not any("_r" in e for e in exchanges(wide)) and len(exchanges(wide)) == 1
    monkeypatch.setattr(S, "common_options", lambda *_: None)
    general = RP.replicate_modes(rows, k, 3)
    assert wide.columns == general.columns
    close(wide, general, ["mode", "frame", *k])
    assert {"mean3", "mean2", "single", "single_random"} == {r[0] for r in wide.select("mode").distinct().collect()}


def test_call_draws(spark):
    """Each draw against its calls picked one by one; a pick is uniform and differs between draws."""
    rng = np.random.default_rng(4)
    rows = [(["s", "t", None][u % 3], f"u{u}", r, float(rng.random()), bool(rng.random() < 0.5)) for u in range(300) for r in range(3) if u != 5 or r]
    df = spark.createDataFrame(rows, "k string, unit string, replicate int, p_max double, correct boolean")
    got = {(r["k"], r["d"]): r for r in RP.call_draws(df.repartition(5), ["k"], ["unit"], 3, 60).collect()}
    assert len(got) == 180
    h = {r["unit"]: r["h"] for r in df.select("unit", F.xxhash64(F.lit("call"), F.coalesce("k", F.lit("\0")), "unit").alias("h")).distinct().collect()}
    share = np.array([[RP.picked(np.array([h[u]]).view(np.uint64), d, 3)[0] for u in h] for d in range(60)])
    assert abs(np.bincount(share.ravel().astype(int), minlength=3) / share.size - 1 / 3).max() < 0.02
    pick = {(u, d): share[d, i] for i, u in enumerate(h) for d in range(60)}
    for d in (0, 7, 59):
        for key in ("s", "t", None):
            mine = [(p, ok) for k, u, r, p, ok in rows if k == key and pick[u, d] == r]
            row, grid = got[key, d], np.zeros(C.SMOOTH_GRID)
            for p, ok in mine:
                grid[min(int(p * C.SMOOTH_GRID), C.SMOOTH_GRID - 1)] += ok - p
            assert row["n"] == len(mine) and row["accuracy"] == pytest.approx(np.mean([ok for _, ok in mine]))
            assert row["smece"] == pytest.approx(C.smooth_eces(grid[None] / len(mine))[0])


def test_call_sums(spark):
    """Every draw as random_calls gives it, with one hash a unit and draw, not one an answer."""
    rng = np.random.default_rng(6)
    rows = [("s" if u % 2 else None, None if u == 4 else f"u{u}", r, None if u == 6 else float(rng.random()), None if u == 8 else u % 3 > (r or 0)) for u in range(60) for r in (0, 1, 2, 2 if u % 7 else 5, None)]
    df = spark.createDataFrame(rows, "k string, unit string, replicate int, p_max double, correct boolean")
    calls = RP.random_calls(df, ["unit"], 3, 30).groupBy("k", "d").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg("p_max").alias("mean_confidence")
    )
    got = RP.call_sums(df, ["k"], ["unit"], 3, 30)
    assert got.columns == calls.columns and got.dtypes == calls.dtypes
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan and len(exchanges(got)) == 1  # no answer is repeated or moved
    close(got, calls, ["k", "d"])


def test_many_digests_at_once():
    texts = [b"", b"a", b"call|1|2", *[bytes(range(65, 65 + n % 50)) * (1 + n // 50) for n in range(40, 140)], "h\u00e9|\0".encode()]
    heads = Heads(texts)
    ends = [b"", b"|7", b"|499", b"x" * 20]
    assert heads.of(ends).tolist() == [[int(hashlib.md5(t + end).hexdigest()[:8], 16) for t in texts] for end in ends]
