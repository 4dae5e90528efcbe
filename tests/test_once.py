"""Costly rows are derived once, and units cross the network once."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from credalis.operators import calibration as C
from credalis.operators import crossfit as X
from credalis.operators import inference as I
from credalis.operators import ranking as R
from credalis.operators import recalibration as RC
from credalis.operators import replicates as RP
from credalis.operators import scoring as S
from credalis.operators import summaries as SU


@pytest.mark.parametrize("step", [
    lambda df: R.auroc(df, ["k"], "x", "ok"),
    lambda df: I.auroc_interval(df, ["k"], "x", "ok", 40),
    lambda df: I.detection_interval(df, ["k"], "x", "ok", [], 40),
    lambda df: I.bootstrap_mean(df, ["k"], "x", [], 40),
    lambda df: I.equivalence(df, ["k"], "x", 0.1, [], 40),
    lambda df: C.reliability_bins(df, ["k"], "x", "ok", 4, "tie"),
])
def test_rows_are_derived_once(spark, step):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def costly(n):
        calls.add(1)
        return (n * 37 % 101) / 101

    df = spark.range(400).select((F.col("id") % 2).alias("k"), costly("id").alias("x"), (F.col("id") % 3 == 0).alias("ok"), F.md5(F.col("id").cast("string")).alias("tie"))
    step(df).collect()
    assert calls.value == 400


def test_text_vectors_are_made_once(spark, monkeypatch):
    calls = spark.sparkContext.accumulator(0)
    own = X._sublinear.func

    @F.udf(X._sublinear.returnType)
    def counted(v):
        calls.add(1)
        return own(v)

    monkeypatch.setattr(X, "_sublinear", counted)
    df = spark.range(40).select("id", F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"), (F.col("id") % 3 == 0).alias("y"))
    assert X.text_oof_scores(df, "text", "y", ["id"], features=1 << 8).count() == 40
    assert calls.value == 40


def exchanges(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]


def test_split_half_moves_no_rows(spark):
    rows = [(f"u{i % 50}" if i % 60 else None, i % 2, float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "unit string, g int, x double")
    for by in ([], ["g"]):
        out = RC.split_half(df, "unit", by=by)
        assert not exchanges(out)
        assert out.columns == [*by, "unit", *[c for c in df.columns if c not in (*by, "unit")], "fit"]
        got = out.collect()
        assert len(got) == sum(r[0] is not None for r in rows)
        for g in ({0, 1} if by else {None}):
            mine = {r["unit"]: r["fit"] for r in got if g is None or r["g"] == g}
            ids = {r[0] for r in rows if g is None or r[1] == g}
            assert abs(sum(mine.values()) - len(ids) // 2) <= 1
    assert RC.split_half(df.limit(0), "unit").count() == 0


@pytest.mark.parametrize("options", [3, 40])
def test_options_of_a_unit_meet_in_its_row(spark, options):
    """More options than are told apart by columns take the general path, with the same numbers."""
    rng = np.random.default_rng(1)
    rows = [("s", f"u{u}", {f"o{o}": None if (u + r) % 9 == 0 and o == 0 else float(rng.random()) for o in range(options) if (u + o) % 4 or r}) for u in range(20) for r in range(3)]
    rows += [("s", "empty", {}), ("s", "none", None)]
    df = spark.createDataFrame(rows, "k string, unit string, dist map<string,double>")
    own: dict = {}
    for _, u, d in rows:
        for o, p in (d or {}).items():
            own.setdefault(u, {}).setdefault(o, []).append(p)
    values = {u: {o: [p for p in ps if p is not None] for o, ps in d.items()} for u, d in own.items()}
    diff = S.max_abs_diff(df, ["unit"])
    want = {u: max((max(p) - min(p) for p in d.values() if p), default=None) for u, d in values.items()}
    assert {r["unit"]: r["max_abs_diff"] for r in diff.collect()} == pytest.approx(want)
    long = df.select("k", "unit", F.explode("dist").alias("option", "p"))
    var = SU.replicate_variance(long, ["k"], ["unit"])
    mid = [p for d in values.values() for p in d.values() if p and SU.MID[0] <= np.mean(p) <= SU.MID[1]]
    v = [np.var(p, ddof=1) for p in mid if len(p) > 1]
    row = var.first()
    assert row["options"] == len(mid)
    assert row["pooled_n"] == pytest.approx(sum(np.mean(p) * (1 - np.mean(p)) for p in mid) / sum(v))
    if options < 16:
        assert len(exchanges(S.max_abs_diff(df, ["unit"]))) == 1
        assert not any("option#" in e for e in exchanges(SU.replicate_variance(long, ["k"], ["unit"])))


def test_every_pair_by_constant_lists(spark):
    df = spark.createDataFrame([("u", r) for r in (0, 1, 2, 3, None)], "unit string, replicate int")
    out = RP.every_pair(df, 3)
    assert "lambda" not in out._jdf.queryExecution().analyzed().toString()
    got = sorted((r["pair"], r["side"], r["replicate"]) for r in out.collect())
    assert got == [("0-1", "a", 0), ("0-1", "b", 1), ("0-2", "a", 0), ("0-2", "b", 2), ("1-2", "a", 1), ("1-2", "b", 2)]
    assert RP.every_pair(df, 1).count() == 0
