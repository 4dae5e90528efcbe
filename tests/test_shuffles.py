"""Operators whose rows meet once: results of the ways for few and for many rows, and what is exchanged."""

import hashlib
from itertools import combinations
from math import log

import pytest
from pyspark.sql import functions as F

from credalis.functions.seeded import pick, pick_of
from credalis.operators import joins as J
from credalis.operators import replicates as RP
from credalis.operators import sampling as SM
from credalis.operators import scoring as S
from credalis.operators import summaries as SU
from credalis.plans import views


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def answers(spark):
    """Units with one to four answers, one of them with a null key, one answered twice alike."""
    p = {"u1": [0.7, 0.2, 0.5], "u2": [0.4], "u3": [0.9, 0.9, 0.1, 0.3], None: [0.2, 0.6], "u4": [0.5, 0.5]}
    data = [(u, i, {"A": x, "B": 1 - x}, "AB"[i % 2]) for u, xs in p.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(data, "unit string, replicate int, dist map<string,double>, gold string")
    return df.select("*", F.array(F.lit("A"), F.lit("B")).alias("options"), F.lit("A").alias("first_listed"), F.lit("B").alias("swap_target"))


def same(a, b):
    assert a.columns == b.columns
    x, y = (sorted(map(tuple, d.collect()), key=str) for d in (a, b))
    assert len(x) == len(y)
    for r, s in zip(x, y, strict=True):
        assert [pytest.approx(v) if isinstance(v, float) else v for v in r] == list(s)


def test_numbers_of_a_hash(spark):
    t = spark.range(50).select(F.md5(F.col("id").cast("string")).alias("h"))
    t = t.select("h", views.bits(F.col("h"), 1, 16).alias("hi"), views.bits(F.col("h"), 17, 12).alias("lo"))
    got = t.select("h", *[views.part16("hi", s) for s in (48, 32, 16, 0)], *[views.part16("lo", s) for s in (32, 16, 0)]).collect()
    assert all(list(r)[1:] == [int(r["h"][4 * i : 4 * i + 4], 16) for i in range(7)] for r in got)


def test_picks_without_number_parsing(spark):
    t = spark.range(3000)
    for n in (1, 2, 3, 7, 16, 17):
        assert t.where(pick_of(n, "s", "id") != pick(F.lit(n), "s", "id")).isEmpty()
    assert "conv(" not in plan(RP.random_calls(t.withColumn("replicate", F.lit(0)), ["id"], 3, 5))


def test_orders_meet_once(answers, monkeypatch):
    rows = S.order_invariance(answers, ["unit"])
    assert "Join" not in plan(rows)
    monkeypatch.setattr(S, "FEW_ORDERS", 0)
    same(rows, S.order_invariance(answers, ["unit"]))
    def js(a, b):
        return sum(x * log(2 * x / (x + y)) + y * log(2 * y / (x + y)) for x, y in ((a, b), (1 - a, 1 - b))) / 2

    want = sum(js(a, b) for a, b in combinations([0.7, 0.2, 0.5], 2)) / 3
    assert rows.where("unit = 'u1'").first()["mean_js"] == pytest.approx(want)


def test_modes_meet_once(answers, monkeypatch):
    rows = RP.replicate_modes(answers, ["gold", "unit"], 3)
    assert plan(rows).count("Exchange hashpartitioning") == 1
    monkeypatch.setattr(S, "FEW_REPLICATES", 0)
    same(rows, RP.replicate_modes(answers, ["gold", "unit"], 3))


def test_cells_meet_once(answers, monkeypatch):
    rows = S.aggregate_cells(answers, ["unit"])
    assert "Join" not in plan(rows)
    with monkeypatch.context() as m:
        m.setattr(S, "_listed_alike", lambda *_: False)
        same(rows, S.aggregate_cells(answers, ["unit"]))
    other = answers.withColumn("options", F.when(F.col("replicate") == 1, F.array(F.lit("B"), F.lit("A"))).otherwise(F.col("options")))
    assert S._listed_alike(answers, ["unit"]) and not S._listed_alike(other, ["unit"])


def test_agreement_sends_no_rows_through_the_driver(spark):
    """Joined rows are never broadcast, whatever their size is guessed at."""
    a = spark.range(40).select(F.col("id").alias("unit"), F.lit("k").alias("k"), (F.col("id") % 7).alias("x"), (F.col("id") % 2 == 0).alias("correct"))
    seen = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(J, "checkpointed", lambda j: seen.append(plan(j)) or j)
        assert J.model_agreement(a, a, ["unit"], ["k"], "x").first()["rho"] == pytest.approx(1)
    assert "Broadcast" not in seen[0]
    answers = a.select("unit", "k", "x", F.lit("A").alias("gold"), F.create_map(F.lit("A"), F.lit(1.0)).alias("dist"), F.lit(0).alias("variant"))
    assert "Broadcast" not in plan(SU.contrast_variants(answers, ["k"], ["unit"], "A", 0))


@pytest.mark.parametrize("copies", [1, 40])
def test_curve_of_the_smallest_hashes(spark, copies):
    """Nested sizes against brute force; with many rows a unit, the first bound is too low."""
    units = 2000 // copies
    df = spark.range(units).select(
        F.lit("s").alias("k"), F.col("id").cast("string").alias("unit"), F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("_c")
    ).drop("_c")
    p = F.conv(F.substring(F.md5("unit"), 1, 4), 16, 10).cast("double") / 65536
    df = df.select("k", "unit", F.create_map(F.lit("A"), p, F.lit("B"), 1 - p).alias("dist"), F.create_map(F.lit("A"), F.lit(0.5), F.lit("B"), F.lit(0.5)).alias("ideal"))
    got = {r["k"]: r["mean_tv"] for r in SU.averaging_curve(df.withColumnRenamed("k", "s"), ["s"], ["unit"], (1, 4, 16), 3).collect()}
    value = {u: int(hashlib.md5(u.encode()).hexdigest()[:4], 16) / 65536 for u in map(str, range(units))}
    for size in (1, 4, 16):
        tv = []
        for d in range(3):
            order = sorted((u for u in value for _ in range(copies)), key=lambda u: hashlib.md5(f"orders|{u}|{d}".encode()).hexdigest())
            drawn = order[:size]
            mean = sum(value[u] for u in drawn) / size
            tv.append(abs(mean - 0.5))
        assert got[size] == pytest.approx(sum(tv) / 3)


def test_fewer_new_names_than_wanted(spark):
    names = spark.createDataFrame([(f"{a} {b}",) for a in ("Ann", "Bob", "Cy") for b in ("Stone", "Lake")], "name string")
    some = names.where("name <> 'Cy Lake' and name <> 'Ann Stone'")
    got = SM.recombine_names(some, some, 5, fewer=True).collect()
    assert {r["name"] for r in got} == {"Cy Lake", "Ann Stone"}
    assert SM.recombine_names(names, names, 5, fewer=True).isEmpty()


def test_two_best_options_deal_no_series(spark):
    """A series with all the rows is not dealt to one task for its two winners."""
    df = spark.range(200).select(F.lit("s").alias("s"), (F.rand(1) / 2).alias("a"), (F.rand(2) / 3).alias("b"))
    df = df.select("s", "a", "b", F.create_map(F.lit("A"), F.col("a"), F.lit("B"), F.col("b"), F.lit("C"), F.lit(0.01)).alias("dist"), F.array(*map(F.lit, "ABC")).alias("options"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = SU.top2_correlation(df, ["s"])
        assert "SortMergeJoin" not in plan(got)
        assert got.first()["top2_corr"] == pytest.approx(df.agg(F.corr("a", "b")).first()[0])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
