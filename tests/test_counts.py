"""Full counts of draws, and draws from the count tree against brute force."""

import itertools

import __spark_entry__ as entry
import numpy as np
from credalis.operators import inference as I
from credalis.operators import timesplit as TS

SF = "/root/testdata/sf0.001"


def test_full_counts(spark):
    q = entry.queries()
    names = "bootstrap_mean bootstrap_stat auroc_interval paired_auroc_difference stratified_resample mean_difference equivalence sign_flip_test within_value_permutation split_selection"
    assert {f"{n}_levels" for n in names.split()} | {"random_call_draws_full", "heldout_acceptance_full"} <= set(q)
    assert q["stratified_resample_levels"](spark, SF).select("b").distinct().count() == 2000
    assert q["split_selection_levels"](spark, SF).select("split_no").distinct().count() == 50


def test_sign_flips(spark):
    d = [0.5, 0.5, 0.5, -0.25, -0.25, 1.0, -0.75, 0.125, 0.125, 0.125]
    df = spark.createDataFrame([("m", i, x) for i, x in enumerate(d)], "month string, unit long, gap double")
    got = I.sign_flip_test(df, ["month"], "gap", [], 4000).first()
    all_signs = np.array(list(itertools.product([-1, 1], repeat=len(d))))
    assert got["n"] == len(d) and abs(got["p"] - ((all_signs * d).mean(axis=1) <= np.mean(d) + 1e-12).mean()) < 0.03


def test_split_halves(spark):
    """Both halves of each month, from the tree as by row."""
    rows = [(f"{m}-{i}", f"2000-{m:02d}", 0.5 + (i % 4) / 10, i % 3 < (2 if m < 8 else 1)) for m in range(1, 17) for i in range(20 + m)]
    df = spark.createDataFrame(rows, "unit string, month string, p_max double, correct boolean")
    total = len(rows) - sum((20 + m) // 2 for m in range(1, 17))
    for scheme in ("item", "tree"):
        got = TS.split_selection(df, ["unit"], 40, scheme=scheme).toPandas()
        assert len(got) == 40 and (got["n_pre"] + got["n_post"] == total).all()
        assert (got["cutoff"] == "2000-08").mean() > 0.6
