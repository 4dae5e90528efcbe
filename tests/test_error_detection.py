"""Replicate signal, error structure and bins of the error detection study, by hand."""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from credalis.plans import studies

OPTIONS = ("A", "B", "C", "D")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    out = []
    for u in range(160):
        gold, sure = OPTIONS[u % 4], rng.random()
        for r in range(3):
            p = rng.dirichlet([1 + 6 * sure * (o == gold) for o in OPTIONS])
            out.append(("s" if u < 150 else "few", f"u{u}", r, gold, p))
    return out


@pytest.fixture(scope="module")
def answers(spark, rows):
    data = [(s, u, r, g, list(OPTIONS), {o: float(x) for o, x in zip(OPTIONS, p)}) for s, u, r, g, p in rows]
    return spark.createDataFrame(data, "set_name string, unit string, replicate int, gold string, options array<string>, dist map<string,double>")


def auroc(score, y):
    pos, neg = score[y], score[~y]
    return ((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg))


def parts(df):
    return {(r["part"], r["group"], r["metric"]): r["value"] for r in df.collect()}


def test_replicate_signal(answers, rows, monkeypatch):
    by = {}
    for s, u, _, g, p in rows:
        by.setdefault((s, u), (g, []))[1].append(p)
    cells = {}
    for (s, u), (g, ps) in by.items():
        mean = np.mean(ps, axis=0)
        tv = np.mean([np.abs(a - b).sum() / 2 for a, b in combinations(ps, 2)])
        cells.setdefault(s, []).append((tv, OPTIONS[mean.argmax()] != g, len({p.argmax() for p in ps}) > 1, mean.max()))
    c = studies.replicate_cells(answers)
    monkeypatch.setattr(studies, "MIN_ERRORS", sum(x[1] for x in cells["few"]) + 1)
    got = parts(studies.replicate_signal(c, 100))
    for s, x in cells.items():
        tv, wrong, flip, _ = map(np.array, zip(*x))
        assert got["replicates", s, "errors"] == wrong.sum() and got["replicates", s, "rep_flip_rate"] == pytest.approx(flip.mean(), abs=1e-6)
        assert got["replicates", s, "mean_rep_tv"] == pytest.approx(tv.mean(), abs=1e-6)
    tv, wrong, _, conf = map(np.array, zip(*cells["s"]))
    assert got["replicate_auroc", "s|rep_tv", "auroc"] == pytest.approx(auroc(tv, wrong), abs=1e-6)
    gain = got["replicate_auroc", "s|s_b", "auroc"] - got["replicate_auroc", "s|s_p", "auroc"]
    assert got["replicate_gain", "s", "diff"] == pytest.approx(gain, abs=2e-6)
    assert got["replicate_gain", "s", "lo"] <= got["replicate_gain", "s", "hi"] and ("spread_entropy", "s", "rho") in got
    assert not any(p == "replicate_auroc" and g.startswith("few") for p, g, _ in got)


def test_error_structure(answers, rows):
    got = parts(studies.error_structure(answers, 3))
    mean = {u: np.mean([p for _, v, _, _, p in rows if v == u], axis=0) for _, u, *_ in rows}
    own = [(g, OPTIONS[p.argmax()], OPTIONS[p.argsort()[-2]], np.sort(p)[-2] / (1 - p.max()), {OPTIONS[i] for i in mean[u].argsort()[-2:]}, OPTIONS[mean[u].argmax()]) for s, u, r, g, p in rows if s == "s" and r == 1]
    wrong = [x for x in own if x[0] != x[1]]
    at = "structure", "1|s"
    assert got[*at, "errors"] == len(wrong) and got[*at, "chance_in_top2"] == pytest.approx(2 / 3, abs=1e-6)
    assert got[*at, "runner_up_share"] == pytest.approx(np.mean([x[3] for x in own]), abs=1e-6)
    assert got[*at, "gold_is_second"] == pytest.approx(np.mean([x[2] == x[0] for x in wrong]), abs=1e-6)
    assert got[*at, "in_ensemble_top2"] == pytest.approx(np.mean([x[1] in x[4] for x in wrong]), abs=1e-6)
    a, b = Counter((x[0], x[1]) for x in wrong), Counter((x[0], x[5]) for x in own if x[0] != x[5])
    assert got["ensemble_confusions", "1|s", "shared"] == len(set(a) & set(b))
    assert got["ensemble_confusions", "1|s", "share_on_shared"] == pytest.approx(sum(a[x] for x in set(a) & set(b)) / len(wrong), abs=1e-6)
    want = sorted(a, key=lambda x: (-a[x], x))[:3]
    assert {g for p, g, _ in got if p == "most_confused" and g.startswith("1|s|")} == {f"1|s|{x}|{y}" for x, y in want}
    assert all(got["most_confused", f"1|s|{x}|{y}", "n"] == a[x, y] and got["most_confused", f"1|s|{x}|{y}", "ensemble"] == b[x, y] for x, y in want)
