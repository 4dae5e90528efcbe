"""Toxicity on held-out rows, mixing rates against a direct solution."""

import gc
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from credalis.llm import mixing, toxicity

SCHEMA = "doc_id long, text string, score double, label double, i int, predicted int, tokens int, rate double, domain int"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(300)]
    bad = ["zzrotten", "zzvile", "zzawful"]
    docs, labels = [], []
    for i in range(1500):
        text = rng.choices(words, k=rng.randint(5, 120))
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text) + 1), rng.choice(bad).upper() + rng.choice(["", "!", ","]))
        docs.append((i, " ".join(text)))
        if i % 3:
            labels.append((i, i % 2, int(toxic)))
    docs += [(5000, None), (5001, ""), (None, "zzvile zzvile"), (7, docs[7][1]), (5002, "word " * 60000)]
    labels += [(None, 1, 1), (4, None, None), (4, 1, 0), (1, 1, 0)]
    d = spark.createDataFrame([(i, t, 0.5, 1.0, 1, 0, 9, 2.0, 3) for i, t in docs], SCHEMA)
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(tables):
    docs, labels = tables
    model = toxicity.train(docs, labels)
    assert 0 < len(model.at) < 2000
    got = toxicity.toxicity(docs, model).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    right = np.mean([r.predicted == int(r.doc_id % 5 == 0) for r in held if r.doc_id < 5000])
    assert right > 0.97 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(not r.predicted for r in got if r.doc_id in (5000, 5001, 5002))
    kept = toxicity.toxicity(docs, model, keep=True)
    assert kept.columns == ["row", "score", "predicted"] and kept.select("row.*").columns == docs.columns


def test_toxicity_empty(tables):
    docs, labels = tables
    none = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.toxicity(docs, none).collect()} == {0.5}
    assert toxicity.toxicity(docs.limit(0), none).count() == 0


def test_labels_held_out(tables):
    """Labels of held-out rows change nothing."""
    docs, labels = tables
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, other)
    assert np.array_equal(a.at, b.at) and np.array_equal(a.weight, b.weight)


def direct(t, p, target, floor):
    """Projected gradient with a small fixed step, many times."""
    r = np.maximum(np.ones(len(t)), floor)
    for _ in range(20000):
        r = np.maximum(floor, r - 0.5 * p @ (p.T @ (t * r) / t.sum() - target))
    return p.T @ (t * r) / t.sum()


@pytest.mark.parametrize("floor,shares", [(0.0, [0.5, 0.3, 0.2]), (0.0, [0.98, 0.01, 0.01]), (1.0, [0.6, 0.2, 0.2])])
def test_rates(spark, floor, shares):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.4, 0.7, 1.0], 400)
    t = rng.integers(0, 300, 400)
    budget = 1.0 if floor == 0 else 1.6
    df = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(t, p, strict=True)], "tokens long, posterior array<double>")
    steps = mixing.fit_steps(df, shares, budget, floor)
    r = np.array([x.r for x in df.select(mixing.rate_of(steps, floor).alias("r")).collect()])
    got = p.T @ (t * r) / t.sum()
    assert (r >= floor).all()
    assert np.abs(got - np.array(shares) * budget).max() <= np.abs(direct(t, p, np.array(shares) * budget, floor) - np.array(shares) * budget).max() + 0.01


def test_mixing(tables):
    docs, labels = tables
    domains = mixing.domain_labels(labels, [(0, 0), (0, 1), (1, 0), (1, 1)])
    got = mixing.mixing_rates(docs, domains, [0.4, 0.1, 0.4, 0.1]).collect()
    assert len(got) == docs.count() and all(r.rate >= 0 and abs(sum(r.posterior) - 1) < 1e-6 for r in got)
    rows = mixing.mixed_rows(docs, domains, [0.4, 0.1, 0.4, 0.1], 1.3, 1.0)
    assert rows.columns == docs.columns and rows.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    none = docs.limit(0)
    assert mixing.mixing_rates(none, domains, [0.5, 0.2, 0.2, 0.1]).count() == mixing.mixed_rows(none, domains, [0.5, 0.2, 0.2, 0.1]).count() == 0
    assert {tuple(r.posterior) for r in mixing.mixing_rates(docs, domains.limit(0), [1, 1, 1, 1]).collect()} == {(0.25, 0.25, 0.25, 0.25)}


def plain_ftrl(examples, epochs=toxicity.EPOCHS):
    """Follow the proximally regularised leader, one named feature after the other."""
    z, n = {}, {}

    def weight(f):
        l1 = 0.0 if f == "bias" else toxicity.L1
        if abs(z.get(f, 0.0)) <= l1:
            return 0.0
        return ((1 if z[f] > 0 else -1) * l1 - z[f]) / ((toxicity.BETA + n[f] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(epochs):
        for found, y in examples:
            w = {f: weight(f) for f in [*found, "bias"]}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for f, v in w.items():
                old = n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / toxicity.ALPHA * v
                n[f] = old + g * g
    return {f: weight(f) for f in z if weight(f)}


def named_features(text):
    w = "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in text).split()
    pairs = [("near", a, b) for a, b in zip(w, w[1:], strict=False)] + [("far", a, b) for a, b in zip(w, w[2:], strict=False)]
    return set(w) | {("stem", x[: toxicity.STEM]) for x in w} | set(pairs)


def test_ftrl_against_named_features():
    """Hashed training gives the scores of plain training on explicit words, heads, pairs and skip pairs."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdef", k=6)) for _ in range(40)]
    examples = []
    for i in range(150):
        text = rng.choices(words, k=rng.randint(0, 15)) + (["Vile!", "thing"] if i % 3 == 0 else [])
        rng.shuffle(text)
        examples.append((" ".join(text), float(i % 3 == 0)))
    model = toxicity.fit([t.encode() for t, _ in examples], np.array([y for _, y in examples]))
    plain = plain_ftrl([(named_features(t), y) for t, y in examples])
    assert len(model.at) == len(plain) - ("bias" in plain)
    for t, _ in examples[:40]:
        want = 1 / (1 + np.exp(-sum(plain.get(f, 0.0) for f in [*named_features(t), "bias"])))
        got = model.scores(*toxicity.features(toxicity.words_of([t.encode()], toxicity.ALPHANUMERIC)), 1)[0]
        assert got == pytest.approx(want, abs=1e-9)


def test_fit_leaves_no_memory():
    """Places are those of the sorted distinct coordinates, the bias last; nothing of a shard stays behind its fit."""
    rng = np.random.default_rng(6)
    lists = [np.unique(rng.integers(0, 1 << toxicity.BITS, n)).astype(np.int32) for n in (0, 3, 400, 400)] + [np.array([0, (1 << toxicity.BITS) - 1], np.int32)]
    seen, own = toxicity.compact(list(lists))
    want = np.unique(np.concatenate(lists))
    assert (seen == want).all() and len(seen) == len(want)
    assert all(x.dtype == np.int32 and (x == [*np.searchsorted(want, y), len(want)]).all() for x, y in zip(own, lists, strict=True))
    gc.collect()
    gc.disable()
    try:
        toxicity.fit([b"vile thing", b"good thing"] * 20, np.array([1.0, 0.0] * 20))
        assert gc.collect() == 0
    finally:
        gc.enable()
