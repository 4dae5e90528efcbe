"""The pipeline, stage by stage, against brute force on a small table."""

import random
import re
import tempfile
from collections import Counter

import pytest

import corpus_pipeline
from credalis.llm import toxicity
from tests.llm.test_near import edited
from tests.llm.test_words import brute as contamination

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def five(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1))))


def one_each(rows):
    """Rows with the smallest id of each component, rows alike in id and text once."""
    rows = list(dict.fromkeys(rows))
    sets, root = [five(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        best[find(i)] = min(best.get(find(i), r), r, key=lambda x: (x[0] is None, x[0] or 0))
    return best.values()


@pytest.fixture(scope="module")
def folder(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(words, k=25))) for i in range(6)]
    texts = []
    for _ in range(60):
        base = rng.choices(words, k=rng.randint(1, 150))
        texts.append(base)
        texts += [edited(rng, base, rng.choice([0, 1, 2]), words) for _ in range(rng.randint(0, 3))]
    texts = [" ".join(t) for t in texts]
    for k in range(0, len(texts), 9):
        texts[k] += " " + " ".join(rng.choices(["zzvile", "ZZrotten!", "zzawful"], k=4))
    for k in range(4, len(texts), 11):
        texts[k] += " " + rng.choice(items)[1]
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [(9000, None, None, None, None), (9001, "", "en", "s", 0), (9002, " ", "en", "s", 1), rows[3], rows[3]]
    path = tempfile.mkdtemp(prefix="credalis-pipeline-")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 9 == 0 and "zz" in texts[i].lower())) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, items


def test_stages(spark, folder):
    path, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    before = docs
    rows = lambda df: [tuple(r) for r in df.select(docs.columns).collect()]
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, path).cache()
        have, got = rows(before), rows(after)
        if name != "sharding":
            assert after.columns == docs.columns
        if name == "toxicity":
            model = toxicity.train(before, spark.read.parquet(f"{path}/labels.parquet"))
            bad = {r.doc_id for r in toxicity.toxicity(before, model).where("predicted = 1").collect()}
            assert bad and Counter(got) == Counter(r for r in have if r[0] not in bad)
        if name == "jaccard_join":
            assert Counter(got) == Counter(one_each(have)) and len(got) < len(have)
        if name == "decontamination":
            assert Counter(got) == Counter(r for r in have if not contamination(r[1], items)[4]) and len(got) < len(have)
        if name == "mixing":
            assert set(got) == set(have) and len(got) > len(have)
        if name == "sharding":
            assert Counter(got) == Counter(have)
            slots = after.groupBy("shard").agg({"slot": "max", "*": "count"}).collect()
            assert all(r["max(slot)"] + 1 == r["count(1)"] for r in slots)
        before = after


def test_run(spark, folder):
    path, _ = folder
    out = corpus_pipeline.run(spark, path)
    assert {"doc_id", "text", "shard", "slot"} <= set(out.columns) and out.count() > 0
    none = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, path).count() == 0
