"""Near copies and repeated passages against brute force."""

import hashlib
import random
import re
from collections import defaultdict
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from credalis.llm import components, jaccard, passages, suffixes
from credalis.llm.lanes import stream_of

SCHEMA = "doc_id long, text string, n long, component int, sig string, rid int, key int, chunk int, tokens string"


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, 1, 2, "s", 3, 4, 5, "t") for i, t in rows], SCHEMA).repartition(parts)


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 4]) for i in range(max(len(w) - 3, min(len(w), 1))))


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        low[find(i)].append(d)
    small = {k: min((x for x in v if x is not None), default=None) for k, v in low.items()}
    return sorted(((d, len(sets[i]), small[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def edited(rng, words, k, vocabulary):
    out = list(words)
    for _ in range(k):
        out[rng.randrange(len(out))] = rng.choice(vocabulary)
    return out


@pytest.mark.parametrize("rare", [64, 3])
def test_near_copies(spark, monkeypatch, rare):
    monkeypatch.setattr(jaccard, "BUCKET_BYTES", 20000)
    rng = random.Random(rare)
    vocabulary = [f"w{i}" for i in range(400)]
    say = lambda n: rng.choices(vocabulary, k=n)
    passage = say(30)
    texts = [None, "", " ", "one", "One", "one two three", "one two three four", "one  TWO three\nfour", "one two three four five", "a " * 500, "a " * 900]
    for n, m in ((150, 60), (40, 20), (700, 12), (90, 40)):
        base = say(n)
        texts += [" ".join(edited(rng, base, rng.choice([0, 1, 1, 2, 3, 5]) * n // 150, vocabulary)) for _ in range(m)]
    chain = say(200)
    for i in range(12):  # each is near the one before only
        chain[(i * 16) % 200] = f"c{i}"
        chain[(i * 16 + 8) % 200] = f"d{i}"
        texts.append(" ".join(chain))
    texts += [" ".join(say(rng.randint(1, 60)) + passage + say(rng.randint(1, 60))) for _ in range(60)]
    texts += [" ".join(say(rng.randint(1, 90))) for _ in range(40)]
    rng.shuffle(texts)
    rows = [(i // 2 if i % 7 == 0 else i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, "only null here"), (3, texts[3])]
    got = sorted((tuple(r) for r in jaccard.near_copies(frame(spark, rows), rare=rare).collect()), key=str)
    assert got == brute(rows)


def test_near_empty(spark):
    assert jaccard.near_copies(frame(spark, [])).count() == 0
    assert sorted(tuple(r) for r in jaccard.near_copies(frame(spark, [(1, None), (2, "")])).collect()) == [(1, 0, 1), (2, 0, 2)]


def test_index_keeps_links():
    """Two linked sets share a key, whatever the frequencies are."""
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(3, 900))
        universe = rng.permutation(5000).astype(np.int64)
        freq = dict(zip(universe.tolist(), rng.integers(2, 200, 5000).tolist(), strict=True))
        x = set(universe[:n].tolist())
        drop = rng.integers(0, max(1, n // 13) + 1)
        y = set(universe[drop : n + rng.integers(0, max(1, n // 13) + 1)].tolist())
        if 100 * len(x & y) < 85 * len(x | y):
            continue
        keys = []
        for s in (x, y):
            order = sorted(s, key=lambda t: (freq[t], t))
            keys.append(set(np.concatenate(jaccard.signatures(len(s), np.array([freq[t] for t in order]), np.array(order, np.int64))).tolist()))
        assert keys[0] & keys[1]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103), (7, 7), (50, 50)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 105: 100, 103: 100}


def passage_brute(rows, span=50):
    big = 1 << 62
    low = {}
    for d, t in rows:
        t = (t or "").encode()
        for i in range(len(t) - span + 1):
            s = t[i : i + span]
            low[s] = min(low.get(s, big), big if d is None else d)
    out = []
    for d, t in rows:
        t = (t or "").encode()
        gone = bytearray(len(t))
        for i in range(len(t) - span + 1):
            if low[t[i : i + span]] < (big if d is None else d):
                gone[i : i + span] = b"\1" * span
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_passages(spark, monkeypatch, seed):
    monkeypatch.setattr(passages, "BUCKET_BYTES", 3000)
    rng = random.Random(seed)
    letters = "abcdefgh é" if seed < 3 else "ab"
    say = lambda n: "".join(rng.choices(letters, k=n))
    shared = [say(rng.choice([49, 50, 51, 60, 90, 200])) for _ in range(12)] + ["x" * 130, "ab" * 60]
    texts = [None, "", "a", "y" * 49, "y" * 50, "y" * 300, "é" * 60, "z" * 5000]
    for _ in range(120):
        parts = [say(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            cut = rng.randint(0, 20)
            parts += [s[cut:] if rng.random() < 0.3 else s, say(rng.randint(0, 40))]
        texts.append("".join(parts))
    texts += rng.choices(texts, k=40) + [shared[9] + say(5) + shared[9]] * 2
    rng.shuffle(texts)
    rows = [(i // 2 if i % 5 == 0 else 3 * i % 211, t) for i, t in enumerate(texts)] + [(None, texts[5]), (None, shared[0] + "tail"), (None, shared[0] + "tail"), (5, texts[9]), (5, texts[9])]
    got = sorted((tuple(r) for r in passages.repeated_passages(frame(spark, rows, 4)).collect()), key=str)
    assert got == passage_brute(rows)
    assert passages.repeated_passages(frame(spark, [])).count() == 0
    assert passages.repeated_passages(frame(spark, [(1, None), (2, "q" * 80)])).count() == 2


def test_bucket_is_ordered_in_parts(spark, monkeypatch):
    """Answers of a bucket do not depend on how many of its runs are ordered together, and no more are than that."""
    rng = np.random.default_rng(3)
    schema, rows = passages.arrow_of(passages.PACKED), []
    for c in range(4):
        lead = rng.integers(0, 40, 300).astype(np.uint64) << np.uint64(32)
        digest = rng.integers(0, 3, 300).astype(np.uint64)
        rows.append((5, c, "runs", *passages._pack(lead, digest, np.arange(300, dtype=np.uint32), rng.integers(0, 90, 300))))
    table = pa.Table.from_batches([passages.batch_of(schema, *(list(c) for c in zip(*rows, strict=True)))])

    def answers():
        found = set()
        for r in passages._answer((pa.scalar(5),), table).to_pylist():
            found |= {(r["chunk"], *x) for x in zip(*(passages._unpack(r[c], k).tolist() for c, k in zip("abc", ("uint32", "int64", "uint8"), strict=True)), strict=True)}
        return found

    whole, sizes, told = answers(), [], passages._told
    monkeypatch.setattr(passages, "RUNS_AT_ONCE", 100)
    monkeypatch.setattr(passages, "_told", lambda lead, *x: (sizes.append(len(lead)), told(lead, *x))[1])
    assert answers() == whole and whole
    assert sum(sizes) == 1200 and max(sizes) < 300


def test_passages_over_many_batches(spark, monkeypatch):
    """Several Arrow batches a partition, and several chunks a batch: each chunk has a number of its own."""
    monkeypatch.setattr(passages, "BUCKET_BYTES", 3000)
    monkeypatch.setattr(passages, "BATCH_BYTES", 1200)
    rng = random.Random(7)
    say = lambda n: "".join(rng.choices("abcdefgh", k=n))
    shared = [say(rng.choice([50, 60, 90, 200])) for _ in range(8)]
    texts = [say(rng.randint(0, 60)) + rng.choice(shared) + say(rng.randint(0, 60)) for _ in range(90)]
    rows = list(enumerate(texts + rng.choices(texts, k=20)))
    rng.shuffle(rows)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        got = sorted((tuple(r) for r in passages.repeated_passages(frame(spark, rows, 3)).collect()), key=str)
    finally:
        spark.conf.set(name, before)
    assert got == passage_brute(rows)


def test_runs_of_one_anchor_are_told_apart(spark, monkeypatch):
    """Runs that share anchor and the middle of the digest, but not the rest, are different runs."""
    from credalis.llm.frames import arrow_of

    original = passages.runs_of

    def weak(*args):
        return replace(r := original(*args), digest=r.digest & ~np.uint64(0xFFFFFFFF << 24))

    monkeypatch.setattr(passages, "runs_of", weak)
    rng = random.Random(11)
    say = lambda n: "".join(rng.choices("abcdefgh", k=n))
    gram = say(24)
    texts = [say(30) + gram + say(30) for _ in range(40)]
    schema = arrow_of(passages.PACKED)
    batch = pa.record_batch([pa.array(range(40), pa.int64()), pa.array(texts), pa.array(range(40), pa.int64()), pa.array(range(40), pa.int64())], ["id", "t", "key", "key2"])
    sent = pa.Table.from_batches(list(passages._send(1, schema)(iter([batch]))))
    runs = sent.filter(pc.equal(sent["kind"], "runs"))
    told = passages._answer((pa.scalar(0, pa.int32()),), runs).to_pylist()
    strings = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - 49):
            strings.setdefault(t[i : i + 50], d)
    assert len(strings) == sum(len(t) - 49 for t in texts)  # no string occurs twice, so no run may be taken
    for r in told:
        own, least = passages._unpack(r["a"], "uint32"), passages._unpack(r["b"], "int64")
        lead = original(*stream_and_hashes(texts))
        assert (least == lead.doc[own]).all()


def test_strings_of_one_digest_are_ordered(monkeypatch):
    """Classes come from the suffix order where digests agree, in one array or dealt by anchor."""
    rng = random.Random(3)
    piece = "".join(rng.choices("ab", k=90))
    texts = [("".join(rng.choices("ab", k=rng.randint(0, 40))) + piece + "".join(rng.choices("ab", k=30))).encode() for _ in range(12)]
    stream, starts = stream_of(texts)
    begin = np.concatenate([np.arange(starts[d], starts[d] + len(t) - 49) for d, t in enumerate(texts)])
    strings = [stream[b : b + 50].tobytes() for b in begin]
    anchor = np.array([hash(s) % 5 for s in strings], np.uint64) << np.uint64(7)
    for limit in (1 << 19, 300):
        monkeypatch.setattr(passages, "SORT_BYTES", limit)
        for digest in (np.zeros(len(begin), np.uint64), passages.digests(stream, begin)[0]):
            kind = passages.equal_strings(stream, begin, anchor, digest)
            assert len(set(kind.tolist())) == len(set(strings)) == len(set(zip(kind.tolist(), strings, strict=True)))


def stream_and_hashes(texts):
    stream, starts = stream_of([t.encode() for t in texts])
    return stream, starts, passages.Hashes.of(stream)


def test_suffix_array():
    rng = random.Random(4)
    for _ in range(500):
        s = [rng.randint(1, rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 60))] + [0]
        assert suffixes.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:])  # noqa: B023


@pytest.mark.parametrize("hot", [0, 1])
def test_neighbouring_strings_travel_as_text(hot):
    """Open strings of two batches meet in buckets, at a few bytes each unless their anchors have very many surroundings."""
    rng = random.Random(5)
    say = lambda n: "".join(rng.choices("abcdefgh é", k=n))
    shared = [say(rng.choice([50, 60, 90, 200])) for _ in range(8)]
    rows = [(i, say(rng.randint(0, 400)) + rng.choice(shared) + say(rng.randint(0, 400))) for i in range(80)]
    rows += [(None, shared[0] + "tail"), (90, "é" * 60), (91, "x" * 49)]
    rng.shuffle(rows)
    cover = passages.COVER.replace("ID", "long")
    batches = []
    for part in (rows[:40], rows[40:]):
        opens = []
        for _, t in part:
            stream, starts = stream_of([t.encode()])
            n = len(passages.batch_runs(stream, starts)[0].doc)
            opens += passages._pack((2 * np.arange(n) + hot).astype(np.uint32)) if n else [None]
        batches.append(pa.record_batch([pa.array(c, k) for c, k in zip([*zip(*part, strict=True), [False] * len(part), [None] * len(part), opens], (pa.int64(), pa.string(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], ["id", "t", "whole", "taken", "open"]))
    covered = pa.Table.from_batches(list(passages._cover(3, passages.arrow_of(cover))(iter(batches))))
    names = ["id", "chunk", "kind", "t", "a", "b", "c"]
    classes = covered.filter(pc.is_in(covered["kind"], pa.array(["class", "piece"]))).select(["bucket", *names])
    size = sum(len(x) for c in "abc" for x in classes[c].to_pylist())
    strings = sum(len(passages._unpack(x, "int64")) for x in classes["b"].to_pylist())
    assert strings > 20000 and set(classes["kind"].to_pylist()) == {("piece", "class")[hot]} and (size < 5 * strings) != hot
    told = [passages._merge((pa.scalar(b),), classes.filter(pc.equal(classes["bucket"], b))) for b in range(3)]
    left = pa.concat_tables([covered.filter(pc.equal(covered["kind"], "text")).select(names), *told])
    finish = passages._finish(passages.arrow_of(f"id long, {passages.RESULT}"))
    done = covered.filter(pc.equal(covered["kind"], "done")).select(["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    parts = [done, *(finish((), left.filter(pc.equal(left["chunk"], c))) for c in set(left["chunk"].to_pylist()))]
    got = sorted((tuple(r.values()) for p in parts for r in p.to_pylist()), key=str)
    assert got == passage_brute(rows) and len(told) == 3


def test_anchors_in_many_surroundings_are_told(monkeypatch):
    lead = np.array([1, 1, 2, 2, 2, 3], np.uint64) << np.uint64(32)
    args = lead, np.array([1, 2, 1, 2, 3, 1], np.uint64), np.arange(6, dtype=np.uint32), np.zeros(6, np.int64), np.zeros(6, np.int32)
    monkeypatch.setattr(passages, "HOT", 2)
    own, _, kinds, _ = passages._told(*args)
    assert dict(zip(own.tolist(), kinds.tolist(), strict=True)) == {0: 1, 1: 1, 2: 2, 3: 2, 4: 2}
