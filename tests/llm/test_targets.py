"""Importance resampling, token files and whitening against brute force."""

import math
import random
import re
import struct
import zlib
from collections import Counter
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import orc
from tokenizers import Tokenizer

from credalis.llm import catalog, crc, resampling, token_files, whitening

SCHEMA = "doc_id long, text string, i int, score string, rank int, part string, first int, ids int, start string, weight int, bucket int, n int"


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, 1, "s", 2, "p", 3, 4, "x", 5, 6, 7) for i, t in rows], SCHEMA).repartition(parts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=300), max_size=12), st.integers(0, 3000))
def test_crc_spans(texts, long_one):
    texts = [*texts, b"\x00" * long_one, bytes(range(256)) * (long_one // 200)]
    stream = np.frombuffer(b"".join(texts) + b"!", np.uint8)
    size = np.array([len(t) for t in texts])
    begin = np.cumsum(size) - size
    got = crc.span_crc32(stream, np.append(begin, 0), np.append(size, len(stream)))
    assert got.tolist() == [zlib.crc32(t) for t in texts] + [zlib.crc32(stream.tobytes())]


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))


def draw(rows, target, lo, hi, buckets, least, percent):
    def runs(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(lo, hi + 1) for k in range(len(w) - n + 1)]

    s, t = (Counter(b for x in side for b in runs(x)) for side in ([x for _, x in rows], target))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for d, text in rows:
        g = [gain[b] for b in runs(text)]
        h = int(sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(g) // len(g) if g else 0
        out.append((d, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text))))
    order = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = order[: len(order) * percent // 100]
    rest = Counter(r[:4] for r in out)
    rest.subtract(Counter(r[:4] for r in drawn))
    return Counter([(*r[:4], k + 1) for k, r in enumerate(drawn)] + [(*r, None) for r in rest.elements()])


@pytest.mark.parametrize("lo,hi,block", [(1, 1, 1 << 16), (1, 2, 7), (2, 3, 1)])
def test_resampling(spark, monkeypatch, lo, hi, block):
    monkeypatch.setattr(resampling, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(resampling, "BLOCK_ROWS", block)
    rng = random.Random(lo + hi)
    known = ["a", "É", "x1", "w" * 70, "z" * 200, "tail", "HEAD"]
    say = lambda n: "".join(rng.choice(known) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    rows = [(i, say(rng.randint(0, 60))) for i in range(120)] + [(200, None), (201, ""), (202, "..."), (None, say(40)), (None, say(40)), (203, "q" * 300_000), (204, "ab " * 50_000)]
    rows += [(300, say(30))] * 45 + [(301, t) for _, t in rows[:30]]
    target = [say(20) + " tail tail" for _ in range(8)] + [None, ""]
    docs, wanted = frame(spark, rows), frame(spark, list(enumerate(target)))
    got = resampling.resampled(docs, wanted, low=lo, high=hi, buckets=50, percent=40)
    assert Counter(map(tuple, got.select("doc_id", "n_features", "weight", "score", "rank").collect())) == draw(rows, target, lo, hi, 50, 20, 40)


def test_resampling_empty(spark):
    none, some = frame(spark, []), frame(spark, [(1, "a b c " * 9), (2, None)])
    assert resampling.resampled(none, some).count() == 0
    got = {r.doc_id: r for r in resampling.resampled(some, none, percent=100).collect()}
    assert got[1].rank == 1 and got[2].rank is None and got[2].weight == 0
    assert {r.rank for r in resampling.resampled(some, none, percent=0).collect()} == {None}


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(catalog.TOKENIZER)


@pytest.fixture(scope="module")
def encoder():
    with open(catalog.TOKENIZER, encoding="utf-8") as f:
        return token_files.Encoder(f.read())


PIECES = ["H", "̱", "«", "»", "'", "(", "'s", "Été", ",", "word", "Wörter", "Don't", "éclair", "́x", "I'LL", "<|endoftext|>", "a<|startoftext|>b", "1234", "日本語", " ", " ", "\x0b", "\x1c", "\x85", "İ", "ΣΑΣ", "🙂", "ﬁ", "!?", "\x00"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(PIECES) | st.text(max_size=6), st.sampled_from(["", " ", "  ", "\n", "\t\r", "\x0c"])), max_size=20))
def test_parts_alone_give_the_same_ids(tokenizer, encoder, parts):
    text = "".join(a + b for a, b in parts)
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    ids, sizes = encoder.ids([text.encode(), b"", text.encode()])
    want = tokenizer.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want * 2 and sizes.tolist() == [len(want), 0, len(want)]


def token_rows():
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(PIECES) + "".join(rng.choices("abcdef", k=rng.randint(1, 7))) for _ in range(n))
    rows = [(rng.randrange(10**6), say(rng.randint(0, 80))) for _ in range(300)]
    rows += [(5, None), (6, ""), (7, " "), (-3, say(5)), (None, say(4)), (None, None), (8, "long " * 70_000), (9, "x" * 120_000)]
    return rows + [(77, "same text")] * 60 + [(77, f"other {k}") for k in range(20)]


@pytest.mark.parametrize("part_bytes,known", [(1 << 26, 1 << 24), (20_000, 2000)])
def test_token_files(spark, monkeypatch, tmp_path, tokenizer, part_bytes, known):
    monkeypatch.setattr(token_files, "KNOWN_BYTES", known)
    monkeypatch.setattr(token_files, "CHUNK_BYTES", 9000)
    rows = token_rows()
    path = f"{tmp_path}/out"
    token_files.write_tokens(frame(spark, rows), path, catalog.TOKENIZER, part_bytes=part_bytes)
    got = sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is None, d or 0))
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids[-1] == 1
        at += r.n_tokens
    have = Counter((r.doc_id, tuple(r.ids[:-1])) for r in got)
    assert have == Counter((d, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids)) for d, t in rows)
    digests = token_files.token_digests(token_files.read_tokens(spark, path)).collect()
    want = sorted((r.doc_id or 0, r.start, r.n_tokens, zlib.crc32(struct.pack(f"<{len(r.ids)}I", *r.ids))) for r in got)
    assert sorted((r.doc_id or 0, *r[1:]) for r in digests) == want


def test_stripes_and_pruning(spark, monkeypatch, tmp_path):
    monkeypatch.setitem(token_files.WRITE, "orc.stripe.size", "65536")
    monkeypatch.setitem(token_files.WRITE, "orc.row.index.stride", "1000")
    rng = random.Random(4)
    rows = [(3 * k, " ".join("".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(25))) for k in range(12_000)]
    path = f"{tmp_path}/out"
    token_files.write_tokens(frame(spark, rows), path, catalog.TOKENIZER)
    files = sorted((tmp_path / "out" / "tokens").glob("*.orc"))
    f = orc.ORCFile(files[0])
    assert len(files) == 1 and f.nstripes > 2 and f.row_index_stride == 1000
    assert sum(f.read_stripe(k).num_rows for k in range(f.nstripes)) == len(rows)
    # ids below 2**16 take 17 bits in a run of integers, uncompressed
    n = sum(r.n_tokens for r in token_files.read_tokens(spark, path).collect())
    assert files[0].stat().st_size < 2.3 * n + 20 * len(rows)

    def scanned(ids):
        df = spark.read.orc(f"{path}/tokens").where(f"doc_id in ({','.join(map(str, ids))})")
        n = df.count()
        assert re.search(r"PushedFilters: .*doc_id", df._jdf.queryExecution().toString())
        return n

    assert scanned([300, 30_003]) == 2 and scanned([301, 30_004]) == 0
    # row groups that neither range nor Bloom filter allows are not read
    read = lambda where: pa.table(orc_rows(spark, f"{path}/tokens", where)).num_rows
    assert read("doc_id = 301") < len(rows) / 4 and read("doc_id = 300") < len(rows) / 4 < read("doc_id >= 0")


def orc_rows(spark, path, where):
    """Rows that the scan hands on before the filter is applied row by row."""
    df = spark.read.orc(path).where(where)
    df = df.select("doc_id")
    df._jdf.queryExecution().executedPlan()
    df.collect()

    def scans(plan):
        name = plan.nodeName()
        if name.startswith("Scan"):
            yield plan
        for k in range(plan.children().size()):
            yield from scans(plan.children().apply(k))
        if name == "AdaptiveSparkPlan":
            yield from scans(plan.executedPlan())

    plan = df._jdf.queryExecution().executedPlan()
    total = sum(s.metrics().get("numOutputRows").get().value() for s in scans(plan))
    return {"n": list(range(total))}


def test_token_files_empty(spark, tmp_path):
    token_files.write_tokens(frame(spark, []), f"{tmp_path}/out", catalog.TOKENIZER)
    assert token_files.token_digests(token_files.read_tokens(spark, f"{tmp_path}/out")).count() == 0


VECTORS = "vec_id long, embedding array<float>, i string, v int, n string, component int"


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "s", 1, "n", 2) for i, v in rows], VECTORS).repartition(4)


def whole(v):
    return [math.floor(1024 * float(np.float32(x))) + 100_000 for x in v]


def check_whitening(spark, rows, components=8):
    ok = [(i, whole(v)) for i, v in rows]
    n, d = len(ok), len(ok[0][1])
    sums = [sum(x[k] for _, x in ok) for k in range(d)]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)] for _, x in ok])
    cov = centred.T @ centred / n
    value = np.sort(np.linalg.eigvalsh(cov))[::-1][:components]
    got = whitening.whitened(vector_frame(spark, rows), components=components).collect()
    assert len(got) == n * min(d, components)
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    deviation = Counter((i, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))) for i, x in ok)
    for c, rs in by.items():
        assert Counter((r.vec_id, r.deviation) for r in rs) == Counter({(i, f if f < 1 << 63 else None): m for (i, f), m in deviation.items()})
        assert {r.n for r in rs} == {n} and all(abs(r.explained - value[c - 1] / np.trace(cov)) <= 1e-9 for r in rs)
    live = [c for c in sorted(by) if by[c][0].whitened is not None]
    ids = [i for i, _ in ok]
    if len(set(ids)) == n and live:
        at = {i: k for k, i in enumerate(ids)}
        w = np.zeros((n, len(live)))
        for j, c in enumerate(live):
            for r in by[c]:
                w[at[r.vec_id], j] = r.whitened
        own = w.T @ w / n
        assert np.abs(own - np.eye(len(live))).max() < 1e-9 and got[0].identity_error < 1e-9
        axis = centred.T @ w / n  # sqrt(e) times each component
        assert np.allclose(cov @ axis, axis * value[[c - 1 for c in live]], rtol=1e-9, atol=1e-9 * value[0])
    return got


def test_whitening(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(700, 12)) @ np.diag([3, 3, 3, 2, 1.5, 1, 1, 1, 0.5, 0.2, 0.1, 0.05])
    check_whitening(spark, list(enumerate(base.astype(np.float32).tolist())))
    check_whitening(spark, list(enumerate((base * 1e5).astype(np.float32).tolist())))  # deviations beyond a long
    turned = rng.permutation(np.concatenate([np.eye(6), -np.eye(6)] * 20))  # one eigenvalue, six times
    check_whitening(spark, list(enumerate(turned.tolist())))


def test_whitening_edges(spark):
    rng = np.random.default_rng(2)
    good = [(i, rng.normal(size=5).astype(np.float32).tolist()) for i in range(40)]
    bad = [(100, None), (101, [1.0, None, 2, 3, 4]), (102, [float("nan")] * 5), (103, [float("inf"), 1, 1, 1, 1]), (104, []), (105, [1.0, 2.0]), (106, [0.0] * 7)]
    rows = good + [(0, good[0][1]), (None, good[1][1])]
    got = whitening.whitened(vector_frame(spark, rows + bad)).collect()
    assert {r.n for r in got} == {42} and len(got) == 42 * 5 and {r.vec_id for r in got} == {i for i, _ in rows}
    near = lambda rs: sorted((str(r.vec_id), r.component, r.deviation, f"{r.whitened:.9g}") for r in rs)
    assert near(check_whitening(spark, rows)) == near(got)
    few = check_whitening(spark, good[:3])  # two directions only
    assert {r.component for r in few if r.whitened is not None} == {1, 2}
    one = whitening.whitened(vector_frame(spark, good[:1])).collect()
    assert len(one) == 5 and all(r.whitened is None and r.deviation == 0 and r.identity_error == 0 for r in one)
    huge = whitening.whitened(vector_frame(spark, [(1, [3e38, 1]), (2, [-3e38, 2]), (3, [0, 3])])).collect()
    assert len(huge) == 6 and all((r.deviation is None) == (r.vec_id != 3) for r in huge)
    assert whitening.whitened(vector_frame(spark, [])).count() == whitening.whitened(vector_frame(spark, bad[:5])).count() == 0


@pytest.mark.parametrize("values", [[5, 3, 1, 0.1], [1, 1 - 1e-9, 1 - 2e-9, 0.5], [2, 2, 2, 1, 1, 1e-6], [1, 1 - 1e-13, 0.5, 0.5 - 1e-10], [0, 0, 0]])
def test_refined_eigen(values):
    d = len(values)
    rng = np.random.default_rng(d)
    q = np.linalg.qr(rng.normal(size=(d, d)))[0].astype(np.longdouble)
    q = q + q @ (np.eye(d) - q.T @ q) / 2  # orthogonal beyond a double
    a = ((q * np.array(values, np.longdouble)) @ q.T).astype(np.float64)
    a = (a + a.T) / 2
    value, x = whitening.refined_eigen(a)
    assert np.allclose(value, sorted(values, reverse=True), atol=1e-15 * max(1, max(values)))
    assert np.abs(x.T @ x - np.eye(d)).max() < 5e-16
    assert np.abs(a @ x - x * value).max() <= 5e-16 * max(values, default=0)


def test_a_letter_that_gets_a_mark_is_not_cut(tokenizer, encoder):
    """Lower-cased, U+0130 is a letter and a mark, which goes with the signs that follow."""
    for text in ("İ'", "İ! aİ?b", "Xİ'sİ"):
        assert encoder.ids([text.encode()])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
