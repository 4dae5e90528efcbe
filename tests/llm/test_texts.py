"""Copies, secrets, URL rules and shards against brute force on small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from credalis.llm import automata, naming, secret_scan, sharding, urls

SCHEMA = "doc_id long, text string, chunk int, name string, block string, shard int, rule string, i int"
EDGES = [None, "", " ", "a", "A", "ab" * 3000, "ab" * 3000 + "c", "É" * 700, "é" * 700, "x" * 1024, "x" * 1025, "x" * 2048, "y" * 5000 + "z", "Z" + "y" * 5000]


@pytest.fixture(scope="module")
def docs(spark):
    texts = [*EDGES, *EDGES[::2], *["hot copy"] * 200, *[f"own {i}" for i in range(40)]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "A"), (None, "a"), (None, "only null")]
    return spark.createDataFrame([(i, t, 1, "n", "b", 2, "r", 3) for i, t in rows], SCHEMA).repartition(7)


@pytest.mark.parametrize("block", [1, 16, 1024])
def test_copies(docs, block):
    rows = docs.collect()
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[low(r.text)].append(r.doc_id)
    small = docs if block > 1 else docs.where("text is null or length(text) < 30")
    texts = {k: v for k, v in groups.items() if block > 1 or len(k) < 30}
    got = naming.exact_copies(small, block_bytes=block).collect()
    want = Counter((d, max(x for x in [*v, -1] if x is not None), len(v), hashlib.sha256(k.encode()).hexdigest()) for k, v in texts.items() for d in v)
    assert Counter((r.doc_id, -1 if r.keep_id is None else r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(texts) and all(r.doc_id == r.keep_id for r in kept)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert naming.exact_copies(none).count() == secret_scan.secret_spans(none).count() == sharding.shards(none).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert urls.url_verdicts(pages, rules).count() == 0
    one = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert urls.url_verdicts(one, rules).first().verdict == "allow"


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
TEXTS = [
    "password = hunter22 and secret:'x' token==abc api_key=\"abcdef\" APIKEY: a.b-c_d", "pässword password: token=abcdef token=1234567", "é token : é token: zzzzzz", None, "",
    "AKIA" + "A1" * 8 + " AKAKIA" + "B" * 16 + " AKIA" + "C" * 15, "xx" + "0a" * 12 + "g" + "f" * 23 + " " + "e" * 1000, "secret" * 300 + "=abcdefg", "d" * 5000, "a" * 1023 + "password=" + "q" * 3000,
    "-----BEGIN RSA PRIVATE KEY----- gh" + "p_" + "a" * 36, "token=\nabcdef token= \"abcdefg 'secret'='abcdef'", "PassWord:abcdefK", "ſecret=abcdefg",
]


def base_spans(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_secrets(spark):
    df = spark.createDataFrame([(i, t, 1, "", "", 1, "", 1) for i, t in enumerate(TEXTS)], SCHEMA)
    for r in secret_scan.secret_spans(df).collect():
        want = base_spans(TEXTS[r.doc_id] or "")
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{b}:{e}" for b, k, e in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest(), (r, text)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in want) for j in range(3)]
        assert set(text.split(",")) - {""} <= set(r.spans.split(","))
    assert "pem:0:31" in secret_scan.secret_spans(df).where("doc_id = 10").first().spans


def test_pattern_limits():
    for bad in ("a*", "ab(cd)?e*f?g|abc", "(abcd|b)"):
        with pytest.raises(ValueError):
            automata.compile_rules([(bad, False)])


def url_brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[2:] if fit else (None, "allow"))


def test_urls(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("a.com", "", "block"), ("b.a.com", "/", "allow")]
    given = [None, "", "x", "http://", "HTTP://WWW.Example.ORG/en/12?x#y", "http://example.org", "http://example.org?q=/es/", "http://example.org/es/\n1", "ftp://aexample.org/es/", "//example.org/es/", "http://x.com/de/://org/", "http://a.com", "http://b.a.com/", "http://q.b.a.com?", "http://.com/fr/", "http://org./", "http://İ.org/", "a" * 5000 + "://com/fr/" + "z" * 5000]
    df = spark.createDataFrame([(i // 2, u, "h", "r", 1) for i, u in enumerate([*given, *given, *["http://hot.org/en"] * 300])], "page_id long, url string, host string, rule string, n int")
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.url_verdicts(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect())
    assert got == Counter((r.page_id, *url_brute(r.url, rules)) for r in df.collect())


def test_shards(docs):
    got = sharding.shards(docs).collect()
    assert len(got) == docs.count()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 8)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(len(s) == 1 for s in _by(got, "doc_id", "shard").values())


def _by(rows, key, value):
    out = defaultdict(set)
    for r in rows:
        out[r[key]].add(r[value])
    return out


def test_shard_weights(spark):
    ids = spark.range(20000).selectExpr("id AS doc_id", "'' AS text")
    n = Counter(r.shard for r in sharding.shards(ids, weights=(1, 2, 5)).collect())
    assert abs(n[0] / 20000 - 1 / 8) < 0.02 and abs(n[2] / 20000 - 5 / 8) < 0.02
    moved = sharding.shards(ids).where("grown_shard <> shard").count()
    assert abs(moved / 20000 - 1 / 9) < 0.02
