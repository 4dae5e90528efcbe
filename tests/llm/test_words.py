"""Benchmark passages and word pieces against brute force."""

import gc
import hashlib
import random
import re

import pytest

from credalis.llm import catalog, decontaminate, pieces, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, item_id int, runs string, items int, i int, t string"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(text, items):
    words = WORD.findall(low(text))
    hit, found = set(), set()
    for item, t in items:
        w = WORD.findall(low(t))
        for k in range(max(len(w) - 9, min(len(w), 1))):
            p = w[k : k + 10]
            for i in range(len(words) - len(p) + 1):
                if words[i : i + len(p)] == p:
                    hit |= set(range(i, i + len(p)))
                    found |= {str(item)} - {"None"}
    ids = ",".join(sorted(found))
    return len(words), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("part_bytes", [1 << 20, 200])
def test_contamination(spark, part_bytes):
    rng = random.Random(5)
    vocabulary = ["a", "b", "c", "é", "x1", "long" * 9]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(2, say(30)), (10, say(12)), (11, say(10)), (2, say(11)), (None, say(10)), (7, "Tail. OF, nine! words; that; ends; here"), (8, None), (9, "..."), (12, "unique"), (13, "two words"), (14, "b a " * 5)]
    texts = [None, "", "...", "unique", "ununique", "TWO--words two words", "b a " * 300, items[0][1], "x " + items[1][1].upper() + " y", "z " * 5000 + items[2][1], items[0][1] * 3, "tail of nine words that ends here", "tail of nine words that ends"]
    texts += [say(600) for _ in range(20)] + [say(40) + " " + rng.choice(items[:5])[1] + " " + say(40) for _ in range(20)] + [items[4][1]]
    docs = spark.createDataFrame([(i % 50, t, 1, "r", 2, 3, "t") for i, t in enumerate(texts)], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, bench, part_bytes=part_bytes).collect()
    assert sorted(tuple(r) for r in got) == sorted((i % 50, *brute(t, items)) for i, t in enumerate(texts))
    kept = decontaminate.benchmark_hits(docs, bench, keep=True)
    assert kept.select("row.*").columns == docs.columns and kept.count() == len(texts)
    assert not any(r.contaminated for r in decontaminate.contamination(docs, bench.limit(0)).collect())
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def greedy(word, initial, inner):
    n, at = 0, 0
    while at < len(word):
        have = inner if at else initial
        end = next((e for e in range(len(word), at, -1) if word[at:e] in have), None)
        if end is None:
            return -1
        n, at = n + 1, end
    return n


def test_piece_automaton():
    rng = random.Random(3)
    for _ in range(60):
        letters = b"ab" if rng.random() < 0.5 else b"abc\xc3"
        make = lambda n: {bytes(rng.choices(letters, k=rng.randint(1, 5))) for _ in range(n)}  # noqa: B023, E731
        initial, inner = make(rng.randint(1, 12)), make(rng.randint(1, 12))
        words = [bytes(rng.choices(letters, k=rng.randint(1, 14))) for _ in range(80)] + [b"a" * 400]
        got = pieces.piece_trie(initial, inner).counts(words).tolist()
        assert got == [greedy(w, initial, inner) for w in words]


def test_piece_counts(spark):
    initial, inner = pieces.spaced_vocabulary(catalog.VOCABULARY)
    a, b = set(initial), set(inner)
    texts = [None, "", "  \n", "The quick brown fox", "naïve straße 漢字 " * 50, "x" * 3000, "unbelievable\tinternationalisation, 12345!"] * 2
    df = spark.createDataFrame([(i, t, 1, "r", 2, 3, "t") for i, t in enumerate(texts)], SCHEMA)
    for r in pieces.piece_counts(df, pieces.piece_trie(initial, inner), b" ").collect():
        words = (texts[r.doc_id] or "").encode().split()
        assert (r.n_words, r.n_unknown) == (len(words), 0)
        assert r.n_pieces == sum(greedy(b" " + w, a, b) for w in words)
    unknown = pieces.piece_counts(df, pieces.piece_trie([b"The"], [b"x"])).where("doc_id = 3").first()
    assert (unknown.n_pieces, unknown.n_unknown) == (4, 3)
    assert pieces.piece_counts(df.limit(0), pieces.piece_trie([], [])).count() == 0


def test_words_leave_no_cycle():
    """What a batch of words took is free with its last reference, not when Python next looks for cycles."""
    texts = [b"some words of a text", b"words of another"]
    gc.collect()
    gc.disable()
    try:
        words.words_of(texts)
        assert gc.collect() == 0
    finally:
        gc.enable()
