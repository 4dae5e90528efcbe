"""Queries of this subpackage: name -> callable(spark, sf_dir), and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from credalis.llm import decontaminate, jaccard, mixing, naming, passages, pieces, resampling, secret_scan, sharding, token_files, toxicity, urls, whitening
from credalis.llm.frames import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.exact_copies(table(spark, sf_dir, "documents"))


ORACLES["op1_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW g AS (PARTITION BY t)"""


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_copies(table(spark, sf_dir, "documents"))


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_spans(table(spark, sf_dir, "documents"))


# The rules of the URL filter.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.url_verdicts(table(spark, sf_dir, "pages"), rules)


ORACLES["op6_url_filter"] = f"""
WITH rules(h, p, v) AS (VALUES {', '.join(str(r) for r in URL_RULES)}),
parts AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
best AS (SELECT host, path, (SELECT max({{'n': length(h || p), 'r': h || p, 'v': v}}) FROM rules WHERE (host = h OR suffix(host, '.' || h)) AND prefix(path, p)) AS b
  FROM (SELECT DISTINCT host, path FROM parts))
SELECT page_id, host, path, b.r AS rule, coalesce(b.v, 'allow') AS verdict FROM parts JOIN best USING (host, path)"""


VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    trie = pieces.piece_trie(*pieces.spaced_vocabulary(VOCABULARY))
    return pieces.piece_counts(table(spark, sf_dir, "documents"), trie, b" ")


# Wanted shares of tokens by (quality, toxic).
SHARES = {(0, 0): 0.25, (0, 1): 0.01, (1, 0): 0.72, (1, 1): 0.02}


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mixing_rates(docs, mixing.domain_labels(table(spark, sf_dir, "labels"), list(SHARES)), list(SHARES.values()))


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


@query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# The checksum of a word runs byte by byte over a table made by eight shifts; each distinct word once.
ORACLES["op11_importance_resampling"] = r"""
WITH RECURSIVE bits(b, k, v) AS (SELECT b, 0, b FROM range(256) t(b)
  UNION ALL SELECT b, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM bits WHERE k < 8),
step AS (SELECT list(v ORDER BY b) AS s FROM bits WHERE k = 8),
texts AS (SELECT row_number() OVER () AS r, doc_id, 0 AS side, text FROM documents UNION ALL SELECT NULL, NULL, 1, text FROM benchmark),
found AS (SELECT r, doc_id, side, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts),
each AS (SELECT r, side, unnest(words) AS w FROM found),
crc AS (SELECT w, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(w), '..'), lambda h : ('0x' || h)::BIGINT)),
    lambda c, b : xor(c // 256, s[(xor(c, b) % 256) + 1]))) % 10000 AS bucket FROM (SELECT DISTINCT w FROM each), step),
counted AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM each JOIN crc USING (w) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (SELECT sum(s) + 10000 FROM counted)::DOUBLE) / ((s + 1)::DOUBLE * (SELECT sum(t) + 10000 FROM counted)::DOUBLE)))::BIGINT AS g FROM counted),
weights AS (SELECT r, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM each JOIN crc USING (w) JOIN gain USING (bucket) WHERE side = 0 GROUP BY r),
scored AS (SELECT r, doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM found LEFT JOIN weights USING (r) WHERE side = 0),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) OVER () * 10 // 100 AS drawn FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM scored LEFT JOIN placed USING (r)"""

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@query
def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, TOKENIZER)
    return token_files.token_digests(token_files.read_tokens(spark, path))


@query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))
