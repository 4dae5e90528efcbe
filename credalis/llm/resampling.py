"""Importance resampling to a target distribution, over hashed runs of words.

Words are runs of ASCII letters and digits and of all other characters beyond ASCII, with
A-Z lower-cased. Features are the runs of ``low`` to ``high`` consecutive words joined by one
space, as often as they occur; their CRC-32 modulo ``buckets`` is their bucket. The gain of a
bucket is the floored log ratio, in thousandths, of its smoothed shares in the target and in
the documents. A document weighs the floored mean of its features' gains; with Gumbel noise
from its id the highest scores are a draw without replacement in proportion to exp(weight).

Counting leaves one row for each task and bucket, and the gains are one short list. Scores
are whole thousandths between about -100,000 and 120,000, so their counts are a bounded table
as well: it gives the least score that is drawn and how many rows stand before each score.
Only drawn rows are sorted, score by score.

Null or empty text has no features and weight 0. Ties go to the smaller id, a null id last;
rows alike in id and figures are counted first and then numbered in blocks, in any order. A
null id draws its noise as an empty one. Without documents the result is empty; without a
target every bucket is equally likely there. Texts of any length are read whole. Other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credalis.llm.crc import span_crc32
from credalis.llm.frames import arrow_of, batch_of, id_type, stored, text_chunks
from credalis.llm.lanes import BREAK, stream_of
from credalis.llm.words import ALPHANUMERIC

BUCKETS = 10_000
LOW, HIGH = 1, 1
CHUNK_BYTES = 1 << 21
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
BLOCK_ROWS = 1 << 16
"""Rows alike that are numbered together."""


@dataclass(frozen=True)
class Spans:
    """Words of texts in one stream with one space between words; ``first`` is each text's first word, with the end of all."""

    stream: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Spans:
        stream, starts = stream_of([b" ".join(t.translate(ALPHANUMERIC).split()) for t in texts])
        end = np.flatnonzero((stream == 32) | (stream == BREAK))
        begin = np.append(0, end[:-1] + 1)
        some = end > begin
        begin, end = begin[some], end[some]
        return cls(stream, begin, end, np.searchsorted(begin, starts))

    @property
    def words(self) -> np.ndarray:
        return np.diff(self.first)

    def buckets(self, low: int, high: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length: the buckets of all features in order, and the first feature of each text with the end of all."""
        for n in range(low, high + 1):
            counts = np.maximum(self.words - n + 1, 0)
            cut = np.append(0, np.cumsum(counts))
            at = np.arange(cut[-1]) + np.repeat(self.first[:-1] - cut[:-1], counts)
            yield span_crc32(self.stream, self.begin[at], self.end[at + n - 1] - self.begin[at]) % np.uint32(buckets), cut


def _count(low: int, high: int, buckets: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, _, texts in text_chunks(batches, CHUNK_BYTES):
            for bucket, _ in Spans.of(texts).buckets(low, high, buckets):
                total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield batch_of(schema, some, total[some])

    return run


def bucket_counts(docs: DataFrame, text_col: str = "text", low: int = LOW, high: int = HIGH, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts in each bucket that has any."""
    ddl = "bucket int, n long"
    rows = docs.select(F.lit(0).alias("i"), F.col(text_col).alias("t"))
    return rows.mapInArrow(_count(low, high, buckets, arrow_of(ddl)), ddl).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored 1000 * ln of the ratio of smoothed shares, target to source, for each bucket."""
    k = len(source)
    s_all, t_all = float(source.sum()) + k, float(target.sum()) + k
    return np.array([math.floor(1000 * math.log((float(t) + 1) * s_all / ((float(s) + 1) * t_all))) for s, t in zip(source, target, strict=True)], np.int64)


def fit(docs: DataFrame, target: DataFrame, text_col: str = "text", low: int = LOW, high: int = HIGH, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket; one row a bucket and side reaches the driver."""
    sides = [bucket_counts(df, text_col, low, high, buckets).withColumn("side", F.lit(k)) for k, df in enumerate((docs, target))]
    found = sides[0].unionByName(sides[1]).toArrow()
    counts = np.zeros((2, buckets), np.int64)
    counts[found.column("side").to_numpy(), found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return gains(*counts)


def _weigh(held: Broadcast, low: int, high: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value
        for _, ids, texts in text_chunks(batches, CHUNK_BYTES):
            count, total = np.zeros((2, len(texts)), np.int64)
            spans = Spans.of(texts)
            for bucket, cut in spans.buckets(low, high, len(gain)):
                sums = np.append(0, np.cumsum(gain[bucket]))
                count += np.diff(cut)
                total += sums[cut[1:]] - sums[cut[:-1]]
            yield batch_of(schema, ids, spans.words, count, total // np.maximum(count, 1))

    return run


def noise(id_col: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, floored, from the seed and the id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", low: int = LOW, high: int = HIGH, seed: int = SEED) -> DataFrame:
    """(i, n_words, n_features, weight, score) of each row."""
    ddl = f"i {id_type(docs, id_col)}, n_words long, n_features long, weight long"
    held = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(_weigh(held, low, high, arrow_of(ddl)), ddl)
    return rows.withColumn("score", F.col("weight") + noise(F.col("i"), seed))


def ranked(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """(i, n_features, weight, score, rank) of each row of ``scored``, a stored table."""
    eligible = F.col("n_words") >= least_words
    table = scored.where(eligible).groupBy("score").agg(F.count("*").alias("c")).toArrow()
    score, count = (table.column(c).to_numpy() for c in ("score", "c"))
    order = np.argsort(-score)
    score, count = score[order], count[order]
    before = np.cumsum(count) - count
    drawn = int(count.sum()) * percent // 100
    own = before < drawn
    names = ["i", "n_features", "weight", "score"]
    if not own.any():
        return scored.select(*names, F.lit(None).cast("long").alias("rank"))
    least = int(score[own].min())
    starts = scored.sparkSession.createDataFrame(pa.table({"score": score[own], "before": before[own]}))
    alike = scored.where(eligible & (F.col("score") >= least)).groupBy(*names).agg(F.count("*").alias("c"))
    w = Window.partitionBy("score").orderBy(F.col("i").asc_nulls_last(), "n_features")
    level = alike.join(F.broadcast(starts), "score")  # scores are bounded whole numbers
    first = F.col("before") + F.sum("c").over(w) - F.col("c")
    blocks = level.select(*names, "c", first.alias("first"), F.explode(F.sequence(F.lit(0), F.expr(f"(c - 1) div {BLOCK_ROWS}"))).alias("block"))
    low = F.col("block") * BLOCK_ROWS
    place = F.explode(F.sequence(F.col("first") + low + 1, F.col("first") + F.least(low + BLOCK_ROWS, F.col("c"))))
    numbered = blocks.select(*names, place.alias("place")).select(*names, F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))
    rest = scored.where(~(eligible & (F.col("score") >= least))).select(*names, F.lit(None).cast("long").alias("rank"))
    return rest.unionByName(numbered)


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: int = LOW, high: int = HIGH, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Per row: id, n_features, weight, score, rank (null when not drawn)."""
    gain = fit(docs, target, text_col, low, high, buckets)
    scored = stored(weighed(docs, gain, id_col, text_col, low, high, seed))
    return ranked(scored, least_words, percent).withColumnRenamed("i", id_col)
