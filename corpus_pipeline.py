"""Corpus pipeline: each stage applies one operator to all rows that the stage before kept.

A stage takes (spark, docs, sf_dir). Its result is written as Parquet into the shared
folder and read again as the next stage's documents. All stages but the last return the
columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from credalis.llm import decontaminate, jaccard, mixing, sharding, toxicity
from credalis.llm.catalog import table
from credalis.llm.frames import stored

# Wanted shares of tokens by (quality, toxic).
SHARES = {(0, 0): 0.10, (0, 1): 0.005, (1, 0): 0.89, (1, 1): 0.005}
BUDGET = 1.25
"""Tokens after mixing, as a multiple of those before."""
FLOOR = 1.0
"""Least rate: mixing repeats documents of scarce domains and drops none."""


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity model rejects."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxicity(docs, model, keep=True).where("predicted = 0").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words a shingle, similarity 0.85."""
    return jaccard.one_per_group(docs, width=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark passage."""
    return decontaminate.benchmark_hits(docs, table(spark, sf_dir, "benchmark"), keep=True).where("size(runs) = 0").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says."""
    labels = mixing.domain_labels(table(spark, sf_dir, "labels"), list(SHARES))
    return mixing.mixed_rows(docs, labels, list(SHARES.values()), BUDGET, FLOOR)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each row, beside its columns."""
    return sharding.shards(docs, keep=docs.columns)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("sharding", shard),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = stored(docs) if k < len(STAGES) - 1 else docs
    return docs
