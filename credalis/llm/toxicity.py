"""Toxicity by logistic regression over hashed word n-grams and skip-grams, trained with FTRL-proximal.

Features of a text, each counted once: words, the first four bytes of words, pairs of
neighbours, and pairs with one word between. They are hashed to a fixed number of
coordinates. Each coordinate has its own learning rate, and the L1 term leaves few weights
that are not zero, so the model is small enough to send to every task.

The model is fitted on at most ``MAX_ROWS`` labelled rows, chosen by a hash of their id, in
shards of at most about ``SHARD_ROWS`` whose weights are averaged. Every text is scored whole.

Null or empty text has no features and scores the bias alone. A label row with null id or
label is not used; of repeated label rows of one id the largest label counts, and each
document row with that id is one example. Without any usable label all weights are zero.
Columns beside id and text are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credalis.llm.frames import ROWS_AT_ONCE, arrow_of, batch_of, column_bytes, text_chunks, trim, with_text
from credalis.llm.words import ALPHANUMERIC, Words, mixed, words_of

BITS = 22
MAX_ROWS = 32_000
SHARD_ROWS = 4_000
FIT_BYTES = 1 << 17
SCORE_BYTES = 1 << 20
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 4.0, 1.0
THRESHOLD = 0.3
STEM = 4


@dataclass(frozen=True)
class Model:
    """Weights that are not zero, sorted by coordinate, and the bias."""

    at: np.ndarray
    weight: np.ndarray
    bias: float

    def scores(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        total = np.full(n, self.bias)
        if len(self.at):
            k = np.minimum(np.searchsorted(self.at, feature), len(self.at) - 1)
            hit = self.at[k] == feature
            total += np.bincount(doc[hit], self.weight[k[hit]], n)
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def coordinates(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, coordinate) of every feature, kind by kind, repeated as often as it occurs."""
    doc, one = words.doc, words.hashes()[words.ids]
    stem = np.fromiter((xxhash.xxh64_intdigest(w[:STEM], 1) for w in words.known), np.uint64, len(words.known))[words.ids]
    near, far = doc[:-1] == doc[1:], doc[:-2] == doc[2:]
    for d, h in ((doc, one), (doc, stem), (doc[:-1][near], mixed(one[:-1], one[1:])[near]), (doc[:-2][far], mixed(~one[:-2], one[2:])[far])):
        yield d, (mixed(h, h) >> np.uint64(64 - BITS)).astype(np.int64)


def features(words: Words, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, coordinate) of the distinct features of each text, sorted; ``wanted`` marks coordinates to keep."""
    keys = [np.zeros(0, np.int64)]
    for doc, at in coordinates(words):
        if wanted is not None:
            kept = np.flatnonzero(wanted[at])
            doc, at = doc[kept], at[kept]
        keys.append((doc << BITS) | at)
    key = np.unique(np.concatenate(keys))
    return key >> BITS, key & ((1 << BITS) - 1)


def used(models: list[Model]) -> np.ndarray:
    """Marks of the coordinates that some model weighs."""
    out = np.zeros(1 << BITS, bool)
    for m in models:
        out[m.at] = True
    return out


def feature_lists(texts: Iterable[bytes], limit: int = FIT_BYTES) -> list[np.ndarray]:
    """Coordinates of each text, worked out over a bounded amount of text at a time."""
    out: list[np.ndarray] = []

    def add(part: list[bytes]) -> None:
        doc, feature = features(words_of(part, ALPHANUMERIC))
        cut = np.searchsorted(doc, np.arange(len(part) + 1))
        out.extend(feature[a:b].astype(np.int32) for a, b in zip(cut[:-1], cut[1:], strict=True))

    part, held = [], 0
    for text in texts:
        part.append(text)
        held += len(text)
        if held >= limit:
            add(part)
            part, held = [], 0
    if part:
        add(part)
    return out


def ordered_texts(table: pa.Table, order: pa.Array) -> Iterator[bytes]:
    """Texts of a shard in the given order, a few at a time."""
    column = table.column("text")
    column = column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()
    for k in range(0, len(order), ROWS_AT_ONCE):
        yield from column_bytes(column.take(order.slice(k, ROWS_AT_ONCE)))


def fit(texts: Iterable[bytes], labels: np.ndarray, epochs: int = EPOCHS) -> Model:
    """FTRL-proximal over the examples in the given order."""
    return fit_lists(*compact(feature_lists(texts)), labels, epochs)


def compact(lists: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Coordinates that occur, and each text's places among them, with one for the bias last; ``lists`` is taken over."""
    place = np.zeros(1 << BITS, np.int32)
    for x in lists:
        place[x] = 1
    seen = np.flatnonzero(place).astype(np.int32)
    place[seen] = np.arange(len(seen), dtype=np.int32)
    for k, x in enumerate(lists):
        lists[k] = np.append(place[x], np.int32(len(seen)))
    return seen, lists


def fit_lists(seen: np.ndarray, own: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> Model:
    """The same from ``compact``; the bias is not shrunk."""
    bias = len(seen)
    z, n = np.zeros(bias + 1), np.zeros(bias + 1)

    def weight(z: np.ndarray, n: np.ndarray, l1: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(epochs):
        for at, y in zip(own, labels, strict=True):
            zi, ni = z[at], n[at]
            w = weight(zi, ni, np.append(np.full(len(at) - 1, L1), 0.0))
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + g * g
    kept = np.flatnonzero(np.abs(z[:bias]) > L1)
    return Model(seen[kept].astype(np.int64), weight(z[kept], n[kept], np.full(len(kept), L1)), float(weight(z[bias:], n[bias:], np.zeros(1))[0]))


def held_out(id_column: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 4 == 2, F.lit(False))


def _fit_shard(key: tuple, table: pa.Table) -> pa.Table:
    trim()
    order = pc.sort_indices(table.column("draw"))
    seen, own = compact(feature_lists(ordered_texts(table, order)))
    labels = table.column("label").take(order).to_numpy()
    del table
    trim()  # the texts and what their features were made from
    model = fit_lists(seen, own, labels)
    del seen, own
    trim()  # what the examples took would stay beside the scoring that this worker does next
    return pa.table({"at": pa.array([*model.at, 1 << BITS], pa.int64()), "weight": pa.array([*model.weight, model.bias], pa.float64())})


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    """Fit on label rows that are not held out; at most 2**BITS weights are collected."""
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("double").alias("label")).where(F.col("i").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("i")))
    known = known.groupBy("i").agg(F.max("label").alias("label")).orderBy(F.xxhash64("i")).limit(max_rows)
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text")).join(F.broadcast(known), "i")  # no more than max_rows ids
    shards = max(1, -(-known.count() // SHARD_ROWS))
    rows = rows.select(F.pmod(F.xxhash64("i"), F.lit(shards)).alias("shard"), F.xxhash64("i", F.lit("draw"), "text").alias("draw"), "text", "label")
    fitted = rows.groupBy("shard").applyInArrow(_fit_shard, "at long, weight double")
    mean = fitted.groupBy("at").agg((F.sum("weight") / shards).alias("weight")).orderBy("at").toArrow()
    at, weight = mean.column("at").to_numpy(), mean.column("weight").to_numpy()
    own = at < 1 << BITS
    return Model(at[own], weight[own], float(weight[~own].sum()))


def _score(held: Broadcast, text: str | None, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = held.value
        wanted = used([model])
        for _, ids, texts in text_chunks(with_text(batches, text), SCORE_BYTES):
            yield batch_of(schema, ids, model.scores(*features(words_of(texts, ALPHANUMERIC), wanted), len(texts)))

    return run


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Per row: id, held_out, score, predicted. ``keep`` carries the whole row as ``row`` instead of the id."""
    rows = docs.select(F.struct("*").alias("i")) if keep else docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    ddl = f"i {rows.schema['i'].dataType.simpleString()}, score double"
    held = docs.sparkSession.sparkContext.broadcast(model)
    out = rows.mapInArrow(_score(held, text_col if keep else None, arrow_of(ddl)), ddl)
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    if keep:
        return out.select(F.col("i").alias("row"), "score", predicted)
    return out.select(F.col("i").alias(id_col), held_out(F.col("i")).alias("held_out"), "score", predicted)
