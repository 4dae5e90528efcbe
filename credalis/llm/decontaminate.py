"""Benchmark passages in documents by multi-pattern search with block shifts.

A pattern is a window of ten consecutive words of a benchmark item, or all words of a
shorter item. For the patterns of each length, a shift table over blocks of two words says
how far the window may move at least; where it may not move, the block's bucket names the
patterns that end so, their first block is compared, and then word by word.

Slices of texts advance together. A text is read by one task in bounded batches, and only
rows of results leave it. The benchmark is held in parts of bounded size; a larger one is
searched part by part, each over all texts.

Null or empty text has no words and is not contaminated. An item without words has no
window. A null item id marks words but is not listed. Repeated rows and ids are judged
alike. An empty benchmark marks nothing. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credalis.llm.frames import arrow_of, batch_of, column_bytes, id_type, stored, text_chunks, with_text
from credalis.llm.words import ALPHANUMERIC, Words, mixed, words_of

WINDOW = 10
PART_BYTES = 8 << 20
"""Benchmark text in one search table, on average."""
LANE_WORDS = 256
SEARCH_BYTES = 1 << 20
"""Bytes of text that a task searches together, apart from a single longer text."""


@dataclass(frozen=True)
class Patterns:
    """Patterns of one length: shifts by block, and patterns sorted by the hash of their last block."""

    length: int
    shift: np.ndarray
    last: np.ndarray
    first: np.ndarray
    words: list[list[bytes]]
    items: list[set[str]]


def _blocks(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the block of ``size`` words that ends at each position."""
    return hashes[at] if size == 1 else mixed(hashes[at - 1], hashes[at])


def search_tables(items: list[tuple[str | None, bytes]], window: int = WINDOW) -> list[Patterns]:
    """Tables of the items' windows, one for each length that occurs."""
    found: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        words = text.translate(ALPHANUMERIC).split()
        for k in range(max(len(words) - window + 1, min(len(words), 1))):
            found.setdefault(tuple(words[k : k + window]), set()).update([] if item is None else [item])
    tables = []
    for m in sorted({len(p) for p in found}):
        chosen = [p for p in found if len(p) == m]
        size = min(2, m)
        known = words_of([b" ".join(p) for p in chosen])
        hashes = known.hashes()[known.ids].reshape(-1, m).reshape(-1)
        ends = np.arange(len(chosen)) * m + m - 1
        bits = max(8, int(4 * len(chosen) * m).bit_length())
        shift = np.full(1 << bits, m - size + 1, np.int64)
        for k in range(m - size + 1):  # k words behind the block
            at = (_blocks(hashes, ends - k, size) & np.uint64((1 << bits) - 1)).astype(np.int64)
            np.minimum.at(shift, at, k)
        last, first = _blocks(hashes, ends, size), _blocks(hashes, ends - m + size, size)
        order = np.argsort(last, kind="stable")
        tables.append(Patterns(m, shift, last[order], first[order], [list(chosen[i]) for i in order], [found[chosen[i]] for i in order]))
    return tables


def occurrences(words: Words, hashes: np.ndarray, table: Patterns) -> list[tuple[int, int]]:
    """(first word, pattern) of every occurrence. ``hashes`` holds the hash of each word in order."""
    m, size = table.length, min(2, table.length)
    counts = np.maximum(words.counts - m + 1, 0)  # windows of each text
    lanes = -(-counts // LANE_WORDS)
    doc = np.repeat(np.arange(len(counts)), lanes)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    at = words.starts[doc] + nth * LANE_WORDS + m - 1
    stop = np.minimum(at + LANE_WORDS, words.starts[doc + 1])
    mask = np.uint64(len(table.shift) - 1)
    out = []
    while len(at):
        block = _blocks(hashes, at, size)
        move = table.shift[(block & mask).astype(np.int64)]
        here = np.flatnonzero(move == 0)
        if len(here):
            low, high = np.searchsorted(table.last, block[here], "left"), np.searchsorted(table.last, block[here], "right")
            many = high - low
            which = np.repeat(here, many)
            pattern = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
            begin = at[which] - m + 1
            same = table.first[pattern] == _blocks(hashes, begin + size - 1, size)
            for b, p in zip(begin[same].tolist(), pattern[same].tolist(), strict=True):
                if [words.known[i] for i in words.ids[b : b + m]] == table.words[p]:
                    out.append((b, p))
        at = at + np.maximum(move, 1)
        live = at < stop
        at, stop = at[live], stop[live]
    return out


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b, e in sorted(runs):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def _search(tables: list[Patterns], schema: pa.Schema, more: bool, text_in_row: str | None = None):
    """Batches of (id, text, earlier runs and items), or of (row that holds the text, earlier runs and items)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            earlier = batch.column("runs").to_pylist(), batch.column("items").to_pylist()
            for _, ids, texts in text_chunks(with_text(iter([batch]), text_in_row), SEARCH_BYTES):
                words = words_of(texts, ALPHANUMERIC)
                hashes = words.hashes()[words.ids]
                runs = [[(r["b"], r["e"]) for r in x or []] for x in earlier[0][at : at + len(texts)]]
                items = [set(x or []) for x in earlier[1][at : at + len(texts)]]
                for table in tables:
                    found = occurrences(words, hashes, table)
                    docs = np.searchsorted(words.starts, [b for b, _ in found], side="right") - 1
                    for d, (b, p) in zip(docs.tolist(), found, strict=True):
                        runs[d].append((b - int(words.starts[d]), b - int(words.starts[d]) + table.length))
                        items[d] |= table.items[p]
                merged = [[{"b": b, "e": e} for b, e in _merged(x)] for x in runs]
                text = [] if text_in_row else [batch.column(1).slice(at, len(texts)) if more else [None] * len(texts)]
                yield batch_of(schema, ids, *text, merged, [sorted(x) for x in items], words.counts)
                at += len(texts)

    return run


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    window: int = WINDOW, part_bytes: int = PART_BYTES, keep: bool = False,
) -> DataFrame:
    """Per row: id, n_words, runs of hit words (b, e), items (sorted ids as strings). ``keep`` carries the whole row as ``row`` instead of the id."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text"))
    parts = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // part_bytes))
    own = [F.struct("*").alias("i")] if keep else [F.col(id_col).alias("i"), F.col(text_col).alias("t")]  # a carried row holds its text once
    rows = docs.select(*own, F.lit(None).cast("array<struct<b:int,e:int>>").alias("runs"), F.lit(None).cast("array<string>").alias("items"))
    names = rows.columns
    ddl = f"{', '.join(f'{x.name} {x.dataType.simpleString()}' for x in rows.schema)}, n_words long"
    for part in range(parts):
        found = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).toArrow().combine_chunks()
        pairs = list(zip(found.column("item").to_pylist(), column_bytes(found.column("text")), strict=True))
        rows = rows.select(*names).mapInArrow(_search(search_tables(pairs, window), arrow_of(ddl), part < parts - 1, text_col if keep else None), ddl)
        rows = stored(rows) if part < parts - 1 else rows
    out = rows.select("i", "n_words", "runs", "items")
    return out.withColumnRenamed("i", "row" if keep else id_col)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hits = benchmark_hits(docs, benchmark, id_col, text_col, **options)
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r["e"] - r["b"])
    return hits.select(
        id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated"),
    )
