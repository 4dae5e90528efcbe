"""Word-piece counts by a linear longest-match automaton.

The vocabulary becomes a trie with failure links: from a node, the link leads where the
match stands after the pieces that can be split off have been popped, and the number of
those pieces is stored with the link. Reading a word byte by byte then gives its number of
greedy longest pieces in time linear in its length, and no piece is built.

Words are runs of bytes without blanks. A word that the vocabulary cannot cover is one
unknown piece. Null or empty text has no words. Repeated rows are counted alike; other
columns are not read. Each task counts every distinct word of a batch once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credalis.llm.frames import arrow_of, batch_of, id_type, text_chunks
from credalis.llm.words import MIX, words_of

INITIAL, INNER = 0, 1
"""Root of the pieces that begin a word, root of those that go on."""
PLAIN = bytes(range(256))


@dataclass(frozen=True)
class PieceTrie:
    """Edges in an open hash table: ``key`` holds node * 256 + byte or -1, ``child`` the next node."""

    key: np.ndarray
    child: np.ndarray
    probes: int
    fail: np.ndarray
    popped: np.ndarray

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Next node over an edge, or -1."""
        want = node * 256 + byte
        at = _slot(want, len(self.key))
        out = np.full(len(node), -1, np.int64)
        for _ in range(self.probes):
            here = self.key[at] == want
            out[here] = self.child[at[here]]
            at = (at + 1) & (len(self.key) - 1)
        return out

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each word; -1 where the vocabulary cannot cover it."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable")
        data = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        begin = (np.cumsum(sizes) - sizes)[order]
        left = sizes[order]
        node = np.zeros(len(words), np.int64)
        total = np.zeros(len(words), np.int64)
        for k in range(int(left[0]) if len(left) else 0):
            live = np.arange(np.searchsorted(-left, -k, "left"))  # words longer than k
            live = live[node[live] >= 0]
            byte = data[begin[live] + k].astype(np.int64)
            while len(live):
                to = self.step(node[live], byte)
                fits = to >= 0
                node[live[fits]] = to[fits]
                live, byte = live[~fits], byte[~fits]
                total[live] += self.popped[node[live]]
                node[live] = self.fail[node[live]]
                going = node[live] >= 0
                live, byte = live[going], byte[going]
        live = np.flatnonzero((node >= 0) & (node != INNER) & (left > 0))
        while len(live):
            total[live] += self.popped[node[live]]
            node[live] = self.fail[node[live]]
            live = live[(node[live] >= 0) & (node[live] != INNER)]
        out = np.empty(len(words), np.int64)
        out[order] = np.where(node < 0, -1, total)
        return out


def piece_trie(initial: Iterable[bytes], inner: Iterable[bytes]) -> PieceTrie:
    """``initial``: pieces that begin a word; ``inner``: pieces that go on (without a mark)."""
    edges: list[dict[int, int]] = [{}, {}]
    whole = [False, False]
    for root, pieces in ((INITIAL, initial), (INNER, inner)):
        for piece in pieces:
            at = root
            for byte in piece:
                if byte not in edges[at]:
                    edges[at][byte] = len(edges)
                    edges.append({})
                    whole.append(False)
                at = edges[at][byte]
            whole[at] = whole[at] or at not in (INITIAL, INNER)
    fail, popped = [-1] * len(edges), [0] * len(edges)
    queue = [(INITIAL, None, 0), (INNER, None, 0)]
    for node, parent, byte in queue:
        if whole[node]:
            fail[node], popped[node] = INNER, 1
        elif parent is not None:
            at, n = fail[parent], popped[parent]
            while at >= 0 and byte not in edges[at]:
                at, n = fail[at], n + popped[at]
            if at >= 0:
                fail[node], popped[node] = edges[at][byte], n
        queue += [(to, node, b) for b, to in edges[node].items()]
    want = np.array([u * 256 + b for u, row in enumerate(edges) for b in row] or [-1], np.int64)
    to = np.array([v for row in edges for v in row.values()] or [-1], np.int64)
    size = 1 << max(4, (8 * len(want)).bit_length())
    key, child = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    at, probes = _slot(want, size), 0
    while len(want):
        probes += 1
        open_ = np.flatnonzero(key[at] < 0)
        chosen = open_[np.unique(at[open_], return_index=True)[1]]
        key[at[chosen]], child[at[chosen]] = want[chosen], to[chosen]
        rest = np.setdiff1d(np.arange(len(want)), chosen)
        want, to, at = want[rest], to[rest], (at[rest] + 1) & (size - 1)
    return PieceTrie(key, child, probes, np.array(fail, np.int64), np.array(popped, np.int64))


def _slot(key: np.ndarray, size: int) -> np.ndarray:
    return ((key.astype(np.uint64) * MIX) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def spaced_vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """Pieces of a rank file (base64 and rank by line): those with a leading space begin a word."""
    pieces = [base64.b64decode(line.split()[0]) for line in Path(path).read_bytes().splitlines() if line.strip()]
    initial = [p for p in pieces if p == b" " or p[:1] == b" " and p[1:].split() == [p[1:]]]
    return initial, [p for p in pieces if p.split() == [p]]


def _count(held: Broadcast, lead: bytes, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie: PieceTrie = held.value
        for _, ids, texts in text_chunks(batches):
            words = words_of(texts, PLAIN)
            pieces = trie.counts([lead + w for w in words.known])[words.ids]

            def total(values: np.ndarray) -> np.ndarray:
                sums = np.concatenate([[0], np.cumsum(values)])
                return sums[words.starts[1:]] - sums[words.starts[:-1]]

            yield batch_of(schema, ids, words.counts, total(np.where(pieces < 0, 1, pieces)), total((pieces < 0).astype(np.int64)))

    return run


def piece_counts(docs: DataFrame, trie: PieceTrie, lead: bytes = b"", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_pieces, n_unknown. ``lead`` stands before each word, as a space does in some vocabularies."""
    ddl = f"i {id_type(docs, id_col)}, n_words long, n_pieces long, n_unknown long"
    held = docs.sparkSession.sparkContext.broadcast(trie)  # as large as the vocabulary
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return rows.mapInArrow(_count(held, lead, arrow_of(ddl)), ddl).withColumnRenamed("i", id_col)
