"""Token ids of texts as ORC files in ascending id order.

Rows are dealt into ranges of ids, sorted, and encoded in the task that writes them, so one
shuffle of texts is all that moves. Each range is one file of rows
(doc_id, part, first, n_tokens, ids): ``first`` counts the ids of the part's documents before
this one. ORC stores the ids in stripes with integer run-length encoding, statistics for every
``ROWS`` rows, and a Bloom filter on ``doc_id``. Readers take stripes in parallel, and a
filter on ``doc_id`` skips files, stripes and row groups by these. A second small table holds
the number of ids before each part.

Texts are encoded by the tokenizers library. Where the vocabulary's rules end a token at every
blank and between letters and punctuation, a task encodes each distinct part between such places
once; it remembers about ``KNOWN_BYTES`` of parts, then starts anew.

Null or empty text has the end id alone. A null id comes last. Rows with one id are ordered by
a hash of their text, rows alike in both keep the order they are read in, and all stay; an id
that many rows have is cut into several parts. A text of any length is one row. An empty table
gives files without rows. Other columns are not read. The folder must be new.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credalis.llm.crc import ranges
from credalis.llm.frames import arrow_of, batch_of, id_type, text_chunks
from credalis.llm.words import LOWER

END_ID = 1
PART_BYTES = 48 << 20
"""Bytes of text in a part, on average."""
CHUNK_BYTES = 1 << 20
KNOWN_BYTES = 64 << 20
"""Bytes of distinct parts whose ids a task remembers."""
PARTS_AT_ONCE = 256
STRIPE_BYTES = 16 << 20
ROWS = 1_000
"""Rows for each entry of the row index and its Bloom filter."""
WRITE = {
    "compression": "none",
    "orc.encoding.strategy": "COMPRESSION",
    "orc.stripe.size": str(STRIPE_BYTES),
    "orc.create.index": "true",
    "orc.row.index.stride": str(ROWS),
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}
# The rules of a vocabulary of word ends, whose words may be cut before they are encoded.
WORD_RULES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
LETTERS = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F"  # not U+0130, which lower-cases to a letter and a mark
SIGNS = r"\x00-\x08\x0E-\x1F!-/:-@\[-`{-~\x7F"
PLAIN_PARTS = re.compile(rf"[{SIGNS}]*'[0-9{LETTERS}]+|[0-9{LETTERS}]+|[{SIGNS}]+")
"""Runs of letters and digits, and runs of ASCII signs, which go with what follows an apostrophe."""
NOT_PLAIN = re.compile(rf"[^\x00-\x7F{LETTERS}]")
CUTS = re.compile(rf"[\x20\x09-\x0D]+|(?<=[0-9{LETTERS}])(?=[{SIGNS}])|(?<=(?!')[{SIGNS}])(?=[0-9{LETTERS}])")
"""In texts with other characters: at blanks, and between a letter of these or a digit and an ASCII sign, but not after an apostrophe."""
CAPITAL_JOINED = re.compile(r"[A-Z](?=[^\x00-\u02FF])")
"""A capital that a mark may follow: composition looks at it before lower-casing does."""
BLANKS = re.compile(r"[\x20\x09-\x0D]+")


def _lower(text: str) -> str:
    """A-Z alone lower-cased."""
    return text.encode().translate(LOWER).decode()


class Encoder:
    """Ids of texts by a tokenizers file.

    Where its rules are those above, texts are cut at places where a token always ends, each
    distinct part is encoded once, and many parts at a time with a special token between them.
    By other rules whole texts are encoded.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        rules = json.loads(definition)
        self.marks = re.compile("|".join(re.escape(t["content"]) for t in rules["added_tokens"]))
        apart = [t for t in rules["added_tokens"] if t["special"] and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"])]
        self.between = apart[0] if apart else None
        self.by_part = self.between is not None and _cuts_words(rules)
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__  # a part's number is its place in order of appearance
        self._forget()

    def _forget(self) -> None:
        """No part is known."""
        self.number.clear()
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.held = 0

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for t in texts for e in self.tokenizer.encode_batch_fast([t], add_special_tokens=False)]

    def _parts(self, text: str) -> list[str]:
        if self.marks.search(text):  # words that hold a special token stay whole
            return [p for w in BLANKS.split(text) for p in ([w] if self.marks.search(w) else CUTS.split(w))]
        if not NOT_PLAIN.search(text):
            return PLAIN_PARTS.findall(_lower(text))
        return CUTS.split(text if CAPITAL_JOINED.search(text) else _lower(text))

    def _learn(self, new: list[str]) -> None:
        marked = {}
        if self.marks.search("\n".join(new)):
            marked = {p: np.array(self._whole([p])[0], np.int32) for p in new if self.marks.search(p)}
        plain = [p for p in new if p not in marked] if marked else new
        flat, sizes = [], []
        for k in range(0, len(plain), PARTS_AT_ONCE):
            ids = np.array(self._whole([self.between["content"].join(plain[k : k + PARTS_AT_ONCE])])[0], np.int32)
            cut = np.flatnonzero(ids == self.between["id"])
            flat.append(np.delete(ids, cut))
            sizes.append(np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1)
        flat = np.concatenate([np.zeros(0, np.int32), *flat, *marked.values()])
        sizes = np.concatenate([np.zeros(0, np.int64), *sizes, [len(x) for x in marked.values()]]).astype(np.int64)
        starts = len(self.flat) + np.cumsum(sizes) - sizes
        if marked:  # back to the order of the numbers
            place = {p: k for k, p in enumerate([*plain, *marked])}
            order = np.array([place[p] for p in new])
            starts, sizes = starts[order], sizes[order]
        self.starts, self.sizes, self.flat = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, flat])
        self.held += sum(map(len, new)) + 180 * len(new) + flat.nbytes

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of each)."""
        if not self.by_part:
            found = self._whole([t.decode() for t in texts])
            return np.fromiter(chain.from_iterable(found), np.int32), np.fromiter(map(len, found), np.int64, len(found))
        if self.held > KNOWN_BYTES:
            self._forget()
        known, numbers, counts = len(self.number), array("q"), [0]
        for text in texts:
            numbers.extend(map(self.number.__getitem__, self._parts(text.decode())))
            counts.append(len(numbers))
        if len(self.number) > known:
            self._learn(list(islice(self.number, known, None)))
        at = np.array(numbers, np.int64)
        sizes = self.sizes[at]
        before = np.append(0, np.cumsum(sizes))
        return self.flat[ranges(self.starts[at], sizes)], np.diff(before[counts])


def _cuts_words(rules: dict) -> bool:
    """Whether a tokenizer's rules are ``WORD_RULES``, after which white space is gone."""
    normal, pre = (rules.get(k) or {} for k in ("normalizer", "pre_tokenizer"))
    if [n["type"] for n in normal.get("normalizers", [])] != NORMALIZERS or normal["normalizers"][1]["pattern"] != {"Regex": r"\s+"}:
        return False
    steps = pre.get("pretokenizers", [{}])
    return steps[0].get("pattern") == {"Regex": WORD_RULES} and steps[0]["invert"] and steps[0]["behavior"] == "Removed"


def _encode(definition: str, end_id: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(definition)
        part, first = TaskContext.get().partitionId(), 0
        for _, keys, texts in text_chunks(batches, CHUNK_BYTES):
            ids, sizes = encoder.ids(texts)
            ids = np.insert(ids, np.cumsum(sizes), end_id).astype(np.int32)
            sizes = sizes + 1
            cut = np.append(0, np.cumsum(sizes))
            lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids))
            yield batch_of(schema, keys, np.full(len(keys), part), first + cut[:-1], sizes, lists)
            first += int(cut[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> None:
    """Encode all texts into ORC files under ``path``; ``tokenizer`` is the driver's path of a tokenizers file."""
    with open(tokenizer, encoding="utf-8") as f:
        definition = f.read()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_last(), "draw", "nth"]
    keyed = rows.withColumn("draw", F.xxhash64("t")).withColumn("nth", F.monotonically_increasing_id())
    dealt = keyed.repartitionByRange(max(1, -(-size // part_bytes)), *order).sortWithinPartitions(*order)
    ddl = f"doc_id {id_type(rows, 'doc_id')}, part int, first long, n_tokens int, ids array<int>"
    tokens = dealt.select("doc_id", "t").mapInArrow(_encode(definition, end_id, arrow_of(ddl)), ddl)
    tokens.write.options(**WRITE).orc(f"{path}/tokens")
    written = docs.sparkSession.read.schema(ddl).orc(f"{path}/tokens")
    parts = written.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row a file
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    parts.select("part", before.alias("before")).coalesce(1).write.orc(f"{path}/parts")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents; filters on ``doc_id`` reach the files' indexes."""
    tokens, parts = spark.read.orc(f"{path}/tokens"), spark.read.orc(f"{path}/parts")
    return tokens.join(parts, "part").select("doc_id", (F.col("before") + F.col("first")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids")


def _digest(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            cut, values = lists.offsets.to_numpy(), np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4")
            crc = [zlib.crc32(values[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            yield batch_of(schema, *batch.columns[:-1], crc)

    return run


def token_digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from what ``read_tokens`` gives."""
    ddl = f"doc_id {id_type(tokens, 'doc_id')}, start long, n_tokens long, ids_crc32 long"
    return tokens.mapInArrow(_digest(arrow_of(ddl)), ddl)
