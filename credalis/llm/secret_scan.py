"""Secrets by one combined deterministic automaton.

Three base rules are always scanned; further rules add spans of their own kind. All rules
are compiled into one transition array, which is stepped once over the bytes of a batch of
texts; a match's start is read backwards from its end. Spans are in code points, end
exclusive; per kind they are leftmost and non-overlapping, as long as possible, and short
ones are dropped after they have been passed.

Null text counts as empty and has no spans; its digests are those of the empty string.
Repeated rows give repeated results. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credalis.llm import automata
from credalis.llm.frames import arrow_of, batch_of, id_type, text_chunks
from credalis.llm.lanes import stream_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``least`` counts the characters of ``value``, the pattern's last part."""

    kind: str
    pattern: str
    least: int
    any_case: bool = False
    value: str = ""


# The base rules.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 6, True, "A-Za-z0-9+/_.=-"),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
FURTHER = (
    Rule("pem", r"-----BEGIN\x20([A-Z0-9]+\x20)*PRIVATE\x20KEY-----", 1),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}", 40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
)


def _value_length(rule: Rule, match: bytes) -> int:
    """Length of the value: what follows the first separator, its spaces and one quote."""
    if not rule.value:
        return len(match)
    cut = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0) + 1
    value = match[cut:].lstrip(b" ")
    return len(value) - (value[:1] in (b'"', b"'"))


def find_secrets(texts: list[bytes], rules: tuple[Rule, ...], scanner: automata.Scanner) -> list[list[tuple[int, int, int]]]:
    """Per text, (start, rule number, end) in code points, sorted."""
    stream, starts = stream_of(texts)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    data = stream.tobytes()
    ahead = np.concatenate([[0], np.cumsum((stream & 0xC0) == 0x80)])  # continuation bytes before
    for k, found in enumerate(automata.spans(scanner, stream)):
        rule = rules[k]
        kept = [(b, e) for b, e in found if _value_length(rule, data[b:e]) >= rule.least]
        if not kept:
            continue
        at = np.array(kept)
        doc = np.searchsorted(starts, at[:, 0], side="right") - 1
        base = starts[doc]
        points = at - base[:, None] - (ahead[at] - ahead[base][:, None])
        for d, (b, e) in zip(doc.tolist(), points.tolist(), strict=True):
            out[d].append((b, k, e))
    return [sorted(x) for x in out]


def _scan(rules: tuple[Rule, ...], scanner: automata.Scanner, schema: pa.Schema):
    def label(rows: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{rules[k].kind}:{b}:{e}" for b, k, e in rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, texts in text_chunks(batches):
            found = find_secrets(texts, rules, scanner)
            base = [[r for r in rows if r[1] < len(BASE)] for rows in found]
            counts = [[sum(r[1] == k for r in rows) for rows in base] for k in range(len(BASE))]
            digest = [hashlib.sha256(label(rows).encode()).hexdigest() for rows in base]
            yield batch_of(schema, ids, *counts, digest, [label(rows) for rows in found])

    return run


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", further: tuple[Rule, ...] = FURTHER) -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, base_sha256, spans (``kind:start:end`` of all rules)."""
    rules = (*BASE, *further)
    scanner = automata.compile_rules([(r.pattern, r.any_case) for r in rules])
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    ddl = f"i {id_type(docs, id_col)}, {', '.join(f'n_{r.kind} long' for r in BASE)}, base_sha256 string, spans string"
    return rows.mapInArrow(_scan(rules, scanner, arrow_of(ddl)), ddl).withColumnRenamed("i", id_col)
