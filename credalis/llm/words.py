"""Words of a batch of texts as integers."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import xxhash

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
"""A-Z lower-cased; blanks stay, so that ``split`` gives words ``[^\\x20\\x09-\\x0D]+``."""
ALPHANUMERIC = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isdigit() or 97 <= b <= 122 else 32 for b in range(256))
"""A-Z lower-cased; every other ASCII byte but digits and letters is a blank."""
MIX = np.uint64(0x9E3779B97F4A7C15)
TURN = np.uint64(29)


@dataclass
class Words:
    """``ids[k]`` is the place of word k in ``known``; ``starts[d]`` is the first word of text d, with the end of all last."""

    known: list[bytes]
    ids: np.ndarray
    starts: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    @property
    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.starts) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each known word."""
        return np.fromiter(map(xxhash.xxh64_intdigest, self.known), np.uint64, len(self.known))


def words_of(texts: list[bytes], letters: bytes = LOWER) -> Words:
    """``letters`` maps each byte before the texts are split at blanks."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    ids, counts = [], []
    for text in texts:
        found = text.translate(letters).split()
        counts.append(len(found))
        ids.extend(map(number.__getitem__, found))
    number.default_factory = None  # else the dictionary holds itself, and its words stay until Python looks for cycles
    return Words(list(number), np.array(ids, np.int64), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64))


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes, in order."""
    x = (a * MIX) ^ b
    return (x ^ (x >> TURN)) * MIX


def shingles(hashes: np.ndarray, words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every run of ``n`` words; a shorter text, if not empty, is one run of all its words.

    ``hashes`` holds the hash of each word in order.
    """
    counts, starts = words.counts, words.starts[:-1]
    runs = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(counts)), runs)
    first = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs) + starts[doc]
    length = np.minimum(counts, n)[doc]
    out = length.astype(np.uint64)
    for k in range(n):
        on = length > k
        out[on] = mixed(out[on], hashes[first[on] + k])
    return doc, out
