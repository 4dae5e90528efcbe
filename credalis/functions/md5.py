"""MD5 of many short texts at once: each step of the digest is one array operation over all of them.

Gives the numbers that :func:`credalis.functions.seeded.key_hash` gives one row at a time, for
jobs that need hundreds of draws a row.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_K = (np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)
_SHIFTS = [s for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in row * 4]
_WORDS = [*range(16), *[(5 * i + 1) % 16 for i in range(16)], *[(3 * i + 5) % 16 for i in range(16)], *[7 * i % 16 for i in range(16)]]
_START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)


def _block(state: np.ndarray, words: np.ndarray) -> np.ndarray:
    """State ``(4, n)`` after one more block of words ``(16, n)``."""
    a, b, c, d = (x.copy() for x in state)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += _K[i]
        f += words[_WORDS[i]]
        s = np.uint32(_SHIFTS[i])
        np.right_shift(f, np.uint32(32) - s, out=t)
        f <<= s
        f |= t
        # the old a has been used: its buffer takes the new b
        np.add(b, f, out=a)
        a, b, c, d = d, a, b, c
    return state + np.stack([a, b, c, d])


class Heads:
    """First 32 bits of the MD5 of fixed beginnings with changing ends."""

    def __init__(self, beginnings: Sequence[bytes], longest_end: int = 20) -> None:
        size = np.fromiter(map(len, beginnings), np.int64, len(beginnings))
        self.order = np.argsort(size, kind="stable")  # texts of one length lie side by side
        self.runs = [(int(v), int(lo), int(lo + n)) for v, lo, n in zip(*np.unique(size[self.order], return_index=True, return_counts=True), strict=True)]
        self.blocks = int((size.max(initial=0) + longest_end + 8) // 64 + 1)
        text = np.zeros((len(beginnings), 64 * self.blocks), np.uint8)
        for length, lo, hi in self.runs:
            text[lo:hi, :length] = np.frombuffer(b"".join(beginnings[i] for i in self.order[lo:hi]), np.uint8).reshape(hi - lo, length)
        self.words = np.ascontiguousarray(text.view("<u4").T)

    def of(self, ends: Sequence[bytes]) -> np.ndarray:
        """The numbers that the first eight hex digits are: a row for each end, a column for each beginning."""
        n = len(self.order)
        words = np.empty((len(self.words), len(ends), n), np.uint32)
        words[:] = self.words[:, None, :]
        last = np.zeros((len(ends), n), np.int64)  # the block that ends with the length
        for g, end in enumerate(ends):
            for length, lo, hi in self.runs:
                tail = bytes(length % 4) + end + b"\x80"
                for w, bits in enumerate(np.frombuffer(tail + bytes(-len(tail) % 4), "<u4")):
                    if bits:
                        words[length // 4 + w, g, lo:hi] |= bits
                block = (length + len(end) + 8) // 64
                words[16 * block + 14, g, lo:hi] = 8 * (length + len(end))
                last[g, lo:hi] = block
        words, last = words.reshape(len(self.words), -1), last.ravel()
        state = np.repeat(_START[:, None], len(last), axis=1)
        for k in range(int(last.max(initial=0)) + 1):
            new = _block(state, words[16 * k : 16 * k + 16])
            state = np.where(k <= last, new, state) if k else new
        out = np.empty((len(ends), n), np.uint32)
        out[:, self.order] = state[0].byteswap().reshape(len(ends), n)
        return out
