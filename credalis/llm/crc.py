"""CRC-32 of many spans of one byte stream, from tables by place.

The checksum is linear in the bytes: a byte contributes a value that depends on itself and on
how many bytes of its span come after it. ``BY_PLACE`` holds these values for the last
``BLOCK`` places; XOR over a span, with a constant for its length, is its checksum. A longer
span is cut into blocks from its end, whose values are carried over the bytes after them by
``FURTHER``, one table for each power of two.
"""

from __future__ import annotations

import numpy as np

POLYNOMIAL = np.uint32(0xEDB88320)
BLOCK = 64
POWERS = 40
"""Spans are shorter than 2**POWERS bytes."""


def _one_byte() -> np.ndarray:
    """State after each byte value, from state 0."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & np.uint32(1), (out >> np.uint32(1)) ^ POLYNOMIAL, out >> np.uint32(1))
    return out


def _places() -> np.ndarray:
    one = _one_byte()
    out = np.empty((BLOCK, 256), np.uint32)
    out[0] = one
    for k in range(1, BLOCK):
        out[k] = (out[k - 1] >> np.uint32(8)) ^ one[out[k - 1] & np.uint32(255)]
    return out


def _carried(state: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = table[0][state & np.uint32(255)]
    for k in (1, 2, 3):
        out = out ^ table[k][(state >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _further() -> np.ndarray:
    """``[j, k, b]``: what byte k of the state, of value b, becomes after 2**j zero bytes."""
    one = _one_byte()
    out = np.empty((POWERS, 4, 256), np.uint32)
    for k in range(4):
        state = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        out[0, k] = (state >> np.uint32(8)) ^ one[state & np.uint32(255)]
    for j in range(1, POWERS):
        for k in range(4):
            out[j, k] = _carried(out[j - 1, k], out[j - 1])
    return out


BY_PLACE = _places()
FURTHER = _further()


def carried(state: np.ndarray, count: np.ndarray) -> np.ndarray:
    """State after ``count`` zero bytes."""
    out = state.astype(np.uint32)
    for j in range(int(count.max(initial=0)).bit_length()):
        on = np.flatnonzero((count >> j) & 1)
        out[on] = _carried(out[on], FURTHER[j])
    return out


def _constants(length: np.ndarray) -> np.ndarray:
    """Checksum of as many zero bytes."""
    return ~carried(np.full(len(length), 0xFFFFFFFF, np.uint32), length)


BY_LENGTH = _constants(np.arange(BLOCK + 1))


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers begin .. begin + size - 1 of each pair."""
    return np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)


def _block_values(stream: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """XOR of the contributions of blocks of 1 to BLOCK bytes."""
    at = ranges(begin, size)
    after = np.repeat(begin + size - 1, size) - at
    return np.bitwise_xor.reduceat(BY_PLACE.ravel()[(after << 8) | stream[at]], np.cumsum(size) - size)


def span_crc32(stream: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of the spans ``stream[begin : begin + size]``; spans may overlap, an empty one gives 0."""
    out = np.zeros(len(begin), np.uint32)
    short = np.flatnonzero((size > 0) & (size <= BLOCK))
    if len(short):
        out[short] = _block_values(stream, begin[short], size[short]) ^ BY_LENGTH[size[short]]
    long_ = np.flatnonzero(size > BLOCK)
    if len(long_):
        begin, size = begin[long_], size[long_]
        blocks = -(-size // BLOCK)
        nth = ranges(np.zeros(len(blocks), np.int64), blocks)
        left = np.repeat(blocks, blocks) - 1 - nth  # whole blocks that come after
        end = np.repeat(begin + size, blocks) - left * BLOCK
        start = np.maximum(end - BLOCK, np.repeat(begin, blocks))
        value = carried(_block_values(stream, start, end - start), left * BLOCK)
        out[long_] = np.bitwise_xor.reduceat(value, np.cumsum(blocks) - blocks) ^ _constants(size)
    return out
