"""Seeded draws that depend on a key only, never on partitioning or task order.

Everything is a substring of ``md5(seed|key...)``, so a lost executor recomputes
the same draw and any other SQL engine can repeat it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAWS_PER_HASH = 8
"""An md5 has 32 hex digits: eight 16-bit draws."""


def key_hash(seed: str | int, *keys: Column | str) -> Column:
    """Hex md5 of ``seed|key|...``; ordering by it is a seeded shuffle. A null key has a mark of its own."""
    return F.md5(hashed_text(seed, *keys))


def hashed_text(seed: str | int, *keys: Column | str) -> Column:
    """The text ``seed|key|...`` that :func:`key_hash` digests."""
    cols = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("\0")) for k in keys]
    return F.concat_ws("|", F.lit(str(seed)), *cols)


def hash_uniform(h: Column | str) -> Column:
    """First 32 bits of a hex hash as a double in [0, 1)."""
    h = F.col(h) if isinstance(h, str) else h
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform(seed: str | int, *keys: Column | str) -> Column:
    """Stable uniform draw per key."""
    return hash_uniform(key_hash(seed, *keys))


def pick(n: Column, seed: str | int, *keys: Column | str) -> Column:
    """Stable integer in ``0 .. n-1`` per key."""
    return F.floor(n * uniform(seed, *keys)).cast("int")


def pick_of(n: int, seed: str | int, *keys: Column | str) -> Column:
    """:func:`pick` for a fixed ``n``: hex sorts like the number, so a small ``n`` needs comparisons only."""
    if n > 16:
        return pick(F.lit(n), seed, *keys)
    h, out = key_hash(seed, *keys), F.lit(n - 1)
    for i in range(n - 1, 0, -1):
        out = F.when(h < f"{-(-(i << 32) // n):08x}", i - 1).otherwise(out)
    return out


def poisson_thresholds() -> list[str]:
    """16-bit hex thresholds of the Poisson(1) distribution function."""
    out, cdf, k = [], 0.0, 0
    while True:
        cdf += math.exp(-1.0) / math.factorial(k)
        cut = round(65536 * cdf)
        if cut > 65535:
            return out
        out.append(f"{cut:04x}")
        k += 1


def poisson1(hex4: Column) -> Column:
    """Poisson(1) weight from four hex digits.

    Lower-case hex of fixed length sorts like the number, so the inverse
    distribution function is a sum of string comparisons: no number parsing.
    """
    out = F.lit(0)
    for t in poisson_thresholds():
        out = out + (hex4 >= F.lit(t)).cast("int")
    return out
