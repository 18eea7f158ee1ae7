"""Deterministic per-row randomness.

`rand()` is re-drawn when a task is retried, so nothing that must reproduce
uses it. A uniform number in [0, 1) comes from a hash of stable keys instead.

Two modes:
  "xxhash64"  fast, JVM-side; the default for production runs.
  "md5"       the first 15 hex digits (60 bits) of md5 over the keys joined by
              '|'. Slower, but any SQL engine with md5 computes the very same
              numbers, so results can be checked against an independent oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = float(2**32)
TWO_53 = float(2**53)


def _cols(keys) -> list[Column]:
    return [k if isinstance(k, Column) else F.lit(k) for k in keys]


def hash_bits(*keys, mode: str = "xxhash64") -> Column:
    """Non-negative BIGINT hash of the keys (53 bits for xxhash64, 60 for md5)."""
    cols = _cols(keys)
    if mode == "xxhash64":
        return F.shiftrightunsigned(F.xxhash64(*cols), 11)
    if mode == "md5":
        joined = F.concat_ws("|", *[c.cast("string") for c in cols])
        return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("bigint")
    raise ValueError(f"unknown hash mode {mode!r}")


def uniform(*keys, mode: str = "xxhash64") -> Column:
    """A DOUBLE in [0, 1) that depends only on the keys (53 bits, exact as a double)."""
    bits = hash_bits(*keys, mode=mode)
    return (bits if mode == "xxhash64" else F.shiftright(bits, 7)) / F.lit(TWO_53)


def uniform_int(*keys, upper: Column | int, mode: str = "xxhash64") -> Column:
    """A BIGINT in [0, upper) that depends only on the keys."""
    up = upper if isinstance(upper, Column) else F.lit(upper)
    return F.pmod(hash_bits(*keys, mode=mode), up.cast("bigint"))


def below(*keys, p: float, mode: str = "xxhash64") -> Column:
    """uniform(*keys) < p without the division.

    md5 mode compares the first 15 hex digits as text with the hex form of
    ceil(p * 2^53) * 2^7: the digests are fixed-width lowercase hex, so text
    order is numeric order.
    """
    import math

    if mode == "md5":
        limit = min(max(math.ceil(p * TWO_53), 0), 2**53)
        if limit >= 2**53:
            return F.lit(True)
        joined = F.concat_ws("|", *[c.cast("string") for c in _cols(keys)])
        return F.substring(F.md5(joined), 1, 15) < F.lit(format(limit << 7, "015x"))
    limit = min(max(math.ceil(p * TWO_53), 0), 2**53)
    return hash_bits(*keys, mode=mode) < F.lit(limit)
