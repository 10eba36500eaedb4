"""Seeded, partition-independent randomness: every decision is a hash of a key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_key(seed: int, tag: str, *keys) -> Column:
    """Sort key ``md5('seed:tag:key[:key...]')``; equal in any SQL engine."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws(":", F.lit(f"{seed}:{tag}"), *[c.cast("string") for c in cols]).cast("binary"))


def u32(seed: int, tag: str, *keys) -> Column:
    """Uniform integer in [0, 2**32) as BIGINT."""
    return F.conv(F.substring(md5_key(seed, tag, *keys), 1, 8), 16, 10).cast("bigint")


def draw(n, seed: int, tag: str, *keys) -> Column:
    """Uniform integer in [0, n) for n < 2**31 (exact in BIGINT)."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.shiftright(u32(seed, tag, *keys) * n.cast("bigint"), 32)


def u64(seed: int, *keys) -> Column:
    """Fast non-portable 64-bit hash, for orders that no other engine must repeat."""
    return F.xxhash64(F.lit(seed), *keys)
