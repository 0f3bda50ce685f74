"""Deterministic pseudo-random numbers from ids.

Every random choice in the engine (splits, subsamples, candidate draws,
weighted tuple draws) is a pure function of ``(seed, ids)``: results do not
depend on partitioning, executor loss or re-execution.

The uniform is ``first 13 hex digits of md5("seed:id1:id2...") / 2^52`` (52 bits, so every position of a pool of up to 4e15 rows
can be drawn), which DuckDB reproduces as ``('0x' || substr(md5(...), 1, 13))::BIGINT / 4503599627370496``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _key(seed, *cols) -> Column:
    parts = [F.lit(str(seed))] + [F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
                                  for c in cols]
    return F.concat_ws(":", *parts)


def uniform(seed, *cols) -> Column:
    """Uniform double in [0, 1) from md5 of ``seed:col1:col2...``."""
    return F.conv(F.substring(F.md5(_key(seed, *cols)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def uniform_sql(seed, *exprs: str) -> str:
    """The same uniform as a DuckDB SQL expression (for oracle strings)."""
    inner = " || ':' || ".join([f"'{seed}'"] + [f"CAST({e} AS VARCHAR)" for e in exprs])
    return f"(('0x' || substr(md5({inner}), 1, 13))::BIGINT / {float(1 << 52)!r})"


def hash_order(seed, *cols) -> Column:
    """Sort key for seeded shuffles: the uniform itself (ties broken by id by callers)."""
    return uniform(seed, *cols)


def bucket(col, n: int) -> Column:
    """Stable hash bucket in [0, n) for salting and block assignment."""
    c = F.col(col) if isinstance(col, str) else col
    return F.pmod(F.xxhash64(c), F.lit(int(n)))
