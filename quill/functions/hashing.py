"""Seeded, order-free randomness as column expressions.

Every random choice in the library is a function of ``(seed, row id)`` so a
recomputed task (lost executor, speculative copy) produces the same answer and
the DuckDB oracle can reproduce it.

Fixed definitions (shared with the SQL oracles):
  hash     = md5('<seed>:' || id)
  uniform  = (int(first 13 hex digits of hash) + 0.5) / 2^52, 0 < u < 1
  gaussian = sqrt(-2 ln u(seed)) * cos(2 pi u(seed + 1))   (Box-Muller)

Repeatable noise is for tests only; DP releases pass ``seed=None``, which uses
``randn()`` seeded by Spark.  Floating-point noise is not hardened against
side-channel attacks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_52 = float(2 ** 52)


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_hex(seed, *ids) -> Column:
    """md5 over ``'<seed>:' || id1 [|| ':' || id2 ...]`` as 32 lowercase hex chars."""
    parts = [F.lit(f"{seed}:")]
    for i, c in enumerate(ids):
        if i:
            parts.append(F.lit(":"))
        parts.append(_as_col(c).cast("string"))
    return F.md5(F.concat(*parts))


def hash_bucket(h: Column, digits: int = 4) -> Column:
    """Leading hex digits of a hash: an order-preserving bucket of the hash order."""
    return F.substring(h, 1, digits)


def uniform(seed, *ids) -> Column:
    """Deterministic U(0,1) from the first 52 bits of the hash."""
    h = hash_hex(seed, *ids)
    x = F.conv(F.substring(h, 1, 13), 16, 10).cast("double")
    return (x + F.lit(0.5)) / F.lit(_TWO_52)


def gaussian(seed, *ids) -> Column:
    """Standard normal draw; ``seed=None`` gives Spark's ``randn`` (production)."""
    if seed is None:
        return F.randn()
    u1 = uniform(seed, *ids)
    u2 = uniform(int(seed) + 1, *ids)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
