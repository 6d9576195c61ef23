"""Deterministic draws from md5, so that any SQL engine can repeat them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = 15


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def draw_token(seed, *keys) -> Column:
    """32 hex digits that depend on the seed and the keys only."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", seed.cast("string"), *[as_column(k).cast("string") for k in keys]))


def draw_int(seed, *keys) -> Column:
    """Uniform integer in [0, 16**15)."""
    return F.conv(F.substring(draw_token(seed, *keys), 1, HEX_DIGITS), 16, 10).cast("bigint")


def draw_below(n, seed, *keys) -> Column:
    """Uniform integer in [0, n)."""
    return F.pmod(draw_int(seed, *keys), as_column(n))
