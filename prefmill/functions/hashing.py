"""Deterministic draws. Every random choice in the package is a hash of (seed, id), so a re-run, a lost executor or
another partition count gives the same rows."""

from pyspark.sql import Column, functions as F

SPACE = 1 << 32


def hash32(text: Column) -> Column:
    """First 32 bits of md5 as a bigint; the same value in any SQL engine with md5 and hex parsing."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def keyed(seed, *parts) -> Column:
    """hash32 of ``seed:part:part``."""
    cells = [p if isinstance(p, Column) else F.col(p) if isinstance(p, str) else F.lit(p) for p in parts]
    return hash32(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cells]))


def draw60(seed, *parts) -> Column:
    """First 60 bits of md5 of ``seed:part:part`` as a bigint: for draws from tables of any size."""
    cells = [p if isinstance(p, Column) else F.col(p) if isinstance(p, str) else F.lit(p) for p in parts]
    text = F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cells])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def uniform(seed, *parts) -> Column:
    """Uniform double in [0, 1)."""
    return keyed(seed, *parts) / F.lit(float(SPACE))
