"""Deterministic pseudo-random draws from a hash, reproducible in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_number(*parts) -> Column:
    """28-bit integer from the md5 of the parts joined by a colon."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")


def hash_uniform(*parts) -> Column:
    """Uniform in [0, 1)."""
    return hash_number(*parts) / F.lit(float(1 << 28))
