"""Rounding at output only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteloom.functions.timing import col


def rounded(x, digits: int = 6) -> Column:
    """Half away from zero on the binary value, as SQL engines round doubles."""
    scale = float(10**digits)
    c = col(x).cast("double")
    return F.signum(c) * F.floor(F.abs(c) * scale + 0.5) / scale


def round_columns(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: rounded(n, digits) for n in names})


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column."""
    return round_columns(df, *[n for n, t in df.dtypes if t in ("double", "float")], digits=digits)
