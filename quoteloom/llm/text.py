"""Small helpers of the corpus operators: words, row keys, reading tables."""

from __future__ import annotations

import string
from collections.abc import Sequence
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quoteloom.session import durable

# White space as the contracts name it, and what separates letters-and-digits words.
SPACES = r"[\x20\x09-\x0D]+"
NOT_SPACES = r"[^\x20\x09-\x0D]+"
BETWEEN_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII texts take the fast path, where both ways agree."""
    slow = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(slow)


def row_key(*columns: str) -> list[Column]:
    """Two 64-bit hashes ``_k1, _k2`` that stand for a row's id and text; nulls are told from empty values.

    Rows equal in all the columns share a key: operators that join on it must give such rows equal results
    or aggregate them first.
    """
    seen = F.concat_ws("", *[F.col(c).isNull().cast("string") for c in columns])
    parts = [F.col(c) for c in columns]
    return [F.xxhash64(seen, *parts).alias("_k1"), F.xxhash64(F.lit(7), *reversed(parts), seen).alias("_k2")]


def sheltered(*needed: str):
    """For operators that return rows of their first argument: columns other than ``needed`` pass under names of their own,
    so that no name of the input can meet one that the operator uses inside."""

    def wrap(fn):
        @wraps(fn)
        def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
            hidden = {c: f"_pass{i}" for i, c in enumerate(docs.columns) if c not in needed}
            out = fn(docs.withColumnsRenamed(hidden), *args, **kwargs)
            return out.withColumnsRenamed({v: k for k, v in hidden.items()})

        return run

    return wrap


def free_name(name: str, taken: Sequence[str]) -> str:
    """``name``, with underscores before it as long as the input has a column of that name."""
    while name in taken:
        name = "_" + name
    return name


def positions(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Rows numbered from 0 in a global order: numbered inside range partitions, plus the sizes of earlier ones."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = {f"_o{i}": c for i, c in enumerate(order)}
    ranged = df.withColumns(keys).repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id())
    ranged = durable(ranged)  # the borders of the ranges hold for both uses
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(*keys)
    numbered = ranged.withColumn("_rn", F.row_number().over(inside)).join(starts, "_part")
    return numbered.withColumn(name, (F.col("_start") + F.col("_rn") - 1).cast("long")).drop("_part", "_rn", "_start", *keys)


def spread(df: DataFrame) -> DataFrame:
    """Deal small hot inputs over all tasks before a step that multiplies rows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def masks_of(width: int, radius: int) -> list[int]:
    """The 2^(radius+1) - 1 bit masks of covering hashing, as signed 64-bit numbers.

    Bit i gets a non-zero vector of radius + 1 bits; mask v keeps the bits whose vector has an odd product with v.
    The vectors of any ``radius`` bits span less than the whole space, so some v is orthogonal to all of them:
    its mask leaves those bits out, and two values that differ only there collide.
    """
    size = 1 << (radius + 1)
    vectors = [i % (size - 1) + 1 for i in range(width)]
    masks = [sum(1 << i for i in range(width) if bin(vectors[i] & v).count("1") & 1) for v in range(1, size)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]
