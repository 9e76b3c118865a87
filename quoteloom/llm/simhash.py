"""Operator 1: SimHash near-dedup with covering hashing.

A document's fingerprint sums the bits of the hashes of its word shingles. Distinct fingerprints are hashed into
2^(radius+1) - 1 tables, one per bit mask (``masks_of``): every pair within the radius shares a bucket in some
table, so no link is missed. Links only have to connect, so a bucket gives a spanning forest, never its pairs:

* buckets of two are compared as they are counted (least and greatest member),
* buckets up to ``BUCKET`` members are compared inside one array,
* members of larger buckets are linked through the points of their half-radius balls: two values within
  the radius share a point, and all values that share a point are within the radius. The work is linear in the
  number of fingerprints, however large the bucket.

Exact copies share a fingerprint and cost one row from the first aggregation on.

Nulls and edge cases: a null or blank text has fingerprint zero and is linked like any other; a null doc_id never is
a component id unless all ids of the component are null; repeated rows each get their row; an empty table gives
an empty table; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteloom.llm.components import components
from quoteloom.llm.text import masks_of, row_key, sheltered
from quoteloom.session import durable

BUCKET = 256
_BLOCK = 1 << 15


def fingerprint(data: bytes | None, words_per_shingle: int = 4) -> int:
    """64-bit SimHash of a text's UTF-8 bytes as a signed number; each bit is set if set in over half the hashes."""
    words = (data or b"").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    k = min(words_per_shingle, len(words))
    n = len(words) - k + 1
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _BLOCK):  # a block bounds the memory of very long texts
        upto = min(n, at + _BLOCK)
        spans = zip(starts[at:upto].tolist(), ends[at + k - 1 : upto + k - 1].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], 42) for a, b in spans], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprint_column(text: Column, words_per_shingle: int = 4) -> Column:
    @F.pandas_udf("long")
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words_per_shingle) for t in texts], dtype="int64")

    return udf(text.cast("binary"))


def _forest(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """For each array of fingerprints, links that connect what chains within the radius connect."""
    for batch in batches:
        a, b = [], []
        for members in batch.column(0):
            v = np.sort(np.array(members.as_py(), np.int64).view(np.uint64))
            near = np.bitwise_count(v[:, None] ^ v[None, :]) <= radius
            label = np.arange(len(v))
            while True:
                new = np.where(near, label[None, :], len(v)).min(axis=1)
                if (new == label).all():
                    break
                label = new
            moved = label != np.arange(len(v))
            a.append(v[moved].view(np.int64))
            b.append(v[label[moved]].view(np.int64))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def links(fingerprints: DataFrame, radius: int = 4, bucket: int = BUCKET) -> DataFrame:
    """Pairs ``a, b`` of distinct fingerprints (column ``fp``) that connect every chain of values within the radius."""
    value = F.col("fp")
    keys = F.array(*[F.xxhash64(F.lit(v), value.bitwiseAND(F.lit(m))) for v, m in enumerate(masks_of(64, radius))])
    rows = fingerprints.select("fp", F.explode(keys).alias("bucket"))
    sizes = durable(
        rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1")
    )
    twos = sizes.filter((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b")
    some = rows.join(sizes.filter(f"n > 2 AND n <= {bucket}").select("bucket"), "bucket")
    lists = some.groupBy("bucket").agg(F.collect_list("fp").alias("members"))
    compared = lists.select("members").mapInArrow(lambda it: _forest(it, radius), "a long, b long")

    crowded = rows.join(sizes.filter(f"n > {bucket}").select("bucket"), "bucket").select("fp").distinct()
    half, rest = radius // 2, radius - radius // 2
    found = twos.union(compared)
    if sizes.filter(f"n > {bucket}").limit(1).count():
        found = found.union(_through_points(crowded, half, rest))
    return found


def _ball(radius: int) -> Column:
    flips = [0] + [sum(1 << i for i in bits) for r in range(1, radius + 1) for bits in combinations(range(64), r)]
    return F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in flips])


def _through_points(crowded: DataFrame, half: int, rest: int) -> DataFrame:
    """Links of values through shared points: one end lies within ``half`` of the point, the other within ``rest``."""
    near = F.transform(_ball(half), lambda m: m.bitwiseXOR(F.col("fp")))
    points = durable(crowded.repartition("fp").select("fp", F.explode(near).alias("point")))
    least = points.groupBy("point").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n"))
    if half == rest:
        return points.join(least.filter("n > 1"), "point").filter("fp != a").select("a", F.col("fp").alias("b"))
    # an odd radius: the farther ends meet every nearer end of their points through the least one
    far = F.transform(_ball(rest), lambda m: m.bitwiseXOR(F.col("fp")))
    farther = crowded.repartition("fp").select("fp", F.explode(far).alias("point"))
    same = points.join(least, "point").filter("fp != a").select("a", F.col("fp").alias("b"))
    return same.union(farther.join(least, "point").filter("fp != a").select("a", F.col("fp").alias("b")))


def near_duplicates(docs: DataFrame, radius: int = 4, words_per_shingle: int = 4, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, _k1, _k2, fp, root, component_id`` per row: documents with one ``root`` are near copies of each other."""
    narrow = durable(docs.select("doc_id", *row_key("doc_id", "text"), fingerprint_column(F.col("text"), words_per_shingle).alias("fp")))
    firsts = durable(narrow.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = durable(components(links(firsts.select("fp"), radius, bucket)))
    groups = firsts.join(roots.withColumnRenamed("node", "fp"), "fp").groupBy("root").agg(F.min("first_id").alias("least_id"))
    members = roots.join(groups, "root").withColumnRenamed("node", "fp")
    # written, so that the join below reads one exchange a side: adaptive execution then splits a fingerprint of many rows
    of = durable(
        firsts.join(members, "fp", "left").select(
            "fp",
            F.coalesce("root", "fp").alias("root"),
            F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("least_id")).alias("component_id"),
        )
    )
    return narrow.join(of, "fp")


@sheltered("doc_id", "text")
def keep_one(docs: DataFrame, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` without all but one of each group: the one with the least doc_id stays.

    Among rows of that id the one with the least row key stays; of rows equal in id and text, one.
    """
    found = near_duplicates(docs, radius)
    winner = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_k1", "_k2")).alias("w"))
    winners = winner.select("w._k1", "w._k2")
    kept = docs.select("*", *row_key("doc_id", "text")).join(winners, ["_k1", "_k2"], "left_semi")
    return kept.dropDuplicates(["_k1", "_k2"]).drop("_k1", "_k2")
