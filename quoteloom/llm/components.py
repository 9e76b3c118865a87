"""Connected components of an edge table by alternating stars.

After Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Each round is two grouped
aggregations with their joins; the edge table never grows, is written to the shared folder once a round, and is
only counted, never collected. A node with very many neighbours is one row per map task in the aggregation
and a skewed join side that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteloom.session import durable


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges come as (larger, smaller) node."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()


def components(edges: DataFrame) -> DataFrame:
    """Rows ``node, root`` for every node of ``edges`` (columns a, b); root is the smallest node reachable.

    Loops and repeated edges do no harm; an empty table gives an empty table; edges with a null end are left out.
    """
    now = durable(
        edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = _state(now)
    while before[0]:
        now = durable(_small_star(durable(_large_star(now))))
        after = _state(now)
        if tuple(after) == tuple(before):
            break
        before = after
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
