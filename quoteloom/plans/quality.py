"""Quality report of collected ticks: what was asked for, what came, what is kept."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteloom.functions.timing import cell
from quoteloom.operators import bars as B
from quoteloom.session import durable
from quoteloom.sources.tables import first_wins, tick_status


def quality_report(ticks: DataFrame, start_us: int, end_us: int, identity, gap_us: int, point: float, frames: dict[str, int]) -> DataFrame:
    """One row per symbol: requested and covered range, counts by fate, gaps wider than ``gap_us``, spread statistics in points, bars per frame.

    Accepted is the first of each identity among the valid ticks in range; everything behind the counts looks at accepted ticks only.
    """
    marked = durable(ticks.withColumn("_status", tick_status(start_us, end_us)))
    one = F.col("_status") == "candidate"
    counted = marked.groupBy(*identity, "_status").agg(F.count(F.lit(1)).alias("_n"))
    fates = counted.groupBy("symbol").agg(
        F.sum("_n").alias("source_rows"),
        F.count_if(one).alias("accepted"),
        F.coalesce(F.sum(F.when(one, F.col("_n") - 1)), F.lit(0)).alias("duplicate"),
        *[F.coalesce(F.sum(F.when(F.col("_status") == s, F.col("_n"))), F.lit(0)).alias(s) for s in ("invalid", "out_of_range")],
    )
    kept = durable(first_wins(marked.filter(one).drop("_status"), list(identity), F.col("seq")))
    covered = kept.groupBy("symbol").agg(F.min("us").alias("covered_start_us"), F.max("us").alias("covered_end_us"))
    wide = B.gaps(kept, gap_us).groupBy("symbol").agg(F.count(F.lit(1)).alias("gaps"), F.max("gap_us").alias("widest_gap_us"))
    spread = B.spread_stats(kept.withColumn("spread_points", (F.col("ask") - F.col("bid")) / point), "spread_points")
    spread = spread.withColumnsRenamed({n: f"spread_{n}" for n in ("minimum", "median", "p95", "maximum")})
    kinds = F.explode(F.array(*[F.struct(F.lit(n).alias("frame"), cell("us", w).alias("at")) for n, w in frames.items()])).alias("_b")
    bars = kept.select("symbol", kinds).select("symbol", "_b.*").distinct().groupBy("symbol").agg(*[F.count_if(F.col("frame") == n).alias(f"bars_{n}") for n in frames])
    out = reduce(lambda a, b: a.join(b, "symbol", "left"), (covered, wide, spread, bars), fates)
    return out.withColumns({"requested_start_us": F.lit(start_us), "requested_end_us": F.lit(end_us), "gaps": F.coalesce("gaps", F.lit(0))})
