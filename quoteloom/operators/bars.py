"""Bars, sampling and continuity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoteloom.functions.timing import DAY, MINUTE, SECOND, cell, cell_start
from quoteloom.operators.ranks import exact_quantiles
from quoteloom.operators.scans import previous, row_index, with_tile


def bars_from_ticks(ticks: DataFrame, width: int = MINUTE) -> DataFrame:
    """OHLC of the mid, tick count, volume and mean spread per symbol and bucket.

    One aggregation that combines before its shuffle. A bar is complete when a later bar of the same
    UTC day exists, so the last bar of each day is not; the flag needs one small pass over bars.
    """
    at = F.struct("us", "seq")
    bars = ticks.groupBy("symbol", cell_start("us", width).alias("open_us")).agg(
        F.min_by("mid", at).alias("open"),
        F.max("mid").alias("high"),
        F.min("mid").alias("low"),
        F.max_by("mid", at).alias("close"),
        F.count(F.lit(1)).alias("ticks"),
        F.sum("volume").alias("volume"),
        F.avg("spread").alias("spread"),
    )
    return flag_complete(bars.withColumnRenamed("open_us", "us"))


def flag_complete(bars: DataFrame) -> DataFrame:
    """At most ``day / width`` bars share a (symbol, day), whatever the tick density."""
    day = Window.partitionBy("symbol", cell("us", DAY))
    return bars.withColumn("complete", F.col("us") < F.max("us").over(day))


def rollup_bars(bars: DataFrame, width: int) -> DataFrame:
    """Smaller bars to larger ones; the spread is weighted by tick count."""
    out = bars.groupBy("symbol", cell_start("us", width).alias("open_us")).agg(
        F.min_by("open", "us").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "us").alias("close"),
        F.sum("ticks").alias("ticks"),
        F.sum("volume").alias("volume"),
        (F.sum(F.col("spread") * F.col("ticks")) / F.sum("ticks")).alias("spread"),
    )
    return flag_complete(out.withColumnRenamed("open_us", "us"))


def rollup_complete(candles: DataFrame, step: int, factor: int, origin: int = 0) -> DataFrame:
    """Groups of exactly ``factor`` candles, aligned to ``origin``; groups with a hole are dropped."""
    width = step * factor
    start = cell_start(F.col("us") - origin, width) + origin
    out = candles.groupBy("symbol", start.alias("open_us")).agg(
        F.min_by("open", "us").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "us").alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("trades").alias("trades"),
        F.count_distinct("us").alias("_n"),
        F.count(F.lit(1)).alias("_rows"),
    )
    full = (F.col("_n") == factor) & (F.col("_rows") == factor)
    return out.filter(full).drop("_n", "_rows").withColumnRenamed("open_us", "us")


def rollup_closed(candles: DataFrame, step: int, factor: int, origin: int = 0) -> DataFrame:
    """As ``rollup_complete``, over candles already closed."""
    rows = candles.filter("closed") if "closed" in candles.columns else candles
    return rollup_complete(rows, step, factor, origin)


def second_bars(ticks: DataFrame, width: int = SECOND) -> DataFrame:
    """First quote of each active second and the number of its ticks."""
    at = F.struct("us", "seq")
    first = F.min_by(F.struct("us", "seq", "bid", "ask", "mid", "spread"), at)
    grouped = ticks.groupBy("symbol", cell("us", width).alias("_c")).agg(
        first.alias("f"), F.count(F.lit(1)).alias("ticks")
    )
    return grouped.select("symbol", "f.*", "ticks")


def sample_first(ticks: DataFrame, every: int, keys=("symbol",), order=("us", "seq")) -> DataFrame:
    """First row of each active bucket, as an aggregate that combines before its shuffle."""
    rest = [c for c in ticks.columns if c not in keys]
    grouped = ticks.groupBy(*keys, cell("us", every).alias("_c"))
    picked = grouped.agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("f"))
    return picked.select(*keys, "f.*")


def gaps(df: DataFrame, threshold: int, keys=("symbol",), order=("us", "seq"), tile: int = DAY) -> DataFrame:
    """Consecutive rows further apart than ``threshold``."""
    seen = previous(with_tile(df, width=tile), keys, order, {"after_us": "us"})
    wide = seen.filter(F.col("us") - F.col("after_us") > threshold)
    return wide.select(*keys, "after_us", F.col("us").alias("before_us"), (F.col("us") - F.col("after_us")).alias("gap_us"))


def time_grid(symbols: DataFrame, start_us: int, end_us: int, step: int) -> DataFrame:
    """Every expected grid time of every symbol, expanded in two steps (chunks, then times)."""
    chunk = step * 1440
    chunks = F.explode(F.sequence(F.lit(start_us), F.lit(end_us - 1), F.lit(chunk))).alias("_c")
    rows = symbols.select("symbol").distinct().select("symbol", chunks)
    last = F.least(F.col("_c") + chunk, F.lit(end_us)) - 1
    return rows.select("symbol", F.explode(F.sequence(F.col("_c"), last, F.lit(step))).alias("us"))


def missing_times(rows: DataFrame, symbols: DataFrame, start_us: int, end_us: int, step: int) -> DataFrame:
    present = rows.select("symbol", cell_start("us", step).alias("us")).distinct()
    return time_grid(symbols, start_us, end_us, step).join(present, ["symbol", "us"], "left_anti")


def continuity(rows: DataFrame, symbols: DataFrame, start_us: int, end_us: int, step: int) -> DataFrame:
    """Expected, present and missing grid times and the coverage of each symbol."""
    expected = len(range(start_us, end_us, step))
    inside = rows.filter((F.col("us") >= start_us) & (F.col("us") < end_us))
    present = inside.groupBy("symbol", cell("us", step).alias("_c")).agg(F.lit(1).alias("_p"))
    counts = present.groupBy("symbol").agg(F.count(F.lit(1)).alias("_present"))
    out = symbols.select("symbol").distinct().join(counts, "symbol", "left")
    got = F.coalesce("_present", F.lit(0))
    return out.select(
        "symbol",
        F.lit(expected).cast("long").alias("expected"),
        got.alias("present"),
        (F.lit(expected) - got).alias("missing"),
        (got * 100.0 / F.lit(expected)).alias("coverage_pct"),
    )


def missing_ranges(missing: DataFrame, step: int, tile: int = DAY) -> DataFrame:
    """Missing grid times as contiguous half-open ranges (gaps and islands)."""
    ranked = row_index(with_tile(missing, width=tile), ["symbol"], ["us"])
    island = (F.col("us") - F.col("rn") * step).alias("_island")
    return (
        ranked.groupBy("symbol", island)
        .agg(F.min("us").alias("start_us"), (F.max("us") + step).alias("end_us"), F.count(F.lit(1)).alias("n"))
        .drop("_island")
    )


def fetch_pages(missing: DataFrame, step: int, rows: int = 1000) -> DataFrame:
    """Span from the first to the last missing time, cut into pages of at most ``rows`` steps."""
    span = missing.groupBy("symbol").agg(F.min("us").alias("lo"), (F.max("us") + step).alias("hi"))
    starts = F.explode(F.sequence(F.col("lo"), F.col("hi") - 1, F.lit(step * rows))).alias("start_us")
    return span.select("symbol", starts, "hi").select(
        "symbol", "start_us", F.least(F.col("start_us") + step * rows, F.col("hi")).alias("end_us")
    )


def eligible_symbols(
    candles: DataFrame, start_us: int, end_us: int, step: int, coverage: float = 0.8, days: int = 60
) -> DataFrame:
    """Coverage and span of each symbol, with the reason of an exclusion."""
    expected = (end_us - start_us) // step
    inside = candles.filter((F.col("us") >= start_us) & (F.col("us") < end_us))
    stats = inside.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"), F.floor((F.max("us") - F.min("us")) / DAY).alias("span_days")
    )
    share = F.col("bars") / F.lit(expected)
    good = (share >= coverage) & (F.col("span_days") >= days)
    reason = F.when(~good, f"HISTORY_LT_{int(coverage * 100)}PCT_OR_{days}_DAYS")
    return stats.withColumns({"coverage": share, "eligible": good, "exclusion": reason})


def spread_stats(df: DataFrame, x: str = "spread", keys=("symbol",)) -> DataFrame:
    """Minimum, median, nearest-rank 95th percentile and maximum."""
    from quoteloom.operators.ranks import value_counts

    keys = list(keys)
    counted = value_counts(df, keys, x)
    total = counted.groupBy(*keys).agg(F.sum("n").alias("_t"))
    rank95 = F.greatest(F.ceil(F.col("_t") * 0.95), F.lit(1))
    tail = (
        counted.join(total, keys)
        .groupBy(*keys)
        .agg(F.min(x).alias("minimum"), F.max(x).alias("maximum"), F.min(F.when(F.col("upto") >= rank95, F.col(x))).alias("p95"))
    )
    return tail.join(exact_quantiles(df, keys, x, {"median": 0.5}), keys)


def missing_history(candles: DataFrame, symbols: DataFrame, expected: int, min_share: float = 0.98) -> DataFrame:
    """Symbols with fewer than the wanted share of expected rows."""
    counts = candles.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    have = F.coalesce("n", F.lit(0))
    out = symbols.select("symbol").distinct().join(counts, "symbol", "left")
    return out.filter(have < expected * min_share).select("symbol", have.alias("rows"))
