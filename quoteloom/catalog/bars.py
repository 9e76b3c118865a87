"""Bars, sampling and continuity on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quoteloom.catalog.ingest import END, R6, START
from quoteloom.catalog.registry import CANDLES, QUOTES, register, with_views
from quoteloom.functions.output import round_columns as rounded
from quoteloom.functions.timing import DAY, HOUR, WEEK
from quoteloom.operators import bars as B
from quoteloom.sources.views import candles, quotes, table

MONDAY = 4 * DAY  # 1970-01-05, so that multi-week groups start on Mondays
BARS_SQL = f"""bars AS (
  SELECT symbol, us // {HOUR} * {HOUR} AS us, arg_min(mid, (us, seq)) AS open, max(mid) AS high, min(mid) AS low,
    arg_max(mid, (us, seq)) AS close, count(*) AS ticks, sum(volume) AS volume, avg(spread) AS spread
  FROM quotes GROUP BY symbol, us // {HOUR} * {HOUR})"""
ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in ("open", "high", "low", "close", "volume", "spread"))


OHLCVS = ("open", "high", "low", "close", "volume", "spread")


@register(
    "b1_bars_from_ticks",
    with_views(QUOTES, BARS_SQL)
    + f"""SELECT symbol, us, {ROUNDED}, ticks,
      us < max(us) OVER (PARTITION BY symbol, us // {DAY}) AS complete FROM bars""",
)
def b1(spark, d):
    return rounded(B.bars_from_ticks(quotes(spark, d), HOUR), *OHLCVS)


@register(
    "b2_rollup_bars",
    with_views(QUOTES, BARS_SQL)
    + f""", r AS (SELECT symbol, us // {6 * HOUR} * {6 * HOUR} AS us, arg_min(open, us) AS open, max(high) AS high,
      min(low) AS low, arg_max(close, us) AS close, CAST(sum(ticks) AS BIGINT) AS ticks, sum(volume) AS volume,
      sum(spread * ticks) / sum(ticks) AS spread FROM bars GROUP BY symbol, us // {6 * HOUR} * {6 * HOUR})
    SELECT symbol, us, {ROUNDED}, ticks, us < max(us) OVER (PARTITION BY symbol, us // {DAY}) AS complete FROM r""",
)
def b2(spark, d):
    return rounded(B.rollup_bars(B.bars_from_ticks(quotes(spark, d), HOUR), 6 * HOUR), *OHLCVS)


def _roll_sql(n):
    w = n * WEEK
    return (
        with_views(CANDLES)
        + f"""SELECT symbol, (us - {MONDAY}) // {w} * {w} + {MONDAY} AS us, round(arg_min(open, us), 6) AS open,
      round(max(high), 6) AS high, round(min(low), 6) AS low, round(arg_max(close, us), 6) AS close,
      round(sum(volume), 6) AS volume, CAST(sum(trades) AS BIGINT) AS trades
    FROM candles GROUP BY symbol, (us - {MONDAY}) // {w} * {w} + {MONDAY} HAVING count(*) = {n}"""
    )


@register("b3_rollup_complete", _roll_sql(4))
def b3(spark, d):
    return rounded(B.rollup_complete(candles(spark, d), WEEK, 4, MONDAY), *OHLCVS[:5])


@register("b4_rollup_closed", _roll_sql(2))
def b4(spark, d):
    return rounded(B.rollup_closed(candles(spark, d).withColumn("closed", F.lit(True)), WEEK, 2, MONDAY), *OHLCVS[:5])


@register(
    "b5_second_bars",
    with_views(QUOTES)
    + f"""SELECT symbol, min(us) AS us, arg_min(seq, (us, seq)) AS seq, round(arg_min(mid, (us, seq)), 6) AS mid,
      count(*) AS ticks FROM quotes GROUP BY symbol, us // {HOUR}""",
)
def b5(spark, d):
    return B.second_bars(quotes(spark, d), HOUR).select("symbol", "us", "seq", R6("mid").alias("mid"), "ticks")


@register(
    "b6_sample_first",
    with_views(QUOTES)
    + f"""SELECT symbol, us, seq, round(bid, 6) AS bid FROM quotes
    QUALIFY row_number() OVER (PARTITION BY symbol, us // {HOUR} ORDER BY us, seq) = 1""",
)
def b6(spark, d):
    return B.sample_first(quotes(spark, d), HOUR).select("symbol", "us", "seq", R6("bid").alias("bid"))


@register(
    "b7_gaps",
    with_views(QUOTES)
    + f"""SELECT symbol, p AS after_us, us AS before_us, us - p AS gap_us FROM (
      SELECT symbol, us, lag(us) OVER (PARTITION BY symbol ORDER BY us, seq) AS p FROM quotes) WHERE us - p > {HOUR}""",
)
def b7(spark, d):
    return B.gaps(quotes(spark, d), HOUR)


@register(
    "b8_continuity",
    with_views(QUOTES)
    + f"""SELECT symbol, 720 AS expected, count(DISTINCT us // {HOUR}) AS present, 720 - count(DISTINCT us // {HOUR}) AS missing,
      round(count(DISTINCT us // {HOUR}) * 100.0 / 720, 6) AS coverage_pct FROM quotes GROUP BY symbol""",
)
def b8(spark, d):
    q = quotes(spark, d)
    return rounded(B.continuity(q, q.select("symbol"), START, END, HOUR), "coverage_pct")


MISSING_SQL = f"""miss AS (
  SELECT s.symbol, {START} + h * {HOUR} AS us FROM (SELECT DISTINCT symbol FROM quotes) s, range(720) t(h)
  WHERE (s.symbol, {START} + h * {HOUR}) NOT IN (SELECT symbol, us // {HOUR} * {HOUR} FROM quotes))"""


@register(
    "b9_missing_ranges",
    with_views(QUOTES, MISSING_SQL)
    + f"""SELECT symbol, min(us) AS start_us, max(us) + {HOUR} AS end_us, count(*) AS n FROM (
      SELECT *, us - row_number() OVER (PARTITION BY symbol ORDER BY us) * {HOUR} AS isl FROM miss)
    GROUP BY symbol, isl""",
)
def b9(spark, d):
    q = quotes(spark, d)
    return B.missing_ranges(B.missing_times(q, q, START, END, HOUR), HOUR)


@register(
    "b9_fetch_pages",
    with_views(QUOTES, MISSING_SQL)
    + f""", s AS (SELECT symbol, min(us) AS lo, max(us) + {HOUR} AS hi FROM miss GROUP BY symbol)
    SELECT symbol, lo + k * {100 * HOUR} AS start_us, least(lo + (k + 1) * {100 * HOUR}, hi) AS end_us
    FROM s, range(8) t(k) WHERE lo + k * {100 * HOUR} < hi""",
)
def b9_pages(spark, d):
    q = quotes(spark, d)
    return B.fetch_pages(B.missing_times(q, q, START, END, HOUR), HOUR, 100)


C_START, C_END = 694_224_000_000_000, 915_148_800_000_000  # 1992-01-01 to 1999-01-01


@register(
    "b10_eligible_symbols",
    with_views(CANDLES)
    + f""", s AS (SELECT symbol, count(*) AS bars, (max(us) - min(us)) // {DAY} AS span_days FROM candles
      WHERE us >= {C_START} AND us < {C_END} GROUP BY symbol)
    SELECT symbol, bars, span_days, round(bars / {(C_END - C_START) // WEEK}, 6) AS coverage,
      bars / {(C_END - C_START) // WEEK} >= 0.8 AND span_days >= 60 AS eligible,
      CASE WHEN bars / {(C_END - C_START) // WEEK} >= 0.8 AND span_days >= 60 THEN NULL
           ELSE 'HISTORY_LT_80PCT_OR_60_DAYS' END AS exclusion FROM s""",
)
def b10(spark, d):
    return rounded(B.eligible_symbols(candles(spark, d), C_START, C_END, WEEK), "coverage")


@register(
    "b11_spread_stats",
    with_views(QUOTES)
    + """, s AS (SELECT symbol, round(spread, 9) AS spread, row_number() OVER (PARTITION BY symbol ORDER BY spread) AS r,
        count(*) OVER (PARTITION BY symbol) AS n FROM quotes)
    SELECT symbol, round(min(spread), 6) AS minimum, round(median(spread), 6) AS median,
      round(min(CASE WHEN r >= ceil(n * CAST(0.95 AS DOUBLE)) THEN spread END), 6) AS p95,
      round(max(spread), 6) AS maximum FROM s GROUP BY symbol""",
)
def b11(spark, d):
    q = quotes(spark, d).withColumn("spread", F.round("spread", 9))
    return rounded(B.spread_stats(q), "minimum", "median", "p95", "maximum")


@register(
    "b12_missing_history",
    with_views(CANDLES)
    + f"""SELECT s_suppkey AS symbol, count(us) AS rows FROM supplier LEFT JOIN candles ON symbol = s_suppkey
    GROUP BY 1 HAVING count(us) < {(C_END - C_START) // WEEK} * 0.8""",
)
def b12(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol"))
    return B.missing_history(candles(spark, d), s, (C_END - C_START) // WEEK, 0.8)
