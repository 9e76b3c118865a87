"""Bar features on weekly candles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quoteloom.catalog.registry import CANDLES, QUOTES, register, with_views
from quoteloom.functions.output import round_doubles
from quoteloom.functions.timing import HOUR, WEEK
from quoteloom.operators import bars as B
from quoteloom.operators import features as X
from quoteloom.sources.views import candles, quotes

TILE = 104 * WEEK
W = "OVER (PARTITION BY symbol ORDER BY us)"


def over(frame: str) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY us ROWS BETWEEN {frame})"


TR = f"""tr AS (SELECT *, row_number() {W} AS rn,
  greatest(high - low, abs(high - lag(close) {W}), abs(low - lag(close) {W})) AS tr FROM candles)"""
NUMBERED = f"n AS (SELECT *, row_number() {W} AS rn FROM candles)"


def ema_cte(name: str, source: str, x: str, span: int) -> str:
    a = 2 / (span + 1)
    return f"""{name} AS (
  SELECT symbol, us, rn, CAST({x} AS DOUBLE) AS e FROM {source} WHERE rn = 1
  UNION ALL
  SELECT s.symbol, s.us, s.rn, {a!r} * s.{x} + (1 - {a!r}) * p.e FROM {name} p
  JOIN {source} s ON s.symbol = p.symbol AND s.rn = p.rn + 1)"""


def recursive(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


def seeded_sql(x: str, period: int, source: str = "l") -> tuple[str, str]:
    """EMA over a list column ``l`` seeded by its first element, and the same without the last element."""
    a = 2 / (period + 1)
    now = f"list_reduce(l, lambda p, v: {a!r} * v + (1 - {a!r}) * p)"
    was = f"list_reduce(l[1:len(l) - 1], lambda p, v: {a!r} * v + (1 - {a!r}) * p)"
    return now, was


@register(
    "f1_visible_bars",
    with_views(
        QUOTES,
        f"""bars AS (SELECT symbol, us // {HOUR} * {HOUR} AS us, arg_max(mid, (us, seq)) AS close FROM quotes GROUP BY 1, 2)""",
        f"bc AS (SELECT *, us + {HOUR} AS close_us FROM bars)",
    )
    + """SELECT q.symbol, q.us, q.seq, b.us AS bar_us, round(b.close, 6) AS bar_close
    FROM quotes q ASOF LEFT JOIN bc b ON q.symbol = b.symbol AND q.us >= b.close_us""",
)
def f1(spark, d):
    q = quotes(spark, d)
    bars = X.close_time(B.bars_from_ticks(q, HOUR), HOUR)
    seen = X.visible_bars(q.select("symbol", "us", "seq"), bars, {"bar_us": "us", "bar_close": "close"})
    return round_doubles(seen)


@register(
    "f2_ema_seeded",
    with_views(CANDLES)
    + f""", l AS (SELECT symbol, us, list(close) {over('62 PRECEDING AND CURRENT ROW')} AS l FROM candles)
    SELECT symbol, us, round({seeded_sql('close', 5)[0]}, 6) AS ema,
      CASE WHEN len(l) > 1 THEN round({seeded_sql('close', 5)[0]} - {seeded_sql('close', 5)[1]}, 6) ELSE 0 END AS ema_slope
    FROM l""",
)
def f2(spark, d):
    out = X.ema_seeded(candles(spark, d), "close", 5, "ema", tile=TILE)
    return round_doubles(out.select("symbol", "us", "ema", "ema_slope"))


@register(
    "f3_ema_full",
    recursive(CANDLES, NUMBERED, ema_cte("e9", "n", "close", 9)) + "SELECT symbol, us, round(e, 6) AS ema FROM e9",
)
def f3(spark, d):
    return round_doubles(X.ema_full(candles(spark, d), "close", 9, "ema", tile=TILE).select("symbol", "us", "ema"))


@register(
    "f4_momentum",
    with_views(CANDLES)
    + f"""SELECT symbol, us, round(coalesce(close - lag(close, 3) {W}, 0), 6) AS momentum FROM candles""",
)
def f4(spark, d):
    return round_doubles(X.momentum(candles(spark, d), "close", 3, "momentum", tile=TILE).select("symbol", "us", "momentum"))


@register(
    "f5_atr_sma",
    with_views(CANDLES, TR)
    + f"SELECT symbol, us, round(avg(tr) {over('13 PRECEDING AND CURRENT ROW')}, 6) AS atr FROM tr",
)
def f5(spark, d):
    return round_doubles(X.atr_sma(candles(spark, d), tile=TILE).select("symbol", "us", "atr"))


@register(
    "f6_atr_ema",
    recursive(CANDLES, TR, ema_cte("e27", "tr", "tr", 27)) + "SELECT symbol, us, round(e, 6) AS atr FROM e27",
)
def f6(spark, d):
    return round_doubles(X.atr_ema(candles(spark, d), tile=TILE).select("symbol", "us", "atr"))


@register(
    "f7_range_regime",
    with_views(CANDLES, TR)
    + f""", a AS (SELECT *, avg(tr) {over('13 PRECEDING AND CURRENT ROW')} AS atr FROM tr),
      r AS (SELECT *, CASE WHEN atr > 0 THEN (high - low) / atr ELSE 0 END AS x FROM a)
    SELECT symbol, us, round(x, 6) AS range_atr, x <= 0.6 AS compression, x >= 1.5 AS expansion FROM r""",
)
def f7(spark, d):
    out = X.range_regime(X.atr_sma(candles(spark, d), tile=TILE))
    return round_doubles(out.select("symbol", "us", "range_atr", "compression", "expansion"))


@register(
    "f8_candle_shape",
    with_views(CANDLES)
    + f""", p AS (SELECT *, lag(open) {W} AS po, lag(close) {W} AS pc, high - low AS sp, abs(close - open) AS b,
        high - greatest(open, close) AS u, least(open, close) - low AS lo2 FROM candles)
    SELECT symbol, us, CASE WHEN sp = 0 THEN 0 ELSE round(b / sp, 6) END AS body_ratio,
      CASE WHEN sp = 0 THEN 0 ELSE round(u / sp, 6) END AS upper_wick,
      CASE WHEN sp = 0 THEN 0 ELSE round(lo2 / sp, 6) END AS lower_wick,
      CASE WHEN sp = 0 THEN NULL WHEN pc < po AND close > open AND open <= pc AND close >= po THEN 'BULLISH'
           WHEN pc > po AND close < open AND open >= pc AND close <= po THEN 'BEARISH' END AS engulfing,
      sp <> 0 AND lo2 >= b * 2 AND u <= greatest(b, sp * 0.1) AS hammer,
      sp <> 0 AND u >= b * 2 AND lo2 <= greatest(b, sp * 0.1) AS shooting_star FROM p""",
)
def f8(spark, d):
    out = X.candle_shape(candles(spark, d), tile=TILE)
    return round_doubles(
        out.select("symbol", "us", "body_ratio", "upper_wick", "lower_wick", "engulfing", "hammer", "shooting_star")
    )


STRUCT_SQL = f"""CASE WHEN lag(high, 2) {W} < lag(high) {W} AND lag(high) {W} < high
       AND lag(low, 2) {W} < lag(low) {W} AND lag(low) {W} < low THEN 'HH_HL'
     WHEN lag(high, 2) {W} > lag(high) {W} AND lag(high) {W} > high
       AND lag(low, 2) {W} > lag(low) {W} AND lag(low) {W} > low THEN 'LH_LL' ELSE 'MIXED' END"""


@register("f9_structure", with_views(CANDLES) + f"SELECT symbol, us, {STRUCT_SQL} AS structure FROM candles")
def f9(spark, d):
    return X.structure(candles(spark, d), tile=TILE).select("symbol", "us", "structure")


@register(
    "f10_levels",
    with_views(CANDLES, TR)
    + f""", a AS (SELECT *, avg(tr) {over('13 PRECEDING AND CURRENT ROW')} AS atr,
        min(low) {over('19 PRECEDING AND CURRENT ROW')} AS s, max(high) {over('19 PRECEDING AND CURRENT ROW')} AS r FROM tr)
    SELECT symbol, us, round(s, 6) AS support, round(r, 6) AS resistance,
      round(CASE WHEN atr > 0 THEN greatest((close - s) / atr, 0) ELSE 0 END, 6) AS support_distance,
      round(CASE WHEN atr > 0 THEN greatest((r - close) / atr, 0) ELSE 0 END, 6) AS resistance_distance FROM a""",
)
def f10(spark, d):
    b = X.blocks(candles(spark, d), 22, tile=TILE)
    out = X.core(X.levels(X.atr_sma(b)))
    return round_doubles(out.select("symbol", "us", "support", "resistance", "support_distance", "resistance_distance"))


@register(
    "f11_breakout_retest",
    with_views(CANDLES)
    + f""", h AS (SELECT *, max(high) {over('6 PRECEDING AND 2 PRECEDING')} AS r, min(low) {over('6 PRECEDING AND 2 PRECEDING')} AS s,
        count(*) {over('6 PRECEDING AND 2 PRECEDING')} AS n, lag(close) {W} AS pc FROM candles)
    SELECT symbol, us, CASE WHEN n = 5 AND pc > r AND low <= r AND close >= r THEN 'BULLISH'
      WHEN n = 5 AND pc < s AND high >= s AND close <= s THEN 'BEARISH' END AS breakout_retest FROM h""",
)
def f11(spark, d):
    return X.breakout_retest(candles(spark, d), tile=TILE).select("symbol", "us", "breakout_retest")


@register(
    "f12_trend_range_regime",
    with_views(CANDLES, TR)
    + f""", a AS (SELECT symbol, us, list(close) {over('62 PRECEDING AND CURRENT ROW')} AS l,
        avg(tr) {over('13 PRECEDING AND CURRENT ROW')} AS atr, {STRUCT_SQL} AS st FROM tr)
    SELECT symbol, us, CASE WHEN st <> 'MIXED' AND atr > 0 AND len(l) > 1
        AND abs({seeded_sql('close', 5)[0]} - {seeded_sql('close', 5)[1]}) >= atr * 0.05 THEN 'TREND' ELSE 'RANGE' END AS regime
    FROM a""",
)
def f12(spark, d):
    return X.m15_block(candles(spark, d), tile=TILE).select("symbol", "us", "regime")


EFF_SQL = f"""eff AS (SELECT n.symbol, n.us, n.rn, n.close, f.e AS fast, s.e AS slow,
    abs(n.close - lag(n.close) {W.replace('symbol', 'n.symbol').replace('us)', 'n.us)')}) AS step
  FROM n JOIN e9 f USING (symbol, rn) JOIN e21 s USING (symbol, rn)),
  eff2 AS (SELECT *, sum(step) {over('11 PRECEDING AND CURRENT ROW')} AS path, lag(close, 12) {W} AS far,
    lag(fast, 3) {W} AS fast3 FROM eff),
  eff3 AS (SELECT *, CASE WHEN path > 0 THEN abs(close - far) / path ELSE 0 END AS ef, abs(fast - slow) / close AS gap FROM eff2),
  reg AS (SELECT symbol, us, rn, CASE WHEN rn <= 21 THEN 'UNKNOWN'
     WHEN ef >= 0.35 AND gap >= 0.0005 AND fast > slow AND fast > fast3 THEN 'TREND_UP'
     WHEN ef >= 0.35 AND gap >= 0.0005 AND fast < slow AND fast < fast3 THEN 'TREND_DOWN' ELSE 'RANGE' END AS regime FROM eff3)"""


@register(
    "f13_efficiency_regime",
    recursive(CANDLES, NUMBERED, ema_cte("e9", "n", "close", 9), ema_cte("e21", "n", "close", 21), EFF_SQL)
    + "SELECT symbol, us, regime FROM reg",
)
def f13(spark, d):
    return X.efficiency_regime(candles(spark, d), tile=TILE).select("symbol", "us", "regime")


@register(
    "f14_rolling",
    with_views(CANDLES, NUMBERED)
    + f"""SELECT symbol, us, CASE WHEN rn >= 20 THEN round(avg(close) {over('19 PRECEDING AND CURRENT ROW')}, 6) END AS mean,
      CASE WHEN rn >= 20 THEN round(stddev_samp(close) {over('19 PRECEDING AND CURRENT ROW')}, 6) END AS std,
      CASE WHEN rn >= 20 THEN round(median(close) {over('19 PRECEDING AND CURRENT ROW')}, 6) END AS median FROM n""",
)
def f14(spark, d):
    b = X.blocks(candles(spark, d), 20, tile=TILE)
    for stat in ("mean", "std", "median"):
        b = X.rolling(b, "close", 20, stat, stat)
    return round_doubles(X.core(b).select("symbol", "us", "mean", "std", "median"))


RS_STEPS, RS_DAY, RS_LEAST = (1, 2, 4, 8), 26, 40
RS_SQL = f"""rs AS (SELECT t.symbol, t.us, t.rn, t.close, e.e AS atr, e.e / t.close * 100 AS atr_pct, t.volume, t.trades, t.open
    FROM tr t JOIN e27 e USING (symbol, rn)),
  rs1 AS (SELECT *, abs(close - lag(close) {W}) AS step, count(*) OVER (PARTITION BY symbol) AS bars FROM rs),
  rs2 AS (SELECT *, close / lag(close, 1) {W} - 1 AS return_15m, close / lag(close, 2) {W} - 1 AS return_30m,
    close / lag(close, 4) {W} - 1 AS return_1h, close / lag(close, 8) {W} - 1 AS return_4h,
    close / lag(close, {RS_DAY}) {W} - 1 AS return_24h,
    median(volume) {over(f'{RS_DAY} PRECEDING AND 1 PRECEDING')} AS vm, median(trades) {over(f'{RS_DAY} PRECEDING AND 1 PRECEDING')} AS tm,
    sum(step) {over('7 PRECEDING AND CURRENT ROW')} AS path, lag(close, 8) {W} AS far,
    list(atr_pct) {over(f'{RS_DAY} PRECEDING AND 1 PRECEDING')} AS hist FROM rs1),
  feat AS (SELECT symbol, us, open, close, atr, return_15m, return_30m, return_1h, return_4h, return_24h,
    CASE WHEN vm > 0 THEN volume / vm ELSE 0 END AS volume_relative,
    CASE WHEN tm > 0 THEN trades / tm ELSE 0 END AS activity_relative,
    len(list_filter(hist, lambda v: v <= atr_pct)) / {float(RS_DAY)} AS atr_percentile,
    CASE WHEN path > 0 THEN abs(close - far) / path ELSE 0 END AS trend_efficiency, atr_pct * 2 AS expected_move_pct
  FROM rs2 WHERE rn > {RS_DAY} AND rn < bars AND bars >= {RS_LEAST})"""
RS_COLS = (
    "atr", "return_15m", "return_30m", "return_1h", "return_4h", "return_24h", "volume_relative",
    "activity_relative", "atr_percentile", "trend_efficiency", "expected_move_pct",
)
RS_CTES = (CANDLES, TR, ema_cte("e27", "tr", "tr", 27), RS_SQL)


def strength(spark, d, bars=None):
    return X.closed_strength(candles(spark, d) if bars is None else bars, least=RS_LEAST, steps=RS_STEPS, day=RS_DAY, tile=TILE)


@register(
    "f15_relative_strength",
    recursive(*RS_CTES) + "SELECT symbol, us, " + ", ".join(f"round({c}, 6) AS {c}" for c in RS_COLS) + " FROM feat",
)
def f15(spark, d):
    return round_doubles(strength(spark, d).select("symbol", "us", *RS_COLS))


@register(
    "f16_warmup_flags",
    with_views(CANDLES, NUMBERED)
    + "SELECT symbol, us, least(rn, 63) AS available, 14 AS required, least(rn, 63) >= 14 AS warm FROM n",
)
def f16(spark, d):
    out = X.warmup_flags(X.m15_block(candles(spark, d), tile=TILE), 14)
    return out.select("symbol", "us", F.col("available").cast("long").alias("available"), "required", "warm")
