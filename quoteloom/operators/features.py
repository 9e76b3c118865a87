"""Point-in-time bar features.

A feature of a bar uses that bar and earlier ones; it becomes visible at the bar's close. All functions
accept a plain bar table or one already cut into row blocks; composing several on one blocked table
costs a single pass. Frames count rows, so blocks carry as many earlier rows as the longest frame.
"""

from __future__ import annotations

import math
from functools import wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoteloom.functions.timing import WEEK
from quoteloom.operators.joins import asof_backward
from quoteloom.operators.paths import TrailingQuantile, TrailingRank, along_path
from quoteloom.operators.scans import affine_carry, block_window, core, prefix_scan, row_blocks, row_index, with_tile
from quoteloom.session import durable

KEYS = ("symbol",)
VISIBLE = 63  # closed bars an observation can see
BLOCK = 512
RANK_ROWS = 65_536  # rows of a tile whose windows are ranked together


def blocks(bars: DataFrame, back: int, keys=KEYS, tile: int = 4 * WEEK, ahead: int = 0) -> DataFrame:
    return row_blocks(with_tile(bars, width=tile), list(keys), ["us"], back, ahead, rows=BLOCK)


def per_series(back):
    """Run a feature on row blocks; ``back`` is the look-back in rows or a function of the arguments."""

    def wrap(fn):
        @wraps(fn)
        def run(df: DataFrame, *args, keys=KEYS, tile: int = 4 * WEEK, **kwargs) -> DataFrame:
            if "_block" in df.columns:
                return fn(df, block_window(keys), *args, **kwargs)
            need = back(*args, **kwargs) if callable(back) else back
            out = fn(blocks(df, need, keys, tile), block_window(keys), *args, **kwargs)
            return core(out).drop("rn", "_tile")

        return run

    return wrap


def _position(w) -> Column:
    return F.row_number().over(w) - 1


def ema_columns(df: DataFrame, averages: dict[str, tuple[str, int]], keys=KEYS, tile: int = 4 * WEEK, block: int = BLOCK, fan: int = 1024) -> DataFrame:
    """Exponential averages over the whole history, seeded by the first value, for several ``name: (column, span)`` in one scan.

    A row maps the average before it to ``q * e + a * x``. Inside a block of rows the maps are summed with weights
    ``q**(t - i)``; a block as a whole is again such a map, and ``affine_carry`` composes the blocks before it. Nothing is cut off:
    a weight only vanishes where it falls below the least double.
    """
    keys = list(keys)
    q = {n: 1 - 2 / (span + 1) for n, (_, span) in averages.items()}
    plain = {n: F.col(x) for n, (x, _) in averages.items() if q[n] == 0}
    scanned = [n for n in averages if q[n] != 0]
    if not scanned:
        return df.withColumns(plain)
    # inside a block the inverse weights must stay in range
    block = max(1, min([block, *[int(200 * math.log(10) / -math.log(q[n])) for n in scanned]]))
    given = {"rn", "_tile"} & set(df.columns)
    ranked = df if "rn" in given else row_index(with_tile(df, width=tile), keys, ["us"])
    ranked = ranked.withColumn("_b", F.floor((F.col("rn") - 1) / block).cast("long"))
    j = F.col("rn") - 1 - F.col("_b") * block
    up = Window.partitionBy(*keys, "_b").orderBy("rn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {}
    for n in scanned:
        weight = F.when(F.col("rn") == 1, F.lit(1.0)).otherwise(F.lit(1 - q[n]))
        inner = F.sum(weight * F.col(averages[n][0]) * F.pow(F.lit(q[n]), -j)).over(up)
        sums[f"_l_{n}"] = F.pow(F.lit(q[n]), j) * inner
    rows = durable(ranked.withColumns(sums | plain))
    last = F.max(F.struct("rn", *[f"_l_{n}" for n in scanned])).alias("_last")
    ends = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"), last)
    count = (rows.agg(F.max("_b")).first()[0] or 0) + 1
    maps = [m for n in scanned for m in (F.pow(F.lit(q[n]), F.col("_n")).alias(f"_a_{n}"), F.coalesce(F.col(f"_last._l_{n}"), F.lit(0.0)).alias(f"_b_{n}"))]
    if count > 1:
        carried = affine_carry(ends.select(*keys, "_b", *maps), keys, "_b", scanned, count, fan)
        rows = rows.join(carried, [*keys, "_b"])
        rows = rows.withColumns({n: F.coalesce(F.col(f"_l_{n}"), F.lit(0.0)) + F.pow(F.lit(q[n]), j + 1) * F.col(f"_in_{n}") for n in scanned})
    else:
        rows = rows.withColumns({n: F.col(f"_l_{n}") for n in scanned})
    return rows.drop("_b", *[f"_l_{n}" for n in scanned], *[f"_in_{n}" for n in scanned], *({"rn", "_tile"} - given))


def ema_full(df: DataFrame, x: str, span: int, name: str, keys=KEYS, tile: int = 4 * WEEK) -> DataFrame:
    """Exponential average over the whole history, seeded by the first value."""
    return ema_columns(df, {name: (x, span)}, keys, tile)


@per_series(lambda x, period, name, depth=VISIBLE: depth)
def ema_seeded(df: DataFrame, w, x: str, period: int, name: str, depth: int = VISIBLE) -> DataFrame:
    """Average over the last ``depth`` values, seeded by the oldest of them; also its last change.

    Adds ``name`` and ``name_slope`` (against the same window without its last value, 0 if alone).
    """
    a = 2 / (period + 1)
    q = 1 - a
    here = w.rowsBetween(-(depth - 1), 0)
    before = w.rowsBetween(-(depth - 1), -1)
    df = df.withColumn("_j", _position(w))
    df = df.withColumn("_wx", F.col(x) * F.pow(F.lit(q), -F.col("_j")))
    df = df.withColumns(
        {
            "_m": F.count(x).over(here) - 1,
            "_s": F.sum("_wx").over(here),
            "_b": F.sum("_wx").over(before),
            "_f": F.first(x).over(here),
        }
    )
    scale = F.pow(F.lit(q), F.col("_j"))
    now = a * scale * F.col("_s") + (1 - a) * F.pow(F.lit(q), F.col("_m")) * F.col("_f")
    was = a * scale / q * F.col("_b") + (1 - a) * F.pow(F.lit(q), F.col("_m") - 1) * F.col("_f")
    slope = F.when(F.col("_m") >= 1, now - was).otherwise(F.lit(0.0))
    return df.withColumns({name: now, f"{name}_slope": slope}).drop("_j", "_wx", "_m", "_s", "_b", "_f")


@per_series(lambda x, k, name: k)
def momentum(df: DataFrame, w, x: str, k: int, name: str) -> DataFrame:
    """Change over ``k`` bars, 0 when the history is too short."""
    return df.withColumn(name, F.coalesce(F.col(x) - F.lag(x, k).over(w), F.lit(0.0)))


@per_series(1)
def true_range(df: DataFrame, w, name: str = "true_range") -> DataFrame:
    prev = F.lag("close").over(w)
    value = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    return df.withColumn(name, value)


@per_series(lambda period=14, name="atr": period + 1)
def atr_sma(df: DataFrame, w, period: int = 14, name: str = "atr") -> DataFrame:
    """Mean of the last true ranges."""
    df = true_range(df, name="_tr")
    return df.withColumn(name, F.avg("_tr").over(w.rowsBetween(-(period - 1), 0))).drop("_tr")


def atr_ema(df: DataFrame, period: int = 14, name: str = "atr", keys=KEYS, tile: int = 4 * WEEK) -> DataFrame:
    """True range smoothed over the whole history by an average of span ``2 * period - 1``."""
    return ema_full(true_range(df, "_tr", keys=keys, tile=tile), "_tr", 2 * period - 1, name, keys, tile).drop("_tr")


def range_regime(df: DataFrame, atr: str = "atr") -> DataFrame:
    """Bar range over ATR; compression at 0.60 and below, expansion at 1.50 and above."""
    ratio = F.when(F.col(atr) > 0, F.try_divide(F.col("high") - F.col("low"), F.col(atr))).otherwise(F.lit(0.0))
    return df.withColumn("range_atr", ratio).withColumns(
        {"compression": F.col("range_atr") <= 0.60, "expansion": F.col("range_atr") >= 1.50}
    )


@per_series(1)
def candle_shape(df: DataFrame, w) -> DataFrame:
    """Body and wick shares and the engulfing, hammer and shooting-star patterns; flat bars are zero."""
    o, h, lo, c = (F.col(n) for n in ("open", "high", "low", "close"))
    span = h - lo
    body, upper, lower = F.abs(c - o), h - F.greatest(o, c), F.least(o, c) - lo
    flat = span == 0
    po, pc = F.lag("open").over(w), F.lag("close").over(w)
    bullish = (pc < po) & (c > o) & (o <= pc) & (c >= po)
    bearish = (pc > po) & (c < o) & (o >= pc) & (c <= po)
    small = F.greatest(body, span * 0.10)

    def share(x: Column) -> Column:
        return F.when(flat, 0.0).otherwise(F.try_divide(x, span))

    return df.withColumns(
        {
            "body_ratio": share(body),
            "upper_wick": share(upper),
            "lower_wick": share(lower),
            "engulfing": F.when(flat, None).when(bullish, "BULLISH").when(bearish, "BEARISH"),
            "hammer": ~flat & (lower >= body * 2) & (upper <= small),
            "shooting_star": ~flat & (upper >= body * 2) & (lower <= small),
        }
    )


@per_series(2)
def structure(df: DataFrame, w, name: str = "structure") -> DataFrame:
    """Three rising highs and lows, three falling ones, or mixed."""
    h, lo = F.col("high"), F.col("low")
    h1, h2, l1, l2 = F.lag("high", 1).over(w), F.lag("high", 2).over(w), F.lag("low", 1).over(w), F.lag("low", 2).over(w)
    up = (h2 < h1) & (h1 < h) & (l2 < l1) & (l1 < lo)
    down = (h2 > h1) & (h1 > h) & (l2 > l1) & (l1 > lo)
    return df.withColumn(name, F.when(up, "HH_HL").when(down, "LH_LL").otherwise("MIXED"))


@per_series(lambda lookback=20, atr="atr": lookback)
def levels(df: DataFrame, w, lookback: int = 20, atr: str = "atr") -> DataFrame:
    """Support and resistance of the last bars and the distance to them in ATR, floored at 0."""
    frame = w.rowsBetween(-(lookback - 1), 0)
    df = df.withColumns({"support": F.min("low").over(frame), "resistance": F.max("high").over(frame)})

    def distance(x: Column) -> Column:
        return F.when(F.col(atr) > 0, F.greatest(F.try_divide(x, F.col(atr)), F.lit(0.0))).otherwise(F.lit(0.0))

    return df.withColumns(
        {
            "support_distance": distance(F.col("close") - F.col("support")),
            "resistance_distance": distance(F.col("resistance") - F.col("close")),
        }
    )


@per_series(lambda lookback=5: lookback + 2)
def breakout_retest(df: DataFrame, w, lookback: int = 5) -> DataFrame:
    """The previous bar closes beyond the extreme of the bars before it and this bar holds the level."""
    history = w.rowsBetween(-(lookback + 1), -2)
    df = df.withColumns(
        {
            "_res": F.max("high").over(history),
            "_sup": F.min("low").over(history),
            "_n": F.count("high").over(history),
            "_pc": F.lag("close").over(w),
        }
    )
    full = F.col("_n") == lookback
    bull = full & (F.col("_pc") > F.col("_res")) & (F.col("low") <= F.col("_res")) & (F.col("close") >= F.col("_res"))
    bear = full & (F.col("_pc") < F.col("_sup")) & (F.col("high") >= F.col("_sup")) & (F.col("close") <= F.col("_sup"))
    out = df.withColumn("breakout_retest", F.when(bull, "BULLISH").when(bear, "BEARISH"))
    return out.drop("_res", "_sup", "_n", "_pc")


def trend_range_regime(df: DataFrame, slope: str = "ema_slope", atr: str = "atr") -> DataFrame:
    """TREND when the structure is not mixed and the slope is at least 5 % of ATR."""
    trend = (F.col("structure") != "MIXED") & (F.col(atr) > 0) & (F.abs(slope) >= F.col(atr) * 0.05)
    return df.withColumn("regime", F.when(trend, "TREND").otherwise("RANGE"))


def efficiency_regime(df: DataFrame, name: str = "regime", keys=KEYS, tile: int = 4 * WEEK) -> DataFrame:
    """Up, down, range or unknown: 12-bar path efficiency, gap of two averages and their direction."""
    averages = ema_columns(df, {"_fast": ("close", 9), "_slow": ("close", 21)}, keys, tile)
    return _efficiency_regime(averages, name, keys=keys, tile=tile)


@per_series(15)
def _efficiency_regime(df: DataFrame, w, name: str) -> DataFrame:
    df = df.withColumn("_step", F.abs(F.col("close") - F.lag("close").over(w)))
    df = df.withColumns(
        {
            "_path": F.sum("_step").over(w.rowsBetween(-11, 0)),
            "_far": F.lag("close", 12).over(w),
            "_fast3": F.lag("_fast", 3).over(w),
        }
    )
    efficiency = F.when(F.col("_path") > 0, F.try_divide(F.abs(F.col("close") - F.col("_far")), F.col("_path"))).otherwise(0.0)
    gap = F.try_divide(F.abs(F.col("_fast") - F.col("_slow")), F.col("close"))
    strong = (efficiency >= 0.35) & (gap >= 0.0005)
    up = strong & (F.col("_fast") > F.col("_slow")) & (F.col("_fast") > F.col("_fast3"))
    down = strong & (F.col("_fast") < F.col("_slow")) & (F.col("_fast") < F.col("_fast3"))
    regime = F.when(F.col("rn") <= 21, "UNKNOWN").when(up, "TREND_UP").when(down, "TREND_DOWN").otherwise("RANGE")
    return df.withColumn(name, regime).drop("_fast", "_slow", "_step", "_path", "_far", "_fast3")


@per_series(lambda x, n, stat, name: n)
def rolling(df: DataFrame, w, x: str, n: int, stat: str, name: str) -> DataFrame:
    """Mean, sample deviation or median of the last ``n`` rows, null until the window is full."""
    frame = w.rowsBetween(-(n - 1), 0)
    fn = {"mean": F.avg(x), "std": F.stddev_samp(x), "median": F.percentile(x, F.lit(0.5))}[stat]
    return df.withColumn(name, F.when(F.col("rn") >= n, fn.over(frame)))


def relative_strength(df: DataFrame, steps: tuple[int, int, int, int] = (3, 6, 12, 48), day: int = 288, keys=KEYS, tile: int = 4 * WEEK) -> DataFrame:
    """Returns over several horizons, activity against the previous day's median, ATR percentile,
    path efficiency and expected move. The first ``day`` bars of a symbol give no row."""
    df = ema_columns(numbered_range(df, keys, tile), {"atr": ("_tr", 27)}, keys, tile).drop("_tr", "_tile")
    df = df.withColumn("atr_pct", F.col("atr") / F.col("close") * 100)
    # the row number is the time here: the window is the last ``day`` bars
    past = [
        TrailingQuantile("_volume", "volume", 0.5, day),
        TrailingQuantile("_trades", "trades", 0.5, day),
        TrailingRank("_atr", "atr_pct", "atr_pct", day),
    ]
    df = along_path(df, df, keys, past, us="rn", order=("rn",), width=max(RANK_ROWS, day), back=day)
    return core(_relative_strength(blocks(df, day + 2, keys, tile), block_window(keys), steps, day)).drop("rn")


def numbered_range(df: DataFrame, keys, tile: int) -> DataFrame:
    """Row number ``rn`` and true range ``_tr`` of each bar from one scan; keeps ``_tile``."""
    scan = {"rn": ("count", F.lit(1)), "_prev": ("last", F.struct("close"))}
    df = prefix_scan(with_tile(df, width=tile), list(keys), ["us"], scan, exclusive=True)
    prev = F.col("_prev.close")
    value = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    return df.withColumns({"rn": F.col("rn") + 1, "_tr": value}).drop("_prev")


def _relative_strength(df: DataFrame, w, steps: tuple[int, int, int, int], day: int) -> DataFrame:
    df = df.withColumn("_step", F.abs(F.col("close") - F.lag("close").over(w)))

    def ret(k: int) -> Column:
        return F.col("close") / F.lag("close", k).over(w) - 1

    def relative(x: str) -> Column:
        return F.when(F.col(f"_{x}") > 0, F.try_divide(F.col(x), F.col(f"_{x}"))).otherwise(0.0)

    far = F.lag("close", steps[3]).over(w)
    df = df.withColumns(
        {
            "return_15m": ret(steps[0]),
            "return_30m": ret(steps[1]),
            "return_1h": ret(steps[2]),
            "return_4h": ret(steps[3]),
            "return_24h": ret(day),
            "volume_relative": relative("volume"),
            "activity_relative": relative("trades"),
            "_path": F.sum("_step").over(w.rowsBetween(-(steps[3] - 1), 0)),
            "_far": far,
            "expected_move_pct": F.col("atr_pct") * 2,
        }
    )
    df = df.withColumns(
        {
            "atr_percentile": (F.col("_atr_below") + F.col("_atr_equal")) / F.lit(float(day)),
            "trend_efficiency": F.when(
                F.col("_path") > 0, F.try_divide(F.abs(F.col("close") - F.col("_far")), F.col("_path"))
            ).otherwise(0.0),
        }
    )
    return df.filter(F.col("rn") > day).drop("_step", "_path", "_far", "_volume", "_trades", "_atr_count", "_atr_below", "_atr_equal")


def closed_strength(df: DataFrame, keys=KEYS, least: int = 300, **settings) -> DataFrame:
    """``relative_strength`` without the last bar of each series, which is still forming, and without series of
    fewer than ``least`` bars."""
    df = durable(df)  # the scan, its carry and the ends read it
    ends = durable(df.groupBy(*keys).agg(F.max("us").alias("_last"), F.count(F.lit(1)).alias("_bars")))  # written, so that its size is known to the join
    rows = relative_strength(df, keys=keys, **settings).join(ends, list(keys))
    return rows.filter((F.col("us") < F.col("_last")) & (F.col("_bars") >= least)).drop("_last", "_bars")


def warmup_flags(df: DataFrame, required: int, available: str = "available") -> DataFrame:
    """Whether enough bars exist for the features of this frame."""
    return df.withColumns({"warm": F.col(available) >= required, "required": F.lit(required)})


def close_time(bars: DataFrame, width: int) -> DataFrame:
    return bars.withColumn("close_us", F.col("us") + width)


def visible_bars(obs: DataFrame, bars: DataFrame, columns: dict[str, str], keys=KEYS, tile: int = 4 * WEEK) -> DataFrame:
    """Features of the last bar closed at or before each observation: one backward as-of on close time."""
    return asof_backward(obs, bars, keys, columns, right_us="close_us", width=tile)


@per_series(VISIBLE + 1)
def m1_block(df: DataFrame, w) -> DataFrame:
    """Momentum, ATR, range regime and shape of the fast frame."""
    for k in (1, 3, 5):
        df = momentum(df, "close", k, f"momentum_{k}")
    return candle_shape(range_regime(atr_sma(df))).withColumn("available", F.least(F.col("rn"), F.lit(VISIBLE)))


@per_series(VISIBLE + 1)
def m5_block(df: DataFrame, w) -> DataFrame:
    """Short and long averages, momentum, ATR, levels and breakout of the middle frame."""
    df = ema_seeded(ema_seeded(df, "close", 3, "ema_short"), "close", 8, "ema_long")
    df = breakout_retest(levels(atr_sma(momentum(df, "close", 3, "momentum"))))
    direction = F.signum(F.col("ema_short") - F.col("ema_long"))
    return df.withColumns({"direction": direction, "available": F.least(F.col("rn"), F.lit(VISIBLE))})


@per_series(VISIBLE + 1)
def m15_block(df: DataFrame, w) -> DataFrame:
    """Average and slope, structure, ATR and regime of the slow frame."""
    df = structure(atr_sma(ema_seeded(df, "close", 5, "ema")))
    df = trend_range_regime(df)
    return df.withColumns(
        {"direction": F.signum(F.col("ema_slope")), "available": F.least(F.col("rn"), F.lit(VISIBLE))}
    )
