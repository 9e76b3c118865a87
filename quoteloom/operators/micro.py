"""Tick microstructure and intraday context, all from quotes at or before the row's time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoteloom.functions.timing import DAY, HOUR, MINUTE, SECOND, cell, cell_start
from quoteloom.operators.bars import sample_first
from quoteloom.operators.joins import past_values, range_join
from quoteloom.operators.paths import TrailingQuantile, TrailingRank, along_path
from quoteloom.operators.scans import (
    previous,
    time_halo,
    trailing_extreme,
    trailing_sums,
    with_tile,
)
from quoteloom.operators.sliding import Runs, SerialMoments

KEYS = ("symbol",)
OBS = ("symbol", "us", "seq")


def tick_changes(ticks: DataFrame, span: int, keys=KEYS) -> DataFrame:
    """Changes against the previous tick, if that tick is at most ``span`` old (null otherwise)."""
    halo = time_halo(ticks, width=max(4 * span, DAY), back=span)
    w = Window.partitionBy(*keys, "_tile").orderBy("us", "seq")
    wide = halo.withColumns(
        {
            "prev_us": F.lag("us").over(w),
            "_pm": F.lag("mid").over(w),
            "_ps": F.lag("spread").over(w),
            "_us2": F.lag("us", 2).over(w),
            "_m2": F.lag("mid", 2).over(w),
        }
    )
    near = F.col("us") - F.col("prev_us") <= span
    near2 = F.col("us") - F.col("_us2") <= span
    out = wide.filter("_core").withColumns(
        {
            "d_mid": F.when(near, F.col("mid") - F.col("_pm")),
            "d_spread": F.when(near, F.col("spread") - F.col("_ps")),
            "d_us": F.when(near, F.col("us") - F.col("prev_us")),
            "acceleration": F.when(near2, (F.col("mid") - F.col("_pm")) - (F.col("_pm") - F.col("_m2"))).otherwise(0.0),
            "prev_us": F.when(near, F.col("prev_us")),
        }
    )
    return out.drop("_pm", "_ps", "_us2", "_m2", "_tile", "_core")


def tick_rate(ticks: DataFrame, windows: dict[str, int], keys=KEYS) -> DataFrame:
    """Ticks in trailing windows, inclusive; ``rate_acceleration`` is the first minus a share of the second."""
    out = trailing_sums(ticks, keys, {f"rate_{n}": (F.lit(1), w) for n, w in windows.items()})
    names = list(windows)
    ratio = windows[names[1]] / windows[names[0]]
    accel = F.col(f"rate_{names[0]}") - F.col(f"rate_{names[1]}") / ratio
    return out.withColumn("rate_acceleration", accel)


def flow_specs(windows: dict[str, int]) -> dict[str, tuple]:
    specs: dict[str, tuple] = {}
    for n, w in windows.items():
        specs[f"up_{n}"] = (F.when(F.col("d_mid") > 0, 1), w, "prev_us")
        specs[f"down_{n}"] = (F.when(F.col("d_mid") < 0, 1), w, "prev_us")
    return specs


def imbalance_columns(n: str) -> dict[str, Column]:
    up, down = F.coalesce(f"up_{n}", F.lit(0.0)), F.coalesce(f"down_{n}", F.lit(0.0))
    total = up + down
    return {
        f"up_share_{n}": F.when(total > 0, up / total).otherwise(0.5),
        f"down_share_{n}": F.when(total > 0, down / total).otherwise(0.5),
        f"imbalance_{n}": (up - down) / F.greatest(total, F.lit(1.0)),
    }


def tick_imbalance(ticks: DataFrame, windows: dict[str, int], keys=KEYS) -> DataFrame:
    """Shares of up and down changes inside each window (neutral one half) and the signed imbalance."""
    moved = tick_changes(ticks, max(windows.values()), keys)
    out = trailing_sums(moved, keys, flow_specs(windows))
    for n in windows:
        out = out.withColumns(imbalance_columns(n)).drop(f"up_{n}", f"down_{n}")
    return out


def price_acceleration(ticks: DataFrame, span: int, keys=KEYS) -> DataFrame:
    """Last change minus the previous one, when all three ticks lie in the window."""
    out = tick_changes(ticks, span, keys)
    return out.drop("prev_us", "d_mid", "d_spread", "d_us")


def spread_context(obs: DataFrame, ticks: DataFrame, span: int) -> DataFrame:
    """Current spread against the median of the trailing window, at sampled rows."""
    slim = obs.select(*OBS, "spread")
    med = along_path(slim, ticks, KEYS, [TrailingQuantile("median_spread", "spread", 0.5, span, own=True)], back=span)
    return med.withColumns(
        {
            "spread_delta": F.col("spread") - F.col("median_spread"),
            "spread_ratio": F.col("spread") / F.greatest("median_spread", F.lit(1e-9)),
        }
    )


def past_value(rows: DataFrame, x: str, back: int, name: str, keys=KEYS, width: int = DAY) -> DataFrame:
    """Value of ``x`` at or before ``T - back``."""
    order = ("us", "seq") if "seq" in rows.columns else ("us",)
    return past_values(rows, {name: (x, back)}, keys, order, width)


def past_return(rows: DataFrame, x: str, back: int, name: str, scale: float = 1.0, keys=KEYS) -> DataFrame:
    out = past_value(rows, x, back, "_past", keys=keys)
    return out.withColumn(name, (F.col(x) - F.col("_past")) / scale).drop("_past")


def recent_range_position(rows: DataFrame, span: int, side: str | None = None, atr: str | None = None, keys=KEYS) -> DataFrame:
    """Distance to the trailing high and low, position between them, pull-back against the ``side`` sign."""
    out = trailing_extreme(rows, keys, span, {"_hi": ("max", "mid"), "_lo": ("min", "mid")})
    gap = F.col("_hi") - F.col("_lo")
    cols = {
        "to_high": F.col("mid") - F.col("_hi"),
        "to_low": F.col("mid") - F.col("_lo"),
        "range_position": F.when(gap > 0, F.try_divide(F.col("mid") - F.col("_lo"), gap)).otherwise(0.5),
    }
    if side:
        depth = F.when(F.col(side) >= 0, F.col("_hi") - F.col("mid")).otherwise(F.col("mid") - F.col("_lo"))
        cols["pullback"] = depth / (F.greatest(atr, F.lit(1e-9)) if atr else F.lit(1.0))
    return out.withColumns(cols).drop("_hi", "_lo")


def run_lengths(obs: DataFrame, ticks: DataFrame, span: int) -> DataFrame:
    """Runs of equal direction in the trailing window: mean, longest, current signed, transition shares."""
    return along_path(obs.select(*OBS), ticks, KEYS, [Runs("mid", span)], back=span)


def interarrival(ticks: DataFrame, short: int, long: int, keys=KEYS) -> DataFrame:
    """Mean gap over two windows, variation over the long one, and their difference, in seconds.

    Gaps are summed as whole microseconds, so the running sums are exact.
    """
    moved = tick_changes(ticks, long, keys)
    gap = F.col("d_us").cast("double")
    specs = {}
    for n, w in (("s", short), ("l", long)):
        specs[f"_n_{n}"] = (F.when(F.col("d_us").isNotNull(), 1), w, "prev_us")
        specs[f"_sum_{n}"] = (gap, w, "prev_us")
    specs["_sq_l"] = (gap * gap / SECOND, long, "prev_us")
    out = trailing_sums(moved, keys, specs)

    def mean(n: str) -> Column:
        return F.when(F.col(f"_n_{n}") > 0.5, F.try_divide(F.col(f"_sum_{n}"), F.col(f"_n_{n}")) / SECOND)

    out = out.withColumns(
        {"gap_short": F.coalesce(mean("s"), F.lit(short / SECOND)), "gap_long": F.coalesce(mean("l"), F.lit(long / SECOND))}
    )
    variance = F.try_divide(F.col("_sq_l"), F.col("_n_l")) / SECOND - F.col("gap_long") * F.col("gap_long")
    cv = F.when(
        (F.col("_n_l") > 0.5) & (F.col("gap_long") > 0),
        F.try_divide(F.sqrt(F.greatest(variance, F.lit(0.0))), F.col("gap_long")),
    ).otherwise(0.0)
    out = out.withColumns({"gap_cv": cv, "gap_acceleration": F.col("gap_long") - F.col("gap_short")})
    return out.drop(*specs, "prev_us", "d_mid", "d_spread", "d_us", "acceleration")


def quote_change_rates(ticks: DataFrame, span: int, keys=KEYS) -> DataFrame:
    """Share of ticks in the window that changed the mid, or the spread."""
    moved = tick_changes(ticks, span, keys)
    has = F.col("d_mid").isNotNull()
    specs = {
        "_n": (F.when(has, 1), span, "prev_us"),
        "_mid": (F.when(F.col("d_mid") != 0, 1), span, "prev_us"),
        "_spr": (F.when(F.abs("d_spread") > 1e-12, 1), span, "prev_us"),
    }
    out = trailing_sums(moved, keys, specs)

    def share(c: str) -> Column:
        return F.when(F.col("_n") > 0.5, F.try_divide(F.coalesce(c, F.lit(0.0)), F.col("_n"))).otherwise(0.0)

    cols = {"mid_change_rate": share("_mid"), "spread_change_rate": share("_spr")}
    return out.withColumns(cols).drop("_n", "_mid", "_spr", "prev_us", "d_mid", "d_spread", "d_us", "acceleration")


# -- second bars ---------------------------------------------------------------------------------
def second_changes(sec: DataFrame, scale: float = 1.0, keys=KEYS, tile: int = DAY) -> DataFrame:
    """Change of the mid against the previous active second (0 for the first of the series)."""
    out = previous(with_tile(sec, width=tile), keys, ["us"], {"_pm": "mid"})
    change = F.coalesce((F.col("mid") - F.col("_pm")) / scale, F.lit(0.0))
    return out.withColumn("delta", change).drop("_pm", "_tile")


def rolling_sum(sec: DataFrame, windows: dict[str, int], keys=KEYS) -> DataFrame:
    """Realised volatility and path length per window from ``delta``, in one sweep."""
    specs = {}
    for n, w in windows.items():
        specs[f"_sq_{n}"] = (F.col("delta") * F.col("delta"), w)
        specs[f"path_{n}"] = (F.abs("delta"), w)
    out = trailing_sums(sec, keys, specs, order=("us",))
    for n in windows:
        out = out.withColumn(f"rv_{n}", F.sqrt(F.greatest(f"_sq_{n}", F.lit(0.0)))).drop(f"_sq_{n}")
    return out


def rolling_extreme(sec: DataFrame, span: int, name: str, x: str = "mid", exclude_current: bool = False, keys=KEYS) -> DataFrame:
    """Trailing high and low of ``x``."""
    outs = {f"high_{name}": ("max", x), f"low_{name}": ("min", x)}
    return trailing_extreme(sec, keys, span, outs, order=("us",), exclude_current=exclude_current)


def efficiency_persistence(sec: DataFrame, span: int, name: str, scale: float = 1.0, keys=KEYS) -> DataFrame:
    """Absolute displacement over path, and the one-sidedness of the moves, over one window."""
    specs = {
        "_path": (F.abs("delta"), span),
        "_up": (F.when(F.col("delta") > 0, 1.0), span),
        "_down": (F.when(F.col("delta") < 0, 1.0), span),
    }
    out = past_value(trailing_sums(sec, keys, specs, order=("us",)), "mid", span, "_past", keys=keys)
    up, down = F.coalesce("_up", F.lit(0.0)), F.coalesce("_down", F.lit(0.0))
    moved = F.abs(F.col("mid") - F.col("_past")) / scale
    # a path of float dust (all changes left the window) is no path
    eff = F.when(F.col("_past").isNotNull() & (F.col("_path") > 1e-9), F.try_divide(moved, F.col("_path"))).otherwise(0.0)
    per = F.when(up + down > 0.5, F.try_divide(F.abs(up - down), up + down)).otherwise(0.0)
    return out.withColumns({f"efficiency_{name}": eff, f"persistence_{name}": per}).drop("_path", "_up", "_down", "_past")


def causal_references(
    sec: DataFrame, stats: dict[str, tuple[str, float]], span: int, every: int = MINUTE, least: int = 20, keys=KEYS
) -> DataFrame:
    """Quantiles over the minute samples strictly before this minute's sample, constant within the minute.

    ``stats`` maps a name to ``(column, quantile)``; fewer than ``least`` values give null.
    """
    used = list(dict.fromkeys(x for x, _ in stats.values()))
    minutes = sample_first(sec.select(*keys, "us", *used), every, keys, ("us",))
    halo = time_halo(minutes, width=max(4 * span, DAY), back=span)
    w = Window.partitionBy(*keys, "_tile").orderBy("us").rangeBetween(-span, -1)
    ref = halo.withColumns({n: F.when(F.count(x).over(w) >= least, F.percentile(x, F.lit(q)).over(w)) for n, (x, q) in stats.items()})
    ref = ref.filter("_core").select(*keys, cell("us", every).alias("_m"), *stats)
    # one row per (symbol, minute) on the right
    return sec.withColumn("_m", cell("us", every)).join(ref, [*keys, "_m"], "left").drop("_m")


def causal_reference(
    sec: DataFrame, x: str, span: int, q: float, name: str, every: int = MINUTE, least: int = 20, keys=KEYS
) -> DataFrame:
    return causal_references(sec, {name: (x, q)}, span, every, least, keys)


def causal_percentile(
    obs: DataFrame, sec: DataFrame, x: str, span: int, name: str, every: int = MINUTE, least: int = 20, keys=KEYS
) -> DataFrame:
    """Mid-rank percentile of the current ``x`` among the minute samples of the last ``span``, before T."""
    minutes = sample_first(sec.select(*keys, "us", x), every, keys, ("us",))
    ranked = along_path(obs, minutes, keys, [TrailingRank("_r", x, x, span)], us="us", order=("us",), back=span)
    share = F.try_divide(F.col("_r_below") + 0.5 * F.col("_r_equal"), F.col("_r_count"))
    return ranked.withColumn(name, F.when(F.col("_r_count") >= least, share)).drop("_r_count", "_r_below", "_r_equal")


def failed_breakouts(obs: DataFrame, sec: DataFrame, span: int, prior: int) -> DataFrame:
    """Breaks of the short prior extreme inside the window that have reversed by now, and the age of the last break."""
    ident = ["symbol", "us"]
    slim = obs.select(*ident, F.col("mid").alias("_now"))
    seen = range_join(slim, sec, KEYS, F.col("us") - span, F.col("us"), {"_m": "mid"}, width=span)
    w = Window.partitionBy(*ident).orderBy("_r_us").rangeBetween(-prior, -1)
    broke = seen.withColumns({"_hi": F.max("_m").over(w), "_lo": F.min("_m").over(w)})
    up, down = F.col("_m") > F.col("_hi"), F.col("_m") < F.col("_lo")
    failed = (up & (F.col("_now") <= F.col("_hi"))) | (down & (F.col("_now") >= F.col("_lo")))
    stats = broke.groupBy(*ident).agg(
        F.sum(F.when(failed, 1.0).otherwise(0.0)).alias("failed_breakouts"),
        F.max(F.when(up | down, F.col("_r_us"))).alias("_last"),
    )
    latency = F.coalesce((F.col("us") - F.col("_last")) / SECOND, F.lit(span / SECOND))
    return stats.select(*ident, "failed_breakouts", latency.alias("retest_latency"))


def day_context(sec: DataFrame, slope: int, scale: float = 1.0) -> DataFrame:
    """Running day high, low and time-weighted mean, position in the range and slope of the mean.

    A (symbol, day) holds at most 86,400 second bars, so the day frames are bounded by the clock.
    """
    keyed = sec.withColumn("day", cell("us", DAY))
    w = Window.partitionBy("symbol", "day").orderBy("us").rowsBetween(Window.unboundedPreceding, 0)
    run = keyed.withColumns(
        {"_hi": F.max("mid").over(w), "_lo": F.min("mid").over(w), "_twap": F.avg("mid").over(w), "_t0": F.first("mid").over(w)}
    )
    out = past_value(run, "_twap", slope, "_was", keys=("symbol", "day"))
    gap = F.col("_hi") - F.col("_lo")
    return out.withColumns(
        {
            "to_day_high": (F.col("mid") - F.col("_hi")) / scale,
            "to_day_low": (F.col("mid") - F.col("_lo")) / scale,
            "day_position": F.when(gap > 0, F.try_divide(F.col("mid") - F.col("_lo"), gap)).otherwise(0.5),
            "to_twap": (F.col("mid") - F.col("_twap")) / scale,
            "twap_slope": (F.col("_twap") - F.coalesce("_was", "_t0")) / scale,
        }
    ).drop("_hi", "_lo", "_twap", "_t0", "_was")


def opening_ranges(sec: DataFrame, scale: float = 1.0, opening: int = 7 * HOUR, first: int = 30 * MINUTE, second: int = 60 * MINUTE) -> DataFrame:
    """Range before the opening, volatility and range just after it, displacement since; null until known."""
    tod = F.col("us") - cell_start("us", DAY)
    keyed = sec.withColumns({"day": cell("us", DAY), "_tod": tod})
    t = F.col("_tod")
    before, in_first, in_second = t < opening, (t >= opening) & (t < opening + first), (t >= opening) & (t < opening + second)
    facts = keyed.groupBy("symbol", "day").agg(
        (F.max(F.when(before, F.col("mid"))) - F.min(F.when(before, F.col("mid")))).alias("_asia"),
        F.sqrt(F.sum(F.when(in_first, F.col("delta") * F.col("delta")))).alias("_rv"),
        (F.max(F.when(in_second, F.col("mid"))) - F.min(F.when(in_second, F.col("mid")))).alias("_range"),
        F.min_by("mid", F.when(t >= opening, F.col("us"))).alias("_open"),
    )
    out = keyed.join(facts, ["symbol", "day"])
    return out.withColumns(
        {
            "asian_range": F.when(t >= opening, F.col("_asia") / scale),
            "opening_rv": F.when(t >= opening + first, F.col("_rv")),
            "opening_range": F.when(t >= opening + second, F.col("_range") / scale),
            "opening_displacement": F.when(t >= opening, (F.col("mid") - F.col("_open")) / scale),
        }
    ).drop("_asia", "_rv", "_range", "_open", "_tod", "day")


def autocorr_varratio(obs: DataFrame, sec: DataFrame, span: int, group: int = 5) -> DataFrame:
    """Lag-one autocorrelation and variance ratio of ``group``-row sums of the deltas in the window."""
    ident = ["symbol", "us"]
    sums = along_path(obs.select(*ident), sec, KEYS, [SerialMoments("delta", span, group)], order=("us",), back=span)
    total = sums.filter("_n > 0").withColumnsRenamed({f"_{c}": c for c in ("n", "s", "ss", "x", "xx", "y", "yy", "xy")})
    total = total.withColumn("k", F.ceil(F.col("n") / group))
    total = total.withColumn("vg", F.col("_gg") / F.col("k") - (F.col("s") / F.col("k")) * (F.col("s") / F.col("k")))
    m = F.col("n") - 1
    vx, vy = m * F.col("xx") - F.col("x") * F.col("x"), m * F.col("yy") - F.col("y") * F.col("y")
    eps = F.lit(1e-12)
    corr = F.when((F.col("n") >= 10) & (vx > eps) & (vy > eps), (m * F.col("xy") - F.col("x") * F.col("y")) / (F.sqrt(vx) * F.sqrt(vy))).otherwise(0.0)
    var = F.col("ss") / F.col("n") - (F.col("s") / F.col("n")) * (F.col("s") / F.col("n"))
    ratio = F.when((F.col("k") >= 3) & (var > eps), F.try_divide(F.col("vg"), group * var)).otherwise(0.0)
    return total.select(*ident, corr.alias("autocorr"), ratio.alias("variance_ratio"))


def interactions(df: DataFrame) -> DataFrame:
    """Eight fixed products of an event row; absent inputs count as zero or one as published."""
    c = F.col
    pct = F.coalesce("volatility_percentile", F.lit(0.0))
    high = (F.coalesce("volatility_percentile", F.lit(-1.0)) >= 2 / 3).cast("double")
    signed = F.when(c("return_60s") < 0, -F.abs("persistence_900s")).otherwise(F.abs("persistence_900s"))
    return df.withColumns(
        {
            "x_return_high_volatility": c("return_60s") * high,
            "x_velocity_low_spread": c("breakout_velocity") * (c("spread_to_volatility") <= 0.5).cast("double"),
            "x_pullback_efficiency": c("pullback_amplitude") * c("efficiency_900s"),
            "x_imbalance_release": c("imbalance_15s") * c("compression_release").cast("double"),
            "x_imbalance_expansion": c("imbalance_acceleration") * c("range_expansion"),
            "x_persistence_volatility": signed * pct,
            "x_displacement_overlap": F.coalesce("opening_displacement", F.lit(0.0)) * c("overlap").cast("double"),
            "x_twap_efficiency": c("to_twap") * c("efficiency_3600s"),
        }
    )


def session_age(us: str = "us") -> tuple[Column, Column]:
    """Session by the second table of fixed UTC bounds, and minutes since it began."""
    minute = (F.col(us) - cell_start(us, DAY)) / MINUTE
    bounds = ((0, 420, "ASIA"), (420, 720, "LONDON"), (720, 960, "LONDON_NEW_YORK"), (960, 1260, "NEW_YORK"), (1260, 1440, "OTHER"))
    name = F.when(minute < bounds[0][1], bounds[0][2])
    start = F.when(minute < bounds[0][1], bounds[0][0])
    for lo, hi, label in bounds[1:]:
        name, start = name.when(minute < hi, label), start.when(minute < hi, lo)
    whole_seconds = F.floor((F.col(us) - cell_start(us, DAY)) / SECOND) / 60
    return name, whole_seconds - start


def normalised_direction_features(df: DataFrame) -> DataFrame:
    """Slope and momentum in ATR, wick and body pressure, signed breakout distance, retest quality."""
    eps = F.lit(1e-9)
    c = F.col
    distance = (
        F.when(c("breakout_retest") == "BULLISH", c("support_distance"))
        .when(c("breakout_retest") == "BEARISH", -c("resistance_distance"))
        .otherwise(0.0)
    )
    return df.withColumns(
        {
            "slope_atr": c("ema_slope") / F.greatest("slow_atr", eps),
            "momentum_atr": c("momentum") / F.greatest("mid_atr", eps),
            "wick_pressure": (c("lower_wick") - c("upper_wick")) / F.greatest(c("lower_wick") + c("upper_wick"), eps),
            "body_pressure": F.signum("momentum_1") * c("body_ratio"),
            "breakout_distance": distance,
            "retest_quality": F.when(c("breakout_retest").isNotNull(), 1 / (1 + F.abs(distance))).otherwise(0.0),
        }
    )


def regime_tags(df: DataFrame, percentile: str, efficiency: str) -> DataFrame:
    """Volatility tercile and trend tag."""
    p = F.col(percentile)
    tercile = F.when(p.isNull(), "UNKNOWN").when(p < 1 / 3, "LOW").when(p < 2 / 3, "MEDIUM").otherwise("HIGH")
    return df.withColumns(
        {"volatility_regime": tercile, "trend_regime": F.when(F.col(efficiency) >= 0.30, "TREND").otherwise("RANGE")}
    )
