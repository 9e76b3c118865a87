"""Votes, scores, setups, event detectors, cooldowns, episodes and cross-sectional ranking."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoteloom.functions.timing import DAY, WEEK, cell
from quoteloom.operators import features as X
from quoteloom.operators.joins import asof_backward, asof_backward_many
from quoteloom.operators.scans import block_window, composed_before, core, prefix_scan, row_index, with_tile
from quoteloom.session import durable

c = F.col


# fixed value: the score from which a signal may be a candidate
CANDIDATE_SCORE = 90


# -- explainable score -----------------------------------------------------------------------------
def _sign_name(x: Column, neutral: str = "NEUTRAL") -> Column:
    return F.when(x > 0, "BUY").when(x < 0, "SELL").otherwise(neutral)


def vote_bias(df: DataFrame) -> DataFrame:
    """Market bias: trend and structure of the slow frame, trend and momentum of the middle one."""
    shape = F.when(c("m15_structure") == "HH_HL", 1).when(c("m15_structure") == "LH_LL", -1).otherwise(0)
    votes = c("m15_direction") + shape + c("m5_direction") + F.signum("m5_momentum")
    return df.withColumn("market_bias", _sign_name(votes))


def vote_trigger(df: DataFrame, max_age: float) -> DataFrame:
    """Trigger direction: fast momenta, acceleration and tick shares; neutral when the ticks are stale."""
    votes = F.signum("m1_momentum_1") + F.signum("m1_momentum_3") + F.signum("m1_momentum_5") + F.signum("acceleration")
    votes = votes + F.when(c("up_share") > 0.55, 1).when(c("down_share") > 0.55, -1).otherwise(0)
    return df.withColumn("trigger", F.when(c("tick_age") > max_age, "NEUTRAL").otherwise(_sign_name(votes)))


def _aligned(x: Column, side: Column) -> Column:
    return ((side == "BUY") & (x > 0)) | ((side == "SELL") & (x < 0))


def score(df: DataFrame, max_age: float, max_spread: float, session_ok: bool = True, news_ok: bool = True) -> DataFrame:
    """Eight capped components, their total out of 100 and the reasons. Needs the two votes."""
    bias, trig = c("market_bias"), c("trigger")
    fresh = (c("tick_age") <= max_age) & (trig != "NEUTRAL")
    with_m15 = _aligned(c("m15_direction"), bias)
    trend = (c("m15_regime") == "TREND") & with_m15
    m5_trend, m5_mom = _aligned(c("m5_direction"), bias), _aligned(c("m5_momentum"), bias)
    m1 = [_aligned(c(f"m1_momentum_{k}"), trig) for k in (1, 3, 5)]
    ratio = F.when(trig == "BUY", c("up_share")).otherwise(c("down_share")) >= 0.60
    accel = _aligned(c("acceleration"), trig)
    steady = (c("rate_1") > 0) & (c("rate_acceleration") >= 0)
    shape = F.when(bias == "BUY", "HH_HL").otherwise("LH_LL")
    side = F.when(bias == "BUY", "BULLISH").otherwise("BEARISH")
    structured = c("m15_structure") == shape
    retested = F.coalesce(c("m5_breakout_retest") == side, F.lit(False))
    balanced = (c("m1_atr") > 0) & c("m1_range_atr").between(0.60, 1.50)
    spread_ok = c("spread_points") <= max_spread
    tight = c("spread_points") <= c("median_spread_points") * 1.25

    def pts(flag: Column, n: int) -> Column:
        return F.when(flag, n).otherwise(0)

    # fixed values: points of each component
    parts = {
        "score_m15": F.when(trend, 15).when(c("m15_regime") == "RANGE", 5).otherwise(0),
        "score_m5": pts(m5_trend, 8) + pts(m5_mom, 7),
        "score_m1": pts(m1[0], 5) + pts(m1[1], 5) + pts(m1[2], 5),
        "score_tick": F.when(fresh, pts(ratio, 8) + pts(accel, 4) + pts(steady, 3)).otherwise(0),
        "score_structure": pts(structured, 8) + pts(retested, 7),
        "score_volatility": F.when(balanced, 10).when(c("m1_atr") > 0, 6).otherwise(0),
        "score_spread": F.when(spread_ok, 6 + pts(tight, 4)).otherwise(0),
        "score_context": F.lit((2 if session_ok else 0) + (3 if news_ok else 0)),
    }
    total = sum((c(n) for n in list(parts)[1:]), c("score_m15"))
    reasons = F.array_compact(
        F.array(
            F.when(trend, F.concat(F.lit("M15_"), bias, F.lit("_TREND"))).when(c("m15_regime") == "RANGE", "M15_RANGE"),
            F.when(m5_trend, "M5_TREND_ALIGNED"),
            F.when(m5_mom, "M5_MOMENTUM_ALIGNED"),
            F.when(m1[0] | m1[1] | m1[2], F.concat(F.lit("M1_MOMENTUM_"), trig)),
            F.when(fresh & ratio, F.concat(F.lit("TICK_RATIO_"), trig)),
            F.when(fresh & accel, F.concat(F.lit("TICK_ACCELERATION_"), trig)),
            F.when(fresh & steady, "TICK_RATE_STABLE_OR_ACCELERATING"),
            F.when(structured, F.concat(F.lit("M15_STRUCTURE_"), shape)),
            F.when(retested, F.concat(F.lit("M5_BREAKOUT_RETEST_"), side)),
            F.when(balanced, "VOLATILITY_BALANCED").when(c("m1_atr") > 0, "VOLATILITY_EXTREME_OR_COMPRESSED"),
            F.when(spread_ok, "SPREAD_ACCEPTABLE"),
            F.lit("SESSION_AND_NEWS_CLEAR") if session_ok and news_ok else F.lit(None).cast("string"),
            F.when(total < CANDIDATE_SCORE, "SCORE_BELOW_CANDIDATE_THRESHOLD"),
        )
    )
    return df.withColumns(parts).withColumns({"score": total, "reasons": reasons})


# fixed values: bars a frame needs before its features count
WARMUP_BARS = {"m15": 14, "m5": 20, "m1": 15}


def blockers(df: DataFrame, max_age: float, max_spread: float | None, session: bool | None = True, news: bool | None = True) -> DataFrame:
    """Reasons that forbid acting, as an array; empty means free to act."""
    short = {f: c(f"{f}_available") < n for f, n in WARMUP_BARS.items()}
    any_short = short["m15"] | short["m5"] | short["m1"]
    bias, trig = c("market_bias"), c("trigger")
    conflict = (bias == "NEUTRAL") | (trig == "NEUTRAL")
    spread = F.lit("SPREAD_LIMIT_UNCALIBRATED") if max_spread is None else F.when(c("spread_points") > max_spread, "SPREAD_TOO_HIGH")

    def tri(value: bool | None, unknown: str, bad: str) -> Column:
        return F.lit(None if value is True else unknown if value is None else bad).cast("string")

    wanted = F.when(trig == "BUY", 1).otherwise(-1)
    found = F.array_compact(
        F.array(
            F.when(any_short, "FEATURE_WARMUP_INCOMPLETE"),
            *[F.when(flag, f"INSUFFICIENT_{f.upper()}_HISTORY") for f, flag in short.items()],
            F.when(c("visible_ticks") < 3, "INSUFFICIENT_TICK_HISTORY"),
            F.when(c("tick_age") > max_age, "MARKET_DATA_STALE"),
            spread,
            tri(session, "SESSION_UNVERIFIED", "SESSION_BLOCKED"),
            tri(news, "NEWS_STATUS_UNKNOWN", "HIGH_IMPACT_NEWS"),
            F.when(conflict, "DIRECTION_CONFLICT").when(bias != trig, "MARKET_TRIGGER_DIVERGENCE"),
            F.when(
                trig != "NEUTRAL",
                F.when(c("m5_direction") == 0, "M5_DIRECTION_UNCONFIRMED").when(c("m5_direction") != wanted, "TRIGGER_AGAINST_M5_TREND"),
            ),
        )
    )
    return df.withColumn("blockers", found)


def decide(df: DataFrame, point: float) -> DataFrame:
    """Tier, side or WAIT, and the proposed stop and target in points."""
    tier = F.when(c("score") < 80, "WAIT").when(c("score") < 90, "WATCH").when(c("score") < 95, "CANDIDATE").otherwise("PREMIUM_CANDIDATE")
    free = (F.size("blockers") == 0) & (c("score") >= CANDIDATE_SCORE)
    stop = F.when(c("m1_atr") > 0, F.greatest(F.lit(1), F.ceil(F.round(c("m1_atr") / point * 1.20, 9))))
    out = df.withColumns({"tier": tier, "side": F.when(free, c("trigger")).otherwise("WAIT"), "stop_points": stop})
    target = F.greatest(c("stop_points") + 1, F.ceil(c("stop_points") * 1.5))
    return out.withColumn("target_points", target)


# -- candle setups ---------------------------------------------------------------------------------
def asof_regime(fast: DataFrame, slow: DataFrame, fast_width: int, slow_width: int, columns: dict[str, str], tile: int = 4 * WEEK) -> DataFrame:
    """State of the slower bar fully closed at the fast bar's close."""
    probe = fast.withColumn("signal_us", c("us") + fast_width)
    right = slow.withColumn("_closed", c("us") + slow_width)
    return asof_backward(probe, right, ["symbol"], columns, "signal_us", "_closed", width=tile)


def _fast_frame(m5: DataFrame, tile: int) -> DataFrame:
    averages = {"fast": ("close", 9), "slow": ("close", 21), "atr": ("_tr", 27)}
    numbered = X.numbered_range(m5, ["symbol"], tile)  # numbers serve the averages and the blocks
    b = X.blocks(X.ema_columns(numbered, averages, tile=tile).drop("_tr"), 24, tile=tile, ahead=1)
    w = block_window(["symbol"])
    b = X.rolling(X.rolling(X.rolling(b, "volume", 20, "median", "vol_med"), "close", 20, "mean", "mean"), "close", 20, "std", "dev")
    b = b.withColumns(
        {
            "prev_close": F.lag("close").over(w),
            "prev_low": F.lag("low").over(w),
            "prev_volume": F.lag("volume").over(w),
            "prev_vol_med": F.lag("vol_med").over(w),
            "prev_mean": F.lag("mean").over(w),
            "prev_dev": F.lag("dev").over(w),
            "high20": F.max("high").over(w.rowsBetween(-20, -1)),
            "high20_before_prev": F.max("high").over(w.rowsBetween(-21, -2)),
            "low3": F.min("low").over(w.rowsBetween(-2, 0)),
            "is_last": F.lead("us").over(w).isNull(),
        }
    )
    return core(b).drop("_tile")


def _numbered(bars: DataFrame, tile: int) -> DataFrame:
    return row_index(with_tile(durable(bars), width=tile), ["symbol"], ["us"])


def setups_v1(m5: DataFrame, m15: DataFrame, fast_width: int, slow_width: int, momentum: DataFrame, tile: int = 4 * WEEK) -> DataFrame:
    """Breakout-retest, momentum pull-back or range reversion on closed bars; the first match wins.

    ``momentum(symbol, us, up)`` tells whether the fastest frame rises at the bar's close. The first 25
    bars and the last one give no signal.
    """
    regime = X.efficiency_regime(_numbered(m15, tile), tile=tile)
    # the momentum joins the bars while they are narrow, and bars that cannot signal go before they are wide
    fast = _fast_frame(durable(m5.join(momentum, ["symbol", "us"], "left")), tile).filter((c("rn") > 25) & ~c("is_last") & c("up"))
    rows = asof_regime(fast, regime, fast_width, slow_width, {"regime": "regime"}, tile).filter(c("regime").isNotNull())
    rows = durable(rows)  # the wide conditions below then meet a plain scan, not a join they could be pushed into
    level = c("high20_before_prev")
    breakout = (
        (c("prev_close") > level)
        & (c("low") <= level * 1.0015)
        & (c("close") > level)
        & (c("prev_volume") >= c("prev_vol_med") * 1.20)
        & (c("regime") != "TREND_DOWN")
    )
    pullback = (
        (c("regime") == "TREND_UP")
        & (c("fast") > c("slow"))
        & (c("low") <= c("fast") * 1.001)
        & (c("close") > c("fast"))
        & (c("close") > c("prev_close"))
        & (c("volume") >= c("vol_med") * 0.80)
    )
    band = c("prev_mean") - 2 * c("prev_dev")
    reversion = (c("regime") == "RANGE") & (c("prev_close") < band) & (c("close") > c("prev_close")) & (c("mean") > c("close"))
    # the flags become plain columns behind one filter: stop, target and confidence then stay small
    rows = rows.filter(breakout | pullback | reversion).withColumns({"_b": breakout, "_p": pullback, "_band": band})
    is_b, is_p = c("_b"), c("_p")
    stop = (
        F.when(is_b, F.least(c("low"), level - c("atr") * 0.35))
        .when(is_p, c("low3") - c("atr") * 0.10)
        .otherwise(F.least("prev_low", "low") - c("atr") * 0.25)
    )
    target = F.when(is_b, c("close") + c("atr") * 2.0).when(is_p, c("close") + c("atr") * 1.5).otherwise(c("mean"))
    stretch = F.abs(c("prev_close") - c("_band")) / F.greatest("atr", F.lit(1e-12)) / 10
    confidence = F.when(is_b, 0.75).when(is_p, 0.70).otherwise(F.least(F.lit(0.80), F.lit(0.55) + stretch))
    setup = F.when(is_b, "BREAKOUT_RETEST").when(is_p, "MOMENTUM_PULLBACK").otherwise("RANGE_MEAN_REVERSION")
    out = rows.select(
        "symbol", "signal_us", setup.alias("setup"), "regime", c("close").alias("entry"), stop.alias("stop"),
        target.alias("target"), "atr", confidence.alias("confidence"),
    )
    return out.filter("stop < entry")


def setups_v2(
    m5: DataFrame, m15: DataFrame, h1: DataFrame, widths: tuple[int, int, int], round_trip_cost_pct: float, tile: int = 4 * WEEK,
    min_move: float = 0.60, min_ratio: float = 3.0, min_reward: float = 2.0,
) -> DataFrame:
    """Up-trend on two slower frames, then expansion or pull-back with enough move over cost.

    Every examined bar gives a row: a signal, or the first reason it was rejected.
    """
    def trend(df: DataFrame) -> DataFrame:
        b = X.blocks(X.ema_columns(_numbered(df, tile), {"fast": ("close", 9), "slow": ("close", 21)}, tile=tile), 4, tile=tile)
        return core(b.withColumn("fast3", F.lag("fast", 3).over(block_window(["symbol"]))))

    slow = trend(h1).withColumn("up", (c("fast") > c("slow")) & (c("fast") > c("fast3")) & (c("close") > c("slow")))
    mid = trend(m15).withColumn("up", (c("fast") > c("slow")) & (c("close") > c("fast")))
    fast = _fast_frame(m5, tile).filter((c("rn") > 25) & ~c("is_last")).withColumn("signal_us", c("us") + widths[0])
    # both slower frames in one scan; what counts is the bar closed at the fast bar's close
    frames = [
        (f.withColumn("_closed", c("us") + (width - widths[0])), "_closed", {f"{n}_up": "up", f"{n}_rn": "rn"})
        for n, f, width in (("m15", mid, widths[1]), ("h1", slow, widths[2]))
    ]
    rows = asof_backward_many(fast, frames, ["symbol"], tile)
    rows = durable(rows.filter((c("m15_rn") > 21) & (c("h1_rn") > 21)))
    breakout = (c("close") > c("high20")) & (c("close") > c("open")) & (c("volume") >= c("vol_med") * 1.20)
    pullback = (
        (c("low") <= c("fast") * 1.0015) & (c("close") > c("fast")) & (c("close") > c("prev_close")) & (c("volume") >= c("vol_med") * 0.75)
    )
    rows = rows.withColumns(
        {
            "setup": F.when(breakout, "BREAKOUT_EXPANSION").when(pullback, "TREND_PULLBACK"),
            "stop": c("low3") - c("atr") * 0.10,
        }
    ).withColumn("risk", c("close") - c("stop"))
    distance = F.greatest(c("risk") * min_reward, c("close") * 0.006)
    move = distance / c("close") * 100
    rejection = (
        F.when(~c("h1_up"), "REGIME")
        .when(~c("m15_up"), "STRUCTURE")
        .when(c("setup").isNull(), "NO_SETUP")
        .when(c("risk") <= 0, "RR_LT_2")
        .when(move < min_move, "GROSS_MOVE_LT_0_60")
        .when(move / max(round_trip_cost_pct, 1e-12) < min_ratio, "MOVE_TO_COST_LT_3")
        .when(F.try_divide(distance, c("risk")) < min_reward, "RR_LT_2")
    )
    return rows.select(
        "symbol", "signal_us", rejection.alias("rejection"), "setup", c("close").alias("entry"), "stop",
        (c("close") + distance).alias("target"), "atr",
        F.when(c("setup") == "BREAKOUT_EXPANSION", 0.75).otherwise(0.70).alias("confidence"),
    )


# -- event detectors -------------------------------------------------------------------------------
def detect_flags(sec: DataFrame, scale: float) -> DataFrame:
    """Trigger conditions of the four detectors. Needs the rolling columns of a second bar.

    ``past_900``.. are values far enough back (null when the history is too short).
    """
    vol = c("past_900").isNotNull() & c("return_60").isNotNull() & (F.abs("return_60") >= 1.5 * c("rv_300"))
    margin = 0.25 * c("rv_900") * scale
    brk = c("past_900").isNotNull() & ((c("mid") > c("prior_high") + margin) | (c("mid") < c("prior_low") - margin))
    acc = (
        c("past_1800").isNotNull() & c("rate5_median").isNotNull() & (c("rate_5") >= 2 * c("rate5_median"))
        & (F.abs("return_5") >= 0.5 * c("rv_60"))
    )
    rel = (
        c("past_14400").isNotNull() & c("previous_range").isNotNull() & c("range_p20").isNotNull()
        & (c("previous_range") <= c("range_p20")) & (c("range_60") >= 1.5 * c("previous_range"))
    )
    flags = {"VOLATILITY_EVENT": vol, "BREAKOUT_EVENT": brk, "ACCELERATION_EVENT": acc, "COMPRESSION_RELEASE_EVENT": rel}
    return sec.withColumns({n.lower(): F.coalesce(f, F.lit(False)) for n, f in flags.items()})


def triggered(sec: DataFrame, flags: list[str]) -> DataFrame:
    """Long table of triggered rows: only these enter the cooldown."""
    names = F.array_compact(F.array(*[F.when(c(f), f.upper()) for f in flags]))
    return sec.select("symbol", "us", F.explode(names).alias("scheme"))


def cooldown(events: DataFrame, seconds: dict[str, int] | int, period: int = DAY) -> DataFrame:
    """Greedy thinning: keep the first row, drop rows closer than the pause to the last kept one.

    It restarts every UTC day, so a group is one (symbol, scheme, day) of already sparse rows and holds
    at most one row per second of the day.
    """
    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("us")
        last, kept = None, []
        for us, pause in zip(pdf["us"], pdf["_pause"], strict=True):
            ok = last is None or us >= last + pause
            kept.append(ok)
            last = us if ok else last
        return pdf.loc[kept, ["symbol", "us", "scheme"]]

    if isinstance(seconds, int):
        pause = F.lit(seconds)
    else:
        pause = F.element_at(F.create_map(*[x for n, s in seconds.items() for x in (F.lit(n), F.lit(s))]), c("scheme"))
    rows = events.select("symbol", "us", "scheme", pause.cast("long").alias("_pause"), cell("us", period).alias("_day"))
    kind = dict(events.dtypes)["symbol"]
    return rows.groupBy("symbol", "scheme", "_day").applyInPandas(keep, f"symbol {kind}, us bigint, scheme string")


def merge_event_types(events: DataFrame) -> DataFrame:
    """One row per time with the sorted set of its schemes."""
    return events.groupBy("symbol", "us").agg(F.array_sort(F.collect_set("scheme")).alias("schemes"))


# -- episodes --------------------------------------------------------------------------------------
# state codes of the episode machine: not started; unarmed or armed, each with whether the last score
# was below activation; active long; active short
_UNINIT, _UN, _UN_B, _AR, _AR_B, _LONG, _SHORT = range(7)


def _advance(state: int, ok: bool, side: int, below: bool, rearm: bool) -> int:
    if state in (_LONG, _SHORT):
        if ok and side == (1 if state == _LONG else -1):
            return state
        return (_AR if rearm else _UN) + below
    if state == _UNINIT:
        return (_AR if rearm else _UN) + below
    if state in (_UN, _UN_B):
        return (_AR if rearm else _UN) + below
    if state == _AR_B and ok:
        return _LONG if side > 0 else _SHORT
    return _AR + below


# what a row can be to the machine: activating long or short, below the lower level, between, or above and not activating
_CLASSES = {
    (True, 1, False, False): 0, (True, -1, False, False): 1, (False, 0, True, True): 2, (False, 0, True, False): 3, (False, 0, False, False): 4,
}


def _packed(ok: bool, side: int, below: bool, rearm: bool) -> int:
    """Where each of the seven states leads, three bits a state."""
    return sum(_advance(s, ok, side, below, rearm) << 3 * s for s in range(7))


_STAY = sum(s << 3 * s for s in range(7))


def _led(packed: Column, state: Column) -> Column:
    """The state to which a packed map leads ``state``."""
    return F.call_function("shiftright", packed, (3 * state).cast("int")).bitwiseAND(F.lit(7))


def _composed(earlier: list, later: list) -> list:
    first, then = earlier[0], later[0]
    total = F.lit(0).cast("long")
    for s in range(7):
        middle = F.shiftright(first, 3 * s).bitwiseAND(F.lit(7))
        total = total + F.shiftleft(_led(then, middle), 3 * s)
    return [total]


def episodes(scored: DataFrame, on: int = 90, rearm: int = 85, tile: int = DAY, fan: int = 1024) -> DataFrame:
    """Hysteresis episodes of a score: start on an upward crossing when armed and unblocked, end on score,
    blocker or direction, re-arm below the lower level; an episode open at the range start is censored.

    Needs symbol, us, score, direction (1, -1, 0) and blocked; ``rearm`` is at most ``on``. The machine has seven states, and a row is one of five maps between
    them. Each of these maps changes nothing when applied twice, so only rows whose class differs from the one before
    matter; there the maps, packed into one number, are composed by doubling inside groups of rows.
    """
    if rearm > on:
        raise ValueError("the score that re-arms is not above the one that activates")
    ok = ~c("blocked") & (c("direction") != 0) & (c("score") >= on)
    kind = (
        F.when(ok & (c("direction") > 0), 0).when(ok, 1).when(c("score") < rearm, 2).when(c("score") < on, 3).otherwise(4)
    )
    rows = prefix_scan(with_tile(scored.withColumn("_class", kind), width=tile), ["symbol"], ["us"], {"_was": ("last", c("_class"))}, exclusive=True)
    rows = durable(rows.withColumn("_turn", ~c("_class").eqNullSafe(c("_was"))).drop("_was"))
    turns = durable(row_index(rows.filter("_turn").select("symbol", "us", "_tile", "_class"), ["symbol"], ["us"]).drop("_tile"))
    count = (turns.agg(F.max("rn")).first()[0] or 0) + 1
    packed = F.lit(None).cast("long")
    for key, code in _CLASSES.items():
        packed = F.when(c("_class") == code, F.lit(_packed(*key)).cast("long")).otherwise(packed)
    maps = turns.withColumn("_map", packed).withColumn("_own", c("_map"))
    reached = composed_before(maps, ["symbol"], "rn", ["_map"], [_STAY], _composed, count, fan)
    entry = _led(c("_map"), F.lit(_UNINIT)).cast("int")
    reached = reached.withColumn("_entry", entry).select("symbol", "us", "_entry", _led(c("_own"), c("_entry")).cast("int").alias("_reached"))
    rows = prefix_scan(rows.join(reached, ["symbol", "us"], "left"), ["symbol"], ["us"], {"_state": ("last", c("_reached"))})
    rows = rows.withColumn("_before", F.when(c("_turn"), c("_entry")).otherwise(c("_state")))
    active, was = c("_state") >= _LONG, c("_before") >= _LONG
    start = F.when(active & ~was, c("us"))
    rows = prefix_scan(rows, ["symbol"], ["us"], {"_start": ("last", start)})
    touched = rows.filter(active | was).withColumns({"_active": active, "_ended": was & ~active})
    side = F.when(c("_before") == _LONG, 1).otherwise(-1)
    why = F.when(c("blocked"), "BLOCKER").when(c("direction") != side, "DIRECTION_CHANGE").otherwise("SCORE_BELOW_ON")
    runs = touched.groupBy("symbol", c("_start").alias("start_us")).agg(
        F.min_by("direction", F.when(c("_active"), c("us"))).alias("direction"),
        F.min_by("score", F.when(c("_active"), c("us"))).alias("first_score"),
        F.max(F.when(c("_active"), c("score"))).alias("peak_score"),
        F.max_by("us", F.when(c("_active"), F.struct("score", -c("us")))).alias("peak_us"),
        F.sum(F.when(c("_active"), 1).otherwise(0)).alias("states"),
        F.max(F.when(c("_ended"), c("us"))).alias("_end"),
        F.max(F.when(c("_ended"), why)).alias("_why"),
    )
    last = scored.groupBy("symbol").agg(F.max("us").alias("_last"))
    return runs.join(last, "symbol").select(
        "symbol", "start_us", "direction", "first_score", "peak_score", "peak_us", "states",
        F.coalesce("_end", "_last").alias("end_us"), F.coalesce("_why", F.lit("RANGE_END")).alias("end_reason"),
    )


# -- cross section ---------------------------------------------------------------------------------
# fixed values: rank components and their weights in hundredths
RANK_WEIGHTS = {
    "return_1h": 25, "return_4h": 25, "return_24h": 15, "vs_first": 15, "vs_universe": 10,
    "volume_relative": 5, "trend_efficiency": 5,
}
# a return less the mean of its time stands where the return stands: the mean's last bits hang on the order of summation
RANKED_BY = {n: n for n in RANK_WEIGHTS} | {"vs_universe": "return_4h"}


def _regime_parts(first: object, second: object) -> dict[str, Column]:
    """Aggregates over the symbols of a time."""
    return {
        "universe_return": F.avg("return_4h"),
        "breadth": F.avg((c("return_4h") > 0).cast("double")),
        "symbols": F.count(F.lit(1)),
        "first_return": F.max(F.when(c("symbol") == first, c("return_4h"))),
        "second_return": F.max(F.when(c("symbol") == second, c("return_4h"))),
    }


def _with_regime(per: DataFrame) -> DataFrame:
    a, b = c("first_return"), c("second_return")
    regime = (
        F.when((a > 0) & (b > 0) & (c("breadth") >= 0.55), "MARKET_RISK_ON")
        .when((a < 0) & (b < 0) & (c("breadth") <= 0.45), "MARKET_RISK_OFF")
        .otherwise("MARKET_NEUTRAL")
    )
    return per.filter(a.isNotNull() & b.isNotNull()).withColumn("regime", regime)


def market_regime(features: DataFrame, first: object, second: object) -> DataFrame:
    """Regime per time from both benchmarks' return and the share of rising symbols."""
    return _with_regime(features.groupBy("us").agg(*[x.alias(n) for n, x in _regime_parts(first, second).items()]))


def rank_cross_section(features: DataFrame, first: object, second: object, position: str = "symbol", least: int = 5) -> DataFrame:
    """Weighted percentile ranks of the symbols of each time.

    A group is one timestamp across the universe: its size is the number of symbols, not of rows. Ties in
    a component go by the symbol's position in the universe, ties in the score by symbol. Components are
    compared at 12 digits, the difference from the universe by the return itself. Scores are sums of integers, divided once and kept at
    12 digits: equal sums are equal scores, and no order of summation can decide a rank or a last digit.
    """
    # the ranks need each time in one place anyway: its regime comes from there, and the features are computed once
    here = Window.partitionBy("us")
    parts = {n: x.over(here) for n, x in _regime_parts(first, second).items()}
    rows = _with_regime(features.withColumns(parts)).filter(c("symbols") >= least).withColumns(
        {
            "vs_first": c("return_4h") - c("first_return"),
            "vs_second": c("return_4h") - c("second_return"),
            "vs_universe": c("return_4h") - c("universe_return"),
        }
    )
    ranks = {}
    for n in RANK_WEIGHTS:
        w = Window.partitionBy("us").orderBy(F.round(c(RANKED_BY[n]) * 1e12), position)
        ranks[f"_r_{n}"] = F.row_number().over(w).cast("long") - 1
    rows = rows.withColumns(ranks)
    points = sum((c(f"_r_{n}") * wt for n, wt in RANK_WEIGHTS.items()), F.lit(0))
    share = points / (F.greatest(c("symbols") - 1, F.lit(1)) * 100)
    rows = rows.withColumn("score", F.round(share * 1e12) / 1e12)
    order = Window.partitionBy("us").orderBy(c("score").desc(), "symbol")
    return rows.withColumn("rank", F.row_number().over(order)).drop(*ranks)


# fixed values: entry gates in order
GATES = (
    "RELATIVE_STRENGTH_VS_BTC", "RELATIVE_STRENGTH_VS_UNIVERSE", "MOMENTUM_1H", "MOMENTUM_4H", "VOLUME",
    "LIQUIDITY", "MOVEMENT_COST_RATIO", "EXPECTED_MOVE", "M5_CONFIRMATION",
)


def entry_gates(ranked: DataFrame, profiles: DataFrame, bars: DataFrame, leaders: int) -> DataFrame:
    """Nine gates for the leaders of each time and the first one each fails.

    ``profiles(symbol, liquidity_sufficient, max_ratio)``; the confirmation bar opens at the feature time.
    """
    confirm = bars.select("symbol", "us", c("open").alias("_bo"), c("close").alias("_bc"))
    rows = ranked.filter(c("rank") <= leaders).join(profiles, "symbol", "left").join(confirm, ["symbol", "us"], "left")
    checks = (
        c("vs_first") > 0, c("vs_universe") > 0, c("return_1h") > 0, c("return_4h") >= 0, c("volume_relative") >= 1,
        c("liquidity_sufficient"), c("max_ratio") >= 3, c("expected_move_pct") >= 0.60, (c("_bo") > 0) & (c("_bc") > c("_bo")),
    )
    gates = F.array(*[F.coalesce(k, F.lit(False)) for k in checks])
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(k, F.lit(False)), n) for n, k in zip(GATES, checks, strict=True)]))
    rows = rows.withColumns({"gates": gates, "first_rejection": F.get(failed, F.lit(0))})
    return rows.withColumn("tradable", c("first_rejection").isNull()).drop("_bo", "_bc")


def timestamp_decisions(gated: DataFrame) -> DataFrame:
    """One decision per time: the best-ranked tradable leader in a risk-on market, else the first reason."""
    per = gated.groupBy("us").agg(
        F.first("regime").alias("regime"),
        F.min_by("symbol", F.when(c("tradable"), c("rank"))).alias("_signal"),
        F.min_by("first_rejection", F.when(c("first_rejection").isNotNull(), c("rank"))).alias("_first"),
    )
    on = c("regime") == "MARKET_RISK_ON"
    reason = F.when(~on, c("regime")).when(c("_signal").isNull(), F.coalesce("_first", F.lit("NO_ELIGIBLE_CANDIDATE")))
    return per.select("us", "regime", F.when(on, c("_signal")).alias("signal"), reason.alias("rejection"))


def regime_counts(regimes: DataFrame) -> DataFrame:
    """Times per regime and their share."""
    counts = regimes.groupBy("regime").agg(F.count(F.lit(1)).alias("n"))
    # three rows at most
    total = counts.agg(F.sum("n").alias("_t"))
    return counts.join(F.broadcast(total)).select("regime", "n", (c("n") / c("_t")).alias("share"))


def select_universe(profiles: DataFrame, n: int, stable: list[str], forced: list[str]) -> DataFrame:
    """First ``n`` attractive pairs by rank, plain ASCII, not stable, one per base; forced pairs are added.

    Needs symbol, base, quote, category, rank.
    """
    plain = c("symbol").rlike("^[A-Za-z0-9]+$") & (c("symbol") == F.concat("base", "quote"))
    good = profiles.filter((c("category") == "ECONOMICALLY_ATTRACTIVE") & ~c("base").isin(stable) & plain)
    best = good.groupBy("base").agg(F.min(F.struct("rank", "symbol")).alias("_b")).select("_b.*")
    chosen = best.orderBy("rank", "symbol").limit(n)
    extra = profiles.filter(c("symbol").isin(forced)).select("rank", "symbol").join(chosen, "symbol", "left_anti")
    return chosen.select("symbol", "rank").unionByName(extra.select("symbol", "rank"))


def rank_opportunities(signals: DataFrame, fee: float, slippage_bps: float, buffer: float) -> DataFrame:
    """Move over cost of each signal, its acceptance and its order within the time.

    Needs symbol, us, open, entry, target, confidence, spread_bps.
    """
    gross = (c("target") - c("entry")) / c("open") * 100
    costs = F.lit(fee * 200) + c("spread_bps") / 100 + slippage_bps / 50
    rows = signals.withColumns({"gross_pct": gross, "cost_pct": costs, "net_pct": gross - costs})
    rows = rows.withColumns({"edge": c("net_pct") * c("confidence"), "accepted": c("net_pct") > buffer})
    w = Window.partitionBy("us").orderBy(F.round("edge", 12).desc(), "symbol")
    return rows.withColumn("opportunity_rank", F.row_number().over(w))


def open_gap_filter(signals: DataFrame, bars: DataFrame, limit: float = 0.25) -> DataFrame:
    """Drop a signal whose next open is further from its reference than a share of ATR."""
    opens = bars.select("symbol", c("us").alias("signal_us"), c("open").alias("next_open"))
    both = signals.join(opens, ["symbol", "signal_us"])
    return both.filter(F.abs(c("next_open") - c("entry")) <= c("atr") * limit)


def primary_event_universe(events: DataFrame) -> DataFrame:
    """Baseline or acceleration events, one per symbol and time, with a stable index over time."""
    rows = events.filter(F.array_contains("schemes", "MINUTE_BASELINE") | F.array_contains("schemes", "ACCELERATION_EVENT"))
    one = rows.groupBy("us", "symbol").agg(F.first("schemes").alias("schemes"))
    indexed = prefix_scan(with_tile(one), [], ["us", "symbol"], {"_n": ("count", F.lit(1))})
    return indexed.select("symbol", "us", (c("_n") - 1).alias("source_index"))
