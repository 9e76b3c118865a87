"""Sampled signal quality: ticks to bars, features, score, blockers, decision and executable outcomes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteloom.functions.timing import MINUTE, WEEK, SECOND, day_text, iso_week, session_dst, weekday_name
from quoteloom.operators import bars as B
from quoteloom.operators import features as X
from quoteloom.operators import labels as L
from quoteloom.operators import micro as M
from quoteloom.operators import signals as G
from quoteloom.operators.joins import asof_backward_many
from quoteloom.operators.scans import trailing_sums
from quoteloom.session import durable


@dataclass(frozen=True)
class EdgeSettings:
    """All lengths in microseconds; the defaults are the published ones for a dense tick stream."""

    every: int = MINUTE
    frames: tuple[int, int, int] = (MINUTE, 5 * MINUTE, 15 * MINUTE)
    rates: tuple[int, int, int] = (SECOND, 5 * SECOND, 15 * SECOND)
    window: int = 60 * SECOND
    horizons: tuple[int, ...] = (5 * SECOND, 10 * SECOND, 30 * SECOND, 60 * SECOND, 180 * SECOND)
    excursion: int = 30 * SECOND
    touch: int = 180 * SECOND
    tolerance: int = 2 * SECOND
    point: float = 0.00001
    max_spread: float = 2.0
    max_age: float = 2.0
    slippage: float = 1.0
    commission: float = 2.0
    contract: float = 100_000.0
    lots: float = 0.01


M15_COLS = {"m15_structure": "structure", "m15_direction": "direction", "m15_regime": "regime", "m15_available": "available"}
M5_COLS = {
    "m5_direction": "direction", "m5_momentum": "momentum", "m5_breakout_retest": "breakout_retest",
    "m5_support_distance": "support_distance", "m5_resistance_distance": "resistance_distance", "m5_available": "available",
}
M1_COLS = {
    "m1_momentum_1": "momentum_1", "m1_momentum_3": "momentum_3", "m1_momentum_5": "momentum_5", "m1_atr": "atr",
    "m1_range_atr": "range_atr", "m1_body_ratio": "body_ratio", "m1_available": "available",
}


def tick_block(ticks: DataFrame, s: EdgeSettings) -> DataFrame:
    """Rates, change shares and acceleration of every tick in one sweep."""
    moved = M.tick_changes(ticks, s.window)
    specs = {f"rate_{n}": (F.lit(1), w) for n, w in zip(("1", "5", "15"), s.rates, strict=True)}
    specs["visible_ticks"] = (F.lit(1), s.window)
    out = trailing_sums(moved, ["symbol"], specs | M.flow_specs({"w": s.window}))
    out = out.withColumns(M.imbalance_columns("w"))
    accel = F.col("rate_1") - F.col("rate_5") / (s.rates[1] / s.rates[0])
    out = out.withColumns({"up_share": F.col("up_share_w"), "down_share": F.col("down_share_w"), "rate_acceleration": accel})
    return out.drop("up_w", "down_w", "up_share_w", "down_share_w", "prev_us", "d_mid", "d_spread", "d_us")


def feature_snapshot(ticks: DataFrame, s: EdgeSettings) -> DataFrame:
    """One wide row per sample: tick block, and the last closed bar of three frames."""
    # bars and samples are far smaller than the ticks and are referred to several times
    m1 = durable(B.bars_from_ticks(ticks, s.frames[0]))
    m5, m15 = (B.rollup_bars(m1, w).filter("complete") for w in s.frames[1:])
    obs = durable(B.sample_first(tick_block(ticks, s), s.every))
    med = M.spread_context(obs.select("symbol", "us", "seq", "spread"), ticks, s.window).select("symbol", "us", "seq", "median_spread")
    obs = obs.join(med, ["symbol", "us", "seq"])
    obs = obs.withColumns(
        {
            "spread_points": F.col("spread") / s.point,
            "median_spread_points": F.col("median_spread") / s.point,
            "tick_age": F.lit(0.0),
        }
    )
    frames = (
        (X.m15_block(m15), s.frames[2], M15_COLS),
        (X.m5_block(m5), s.frames[1], M5_COLS),
        (X.m1_block(m1.filter("complete")), s.frames[0], M1_COLS),
    )
    rights = [(X.close_time(bars, width), "close_us", columns) for bars, width, columns in frames]
    obs = asof_backward_many(durable(obs), rights, ["symbol"], width=4 * WEEK)
    # a sample without a closed bar in every frame has no feature base
    return obs.filter("m15_available IS NOT NULL AND m5_available IS NOT NULL AND m1_available IS NOT NULL")


def decisions(snapshot: DataFrame, s: EdgeSettings) -> DataFrame:
    voted = G.vote_trigger(G.vote_bias(snapshot), s.max_age)
    return G.decide(G.blockers(G.score(voted, s.max_age, s.max_spread), s.max_age, s.max_spread), s.point)


def observations(ticks: DataFrame, s: EdgeSettings) -> DataFrame:
    """Decisions with calendar keys and, for unblocked rows with a direction, their executable outcomes."""
    rows = durable(decisions(feature_snapshot(ticks, s), s))
    horizons = {str(i): h for i, h in enumerate(s.horizons)}
    main = str(len(s.horizons) // 2)
    buy = F.col("trigger") == "BUY"
    rows = L.executable_returns(rows, ticks, horizons, s.tolerance, s.point)
    rows = L.mfe_mae(rows, ticks, s.excursion, s.point)
    rows = L.first_touch(durable(rows), ticks, s.touch, "trigger", "stop_points", "target_points", s.point)
    complete = F.col("mfe_long").isNotNull() & F.col("stop_points").isNotNull() & (F.col("trigger") != "NEUTRAL")
    for n in horizons:
        complete = complete & F.col(f"long_{n}").isNotNull()
    free = F.size("blockers") == 0
    rows = rows.withColumns({"blocked": ~free, "usable": free & complete})
    sided = {f"return_{n}": F.when(buy, F.col(f"long_{n}")).otherwise(F.col(f"short_{n}")) for n in horizons}
    sided["market"] = F.when(buy, F.col(f"mid_{main}")).otherwise(-F.col(f"mid_{main}"))
    sided["mfe"] = F.when(buy, F.col("mfe_long")).otherwise(F.col("mfe_short"))
    sided["mae"] = F.when(buy, F.col("mae_long")).otherwise(F.col("mae_short"))
    rows = rows.withColumns({k: F.when(F.col("usable"), v) for k, v in sided.items()})
    rows = L.cost_ladder(rows, "market", f"return_{main}", s.slippage, s.commission, s.point, s.contract, s.lots)
    hit = (F.col(f"return_{main}") > 0).cast("double")
    return rows.withColumns(
        {
            "accuracy": hit,
            "touch": F.when(F.col("usable"), F.col("touch")),
            "status": L.outcome_status(F.col("blocked"), F.col("usable")),
            "date": day_text("us"),
            "week": iso_week("us"),
            "weekday": weekday_name("us"),
            "session": session_dst("us"),
        }
    )
