"""Outcome labels: what happened after an observation, at prices that could be traded.

Long enters at the ask and leaves at the bid, short the reverse. Paths start strictly after T. Two
notions of the horizon tick are kept apart: the first tick at or after ``T + h`` within a tolerance
(returns) and the last tick at or before a timeout (barriers).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteloom.operators.joins import asof_forward
from quoteloom.operators.paths import Extreme, Neighbour, Touch, along_path
from quoteloom.operators.scans import forward_extreme

KEYS = ("symbol",)
IDENT = ("symbol", "us", "seq")


def forward_asof(obs: DataFrame, ticks: DataFrame, horizons: dict[str, int], tolerance: int) -> DataFrame:
    """One row per observation and horizon with the first tick at or after it (null beyond tolerance)."""
    steps = F.explode(F.array(*[F.struct(F.lit(n).alias("h"), F.lit(w).cast("long").alias("w")) for n, w in horizons.items()]))
    probes = obs.select("*", steps.alias("_h")).select(*obs.columns, F.col("_h.h").alias("h"), (F.col("us") + F.col("_h.w")).alias("_due"))
    found = {"future_us": "us", "future_bid": "bid", "future_ask": "ask"}
    out = asof_forward(probes, ticks, KEYS, found, tolerance, left_us="_due", right_order=["seq"])
    return out.drop("_due")


def _wide(long: DataFrame, base, horizons, values: dict[str, Column]) -> DataFrame:
    """One row per observation again; the observation's columns ride along."""
    rest = [c for c in base if c not in IDENT]
    picks = []
    for n in horizons:
        for name, value in values.items():
            picks.append(F.max(F.when(F.col("h") == n, value)).alias(f"{name}_{n}"))
    payload = [F.first(F.struct(*rest)).alias("_row")] if rest else []
    grouped = long.groupBy(*IDENT).agg(*payload, *picks)
    return grouped.select(*IDENT, *[F.col(f"_row.{c}").alias(c) for c in rest], *[c for c in grouped.columns if c not in (*IDENT, "_row")])


def executable_returns(obs: DataFrame, ticks: DataFrame, horizons: dict[str, int], tolerance: int, point: float) -> DataFrame:
    """Long, short and mid returns in points at every horizon, from one union pass."""
    long = forward_asof(obs, ticks, horizons, tolerance)
    mid = (F.col("future_bid") + F.col("future_ask")) / 2
    values = {
        "long": (F.col("future_bid") - F.col("ask")) / point,
        "short": (F.col("bid") - F.col("future_ask")) / point,
        "mid": (mid - F.col("mid")) / point,
    }
    return _wide(long, obs.columns, horizons, values)


EXTREMES = {"_max_bid": ("max", "bid"), "_min_bid": ("min", "bid"), "_max_ask": ("max", "ask"), "_min_ask": ("min", "ask")}


def _floor0(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def mfe_mae(obs: DataFrame, ticks: DataFrame, span: int, point: float) -> DataFrame:
    """Best and worst executable excursion of both sides in ``(T, T + span]``, floored at 0; null if no tick."""
    out = forward_extreme(obs, ticks, KEYS, span, EXTREMES)
    has = F.col("_max_bid").isNotNull()
    sides = {
        "mfe_long": F.col("_max_bid") - F.col("ask"),
        "mae_long": F.col("ask") - F.col("_min_bid"),
        "mfe_short": F.col("bid") - F.col("_min_ask"),
        "mae_short": F.col("_max_ask") - F.col("bid"),
    }
    return out.withColumns({n: F.when(has, _floor0(c / point)) for n, c in sides.items()}).drop(*EXTREMES)


def barrier_levels(df: DataFrame, side: str, stop: str, target: str, point: float) -> DataFrame:
    """Price levels of the barriers; the levels of the other side stay null."""
    buy = F.col(side) == "BUY"
    return df.withColumns(
        {
            "_lt": F.when(buy, F.col("ask") + F.col(target) * point),
            "_ls": F.when(buy, F.col("ask") - F.col(stop) * point),
            "_st": F.when(~buy, F.col("bid") - F.col(target) * point),
            "_ss": F.when(~buy, F.col("bid") + F.col(stop) * point),
        }
    )


BARRIERS = {"lt": ("bid", ">=", "_lt"), "ls": ("bid", "<=", "_ls"), "st": ("ask", "<=", "_st"), "ss": ("ask", ">=", "_ss")}


def _touches(end: str, carry) -> list[Touch]:
    return [Touch(n, c, op, level, end, ("us", "seq", *carry)) for n, (c, op, level) in BARRIERS.items()]


def _touched(hit: DataFrame, carry) -> DataFrame:
    """``touch``, ``target_us``, ``stop_us`` and what was carried, from the passages of the four barriers."""
    cols = {"target_us": F.coalesce("lt_us", "st_us"), "stop_us": F.coalesce("ls_us", "ss_us")}
    cols |= {"_tseq": F.coalesce("lt_seq", "st_seq"), "_sseq": F.coalesce("ls_seq", "ss_seq")}
    for c in carry:
        cols |= {f"target_{c}": F.coalesce(f"lt_{c}", f"st_{c}"), f"stop_{c}": F.coalesce(f"ls_{c}", f"ss_{c}")}
    out = hit.withColumns(cols)
    t, s = F.struct("target_us", "_tseq"), F.struct("stop_us", "_sseq")
    target_first = F.col("target_us").isNotNull() & (F.col("stop_us").isNull() | (t < s))
    touch = F.when(target_first, "TARGET_FIRST").when(F.col("stop_us").isNotNull(), "STOP_FIRST").otherwise("NEITHER")
    scratch = [f"{b}_{x}" for b in BARRIERS for x in ("us", "seq", *carry)]
    return out.withColumn("touch", touch).drop(*scratch, "_lt", "_ls", "_st", "_ss", "_tseq", "_sseq")


def first_touch(obs: DataFrame, ticks: DataFrame, span: int, side: str, stop: str, target: str, point: float, carry=(), width: int | None = None) -> DataFrame:
    """Which barrier is touched first in ``(T, T + span]``; adds ``touch`` and the touching times (one tick cannot touch both)."""
    levels = barrier_levels(obs, side, stop, target, point).withColumn("_end", F.col("us") + span)
    return _touched(along_path(levels, ticks, KEYS, _touches("_end", carry), span, width=width), carry).drop("_end")


def cost_ladder(
    df: DataFrame, mid_return: str, executable: str, slippage: float, commission: float, point: float, contract: float, lots: float
) -> DataFrame:
    """Mid return, then after spread, slippage and commission, in points and in account currency."""
    per_point = point * contract * lots / F.col("mid")
    fee = 2 * commission * lots
    return df.withColumns(
        {
            "before_costs": F.col(mid_return),
            "after_spread": F.col(executable),
            "after_slippage": F.col(executable) - 2 * slippage,
            "commission_points": F.lit(fee) / per_point,
        }
    ).withColumns(
        {
            "after_commission": F.col("after_slippage") - F.col("commission_points"),
            "after_commission_money": (F.col("after_slippage") - F.col("commission_points")) * per_point,
        }
    )


def horizon_labels(obs: DataFrame, ticks: DataFrame, horizons: dict[str, int], tolerance: int, point: float, width: int | None = None) -> DataFrame:
    """Returns and path extremes up to each horizon tick, for both sides and for the mid; all horizons from one pass over the ticks.

    The path ends at the horizon tick, so its quote joins the extremes of the open window before T + h.
    """
    path = ticks.withColumn("mid", (F.col("bid") + F.col("ask")) / 2) if "mid" not in ticks.columns else ticks
    questions: list = []
    for n in horizons:
        questions.append(Neighbour(f"_due_{n}", {f"_bid_{n}": "bid", f"_ask_{n}": "ask"}, tolerance))
        questions += [Extreme(f"_{kind}_{c}_{n}", kind, c, f"_due_{n}", inclusive=False) for kind in ("max", "min") for c in ("bid", "ask", "mid")]
    timed = obs.withColumns({f"_due_{n}": F.col("us") + w for n, w in horizons.items()})
    out = along_path(timed, path, KEYS, questions, max(horizons.values()) + tolerance, width=width)
    for n in horizons:
        fb, fa = F.col(f"_bid_{n}"), F.col(f"_ask_{n}")
        fm = (fb + fa) / 2
        ends = {"bid": fb, "ask": fa, "mid": fm}
        top = {c: F.greatest(F.col(f"_max_{c}_{n}"), v) for c, v in ends.items()}
        low = {c: F.least(F.col(f"_min_{c}_{n}"), v) for c, v in ends.items()}
        ok = fb.isNotNull()
        up, down = _floor0((top["mid"] - F.col("mid")) / point), _floor0((F.col("mid") - low["mid"]) / point)
        market = (fm - F.col("mid")) / point
        labels = {
            "market_return": market,
            "long_return": (fb - F.col("ask")) / point,
            "short_return": (F.col("bid") - fa) / point,
            "up": up,
            "down": down,
            "opportunity_mfe": F.greatest(up, down),
            "direction_mae": F.when(market >= 0, down).otherwise(up),
            "mfe_long": _floor0((top["bid"] - F.col("ask")) / point),
            "mae_long": _floor0((F.col("ask") - low["bid"]) / point),
            "mfe_short": _floor0((F.col("bid") - low["ask"]) / point),
            "mae_short": _floor0((top["ask"] - F.col("bid")) / point),
            "direction_long": F.when(market > 0, 1).otherwise(0),
        }
        out = out.withColumns({f"{k}_{n}": F.when(ok, v) for k, v in labels.items()})
    return out.drop(*[f"_due_{n}" for n in horizons], *[c for q in questions for c in q.answers()])


@dataclass(frozen=True)
class Barrier:
    """Barriers in ATR with a floor in costs, and the time allowed."""

    id: str
    stop_atr: float
    target_atr: float
    timeout: int
    target_to_cost: float


# fixed values: the four published barrier settings (seconds times one million)
BARRIER_SETTINGS = (
    Barrier("B01", 0.75, 1.25, 180_000_000, 1.5),
    Barrier("B02_PRIMARY", 1.0, 2.0, 300_000_000, 2.0),
    Barrier("B03", 1.0, 2.5, 600_000_000, 2.0),
    Barrier("B04", 1.5, 3.0, 900_000_000, 2.0),
)


def triple_barrier(
    obs: DataFrame, ticks: DataFrame, settings, tolerance: int, point: float, atr: str = "atr_points", width: int | None = None
) -> DataFrame:
    """TARGET, STOP or NEITHER per setting and side, with exit returns under three cost scenarios.

    Needs ``cost_optimistic``, ``cost_base``, ``cost_stress`` in points. One row per observation,
    setting and side; incomplete when no tick lies within the tolerance before the timeout. One pass over the
    ticks answers all settings and sides.
    """
    grid = [
        F.struct(
            F.lit(s.id).alias("setting"),
            F.lit(side).alias("side"),
            (F.col("us") + s.timeout).alias("due"),
            F.greatest(F.col(atr) * s.target_atr, F.col("cost_base") * s.target_to_cost).alias("target"),
            F.greatest(F.col(atr) * s.stop_atr, F.lit(1.0)).alias("stop"),
        )
        for s in settings
        for side in ("BUY", "SELL")
    ]
    used = [*IDENT, "bid", "ask", "mid", "cost_optimistic", "cost_base", "cost_stress"]
    both = obs.select(*used, F.explode(F.array(*grid)).alias("_g"))
    both = both.select(
        *used, F.col("_g.setting").alias("setting"), F.col("_g.side").alias("side"), F.col("_g.due").alias("_due"),
        F.col("_g.target").alias("target_points"), F.col("_g.stop").alias("stop_points"),
    )
    questions = [
        Neighbour("_due", {"_end_us": "us", "_end_bid": "bid", "_end_ask": "ask"}, tolerance, ahead=False, times=("_end_us",)),
        *[Extreme(n, kind, c, "_due") for n, (kind, c) in EXTREMES.items()],
        *_touches("_due", ("bid", "ask")),
    ]
    levels = barrier_levels(both, "side", "stop_points", "target_points", point)
    hit = _touched(along_path(levels, ticks, KEYS, questions, max(s.timeout for s in settings), width=width), ("bid", "ask"))
    hit = hit.withColumn("complete", F.coalesce(F.col("_end_us") > F.col("us"), F.lit(False)))
    buy, c = F.col("side") == "BUY", F.col("complete")

    def exit_quote(q: str) -> Column:
        return F.when(F.col("touch") == "TARGET_FIRST", F.col(f"target_{q}")).when(F.col("touch") == "STOP_FIRST", F.col(f"stop_{q}")).otherwise(F.col(f"_end_{q}"))

    hit = hit.withColumns({"_xb": exit_quote("bid"), "_xa": exit_quote("ask")})
    xm = (F.col("_xb") + F.col("_xa")) / 2
    ret = F.when(buy, F.col("_xb") - F.col("ask")).otherwise(F.col("bid") - F.col("_xa")) / point
    gross = F.when(buy, xm - F.col("mid")).otherwise(F.col("mid") - xm) / point
    best = F.when(buy, F.col("_max_bid") - F.col("ask")).otherwise(F.col("bid") - F.col("_min_ask")) / point
    worst = F.when(buy, F.col("ask") - F.col("_min_bid")).otherwise(F.col("_max_ask") - F.col("bid")) / point
    values = {
        "outcome": F.col("touch"),
        "gross_return": gross,
        "executable_return": ret,
        "base_net": ret - (F.col("cost_base") - F.col("cost_optimistic")),
        "stress_net": ret - (F.col("cost_stress") - F.col("cost_optimistic")),
        "mfe": _floor0(best),
        "mae": _floor0(worst),
        "seconds_to_target": (F.col("target_us") - F.col("us")) / 1_000_000,
        "seconds_to_stop": (F.col("stop_us") - F.col("us")) / 1_000_000,
    }
    return hit.select(*IDENT, "setting", "side", "complete", "target_points", "stop_points", *[F.when(c, v).alias(n) for n, v in values.items()])


def event_labels(events: DataFrame, ticks: DataFrame, horizons: dict[str, int], tolerance: int, point: float, cost: str) -> DataFrame:
    """Executable and signed returns, excursions, tradable movement and path quality; all horizons or no row."""
    out = horizon_labels(events, ticks, horizons, tolerance, point)
    complete = reduce(lambda a, b: a & b, [F.col(f"long_return_{n}").isNotNull() for n in horizons])
    out = out.filter(complete)
    for n in horizons:
        up, down = F.col(f"up_{n}"), F.col(f"down_{n}")
        favorable, adverse = F.greatest(up, down), F.when(up >= down, down).otherwise(up)
        out = out.withColumns(
            {
                f"signed_return_{n}": (F.col(f"long_return_{n}") - F.col(f"short_return_{n}")) / 2,
                f"tradable_ratio_{n}": favorable / F.greatest(cost, F.lit(1e-9)),
                f"path_quality_{n}": favorable / F.greatest(adverse, F.lit(1.0)),
            }
        )
    return out


# fixed values: slippage points per side and commission per lot and side of the three scenarios
COST_SCENARIOS = {"optimistic": (0.0, 0.0), "base": (1.0, 2.0), "stress": (2.0, 4.0)}


def cost_scenarios(df: DataFrame, point: float, contract: float, lots: float, scenarios=None) -> DataFrame:
    """Spread plus slippage plus commission in points, per scenario."""
    per_point = point * contract * lots / F.col("mid")
    spread = (F.col("ask") - F.col("bid")) / point
    return df.withColumns(
        {
            f"cost_{n}": spread + 2 * slip + F.lit(2 * fee * lots) / per_point
            for n, (slip, fee) in (scenarios or COST_SCENARIOS).items()
        }
    )


def inverse_outcomes(obs: DataFrame, ticks: DataFrame, side: str, horizons: dict[str, int], tolerance: int, point: float) -> DataFrame:
    """Return of the signal's side and of the opposite side at each horizon, from the same pass."""
    out = executable_returns(obs, ticks, horizons, tolerance, point)
    buy = F.col(side) == "BUY"
    cols = {}
    for n in horizons:
        cols[f"original_{n}"] = F.when(buy, F.col(f"long_{n}")).otherwise(F.col(f"short_{n}"))
        cols[f"inverse_{n}"] = F.when(buy, F.col(f"short_{n}")).otherwise(F.col(f"long_{n}"))
    return out.withColumns(cols)


def weakest_forward_return(ranked: DataFrame, bars: DataFrame, ahead: int) -> DataFrame:
    """In risk-off, the short return of the lowest-ranked symbol over ``ahead``."""
    weak = ranked.filter("regime = 'MARKET_RISK_OFF'").groupBy("us").agg(F.max_by("symbol", "rank").alias("symbol"))
    now = bars.select("symbol", "us", F.col("open").alias("_now"))
    later = bars.select("symbol", (F.col("us") - ahead).alias("us"), F.col("open").alias("_later"))
    both = weak.join(now, ["symbol", "us"]).join(later, ["symbol", "us"]).filter("_now > 0")
    return both.select("symbol", "us", (-(F.col("_later") / F.col("_now") - 1) * 100).alias("short_return_pct"))


def signal_bar_outcomes(signals: DataFrame, bars: DataFrame, timeout: int, longest: int, width: int | None = None) -> DataFrame:
    """Every signal on its own against candles: stop before target within a bar, else exit at the close of
    the first bar at or after the timeout. ``half_spread`` (a fraction) lowers the touch prices.

    Signals carry symbol, us (entry bar), entry, stop, target, half_spread.
    """
    touch = 1 - F.col("half_spread")
    sig = signals.withColumns({"_stop": F.col("stop") / touch, "_target": F.col("target") / touch, "_due": F.col("us") + timeout, "_entry": F.col("us")})
    sig = sig.withColumns({"_last": F.col("_due") + longest, "us": F.col("us") - 1})  # the entry bar is on the path
    questions = [
        Neighbour("_due", {"timeout_us": "us", "timeout_close": "close"}, longest, times=("timeout_us",)),
        Touch("stop", "low", "<=", "_stop", "timeout_us", ("us",), otherwise="_last"),
        Touch("target", "high", ">=", "_target", "timeout_us", ("us",), otherwise="_last"),
    ]
    hit = along_path(sig, bars, KEYS, questions, timeout + longest + 1, order=("us",), width=width)
    stopped = F.col("stop_us").isNotNull() & (F.col("target_us").isNull() | (F.col("stop_us") <= F.col("target_us")))
    reason = F.when(stopped, "STOP").when(F.col("target_us").isNotNull(), "TARGET").when(F.col("timeout_us").isNotNull(), "TIMEOUT").otherwise("OPEN")
    out = hit.withColumn("us", F.col("_entry")).withColumn("reason", reason)
    out = out.withColumns(
        {
            "exit_us": F.when(stopped, F.col("stop_us")).when(F.col("reason") == "TARGET", F.col("target_us")).otherwise(F.col("timeout_us")),
            "exit_price": F.when(stopped, F.col("stop")).when(F.col("reason") == "TARGET", F.col("target")).otherwise(F.col("timeout_close")),
        }
    )
    return out.drop("_stop", "_target", "_due", "_last", "_entry", "stop_us", "target_us", "timeout_us", "timeout_close")


def trade_cost_decomposition(fills: DataFrame) -> DataFrame:
    """Market result, spread, slippage, commission and net of long fills, with the identity as a check.

    Needs quantity, entry, exit (reference prices), half_spread, slippage and fee (fractions per side).
    """
    q, e, x, h, s, f = (F.col(c) for c in ("quantity", "entry", "exit", "half_spread", "slippage", "fee"))
    bought = e * (1 + h) * (1 + s)
    sold = x * (1 - h) * (1 - s)
    commission = q * bought * f + q * sold * f
    out = fills.withColumns(
        {
            "market_pnl": q * (x - e),
            "spread_cost": q * (e * h + x * h),
            "slippage_cost": q * (e * (1 + h) * s + x * (1 - h) * s),
            "commission": commission,
            "net": q * (sold - bought) - commission,
        }
    )
    cross = F.col("market_pnl") - F.col("spread_cost") - F.col("slippage_cost") - F.col("commission")
    return out.withColumn("net_crosscheck", cross)


def outcome_status(blocked: Column, complete: Column) -> Column:
    return F.when(blocked, "SIGNAL_BLOCKED").when(complete, "COMPLETE").otherwise("FUTURE_DATA_INCOMPLETE")
