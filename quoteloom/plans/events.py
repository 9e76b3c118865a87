"""Event table: second bars, rolling context, detectors, cooldown, the 88 features and the labels.

Features of an event come from three passes: rolling columns of all seconds (needed by the detectors), one pass over the ticks
and one over the seconds that answer all other questions at the events alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteloom.functions.timing import DAY, HOUR, SECOND, day_text, iso_week
from quoteloom.operators import bars as B
from quoteloom.operators import labels as L
from quoteloom.operators import micro as M
from quoteloom.operators import signals as G
from quoteloom.operators.joins import past_values
from quoteloom.operators.paths import TrailingQuantile, TrailingRank, along_path
from quoteloom.operators.scans import trailing_sums
from quoteloom.operators.sliding import Runs
from quoteloom.operators.tape import Arrivals, Changes, Flow, LocalExtremes
from quoteloom.session import durable

# fixed values: context windows and label horizons in seconds
WINDOWS = (300, 900, 1800, 3600, 14400)
HORIZONS = (30, 60, 180, 300, 600, 900)
COOLDOWNS = {
    # fixed values: pause in seconds between two kept events of one scheme
    "VOLATILITY_EVENT": 180, "BREAKOUT_EVENT": 300, "ACCELERATION_EVENT": 120, "COMPRESSION_RELEASE_EVENT": 600,
}


TICK_WINDOWS = (1, 5, 15, 30, 60)

# the 88 features and their groups
FEATURE_GROUPS: dict[str, str] = {
    **{f"{n}_{w}": g for w in WINDOWS for n, g in (("rv", "volatility"), ("range", "volatility"), ("efficiency", "trend"), ("persistence", "trend"))},
    **{n: "volatility" for n in ("atr_normalised", "range_expansion", "range_compression")},
    **{n: "trend" for n in ("autocorr", "variance_ratio", "to_day_high", "to_day_low", "day_position", "to_twap", "twap_slope")},
    **{n: "regime" for n in ("volatility_percentile", "activity_percentile")},
    **{n: "spread_cost" for n in ("spread_percentile", "spread_to_volatility", "move_to_cost", "spread_delta", "spread_points", "spread_ratio")},
    **{
        n: "session_time"
        for n in ("session_age", "since_london", "since_new_york", "overlap", "asian_range", "opening_rv", "opening_range", "opening_displacement")
    },
    **{f"imbalance_{w}s": "microstructure" for w in TICK_WINDOWS},
    **{
        n: "microstructure"
        for n in (
            "imbalance_acceleration", "run_mean", "run_max", "run_current", "up_up", "down_down", "gap_short_mean", "gap_mean", "gap_cv", "gap_acceleration",
            "quote_changes_5s", "quote_changes_60s", "spread_changes_60s", "rate_1s", "rate_5s", "rate_15s", "rate_acceleration", "uptick_ratio",
        )
    },
    **{n: "momentum" for n in ("displacement_per_tick", "return_5", "return_15", "return_30", "return_60")},
    **{n: "breakout_retest" for n in ("pullback_amplitude", "since_high", "since_low", "failed_breakouts", "breakout_velocity", "retest_latency")},
    **{
        n: "regime"
        for n in (
            "x_return_high_volatility", "x_velocity_low_spread", "x_pullback_efficiency", "x_imbalance_release", "x_imbalance_expansion",
            "x_persistence_volatility", "x_displacement_overlap", "x_twap_efficiency",
        )
    },
}


@dataclass(frozen=True)
class EventSettings:
    """Lengths in microseconds. ``unit`` stretches every published length for sparser streams."""

    unit: int = SECOND
    scale: float = 0.00001
    horizons: dict = field(default_factory=lambda: {str(h): h for h in HORIZONS})
    tolerance: int = 2
    cooldowns: dict = field(default_factory=lambda: dict(COOLDOWNS))
    sample: int = 60
    least: int = 20


def second_context(ticks: DataFrame, s: EventSettings) -> DataFrame:
    """Rolling columns of every active second, each window in one sweep or one two-cell scan."""
    u = s.unit
    # second bars are referred to by several scans: compute them from the ticks once
    sec = M.second_changes(durable(B.second_bars(ticks, u)), s.scale)
    specs = {f"_sq_{n}": (F.col("delta") * F.col("delta"), n * u) for n in (60, *WINDOWS)}
    specs |= {f"_path_{n}": (F.abs("delta"), n * u) for n in WINDOWS}
    specs |= {f"_up_{n}": (F.when(F.col("delta") > 0, 1.0), n * u) for n in WINDOWS}
    specs |= {f"_down_{n}": (F.when(F.col("delta") < 0, 1.0), n * u) for n in WINDOWS}
    specs |= {"_rate": (F.col("ticks"), 5 * u), "_rate_15": (F.col("ticks"), 15 * u)}
    sec = trailing_sums(sec, ["symbol"], specs, order=("us",))
    sec = sec.withColumns({f"rv_{n}": F.sqrt(F.greatest(f"_sq_{n}", F.lit(0.0))) for n in (60, *WINDOWS)})
    # ticks of the current second after its first one are not known yet
    sec = sec.withColumns({"rate_5": F.col("_rate") - F.col("ticks") + 1, "rate_15": F.col("_rate_15") - F.col("ticks") + 1})
    for n in (60, *WINDOWS):
        sec = M.rolling_extreme(sec, n * u, str(n))
        sec = sec.withColumn(f"range_{n}", (F.col(f"high_{n}") - F.col(f"low_{n}")) / s.scale)
    sec = M.rolling_extreme(sec, 900 * u, "p", exclude_current=True)
    sec = sec.withColumnsRenamed({"high_p": "prior_high", "low_p": "prior_low"})
    past = {f"past_{back}": ("mid", back * u) for back in (5, 15, 30, 60, *WINDOWS)}
    sec = past_values(sec, past | {"previous_range": ("range_300", 60 * u)}, ["symbol"])
    sec = sec.withColumns({f"return_{n}": (F.col("mid") - F.col(f"past_{n}")) / s.scale for n in (5, 15, 30, 60)})
    stats = {"range_median": ("range_300", 0.5), "range_p20": ("range_300", 0.2), "rate5_median": ("rate_5", 0.5)}
    sec = M.causal_references(sec, stats, 14400 * u, s.sample * u, s.least)
    for n in WINDOWS:
        moved = F.abs(F.col("mid") - F.col(f"past_{n}")) / s.scale
        known = F.col(f"past_{n}").isNotNull() & (F.col(f"_path_{n}") > 1e-9)
        up, down = F.coalesce(f"_up_{n}", F.lit(0.0)), F.coalesce(f"_down_{n}", F.lit(0.0))
        one_sided = F.when(up + down > 0.5, F.try_divide(F.abs(up - down), up + down)).otherwise(0.0)
        sec = sec.withColumns({f"efficiency_{n}": F.when(known, F.try_divide(moved, F.col(f"_path_{n}"))).otherwise(0.0), f"persistence_{n}": one_sided})
    scratch = [c for c in sec.columns if c.startswith(("_sq_", "_path_", "_up_", "_down_", "_rate", "high_", "low_"))]
    return sec.drop(*scratch)


def event_rows(sec: DataFrame, s: EventSettings) -> DataFrame:
    """Baseline samples and detector events after their cooldown, one row per time with its schemes."""
    flagged = G.detect_flags(sec, s.scale)
    hits = G.triggered(flagged, [n.lower() for n in s.cooldowns])
    kept = G.cooldown(hits, {n: p * s.unit for n, p in s.cooldowns.items()})
    base = B.sample_first(sec.select("symbol", "us"), s.sample * s.unit, ("symbol",), ("us",))
    return G.merge_event_types(kept.unionByName(base.withColumn("scheme", F.lit("MINUTE_BASELINE"))))


def event_features(rows: DataFrame, sec: DataFrame, ticks: DataFrame, s: EventSettings) -> DataFrame:
    """The features of ``FEATURE_GROUPS`` at events (rows of ``sec`` with ``schemes``)."""
    u = s.unit
    minutes = B.sample_first(sec.select("symbol", "us", "rv_300", "rate_15", "spread", "range_300"), s.sample * u, ("symbol",), ("us",))
    past = 14400 * u
    ranks = {"volatility_percentile": "rv_300", "activity_percentile": "rate_15", "spread_percentile": "spread"}
    questions = [TrailingRank(f"_{n}", x, x, past) for n, x in ranks.items()]
    questions.append(TrailingQuantile("_range_median", "range_300", 0.5, past, least=s.least))
    rows = along_path(rows, minutes, ["symbol"], questions, order=("us",), back=past)
    for n in ranks:
        share = F.try_divide(F.col(f"_{n}_below") + 0.5 * F.col(f"_{n}_equal"), F.col(f"_{n}_count"))
        rows = rows.withColumn(n, F.when(F.col(f"_{n}_count") >= s.least, share)).drop(*[f"_{n}_{k}" for k in ("count", "below", "equal")])
    tape = [
        Flow("mid", tuple((f"{w}s", w * u) for w in TICK_WINDOWS)),
        Runs("mid", 60 * u),
        Arrivals("gap_short", "us", 5 * u, u),
        Arrivals("gap", "us", 60 * u, u),
        Changes("quote_changes_5s", "mid", 5 * u),
        Changes("quote_changes_60s", "mid", 60 * u),
        Changes("spread_changes_60s", "spread", 60 * u),
        TrailingQuantile("_spread_median", "spread", 0.5, 60 * u, own=True),
        LocalExtremes("mid", 60 * u, u),
    ]
    rows = along_path(rows, ticks, ["symbol"], tape, back=60 * u)
    rows = rows.join(M.autocorr_varratio(rows, sec, 900 * u), ["symbol", "us"]).join(M.failed_breakouts(rows, sec, 60 * u, 15 * u), ["symbol", "us"])
    day = M.day_context(sec, 900 * u, s.scale).select("symbol", "us", "to_day_high", "to_day_low", "day_position", "to_twap", "twap_slope")
    opening = M.opening_ranges(sec, s.scale).select("symbol", "us", "asian_range", "opening_rv", "opening_range", "opening_displacement")
    rows = rows.join(day, ["symbol", "us"]).join(opening, ["symbol", "us"])
    session, age = M.session_age()
    minute = F.floor((F.col("us") % DAY) / (60 * SECOND))
    spread = F.col("spread") / s.scale
    tiny = F.lit(1e-9)
    rows = rows.withColumns(
        {
            "session": session,
            "session_age": age,
            "since_london": minute - 7 * 60,
            "since_new_york": minute - 12 * 60,
            "overlap": ((minute >= 12 * 60) & (minute < 16 * 60)).cast("double"),
            "atr_normalised": F.col("range_300") / F.greatest("_range_median", tiny),
            "range_expansion": F.col("range_300") / F.greatest("_range_median", tiny),
            "range_compression": F.col("_range_median") / F.greatest("range_300", tiny),
            "spread_points": spread,
            "spread_to_volatility": spread / F.greatest("rv_300", tiny),
            "spread_delta": (F.col("spread") - F.col("_spread_median")) / s.scale,
            "spread_ratio": F.col("spread") / F.greatest("_spread_median", tiny),
            "move_to_cost": F.col("range_300") / F.greatest("cost_base", tiny),
            "imbalance_acceleration": F.col("imbalance_5s") - F.col("imbalance_30s"),
            "gap_acceleration": F.col("gap_mean") - F.col("gap_short_mean"),
            "rate_acceleration": F.col("rate_1s") - F.col("rate_5s") / 5,
            "uptick_ratio": (F.col("imbalance_60s") + 1) / 2,
            "displacement_per_tick": F.col("return_15") / F.greatest("rate_15s", F.lit(1.0)),
            "pullback_amplitude": F.greatest(F.col("local_high") - F.col("mid"), F.col("mid") - F.col("local_low")) / s.scale,
            "breakout_velocity": F.col("return_15") / 15,
        }
    )
    # without a median nothing is expanded: the comparison has no value, not a value over nothing
    known = F.col("_range_median").isNotNull()
    rows = rows.withColumns({n: F.when(known, F.col(n)) for n in ("atr_normalised", "range_expansion")})
    crossed = rows.withColumns({"return_60s": F.col("return_60"), "persistence_900s": F.col("persistence_900"), "efficiency_900s": F.col("efficiency_900"),
                                "efficiency_3600s": F.col("efficiency_3600"), "compression_release": F.array_contains("schemes", "COMPRESSION_RELEASE_EVENT")})
    crossed = M.interactions(crossed).drop("return_60s", "persistence_900s", "efficiency_900s", "efficiency_3600s", "compression_release")
    return crossed.drop("_range_median", "_spread_median", "local_high", "local_low", "gap_short_cv", "rate_30s", "rate_60s")


def event_dataset(ticks: DataFrame, s: EventSettings, contract: float = 100_000.0, lots: float = 0.01) -> DataFrame:
    """Events with their features, regime tags and complete labels."""
    sec = durable(second_context(ticks, s))
    rows = durable(L.cost_scenarios(event_rows(sec, s).join(sec, ["symbol", "us"]), s.scale, contract, lots))
    rows = durable(event_features(rows, sec, ticks, s))
    rows = M.regime_tags(rows, "volatility_percentile", "efficiency_900")
    horizons = {n: h * s.unit for n, h in s.horizons.items()}
    rows = L.event_labels(rows, ticks, horizons, s.tolerance * s.unit, s.scale, "cost_base")
    return rows.withColumns({"day": day_text("us"), "week": iso_week("us"), "hour": F.floor((F.col("us") % DAY) / HOUR)})


def write_events(events: DataFrame, path: str) -> None:
    """One folder per day; range partitioning keeps a hot day in several files."""
    events.repartitionByRange("day", "us").write.mode("overwrite").partitionBy("day").option("compression", "zstd").parquet(path)

