"""Scores, setups, events, episodes and ranking on the quote stream and on weekly candles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quoteloom.catalog.features import RS_CTES, TILE, W, ema_cte, over, recursive, seeded_sql, strength
from quoteloom.catalog.labels import FWD, HZ, OBS, POINT, TOL, fwd
from quoteloom.catalog.micro import CHANGES, SEC, pairs_sql, rng, seconds
from quoteloom.catalog.registry import CANDLES, QUOTES, register, with_views
from quoteloom.functions.output import round_doubles
from quoteloom.functions.timing import DAY, HOUR, WEEK
from quoteloom.operators import bars as B
from quoteloom.operators import signals as G
from quoteloom.plans import edge as E
from quoteloom.plans.events import EventSettings, event_dataset
from quoteloom.session import durable
from quoteloom.sources.views import candles, quotes, table

SET = E.EdgeSettings(
    every=HOUR, frames=(HOUR, 3 * HOUR, 6 * HOUR), rates=(2 * HOUR, 10 * HOUR, 30 * HOUR), window=12 * HOUR,
    horizons=(2 * HOUR, 4 * HOUR, 6 * HOUR, 12 * HOUR, 24 * HOUR), excursion=6 * HOUR, touch=24 * HOUR,
    tolerance=TOL, point=POINT, max_spread=8.0, contract=1000.0,
)


def bars_cte(n: str, width: int) -> str:
    """Complete bars of one frame with row number and the frame columns the snapshot uses."""
    w = f"OVER (PARTITION BY symbol ORDER BY us)"
    return f"""{n}0 AS (SELECT symbol, us // {width} * {width} AS us, arg_min(mid, (us, seq)) AS open, max(mid) AS high, min(mid) AS low,
      arg_max(mid, (us, seq)) AS close FROM quotes GROUP BY symbol, us // {width} * {width}),
    {n}1 AS (SELECT * FROM {n}0 QUALIFY us < max(us) OVER (PARTITION BY symbol, us // {DAY})),
    {n} AS (SELECT *, us + {width} AS close_us, row_number() {w} AS rn, list(close) {over('62 PRECEDING AND CURRENT ROW')} AS l,
      greatest(high - low, abs(high - lag(close) {w}), abs(low - lag(close) {w})) AS tr FROM {n}1),
    {n}t AS (SELECT *, avg(tr) {over('13 PRECEDING AND CURRENT ROW')} AS atr FROM {n})"""


E3, E8, E5 = seeded_sql("close", 3)[0], seeded_sql("close", 8)[0], seeded_sql("close", 5)
M15 = f"""m15f AS (SELECT *, CASE WHEN len(l) > 1 THEN {E5[0]} - {E5[1]} ELSE 0 END AS slope,
    CASE WHEN lag(high, 2) {W} < lag(high) {W} AND lag(high) {W} < high AND lag(low, 2) {W} < lag(low) {W} AND lag(low) {W} < low THEN 'HH_HL'
      WHEN lag(high, 2) {W} > lag(high) {W} AND lag(high) {W} > high AND lag(low, 2) {W} > lag(low) {W} AND lag(low) {W} > low THEN 'LH_LL' ELSE 'MIXED' END AS structure FROM m15t),
  m15g AS (SELECT symbol, close_us, structure, sign(slope) AS direction, least(rn, 63) AS available,
    CASE WHEN structure <> 'MIXED' AND atr > 0 AND abs(slope) >= atr * 0.05 THEN 'TREND' ELSE 'RANGE' END AS regime FROM m15f)"""
M5 = f"""m5f AS (SELECT *, max(high) {over('6 PRECEDING AND 2 PRECEDING')} AS r5, min(low) {over('6 PRECEDING AND 2 PRECEDING')} AS s5,
    count(*) {over('6 PRECEDING AND 2 PRECEDING')} AS n5, lag(close) {W} AS pc, min(low) {over('19 PRECEDING AND CURRENT ROW')} AS sup,
    max(high) {over('19 PRECEDING AND CURRENT ROW')} AS res FROM m5t),
  m5g AS (SELECT symbol, close_us, sign({E3} - {E8}) AS direction, coalesce(close - lag(close, 3) {W}, 0) AS momentum, least(rn, 63) AS available,
    CASE WHEN n5 = 5 AND pc > r5 AND low <= r5 AND close >= r5 THEN 'BULLISH' WHEN n5 = 5 AND pc < s5 AND high >= s5 AND close <= s5 THEN 'BEARISH' END AS breakout_retest,
    CASE WHEN atr > 0 THEN greatest((close - sup) / atr, 0) ELSE 0 END AS support_distance,
    CASE WHEN atr > 0 THEN greatest((res - close) / atr, 0) ELSE 0 END AS resistance_distance FROM m5f)"""
M1 = f"""m1g AS (SELECT symbol, close_us, coalesce(close - lag(close, 1) {W}, 0) AS momentum_1, coalesce(close - lag(close, 3) {W}, 0) AS momentum_3,
    coalesce(close - lag(close, 5) {W}, 0) AS momentum_5, atr, CASE WHEN atr > 0 THEN (high - low) / atr ELSE 0 END AS range_atr,
    CASE WHEN high = low THEN 0 ELSE abs(close - open) / (high - low) END AS body_ratio, least(rn, 63) AS available FROM m1t)"""
TICKF = f"""tk AS (SELECT *, count(*) {rng(2)} AS rate_1, count(*) {rng(10)} AS rate_5, count(*) {rng(30)} AS rate_15, count(*) {rng(12)} AS visible_ticks,
    median(spread) {rng(12)} AS median_spread,
    CASE WHEN us - lag(us, 2) OVER (PARTITION BY symbol ORDER BY us, seq) <= {12 * HOUR} THEN
      (mid - lag(mid) OVER (PARTITION BY symbol ORDER BY us, seq)) - (lag(mid) OVER (PARTITION BY symbol ORDER BY us, seq) - lag(mid, 2) OVER (PARTITION BY symbol ORDER BY us, seq)) ELSE 0 END AS acceleration FROM quotes),
  fl AS (SELECT symbol, us, seq, count(CASE WHEN dm > 0 THEN 1 END) AS u, count(CASE WHEN dm < 0 THEN 1 END) AS n FROM ({pairs_sql(12)}) GROUP BY ALL),
  snap0 AS (SELECT t.*, CASE WHEN u + n > 0 THEN u / (u + n) ELSE 0.5 END AS up_share, CASE WHEN u + n > 0 THEN n / (u + n) ELSE 0.5 END AS down_share,
    rate_1 - rate_5 / 5 AS rate_acceleration, spread / {POINT} AS spread_points, median_spread / {POINT} AS median_spread_points
    FROM (SELECT * FROM tk QUALIFY row_number() OVER (PARTITION BY symbol, us // {HOUR} ORDER BY us, seq) = 1) t JOIN fl USING (symbol, us, seq)),
  snap AS (SELECT o.*, a.structure AS m15_structure, a.direction AS m15_direction, a.regime AS m15_regime, a.available AS m15_available,
    b.direction AS m5_direction, b.momentum AS m5_momentum, b.breakout_retest AS m5_breakout_retest, b.support_distance AS m5_support_distance,
    b.resistance_distance AS m5_resistance_distance, b.available AS m5_available, c.momentum_1 AS m1_momentum_1, c.momentum_3 AS m1_momentum_3,
    c.momentum_5 AS m1_momentum_5, c.atr AS m1_atr, c.range_atr AS m1_range_atr, c.body_ratio AS m1_body_ratio, c.available AS m1_available
    FROM snap0 o ASOF JOIN m15g a ON a.symbol = o.symbol AND o.us >= a.close_us ASOF JOIN m5g b ON b.symbol = o.symbol AND o.us >= b.close_us
    ASOF JOIN m1g c ON c.symbol = o.symbol AND o.us >= c.close_us)"""
SNAP = (QUOTES, CHANGES, bars_cte("m1", HOUR), bars_cte("m5", 3 * HOUR), bars_cte("m15", 6 * HOUR), M15, M5, M1, TICKF)
SNAP_COLS = (
    "rate_1", "rate_5", "rate_15", "visible_ticks", "up_share", "down_share", "acceleration", "rate_acceleration", "spread_points",
    "median_spread_points", "m15_structure", "m15_direction", "m15_regime", "m15_available", "m5_direction", "m5_momentum", "m5_breakout_retest",
    "m5_support_distance", "m5_resistance_distance", "m5_available", "m1_momentum_1", "m1_momentum_3", "m1_momentum_5", "m1_atr", "m1_range_atr",
    "m1_body_ratio", "m1_available",
)
TEXT = ("m15_structure", "m15_regime", "m5_breakout_retest")


@register(
    "f17_feature_snapshot",
    with_views(*SNAP) + "SELECT symbol, us, seq, " + ", ".join(c if c in TEXT else f"round({c}, 6) AS {c}" for c in SNAP_COLS) + " FROM snap",
)
def f17(spark, d):
    out = E.feature_snapshot(quotes(spark, d), SET).select("symbol", "us", "seq", *SNAP_COLS)
    return round_doubles(out)


def aligned(x: str, side: str) -> str:
    return f"(({side} = 'BUY' AND {x} > 0) OR ({side} = 'SELL' AND {x} < 0))"


VOTES = """voted AS (SELECT *, CASE WHEN vb > 0 THEN 'BUY' WHEN vb < 0 THEN 'SELL' ELSE 'NEUTRAL' END AS market_bias,
    CASE WHEN vt > 0 THEN 'BUY' WHEN vt < 0 THEN 'SELL' ELSE 'NEUTRAL' END AS trigger FROM (SELECT *,
    m15_direction + CASE m15_structure WHEN 'HH_HL' THEN 1 WHEN 'LH_LL' THEN -1 ELSE 0 END + m5_direction + sign(m5_momentum) AS vb,
    sign(m1_momentum_1) + sign(m1_momentum_3) + sign(m1_momentum_5) + sign(acceleration) + CASE WHEN up_share > 0.55 THEN 1 WHEN down_share > 0.55 THEN -1 ELSE 0 END AS vt FROM snap))"""
AL = {
    "tr": f"(m15_regime = 'TREND' AND {aligned('m15_direction', 'market_bias')})", "m5t": aligned("m5_direction", "market_bias"),
    "m5m": aligned("m5_momentum", "market_bias"), "a1": aligned("m1_momentum_1", "trigger"), "a3": aligned("m1_momentum_3", "trigger"),
    "a5": aligned("m1_momentum_5", "trigger"), "fr": "trigger <> 'NEUTRAL'", "rt": "CASE WHEN trigger = 'BUY' THEN up_share ELSE down_share END >= 0.6",
    "ac": aligned("acceleration", "trigger"), "st": "(rate_1 > 0 AND rate_acceleration >= 0)",
    "stx": "m15_structure = CASE WHEN market_bias = 'BUY' THEN 'HH_HL' ELSE 'LH_LL' END",
    "br": "coalesce(m5_breakout_retest = CASE WHEN market_bias = 'BUY' THEN 'BULLISH' ELSE 'BEARISH' END, false)",
    "bal": "(m1_atr > 0 AND m1_range_atr BETWEEN 0.6 AND 1.5)", "sp": "spread_points <= 8",
}
SCORED = (
    "flags AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in AL.items()) + " FROM voted),"
    + """ scored AS (SELECT *, CASE WHEN tr THEN 15 WHEN m15_regime = 'RANGE' THEN 5 ELSE 0 END AS score_m15, CASE WHEN m5t THEN 8 ELSE 0 END + CASE WHEN m5m THEN 7 ELSE 0 END AS score_m5,
      CASE WHEN a1 THEN 5 ELSE 0 END + CASE WHEN a3 THEN 5 ELSE 0 END + CASE WHEN a5 THEN 5 ELSE 0 END AS score_m1,
      CASE WHEN fr THEN CASE WHEN rt THEN 8 ELSE 0 END + CASE WHEN ac THEN 4 ELSE 0 END + CASE WHEN st THEN 3 ELSE 0 END ELSE 0 END AS score_tick,
      CASE WHEN stx THEN 8 ELSE 0 END + CASE WHEN br THEN 7 ELSE 0 END AS score_structure, CASE WHEN bal THEN 10 WHEN m1_atr > 0 THEN 6 ELSE 0 END AS score_volatility,
      CASE WHEN sp THEN 6 + CASE WHEN spread_points <= median_spread_points * 1.25 THEN 4 ELSE 0 END ELSE 0 END AS score_spread, 5 AS score_context,
      array_to_string(list_filter([CASE WHEN tr THEN 'M15_' || market_bias || '_TREND' WHEN m15_regime = 'RANGE' THEN 'M15_RANGE' END, CASE WHEN m5t THEN 'M5_TREND_ALIGNED' END,
        CASE WHEN m5m THEN 'M5_MOMENTUM_ALIGNED' END, CASE WHEN a1 OR a3 OR a5 THEN 'M1_MOMENTUM_' || trigger END, CASE WHEN fr AND rt THEN 'TICK_RATIO_' || trigger END,
        CASE WHEN fr AND ac THEN 'TICK_ACCELERATION_' || trigger END, CASE WHEN fr AND st THEN 'TICK_RATE_STABLE_OR_ACCELERATING' END,
        CASE WHEN stx THEN 'M15_STRUCTURE_' || CASE WHEN market_bias = 'BUY' THEN 'HH_HL' ELSE 'LH_LL' END END,
        CASE WHEN br THEN 'M5_BREAKOUT_RETEST_' || CASE WHEN market_bias = 'BUY' THEN 'BULLISH' ELSE 'BEARISH' END END,
        CASE WHEN bal THEN 'VOLATILITY_BALANCED' WHEN m1_atr > 0 THEN 'VOLATILITY_EXTREME_OR_COMPRESSED' END, CASE WHEN sp THEN 'SPREAD_ACCEPTABLE' END, 'SESSION_AND_NEWS_CLEAR'],
        lambda x: x IS NOT NULL), ',') AS good FROM flags),
    total AS (SELECT *, score_m15 + score_m5 + score_m1 + score_tick + score_structure + score_volatility + score_spread + score_context AS score,
      good || CASE WHEN score_m15 + score_m5 + score_m1 + score_tick + score_structure + score_volatility + score_spread + score_context < 90 THEN ',SCORE_BELOW_CANDIDATE_THRESHOLD' ELSE '' END AS reasons,
      array_to_string(list_filter([CASE WHEN m15_available < 14 OR m5_available < 20 OR m1_available < 15 THEN 'FEATURE_WARMUP_INCOMPLETE' END,
        CASE WHEN m15_available < 14 THEN 'INSUFFICIENT_M15_HISTORY' END, CASE WHEN m5_available < 20 THEN 'INSUFFICIENT_M5_HISTORY' END,
        CASE WHEN m1_available < 15 THEN 'INSUFFICIENT_M1_HISTORY' END, CASE WHEN visible_ticks < 3 THEN 'INSUFFICIENT_TICK_HISTORY' END,
        CASE WHEN spread_points > 8 THEN 'SPREAD_TOO_HIGH' END,
        CASE WHEN market_bias = 'NEUTRAL' OR trigger = 'NEUTRAL' THEN 'DIRECTION_CONFLICT' WHEN market_bias <> trigger THEN 'MARKET_TRIGGER_DIVERGENCE' END,
        CASE WHEN trigger <> 'NEUTRAL' THEN CASE WHEN m5_direction = 0 THEN 'M5_DIRECTION_UNCONFIRMED'
          WHEN m5_direction <> CASE WHEN trigger = 'BUY' THEN 1 ELSE -1 END THEN 'TRIGGER_AGAINST_M5_TREND' END END], lambda x: x IS NOT NULL), ',') AS blockers FROM scored),
    decided AS (SELECT *, CASE WHEN score < 80 THEN 'WAIT' WHEN score < 90 THEN 'WATCH' WHEN score < 95 THEN 'CANDIDATE' ELSE 'PREMIUM_CANDIDATE' END AS tier,
      CASE WHEN blockers = '' AND score >= 90 THEN trigger ELSE 'WAIT' END AS side, CASE WHEN m1_atr > 0 THEN greatest(1, ceil(round(m1_atr / 0.01 * 1.2, 9))) END AS stop_points FROM total),
    dec AS (SELECT *, greatest(stop_points + 1, ceil(stop_points * 1.5)) AS target_points FROM decided)"""
)
DEC = (*SNAP, VOTES, SCORED)


def decided(spark, d):
    return E.decisions(E.feature_snapshot(quotes(spark, d), SET), SET)


@register("g1_g2_votes", with_views(*SNAP, VOTES) + "SELECT symbol, us, seq, market_bias, trigger FROM voted")
def g1(spark, d):
    return decided(spark, d).select("symbol", "us", "seq", "market_bias", "trigger")


PARTS = ("score_m15", "score_m5", "score_m1", "score_tick", "score_structure", "score_volatility", "score_spread", "score_context", "score")


@register("g3_score", with_views(*DEC) + f"SELECT symbol, us, seq, {', '.join(PARTS)}, reasons FROM dec")
def g3(spark, d):
    return decided(spark, d).select("symbol", "us", "seq", *PARTS, F.array_join("reasons", ",").alias("reasons"))


@register("g4_blockers", with_views(*DEC) + "SELECT symbol, us, seq, blockers FROM dec")
def g4(spark, d):
    return decided(spark, d).select("symbol", "us", "seq", F.array_join("blockers", ",").alias("blockers"))


@register("g5_decide", with_views(*DEC) + "SELECT symbol, us, seq, tier, side, CAST(stop_points AS BIGINT) AS stop_points, CAST(target_points AS BIGINT) AS target_points FROM dec")
def g5(spark, d):
    return decided(spark, d).select("symbol", "us", "seq", "tier", "side", "stop_points", "target_points")


# -- candle setups: weekly, monthly-like and quarterly-like frames stand in for the fast, middle and slow ones
MON = 4 * DAY
FAST = f"""fastn AS (SELECT *, row_number() {W} AS rn, greatest(high - low, abs(high - lag(close) {W}), abs(low - lag(close) {W})) AS tr FROM candles)"""
FASTF = f"""ff AS (SELECT n.*, a.e AS atr, f.e AS fast, s.e AS slow FROM fastn n JOIN e27 a USING (symbol, rn) JOIN ef f USING (symbol, rn) JOIN es s USING (symbol, rn)),
  ff1 AS (SELECT *, CASE WHEN rn >= 20 THEN median(volume) {over('19 PRECEDING AND CURRENT ROW')} END AS vol_med, CASE WHEN rn >= 20 THEN avg(close) {over('19 PRECEDING AND CURRENT ROW')} END AS mean,
    CASE WHEN rn >= 20 THEN stddev_samp(close) {over('19 PRECEDING AND CURRENT ROW')} END AS dev FROM ff),
  ff2 AS (SELECT *, us + {WEEK} AS signal_us, lag(close) {W} AS pc, lag(low) {W} AS pl, lag(volume) {W} AS pv, lag(vol_med) {W} AS pvm, lag(mean) {W} AS pm, lag(dev) {W} AS pd,
    max(high) {over('20 PRECEDING AND 1 PRECEDING')} AS h20, max(high) {over('21 PRECEDING AND 2 PRECEDING')} AS h20p, min(low) {over('2 PRECEDING AND CURRENT ROW')} AS low3,
    lead(us) {W} IS NULL AS is_last, close > lag(close, 3) {W} AS up FROM ff1)"""


def slow_ctes(n: str, k: int) -> tuple[str, ...]:
    w = k * WEEK
    return (
        f"""{n} AS (SELECT symbol, us, close, row_number() {W} AS rn FROM (SELECT symbol, (us - {MON}) // {w} * {w} + {MON} AS us, arg_max(close, us) AS close FROM candles
          GROUP BY 1, 2 HAVING count(*) = {k}))""",
        ema_cte(f"{n}f", n, "close", 9),
        ema_cte(f"{n}s", n, "close", 21),
    )


def slow_state(n: str, k: int) -> str:
    w = k * WEEK
    return f"""{n}a AS (SELECT x.symbol, x.us, x.rn, x.close, f.e AS fast, s.e AS slow FROM {n} x JOIN {n}f f USING (symbol, rn) JOIN {n}s s USING (symbol, rn)),
      {n}b AS (SELECT *, us + {w} AS closed, abs(close - lag(close) {W}) AS step, lag(close, 12) {W} AS far, lag(fast, 3) {W} AS fast3 FROM {n}a),
      {n}c AS (SELECT *, sum(step) {over('11 PRECEDING AND CURRENT ROW')} AS path FROM {n}b),
      {n}d AS (SELECT *, CASE WHEN rn <= 21 THEN 'UNKNOWN' WHEN CASE WHEN path > 0 THEN abs(close - far) / path ELSE 0 END >= 0.35 AND abs(fast - slow) / close >= 0.0005 THEN
         CASE WHEN fast > slow AND fast > fast3 THEN 'TREND_UP' WHEN fast < slow AND fast < fast3 THEN 'TREND_DOWN' ELSE 'RANGE' END ELSE 'RANGE' END AS regime FROM {n}c)"""


BASE = (CANDLES, FAST, ema_cte("e27", "fastn", "tr", 27), ema_cte("ef", "fastn", "close", 9), ema_cte("es", "fastn", "close", 21), FASTF)
S2 = (*slow_ctes("k2", 2), slow_state("k2", 2))
S3 = (*slow_ctes("k3", 3), slow_state("k3", 3))


@register(
    "g6_setups_v1",
    recursive(*BASE, *S2)
    + """, j AS (SELECT f.*, k.regime, pm - 2 * pd AS band FROM ff2 f ASOF JOIN k2d k ON k.symbol = f.symbol AND f.signal_us >= k.closed WHERE f.rn > 25 AND NOT is_last AND up),
    s AS (SELECT *, CASE WHEN pc > h20p AND low <= h20p * 1.0015 AND close > h20p AND pv >= pvm * 1.2 AND regime <> 'TREND_DOWN' THEN 'BREAKOUT_RETEST'
      WHEN regime = 'TREND_UP' AND fast > slow AND low <= fast * 1.001 AND close > fast AND close > pc AND volume >= vol_med * 0.8 THEN 'MOMENTUM_PULLBACK'
      WHEN regime = 'RANGE' AND pc < band AND close > pc AND mean > close THEN 'RANGE_MEAN_REVERSION' END AS setup FROM j),
    o AS (SELECT *, CASE setup WHEN 'BREAKOUT_RETEST' THEN least(low, h20p - atr * 0.35) WHEN 'MOMENTUM_PULLBACK' THEN low3 - atr * 0.1 ELSE least(pl, low) - atr * 0.25 END AS stop,
      CASE setup WHEN 'BREAKOUT_RETEST' THEN close + atr * 2 WHEN 'MOMENTUM_PULLBACK' THEN close + atr * 1.5 ELSE mean END AS target,
      CASE setup WHEN 'BREAKOUT_RETEST' THEN 0.75 WHEN 'MOMENTUM_PULLBACK' THEN 0.7 ELSE least(0.8, 0.55 + abs(pc - band) / greatest(atr, 1e-12) / 10) END AS confidence FROM s WHERE setup IS NOT NULL)
    SELECT symbol, signal_us, setup, regime, round(close, 6) AS entry, round(stop, 6) AS stop, round(target, 6) AS target, round(atr, 6) AS atr, round(confidence, 6) AS confidence
    FROM o WHERE stop < close""",
)
def g6(spark, d):
    m5 = durable(candles(spark, d))  # all frames read it
    mom = G.X.momentum(m5, "close", 3, "m", tile=TILE).select("symbol", "us", (F.col("m") > 0).alias("up"))
    out = G.setups_v1(m5, B.rollup_complete(m5, WEEK, 2, MON), WEEK, 2 * WEEK, mom, tile=TILE)
    return round_doubles(out)


@register(
    "g7_setups_v2",
    recursive(*BASE, *S2, *S3)
    + """, j AS (SELECT f.*, a.fast > a.slow AND a.close > a.fast AS mup, b.fast > b.slow AND b.fast > b.fast3 AND b.close > b.slow AS hup, low3 - f.atr * 0.1 AS stop
      FROM ff2 f ASOF JOIN k2d a ON a.symbol = f.symbol AND f.signal_us >= a.closed ASOF JOIN k3d b ON b.symbol = f.symbol AND f.signal_us >= b.closed
      WHERE f.rn > 25 AND NOT is_last AND a.rn > 21 AND b.rn > 21),
    s AS (SELECT *, CASE WHEN close > h20 AND close > open AND volume >= vol_med * 1.2 THEN 'BREAKOUT_EXPANSION'
      WHEN low <= fast * 1.0015 AND close > fast AND close > pc AND volume >= vol_med * 0.75 THEN 'TREND_PULLBACK' END AS setup, greatest((close - stop) * 2.0, close * 0.006) AS dist FROM j)
    SELECT symbol, signal_us, setup, CASE WHEN NOT hup THEN 'REGIME' WHEN NOT mup THEN 'STRUCTURE' WHEN setup IS NULL THEN 'NO_SETUP' WHEN close - stop <= 0 THEN 'RR_LT_2'
      WHEN dist / close * 100 < 0.6 THEN 'GROSS_MOVE_LT_0_60' WHEN dist / close * 100 / 20.0 < 3 THEN 'MOVE_TO_COST_LT_3' WHEN dist / (close - stop) < 2 THEN 'RR_LT_2' END AS rejection,
      round(close, 6) AS entry, round(stop, 6) AS stop, round(close + dist, 6) AS target, round(atr, 6) AS atr, CASE WHEN setup = 'BREAKOUT_EXPANSION' THEN 0.75 ELSE 0.7 END AS confidence FROM s""",
)
def g7(spark, d):
    m5 = durable(candles(spark, d))  # all frames read it
    out = G.setups_v2(m5, B.rollup_complete(m5, WEEK, 2, MON), B.rollup_complete(m5, WEEK, 3, MON), (WEEK, 2 * WEEK, 3 * WEEK), 20.0, tile=TILE)
    return round_doubles(out)


@register(
    "g8_asof_regime",
    recursive(CANDLES, *S2)
    + f"""SELECT c.symbol, c.us, k.regime FROM candles c ASOF LEFT JOIN k2d k ON k.symbol = c.symbol AND c.us + {WEEK} >= k.closed""",
)
def g8(spark, d):
    m5 = candles(spark, d)
    slow = G.X.efficiency_regime(B.rollup_complete(m5, WEEK, 2, MON), tile=TILE)
    return G.asof_regime(m5, slow, WEEK, 2 * WEEK, {"regime": "regime"}, tile=TILE).select("symbol", "us", "regime")


# -- detectors: fixed conditions on hourly bars
DET = f"""det AS (SELECT *, mid - lag(mid, 2) OVER (PARTITION BY symbol ORDER BY us) AS r2, sqrt(sum(delta * delta) {rng(24)}) AS rv,
    max(mid) OVER (PARTITION BY symbol ORDER BY us RANGE BETWEEN {24 * HOUR} PRECEDING AND 1 PRECEDING) AS ph,
    min(mid) OVER (PARTITION BY symbol ORDER BY us RANGE BETWEEN {24 * HOUR} PRECEDING AND 1 PRECEDING) AS pl, max(mid) {rng(6)} - min(mid) {rng(6)} AS rg FROM sec)"""
DET_COLS = {
    "past_900": "ph", "past_1800": "ph", "past_14400": "ph", "return_60": "r2", "return_5": "delta", "rv_300": "rv * 0.4", "rv_900": "rv", "rv_60": "rv * 0.5",
    "prior_high": "ph", "prior_low": "pl", "rate_5": "spread", "rate5_median": "0.02", "previous_range": "rg * 0.5", "range_p20": "2.0", "range_60": "rg",
}
FLAGS = f"""fl0 AS (SELECT symbol, us, mid, {', '.join(f'{v} AS {k}' for k, v in DET_COLS.items())} FROM det),
  fl AS (SELECT symbol, us, coalesce(past_900 IS NOT NULL AND return_60 IS NOT NULL AND abs(return_60) >= 1.5 * rv_300, false) AS volatility_event,
    coalesce(past_900 IS NOT NULL AND (mid > prior_high + 0.25 * rv_900 * 0.1 OR mid < prior_low - 0.25 * rv_900 * 0.1), false) AS breakout_event,
    coalesce(past_1800 IS NOT NULL AND rate_5 >= 2 * rate5_median AND abs(return_5) >= 0.5 * rv_60, false) AS acceleration_event,
    coalesce(past_14400 IS NOT NULL AND previous_range <= range_p20 AND range_60 >= 1.5 * previous_range, false) AS compression_release_event FROM fl0),
  trig AS (SELECT symbol, us, unnest(list_filter([CASE WHEN volatility_event THEN 'VOLATILITY_EVENT' END, CASE WHEN breakout_event THEN 'BREAKOUT_EVENT' END,
    CASE WHEN acceleration_event THEN 'ACCELERATION_EVENT' END, CASE WHEN compression_release_event THEN 'COMPRESSION_RELEASE_EVENT' END], lambda x: x IS NOT NULL)) AS scheme FROM fl)"""
FLAG_NAMES = ["volatility_event", "breakout_event", "acceleration_event", "compression_release_event"]


def flagged(spark, d):
    from pyspark.sql import Window

    from quoteloom.operators.micro import rolling_extreme, rolling_sum
    from quoteloom.operators.scans import row_blocks, with_tile, core

    s = seconds(spark, d)
    s = core(row_blocks(with_tile(s, width=4 * WEEK), ["symbol"], ["us"], back=2).withColumn("r2", F.col("mid") - F.lag("mid", 2).over(Window.partitionBy("symbol", "_block").orderBy("rn"))))
    s = rolling_sum(s.drop("rn", "_tile"), {"x": 24 * HOUR}).withColumnRenamed("rv_x", "rv")
    s = rolling_extreme(rolling_extreme(s, 24 * HOUR, "p", exclude_current=True), 6 * HOUR, "r")
    s = s.withColumns({"ph": F.col("high_p"), "pl": F.col("low_p"), "rg": F.col("high_r") - F.col("low_r")})
    return G.detect_flags(s.select("symbol", "us", "mid", *[F.expr(v).alias(k) for k, v in DET_COLS.items()]), 0.1)


@register("g9_detect_events", with_views(QUOTES, SEC, DET, FLAGS) + f"SELECT symbol, us, {', '.join(FLAG_NAMES)} FROM fl")
def g9(spark, d):
    return flagged(spark, d).select("symbol", "us", *FLAG_NAMES)


COOL = f"""tn AS (SELECT *, us // {DAY} AS day, row_number() OVER (PARTITION BY symbol, scheme, us // {DAY} ORDER BY us) AS k FROM trig),
  cool AS (SELECT symbol, scheme, day, k, us, us AS last, true AS keep FROM tn WHERE k = 1
    UNION ALL SELECT t.symbol, t.scheme, t.day, t.k, t.us, CASE WHEN t.us >= c.last + {3 * HOUR} THEN t.us ELSE c.last END, t.us >= c.last + {3 * HOUR}
    FROM cool c JOIN tn t ON t.symbol = c.symbol AND t.scheme = c.scheme AND t.day = c.day AND t.k = c.k + 1)"""


@register("g10_cooldown", recursive(QUOTES, SEC, DET, FLAGS, COOL) + "SELECT symbol, us, scheme FROM cool WHERE keep")
def g10(spark, d):
    return G.cooldown(G.triggered(flagged(spark, d), FLAG_NAMES), 3 * HOUR)


@register(
    "g11_merge_event_types",
    with_views(QUOTES, SEC, DET, FLAGS) + "SELECT symbol, us, string_agg(scheme, '|' ORDER BY scheme) AS schemes FROM trig GROUP BY symbol, us",
)
def g11(spark, d):
    out = G.merge_event_types(G.triggered(flagged(spark, d), FLAG_NAMES))
    return out.withColumn("schemes", F.array_join("schemes", "|"))


EPI = f"""sc AS (SELECT symbol, us, CAST(least(100, 40 + floor(spread * 500) + abs(delta) * 4) AS BIGINT) AS score, CASE WHEN delta > 0 THEN 1 WHEN delta < 0 THEN -1 ELSE 0 END AS direction,
    abs(delta) > 16 AS blocked, row_number() OVER (PARTITION BY symbol ORDER BY us) AS k FROM sec),
  ma AS (SELECT symbol, us, k, score, direction, CASE WHEN score < 75 THEN 1 ELSE 0 END AS armed, score < 80 AS pb, 0 AS act, CAST(NULL AS BIGINT) AS st, 0 AS was, CAST(NULL AS VARCHAR) AS why FROM sc WHERE k = 1
    UNION ALL SELECT s.symbol, s.us, s.k, s.score, s.direction,
      CASE WHEN m.act <> 0 THEN CASE WHEN ok AND s.direction = m.act THEN 0 ELSE CAST(s.score < 75 AS INT) END WHEN m.armed = 0 THEN CAST(s.score < 75 AS INT) WHEN m.pb AND ok THEN 0 ELSE 1 END,
      s.score < 80, CASE WHEN m.act <> 0 THEN CASE WHEN ok AND s.direction = m.act THEN m.act ELSE 0 END WHEN m.armed = 1 AND m.pb AND ok THEN s.direction ELSE 0 END,
      CASE WHEN m.act = 0 AND m.armed = 1 AND m.pb AND ok THEN s.us ELSE m.st END, m.act,
      CASE WHEN m.act <> 0 AND NOT (ok AND s.direction = m.act) THEN CASE WHEN s.blocked THEN 'BLOCKER' WHEN s.direction <> m.act THEN 'DIRECTION_CHANGE' ELSE 'SCORE_BELOW_ON' END END
    FROM ma m JOIN (SELECT *, NOT blocked AND direction <> 0 AND score >= 80 AS ok FROM sc) s ON s.symbol = m.symbol AND s.k = m.k + 1),
  la AS (SELECT symbol, max(us) AS lu FROM sec GROUP BY symbol)"""


def scored(spark, d):
    value = F.least(F.lit(100.0), 40 + F.floor(F.col("spread") * 500) + F.abs("delta") * 4)
    s = seconds(spark, d)
    return s.select("symbol", "us", F.rint(value).cast("long").alias("score"), F.signum("delta").cast("int").alias("direction"), (F.abs("delta") > 16).alias("blocked"))


@register(
    "g12_episodes",
    recursive(QUOTES, SEC, EPI)
    + """SELECT m.symbol, st AS start_us, arg_min(direction, us) FILTER (act <> 0) AS direction, arg_min(score, us) FILTER (act <> 0) AS first_score, max(score) FILTER (act <> 0) AS peak_score,
      arg_max(us, score * 1e16 - us / 1e4) FILTER (act <> 0) AS peak_us, count(*) FILTER (act <> 0) AS states, coalesce(max(us) FILTER (act = 0), any_value(lu)) AS end_us,
      coalesce(max(why), 'RANGE_END') AS end_reason FROM ma m JOIN la USING (symbol) WHERE act <> 0 OR was <> 0 GROUP BY m.symbol, st""",
)
def g12(spark, d):
    return G.episodes(scored(spark, d), 80, 75)


# -- cross section over weekly relative strength; suppliers 1 and 2 are the benchmarks
REG = """per AS (SELECT us, avg(return_4h) AS ur, avg(CASE WHEN return_4h > 0 THEN 1.0 ELSE 0.0 END) AS br, count(*) AS n, max(CASE WHEN symbol = 1 THEN return_4h END) AS a,
    max(CASE WHEN symbol = 2 THEN return_4h END) AS b FROM feat GROUP BY us),
  reg AS (SELECT *, CASE WHEN a > 0 AND b > 0 AND br >= 0.55 THEN 'MARKET_RISK_ON' WHEN a < 0 AND b < 0 AND br <= 0.45 THEN 'MARKET_RISK_OFF' ELSE 'MARKET_NEUTRAL' END AS regime
    FROM per WHERE a IS NOT NULL AND b IS NOT NULL)"""
CROSS = (
    "cr AS (SELECT f.*, n, regime, return_4h - a AS vs_first, return_4h - b AS vs_second, return_4h - ur AS vs_universe FROM feat f JOIN reg USING (us) WHERE n >= 5),"
    + " cs AS (SELECT *, round(("
    + " + ".join(f"{w} * (row_number() OVER (PARTITION BY us ORDER BY round({G.RANKED_BY[n]}, 12), symbol) - 1)" for n, w in G.RANK_WEIGHTS.items())
    + ") / (greatest(n - 1, 1) * 100), 12) AS score FROM cr), ranked AS (SELECT *, row_number() OVER (PARTITION BY us ORDER BY score DESC, symbol) AS rank FROM cs)"
)


def cross(spark, d, bars=None):
    return G.rank_cross_section(strength(spark, d, bars), 1, 2)


@register(
    "g13_rank_cross_section",
    recursive(*RS_CTES, REG, CROSS)
    + "SELECT symbol, us, regime, round(vs_first, 6) AS vs_first, round(vs_second, 6) AS vs_second, round(vs_universe, 6) AS vs_universe, round(score, 6) AS score, rank FROM ranked",
)
def g13(spark, d):
    out = cross(spark, d).select("symbol", "us", "regime", "vs_first", "vs_second", "vs_universe", "score", F.col("rank").cast("long").alias("rank"))
    return round_doubles(out)


@register(
    "g14_market_regime",
    recursive(*RS_CTES, REG) + "SELECT us, n AS symbols, round(ur, 6) AS universe_return, round(br, 6) AS breadth, regime FROM reg",
)
def g14(spark, d):
    out = G.market_regime(strength(spark, d), 1, 2).select("us", "symbols", "universe_return", "breadth", "regime")
    return round_doubles(out)


PROF = "prof AS (SELECT s_suppkey AS symbol, s_acctbal > 0 AS liquidity_sufficient, s_acctbal / 1000 AS max_ratio FROM supplier)"
GATE_SQL = """chk AS (SELECT r.*, [coalesce(vs_first > 0, false), coalesce(vs_universe > 0, false), return_1h > 0, return_4h >= 0, volume_relative >= 1, coalesce(liquidity_sufficient, false),
     coalesce(max_ratio >= 3, false), expected_move_pct >= 0.6, coalesce(c.open > 0 AND c.close > c.open, false)] AS g FROM ranked r LEFT JOIN prof p ON p.symbol = r.symbol
     LEFT JOIN candles c ON c.symbol = r.symbol AND c.us = r.us WHERE rank <= 3),
   gated AS (SELECT *, list_position(g, false) AS fp, ['""" + "', '".join(G.GATES) + """'] AS names FROM chk)"""


def gated(spark, d):
    prof = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("symbol"), (F.col("s_acctbal") > 0).alias("liquidity_sufficient"), (F.col("s_acctbal") / 1000).alias("max_ratio")
    )
    bars = durable(candles(spark, d))  # the features and the confirmation read it
    return G.entry_gates(cross(spark, d, bars), prof, bars, 3)


@register(
    "g15_entry_gates",
    recursive(*RS_CTES, REG, CROSS, PROF, GATE_SQL)
    + "SELECT symbol, us, rank, names[fp] AS first_rejection, fp IS NULL OR fp = 0 AS tradable FROM gated",
)
def g15(spark, d):
    return gated(spark, d).select("symbol", "us", F.col("rank").cast("long").alias("rank"), "first_rejection", "tradable")


@register(
    "g15_timestamp_decisions",
    recursive(*RS_CTES, REG, CROSS, PROF, GATE_SQL)
    + """, t AS (SELECT us, any_value(regime) AS regime, arg_min(symbol, rank) FILTER (fp IS NULL OR fp = 0) AS sg, arg_min(names[fp], rank) FILTER (fp > 0) AS fr FROM gated GROUP BY us)
    SELECT us, regime, CASE WHEN regime = 'MARKET_RISK_ON' THEN sg END AS signal,
      CASE WHEN regime <> 'MARKET_RISK_ON' THEN regime WHEN sg IS NULL THEN coalesce(fr, 'NO_ELIGIBLE_CANDIDATE') END AS rejection FROM t""",
)
def g15t(spark, d):
    return G.timestamp_decisions(gated(spark, d))


@register(
    "g16_regime_counts",
    recursive(*RS_CTES, REG) + "SELECT regime, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM reg GROUP BY regime",
)
def g16(spark, d):
    return round_doubles(G.regime_counts(G.market_regime(strength(spark, d), 1, 2)))


@register(
    "g17_select_universe",
    """WITH p AS (SELECT p_partkey AS rank, 'B' || (p_partkey % 40) AS base, CASE WHEN p_partkey % 7 = 0 THEN 'EUR' ELSE 'USDT' END AS quote, CASE WHEN p_size > 20 THEN 'ECONOMICALLY_ATTRACTIVE' ELSE 'WEAK' END AS category FROM part),
      s AS (SELECT *, base || quote AS symbol FROM p), g AS (SELECT * FROM s WHERE category = 'ECONOMICALLY_ATTRACTIVE' AND base NOT IN ('B1', 'B2')),
      b AS (SELECT base, min(rank) AS rank, arg_min(symbol, rank) AS symbol FROM g GROUP BY base), ch AS (SELECT symbol, rank FROM b ORDER BY rank, symbol LIMIT 10),
      f AS (SELECT symbol, min(rank) AS rank FROM s WHERE symbol IN ('B3USDT', 'B5USDT') GROUP BY symbol)
    SELECT symbol, rank FROM ch UNION ALL SELECT symbol, rank FROM f WHERE symbol NOT IN (SELECT symbol FROM ch)""",
)
def g17(spark, d):
    p = table(spark, d, "part").select(
        F.col("p_partkey").alias("rank"), F.concat(F.lit("B"), F.pmod("p_partkey", F.lit(40))).alias("base"),
        F.when(F.pmod("p_partkey", F.lit(7)) == 0, "EUR").otherwise("USDT").alias("quote"),
        F.when(F.col("p_size") > 20, "ECONOMICALLY_ATTRACTIVE").otherwise("WEAK").alias("category"),
    )
    p = p.withColumn("symbol", F.concat("base", "quote"))
    forced = ["B3USDT", "B5USDT"]
    # the exchange lists a pair once; here the best-ranked row stands for it
    once = p.filter(F.col("symbol").isin(forced)).groupBy("symbol").agg(F.min("rank").alias("rank"))
    chosen = G.select_universe(p, 10, ["B1", "B2"], [])
    return chosen.unionByName(once.join(chosen, "symbol", "left_anti").select("symbol", "rank"))


OPP = f"""opp AS (SELECT c.symbol, c.us + {WEEK} AS us, c.close AS entry, c.close * (1 + c.trades / 50.0) AS target, n.open, 0.6 + c.trades / 100.0 AS confidence, c.symbol % 7 * 10.0 AS spread_bps
    FROM candles c JOIN candles n ON n.symbol = c.symbol AND n.us = c.us + {WEEK} WHERE c.close > c.open)"""


def opportunities(spark, d):
    c = candles(spark, d)
    n = c.select("symbol", F.col("us").alias("us"), F.col("open").alias("_open"))
    rows = c.filter("close > open").select(
        "symbol", (F.col("us") + WEEK).alias("us"), F.col("close").alias("entry"), (F.col("close") * (1 + F.col("trades") / 50.0)).alias("target"),
        (0.6 + F.col("trades") / 100.0).alias("confidence"), (F.pmod("symbol", F.lit(7)) * 10.0).alias("spread_bps"),
    )
    return rows.join(n, ["symbol", "us"]).withColumnRenamed("_open", "open")


@register(
    "g18_rank_opportunities",
    with_views(CANDLES, OPP)
    + """, e AS (SELECT *, (target - entry) / open * 100 AS g, 0.001 * 200 + spread_bps / 100 + 5.0 / 50 AS k FROM opp)
    SELECT symbol, us, round(g - k, 6) AS net_pct, round((g - k) * confidence, 6) AS edge, g - k > 0.1 AS accepted,
      row_number() OVER (PARTITION BY us ORDER BY round((g - k) * confidence, 12) DESC, symbol) AS opportunity_rank FROM e""",
)
def g18(spark, d):
    out = G.rank_opportunities(opportunities(spark, d), 0.001, 5.0, 0.1)
    return round_doubles(out.select("symbol", "us", "net_pct", "edge", "accepted", F.col("opportunity_rank").cast("long").alias("opportunity_rank")))


@register(
    "g19_open_gap_filter",
    with_views(CANDLES)
    + f"""SELECT c.symbol, c.us + {WEEK} AS signal_us, round(c.close, 6) AS entry, round(n.open, 6) AS next_open FROM candles c JOIN candles n ON n.symbol = c.symbol AND n.us = c.us + {WEEK}
    WHERE abs(n.open - c.close) <= (c.high - c.low) * 0.25""",
)
def g19(spark, d):
    c = candles(spark, d)
    sig = c.select("symbol", (F.col("us") + WEEK).alias("signal_us"), F.col("close").alias("entry"), (F.col("high") - F.col("low")).alias("atr"))
    return round_doubles(G.open_gap_filter(sig, c).select("symbol", "signal_us", "entry", "next_open"))


@register("g20_event_dataset")
def g20(spark, d):
    s = EventSettings(unit=HOUR // 60, scale=0.01, tolerance=240, sample=360)
    out = event_dataset(quotes(spark, d), s, 1000.0)
    return round_doubles(out.withColumn("schemes", F.array_join("schemes", "|")))


@register(
    "g21_primary_event_universe",
    with_views(QUOTES, SEC, DET, FLAGS)
    + f""", ev AS (SELECT symbol, us, scheme FROM trig UNION ALL SELECT symbol, us, 'MINUTE_BASELINE' FROM sec QUALIFY row_number() OVER (PARTITION BY symbol, us // {6 * HOUR} ORDER BY us) = 1),
     p AS (SELECT DISTINCT symbol, us FROM ev WHERE scheme IN ('MINUTE_BASELINE', 'ACCELERATION_EVENT'))
    SELECT symbol, us, row_number() OVER (ORDER BY us, symbol) - 1 AS source_index FROM p""",
)
def g21(spark, d):
    base = B.sample_first(seconds(spark, d).select("symbol", "us"), 6 * HOUR, ("symbol",), ("us",)).withColumn("scheme", F.lit("MINUTE_BASELINE"))
    return G.primary_event_universe(G.merge_event_types(G.triggered(flagged(spark, d), FLAG_NAMES).unionByName(base)))


@register(
    "l11_weakest_forward_return",
    recursive(*RS_CTES, REG, CROSS)
    + f""", w AS (SELECT us, arg_max(symbol, rank) AS symbol FROM ranked WHERE regime = 'MARKET_RISK_OFF' GROUP BY us)
    SELECT w.symbol, w.us, round(-(b.open / a.open - 1) * 100, 6) AS short_return_pct FROM w JOIN candles a ON a.symbol = w.symbol AND a.us = w.us
    JOIN candles b ON b.symbol = w.symbol AND b.us = w.us + {WEEK}""",
)
def l11(spark, d):
    from quoteloom.operators.labels import weakest_forward_return

    bars = durable(candles(spark, d))  # the features and both opens read it
    return round_doubles(weakest_forward_return(cross(spark, d, bars), bars, WEEK))


EDGE_FWD = [fwd(f"e{i}", h, src="dec") for i, h in enumerate(SET.horizons)]


@register(
    "edge_validation",
    with_views(*DEC, *EDGE_FWD)
    + f""", nx AS (SELECT symbol, us, seq, lead(us) OVER (PARTITION BY symbol ORDER BY us, seq) AS nu FROM quotes),
    u AS (SELECT dd.*, blockers = '' AS free, f2.fb AS fb2, f2.fa AS fa2, stop_points IS NOT NULL AND trigger <> 'NEUTRAL' AND nu <= dd.us + {SET.excursion} AND f0.fb IS NOT NULL AND f1.fb IS NOT NULL AND f2.fb IS NOT NULL AND f3.fb IS NOT NULL AND f4.fb IS NOT NULL AS ok
      FROM dec dd JOIN nx USING (symbol, us, seq) """
    + " ".join(f"JOIN fwd_e{i} f{i} USING (symbol, us, seq)" for i in range(5))
    + f"""), r AS (SELECT *, CASE WHEN free AND ok THEN CASE WHEN trigger = 'BUY' THEN fb2 - ask ELSE bid - fa2 END / {POINT} END AS ret FROM u)
    SELECT symbol, CASE WHEN NOT free THEN 'SIGNAL_BLOCKED' WHEN ok THEN 'COMPLETE' ELSE 'FUTURE_DATA_INCOMPLETE' END AS status, count(*) AS n, round(avg(ret), 6) AS after_spread, round(avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0 END), 6) AS accuracy FROM r GROUP BY ALL""",
)
def edge_validation(spark, d):
    out = E.observations(quotes(spark, d), SET).groupBy("symbol", "status").agg(
        F.count(F.lit(1)).alias("n"), F.avg("after_spread").alias("after_spread"), F.avg("accuracy").alias("accuracy")
    )
    return round_doubles(out)


# -- flagship: hourly samples, executable returns by session
@register(
    "edge_by_session",
    with_views(QUOTES, OBS, *FWD)
    + f""", h AS (SELECT o.*, a.fb AS fba, a.fa AS faa, b.fb AS fbb, hour(timezone('Europe/London', timezone('UTC', make_timestamp(us)))) AS l,
        hour(timezone('America/New_York', timezone('UTC', make_timestamp(us)))) AS n, hour(timezone('Asia/Tokyo', timezone('UTC', make_timestamp(us)))) AS k
      FROM obs o JOIN fwd_a a USING (symbol, us, seq) JOIN fwd_b b USING (symbol, us, seq)),
    s AS (SELECT *, CASE WHEN l >= 8 AND l < 17 AND n >= 8 AND n < 17 THEN 'LONDON_NEW_YORK' WHEN l >= 8 AND l < 17 THEN 'LONDON' WHEN n >= 8 AND n < 17 THEN 'NEW_YORK'
      WHEN k >= 8 AND k < 17 THEN 'ASIA' ELSE 'OTHER' END AS session FROM h)
    SELECT session, count(*) AS observations, count(fba) AS usable, round(avg((fba - ask) / {POINT}), 6) AS long_short_horizon, round(avg((bid - faa) / {POINT}), 6) AS short_short_horizon,
      round(avg((fbb - ask) / {POINT}), 6) AS long_long_horizon FROM s GROUP BY session""",
)
def edge_by_session(spark, d):
    from quoteloom.functions.timing import session_dst
    from quoteloom.operators.labels import executable_returns

    q = quotes(spark, d)
    out = executable_returns(B.sample_first(q, HOUR), q, HZ, TOL, POINT)
    return round_doubles(
        out.groupBy(session_dst("us").alias("session")).agg(
            F.count(F.lit(1)).alias("observations"), F.count("long_a").alias("usable"), F.avg("long_a").alias("long_short_horizon"),
            F.avg("short_a").alias("short_short_horizon"), F.avg("long_b").alias("long_long_horizon"),
        )
    )
