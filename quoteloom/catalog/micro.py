"""Tick microstructure on the quote stream; hours stand in for seconds because the stream is sparse."""

from __future__ import annotations

from pyspark.sql import functions as F

from quoteloom.catalog.registry import QUOTES, register, with_views
from quoteloom.functions import timing as Tm
from quoteloom.functions.output import round_columns, round_doubles
from quoteloom.functions.timing import DAY, HOUR
from quoteloom.operators import bars as B
from quoteloom.operators import micro as M
from quoteloom.sources.views import quotes

P = "PARTITION BY symbol ORDER BY us, seq"
SAMPLES = f"""obs AS (SELECT * FROM quotes QUALIFY row_number() OVER (PARTITION BY symbol, us // {6 * HOUR} ORDER BY us, seq) = 1)"""
SEC = f"""sec0 AS (SELECT symbol, us, seq, bid, ask, mid, spread FROM quotes
    QUALIFY row_number() OVER (PARTITION BY symbol, us // {HOUR} ORDER BY us, seq) = 1),
  sec AS (SELECT *, coalesce(mid - lag(mid) OVER (PARTITION BY symbol ORDER BY us), 0) AS delta FROM sec0)"""


def rng(hours: float) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY us RANGE BETWEEN {int(hours * HOUR)} PRECEDING AND CURRENT ROW)"


def samples(spark, d):
    return B.sample_first(quotes(spark, d), 6 * HOUR)


def seconds(spark, d):
    return M.second_changes(B.second_bars(quotes(spark, d), HOUR))


@register(
    "t1_tick_rate",
    with_views(QUOTES)
    + f"""SELECT symbol, us, seq, count(*) {rng(2)} AS rate_short, count(*) {rng(10)} AS rate_long,
      round(count(*) {rng(2)} - count(*) {rng(10)} / 5, 6) AS rate_acceleration FROM quotes""",
)
def t1(spark, d):
    out = M.tick_rate(quotes(spark, d), {"short": 2 * HOUR, "long": 10 * HOUR})
    return round_doubles(out.select("symbol", "us", "seq", "rate_short", "rate_long", "rate_acceleration"))


CHANGES = f"""ch AS (SELECT *, mid - lag(mid) OVER ({P}) AS dm, spread - lag(spread) OVER ({P}) AS ds,
    lag(us) OVER ({P}) AS pu FROM quotes)"""


def pairs_sql(hours: float) -> str:
    return f"""SELECT q.symbol, q.us, q.seq, c.dm, c.ds, c.us - c.pu AS du FROM quotes q
      LEFT JOIN ch c ON c.symbol = q.symbol AND c.us <= q.us AND c.pu >= q.us - {int(hours * HOUR)}"""


@register(
    "t2_tick_imbalance",
    with_views(QUOTES, CHANGES)
    + f""", s AS (SELECT symbol, us, seq, count(CASE WHEN dm > 0 THEN 1 END) AS u, count(CASE WHEN dm < 0 THEN 1 END) AS n
      FROM ({pairs_sql(6)}) GROUP BY ALL)
    SELECT symbol, us, seq, round(CASE WHEN u + n > 0 THEN u / (u + n) ELSE 0.5 END, 6) AS up_share_w,
      round(CASE WHEN u + n > 0 THEN n / (u + n) ELSE 0.5 END, 6) AS down_share_w,
      round((u - n) / greatest(u + n, 1), 6) AS imbalance_w FROM s""",
)
def t2(spark, d):
    out = M.tick_imbalance(quotes(spark, d), {"w": 6 * HOUR})
    return round_doubles(out.select("symbol", "us", "seq", "up_share_w", "down_share_w", "imbalance_w"))


@register(
    "t3_price_acceleration",
    with_views(QUOTES)
    + f"""SELECT symbol, us, seq, round(CASE WHEN us - lag(us, 2) OVER ({P}) <= {6 * HOUR} THEN
      (mid - lag(mid) OVER ({P})) - (lag(mid) OVER ({P}) - lag(mid, 2) OVER ({P})) ELSE 0 END, 6) AS acceleration FROM quotes""",
)
def t3(spark, d):
    return round_doubles(M.price_acceleration(quotes(spark, d), 6 * HOUR).select("symbol", "us", "seq", "acceleration"))


@register(
    "t4_spread_context",
    with_views(QUOTES, SAMPLES)
    + f""", m AS (SELECT o.symbol, o.us, o.seq, o.spread, median(q.spread) AS md FROM obs o JOIN quotes q
      ON q.symbol = o.symbol AND q.us BETWEEN o.us - {12 * HOUR} AND o.us GROUP BY ALL)
    SELECT symbol, us, seq, round(spread, 6) AS spread, round(md, 6) AS median_spread, round(spread - md, 6) AS spread_delta,
      round(spread / greatest(md, 1e-9), 6) AS spread_ratio FROM m""",
)
def t4(spark, d):
    return round_doubles(M.spread_context(samples(spark, d), quotes(spark, d), 12 * HOUR))


@register(
    "t5_past_value",
    with_views(QUOTES)
    + f"""SELECT q.symbol, q.us, q.seq, round(q.mid - p.mid, 6) AS past_return FROM quotes q
    ASOF LEFT JOIN quotes p ON p.symbol = q.symbol AND q.us - {3 * HOUR} >= p.us""",
)
def t5(spark, d):
    out = M.past_return(quotes(spark, d), "mid", 3 * HOUR, "past_return")
    return round_doubles(out.select("symbol", "us", "seq", "past_return"))


@register(
    "t6_recent_range_position",
    with_views(QUOTES)
    + f""", w AS (SELECT *, max(mid) {rng(12)} AS hi, min(mid) {rng(12)} AS lo FROM quotes)
    SELECT symbol, us, seq, round(mid - hi, 6) AS to_high, round(mid - lo, 6) AS to_low,
      round(CASE WHEN hi > lo THEN (mid - lo) / (hi - lo) ELSE 0.5 END, 6) AS range_position,
      round(CASE WHEN volume >= 50 THEN hi - mid ELSE mid - lo END, 6) AS pullback FROM w""",
)
def t6(spark, d):
    q = quotes(spark, d).withColumn("trend", F.when(F.col("volume") >= 50, 1.0).otherwise(-1.0))
    out = M.recent_range_position(q, 12 * HOUR, "trend")
    return round_doubles(out.select("symbol", "us", "seq", "to_high", "to_low", "range_position", "pullback"))


OBS_ROWS = """SELECT o.symbol, o.us, o.seq, q.us AS qu, q.seq AS qs, q.mid - lag(q.mid) OVER (PARTITION BY o.symbol, o.us ORDER BY q.us, q.seq) AS dm
      FROM obs o JOIN quotes q ON q.symbol = o.symbol AND q.us BETWEEN o.us - {w} AND o.us"""


@register(
    "t7_run_lengths",
    with_views(QUOTES, SAMPLES)
    + f""", r AS (SELECT * FROM ({OBS_ROWS.format(w=24 * HOUR)}) WHERE dm <> 0),
      s AS (SELECT *, sign(dm) AS sg, CASE WHEN sign(dm) = lag(sign(dm)) OVER (PARTITION BY symbol, us ORDER BY qu, qs) THEN 0 ELSE 1 END AS nw,
        lead(sign(dm)) OVER (PARTITION BY symbol, us ORDER BY qu, qs) AS nx FROM r),
      t AS (SELECT *, sum(nw) OVER (PARTITION BY symbol, us ORDER BY qu, qs) AS rid FROM s),
      g AS (SELECT symbol, us, rid, count(*) AS n, any_value(sg) AS sg FROM t GROUP BY ALL),
      a AS (SELECT symbol, us, avg(n) AS rm, max(n) AS rx, arg_max(n * sg, rid) AS cur FROM g GROUP BY ALL),
      tr AS (SELECT symbol, us, count(CASE WHEN sg = 1 AND nx IS NOT NULL THEN 1 END) AS uo, count(CASE WHEN sg = 1 AND nx = 1 THEN 1 END) AS uu,
        count(CASE WHEN sg = -1 AND nx IS NOT NULL THEN 1 END) AS dow, count(CASE WHEN sg = -1 AND nx = -1 THEN 1 END) AS dd FROM t GROUP BY ALL)
    SELECT o.symbol, o.us, o.seq, round(coalesce(rm, 0), 6) AS run_mean, coalesce(rx, 0) AS run_max, coalesce(cur, 0) AS run_current,
      round(coalesce(uu / greatest(uo, 1), 0), 6) AS up_up, round(coalesce(dd / greatest(dow, 1), 0), 6) AS down_down
    FROM obs o LEFT JOIN a USING (symbol, us) LEFT JOIN tr USING (symbol, us)""",
)
def t7(spark, d):
    return round_doubles(M.run_lengths(samples(spark, d), quotes(spark, d), 24 * HOUR))


@register(
    "t8_interarrival",
    with_views(QUOTES, CHANGES)
    + f""", l AS (SELECT symbol, us, seq, avg(du) / 1e6 AS ml, stddev_pop(du / 1e6) AS sl FROM ({pairs_sql(24)}) GROUP BY ALL),
      s AS (SELECT symbol, us, seq, avg(du) / 1e6 AS ms FROM ({pairs_sql(6)}) GROUP BY ALL)
    SELECT symbol, us, seq, round(coalesce(ms, {6 * 3600}), 6) AS gap_short, round(coalesce(ml, {24 * 3600}), 6) AS gap_long,
      round(CASE WHEN ml > 0 THEN sl / ml ELSE 0 END, 6) AS gap_cv,
      round(coalesce(ml, {24 * 3600}) - coalesce(ms, {6 * 3600}), 6) AS gap_acceleration FROM l JOIN s USING (symbol, us, seq)""",
)
def t8(spark, d):
    out = M.interarrival(quotes(spark, d), 6 * HOUR, 24 * HOUR)
    out = out.select("symbol", "us", "seq", "gap_short", "gap_long", "gap_cv", "gap_acceleration")
    return round_doubles(out)


@register(
    "t9_quote_change_rates",
    with_views(QUOTES, CHANGES)
    + f""", l AS (SELECT symbol, us, seq, count(dm) AS n, count(CASE WHEN dm <> 0 THEN 1 END) AS m,
        count(CASE WHEN abs(ds) > 1e-12 THEN 1 END) AS s FROM ({pairs_sql(6)}) GROUP BY ALL)
    SELECT symbol, us, seq, round(CASE WHEN n > 0 THEN m / n ELSE 0 END, 6) AS mid_change_rate,
      round(CASE WHEN n > 0 THEN s / n ELSE 0 END, 6) AS spread_change_rate FROM l""",
)
def t9(spark, d):
    out = M.quote_change_rates(quotes(spark, d), 6 * HOUR)
    return round_doubles(out.select("symbol", "us", "seq", "mid_change_rate", "spread_change_rate"))


@register(
    "t10_rolling_sum",
    with_views(QUOTES, SEC)
    + f"""SELECT symbol, us, round(sqrt(sum(delta * delta) {rng(6)}), 6) AS rv_a, round(sum(abs(delta)) {rng(6)}, 6) AS path_a,
      round(sqrt(sum(delta * delta) {rng(48)}), 6) AS rv_b, round(sum(abs(delta)) {rng(48)}, 6) AS path_b FROM sec""",
)
def t10(spark, d):
    out = M.rolling_sum(seconds(spark, d), {"a": 6 * HOUR, "b": 48 * HOUR})
    return round_doubles(out.select("symbol", "us", "rv_a", "path_a", "rv_b", "path_b"))


@register(
    "t11_rolling_extreme",
    with_views(QUOTES, SEC)
    + f"""SELECT symbol, us, round(max(mid) {rng(24)}, 6) AS high_w, round(min(mid) {rng(24)}, 6) AS low_w,
      round(max(mid) OVER (PARTITION BY symbol ORDER BY us RANGE BETWEEN {24 * HOUR} PRECEDING AND 1 PRECEDING), 6) AS high_p,
      round(min(mid) OVER (PARTITION BY symbol ORDER BY us RANGE BETWEEN {24 * HOUR} PRECEDING AND 1 PRECEDING), 6) AS low_p FROM sec""",
)
def t11(spark, d):
    out = M.rolling_extreme(seconds(spark, d), 24 * HOUR, "w")
    out = M.rolling_extreme(out, 24 * HOUR, "p", exclude_current=True)
    return round_doubles(out.select("symbol", "us", "high_w", "low_w", "high_p", "low_p"))


@register(
    "t12_efficiency_persistence",
    with_views(QUOTES, SEC)
    + f""", w AS (SELECT *, sum(abs(delta)) {rng(24)} AS path, count(CASE WHEN delta > 0 THEN 1 END) {rng(24)} AS u,
        count(CASE WHEN delta < 0 THEN 1 END) {rng(24)} AS n FROM sec)
    SELECT w.symbol, w.us, round(CASE WHEN p.mid IS NOT NULL AND path > 1e-9 THEN abs(w.mid - p.mid) / path ELSE 0 END, 6) AS efficiency_w,
      round(CASE WHEN u + n > 0 THEN abs(u - n) / (u + n) ELSE 0 END, 6) AS persistence_w
    FROM w ASOF LEFT JOIN sec p ON p.symbol = w.symbol AND w.us - {24 * HOUR} >= p.us""",
)
def t12(spark, d):
    out = M.efficiency_persistence(seconds(spark, d), 24 * HOUR, "w")
    return round_doubles(out.select("symbol", "us", "efficiency_w", "persistence_w"))


MIN6 = f"""mins AS (SELECT * FROM sec QUALIFY row_number() OVER (PARTITION BY symbol, us // {6 * HOUR} ORDER BY us) = 1)"""


@register(
    "t13_causal_reference",
    with_views(QUOTES, SEC, MIN6)
    + f""", r AS (SELECT symbol, us // {6 * HOUR} AS c,
       count(spread) OVER w AS n, quantile_cont(spread, 0.2) OVER w AS q FROM mins
       WINDOW w AS (PARTITION BY symbol ORDER BY us RANGE BETWEEN {10 * DAY} PRECEDING AND 1 PRECEDING))
    SELECT s.symbol, s.us, CASE WHEN n >= 20 THEN round(q, 6) END AS spread_p20 FROM sec s JOIN r ON r.symbol = s.symbol AND r.c = s.us // {6 * HOUR}""",
)
def t13(spark, d):
    out = M.causal_reference(seconds(spark, d), "spread", 10 * DAY, 0.2, "spread_p20", every=6 * HOUR)
    return round_doubles(out.select("symbol", "us", "spread_p20"))


@register(
    "t14_causal_percentile",
    with_views(QUOTES, SEC, MIN6)
    + f""", j AS (SELECT s.symbol, s.us, count(m.mid) AS n, sum(CASE WHEN m.mid < s.mid THEN 1 WHEN m.mid = s.mid THEN 0.5 ELSE 0 END) AS r
      FROM sec s LEFT JOIN mins m ON m.symbol = s.symbol AND m.us >= s.us - {10 * DAY} AND m.us < s.us GROUP BY ALL)
    SELECT symbol, us, CASE WHEN n >= 20 THEN round(CAST(r AS DOUBLE) / n, 6) END AS percentile FROM j""",
)
def t14(spark, d):
    s = seconds(spark, d)
    out = M.causal_percentile(s, s, "mid", 10 * DAY, "percentile", every=6 * HOUR)
    return round_doubles(out.select("symbol", "us", "percentile"))


@register(
    "t15_failed_breakouts",
    with_views(QUOTES, SEC)
    + f""", j AS (SELECT s.symbol, s.us, s.mid AS now, r.us AS ru, r.mid AS m,
        max(r.mid) OVER w AS hi, min(r.mid) OVER w AS lo FROM sec s JOIN sec r ON r.symbol = s.symbol AND r.us BETWEEN s.us - {24 * HOUR} AND s.us
        WINDOW w AS (PARTITION BY s.symbol, s.us ORDER BY r.us RANGE BETWEEN {6 * HOUR} PRECEDING AND 1 PRECEDING))
    SELECT symbol, us, CAST(count(CASE WHEN (m > hi AND now <= hi) OR (m < lo AND now >= lo) THEN 1 END) AS DOUBLE) AS failed_breakouts,
      round(coalesce((us - max(CASE WHEN m > hi OR m < lo THEN ru END)) / 1e6, {24 * 3600}), 6) AS retest_latency FROM j GROUP BY symbol, us""",
)
def t15(spark, d):
    s = seconds(spark, d)
    return round_doubles(M.failed_breakouts(s, s, 24 * HOUR, 6 * HOUR))


@register(
    "t16_day_context",
    with_views(QUOTES, SEC)
    + f""", w AS (SELECT *, us // {DAY} AS day, max(mid) OVER d AS hi, min(mid) OVER d AS lo, avg(mid) OVER d AS tw, first(mid) OVER d AS t0 FROM sec
        WINDOW d AS (PARTITION BY symbol, us // {DAY} ORDER BY us))
    SELECT w.symbol, w.us, round(w.mid - w.hi, 6) AS to_day_high, round(w.mid - w.lo, 6) AS to_day_low,
      round(CASE WHEN w.hi > w.lo THEN (w.mid - w.lo) / (w.hi - w.lo) ELSE 0.5 END, 6) AS day_position, round(w.mid - w.tw, 6) AS to_twap,
      round(w.tw - coalesce(p.tw, w.t0), 8) AS twap_slope
    FROM w ASOF LEFT JOIN w p ON p.symbol = w.symbol AND p.day = w.day AND w.us - {3 * HOUR} >= p.us""",
)
def t16(spark, d):
    out = M.day_context(seconds(spark, d), 3 * HOUR)
    return round_columns(round_columns(out.select("symbol", "us", "to_day_high", "to_day_low", "day_position", "to_twap", "twap_slope"), "to_day_high", "to_day_low", "day_position", "to_twap"), "twap_slope", digits=8)


@register(
    "t17_opening_ranges",
    with_views(QUOTES, SEC)
    + f""", k AS (SELECT *, us // {DAY} AS day, us % {DAY} AS tod FROM sec),
      f AS (SELECT symbol, day, max(CASE WHEN tod < {7 * HOUR} THEN mid END) - min(CASE WHEN tod < {7 * HOUR} THEN mid END) AS asia,
        sqrt(sum(CASE WHEN tod >= {7 * HOUR} AND tod < {10 * HOUR} THEN delta * delta END)) AS rv,
        max(CASE WHEN tod >= {7 * HOUR} AND tod < {13 * HOUR} THEN mid END) - min(CASE WHEN tod >= {7 * HOUR} AND tod < {13 * HOUR} THEN mid END) AS rg,
        arg_min(mid, us) FILTER (tod >= {7 * HOUR}) AS op FROM k GROUP BY ALL)
    SELECT symbol, us, CASE WHEN tod >= {7 * HOUR} THEN round(asia, 6) END AS asian_range, CASE WHEN tod >= {10 * HOUR} THEN round(rv, 6) END AS opening_rv,
      CASE WHEN tod >= {13 * HOUR} THEN round(rg, 6) END AS opening_range, CASE WHEN tod >= {7 * HOUR} THEN round(mid - op, 6) END AS opening_displacement
    FROM k JOIN f USING (symbol, day)""",
)
def t17(spark, d):
    out = M.opening_ranges(seconds(spark, d), first=3 * HOUR, second=6 * HOUR)
    return round_doubles(out.select("symbol", "us", "asian_range", "opening_rv", "opening_range", "opening_displacement"))


@register(
    "t18_autocorr_varratio",
    with_views(QUOTES, SEC)
    + f""", j AS (SELECT s.symbol, s.us, r.us AS ru, r.delta AS dl, lag(r.delta) OVER w AS pl, (row_number() OVER w - 1) // 5 AS g
        FROM sec s JOIN sec r ON r.symbol = s.symbol AND r.us BETWEEN s.us - {72 * HOUR} AND s.us WINDOW w AS (PARTITION BY s.symbol, s.us ORDER BY r.us)),
      a AS (SELECT symbol, us, count(*) AS n, corr(pl, dl) AS c, var_pop(dl) AS v FROM j GROUP BY ALL),
      b AS (SELECT symbol, us, count(*) AS k, var_pop(sg) AS vg FROM (SELECT symbol, us, g, sum(dl) AS sg FROM j GROUP BY ALL) GROUP BY ALL)
    SELECT symbol, us, CASE WHEN n >= 10 AND NOT isnan(c) THEN round(c, 6) ELSE 0 END AS autocorr,
      CASE WHEN k >= 3 AND v > 1e-12 THEN round(vg / (5 * v), 6) ELSE 0 END AS variance_ratio FROM a JOIN b USING (symbol, us)""",
)
def t18(spark, d):
    s = seconds(spark, d)
    return round_doubles(M.autocorr_varratio(s, s, 72 * HOUR))


INTER_IN = {
    "volatility_percentile": "volume / 100", "return_60s": "mid - 105", "persistence_900s": "volume / 200",
    "breakout_velocity": "(mid - 104) / 15", "spread_to_volatility": "spread * 10", "pullback_amplitude": "volume",
    "efficiency_900s": "volume / 150", "imbalance_15s": "(volume - 50) / 50", "compression_release": "CASE WHEN volume > 60 THEN 1 ELSE 0 END",
    "imbalance_acceleration": "(volume - 30) / 50", "range_expansion": "spread * 30", "opening_displacement": "CASE WHEN volume > 20 THEN mid - 103 END",
    "overlap": "CASE WHEN volume > 40 THEN 1 ELSE 0 END", "to_twap": "mid - 102", "efficiency_3600s": "volume / 170",
}
INTER_OUT = (
    "x_return_high_volatility", "x_velocity_low_spread", "x_pullback_efficiency", "x_imbalance_release",
    "x_imbalance_expansion", "x_persistence_volatility", "x_displacement_overlap", "x_twap_efficiency",
)


@register(
    "t19_interactions",
    with_views(QUOTES)
    + ", e AS (SELECT seq, " + ", ".join(f"{v} AS {k}" for k, v in INTER_IN.items()) + " FROM quotes)"
    + """ SELECT seq, round(return_60s * CASE WHEN volatility_percentile >= 2 / 3 THEN 1 ELSE 0 END, 6) AS x_return_high_volatility,
      round(breakout_velocity * CASE WHEN spread_to_volatility <= 0.5 THEN 1 ELSE 0 END, 6) AS x_velocity_low_spread,
      round(pullback_amplitude * efficiency_900s, 6) AS x_pullback_efficiency, round(imbalance_15s * compression_release, 6) AS x_imbalance_release,
      round(imbalance_acceleration * range_expansion, 6) AS x_imbalance_expansion,
      round(CASE WHEN return_60s < 0 THEN -persistence_900s ELSE persistence_900s END * volatility_percentile, 6) AS x_persistence_volatility,
      round(coalesce(opening_displacement, 0) * overlap, 6) AS x_displacement_overlap, round(to_twap * efficiency_3600s, 6) AS x_twap_efficiency FROM e""",
)
def t19(spark, d):
    e = quotes(spark, d).select("seq", *[F.expr(v).alias(k) for k, v in INTER_IN.items()])
    return round_doubles(M.interactions(e).select("seq", *INTER_OUT))


@register(
    "t20_session_fixed",
    with_views(QUOTES)
    + f""", h AS (SELECT seq, us % {DAY} // {HOUR} AS h, us % {DAY} // 1000000 AS s FROM quotes)
    SELECT seq, CASE WHEN h < 7 THEN 'ASIA' WHEN h < 13 THEN 'LONDON' WHEN h < 16 THEN 'LONDON_NEW_YORK' WHEN h < 21 THEN 'NEW_YORK' ELSE 'OFF_HOURS' END AS session_a,
      CASE WHEN h < 7 THEN 'ASIA' WHEN h < 12 THEN 'LONDON' WHEN h < 16 THEN 'LONDON_NEW_YORK' WHEN h < 21 THEN 'NEW_YORK' ELSE 'OTHER' END AS session_b,
      round(s / 60 - CASE WHEN h < 7 THEN 0 WHEN h < 12 THEN 420 WHEN h < 16 THEN 720 WHEN h < 21 THEN 960 ELSE 1260 END, 6) AS session_age FROM h""",
)
def t20(spark, d):
    name, age = M.session_age()
    q = quotes(spark, d)
    return round_doubles(q.select("seq", Tm.session_fixed("us").alias("session_a"), name.alias("session_b"), age.alias("session_age")))


@register(
    "t21_session_dst",
    """WITH w AS (SELECT o_orderkey, o_orderdate + to_hours(CAST(o_orderkey % 24 AS BIGINT)) AS t FROM orders),
     h AS (SELECT o_orderkey, hour(timezone('Europe/London', timezone('UTC', t))) AS l, hour(timezone('America/New_York', timezone('UTC', t))) AS n,
       hour(timezone('Asia/Tokyo', timezone('UTC', t))) AS k FROM w)
    SELECT o_orderkey, CASE WHEN l >= 8 AND l < 17 AND n >= 8 AND n < 17 THEN 'LONDON_NEW_YORK' WHEN l >= 8 AND l < 17 THEN 'LONDON'
      WHEN n >= 8 AND n < 17 THEN 'NEW_YORK' WHEN k >= 8 AND k < 17 THEN 'ASIA' ELSE 'OTHER' END AS session FROM h""",
)
def t21(spark, d):
    from quoteloom.sources.views import micros, table

    o = table(spark, d, "orders")
    at = micros("o_orderdate") + F.pmod("o_orderkey", F.lit(24)) * HOUR
    return o.select("o_orderkey", Tm.session_dst(at).alias("session"))


@register(
    "t22_calendar_keys",
    """SELECT l_orderkey, l_linenumber, l_partkey, strftime(l_shipdate, '%Y-%m-%d') AS day, strftime(l_shipdate, '%G-W%V') AS week,
      strftime(l_shipdate, '%A') AS weekday, strftime(l_shipdate, '%Y-%m') AS month FROM lineitem""",
)
def t22(spark, d):
    from quoteloom.sources.views import ledger

    return ledger(spark, d).select(
        "l_orderkey", "l_linenumber", "l_partkey", Tm.day_text("us").alias("day"), Tm.iso_week("us").alias("week"),
        Tm.weekday_name("us").alias("weekday"), Tm.month_text("us").alias("month"),
    )


DIR_IN = {
    "ema_slope": "mid - 105", "slow_atr": "spread * 3", "momentum": "mid - 104", "mid_atr": "spread * 2",
    "upper_wick": "volume / 200", "lower_wick": "1 - volume / 150", "momentum_1": "volume - 50", "body_ratio": "volume / 120",
    "breakout_retest": "CASE WHEN volume < 30 THEN 'BULLISH' WHEN volume < 60 THEN 'BEARISH' END",
    "support_distance": "volume / 10", "resistance_distance": "volume / 20",
}


@register(
    "t23_normalised_direction_features",
    with_views(QUOTES)
    + ", e AS (SELECT seq, " + ", ".join(f"{v} AS {k}" for k, v in DIR_IN.items()) + " FROM quotes),"
    + """ b AS (SELECT *, CASE WHEN breakout_retest = 'BULLISH' THEN support_distance WHEN breakout_retest = 'BEARISH' THEN -resistance_distance ELSE 0 END AS bd FROM e)
    SELECT seq, round(ema_slope / greatest(slow_atr, 1e-9), 6) AS slope_atr, round(momentum / greatest(mid_atr, 1e-9), 6) AS momentum_atr,
      round((lower_wick - upper_wick) / greatest(lower_wick + upper_wick, 1e-9), 6) AS wick_pressure, round(sign(momentum_1) * body_ratio, 6) AS body_pressure,
      round(bd, 6) AS breakout_distance, round(CASE WHEN breakout_retest IS NOT NULL THEN 1 / (1 + abs(bd)) ELSE 0 END, 6) AS retest_quality FROM b""",
)
def t23(spark, d):
    e = quotes(spark, d).select("seq", *[F.expr(v).alias(k) for k, v in DIR_IN.items()])
    out = M.normalised_direction_features(e)
    return round_doubles(out.select("seq", "slope_atr", "momentum_atr", "wick_pressure", "body_pressure", "breakout_distance", "retest_quality"))


@register(
    "t24_regime_tags",
    with_views(QUOTES)
    + """SELECT seq, CASE WHEN volume <= 10 THEN 'UNKNOWN' WHEN volume / 100 < 1 / 3 THEN 'LOW' WHEN volume / 100 < 2 / 3 THEN 'MEDIUM' ELSE 'HIGH' END AS volatility_regime,
      CASE WHEN spread * 4 >= 0.3 THEN 'TREND' ELSE 'RANGE' END AS trend_regime FROM quotes""",
)
def t24(spark, d):
    q = quotes(spark, d).select("seq", F.expr("CASE WHEN volume > 10 THEN volume / 100 END").alias("p"), (F.col("spread") * 4).alias("e"))
    return M.regime_tags(q, "p", "e").select("seq", "volatility_regime", "trend_regime")
