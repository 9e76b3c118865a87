"""Outcome labels of hourly samples of the quote stream."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from quoteloom.catalog.registry import CANDLES, QUOTES, register, with_views
from quoteloom.functions.output import round_doubles
from quoteloom.functions.timing import DAY, HOUR, WEEK
from quoteloom.operators import bars as B
from quoteloom.operators import labels as L
from quoteloom.session import durable
from quoteloom.sources.views import candles, quotes

POINT = 0.01
TOL = 2 * HOUR
HZ = {"a": 3 * HOUR, "b": 24 * HOUR}
OBS = f"obs AS (SELECT * FROM quotes QUALIFY row_number() OVER (PARTITION BY symbol, us // {HOUR} ORDER BY us, seq) = 1)"


def fwd(alias: str, w: int, out: str = "fwd", src: str = "obs") -> str:
    return f"""{out}_{alias} AS (SELECT o.symbol, o.us, o.seq, CASE WHEN t.us - (o.us + {w}) <= {TOL} THEN t.bid END AS fb,
      CASE WHEN t.us - (o.us + {w}) <= {TOL} THEN t.ask END AS fa, CASE WHEN t.us - (o.us + {w}) <= {TOL} THEN t.us END AS fu,
      CASE WHEN t.us - (o.us + {w}) <= {TOL} THEN t.seq END AS fs
      FROM {src} o ASOF LEFT JOIN quotes t ON t.symbol = o.symbol AND o.us + {w} <= t.us)"""


FWD = (fwd("a", HZ["a"]), fwd("b", HZ["b"]))


def sampled(spark, d):
    return B.sample_first(quotes(spark, d), HOUR)


@register(
    "l1_forward_asof",
    with_views(QUOTES, OBS, *FWD)
    + """SELECT symbol, us, seq, 'a' AS h, fu AS future_us, round(fb, 6) AS future_bid, round(fa, 6) AS future_ask FROM fwd_a
      UNION ALL SELECT symbol, us, seq, 'b', fu, round(fb, 6), round(fa, 6) FROM fwd_b""",
)
def l1(spark, d):
    out = L.forward_asof(sampled(spark, d).select("symbol", "us", "seq"), quotes(spark, d), HZ, TOL)
    return round_doubles(out)


RET_SQL = ", ".join(
    f"round(({n}.fb - o.ask) / {POINT}, 6) AS long_{n}, round((o.bid - {n}.fa) / {POINT}, 6) AS short_{n}, round((({n}.fb + {n}.fa) / 2 - o.mid) / {POINT}, 6) AS mid_{n}"
    for n in "ab"
)
JOINED = "FROM obs o JOIN fwd_a a USING (symbol, us, seq) JOIN fwd_b b USING (symbol, us, seq)"


@register("l2_executable_returns", with_views(QUOTES, OBS, *FWD) + f"SELECT symbol, us, seq, {RET_SQL} {JOINED}")
def l2(spark, d):
    out = L.executable_returns(sampled(spark, d), quotes(spark, d), HZ, TOL, POINT)
    return round_doubles(out.select("symbol", "us", "seq", *[f"{k}_{n}" for n in HZ for k in ("long", "short", "mid")]))


@register(
    "l3_mfe_mae",
    with_views(QUOTES, OBS)
    + f"""SELECT o.symbol, o.us, o.seq, CASE WHEN count(q.us) > 0 THEN round(greatest(max(q.bid) - o.ask, 0) / {POINT}, 6) END AS mfe_long, CASE WHEN count(q.us) > 0 THEN round(greatest(o.ask - min(q.bid), 0) / {POINT}, 6) END AS mae_long,
      CASE WHEN count(q.us) > 0 THEN round(greatest(o.bid - min(q.ask), 0) / {POINT}, 6) END AS mfe_short, CASE WHEN count(q.us) > 0 THEN round(greatest(max(q.ask) - o.bid, 0) / {POINT}, 6) END AS mae_short
    FROM obs o LEFT JOIN quotes q ON q.symbol = o.symbol AND q.us > o.us AND q.us <= o.us + {12 * HOUR} GROUP BY o.symbol, o.us, o.seq, o.ask, o.bid""",
)
def l3(spark, d):
    out = L.mfe_mae(sampled(spark, d), quotes(spark, d), 12 * HOUR, POINT)
    return round_doubles(out.select("symbol", "us", "seq", "mfe_long", "mae_long", "mfe_short", "mae_short"))


SIDED = "sided AS (SELECT *, CASE WHEN volume % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, 100 + volume AS stop, 150 + 2 * volume AS target FROM obs)"


def sided(spark, d):
    return sampled(spark, d).withColumns(
        {
            "side": F.when(F.pmod("volume", F.lit(2)) == 0, "BUY").otherwise("SELL"),
            "stop": F.col("volume") + 100,
            "target": F.col("volume") * 2 + 150,
        }
    )


@register(
    "l4_first_touch",
    with_views(QUOTES, OBS, SIDED)
    + f""", p AS (SELECT o.*, q.us AS qu, q.seq AS qs, CASE WHEN side = 'BUY' THEN q.bid >= o.ask + target * {POINT} ELSE q.ask <= o.bid - target * {POINT} END AS t,
        CASE WHEN side = 'BUY' THEN q.bid <= o.ask - stop * {POINT} ELSE q.ask >= o.bid + stop * {POINT} END AS s
      FROM sided o LEFT JOIN quotes q ON q.symbol = o.symbol AND q.us > o.us AND q.us <= o.us + {24 * HOUR}),
    h AS (SELECT symbol, us, seq, min(CASE WHEN t THEN qu END) AS target_us, min(CASE WHEN s THEN qu END) AS stop_us FROM p GROUP BY symbol, us, seq)
    SELECT *, CASE WHEN target_us IS NOT NULL AND (stop_us IS NULL OR target_us < stop_us) THEN 'TARGET_FIRST' WHEN stop_us IS NOT NULL THEN 'STOP_FIRST' ELSE 'NEITHER' END AS touch FROM h""",
)
def l4(spark, d):
    out = L.first_touch(sided(spark, d), quotes(spark, d), 24 * HOUR, "side", "stop", "target", POINT)
    return out.select("symbol", "us", "seq", "target_us", "stop_us", "touch")


@register(
    "l5_cost_ladder",
    with_views(QUOTES, OBS, FWD[0])
    + f""", r AS (SELECT symbol, us, seq, o.mid, ((fb + fa) / 2 - o.mid) / {POINT} AS m, (fb - o.ask) / {POINT} AS x, {POINT} * 1000 * 0.01 / o.mid AS pp
      FROM obs o JOIN fwd_a USING (symbol, us, seq))
    SELECT symbol, us, seq, round(m, 6) AS before_costs, round(x, 6) AS after_spread, round(x - 2, 6) AS after_slippage,
      round(0.04 / pp, 6) AS commission_points, round(x - 2 - 0.04 / pp, 6) AS after_commission, round((x - 2 - 0.04 / pp) * pp, 6) AS after_commission_money FROM r""",
)
def l5(spark, d):
    out = L.executable_returns(sampled(spark, d), quotes(spark, d), {"a": HZ["a"]}, TOL, POINT)
    out = L.cost_ladder(out, "mid_a", "long_a", 1, 2, POINT, 1000, 0.01)
    return round_doubles(
        out.select("symbol", "us", "seq", "before_costs", "after_spread", "after_slippage", "commission_points", "after_commission", "after_commission_money")
    )


def path_sql(n: str, src: str = "obs") -> str:
    """Extremes from T (exclusive) to the horizon tick (inclusive)."""
    return f"""path_{n} AS (SELECT o.symbol, o.us, o.seq, o.bid, o.ask, o.mid, f.fb, f.fa, max(q.bid) AS xb, min(q.bid) AS nb, max(q.ask) AS xa, min(q.ask) AS na,
      max(q.mid) AS xm, min(q.mid) AS nm FROM {src} o JOIN fwd_{n} f USING (symbol, us, seq)
      JOIN quotes q ON q.symbol = o.symbol AND q.us > o.us AND q.us <= f.fu GROUP BY ALL),
    lab_{n} AS (SELECT symbol, us, seq, ((fb + fa) / 2 - mid) / {POINT} AS market_return, (fb - ask) / {POINT} AS long_return, (bid - fa) / {POINT} AS short_return,
      greatest(xm - mid, 0) / {POINT} AS up, greatest(mid - nm, 0) / {POINT} AS down, greatest(xb - ask, 0) / {POINT} AS mfe_long,
      greatest(ask - nb, 0) / {POINT} AS mae_long, greatest(bid - na, 0) / {POINT} AS mfe_short, greatest(xa - bid, 0) / {POINT} AS mae_short FROM path_{n})"""


LAB = ("market_return", "long_return", "short_return", "mfe_long", "mae_long", "mfe_short", "mae_short")


def lab_cols(n: str) -> str:
    return ", ".join(f"round({n}.{c}, 6) AS {c}_{n}" for c in LAB)


@register(
    "l6_horizon_labels",
    with_views(QUOTES, OBS, *FWD, path_sql("a"), path_sql("b"))
    + "SELECT o.symbol, o.us, o.seq, "
    + ", ".join(
        f"""{lab_cols(n)}, round(greatest({n}.up, {n}.down), 6) AS opportunity_mfe_{n},
        round(CASE WHEN {n}.market_return >= 0 THEN {n}.down ELSE {n}.up END, 6) AS direction_mae_{n},
        CASE WHEN {n}.market_return > 0 THEN 1 WHEN {n}.market_return IS NOT NULL THEN 0 END AS direction_long_{n}"""
        for n in "ab"
    )
    + " FROM obs o LEFT JOIN lab_a a USING (symbol, us, seq) LEFT JOIN lab_b b USING (symbol, us, seq)",
)
def l6(spark, d):
    out = L.horizon_labels(sampled(spark, d), quotes(spark, d), HZ, TOL, POINT)
    cols = [f"{c}_{n}" for n in HZ for c in (*LAB, "opportunity_mfe", "direction_mae", "direction_long")]
    return round_doubles(out.select("symbol", "us", "seq", *cols))


# the published settings, their timeouts stretched to the sparse test stream
SETTINGS = tuple(replace(b, timeout=b.timeout * 240) for b in L.BARRIER_SETTINGS)
COSTED = f"""costed AS (SELECT *, 200 + volume AS atr_points, spread / {POINT} AS cost_optimistic, spread / {POINT} + 2 + 0.04 * mid / ({POINT} * 10) AS cost_base,
   spread / {POINT} + 4 + 0.08 * mid / ({POINT} * 10) AS cost_stress FROM obs)"""


def costed(spark, d):
    o = L.cost_scenarios(sampled(spark, d), POINT, 1000, 0.01)
    return o.withColumn("atr_points", F.col("volume") + 200)


def barrier_sql(s: L.Barrier) -> str:
    return f"""t_{s.id} AS (SELECT o.*, '{s.id}' AS setting, t.us AS eu, t.bid AS eb, t.ask AS ea,
      greatest(atr_points * {s.target_atr}, cost_base * {s.target_to_cost}) AS target_points, greatest(atr_points * {s.stop_atr}, 1.0) AS stop_points,
      {s.timeout} AS tmo FROM costed o ASOF LEFT JOIN quotes t ON t.symbol = o.symbol AND o.us + {s.timeout} >= t.us)"""


@register(
    "l7_triple_barrier",
    with_views(QUOTES, OBS, COSTED, *map(barrier_sql, SETTINGS))
    + f""", tt AS (SELECT *, us + tmo - eu <= {TOL} AND eu > us AS complete FROM ({' UNION ALL '.join(f"SELECT * FROM t_{b.id}" for b in SETTINGS)})),
    sd AS (SELECT *, unnest(['BUY', 'SELL']) AS side FROM tt),
    p AS (SELECT s.symbol, s.us, s.seq, s.setting, s.side, q.us AS qu, q.bid AS qb, q.ask AS qa,
       CASE WHEN side = 'BUY' THEN (q.bid - s.ask) / {POINT} ELSE (s.bid - q.ask) / {POINT} END AS pnl,
       CASE WHEN side = 'BUY' THEN q.bid >= s.ask + target_points * {POINT} ELSE q.ask <= s.bid - target_points * {POINT} END AS ht,
       CASE WHEN side = 'BUY' THEN q.bid <= s.ask - stop_points * {POINT} ELSE q.ask >= s.bid + stop_points * {POINT} END AS hs
      FROM sd s JOIN quotes q ON q.symbol = s.symbol AND q.us > s.us AND q.us <= s.us + s.tmo),
    g AS (SELECT symbol, us, seq, setting, side, max(pnl) AS mx, min(pnl) AS mn, min(CASE WHEN ht THEN qu END) AS tu, min(CASE WHEN hs THEN qu END) AS su,
       arg_min(qb, qu) FILTER (ht) AS tb, arg_min(qa, qu) FILTER (ht) AS ta, arg_min(qb, qu) FILTER (hs) AS sb, arg_min(qa, qu) FILTER (hs) AS sa FROM p GROUP BY ALL),
    r AS (SELECT s.*, mx, mn, tu, su, CASE WHEN tu IS NOT NULL AND (su IS NULL OR tu < su) THEN 'TARGET_FIRST' WHEN su IS NOT NULL THEN 'STOP_FIRST' ELSE 'NEITHER' END AS oc,
       tb, ta, sb, sa FROM sd s LEFT JOIN g USING (symbol, us, seq, setting, side)),
    x AS (SELECT *, CASE oc WHEN 'TARGET_FIRST' THEN tb WHEN 'STOP_FIRST' THEN sb ELSE eb END AS xb, CASE oc WHEN 'TARGET_FIRST' THEN ta WHEN 'STOP_FIRST' THEN sa ELSE ea END AS xa FROM r),
    y AS (SELECT *, CASE WHEN side = 'BUY' THEN (xb - ask) / {POINT} ELSE (bid - xa) / {POINT} END AS ret,
       CASE WHEN side = 'BUY' THEN ((xb + xa) / 2 - mid) / {POINT} ELSE (mid - (xb + xa) / 2) / {POINT} END AS gr FROM x)
    SELECT symbol, us, seq, setting, side, coalesce(complete, false) AS complete, round(target_points, 6) AS target_points, round(stop_points, 6) AS stop_points,
      CASE WHEN complete THEN oc END AS outcome, CASE WHEN complete THEN round(gr, 6) END AS gross_return, CASE WHEN complete THEN round(ret, 6) END AS executable_return,
      CASE WHEN complete THEN round(ret - (cost_base - cost_optimistic), 6) END AS base_net, CASE WHEN complete THEN round(ret - (cost_stress - cost_optimistic), 6) END AS stress_net,
      CASE WHEN complete THEN round(greatest(mx, 0), 6) END AS mfe, CASE WHEN complete THEN round(greatest(-mn, 0), 6) END AS mae,
      CASE WHEN complete THEN round((tu - us) / 1e6, 6) END AS seconds_to_target, CASE WHEN complete THEN round((su - us) / 1e6, 6) END AS seconds_to_stop FROM y""",
)
def l7(spark, d):
    return round_doubles(L.triple_barrier(costed(spark, d), quotes(spark, d), SETTINGS, TOL, POINT))


EV = ("long_return", "short_return", "mfe_long", "mae_long", "mfe_short", "mae_short")


@register(
    "l8_event_labels",
    with_views(QUOTES, OBS, COSTED, *FWD, path_sql("a"), path_sql("b"))
    + "SELECT o.symbol, o.us, o.seq, "
    + ", ".join(
        ", ".join(f"round({n}.{c}, 6) AS {c}_{n}" for c in EV)
        + f""", round(({n}.long_return - {n}.short_return) / 2, 6) AS signed_return_{n}, round(greatest({n}.up, {n}.down) / greatest(cost_base, 1e-9), 6) AS tradable_ratio_{n},
        round(greatest({n}.up, {n}.down) / greatest(CASE WHEN {n}.up >= {n}.down THEN {n}.down ELSE {n}.up END, 1), 6) AS path_quality_{n}"""
        for n in "ab"
    )
    + """ FROM costed o JOIN lab_a a USING (symbol, us, seq) JOIN lab_b b USING (symbol, us, seq)""",
)
def l8(spark, d):
    out = L.event_labels(costed(spark, d), quotes(spark, d), HZ, TOL, POINT, "cost_base")
    cols = [f"{c}_{n}" for n in HZ for c in (*EV, "signed_return", "tradable_ratio", "path_quality")]
    return round_doubles(out.select("symbol", "us", "seq", *cols))


@register(
    "l9_cost_scenarios",
    with_views(QUOTES, OBS, COSTED)
    + "SELECT seq, round(cost_optimistic, 6) AS cost_optimistic, round(cost_base, 6) AS cost_base, round(cost_stress, 6) AS cost_stress FROM costed",
)
def l9(spark, d):
    return round_doubles(costed(spark, d).select("seq", "cost_optimistic", "cost_base", "cost_stress"))


@register(
    "l10_inverse_outcomes",
    with_views(QUOTES, OBS, SIDED, *FWD)
    + "SELECT symbol, us, seq, "
    + ", ".join(
        f"""round(CASE WHEN side = 'BUY' THEN ({n}.fb - o.ask) ELSE (o.bid - {n}.fa) END / {POINT}, 6) AS original_{n},
        round(CASE WHEN side = 'BUY' THEN (o.bid - {n}.fa) ELSE ({n}.fb - o.ask) END / {POINT}, 6) AS inverse_{n}"""
        for n in "ab"
    )
    + " FROM sided o JOIN fwd_a a USING (symbol, us, seq) JOIN fwd_b b USING (symbol, us, seq)",
)
def l10(spark, d):
    out = L.inverse_outcomes(sided(spark, d), quotes(spark, d), "side", HZ, TOL, POINT)
    return round_doubles(out.select("symbol", "us", "seq", *[f"{k}_{n}" for n in HZ for k in ("original", "inverse")]))


@register(
    "l12_signal_bar_outcomes",
    with_views(CANDLES)
    + f""", sig AS (SELECT c.symbol, c.us + {WEEK} AS us, e.open AS entry, e.open * 0.6 AS stop, e.open * 1.8 AS target FROM candles c
       JOIN candles e ON e.symbol = c.symbol AND e.us = c.us + {WEEK} WHERE c.close > c.open),
    tm AS (SELECT s.*, CASE WHEN t.us <= s.us + {8 * WEEK} THEN t.us END AS tu, CASE WHEN t.us <= s.us + {8 * WEEK} THEN t.close END AS tc
       FROM sig s ASOF LEFT JOIN candles t ON t.symbol = s.symbol AND s.us + {4 * WEEK} <= t.us),
    h AS (SELECT s.symbol, s.us, any_value(s.entry) AS entry, any_value(stop) AS stop, any_value(target) AS target, any_value(tu) AS tu, any_value(tc) AS tc,
       min(CASE WHEN b.low <= stop / (1 - 0.001) THEN b.us END) AS su, min(CASE WHEN b.high >= target / (1 - 0.001) THEN b.us END) AS gu
       FROM tm s JOIN candles b ON b.symbol = s.symbol AND b.us >= s.us AND b.us <= coalesce(tu, s.us + {8 * WEEK}) GROUP BY s.symbol, s.us),
    r AS (SELECT *, CASE WHEN su IS NOT NULL AND (gu IS NULL OR su <= gu) THEN 'STOP' WHEN gu IS NOT NULL THEN 'TARGET' WHEN tu IS NOT NULL THEN 'TIMEOUT' ELSE 'OPEN' END AS reason FROM h)
    SELECT symbol, us, reason, CASE reason WHEN 'STOP' THEN su WHEN 'TARGET' THEN gu ELSE tu END AS exit_us,
      round(CASE reason WHEN 'STOP' THEN stop WHEN 'TARGET' THEN target ELSE tc END, 6) AS exit_price FROM r""",
)
def l12(spark, d):
    c = durable(candles(spark, d))  # signals, entries and the path read it
    entries = c.select("symbol", "us", F.col("open").alias("entry"))
    sig = c.filter("close > open").select("symbol", (F.col("us") + WEEK).alias("us")).join(entries, ["symbol", "us"])
    sig = sig.withColumns({"stop": F.col("entry") * 0.6, "target": F.col("entry") * 1.8, "half_spread": F.lit(0.001)})
    out = L.signal_bar_outcomes(sig, c, 4 * WEEK, 4 * WEEK)
    return round_doubles(out.select("symbol", "us", "reason", "exit_us", "exit_price"))


@register(
    "l13_trade_cost_decomposition",
    """WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS q, l_extendedprice / l_quantity AS e,
        l_extendedprice / l_quantity * (0.95 + l_discount) AS x, l_tax / 100 AS h, 0.0002 AS s, 0.001 AS f FROM lineitem),
      c AS (SELECT *, q * e * (1 + h) * (1 + s) * f + q * x * (1 - h) * (1 - s) * f AS com FROM f)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(q * (x - e), 4) AS market_pnl, round(q * (e * h + x * h), 4) AS spread_cost,
      round(q * (e * (1 + h) * s + x * (1 - h) * s), 4) AS slippage_cost, round(com, 4) AS commission,
      round(q * (x * (1 - h) * (1 - s) - e * (1 + h) * (1 + s)) - com, 4) AS net,
      round(q * (x - e) - q * (e * h + x * h) - q * (e * (1 + h) * s + x * (1 - h) * s) - com, 4) AS net_crosscheck FROM c""",
)
def l13(spark, d):
    from quoteloom.sources.views import table

    price = F.col("l_extendedprice") / F.col("l_quantity")
    fills = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("quantity"), price.alias("entry"),
        (price * (F.lit(0.95) + F.col("l_discount"))).alias("exit"), (F.col("l_tax") / 100).alias("half_spread"),
        F.lit(0.0002).alias("slippage"), F.lit(0.001).alias("fee"),
    )
    out = L.trade_cost_decomposition(fills).drop("quantity", "entry", "exit", "half_spread", "slippage", "fee")
    return round_doubles(out, 4)


@register(
    "l14_outcome_status",
    with_views(QUOTES, OBS, FWD[1])
    + """SELECT o.symbol, CASE WHEN o.volume > 90 THEN 'SIGNAL_BLOCKED' WHEN fb IS NOT NULL THEN 'COMPLETE' ELSE 'FUTURE_DATA_INCOMPLETE' END AS status, count(*) AS n
    FROM obs o JOIN fwd_b USING (symbol, us, seq) GROUP BY ALL""",
)
def l14(spark, d):
    out = L.executable_returns(sampled(spark, d), quotes(spark, d), {"b": HZ["b"]}, TOL, POINT)
    status = L.outcome_status(F.col("volume") > 90, F.col("long_b").isNotNull())
    return out.groupBy("symbol", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))
