"""Ledger analytics on the trades derived from order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from quoteloom.catalog.registry import CANDLES, LEDGER, register, with_views
from quoteloom.functions.output import round_columns, round_doubles
from quoteloom.functions.timing import DAY
from quoteloom.operators import ledger as P
from quoteloom.sources.views import LEDGER_ORDER, candles, ledger, table

CAP = 1_000_000.0
ORD = list(LEDGER_ORDER)
CURVE = f"""cur AS (SELECT *, {CAP} + sum(net) OVER (ORDER BY n) AS eq, sum(CASE WHEN net < 0 THEN 1 ELSE 0 END) OVER (ORDER BY n) AS cl FROM ledger),
  cur2 AS (SELECT *, greatest({CAP}, max(eq) OVER (ORDER BY n)) AS pk, cl - coalesce(max(CASE WHEN net >= 0 THEN cl END) OVER (ORDER BY n), 0) AS st FROM cur)"""
SUMS = """count(*) AS trades, count(CASE WHEN net > 0 THEN 1 END) AS wins, count(CASE WHEN net < 0 THEN 1 END) AS losses, round(sum(net), 2) AS net_pnl, round(sum(market_pnl), 2) AS gross_pnl,
  round(sum(spread_cost), 2) AS spread_cost, round(sum(slippage_cost), 2) AS slippage_cost, round(sum(commission), 2) AS commission,
  round(count(CASE WHEN net > 0 THEN 1 END) / count(*) * 100, 4) AS win_rate, round(coalesce(avg(CASE WHEN net > 0 THEN net END), 0), 4) AS average_win,
  round(coalesce(avg(CASE WHEN net < 0 THEN net END), 0), 4) AS average_loss, round(avg(net), 4) AS expectancy,
  round(sum(CASE WHEN net > 0 THEN net ELSE 0 END) / nullif(sum(CASE WHEN net < 0 THEN -net ELSE 0 END), 0), 6) AS profit_factor"""
MONEY = ("net_pnl", "gross_pnl", "spread_cost", "slippage_cost", "commission")
FOUR = ("win_rate", "average_win", "average_loss", "expectancy")


def money(df, *extra):
    out = round_columns(df, *MONEY, digits=2)
    return round_columns(round_columns(out, *FOUR, digits=4), "profit_factor", *extra)


@register(
    "p1_ledger_metrics",
    with_views(LEDGER, CURVE)
    + f"SELECT {SUMS}, round(sum(net) / {CAP} * 100, 6) AS net_return_pct, round(max(pk - eq), 2) AS max_drawdown, round(max((pk - eq) / pk * 100), 6) AS max_drawdown_pct, CAST(max(st) AS BIGINT) AS max_losing_streak FROM cur2",
)
def p1(spark, d):
    out = P.ledger_metrics(ledger(spark, d), ORD, CAP)
    return round_columns(money(out, "net_return_pct", "max_drawdown_pct"), "max_drawdown", digits=2)


DAYS = f"""dy AS (SELECT us // {DAY} AS day, sum(net) AS dn FROM ledger GROUP BY 1), dz AS (SELECT *, {CAP} + coalesce(sum(dn) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS se FROM dy)"""
P_START, P_END = 8035 * DAY, 10592 * DAY  # 1992-01-01 to 1998-12-31


@register(
    "p2_scenario_metrics",
    with_views(LEDGER, DAYS)
    + f""", g AS (SELECT d, dn / se * 100 AS ret, coalesce(dn / se * 100, 0) AS r FROM range({P_START // DAY}, {P_END // DAY}) t(d) LEFT JOIN dz ON day = d),
      w AS (SELECT strftime(make_timestamp(us), '%G-W%V') AS w, sum(net) AS n FROM ledger GROUP BY 1), s AS (SELECT symbol, sum(net) AS n FROM ledger WHERE net > 0 GROUP BY 1)
    SELECT count(*) AS days, count(CASE WHEN r >= 1 THEN 1 END) AS days_at_target, count(CASE WHEN r > 0 AND r < 1 THEN 1 END) AS days_between, count(CASE WHEN r < 0 THEN 1 END) AS negative_days,
      count(*) - count(ret) AS no_trade_days, round(avg(r), 6) AS average_daily_pct, round(median(r), 6) AS median_daily_pct, round(max(r), 6) AS best_day_pct, round(min(r), 6) AS worst_day_pct,
      (SELECT count(*) FROM w) AS active_weeks, (SELECT round(avg(CASE WHEN n > 0 THEN 1.0 ELSE 0 END), 6) FROM w) AS positive_week_ratio,
      (SELECT round(coalesce(max(CASE WHEN n > 0 THEN n END) / sum(CASE WHEN n > 0 THEN n END), 1), 6) FROM w) AS week_concentration, (SELECT round(max(n) / sum(n), 6) FROM s) AS symbol_concentration FROM g""",
)
def p2(spark, d):
    return round_doubles(P.scenario_metrics(ledger(spark, d), CAP, P_START, P_END))


@register(
    "p3_breakdown",
    with_views(LEDGER) + f"SELECT 'SYMBOL' AS kind, CAST(symbol AS VARCHAR) AS key, {SUMS} FROM ledger GROUP BY symbol UNION ALL SELECT 'SETUP', setup, {SUMS} FROM ledger GROUP BY setup",
)
def p3(spark, d):
    return money(P.breakdown(ledger(spark, d)))


@register(
    "p4_period_returns",
    with_views(LEDGER)
    + f"""SELECT 'WEEK' AS kind, strftime(make_timestamp(us), '%G-W%V') AS period, round(sum(net) / {CAP} * 100, 6) AS return_pct FROM ledger GROUP BY 2
      UNION ALL SELECT 'MONTH', strftime(make_timestamp(us), '%Y-%m'), round(sum(net) / {CAP} * 100, 6) FROM ledger GROUP BY 2""",
)
def p4(spark, d):
    return round_doubles(P.period_returns(ledger(spark, d), CAP))


@register(
    "p5_hold_benchmarks",
    with_views(CANDLES)
    + """, h AS (SELECT symbol, (arg_max(close, us) / arg_min(open, us) - 1) * 100 AS g FROM candles GROUP BY symbol), k AS (SELECT h.*, coalesce(s_nationkey / 10.0, 0) AS cost FROM h LEFT JOIN supplier ON s_suppkey = symbol)
    SELECT 'BUY_AND_HOLD_FIRST' AS name, round(avg(g), 6) AS gross_pct, round(avg(cost), 6) AS cost_pct, round(avg(g - cost), 6) AS net_pct FROM k WHERE symbol = 1
    UNION ALL SELECT 'BUY_AND_HOLD_EQUAL_WEIGHT', round(avg(g), 6), round(avg(cost), 6), round(avg(g - cost), 6) FROM k UNION ALL SELECT 'CASH', 0, 0, 0""",
)
def p5(spark, d):
    costs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol"), (F.col("s_nationkey") / 10.0).alias("cost"))
    return round_doubles(P.hold_benchmarks(candles(spark, d), costs, 1))


@register(
    "p6_concentration",
    with_views(LEDGER)
    + """, s AS (SELECT symbol, sum(net) AS n, max(net) AS m FROM ledger GROUP BY symbol), t AS (SELECT sum(n) AS total, arg_max(symbol, n) AS ls, max(n) AS ln, max(m) AS lm FROM s)
    SELECT round(total, 2) AS total, CASE WHEN total > 0 THEN ls END AS largest_symbol, round(CASE WHEN total > 0 THEN ln / total ELSE 0 END, 6) AS largest_symbol_share,
      round(CASE WHEN total > 0 THEN lm / total ELSE 0 END, 6) AS largest_trade_share, round(CASE WHEN total > 0 THEN total - ln ELSE total END, 2) AS without_largest_symbol,
      round(CASE WHEN total > 0 THEN total - lm ELSE total END, 2) AS without_largest_trade FROM t""",
)
def p6(spark, d):
    out = P.concentration(ledger(spark, d))
    return round_columns(round_columns(out, "largest_symbol_share", "largest_trade_share"), "total", "without_largest_symbol", "without_largest_trade", digits=2)


@register(
    "p7_ledger_status",
    with_views(LEDGER, CURVE, CANDLES, "hp AS (SELECT symbol, (arg_max(close, us) / arg_min(open, us) - 1) * 100 AS g FROM candles GROUP BY symbol)")
    + f""", w AS (SELECT strftime(make_timestamp(us), '%G-W%V') AS w, sum(net) AS n FROM ledger GROUP BY 1), k AS (SELECT count(*) AS active_weeks, count(CASE WHEN n > 0 THEN 1 END) AS positive_weeks FROM w),
    m AS (SELECT {SUMS}, sum(net) AS nn, sum(market_pnl) AS gg, max((pk - eq) / pk * 100) AS dd, sum(market_pnl) - sum(commission) * 1.5 - sum(spread_cost) * 2 - sum(slippage_cost) * 3 AS st FROM cur2)
    SELECT trades, net_pnl, active_weeks, positive_weeks, round(positive_weeks / active_weeks, 6) AS positive_week_ratio, round(st / trades, 4) AS stress_expectancy,
      CASE WHEN trades < 60 THEN 'INSUFFICIENT_EVIDENCE' WHEN nn > 0 AND gg > 0 AND profit_factor >= 1.2 AND dd <= 10 AND positive_weeks / active_weeks >= 0.6 AND st >= 0 THEN 'PASSED' ELSE 'FAILED' END AS verdict,
      (SELECT round(max(CASE WHEN symbol = 1 THEN g END), 6) FROM hp) AS hold_first_pct, (SELECT round(avg(g), 6) FROM hp) AS hold_equal_weight_pct, CAST(0 AS DOUBLE) AS cash_pct, round(nn / {CAP} * 100, 4) AS net_return_pct FROM m, k""",
)
def p7(spark, d):
    prices = candles(spark, d).groupBy("symbol").agg(F.min_by("open", "us").alias("started"), F.max_by("close", "us").alias("latest"))
    out = P.ledger_status(ledger(spark, d), ORD, CAP, 2557, prices, 1)
    out = out.select(
        "trades", "net_pnl", "active_weeks", "positive_weeks", "positive_week_ratio", "stress_expectancy", "verdict", "hold_first_pct", "hold_equal_weight_pct", "cash_pct", "net_return_pct",
    )
    out = round_columns(round_columns(out, "net_pnl", digits=2), "stress_expectancy", "net_return_pct", digits=4)
    return round_columns(out, "positive_week_ratio", "hold_first_pct", "hold_equal_weight_pct")


INDAY = f"""di AS (SELECT l.*, us // {DAY} AS day, se, se + sum(net) OVER (PARTITION BY us // {DAY} ORDER BY n) AS e FROM ledger l JOIN dz ON dz.day = l.us // {DAY}),
  dj AS (SELECT *, greatest(se, max(e) OVER (PARTITION BY day ORDER BY n)) AS p FROM di)"""


@register(
    "p8_daily_report",
    with_views(LEDGER, DAYS, INDAY)
    + """, g AS (SELECT day, any_value(se) AS se, sum(net) AS net, count(*) AS trades, count(CASE WHEN net > 0 THEN 1 END) AS wins, sum(commission) AS fees, max(CASE WHEN p > 0 THEN (p - e) / p * 100 ELSE 0 END) AS dd FROM dj GROUP BY day)
    SELECT day, round(se, 2) AS start_equity, round(net, 2) AS net, trades, wins, round(fees, 2) AS fees, round(dd, 4) AS drawdown_pct, round(CASE WHEN se > 0 THEN net / se * 100 ELSE 0 END, 4) AS return_pct,
      round(se + net, 2) AS end_equity, CASE WHEN se > 0 THEN net / se * 100 ELSE 0 END >= 1 AS target_reached FROM g""",
)
def p8(spark, d):
    out = round_columns(P.daily_report(ledger(spark, d), ORD, CAP), "start_equity", "net", "fees", "end_equity", digits=2)
    return round_columns(out, "drawdown_pct", "return_pct", digits=4)


@register(
    "p9_daily_gate_flags",
    with_views(LEDGER, DAYS)
    + f""", a AS (SELECT l.*, us // {DAY} AS day, se, coalesce(sum(net) OVER pv, 0) AS dp, count(*) OVER pv AS tb, coalesce(sum(CASE WHEN net <= 0 THEN 1 ELSE 0 END) OVER pv, 0) AS lb,
        sum(CASE WHEN net <= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY us // {DAY} ORDER BY n) AS lc FROM ledger l JOIN dz ON dz.day = l.us // {DAY}
        WINDOW pv AS (PARTITION BY us // {DAY} ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      b AS (SELECT *, lb - coalesce(max(CASE WHEN net > 0 THEN lc END) OVER (PARTITION BY day ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sb, dp / se * 100 AS dr FROM a),
      c AS (SELECT *, CASE WHEN dr >= 0.05 THEN 'DAILY_TARGET_REACHED' WHEN dr <= -0.05 THEN 'DAILY_LOSS_LIMIT_REACHED' WHEN sb >= 3 THEN 'COOLDOWN' WHEN tb >= 6 THEN 'DISABLED' ELSE 'ACTIVE' END AS state FROM b)
    SELECT day, state, count(*) AS n, CAST(sum(tb) AS BIGINT) AS trades_before, CAST(sum(sb) AS BIGINT) AS streak_before FROM c GROUP BY day, state""",
)
def p9(spark, d):
    out = P.daily_gate_flags(ledger(spark, d), ORD, CAP, 0.05, -0.05)
    return out.groupBy("day", "state").agg(
        F.count(F.lit(1)).alias("n"), F.sum("trades_before").alias("trades_before"), F.sum("streak_before").alias("streak_before")
    )
