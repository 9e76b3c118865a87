"""Market structure on books from order lines, candles and pairs from customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quoteloom.catalog.bars import MONDAY
from quoteloom.catalog.registry import BOOKS, CANDLES, QUOTES, register, with_views
from quoteloom.functions.output import round_columns, round_doubles
from quoteloom.functions.timing import WEEK
from quoteloom.operators import market as C
from quoteloom.session import durable
from quoteloom.sources.views import book_levels, candles, quotes, table

PAIRS = """pairs AS (SELECT c_custkey AS symbol, 'B' || c_nationkey AS base, c_mktsegment AS quote, CASE WHEN c_custkey % 11 = 0 THEN 'HALT' ELSE 'TRADING' END AS status,
    abs(c_acctbal) * 100 AS volume, 100.0 + c_nationkey AS bid, 100.0 + c_nationkey + c_custkey % 9 * 0.05 AS ask, c_custkey % 5 * 0.0002 AS maker, 0.0004 + c_custkey % 7 * 0.0002 AS taker,
    c_acctbal / 2000 AS move_pct, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 8 * 0.05 END AS impact_pct, abs(c_acctbal) * (1 + c_custkey % 3) AS bid_depth, abs(c_acctbal) * (1 + c_custkey % 4) AS ask_depth,
    c_custkey % 9 * 0.05 AS spread_pct, c_custkey % 4 <> 0 AS fills FROM customer)"""


def pairs(spark, d):
    k, bal = F.col("c_custkey"), F.col("c_acctbal")
    mod = lambda n: F.pmod(k, F.lit(n))
    return table(spark, d, "customer").select(
        k.alias("symbol"), F.concat(F.lit("B"), "c_nationkey").alias("base"), F.col("c_mktsegment").alias("quote"),
        F.when(mod(11) == 0, "HALT").otherwise("TRADING").alias("status"), (F.abs(bal) * 100).alias("volume"),
        (F.lit(100.0) + F.col("c_nationkey")).alias("bid"), (F.lit(100.0) + F.col("c_nationkey") + mod(9) * 0.05).alias("ask"),
        (mod(5) * 0.0002).alias("maker"), (F.lit(0.0004) + mod(7) * 0.0002).alias("taker"), (bal / 2000).alias("move_pct"),
        F.when(mod(3) == 0, None).otherwise(mod(8) * 0.05).alias("impact_pct"), (F.abs(bal) * (1 + mod(3))).alias("bid_depth"),
        (F.abs(bal) * (1 + mod(4))).alias("ask_depth"), (mod(9) * 0.05).alias("spread_pct"), (mod(4) != 0).alias("fills"),
    )


@register(
    "c1_spread_metrics",
    with_views(QUOTES)
    + """, s AS (SELECT symbol, (ask - bid) / ((ask + bid) / 2) * 100 AS p FROM quotes WHERE bid > 0 AND ask >= bid)
    SELECT symbol, round(avg(p), 6) AS average_pct, count(*) AS samples, round(median(p), 6) AS p50_pct, round(quantile_cont(p, 0.95), 6) AS p95_pct, round(median(p) * 100, 6) AS p50_bps FROM s GROUP BY symbol""",
)
def c1(spark, d):
    return round_doubles(C.spread_metrics(quotes(spark, d)))


@register(
    "c2_book_walk",
    with_views(BOOKS)
    + """, r AS (SELECT *, price * qty AS v, first(price) OVER s AS best, sum(price * qty) OVER (s ROWS UNBOUNDED PRECEDING) AS qt, sum(qty) OVER (s ROWS UNBOUNDED PRECEDING) AS bt, row_number() OVER s AS rn FROM book_levels
        WINDOW s AS (PARTITION BY snapshot, side ORDER BY CASE WHEN side = 'ask' THEN price ELSE -price END, l_linenumber, l_partkey, l_suppkey)),
      n AS (SELECT *, unnest([1000.0, 20000.0, 80000.0]) AS notional FROM r),
      g AS (SELECT snapshot, notional, sum(CASE WHEN side = 'ask' THEN least(greatest(notional - (qt - v), 0), v) / price END) AS bg, max(CASE WHEN side = 'ask' THEN qt END) AS atot,
        arg_max(price, rn) FILTER (side = 'ask') AS al, max(CASE WHEN side = 'ask' THEN best END) AS ab, sum(CASE WHEN side = 'bid' THEN least(greatest(notional / best - (bt - qty), 0), qty) * price END) AS got,
        max(CASE WHEN side = 'bid' THEN bt END) AS btot, arg_max(price, rn) FILTER (side = 'bid') AS bl, max(CASE WHEN side = 'bid' THEN best END) AS bb FROM n GROUP BY ALL)
    SELECT snapshot, notional, CASE WHEN ab > 0 AND bb > 0 THEN round((greatest(CASE WHEN atot >= notional THEN notional / bg ELSE al END / ab - 1, 0)
        + greatest(1 - CASE WHEN btot >= notional / bb THEN got / (notional / bb) ELSE bl END / bb, 0)) * 100, 6) ELSE 0 END AS impact_pct,
      coalesce(ab > 0 AND bb > 0 AND atot >= notional AND btot >= notional / bb, false) AS complete FROM g""",
)
def c2(spark, d):
    return round_doubles(C.book_walk(book_levels(spark, d), [1000, 20000, 80000], tie=("l_linenumber", "l_partkey", "l_suppkey")))


@register(
    "c3_depth",
    with_views(BOOKS)
    + """SELECT snapshot, round(coalesce(sum(CASE WHEN side = 'bid' THEN price * qty END), 0), 4) AS bid_depth, round(coalesce(sum(CASE WHEN side = 'ask' THEN price * qty END), 0), 4) AS ask_depth
    FROM book_levels GROUP BY snapshot""",
)
def c3(spark, d):
    return round_doubles(C.depth(book_levels(spark, d)), 4)


VOL_HORIZONS = {"5m": 1, "15m": 3, "1h": 12, "4h": 48}  # the published lengths as multiples of the smallest, on weekly candles


def vol_sql(n: str, k: int) -> str:
    return f"""b{k} AS (SELECT symbol, '{n}' AS horizon, (us - {MONDAY}) // {k * WEEK} AS us, arg_max(close, us) AS close, max(high) AS high, min(low) AS low FROM candles GROUP BY ALL HAVING count(*) = {k}),
    v{k} AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY us)) * 100 AS r, (high - low) / close * 100 AS m FROM b{k})"""


@register(
    "c4_volatility_and_move",
    with_views(CANDLES, *[vol_sql(n, k).replace("GROUP BY ALL", f"GROUP BY symbol, (us - {MONDAY}) // {k * WEEK}") for n, k in VOL_HORIZONS.items()])
    + """SELECT symbol, horizon, count(*) AS bars, round(CASE WHEN count(*) >= 3 THEN stddev_samp(r) ELSE 0 END, 6) AS volatility_pct, round(CASE WHEN count(*) >= 3 THEN median(m) ELSE 0 END, 6) AS move_pct
    FROM ("""
    + " UNION ALL ".join(f"SELECT * FROM v{k}" for k in VOL_HORIZONS.values())
    + ") GROUP BY symbol, horizon",
)
def c4(spark, d):
    return round_doubles(C.volatility_and_move(durable(candles(spark, d)), WEEK, VOL_HORIZONS, MONDAY, 104 * WEEK))


COST_SQL = """cost AS (SELECT symbol, unnest(['TAKER_ENTRY_TAKER_EXIT', 'MAKER_ENTRY_TAKER_EXIT']) AS mode, * EXCLUDE symbol, (ask - bid) / ((ask + bid) / 2) * 100 AS sp FROM pairs),
  cost2 AS (SELECT *, CASE mode WHEN 'TAKER_ENTRY_TAKER_EXIT' THEN taker * 2 ELSE maker + taker END * 100 + CASE mode WHEN 'TAKER_ENTRY_TAKER_EXIT' THEN sp + greatest(coalesce(impact_pct, 0), 0.1)
     ELSE sp / 2 + greatest(coalesce(impact_pct / 2, 0), 0.05) + 0.01 END AS cost_pct FROM cost)"""


@register(
    "c5_round_trip_cost",
    with_views(PAIRS, COST_SQL) + "SELECT symbol, mode, round(cost_pct, 6) AS cost_pct, round(move_pct - cost_pct, 6) AS net_edge_pct, move_pct - cost_pct > 0.1 AS acceptable FROM cost2",
)
def c5(spark, d):
    return round_doubles(C.round_trip_cost(pairs(spark, d), 5.0, 10.0, 0.01).select("symbol", "mode", "cost_pct", "net_edge_pct", "acceptable"))


@register(
    "c6_resolve_fees",
    """SELECT c_custkey AS symbol, round(coalesce(s_acctbal / 1e6, CASE WHEN n_regionkey > 1 THEN n_nationkey / 1e4 END, 0.001), 6) AS maker, round(coalesce(s_acctbal / 1e6, CASE WHEN n_regionkey > 1 THEN n_nationkey / 1e4 END, 0.002), 6) AS taker,
      CASE WHEN s_suppkey IS NOT NULL THEN 'SYMBOL_FEE' WHEN n_regionkey > 1 THEN 'ACCOUNT_COMMISSION_RATE' ELSE 'CONFIGURED_FALLBACK' END AS fee_source
    FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""",
)
def c6(spark, d):
    sym = table(spark, d, "customer").select(F.col("c_custkey").alias("symbol"), F.col("c_nationkey").alias("account"))
    fee = F.col("s_acctbal") / 1e6
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol"), fee.alias("maker"), fee.alias("taker"))
    rate = F.col("n_nationkey") / 1e4
    a = table(spark, d, "nation").filter("n_regionkey > 1").select(F.col("n_nationkey").alias("account"), rate.alias("maker"), rate.alias("taker"))
    return round_doubles(C.resolve_fees(sym, s, a, 0.001, 0.002))


@register(
    "c7_special_pricing",
    """SELECT c_custkey, c_nationkey % 3 = 1 AS special, c_nationkey % 4 = 2 AS tax, c_acctbal > 5000 AND c_nationkey > 5 AS discount, c_nationkey % 3 = 1 OR c_nationkey % 4 = 2 OR (c_acctbal > 5000 AND c_nationkey > 5) AS special_pricing FROM customer""",
)
def c7(spark, d):
    k = F.col("c_nationkey")
    flag = lambda x: F.when(x, "true").otherwise("false")
    doc = F.concat(
        F.lit('{"specialCommission":{"maker":"0.0","taker":"'), F.when(k % 3 == 1, "0.01").otherwise("0"), F.lit('"},"taxCommission":{"maker":"'),
        F.when(k % 4 == 2, "0.002").otherwise("0.000"), F.lit('"},"discount":{"enabledForAccount":'), flag(F.col("c_acctbal") > 5000),
        F.lit(',"enabledForSymbol":'), flag(k > 5), F.lit("}}"),
    )
    return C.special_pricing(table(spark, d, "customer").select("c_custkey", doc.alias("payload"))).drop("payload")


RULES = """rules AS (SELECT p_partkey, p_size, p_retailprice, 0.01 AS tick, (1 + p_size % 5) / 100.0 AS minq, 5 + p_size % 20 AS maxq, CASE WHEN p_size % 3 = 0 THEN 0.001 ELSE 0.005 END AS step FROM part)"""


def rules(spark, d):
    p = table(spark, d, "part")
    size = F.col("p_size")
    dec = lambda x: x.cast("decimal(38,18)")
    return p.select(
        "p_partkey", "p_size", "p_retailprice", dec(F.lit("0.01")).alias("tick_size"), dec((1 + size % 5).cast("decimal(10,0)") / F.lit(100).cast("decimal(10,0)")).alias("min_qty"),
        dec(5 + size % 20).alias("max_qty"), dec(F.when(size % 3 == 0, "0.001").otherwise("0.005")).alias("step"),
    )


@register(
    "c8_flatten_symbol_rules",
    """SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 'IDENTITY' WHEN p_size % 10 = 1 THEN 'MISSING_FILTER' WHEN p_size % 10 = 2 THEN 'AMBIGUOUS' END AS reject,
      CASE WHEN p_size % 10 <> 1 THEN 0.01 END AS tick_size, CASE WHEN p_size % 4 = 0 THEN 0.5 ELSE 0.1 END AS min_qty, CASE WHEN p_size % 4 = 0 THEN 0.25 ELSE 0.05 END AS step,
      CASE WHEN p_size % 2 = 0 THEN 10.0 ELSE 5.0 END AS min_notional FROM part""",
)
def c8(spark, d):
    s = F.col("p_size")
    name = F.when(s % 10 == 0, "XXX").when(s % 10 == 2, "ab").otherwise("AB")
    base = F.when(s % 10 == 2, "ab").otherwise("AB")
    doc = F.concat(
        F.lit('{"symbol":"'), name, F.lit('USD","baseAsset":"'), base, F.lit('","quoteAsset":"USD","status":"TRADING","filters":['),
        F.when(s % 10 == 1, "").otherwise('{"filterType":"PRICE_FILTER","tickSize":"0.01","minPrice":"0.01","maxPrice":"1000"},'),
        F.lit('{"filterType":"LOT_SIZE","minQty":"0.1","maxQty":"900","stepSize":"0.05"},{"filterType":"MARKET_LOT_SIZE","maxQty":"500",'),
        F.when(s % 4 == 0, '"minQty":"0.5","stepSize":"0.25"}').otherwise('"minQty":"0","stepSize":"0"}'),
        F.when(s % 2 == 0, ',{"filterType":"NOTIONAL","minNotional":"10"}').otherwise(',{"filterType":"MIN_NOTIONAL","minNotional":"5"}'), F.lit("]}"),
    )
    out = C.flatten_symbol_rules(table(spark, d, "part").select("p_partkey", doc.alias("payload")))
    return out.select("p_partkey", "reject", *[F.col(x).cast("double").alias(x) for x in ("tick_size", "min_qty", "step", "min_notional")])


@register(
    "c9_min_order_quantity",
    with_views(RULES)
    + """, q AS (SELECT *, greatest(CAST(minq AS DECIMAL(30,12)), CAST(50 AS DECIMAL(30,12)) / p_retailprice) AS need FROM rules)
    SELECT p_partkey, round(CASE WHEN ceil(round(need / step, 9)) * step <= maxq THEN ceil(round(need / step, 9)) * step END, 6) AS min_order_qty FROM q""",
)
def c9(spark, d):
    r = rules(spark, d).withColumns({"min_notional": F.lit(50).cast("decimal(38,18)"), "price": F.col("p_retailprice").cast("decimal(38,18)")})
    return round_doubles(C.min_order_quantity(r).select("p_partkey", F.col("min_order_qty").cast("double").alias("min_order_qty")))


@register(
    "c10_validate_orders",
    with_views(RULES)
    + """, o AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity / 8 AS DECIMAL(18,6)) AS qty, CAST(l_extendedprice / 1000 AS DECIMAL(18,5)) AS price, r.* FROM lineitem JOIN rules r ON p_partkey = l_partkey)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(list_filter([CASE WHEN p_size % 13 = 0 THEN 'SYMBOL_NOT_SPOT_TRADABLE' END, CASE WHEN qty < minq THEN 'BELOW_MINIMUM_QUANTITY' END, CASE WHEN qty > maxq THEN 'ABOVE_MAXIMUM_QUANTITY' END,
      CASE WHEN qty * 1000000 % CAST(step * 1000000 AS BIGINT) <> 0 THEN 'INVALID_QUANTITY_STEP' END, CASE WHEN price < 2 OR price > 60 THEN 'PRICE_OUT_OF_RANGE' END,
      CASE WHEN price * 100000 % 1000 <> 0 THEN 'INVALID_PRICE_TICK' END, CASE WHEN qty * price < 20 THEN 'BELOW_MINIMUM_NOTIONAL' END, CASE WHEN qty * price > 200 THEN 'ABOVE_MAXIMUM_NOTIONAL' END], lambda x: x IS NOT NULL), ',') AS violations FROM o""",
)
def c10(spark, d):
    o = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") / 8).cast("decimal(18,6)").cast("decimal(38,18)").alias("qty"),
        (F.col("l_extendedprice") / 1000).cast("decimal(18,5)").cast("decimal(38,18)").alias("price"),
    )
    rows = o.join(rules(spark, d), F.col("l_partkey") == F.col("p_partkey")).withColumns(
        {"status": F.when(F.col("p_size") % 13 == 0, "HALT").otherwise("TRADING"), "spot": F.lit(True), "min_price": F.lit(2).cast("decimal(38,18)"),
         "max_price": F.lit(60).cast("decimal(38,18)"), "min_notional": F.lit(20).cast("decimal(38,18)"), "max_notional": F.lit(200).cast("decimal(38,18)")}
    )
    out = C.validate_orders(rows)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join("violations", ",").alias("violations"))


@register(
    "c11_size_candidates",
    """WITH o AS (SELECT o_orderkey, abs(o_totalprice) AS equity, o_totalprice / (1 + o_orderkey % 4) AS cash, 100.0 + o_orderkey % 50 AS entry, (100.0 + o_orderkey % 50) * (1 - (o_orderkey % 6) / 100.0) AS stop FROM orders),
      r AS (SELECT *, (entry - stop) / entry + 0.002 + 0.001 AS rate FROM o), q AS (SELECT *, floor(CAST(CAST(least(equity * 0.2 / 100 / (entry * rate), cash / entry, 200) AS VARCHAR) AS DECIMAL(30,18)) * 100) * 0.01 AS qty FROM r),
      s AS (SELECT *, qty * entry AS notional, qty * entry * rate AS loss FROM q),
      t AS (SELECT *, CASE WHEN equity <= 0 OR cash <= 0 OR stop <= 0 OR stop >= entry THEN 'INVALID' WHEN qty < 0.5 OR notional < 100 THEN 'MINIMUM_ORDER_INCOMPATIBLE_WITH_RISK_BUDGET' WHEN loss / equity * 100 > 0.15 THEN 'MAXIMUM_RISK_EXCEEDED' ELSE 'ACCEPT' END AS reason FROM s)
    SELECT o_orderkey, reason, round(CASE WHEN reason IN ('INVALID', 'MINIMUM_ORDER_INCOMPATIBLE_WITH_RISK_BUDGET') THEN 0 ELSE qty END, 4) AS quantity, round(loss, 7) AS estimated_loss FROM t""",
)
def c11(spark, d):
    k = F.col("o_orderkey")
    dec = lambda x: F.lit(x).cast("decimal(38,18)")
    o = table(spark, d, "orders").select(
        "o_orderkey", F.abs("o_totalprice").alias("equity"), (F.col("o_totalprice") / (1 + k % 4)).alias("cash"), (F.lit(100.0) + k % 50).alias("entry"),
        ((F.lit(100.0) + k % 50) * (1 - (k % 6) / 100.0)).alias("stop"), F.lit(0.002).alias("fee"), F.lit(0.001).alias("slippage"),
        dec("0.01").alias("step"), F.lit(0.5).alias("min_qty"), F.lit(200.0).alias("max_qty"), F.lit(100.0).alias("min_notional"),
    )
    out = C.size_candidates(o, max_risk_pct=0.15).select("o_orderkey", "reason", "quantity", "estimated_loss")
    return round_columns(round_columns(out, "quantity", digits=4), "estimated_loss", digits=7)


@register(
    "c12_shortlist_pairs",
    with_views(PAIRS)
    + """, g AS (SELECT * FROM pairs WHERE quote IN ('BUILDING', 'MACHINERY') AND status = 'TRADING' AND volume >= 100000), p AS (SELECT * FROM g WHERE base IN ('B1', 'B2', 'B3')),
      o AS (SELECT *, row_number() OVER (ORDER BY volume DESC, symbol) AS n FROM g WHERE base NOT IN ('B1', 'B2', 'B3'))
    SELECT symbol, round(volume, 4) AS volume, true AS priority FROM p UNION ALL SELECT symbol, round(volume, 4), false FROM o WHERE n <= 100 - (SELECT count(*) FROM p)""",
)
def c12(spark, d):
    return round_doubles(C.shortlist_pairs(pairs(spark, d), ["BUILDING", "MACHINERY"], ["B1", "B2", "B3"], 100_000, 100).select("symbol", "volume", "priority"), 4)


RANKIN = """rk AS (SELECT *, bid_depth AS depth, spread_pct + 0.1 + taker * 200 AS taker_cost, spread_pct / 2 + 0.05 + (maker + taker) * 100 AS maker_cost, symbol % 2 = 0 AS credible, symbol % 13 <> 0 AS compatible FROM pairs),
  rk2 AS (SELECT *, move_pct - taker_cost AS taker_edge, move_pct - maker_cost AS maker_edge, move_pct - taker_cost > 0.2 AS taker_ok, move_pct - maker_cost > 0.2 AS maker_ok FROM rk)"""


@register(
    "c13_rank_pairs",
    with_views(PAIRS, RANKIN)
    + """, m AS (SELECT *, CASE WHEN compatible AND credible AND maker_ok AND (NOT (compatible AND taker_ok) OR maker_edge > taker_edge) THEN 'MAKER_ENTRY_TAKER_EXIT' WHEN compatible AND taker_ok THEN 'TAKER_ENTRY_TAKER_EXIT' END AS mode,
      log10(greatest(volume, 1)) * 2 + log10(greatest(depth, 1)) + 3 / (1 + spread_pct * 100) + 2 / (1 + CASE WHEN credible THEN maker + taker ELSE taker * 2 END * 10000) + least(move_pct, 5)
       + 4 * least(move_pct / greatest(CASE WHEN credible THEN maker_cost ELSE taker_cost END, 1e-12), 20) AS score FROM rk2)
    SELECT symbol, mode, round(score, 6) AS score, mode IS NOT NULL AS allowed, row_number() OVER (ORDER BY CASE WHEN mode IS NOT NULL THEN 1 ELSE 0 END DESC, round(score, 12) DESC, symbol) AS rank FROM m""",
)
def c13(spark, d):
    p = pairs(spark, d).withColumns(
        {"depth": F.col("bid_depth"), "taker_cost": F.col("spread_pct") + 0.1 + F.col("taker") * 200, "maker_cost": F.col("spread_pct") / 2 + 0.05 + (F.col("maker") + F.col("taker")) * 100,
         "credible": F.pmod("symbol", F.lit(2)) == 0, "compatible": F.pmod("symbol", F.lit(13)) != 0}
    )
    p = p.withColumns({"taker_edge": F.col("move_pct") - F.col("taker_cost"), "maker_edge": F.col("move_pct") - F.col("maker_cost")})
    p = p.withColumns({"taker_ok": F.col("taker_edge") > 0.2, "maker_ok": F.col("maker_edge") > 0.2})
    return round_doubles(C.rank_pairs(p).select("symbol", "mode", "score", "allowed", F.col("rank").cast("long").alias("rank")))


PROFILE = """pin AS (SELECT *, spread_pct AS spread_p50, spread_pct * 1.2 AS spread_p95, coalesce(impact_pct, 0.02) AS slippage, move_pct AS move_5m, move_pct * 2 AS move_1h, move_pct * 4 AS move_4h FROM pairs),
  pp AS (SELECT *, spread_p50 + slippage + taker * 200 AS tc FROM pin), pq AS (SELECT *, greatest(move_1h / greatest(tc, 1e-12), move_4h / greatest(tc, 1e-12)) AS max_ratio,
   volume >= 100000 AND bid_depth >= 1000 AND ask_depth >= 1000 AND fills AS liq FROM pp),
  pr AS (SELECT *, CASE WHEN liq AND spread_p95 * 100 <= 30 AND slippage * 100 <= 25 AND max_ratio >= 3 THEN 'ECONOMICALLY_ATTRACTIVE' WHEN liq AND max_ratio >= 1.5 THEN 'MARGINAL' ELSE 'TOO_EXPENSIVE' END AS category FROM pq),
  prof AS (SELECT *, row_number() OVER (ORDER BY CASE category WHEN 'ECONOMICALLY_ATTRACTIVE' THEN 0 WHEN 'MARGINAL' THEN 1 ELSE 2 END, round(max_ratio, 12) DESC, volume DESC, symbol) AS rank FROM pr)"""


def profiles(spark, d):
    p = pairs(spark, d).withColumns(
        {"spread_p50": F.col("spread_pct"), "spread_p95": F.col("spread_pct") * 1.2, "slippage": F.coalesce("impact_pct", F.lit(0.02)), "move_5m": F.col("move_pct"),
         "move_1h": F.col("move_pct") * 2, "move_4h": F.col("move_pct") * 4}
    )
    limits = {"min_volume": 100_000, "min_depth": 1000, "max_spread_bps": 30, "max_slippage_bps": 25, "min_ratio": 3}
    return C.pair_profile(p, ["5m", "1h", "4h"], ["1h", "4h"], limits)


@register("c14_pair_profile", with_views(PAIRS, PROFILE) + "SELECT symbol, category, round(max_ratio, 8) AS max_ratio, liq AS liquidity_sufficient, rank FROM prof")
def c14(spark, d):
    return round_doubles(profiles(spark, d).select("symbol", "category", "max_ratio", "liquidity_sufficient", F.col("rank").cast("long").alias("rank")), 8)


@register(
    "c15_best_pair_per_asset",
    with_views(PAIRS, PROFILE)
    + """SELECT base, symbol, category, round(greatest(move_1h, move_4h) / greatest(taker * 200, 1e-12), 6) AS move_over_fees, round(max_ratio, 6) AS move_over_cost FROM prof
    QUALIFY row_number() OVER (PARTITION BY base ORDER BY rank) = 1""",
)
def c15(spark, d):
    return round_doubles(C.best_pair_per_asset(profiles(spark, d), ["1h", "4h"]))


@register(
    "c16_liquidity_filter",
    with_views(PAIRS) + "SELECT symbol FROM pairs WHERE quote = 'BUILDING' AND volume >= 100000 AND spread_pct * 100 <= 20 AND bid_depth >= 5000 AND ask_depth >= 5000",
)
def c16(spark, d):
    p = pairs(spark, d).withColumn("spread_bps", F.col("spread_pct") * 100)
    return C.liquidity_filter(p, "BUILDING", 100_000, 20, 5000).select("symbol")
