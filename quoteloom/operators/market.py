"""Order books, costs, fees, exchange rules, pair profiles and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoteloom.operators.bars import rollup_closed
from quoteloom.operators.ranks import exact_quantiles, global_index, quantiles_of_many_keys
from quoteloom.operators.scans import previous, with_tile

c = F.col
FLOOR = 1e-12


# -- books -----------------------------------------------------------------------------------------
def spread_metrics(books: DataFrame) -> DataFrame:
    """Average, median and 95th percentile of the relative spread per symbol; crossed rows are dropped."""
    good = books.filter((c("bid") > 0) & (c("ask") > 0) & (c("ask") >= c("bid")))
    rows = good.withColumn("spread_pct", (c("ask") - c("bid")) / ((c("ask") + c("bid")) / 2) * 100)
    mean = rows.groupBy("symbol").agg(F.avg("spread_pct").alias("average_pct"), F.count(F.lit(1)).alias("samples"))
    return mean.join(exact_quantiles(rows, ["symbol"], "spread_pct", {"p50_pct": 0.5, "p95_pct": 0.95}), "symbol").withColumn(
        "p50_bps", c("p50_pct") * 100
    )


def depth(levels: DataFrame, keys=("snapshot",)) -> DataFrame:
    """Quote depth of each side."""
    value = c("price") * c("qty")
    return levels.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(c("side") == "bid", value)), F.lit(0.0)).alias("bid_depth"),
        F.coalesce(F.sum(F.when(c("side") == "ask", value)), F.lit(0.0)).alias("ask_depth"),
    )


def book_walk(levels: DataFrame, notionals, keys=("snapshot",), tie=()) -> DataFrame:
    """Round-trip impact of buying and selling a fixed quote notional, and whether the book fills it.

    A window is one side of one snapshot, whose length the exchange bounds (the levels it publishes).
    """
    keys = list(keys)
    better = F.when(c("side") == "ask", c("price")).otherwise(-c("price"))
    by = Window.partitionBy(*keys, "side").orderBy("_better", *tie)
    run = levels.withColumn("_better", better).withColumns(
        {
            "_value": c("price") * c("qty"),
            "_best": F.first("price").over(by),
            "_quote_to": F.sum(c("price") * c("qty")).over(by.rowsBetween(Window.unboundedPreceding, 0)),
            "_base_to": F.sum("qty").over(by.rowsBetween(Window.unboundedPreceding, 0)),
            "_n": F.row_number().over(by),
        }
    )
    sized = run.withColumn("notional", F.explode(F.array(*[F.lit(float(n)) for n in notionals])))
    ask = c("side") == "ask"
    left_quote = F.greatest(c("notional") - (c("_quote_to") - c("_value")), F.lit(0.0))
    take_quote = F.least(left_quote, c("_value"))
    wanted = c("notional") / c("_best")
    take_base = F.least(F.greatest(wanted - (c("_base_to") - c("qty")), F.lit(0.0)), c("qty"))
    sums = sized.groupBy(*keys, "notional").agg(
        F.sum(F.when(ask, take_quote / c("price"))).alias("_bought"),
        F.max(F.when(ask, c("_quote_to"))).alias("_ask_total"),
        F.max_by("price", F.when(ask, c("_n"))).alias("_ask_last"),
        F.max(F.when(ask, c("_best"))).alias("_ask_best"),
        F.sum(F.when(~ask, take_base * c("price"))).alias("_got"),
        F.max(F.when(~ask, c("_base_to"))).alias("_bid_total"),
        F.max_by("price", F.when(~ask, c("_n"))).alias("_bid_last"),
        F.max(F.when(~ask, c("_best"))).alias("_bid_best"),
    )
    two_sided = F.coalesce((c("_ask_best") > 0) & (c("_bid_best") > 0), F.lit(False))
    bought_all = c("_ask_total") >= c("notional")
    target = c("notional") / c("_bid_best")
    sold_all = c("_bid_total") >= target
    buy_avg = F.when(bought_all, F.try_divide(c("notional"), c("_bought"))).otherwise(c("_ask_last"))
    sell_avg = F.when(sold_all, F.try_divide(c("_got"), target)).otherwise(c("_bid_last"))
    impact = F.greatest(buy_avg / c("_ask_best") - 1, F.lit(0.0)) + F.greatest(1 - sell_avg / c("_bid_best"), F.lit(0.0))
    return sums.select(
        *keys,
        "notional",
        F.when(two_sided, impact * 100).otherwise(0.0).alias("impact_pct"),
        (two_sided & bought_all & sold_all).alias("complete"),
    )


def volatility_and_move(candles: DataFrame, step: int, horizons: dict[str, int], origin: int = 0, tile: int | None = None) -> DataFrame:
    """Deviation of log returns and median relative range per horizon, in percent."""
    parts = None
    for name, factor in horizons.items():
        bars = rollup_closed(candles, step, factor, origin) if factor > 1 else candles
        rows = previous(with_tile(bars, width=tile or step * 1024), ["symbol"], ["us"], {"_pc": "close"})
        rows = rows.withColumns({"_ret": F.ln(c("close") / c("_pc")) * 100, "_move": (c("high") - c("low")) / c("close") * 100})
        one = rows.select("symbol", F.lit(name).alias("horizon"), "_ret", "_move")
        parts = one if parts is None else parts.unionByName(one)
    stats = parts.groupBy("symbol", "horizon").agg(F.count(F.lit(1)).alias("bars"), F.stddev_samp("_ret").alias("_v"))
    both = stats.join(quantiles_of_many_keys(parts, ["symbol", "horizon"], "_move", {"_m": 0.5}), ["symbol", "horizon"])
    enough = c("bars") >= 3
    return both.select(
        "symbol", "horizon", "bars", F.when(enough, c("_v")).otherwise(0.0).alias("volatility_pct"), F.when(enough, c("_m")).otherwise(0.0).alias("move_pct")
    )


# -- costs and fees --------------------------------------------------------------------------------
def round_trip_cost(pairs: DataFrame, slippage_bps: float, buffer_bps: float, adverse_pct: float = 0.0) -> DataFrame:
    """Cost and net edge of both execution modes. Needs bid, ask, maker, taker, move_pct, impact_pct."""
    spread = (c("ask") - c("bid")) / ((c("ask") + c("bid")) / 2) * 100
    taker_slip = F.greatest(F.coalesce("impact_pct", F.lit(0.0)), F.lit(2 * slippage_bps / 100))
    maker_slip = F.greatest(F.coalesce(c("impact_pct") / 2, F.lit(0.0)), F.lit(slippage_bps / 100)) + adverse_pct

    def mode(name: str, entry: Column, sp: Column, slip: Column) -> Column:
        return F.struct(F.lit(name).alias("mode"), ((entry + c("taker")) * 100).alias("commission_pct"), sp.alias("spread_pct"), slip.alias("slippage_pct"))

    modes = F.array(
        mode("TAKER_ENTRY_TAKER_EXIT", c("taker"), spread, taker_slip), mode("MAKER_ENTRY_TAKER_EXIT", c("maker"), spread / 2, maker_slip)
    )
    rows = pairs.filter((c("bid") > 0) & (c("ask") >= c("bid"))).withColumn("_m", F.explode(modes))
    added = ("mode", "commission_pct", "spread_pct", "slippage_pct")
    rows = rows.select(*[x for x in pairs.columns if x not in added], "_m.*").withColumn("cost_pct", c("spread_pct") + c("slippage_pct") + c("commission_pct"))
    rows = rows.withColumn("net_edge_pct", c("move_pct") - c("cost_pct"))
    return rows.withColumn("acceptable", c("net_edge_pct") > buffer_bps / 100)


def resolve_fees(symbols: DataFrame, symbol_fees: DataFrame, account_fees: DataFrame, maker: float, taker: float) -> DataFrame:
    """Fee of the symbol, else of its account, else a non-zero fallback, with its source."""
    s = symbol_fees.select("symbol", c("maker").alias("_sm"), c("taker").alias("_st"))
    a = account_fees.select("account", c("maker").alias("_am"), c("taker").alias("_at"))
    rows = symbols.join(s, "symbol", "left").join(a, "account", "left")
    source = F.when(c("_sm").isNotNull(), "SYMBOL_FEE").when(c("_am").isNotNull(), "ACCOUNT_COMMISSION_RATE").otherwise("CONFIGURED_FALLBACK")
    return rows.select(
        "symbol", F.coalesce("_sm", "_am", F.lit(maker)).alias("maker"), F.coalesce("_st", "_at", F.lit(taker)).alias("taker"), source.alias("fee_source")
    )


_RATES = "map<string,string>"


def special_pricing(fees: DataFrame, payload: str = "payload") -> DataFrame:
    """Whether the commission document shows a discount, special or tax component."""
    doc = F.from_json(c(payload), f"specialCommission {_RATES}, taxCommission {_RATES}, discount struct<enabledForAccount:boolean,enabledForSymbol:boolean>")

    def nonzero(m: Column) -> Column:
        values = F.coalesce(F.map_values(m), F.array().cast("array<string>"))
        return F.exists(values, lambda v: F.coalesce(v.try_cast("double"), F.lit(0.0)) != 0)

    rows = fees.withColumn("_d", doc)
    active = F.coalesce(c("_d.discount.enabledForAccount") & c("_d.discount.enabledForSymbol"), F.lit(False))
    rows = rows.withColumns({"special": nonzero(c("_d.specialCommission")), "tax": nonzero(c("_d.taxCommission")), "discount": active}).drop("_d")
    return rows.withColumn("special_pricing", c("special") | c("tax") | c("discount"))


# -- exchange rules --------------------------------------------------------------------------------
_INFO = "symbol string, baseAsset string, quoteAsset string, status string, filters array<map<string,string>>"
DEC = "decimal(38,18)"


def flatten_symbol_rules(info: DataFrame, payload: str = "payload") -> DataFrame:
    """Exchange metadata to typed rules; a market lot without limits falls back to the lot; rejects carry a reason."""
    rows = info.withColumn("_d", F.from_json(c(payload), _INFO)).select(*[x for x in info.columns if x != payload], "_d.*")
    # a filter type listed twice counts once: the last listing wins
    latest = F.aggregate(
        "filters",
        F.create_map().cast("map<string,map<string,string>>"),
        lambda acc, f: F.map_concat(F.map_filter(acc, lambda k, v: k != f["filterType"]), F.create_map(f["filterType"], f)),
    )
    rows = rows.withColumn("_f", latest)

    def value(kind: str, field: str) -> Column:
        return F.try_element_at(F.try_element_at(c("_f"), F.lit(kind)), F.lit(field)).try_cast(DEC)

    market_ok = (value("MARKET_LOT_SIZE", "minQty") > 0) & (value("MARKET_LOT_SIZE", "stepSize") > 0)

    def market(field: str) -> Column:
        return F.when(F.coalesce(market_ok, F.lit(False)), value("MARKET_LOT_SIZE", field)).otherwise(value("LOT_SIZE", field))

    zero = F.lit(0).cast(DEC)
    notional = F.coalesce(value("NOTIONAL", "minNotional"), value("MIN_NOTIONAL", "minNotional"), zero)
    reject = (
        F.when(c("symbol") != F.concat("baseAsset", "quoteAsset"), "IDENTITY")
        .when(value("PRICE_FILTER", "tickSize").isNull() | value("LOT_SIZE", "stepSize").isNull(), "MISSING_FILTER")
        .when(~c("symbol").rlike("^[A-Z0-9]+$"), "AMBIGUOUS")
    )
    out = rows.withColumns(
        {
            "tick_size": value("PRICE_FILTER", "tickSize"),
            "min_price": value("PRICE_FILTER", "minPrice"),
            "max_price": value("PRICE_FILTER", "maxPrice"),
            "min_qty": market("minQty"),
            "max_qty": market("maxQty"),
            "step": market("stepSize"),
            "min_notional": notional,
            "reject": reject,
        }
    )
    return out.drop("filters", "_f")


def to_step(x: Column, step: Column, up: bool = False) -> Column:
    """Round a decimal to a step, down or up; exact on decimals."""
    # the remainder of two decimals is exact; a decimal quotient would be rounded to few digits
    low = (x - x % step).cast(DEC)
    return F.when(F.lit(up) & (low < x), (low + step).cast(DEC)).otherwise(low)


def min_order_quantity(pairs: DataFrame) -> DataFrame:
    """Smallest step-aligned quantity that meets the quantity and notional minima; null above the maximum."""
    need = F.when(c("min_notional") > 0, F.try_divide("min_notional", "price")).otherwise(F.lit(0))
    qty = to_step(F.greatest(c("min_qty").cast(DEC), need.cast(DEC)), c("step"), up=True)
    return pairs.withColumn("min_order_qty", F.when(qty <= c("max_qty"), qty))


def validate_orders(orders: DataFrame) -> DataFrame:
    """All violations of the symbol's rules as an array."""
    value = c("qty") * c("price")
    out = F.array_compact(
        F.array(
            F.when((c("status") != "TRADING") | ~c("spot"), "SYMBOL_NOT_SPOT_TRADABLE"),
            F.when(c("qty") < c("min_qty"), "BELOW_MINIMUM_QUANTITY"),
            F.when(c("qty") > c("max_qty"), "ABOVE_MAXIMUM_QUANTITY"),
            F.when(c("qty") != to_step(c("qty"), c("step")), "INVALID_QUANTITY_STEP"),
            F.when((c("price") < c("min_price")) | ((c("max_price") > 0) & (c("price") > c("max_price"))), "PRICE_OUT_OF_RANGE"),
            F.when(c("price") != to_step(c("price"), c("tick_size")), "INVALID_PRICE_TICK"),
            F.when(value < c("min_notional"), "BELOW_MINIMUM_NOTIONAL"),
            F.when(value > c("max_notional"), "ABOVE_MAXIMUM_NOTIONAL"),
        )
    )
    return orders.withColumn("violations", out)


def size_candidates(rows: DataFrame, risk_pct: float = 0.20, max_risk_pct: float = 0.35) -> DataFrame:
    """Quantity from a risk budget, capped by cash, floored to the step; the reason of a reject.

    Needs equity, cash, entry, stop, fee (round trip), slippage (round trip), step, min_qty, max_qty, min_notional.
    """
    bad = (c("equity") <= 0) | (c("cash") <= 0) | (c("stop") <= 0) | (c("stop") >= c("entry"))
    rate = F.try_divide(c("entry") - c("stop"), c("entry")) + c("fee") + c("slippage")
    out = rows.withColumn("_rate", rate)
    by_risk = F.try_divide(c("equity") * risk_pct / 100, c("entry") * c("_rate"))
    raw = F.least(by_risk, F.try_divide(c("cash"), c("entry")), c("max_qty").cast("double"))
    qty = to_step(raw.cast(DEC), c("step").cast(DEC)).cast("double")
    out = out.withColumn("_q", qty).withColumn("notional", c("_q") * c("entry"))
    out = out.withColumn("estimated_loss", c("notional") * c("_rate"))
    out = out.withColumn("risk_pct", F.try_divide(c("estimated_loss"), c("equity")) * 100)
    reason = (
        F.when(bad, "INVALID")
        .when((c("_q") < c("min_qty")) | (c("notional") < c("min_notional")), "MINIMUM_ORDER_INCOMPATIBLE_WITH_RISK_BUDGET")
        .when(c("risk_pct") > max_risk_pct, "MAXIMUM_RISK_EXCEEDED")
        .otherwise("ACCEPT")
    )
    out = out.withColumn("reason", reason)
    none = c("reason").isin("INVALID", "MINIMUM_ORDER_INCOMPATIBLE_WITH_RISK_BUDGET")
    return out.withColumn("quantity", F.when(none, 0.0).otherwise(c("_q"))).drop("_q", "_rate")


# -- universe --------------------------------------------------------------------------------------
def shortlist_pairs(pairs: DataFrame, quotes: list[str], priority: list[str], min_volume: float, most: int) -> DataFrame:
    """Liquid tradable pairs: all priority bases, then the others by volume up to the cap of the report."""
    good = pairs.filter(c("quote").isin(quotes) & (c("status") == "TRADING") & (c("volume") >= min_volume))
    first = good.filter(c("base").isin(priority))
    rest = good.filter(~c("base").isin(priority)).orderBy(c("volume").desc(), "symbol").limit(most)
    # the cap counts priority pairs too; one row
    taken = first.agg(F.count(F.lit(1)).alias("_k"))
    w = Window.partitionBy(F.lit(0)).orderBy(c("volume").desc(), "symbol")  # at most ``most`` rows
    ranked = rest.withColumn("_n", F.row_number().over(w)).join(F.broadcast(taken))
    others = ranked.filter(c("_n") <= F.lit(most) - c("_k")).drop("_n", "_k")
    return first.withColumn("priority", F.lit(True)).unionByName(others.withColumn("priority", F.lit(False)))


def rank_pairs(pairs: DataFrame) -> DataFrame:
    """Execution mode, six score components and the rank by (allowed, score).

    Needs symbol, maker, taker, spread_pct, volume, depth, move_pct, taker_cost, maker_cost, taker_edge, maker_edge,
    taker_ok, maker_ok (edge above buffer), credible, compatible. One row per listed pair.
    """
    maker, taker = c("compatible") & c("credible") & c("maker_ok"), c("compatible") & c("taker_ok")
    mode = F.when(maker & (~taker | (c("maker_edge") > c("taker_edge"))), "MAKER_ENTRY_TAKER_EXIT").when(taker, "TAKER_ENTRY_TAKER_EXIT")
    fee = F.when(c("credible"), c("maker") + c("taker")).otherwise(c("taker") * 2)
    cost = F.when(c("credible"), c("maker_cost")).otherwise(c("taker_cost"))
    parts = {
        "liquidity": F.log10(F.greatest(c("volume"), F.lit(1.0))),
        "depth_score": F.log10(F.greatest(c("depth"), F.lit(1.0))),
        "spread_score": 1 / (1 + c("spread_pct") * 100),
        "fee_score": 1 / (1 + fee * 10000),
        "movement": F.least(c("move_pct"), F.lit(5.0)),
        "ratio": F.least(c("move_pct") / F.greatest(cost, F.lit(FLOOR)), F.lit(20.0)),
    }
    rows = pairs.withColumns(parts | {"mode": mode})
    total = c("liquidity") * 2 + c("depth_score") + c("spread_score") * 3 + c("fee_score") * 2 + c("movement") + c("ratio") * 4
    rows = rows.withColumns({"score": total, "allowed": c("mode").isNotNull()})
    return global_rank(rows, [c("allowed").cast("int").desc(), F.round("score", 12).desc(), c("symbol")])


def global_rank(rows: DataFrame, order) -> DataFrame:
    return global_index(rows, order, "rank").withColumn("rank", c("rank").cast("int"))


# fixed values: order of the categories
CATEGORY_ORDER = {"ECONOMICALLY_ATTRACTIVE": 0, "MARGINAL": 1, "TOO_EXPENSIVE": 2}


def pair_profile(pairs: DataFrame, horizons: list[str], strategic: list[str], s: dict[str, float]) -> DataFrame:
    """Move over cost per horizon, best strategic ratio, category and rank.

    Needs symbol, volume, bid_depth, ask_depth, fills, spread_p50, spread_p95, slippage, maker, taker and
    ``move_<horizon>``; ``s`` holds min_volume, min_depth, max_spread_bps, max_slippage_bps, min_ratio.
    """
    taker_cost = c("spread_p50") + c("slippage") + c("taker") * 200
    maker_cost = c("spread_p50") / 2 + c("slippage") / 2 + (c("maker") + c("taker")) * 100
    rows = pairs.withColumns({"taker_cost": taker_cost, "maker_cost": maker_cost})
    rows = rows.withColumns({f"ratio_{h}": c(f"move_{h}") / F.greatest(c("taker_cost"), F.lit(FLOOR)) for h in horizons})
    rows = rows.withColumns({f"edge_{h}": c(f"move_{h}") - c("taker_cost") for h in horizons})
    best = F.greatest(*[c(f"ratio_{h}") for h in strategic])
    liquid = (c("volume") >= s["min_volume"]) & (c("bid_depth") >= s["min_depth"]) & (c("ask_depth") >= s["min_depth"]) & c("fills")
    rows = rows.withColumns(
        {
            "max_ratio": best,
            "liquidity_sufficient": liquid,
            "spread_ok": c("spread_p95") * 100 <= s["max_spread_bps"],
            "slippage_ok": c("slippage") * 100 <= s["max_slippage_bps"],
        }
    )
    category = (
        F.when(c("liquidity_sufficient") & c("spread_ok") & c("slippage_ok") & (c("max_ratio") >= s["min_ratio"]), "ECONOMICALLY_ATTRACTIVE")
        .when(c("liquidity_sufficient") & (c("max_ratio") >= 1.5), "MARGINAL")
        .otherwise("TOO_EXPENSIVE")
    )
    rows = rows.withColumn("category", category)
    place = F.when(c("category") == "ECONOMICALLY_ATTRACTIVE", 0).when(c("category") == "MARGINAL", 1).otherwise(2)
    return global_rank(rows, [place, F.round("max_ratio", 12).desc(), c("volume").desc(), c("symbol")])


def best_pair_per_asset(profiles: DataFrame, strategic: list[str]) -> DataFrame:
    """First-ranked quote of each base, with its move over fees and over total cost."""
    rest = [x for x in profiles.columns if x != "base"]
    best = profiles.groupBy("base").agg(F.min_by(F.struct(*rest), "rank").alias("b")).select("base", "b.*")
    move = F.greatest(*[c(f"move_{h}") for h in strategic])
    return best.select(
        "base", "symbol", "category", (move / F.greatest(c("taker") * 200, F.lit(FLOOR))).alias("move_over_fees"), c("max_ratio").alias("move_over_cost")
    )


def liquidity_filter(pairs: DataFrame, quote: str, volume: float, spread_bps: float, min_depth: float) -> DataFrame:
    """Thresholds of one quote currency: volume, spread and both depths."""
    return pairs.filter(
        (c("quote") == quote) & (c("volume") >= volume) & (c("spread_bps") <= spread_bps) & (c("bid_depth") >= min_depth) & (c("ask_depth") >= min_depth)
    )
