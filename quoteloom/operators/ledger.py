"""Analytics on a supplied table of closed trades.

The equity curve is one global series; it is scanned in tiles (days) with a carry from the small table
of tile totals, never through one global window over trades.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoteloom.functions.timing import DAY, HOUR, cell, iso_week, month_text
from quoteloom.operators.scans import balanced_tile

c = F.col
_UP = (Window.unboundedPreceding, Window.currentRow)


def running_peaks(df: DataFrame, keys, order, series: dict[str, tuple[Column, Column]], tile: str) -> DataFrame:
    """Running sums and the running maximum of each sum, in one pass over tiles.

    ``series`` maps a name to ``(value, mask)``; adds ``<name>`` (running sum) and ``<name>_peak`` (its
    running maximum over the masked rows so far, null before the first). A peak of earlier tiles is known
    from their totals: sum and highest inner prefix per tile compose.
    """
    keys, part = list(keys), [*keys, tile]
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(*_UP)
    local = df.withColumns({f"_s_{n}": F.sum(v).over(w) for n, (v, _) in series.items()})
    local = local.withColumns({f"_m_{n}": F.when(mask, c(f"_s_{n}")) for n, (_, mask) in series.items()})
    local = local.withColumns({f"_p_{n}": F.max(f"_m_{n}").over(w) for n in series})
    totals = local.groupBy(*part).agg(
        *[F.sum(v).alias(f"_t_{n}") for n, (v, _) in series.items()], *[F.max(f"_m_{n}").alias(f"_h_{n}") for n in series]
    )
    before = Window.partitionBy(*keys).orderBy(tile).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({f"_c_{n}": F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)) for n in series})
    totals = totals.withColumns({f"_g_{n}": F.max(c(f"_c_{n}") + c(f"_h_{n}")).over(before) for n in series})
    carried = totals.select(*part, *[f"_c_{n}" for n in series], *[f"_g_{n}" for n in series])
    out = local.join(carried, part, "left")
    out = out.withColumns(
        {n: c(f"_c_{n}") + c(f"_s_{n}") for n in series}
        | {f"{n}_peak": F.greatest(c(f"_g_{n}"), c(f"_c_{n}") + c(f"_p_{n}")) for n in series}
    )
    return out.drop(*[f"_{x}_{n}" for x in "smpcg" for n in series])


def _losses(net: str) -> Column:
    return F.when(c(net) < 0, 1).otherwise(0)


def equity_curve(trades: DataFrame, order, capital: float, net: str = "net", tile_width: int | None = DAY) -> DataFrame:
    """Equity, peak, drawdown and losing streak after every trade; tiles of one width, or balanced if None."""
    rows = balanced_tile(trades, []) if tile_width is None else trades.withColumn("_tile", cell("us", tile_width))
    series = {"_cum": (c(net), F.lit(True)), "_loss": (_losses(net), c(net) >= 0)}
    out = running_peaks(rows, [], order, series, "_tile")
    equity = F.lit(capital) + c("_cum")
    peak = F.greatest(F.lit(capital), F.lit(capital) + c("_cum_peak"))
    out = out.withColumns({"equity": equity, "peak": peak, "losing_streak": c("_loss") - F.coalesce("_loss_peak", F.lit(0))})
    out = out.withColumn("drawdown", c("peak") - c("equity"))
    pct = F.when(c("peak") > 0, F.try_divide(c("drawdown"), c("peak")) * 100).otherwise(0.0)
    return out.withColumn("drawdown_pct", pct).drop("_tile", "_cum", "_cum_peak", "_loss", "_loss_peak")


def _sums(net: str = "net") -> list[Column]:
    win, loss = c(net) > 0, c(net) < 0
    return [
        F.count(F.lit(1)).alias("trades"),
        F.sum(win.cast("long")).alias("wins"),
        F.sum(loss.cast("long")).alias("losses"),
        F.sum(net).alias("net_pnl"),
        F.sum("market_pnl").alias("gross_pnl"),
        F.sum("spread_cost").alias("spread_cost"),
        F.sum("slippage_cost").alias("slippage_cost"),
        F.sum("commission").alias("commission"),
        F.coalesce(F.sum(F.when(win, c(net))), F.lit(0.0)).alias("_won"),
        F.coalesce(F.sum(F.when(loss, -c(net))), F.lit(0.0)).alias("_lost"),
    ]


def _ratios() -> dict[str, Column]:
    return {
        "win_rate": c("wins") / c("trades") * 100,
        "average_win": F.coalesce(F.try_divide("_won", "wins"), F.lit(0.0)),
        "average_loss": -F.coalesce(F.try_divide("_lost", "losses"), F.lit(0.0)),
        "expectancy": c("net_pnl") / c("trades"),
        "profit_factor": F.when(c("_lost") > 0, F.try_divide("_won", "_lost")),
    }


def ledger_metrics(trades: DataFrame, order, capital: float) -> DataFrame:
    """Profit, costs, win statistics, drawdown and longest losing streak of the whole ledger."""
    curve = equity_curve(trades, order, capital)
    out = curve.agg(
        *_sums(),
        F.max("drawdown").alias("max_drawdown"),
        F.max("drawdown_pct").alias("max_drawdown_pct"),
        F.max("losing_streak").cast("long").alias("max_losing_streak"),
    )
    return out.withColumns(_ratios()).withColumn("net_return_pct", c("net_pnl") / capital * 100).drop("_won", "_lost")


def daily_results(trades: DataFrame, capital: float) -> DataFrame:
    """Net result and start equity of each traded day; the running frame is over days."""
    days = trades.groupBy(cell("us", DAY).alias("day")).agg(F.sum("net").alias("day_net"), F.count(F.lit(1)).alias("day_trades"))
    before = Window.partitionBy().orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    start = F.lit(capital) + F.coalesce(F.sum("day_net").over(before), F.lit(0.0))
    return days.withColumn("start_equity", start)


def scenario_metrics(trades: DataFrame, capital: float, start_us: int, end_us: int) -> DataFrame:
    """Weekly share, concentration and the distribution of daily returns over the whole calendar."""
    days = daily_results(trades, capital).withColumn("ret", F.try_divide(c("day_net"), c("start_equity")) * 100)
    grid = trades.sparkSession.range(start_us // DAY, (end_us - 1) // DAY + 1).withColumnRenamed("id", "day")
    full = grid.join(days, "day", "left").withColumn("r", F.coalesce("ret", F.lit(0.0)))
    daily = full.agg(
        F.count(F.lit(1)).alias("days"),
        F.sum((c("r") >= 1).cast("long")).alias("days_at_target"),
        F.sum(((c("r") > 0) & (c("r") < 1)).cast("long")).alias("days_between"),
        F.sum((c("r") < 0).cast("long")).alias("negative_days"),
        F.sum(c("ret").isNull().cast("long")).alias("no_trade_days"),
        F.avg("r").alias("average_daily_pct"),
        F.percentile("r", F.lit(0.5)).alias("median_daily_pct"),
        F.max("r").alias("best_day_pct"),
        F.min("r").alias("worst_day_pct"),
    )
    weeks = trades.groupBy(iso_week("us").alias("w")).agg(F.sum("net").alias("n"))
    weekly = weeks.agg(
        F.count(F.lit(1)).alias("active_weeks"),
        F.avg((c("n") > 0).cast("double")).alias("positive_week_ratio"),
        F.coalesce(F.try_divide(F.max(F.when(c("n") > 0, c("n"))), F.sum(F.when(c("n") > 0, c("n")))), F.lit(1.0)).alias("week_concentration"),
    )
    symbols = trades.filter("net > 0").groupBy("symbol").agg(F.sum("net").alias("n"))
    conc = symbols.agg(F.coalesce(F.try_divide(F.max("n"), F.sum("n")), F.lit(1.0)).alias("symbol_concentration"))
    # three one-row tables side by side
    return daily.join(F.broadcast(weekly)).join(F.broadcast(conc))


def breakdown(trades: DataFrame) -> DataFrame:
    """The same sums per symbol and per setup, in one pass over grouping sets."""
    rows = trades.select(
        F.explode(F.array(F.struct(F.lit("SYMBOL").alias("kind"), c("symbol").cast("string").alias("key")), F.struct(F.lit("SETUP").alias("kind"), c("setup").alias("key")))).alias("g"),
        "net", "market_pnl", "spread_cost", "slippage_cost", "commission",
    )
    out = rows.groupBy("g.kind", "g.key").agg(*_sums())
    return out.withColumns(_ratios()).drop("_won", "_lost")


def period_returns(trades: DataFrame, capital: float) -> DataFrame:
    """Return per ISO week and per month, in percent of the capital."""
    periods = F.array(
        F.struct(F.lit("WEEK").alias("kind"), iso_week("us").alias("period")), F.struct(F.lit("MONTH").alias("kind"), month_text("us").alias("period"))
    )
    rows = trades.select(F.explode(periods).alias("p"), "net")
    return rows.groupBy("p.kind", "p.period").agg((F.sum("net") / capital * 100).alias("return_pct"))


def hold_benchmarks(bars: DataFrame, costs: DataFrame, first: object) -> DataFrame:
    """Buy and hold of one symbol, of the equal-weight universe, and cash, gross and net of cost."""
    held = bars.groupBy("symbol").agg(((F.max_by("close", "us") / F.min_by("open", "us") - 1) * 100).alias("gross"))
    held = held.join(costs, "symbol", "left").withColumn("cost", F.coalesce("cost", F.lit(0.0)))
    names = F.array_compact(F.array(F.when(c("symbol") == first, "BUY_AND_HOLD_FIRST"), F.lit("BUY_AND_HOLD_EQUAL_WEIGHT"), F.lit("CASH")))
    rows = held.select(F.explode(names).alias("name"), "gross", "cost")
    zero = c("name") == "CASH"
    return rows.groupBy("name").agg(
        F.avg(F.when(zero, 0.0).otherwise(c("gross"))).alias("gross_pct"),
        F.avg(F.when(zero, 0.0).otherwise(c("cost"))).alias("cost_pct"),
        F.avg(F.when(zero, 0.0).otherwise(c("gross") - c("cost"))).alias("net_pct"),
    )


def concentration(trades: DataFrame) -> DataFrame:
    """Share of the largest symbol and trade in a positive total, and the profit without them."""
    per = trades.groupBy("symbol").agg(F.sum("net").alias("n"), F.max("net").alias("m"))
    out = per.agg(F.sum("n").alias("total"), F.max(F.struct("n", "symbol")).alias("_s"), F.max("m").alias("_m"))
    good = c("total") > 0
    return out.select(
        "total",
        F.when(good, c("_s.symbol")).alias("largest_symbol"),
        F.when(good, c("_s.n") / c("total")).otherwise(0.0).alias("largest_symbol_share"),
        F.when(good, c("_m") / c("total")).otherwise(0.0).alias("largest_trade_share"),
        F.when(good, c("total") - c("_s.n")).otherwise(c("total")).alias("without_largest_symbol"),
        F.when(good, c("total") - c("_m")).otherwise(c("total")).alias("without_largest_trade"),
    )


def ledger_status(trades: DataFrame, order, capital: float, calendar_days: int, prices: DataFrame | None = None, first: object = None) -> DataFrame:
    """Rolling status with the stressed expectancy and the evidence gate; with ``prices`` (symbol, started, latest) also what cash, holding ``first``
    and holding all symbols in equal parts would have returned, in percent."""
    base = ledger_metrics(trades, order, capital)
    weeks = trades.groupBy(iso_week("us").alias("w")).agg(F.sum("net").alias("n"))
    weekly = weeks.agg(F.count(F.lit(1)).alias("active_weeks"), F.sum((c("n") > 0).cast("long")).alias("positive_weeks"))
    out = base.join(F.broadcast(weekly))  # one row each
    stress = c("gross_pnl") - c("commission") * 1.5 - c("spread_cost") * 2 - c("slippage_cost") * 3
    ratio = c("positive_weeks") / F.greatest("active_weeks", F.lit(1))
    enough = F.lit(calendar_days >= 30) & (c("trades") >= 60)
    passes = (
        (c("net_pnl") > 0) & (c("gross_pnl") > 0) & F.coalesce(c("profit_factor") >= 1.20, F.lit(False)) & (c("max_drawdown_pct") <= 10)
        & (ratio >= 0.60) & (stress >= 0)
    )
    verdict = F.when(~enough, "INSUFFICIENT_EVIDENCE").when(passes, "PASSED").otherwise("FAILED")
    out = out.withColumns({"stress_expectancy": stress / c("trades"), "positive_week_ratio": ratio, "verdict": verdict})
    if prices is None:
        return out
    held = F.when(c("started") > 0, (c("latest") / c("started") - 1) * 100)
    one = prices.agg(F.coalesce(F.max(F.when(c("symbol") == first, held)), F.lit(0.0)).alias("hold_first_pct"), F.coalesce(F.avg(held), F.lit(0.0)).alias("hold_equal_weight_pct"))
    return out.join(F.broadcast(one)).withColumns({"cash_pct": F.lit(0.0), "net_return_pct": c("net_pnl") / capital * 100})  # one row each


def daily_report(trades: DataFrame, order, capital: float) -> DataFrame:
    """Each day's start and end equity, costs, wins, drawdown inside the day and target flag."""
    days = daily_results(trades, capital)
    rows = trades.withColumns({"day": cell("us", DAY), "_tile": cell("us", HOUR)})
    run = running_peaks(rows, ["day"], order, {"_cum": (c("net"), F.lit(True))}, "_tile").join(days, "day")
    peak = F.greatest(c("start_equity"), c("start_equity") + c("_cum_peak"))
    dd = F.when(peak > 0, F.try_divide(peak - (c("start_equity") + c("_cum")), peak) * 100).otherwise(0.0)
    out = run.groupBy("day").agg(
        F.first("start_equity").alias("start_equity"),
        F.sum("net").alias("net"),
        F.count(F.lit(1)).alias("trades"),
        F.sum((c("net") > 0).cast("long")).alias("wins"),
        F.sum("commission").alias("fees"),
        F.max(dd).alias("drawdown_pct"),
    )
    ret = F.when(c("start_equity") > 0, F.try_divide(c("net"), c("start_equity")) * 100).otherwise(0.0)
    out = out.withColumn("return_pct", ret)
    return out.withColumns({"end_equity": c("start_equity") + c("net"), "target_reached": c("return_pct") >= 1.0})


def daily_gate_flags(trades: DataFrame, order, capital: float, target: float = 1.0, limit: float = -1.0, most: int = 6, streak: int = 3) -> DataFrame:
    """State of the daily limits just before each trade: day return, trades so far, losing streak."""
    days = daily_results(trades, capital)
    rows = trades.withColumns({"day": cell("us", DAY), "_tile": cell("us", HOUR)})
    lost = F.when(c("net") <= 0, 1).otherwise(0)
    series = {"_cum": (c("net"), F.lit(True)), "_n": (F.lit(1), F.lit(True)), "_l": (lost, c("net") > 0)}
    run = running_peaks(rows, ["day"], order, series, "_tile").join(days.select("day", "start_equity"), "day")
    # the state before this trade: undo its own contribution; a win ends a streak only afterwards
    won = c("net") > 0
    prior_losses = c("_l") - lost
    run = run.withColumns({"day_pnl_before": c("_cum") - c("net"), "trades_before": c("_n") - 1, "_lb": prior_losses})
    keyed = run.withColumn("_won_level", F.when(won, c("_l")))
    w = Window.partitionBy("day", "_tile").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.max("_won_level").over(w)
    tile_best = keyed.groupBy("day", "_tile").agg(F.max("_won_level").alias("_b"))
    earlier = Window.partitionBy("day").orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    tile_best = tile_best.select("day", "_tile", F.max("_b").over(earlier).alias("_earlier"))
    out = keyed.withColumn("_inside", inside).join(tile_best, ["day", "_tile"], "left")
    last_win = F.coalesce(F.greatest("_inside", "_earlier"), F.lit(0))
    out = out.withColumns({"streak_before": c("_lb") - last_win, "day_return_before": F.coalesce(F.try_divide(c("day_pnl_before"), c("start_equity")) * 100, F.lit(0.0))})
    state = (
        F.when(c("day_return_before") >= target, "DAILY_TARGET_REACHED")
        .when(c("day_return_before") <= limit, "DAILY_LOSS_LIMIT_REACHED")
        .when(c("streak_before") >= streak, "COOLDOWN")
        .when(c("trades_before") >= most, "DISABLED")
        .otherwise("ACTIVE")
    )
    scratch = ["_cum", "_cum_peak", "_n", "_n_peak", "_l", "_l_peak", "_lb", "_won_level", "_inside", "_earlier", "_tile"]
    return out.withColumn("state", state).drop(*scratch)
