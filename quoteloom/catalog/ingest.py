"""Scans, sinks and ingest steps on the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quoteloom.catalog.registry import CANDLES, QUOTES, register, with_views
from quoteloom.functions.output import rounded
from quoteloom.functions.timing import DAY, HOUR, WEEK, cell, day_text
from quoteloom.operators import bars as B
from quoteloom.plans.quality import quality_report
from quoteloom.session import checkpoint_dir
from quoteloom.sources import tables as S
from quoteloom.sources.views import candles, quotes, table

START = 1_704_067_200_000_000  # 2024-01-01
END = START + 30 * DAY
R6 = rounded


def scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def by_day(df):
    return df.groupBy("symbol", day_text("us").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), R6(F.sum("bid")).alias("bid_sum")
    )


DAY_SQL = "strftime(make_timestamp(us), '%Y-%m-%d')"


@register(
    "s1_read_ticks",
    with_views(QUOTES)
    + f"""SELECT symbol, count(*) AS n, min(us) AS first_us, max(us) AS last_us, round(sum(bid), 6) AS bid_sum
    FROM quotes WHERE symbol = 'click' AND us >= {START + 3 * DAY + 5 * HOUR} AND us < {START + 9 * DAY + 7 * HOUR}
    GROUP BY symbol""",
)
def s1(spark, d):
    path = scratch(spark, "ticks")
    S.merge_ticks(quotes(spark, d).drop("mid", "spread"), path)
    got = S.read_ticks(spark, path, "click", START + 3 * DAY + 5 * HOUR, START + 9 * DAY + 7 * HOUR)
    return got.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
        R6(F.sum("bid")).alias("bid_sum"),
    )


@register(
    "s2_read_quotes",
    with_views(QUOTES)
    + f"""SELECT symbol, count(*) AS n, round(sum((ask - bid) / 0.01), 6) AS spread_points
    FROM quotes WHERE us >= {START + DAY} AND us < {START + 20 * DAY} GROUP BY symbol""",
)
def s2(spark, d):
    q = S.read_quotes(quotes(spark, d), START + DAY, START + 20 * DAY, 0.01)
    return q.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), R6(F.sum("spread_points")).alias("spread_points"))


@register(
    "s3_read_bars",
    with_views(CANDLES)
    + f"""SELECT symbol, us, close, false AS complete FROM candles
    WHERE us >= {841795200000000 - 26 * WEEK} AND us <= 841795200000000""",
)
def s3(spark, d):
    return S.read_bars(candles(spark, d), 841_795_200_000_000, 26 * WEEK).select("symbol", "us", "close", "complete")


@register(
    "s4_merge_ticks",
    with_views(QUOTES)
    + f"""SELECT symbol, {DAY_SQL} AS day, 2 * count(*) AS n, round(sum(bid) + sum(bid + 0.5), 6) AS bid_sum
    FROM quotes GROUP BY ALL""",
)
def s4(spark, d):
    path = scratch(spark, "merge")
    q = quotes(spark, d).drop("mid", "spread")
    S.merge_ticks(q, path)
    S.merge_ticks(q, path)  # replay: nothing may change
    S.merge_ticks(q.withColumn("bid", F.col("bid") + 0.5), path)  # same times, different ticks: kept
    return by_day(spark.read.parquet(path))


@register(
    "s5_write_bars",
    with_views(CANDLES)
    + f"""SELECT symbol, count(*) AS n, round(sum(CASE WHEN us >= {841795200000000} THEN close * 2 ELSE close END), 6)
    AS close_sum FROM candles GROUP BY symbol""",
)
def s5(spark, d):
    path = scratch(spark, "bars")
    bars = candles(spark, d).withColumn("frame", F.lit("W1"))
    S.write_bars(bars, path, replace=True, period="year")
    revised = bars.filter(F.col("us") >= 841_795_200_000_000).withColumn("close", F.col("close") * 2)
    S.write_bars(revised, path, replace=False, period="year")
    return S.read_store(spark, path).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), R6(F.sum("close")).alias("close_sum")
    )


@register(
    "s6_append_unique",
    """WITH k AS (SELECT event_type, user_id, min(event_id) AS first_id FROM events GROUP BY 1, 2)
    SELECT event_type, count(*) AS n, CAST(sum(first_id) AS BIGINT) AS first_ids FROM k GROUP BY 1""",
)
def s6(spark, d):
    path = scratch(spark, "append")
    e = table(spark, d, "events").select("event_id", "event_type", "user_id")
    S.append_unique(e, path, ["event_type", "user_id"], "event_id")
    S.append_unique(e, path, ["event_type", "user_id"], "event_id")
    return S.read_store(spark, path).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("first_ids")
    )


def raw_messages(spark, d):
    """Book, trade, candle and unknown messages rebuilt as JSON text from the tick table."""
    q = quotes(spark, d)
    num = lambda c: F.format_string("%.4f", c)
    book = F.concat(
        F.lit('{"u":'), F.col("seq"), F.lit(',"s":"'), F.col("symbol"), F.lit('","b":"'), num(F.col("bid")),
        F.lit('","B":"1","a":"'), num(F.when(F.col("volume") == 7, F.col("bid") - 1).otherwise(F.col("ask"))),
        F.lit('","A":"2"}'),
    )
    trade = F.concat(
        F.lit('{"e":"aggTrade","s":"'), F.col("symbol"), F.lit('","a":'), F.col("seq"), F.lit(',"p":"'),
        num(F.col("mid")), F.lit('","q":"'), num(F.col("volume")), F.lit('","T":'), F.floor(F.col("us") / 1000),
        F.lit(',"m":'), F.when(F.col("volume") < 50, "true").otherwise("false"), F.lit("}"),
    )
    candle = F.concat(
        F.lit('{"e":"kline","s":"'), F.col("symbol"), F.lit('","k":{"t":'), F.floor(F.col("us") / 1000),
        F.lit(',"T":0,"n":1,"i":"'), F.when(F.col("volume") < 90, "1m").otherwise("3m"), F.lit('","o":"'),
        num(F.col("bid")), F.lit('","h":"'), num(F.col("ask")), F.lit('","l":"'), num(F.col("bid")),
        F.lit('","c":"'), num(F.col("mid")), F.lit('","v":"'), num(F.col("volume")), F.lit('","x":true}}'),
    )
    kind = F.pmod(F.col("seq"), F.lit(4))
    text = F.when(kind == 0, book).when(kind == 1, trade).when(kind == 2, candle).otherwise('{"e":"depth"}')
    return q.select("seq", "us", text.alias("payload"))


@register(
    "s7_normalize_events",
    with_views(QUOTES)
    + """, m AS (SELECT *, seq % 4 AS kd FROM quotes)
    SELECT CASE kd WHEN 0 THEN 'book' WHEN 1 THEN 'trade' WHEN 2 THEN 'candle' ELSE 'none' END AS kind,
      CASE WHEN kd = 3 THEN 'UNSUPPORTED_EVENT' WHEN kd = 0 AND volume = 7 THEN 'CROSSED_BOOK'
           WHEN kd = 2 AND NOT volume < 90 THEN 'BAD_INTERVAL' ELSE 'ok' END AS reject,
      count(*) AS n,
      round(sum(CASE WHEN kd = 0 THEN CAST(printf('%.4f', bid) AS DOUBLE)
                     WHEN kd = 1 THEN CAST(printf('%.4f', mid) AS DOUBLE)
                     WHEN kd = 2 THEN CAST(printf('%.4f', mid) AS DOUBLE) END), 4) AS price_sum,
      count(CASE WHEN kd = 1 AND volume < 50 THEN 1 END) AS sells
    FROM m GROUP BY 1, 2""",
)
def s7(spark, d):
    typed = S.normalize_events(raw_messages(spark, d))
    price = F.coalesce("bid", "price", "close").cast("double")
    return typed.groupBy(F.coalesce("kind", F.lit("none")).alias("kind"), F.coalesce("reject", F.lit("ok")).alias("reject")).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum(price), 4).alias("price_sum"),
        F.count(F.when(F.col("taker_side") == "SELL", 1)).alias("sells"),
    )


@register(
    "s8_archive_raw",
    "SELECT sha256(props) AS payload_key, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1",
)
def s8(spark, d):
    raw = table(spark, d, "events").select("event_id", F.col("props").alias("payload"))
    return S.archive_raw(raw).groupBy("payload_key").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id")
    )


@register(
    "s9_flatten_rest_candles",
    with_views(CANDLES)
    + f"""SELECT symbol, us, round(open, 6) AS open, round(close, 6) AS close, trades,
      us + {WEEK} < {841795200000000} AS closed FROM candles""",
)
def s9(spark, d):
    c = candles(spark, d)
    num = lambda x: F.format_string("%.12f", F.col(x))
    ms = F.floor(F.col("us") / 1000).cast("string")
    row = F.array(
        ms, num("open"), num("high"), num("low"), num("close"), num("volume"),
        F.floor((F.col("us") + WEEK) / 1000).cast("string"), num("volume"), F.col("trades").cast("string"),
        num("volume"), num("volume"), F.lit("0"),
    )
    flat = S.flatten_rest_candles(c.select("symbol", row.alias("row")), 841_795_200_000_000)
    return flat.select(
        "symbol", "us", rounded(F.col("open")).alias("open"),
        rounded(F.col("close")).alias("close"), "trades", "closed",
    )


@register(
    "s10_read_candles",
    with_views(CANDLES)
    + """SELECT symbol, count(*) AS n, round(sum(close * 1.5), 6) AS close_sum FROM candles
    WHERE symbol IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
      AND us >= 757382400000000 AND us < 841795200000000 GROUP BY symbol""",
)
def s10(spark, d):
    c = candles(spark, d).withColumns({"closed": F.lit(True), "part": F.lit(1)})
    later = c.withColumns({"close": F.col("close") * 1.5, "part": F.lit(2)})
    wanted = table(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("symbol"))
    got = S.read_candles(c.unionByName(later), wanted, 757_382_400_000_000, 841_795_200_000_000)
    return got.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), R6(F.sum("close")).alias("close_sum"))


@register(
    "s11_union_archive_live",
    with_views(CANDLES)
    + """SELECT symbol, us, round(CASE WHEN us >= 820454400000000 THEN close + 1 ELSE close END, 6) AS close
    FROM candles""",
)
def s11(spark, d):
    c = candles(spark, d)
    live = c.filter(F.col("us") >= 820_454_400_000_000).select("symbol", "us", (F.col("close") + 1).alias("close"))
    return S.union_archive_live(c, live).select("symbol", "us", R6("close").alias("close"))


@register(
    "s12_ingest_days",
    with_views(QUOTES)
    + f"""SELECT {START} + dd * {DAY} AS start_us, CASE WHEN dd < 10 THEN 'RESUMED' ELSE 'LOADED' END AS status,
      count(us) AS accepted
    FROM range(30) t(dd) LEFT JOIN quotes ON us >= {START} + dd * {DAY} AND us < {START} + (dd + 1) * {DAY}
    GROUP BY 1, 2""",
)
def s12(spark, d):
    q, path = quotes(spark, d), scratch(spark, "days")
    S.load_days(S.day_chunks(spark, START, START + 10 * DAY), q, path)
    status = S.load_days(S.day_chunks(spark, START, END), q, path)
    stored = S.read_store(spark, path).groupBy(cell("us", DAY).alias("_day")).agg(F.count(F.lit(1)).alias("accepted"))
    return status.drop("accepted").join(stored, cell("start_us", DAY) == F.col("_day"), "left").select("start_us", "status", F.coalesce("accepted", F.lit(0)).alias("accepted"))


@register(
    "s13_validate_ticks",
    with_views(QUOTES)
    + f""", r AS (SELECT * FROM quotes UNION ALL
        SELECT seq, symbol, us, CASE WHEN volume > 80 THEN ask + 1 ELSE bid END, ask, volume, mid, spread FROM quotes),
      k AS (SELECT *, CASE WHEN ask < bid THEN 'invalid' WHEN us < {START + DAY} OR us >= {END - DAY} THEN 'out_of_range'
         ELSE 'candidate' END AS st FROM r)
    SELECT count(*) AS source_rows, count(DISTINCT CASE WHEN st = 'candidate' THEN seq END) AS accepted,
      count(CASE WHEN st = 'candidate' THEN 1 END) - count(DISTINCT CASE WHEN st = 'candidate' THEN seq END) AS duplicate,
      count(CASE WHEN st = 'invalid' THEN 1 END) AS invalid,
      count(CASE WHEN st = 'out_of_range' THEN 1 END) AS out_of_range FROM k""",
)
def s13(spark, d):
    q = quotes(spark, d)
    again = q.withColumn("bid", F.when(F.col("volume") > 80, F.col("ask") + 1).otherwise(F.col("bid")))
    return S.validate_ticks(q.unionByName(again), START + DAY, END - DAY, ["symbol", "us", "bid", "ask", "volume"])


@register(
    "s14_to_canonical_utc",
    """WITH w AS (SELECT o_orderkey, o_orderdate + to_hours(CAST(o_orderkey % 24 AS BIGINT)) AS wall FROM orders),
    z AS (SELECT *, wall - to_hours(1) AS winter, wall - to_hours(2) AS summer FROM w),
    f AS (SELECT *, CAST(timezone('Europe/Paris', timezone('UTC', winter)) AS TIMESTAMP) = wall AS wok,
                    CAST(timezone('Europe/Paris', timezone('UTC', summer)) AS TIMESTAMP) = wall AS sok FROM z)
    SELECT o_orderkey, epoch_us(CASE WHEN wok AND sok THEN NULL WHEN wok THEN winter WHEN sok THEN summer END) AS utc_us,
      CASE WHEN wok AND sok THEN 'AMBIGUOUS' WHEN NOT wok AND NOT sok THEN 'NONEXISTENT' END AS dst_reject
    FROM f""",
)
def s14(spark, d):
    o = table(spark, d, "orders")
    hours = F.make_dt_interval(F.lit(0), F.pmod("o_orderkey", F.lit(24)).cast("int"))
    walls = o.select("o_orderkey", (F.col("o_orderdate").cast("timestamp") + hours).alias("wall"))
    done = S.to_canonical_utc(walls, "wall", "Europe/Paris")
    return done.select("o_orderkey", F.unix_micros("utc").alias("utc_us"), "dst_reject")


@register(
    "s15_dataset_seal",
    with_views(QUOTES)
    + f"""SELECT count(*) AS ticks, min(us) AS first_us, max(us) AS last_us, count(DISTINCT us // {DAY}) AS active_days,
      30 - count(DISTINCT us // {DAY}) AS empty_days,
      CASE WHEN min(us) < {START} OR max(us) >= {END} THEN 'OUT_OF_RANGE' ELSE 'VALID' END AS status FROM quotes""",
)
def s15(spark, d):
    return S.dataset_seal(quotes(spark, d), START, END)


@register(
    "s16_quality_report",
    with_views(QUOTES)
    + f""", g AS (SELECT us - lag(us) OVER (PARTITION BY symbol ORDER BY us, seq) AS gap FROM quotes),
      b AS (SELECT count(*) AS bars FROM (SELECT DISTINCT symbol, us // {HOUR} FROM quotes))
    SELECT (SELECT count(*) FROM quotes) AS ticks, (SELECT min(us) FROM quotes) AS first_us,
      (SELECT max(us) FROM quotes) AS last_us, (SELECT count(*) FROM g WHERE gap > {6 * HOUR}) AS gaps,
      (SELECT CAST(max(gap) AS BIGINT) FROM g) AS widest_gap_us, (SELECT bars FROM b) AS bars""",
)
def s16(spark, d):
    q = quotes(spark, d)
    one = q.agg(F.count(F.lit(1)).alias("ticks"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    g = B.gaps(q, 0).agg(F.count(F.when(F.col("gap_us") > 6 * HOUR, 1)).alias("gaps"), F.max("gap_us").alias("widest_gap_us"))
    b = B.bars_from_ticks(q, HOUR).agg(F.count(F.lit(1)).alias("bars"))
    # three one-row reports side by side
    return one.join(F.broadcast(g)).join(F.broadcast(b))


QUALITY_FRAMES = {"h1": HOUR, "d1": DAY}


@register(
    "s16_symbol_quality",
    with_views(QUOTES)
    + f""", r AS (SELECT * FROM quotes UNION ALL SELECT seq, symbol, us, CASE WHEN volume > 80 THEN ask + 1 ELSE bid END, ask, volume, mid, spread FROM quotes),
    k AS (SELECT symbol, us, bid, ask, min(seq) AS seq, count(*) AS n, CASE WHEN ask < bid OR bid <= 0 THEN 'invalid' WHEN us < {START + DAY} OR us >= {END - DAY} THEN 'out_of_range' ELSE 'candidate' END AS st FROM r GROUP BY symbol, us, bid, ask),
    a AS (SELECT * FROM k WHERE st = 'candidate'), g AS (SELECT symbol, us - lag(us) OVER (PARTITION BY symbol ORDER BY us, seq) AS gap FROM a),
    s AS (SELECT *, (ask - bid) / 0.01 AS sp, row_number() OVER (PARTITION BY symbol ORDER BY (ask - bid) / 0.01) AS rn, count(*) OVER (PARTITION BY symbol) AS t FROM a)
    SELECT k.symbol, CAST({START + DAY} AS BIGINT) AS requested_start_us, CAST({END - DAY} AS BIGINT) AS requested_end_us, sum(n) AS source_rows, count(CASE WHEN st = 'candidate' THEN 1 END) AS accepted, sum(CASE WHEN st = 'candidate' THEN n - 1 ELSE 0 END) AS duplicate,
      sum(CASE WHEN st = 'invalid' THEN n ELSE 0 END) AS invalid, sum(CASE WHEN st = 'out_of_range' THEN n ELSE 0 END) AS out_of_range, min(CASE WHEN st = 'candidate' THEN us END) AS covered_start_us, max(CASE WHEN st = 'candidate' THEN us END) AS covered_end_us,
      (SELECT count(*) FROM g WHERE g.symbol = k.symbol AND gap > {6 * HOUR}) AS gaps, (SELECT max(gap) FROM g WHERE g.symbol = k.symbol AND gap > {6 * HOUR}) AS widest_gap_us,
      (SELECT round(min(sp), 6) FROM s WHERE s.symbol = k.symbol) AS spread_minimum, (SELECT round(median(sp), 6) FROM s WHERE s.symbol = k.symbol) AS spread_median,
      (SELECT round(min(sp), 6) FROM s WHERE s.symbol = k.symbol AND rn >= greatest(ceil(t * 0.95), 1)) AS spread_p95, (SELECT round(max(sp), 6) FROM s WHERE s.symbol = k.symbol) AS spread_maximum,
      (SELECT count(DISTINCT us // {HOUR}) FROM a WHERE a.symbol = k.symbol) AS bars_h1, (SELECT count(DISTINCT us // {DAY}) FROM a WHERE a.symbol = k.symbol) AS bars_d1 FROM k GROUP BY k.symbol""",
)
def s16_symbols(spark, d):
    q = quotes(spark, d)
    doubled = q.unionByName(q.withColumn("bid", F.when(F.col("volume") > 80, F.col("ask") + 1).otherwise(F.col("bid"))))
    out = quality_report(doubled, START + DAY, END - DAY, ["symbol", "us", "bid", "ask"], 6 * HOUR, 0.01, QUALITY_FRAMES)
    names = ["minimum", "median", "p95", "maximum"]
    return out.select(*[c for c in out.columns if not c.startswith("spread_")], *[R6(f"spread_{n}").alias(f"spread_{n}") for n in names])


@register(
    "s17_candle_quality",
    with_views(CANDLES, QUOTES)
    + """SELECT true AS times_utc, (SELECT bool_and(ask >= bid) FROM quotes) AS book_ask_gte_bid, bool_and(high >= greatest(open, close) AND low <= least(open, close)) AS ohlc_ok,
      bool_and(us % 60000000 = 0) AS minute_aligned, bool_and(open IS NOT NULL AND close IS NOT NULL) AS no_nulls,
      count(*) AS candles FROM candles""",
)
def s17(spark, d):
    return S.candle_quality(candles(spark, d), quotes(spark, d))
