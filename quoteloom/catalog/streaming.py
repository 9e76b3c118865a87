"""Streaming jobs driven to completion over landing files cut from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quoteloom.catalog.features import strength
from quoteloom.catalog.ingest import raw_messages
from quoteloom.catalog.labels import HOUR
from quoteloom.catalog.micro import SEC
from quoteloom.catalog.registry import QUOTES, register, with_views
from quoteloom.catalog.signals import COOL, DET, EPI, FLAG_NAMES, FLAGS, flagged, recursive, scored
from quoteloom.functions.output import round_doubles
from quoteloom.functions.timing import WEEK
from quoteloom.operators import signals as G
from quoteloom.session import durable, shared_path
from quoteloom.sources.views import candles, quotes, table
from quoteloom.streaming import jobs as J


def scratch(spark) -> str:
    return shared_path(spark, "stream")


def landed(spark, df, order: str, batches: int = 4):
    """Landing folder filled in order of time, read back as a stream of several micro-batches."""
    root = scratch(spark)
    parts = durable(df.repartitionByRange(batches, order).withColumn("_part", F.spark_partition_id()))
    for i in range(batches):  # later files are younger, and the source takes them in that order
        some = parts.filter(F.col("_part") == i).drop("_part")
        some.repartitionByRange(2, order).sortWithinPartitions(order).write.mode("append").parquet(f"{root}/in")
    return root, J.landing(spark, f"{root}/in", df.schema, files_per_trigger=2)


def passed(source: str, delay: int = 60_000) -> str:
    """Time up to which the watermark lets a stream of ``source`` go, in SQL."""
    return f"((SELECT max(us) FROM {source}) // 1000 - {delay}) * 1000"


@register(
    "st1_stream_events",
    with_views(QUOTES)
    + """, m AS (SELECT *, seq % 4 AS kd FROM quotes) SELECT CASE WHEN kd = 3 OR (kd = 0 AND volume = 7) OR (kd = 2 AND NOT volume < 90) THEN 'reject' ELSE 'good' END AS sink, count(*) AS n FROM m GROUP BY 1""",
)
def st1(spark, d):
    root, raw = landed(spark, raw_messages(spark, d), "us")
    J.stream_events(raw, f"{root}/good", f"{root}/bad", f"{root}/cp")
    good, bad = (spark.read.parquet(f"{root}/{x}").select(F.lit(n).alias("sink")) for x, n in (("good", "good"), ("bad", "reject")))
    return good.unionByName(bad).groupBy("sink").agg(F.count(F.lit(1)).alias("n"))


@register("st2_stream_dedupe", with_views(QUOTES) + "SELECT symbol, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seqs FROM quotes GROUP BY symbol")
def st2(spark, d):
    q = quotes(spark, d).select("symbol", "us", "seq")
    root, ticks = landed(spark, q.unionByName(q), "us")
    J.run_to_end(J.stream_dedupe(ticks, ["symbol", "seq"], "2 days"), f"{root}/out", f"{root}/cp")
    return spark.read.parquet(f"{root}/out").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seqs"))


@register(
    "st3_stream_bars",
    with_views(QUOTES)
    + f"""SELECT symbol, us // {HOUR} * {HOUR} AS us, round(arg_min(mid, (us, seq)), 6) AS open, round(max(mid), 6) AS high, round(arg_max(mid, (us, seq)), 6) AS close, count(*) AS ticks FROM quotes
    WHERE us // {HOUR} * {HOUR} + {HOUR} <= (SELECT max(us) // 1000 * 1000 FROM quotes) - {2 * HOUR} GROUP BY symbol, us // {HOUR} * {HOUR}""",
)
def st3(spark, d):
    root, ticks = landed(spark, quotes(spark, d), "us")
    J.run_to_end(J.flatten_window(J.stream_bars(ticks, "1 hour", "2 hours")), f"{root}/out", f"{root}/cp")
    return round_doubles(spark.read.parquet(f"{root}/out").select("symbol", "us", "open", "high", "close", "ticks"))


@register("st4_stream_rollup")
def st4(spark, d):
    root, ticks = landed(spark, quotes(spark, d), "us")
    J.run_to_end(J.flatten_window(J.stream_rollup(J.stream_bars(ticks, "1 hour", "2 hours"), "6 hours")), f"{root}/out", f"{root}/cp")
    return round_doubles(spark.read.parquet(f"{root}/out").select("symbol", "us", "open", "high", "close", "ticks"))


@register("st5_stream_cooldown", recursive(QUOTES, SEC, DET, FLAGS, COOL) + f"SELECT symbol, us, scheme FROM cool WHERE keep AND us <= {passed('cool')}")
def st5(spark, d):
    root, events = landed(spark, G.triggered(flagged(spark, d), FLAG_NAMES), "us")
    J.run_to_end(J.stream_cooldown(events, 3 * HOUR), f"{root}/out", f"{root}/cp")
    return spark.read.parquet(f"{root}/out")


@register(
    "st5_stream_episodes",
    recursive(QUOTES, SEC, EPI)
    + """SELECT m.symbol, st AS start_us, arg_min(direction, us) FILTER (act <> 0) AS direction, max(score) FILTER (act <> 0) AS peak_score, count(*) FILTER (act <> 0) AS states, max(us) FILTER (act = 0) AS end_us, max(why) AS end_reason
    FROM ma m WHERE act <> 0 OR was <> 0 GROUP BY m.symbol, st HAVING max(why) IS NOT NULL AND max(us) FILTER (act = 0) <= """
    + passed("ma"),
)
def st5e(spark, d):
    root, rows = landed(spark, scored(spark, d), "us")
    J.run_to_end(J.stream_episodes(rows, 80, 75), f"{root}/out", f"{root}/cp")
    return spark.read.parquet(f"{root}/out")


EXPECTED = 5  # symbols of a complete cross-section


@register("st6_stream_decisions")
def st6(spark, d):
    bars = durable(candles(spark, d))  # the features and every batch read it
    feats = strength(spark, d, bars).select(
        "symbol", "us", "return_1h", "return_4h", "return_24h", "volume_relative", "trend_efficiency", "expected_move_pct", (F.col("us") + F.pmod(F.col("us") / WEEK, F.lit(7)).cast("long") * HOUR).alias("arrived_us")
    )
    prof = table(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol"), (F.col("s_acctbal") > 0).alias("liquidity_sufficient"), (F.col("s_acctbal") / 1000).alias("max_ratio"))
    root, stream = landed(spark, feats, "us")
    J.stream_decisions(stream, prof, bars, 1, 2, 3, EXPECTED, f"{root}/out", f"{root}/cp", 4 * HOUR, 4 * WEEK)
    out = spark.read.parquet(f"{root}/out")
    return out.select("us", "symbols", "regime", "signal", "rejection", "complete", "latency_us", "status")


@register(
    "st7_skip_late",
    with_views(QUOTES)
    + f"""SELECT seq, CASE WHEN volume * 2 > 60 THEN 'SKIPPED_LATE' ELSE 'DECIDED' END AS status, CASE WHEN volume * 2 > 60 THEN NULL ELSE symbol END AS signal FROM quotes""",
)
def st7(spark, d):
    q = quotes(spark, d).select("seq", "us", F.col("symbol").alias("signal"), (F.col("us") + (F.col("volume") * 2_000_000).cast("long")).alias("now"))
    root, stream = landed(spark, q.unionByName(q), "us")  # every time comes twice
    J.stream_skip_late(stream, ["seq", "us"], "now", 60_000_000, f"{root}/out", f"{root}/cp")
    return spark.read.parquet(f"{root}/out").select("seq", "status", "signal")


@register(
    "st8_repair_stream",
    with_views(QUOTES)
    + f"""SELECT symbol, (max(h) - min(h)) // {HOUR} + 1 AS expected, (max(h) - min(h)) // {HOUR} + 1 AS present, 100.0 AS coverage_pct, (max(h) - min(h)) // {HOUR} + 1 - count(DISTINCT h) AS repaired
    FROM (SELECT symbol, us // {HOUR} * {HOUR} AS h FROM quotes) q GROUP BY symbol""",
)
def st8(spark, d):
    """Gaps found over several batches, fetched from a source that has every hour, and inspected again."""
    hourly = quotes(spark, d).groupBy("symbol", (F.col("us") - F.pmod(F.col("us"), F.lit(HOUR))).alias("us")).agg(F.count(F.lit(1)).alias("ticks"))
    root, stream = landed(spark, hourly, "us")
    J.repair_stream(stream, HOUR, f"{root}/out", f"{root}/cp", 100)
    hourly.write.parquet(f"{root}/store")
    span = hourly.agg(F.min("us").alias("lo"), F.max("us").alias("hi")).crossJoin(hourly.select("symbol").distinct())  # one row times the symbols
    source = span.select("symbol", F.explode(F.sequence("lo", "hi", F.lit(HOUR))).alias("us"), F.lit(0).cast("long").alias("ticks"))
    after = J.apply_repair(spark.read.parquet(f"{root}/out"), source, f"{root}/store", HOUR)
    return after.join(hourly.groupBy("symbol").agg(F.count(F.lit(1)).alias("_was")), "symbol").select("symbol", "expected", "present", "coverage_pct", (F.col("present") - F.col("_was")).alias("repaired"))
