"""Market views over the generic test tables (ticks, candles, trades, books, predictions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteloom.session import use_utc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tick stream of five symbols; ``seq`` is the total order of equal times."""
    half = (F.col("event_id") % 5 + 1) * 0.01
    base = F.lit(100) + F.col("value") / 10
    ticks = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("symbol"),
        micros("ts").alias("us"),
        (base - half).alias("bid"),
        (base + half).alias("ask"),
        F.col("user_id").cast("double").alias("volume"),
    )
    return ticks.withColumns(
        {"mid": (F.col("bid") + F.col("ask")) / 2, "spread": F.col("ask") - F.col("bid")}
    )


LINE_KEY = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


def candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly candles per supplier; open and close by the total order of the lines."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("symbol"),
        F.date_trunc("week", F.col("l_shipdate").cast("timestamp")).alias("wk"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
        F.col("l_quantity").alias("q"),
        F.struct(*LINE_KEY).alias("k"),
    )
    bars = lines.groupBy("symbol", "wk").agg(
        F.min_by("px", "k").alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", "k").alias("close"),
        F.sum("q").alias("volume"),
        F.count(F.lit(1)).alias("trades"),
    )
    return bars.withColumn("us", F.unix_micros("wk")).drop("wk")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One closed trade per order line."""
    price = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("symbol"),
        F.col("l_returnflag").alias("setup"),
        micros("l_shipdate").alias("us"),
        (price * (F.col("l_discount") - 0.05)).alias("market_pnl"),
        (price * 0.0005).alias("spread_cost"),
        (price * 0.0002).alias("slippage_cost"),
        (price * F.col("l_tax") * 0.01).alias("commission"),
        (price * (F.col("l_discount") - 0.05) - price * 0.0002 - price * F.col("l_tax") * 0.01).alias("net"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
    )


LEDGER_ORDER = ("us", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def book_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as depth levels of one book snapshot per order."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("snapshot"),
        F.when(F.col("l_linenumber") % 2 == 0, "ask").otherwise("bid").alias("side"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("qty"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        micros("l_shipdate").alias("us"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows with a binary outcome and a payoff."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        micros("ts").alias("us"),
        F.to_date(F.col("ts").cast("timestamp")).alias("day"),
        (F.col("user_id") % 4 + 1).alias("fold"),
        F.when(F.col("event_id") % 2 == 0, "LONG").otherwise("SHORT").alias("side"),
        (F.col("event_id") * 7919 % 1000 / F.lit(1000.0)).alias("p"),
        F.when(F.col("value") > 50, 1).otherwise(0).alias("y"),
        (F.col("value") - 50).alias("pnl"),
        F.col("event_type").alias("symbol"),
        F.col("value").alias("value"),
        F.col("user_id").alias("user_id"),
    )

