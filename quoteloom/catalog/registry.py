"""Registry of queries: a name, a Spark callable and, where SQL can say it, a DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


QUOTES = """quotes AS (
  SELECT seq, symbol, us, bid, ask, volume, (bid + ask) / 2 AS mid, ask - bid AS spread FROM (
    SELECT event_id AS seq, event_type AS symbol, epoch_us(ts) AS us,
           100 + value / 10 - (event_id % 5 + 1) * 0.01 AS bid,
           100 + value / 10 + (event_id % 5 + 1) * 0.01 AS ask,
           CAST(user_id AS DOUBLE) AS volume
    FROM events) q0)"""

CANDLES = """candles AS (
  SELECT symbol, epoch_us(CAST(wk AS TIMESTAMP)) AS us, max(CASE WHEN f = 1 THEN px END) AS open,
         max(px) AS high, min(px) AS low, max(CASE WHEN g = 1 THEN px END) AS close,
         sum(q) AS volume, count(*) AS trades
  FROM (
    SELECT l_suppkey AS symbol, date_trunc('week', l_shipdate) AS wk, l_extendedprice / l_quantity AS px,
           l_quantity AS q,
           row_number() OVER (PARTITION BY l_suppkey, date_trunc('week', l_shipdate)
             ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS f,
           row_number() OVER (PARTITION BY l_suppkey, date_trunc('week', l_shipdate)
             ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC,
                      l_extendedprice DESC) AS g
    FROM lineitem) c0
  GROUP BY symbol, wk)"""

LEDGER = """ledger AS (
  SELECT l_suppkey AS symbol, l_returnflag AS setup, epoch_us(l_shipdate) AS us,
         l_extendedprice * (l_discount - 0.05) AS market_pnl, l_extendedprice * 0.0005 AS spread_cost,
         l_extendedprice * 0.0002 AS slippage_cost, l_extendedprice * l_tax * 0.01 AS commission,
         l_extendedprice * (l_discount - 0.05) - l_extendedprice * 0.0002
           - l_extendedprice * l_tax * 0.01 AS net,
         row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey,
           l_extendedprice) AS n,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
  FROM lineitem)"""

BOOKS = """book_levels AS (
  SELECT l_orderkey AS snapshot, CASE WHEN l_linenumber % 2 = 0 THEN 'ask' ELSE 'bid' END AS side,
         l_extendedprice / l_quantity AS price, l_quantity AS qty, l_linenumber, l_partkey, l_suppkey,
         epoch_us(l_shipdate) AS us
  FROM lineitem)"""

PREDICTIONS = """predictions AS (
  SELECT event_id, epoch_us(ts) AS us, CAST(ts AS DATE) AS day, user_id % 4 + 1 AS fold,
         CASE WHEN event_id % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS side,
         CAST((event_id * 7919 % 1000) / 1000.0 AS DOUBLE) AS p,
         CASE WHEN value > 50 THEN 1 ELSE 0 END AS y, value - 50 AS pnl,
         event_type AS symbol, value, user_id
  FROM events)"""


def with_views(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
