"""Partitioned tables: range reads, idempotent merges, keyed appends, validation and seals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quoteloom.functions.timing import DAY, MINUTE, cell, day_text
from quoteloom.session import durable
from quoteloom.sources.commits import Store, append_new, replace_parts

TICK_IDENTITY = ("symbol", "us", "bid", "ask", "last", "volume", "volume_real", "flags")
CANDLE_INTERVALS = ("1m", "5m", "15m", "1h")


# -- reads ---------------------------------------------------------------------------------------
def read_ticks(spark: SparkSession, root: str, symbol: str, start_us: int, end_us: int) -> DataFrame:
    """Half-open range read; the ``date`` predicate prunes partitions, ``us`` reaches the row groups."""
    first, last = day_literal(start_us), day_literal(end_us - 1)
    rows = spark.read.parquet(root).filter(
        (F.col("symbol") == symbol) & (F.col("date") >= first) & (F.col("date") <= last)
    )
    if rows.select("date").limit(1).isEmpty():
        raise ValueError("no partition covers the requested range")
    return rows.filter((F.col("us") >= start_us) & (F.col("us") < end_us))


def day_literal(us: int) -> Column:
    return F.to_date(F.timestamp_micros(F.lit(us)))


def read_quotes(df: DataFrame, start_us: int, end_us: int, point: float) -> DataFrame:
    """Three-column quote scan; the spread in points is derived where the table has none."""
    rows = df.filter((F.col("us") >= start_us) & (F.col("us") < end_us))
    if "spread_points" not in rows.columns:
        rows = rows.withColumn("spread_points", (F.col("ask") - F.col("bid")) / point)
    return rows.select("symbol", "us", "seq", "bid", "ask", "spread_points")


def read_bars(df: DataFrame, as_of: int, lookback: int) -> DataFrame:
    """Bars opened in ``[as_of - lookback, as_of]``; a missing completion flag reads as false."""
    rows = df.filter((F.col("us") >= as_of - lookback) & (F.col("us") <= as_of))
    flag = F.col("complete") if "complete" in df.columns else F.lit(None).cast("boolean")
    return rows.withColumn("complete", F.coalesce(flag, F.lit(False)))


def read_candles(df: DataFrame, symbols: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Closed candles of the listed symbols, prices as double, the latest part wins per (symbol, time)."""
    rows = df.filter((F.col("us") >= start_us) & (F.col("us") < end_us) & F.col("closed"))
    rows = rows.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
    for name, kind in rows.dtypes:
        if kind.startswith("decimal"):
            rows = rows.withColumn(name, F.col(name).cast("double"))
    return last_wins(rows, ["symbol", "us"], "part")


def last_wins(df: DataFrame, keys, version: str) -> DataFrame:
    """Keep the row with the highest ``version`` per key; combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def first_wins(df: DataFrame, keys, order: Column) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def union_archive_live(archive: DataFrame, live: DataFrame, keys=("symbol", "us")) -> DataFrame:
    """Historical and live candles; the live copy wins."""
    both = archive.withColumn("_origin", F.lit(0)).unionByName(
        live.withColumn("_origin", F.lit(1)), allowMissingColumns=True
    )
    return last_wins(both, list(keys), "_origin").drop("_origin")


# -- writes --------------------------------------------------------------------------------------
def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def overwrite_days(df: DataFrame, path: str, partitions=("date",)) -> None:
    """Replace exactly the touched partitions. Rows are range partitioned by (partition, symbol, time):
    few files per day, a hot day or symbol is still split over several tasks, and the sorted files let
    row-group statistics prune by symbol without a directory per symbol."""
    spread = df.repartitionByRange(*[F.col(p) for p in partitions], F.col("symbol"), F.col("us"))
    writer = spread.sortWithinPartitions(*partitions, "symbol", "us").write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(
        *partitions
    ).parquet(path)


def merge_ticks(df: DataFrame, path: str, identity=TICK_IDENTITY) -> None:
    """Idempotent merge into day partitions: equal ticks are stored once, the stored copy wins.

    Distinct ticks of the same millisecond are kept. Only days present in ``df`` are read and rewritten.
    """
    spark = df.sparkSession
    rows = df.withColumn("date", F.to_date(F.timestamp_micros("us"))).withColumn("_new", F.lit(1))
    if exists(spark, path):
        touched = rows.select("date").distinct()  # calendar days only; prunes partitions at run time
        stored = spark.read.parquet(path).join(touched, "date", "left_semi")
        rows = stored.withColumn("_new", F.lit(0)).unionByName(rows, allowMissingColumns=True)
    keys = [c for c in identity if c in rows.columns]
    order = F.struct("_new", "seq") if "seq" in rows.columns else F.struct("_new")
    merged = first_wins(rows, keys, order).drop("_new")
    overwrite_days(merged, path)


def write_bars(df: DataFrame, path: str, replace: bool = True, period: str = "day") -> None:
    """Store bars by frame and open day (or month, year); merge keeps the new copy of an existing bar. One commit: readers see all of it or nothing."""
    rows = df.withColumn("date", F.to_date(F.date_trunc(period, F.timestamp_micros("us"))))

    def merge(stored: DataFrame, new: DataFrame) -> DataFrame:
        both = stored.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
        return last_wins(both, ["frame", "symbol", "us"], "_v").drop("_v").select(*new.columns)

    replace_parts(rows, path, ["symbol", "us"], ["frame", "date"], None if replace else merge)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """A committed table as of now."""
    found = Store(spark, path).read()
    if found is None:
        raise ValueError(f"nothing was committed to {path}")
    return found


def append_unique(df: DataFrame, path: str, keys, order: str) -> dict[str, int]:
    """First row per key of the batch, minus the keys already stored, appended; says how many were written and repeated, and
    how many stored files had to be opened. Only files whose key range and Bloom filter admit a key of the batch are."""
    came = Observation()
    fresh = first_wins(df.observe(came, F.count(F.lit(1)).alias("n")), list(keys), F.col(order))
    done = append_new(fresh.select(*df.columns), path, list(keys))
    return {"written": done["written"], "duplicates": came.get["n"] - done["written"], "opened": done["opened"]}


# -- raw payloads --------------------------------------------------------------------------------
PRICE = "decimal(38,18)"


def normalize_events(raw: DataFrame, payload: str = "payload", received: str = "us") -> DataFrame:
    """Raw JSON messages to one typed row each, by kind: candle, trade, book, or a reject with its reason.

    Keys differ only in case (``b``/``B``); a message is parsed once to a variant, whose keys are case sensitive.
    """
    raw = raw.withColumn("_v", F.try_parse_json(F.col(payload)))

    def text(path: str) -> Column:
        return F.try_variant_get("_v", f"$.{path}", "string")

    def price(path: str) -> Column:
        return text(path).try_cast(PRICE)

    kind = (
        F.when(text("e") == "aggTrade", "trade")
        .when(text("e") == "kline", "candle")
        .when(text("u").isNotNull() & text("b").isNotNull() & text("a").isNotNull() & text("s").isNotNull(), "book")
    )
    typed = raw.withColumn("kind", kind).withColumns(
        {
            "symbol": text("s"),
            "event_us": F.when(F.col("kind") == "trade", text("T").try_cast("long") * 1000)
            .when(F.col("kind") == "candle", text("k.t").try_cast("long") * 1000)
            .otherwise(F.col(received)),
            "bid": F.when(F.col("kind") == "book", price("b")),
            "ask": F.when(F.col("kind") == "book", price("a")),
            "price": F.when(F.col("kind") == "trade", price("p")),
            "quantity": F.when(F.col("kind") == "trade", price("q")),
            "taker_side": F.when(
                F.col("kind") == "trade", F.when(text("m") == "true", "SELL").otherwise("BUY")
            ),
            "interval": text("k.i"),
            "open": price("k.o"),
            "high": price("k.h"),
            "low": price("k.l"),
            "close": price("k.c"),
            "base_volume": price("k.v"),
            "closed": text("k.x") == "true",
        }
    )
    reject = (
        F.when(F.col("kind").isNull(), "UNSUPPORTED_EVENT")
        .when((F.col("kind") == "book") & (F.col("bid").isNull() | F.col("ask").isNull()), "BAD_NUMBER")
        .when((F.col("kind") == "book") & (F.col("ask") < F.col("bid")), "CROSSED_BOOK")
        .when((F.col("kind") == "trade") & (F.col("price").isNull() | F.col("quantity").isNull()), "BAD_NUMBER")
        .when((F.col("kind") == "candle") & ~F.col("interval").isin(*CANDLE_INTERVALS), "BAD_INTERVAL")
        .when((F.col("kind") == "candle") & (F.col("open").isNull() | F.col("close").isNull()), "BAD_NUMBER")
    )
    return typed.withColumn("reject", reject).drop("_v")


def archive_raw(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Raw payload with a content key, for keyed appends."""
    return raw.withColumn("payload_key", F.sha2(F.col(payload), 256))


def flatten_rest_candles(raw: DataFrame, now_us: int, field: str = "row") -> DataFrame:
    """Positional candle arrays to typed columns; closed means the close time has passed."""
    names = ("open", "high", "low", "close", "volume")

    def at(i: int) -> Column:
        return F.element_at(F.col(field), i + 1)

    keep = [c for c in raw.columns if c != field]
    return raw.select(
        *keep,
        (at(0).cast("long") * 1000).alias("us"),
        *[at(i + 1).cast(PRICE).alias(n) for i, n in enumerate(names)],
        (at(6).cast("long") * 1000).alias("close_us"),
        at(7).cast(PRICE).alias("quote_volume"),
        at(8).cast("long").alias("trades"),
        at(9).cast(PRICE).alias("taker_base"),
        at(10).cast(PRICE).alias("taker_quote"),
        (at(6).cast("long") * 1000 < now_us).alias("closed"),
    )


# -- ingest control ------------------------------------------------------------------------------
def day_chunks(spark: SparkSession, start_us: int, end_us: int) -> DataFrame:
    """Calendar-day chunks of ``[start, end)``; the first and last may be partial."""
    days = spark.range(start_us // DAY, (end_us - 1) // DAY + 1).select((F.col("id") * DAY).alias("d"))
    return days.select(
        F.greatest("d", F.lit(start_us)).alias("start_us"),
        F.least(F.col("d") + DAY, F.lit(end_us)).alias("end_us"),
    )


def ingest_days(chunks: DataFrame, manifest: DataFrame, landing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the chunks without a valid completion record, and the status of every chunk.

    ``manifest(start_us, end_us, accepted)`` is the table of completed chunks; it is written after the
    data commit, so a crash only repeats work.
    """
    done = manifest.select("start_us", "end_us", F.col("accepted").alias("_accepted"))
    plan = chunks.join(done, ["start_us", "end_us"], "left").withColumn(
        "status", F.when(F.col("_accepted").isNotNull(), "RESUMED").otherwise("LOADED")
    )
    todo = plan.filter("status = 'LOADED'").select("start_us", "end_us")
    keyed = landing.withColumn("_day", cell("us", DAY))
    rows = keyed.join(todo.withColumn("_day", cell("start_us", DAY)), "_day").filter(
        (F.col("us") >= F.col("start_us")) & (F.col("us") < F.col("end_us"))
    )
    counts = rows.groupBy("start_us", "end_us").agg(F.count(F.lit(1)).alias("_loaded"))
    status = plan.join(counts, ["start_us", "end_us"], "left").select(
        "start_us",
        "end_us",
        "status",
        F.coalesce("_accepted", "_loaded", F.lit(0)).cast("long").alias("accepted"),
    )
    return rows.drop("_day", "start_us", "end_us"), status


def load_days(chunks: DataFrame, landing: DataFrame, path: str, keys=("symbol", "us", "seq")) -> DataFrame:
    """Load the chunks that are not complete, and return the status of every chunk.

    The completion records stand in the same commit as the rows, so a chunk is complete exactly if its rows are there: a run that
    breaks before its commit is repeated whole, one that breaks after it changes nothing.
    """
    spark = chunks.sparkSession
    store = Store(spark, path)
    while True:
        version, log = store._next(), store.log()
        records = [tuple(r) for line in log for r in line.get("note", {}).get("chunks", [])]  # days
        manifest = spark.createDataFrame(records, "start_us long, end_us long, accepted long")
        rows, status = ingest_days(chunks, manifest, landing)
        status = durable(status)
        loaded = status.filter("status = 'LOADED'").select("start_us", "end_us", "accepted").collect()  # days
        if not loaded:
            return status
        line = store.stage(rows, list(keys))
        if store.commit(version, {**line, "note": {"chunks": [list(r) for r in loaded]}}):
            return status


def tick_status(start_us: int, end_us: int) -> Column:
    """invalid, out_of_range or candidate."""
    good = (
        F.col("bid").isNotNull()
        & F.col("ask").isNotNull()
        & ~F.isnan("bid")
        & ~F.isnan("ask")
        & (F.col("bid") > 0)
        & (F.col("ask") < F.lit(float("inf")))
        & (F.col("ask") >= F.col("bid"))
    )
    inside = (F.col("us") >= start_us) & (F.col("us") < end_us)
    return F.when(~good, "invalid").when(~inside, "out_of_range").otherwise("candidate")


def validate_ticks(df: DataFrame, start_us: int, end_us: int, identity) -> DataFrame:
    """Classify every tick: invalid, out_of_range, duplicate (not the first of its identity), accepted."""
    marked = df.withColumn("status", tick_status(start_us, end_us))
    candidate = F.col("status") == "candidate"
    counted = marked.groupBy(*identity, "status").agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy().agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("source_rows"),
        F.coalesce(F.sum(F.when(candidate, 1)), F.lit(0)).alias("accepted"),
        F.coalesce(F.sum(F.when(candidate, F.col("_n") - 1)), F.lit(0)).alias("duplicate"),
        F.coalesce(F.sum(F.when(F.col("status") == "invalid", F.col("_n"))), F.lit(0)).alias("invalid"),
        F.coalesce(F.sum(F.when(F.col("status") == "out_of_range", F.col("_n"))), F.lit(0)).alias("out_of_range"),
    )


def to_canonical_utc(df: DataFrame, wall: str, zone: str, out: str = "utc") -> DataFrame:
    """Server wall time to UTC. A wall time that a clock change skips or repeats gives null and a reason.

    ``wall`` is a timestamp holding wall-clock digits in a UTC session.
    """
    w = F.col(wall)
    utc = F.to_utc_timestamp(w, zone)

    def back(ts: Column) -> Column:
        return F.from_utc_timestamp(ts, zone)

    hour = F.expr("INTERVAL 1 HOUR")
    valid = back(utc) == w
    doubled = (back(utc - hour) == w) | (back(utc + hour) == w)
    reason = F.when(~valid, "NONEXISTENT").when(doubled, "AMBIGUOUS")
    return df.withColumn("dst_reject", reason).withColumn(out, F.when(F.col("dst_reject").isNull(), utc))


def dataset_seal(df: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Count and range of a sealed dataset; the status tells whether it stays inside its declaration."""
    span_days = (end_us - start_us + DAY - 1) // DAY
    one = df.agg(
        F.count(F.lit(1)).alias("ticks"),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
        F.count_distinct(cell("us", DAY)).alias("active_days"),
    )
    outside = (F.col("first_us") < start_us) | (F.col("last_us") >= end_us)
    return one.withColumns(
        {
            "empty_days": F.lit(span_days) - F.col("active_days"),
            "status": F.when(F.col("ticks") == 0, "NO_DATA").when(outside, "OUT_OF_RANGE").otherwise("VALID"),
        }
    )


def candle_quality(df: DataFrame, books: DataFrame | None = None, zone: str = "UTC") -> DataFrame:
    """Dataset-level invariants of candles, and with ``books`` of quotes; times are microseconds of the session's zone, which should be ``zone``."""
    envelope = (F.col("high") >= F.greatest("open", "close")) & (F.col("low") <= F.least("open", "close"))
    out = df.agg(
        F.bool_and(envelope).alias("ohlc_ok"),
        F.bool_and(F.pmod(F.col("us"), F.lit(MINUTE)) == 0).alias("minute_aligned"),
        F.bool_and(F.col("open").isNotNull() & F.col("close").isNotNull()).alias("no_nulls"),
        F.count(F.lit(1)).alias("candles"),
    ).withColumn("times_utc", F.current_timezone() == zone)
    if books is None:
        return out
    return out.join(F.broadcast(books.agg(F.bool_and(F.col("ask") >= F.col("bid")).alias("book_ask_gte_bid"))))  # one row each


def day_of(us: str = "us") -> Column:
    return day_text(us)
