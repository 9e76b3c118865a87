"""Structured Streaming versions of the bar, dedupe, cooldown, episode, decision and repair steps.

Sources are landing folders of JSON or Parquet files (any streaming source with the same columns works).
State is keyed by symbol and scheme and holds a few numbers per key; sinks written from micro-batches are
idempotent: a batch owns a folder named by its id, so a replay overwrites its own output.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quoteloom.functions.timing import DAY, as_timestamp, cell, cell_start
from quoteloom.operators import signals as G
from quoteloom.operators.bars import fetch_pages
from quoteloom.operators.signals import _LONG, _SHORT, _UNINIT, _advance
from quoteloom.sources.tables import append_unique, exists, normalize_events, read_store

c = F.col


def landing(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int = 10) -> DataFrame:
    """Stream of the files arriving in a folder."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(path)


def with_time(df: DataFrame, us: str = "us", delay: str = "1 minute") -> DataFrame:
    return df.withColumn("ts", as_timestamp(us)).withWatermark("ts", delay)


def run_to_end(df: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything available and stop; used by tests and by scheduled catch-up runs."""
    query = (
        df.writeStream.outputMode(mode).format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def run_batches(df: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    query = df.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


# -- events, bars ----------------------------------------------------------------------------------
def stream_events(raw: DataFrame, good: str, rejects: str, checkpoint: str) -> StreamingQuery:
    """Raw envelopes to typed events; rejected rows go to their own table with the reason."""
    def split(batch: DataFrame, batch_id: int) -> None:
        typed = normalize_events(batch).persist()
        typed.filter("reject IS NULL").drop("reject").write.mode("overwrite").parquet(f"{good}/batch={batch_id}")
        typed.filter("reject IS NOT NULL").write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")
        typed.unpersist()

    return run_batches(raw, split, checkpoint)


def stream_dedupe(df: DataFrame, keys, delay: str) -> DataFrame:
    """Drop repeats of a key that arrive within the watermark delay; state expires with it."""
    return with_time(df, delay=delay).dropDuplicatesWithinWatermark(list(keys)).drop("ts")


def stream_bars(ticks: DataFrame, width: str, delay: str) -> DataFrame:
    """Tumbling bars, emitted once the watermark has closed them."""
    at = F.struct("us", "seq")
    return (
        with_time(ticks, delay=delay)
        .groupBy("symbol", F.window("ts", width).alias("w"))
        .agg(
            F.min_by("mid", at).alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.max_by("mid", at).alias("close"),
            F.count(F.lit(1)).alias("ticks"), F.sum("volume").alias("volume"), F.avg("spread").alias("spread"),
        )
    )


def flatten_window(bars: DataFrame) -> DataFrame:
    return bars.withColumn("us", F.unix_micros(c("w.start"))).drop("w")


def stream_rollup(bars: DataFrame, width: str) -> DataFrame:
    """Closed bars to larger bars in the same query, by windows over window times."""
    at = F.col("w.start")
    return bars.groupBy("symbol", F.window(F.window_time("w"), width).alias("w2")).agg(
        F.min_by("open", at).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", at).alias("close"),
        F.sum("ticks").alias("ticks"), F.sum("volume").alias("volume"), (F.sum(c("spread") * c("ticks")) / F.sum("ticks")).alias("spread"),
    ).withColumnRenamed("w2", "w")


# -- stateful signals ------------------------------------------------------------------------------
def _due(frames: Iterator[pd.DataFrame], columns: list[str], held: str, watermark_us: int) -> tuple[list[list], list[list]]:
    """Rows of a key in time order: those the watermark has passed, and those that still wait.

    A key's rows come in chunks without order among them, and rows of one time may come in several batches; nothing is
    folded before the watermark says that nothing earlier can come.
    """
    rows = json.loads(held) if held else []
    for pdf in frames:
        rows += pdf[columns].to_numpy(dtype=object).tolist()
    rows = sorted([int(r[0]), *[v.item() if hasattr(v, "item") else v for v in r[1:]]] for r in rows)
    cut = bisect.bisect_right([r[0] for r in rows], watermark_us)
    return rows[:cut], rows[cut:]


def stream_cooldown(events: DataFrame, pause: int, kind: str = "string", delay: str = "1 minute") -> DataFrame:
    """Greedy cooldown per (symbol, scheme, UTC day), folded in event time as the watermark passes.

    The state of a key is its last kept time and the rows that wait; it goes when its day has passed. Rows later than
    ``delay`` are dropped by the watermark, as in any windowed stream.
    """
    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held = state.get if state.exists else (None, "")
        mark = state.getCurrentWatermarkMs()
        due, wait = _due(frames, ["us"], held, mark * 1000)
        kept = []
        for (us,) in due:
            if last is None or us >= last + pause:
                kept.append(us)
                last = us
        end = (int(key[2]) + 1) * DAY // 1000
        if mark >= end:
            state.remove()
        else:
            state.update((last, json.dumps(wait)))
            state.setTimeoutTimestamp(max(mark, wait[0][0] // 1000 if wait else end) + 1)
        yield pd.DataFrame({"symbol": [key[0]] * len(kept), "us": kept, "scheme": [key[1]] * len(kept)})

    out = f"symbol {kind}, us bigint, scheme string"
    dated = with_time(events, delay=delay).withColumn("_day", cell("us", DAY))
    return dated.groupBy("symbol", "scheme", "_day").applyInPandasWithState(step, out, "last bigint, held string", "append", GroupStateTimeout.EventTimeTimeout)


def stream_episodes(scored: DataFrame, on: int, rearm: int, kind: str = "string", delay: str = "1 minute") -> DataFrame:
    """Episode starts and ends of a scored stream, folded in event time as the watermark passes.

    The state is the machine's code, the open start, its peak and the rows that wait.
    """
    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        code, start, peak, count, held = state.get if state.exists else (_UNINIT, 0, 0, 0, "")
        due, wait = _due(frames, ["us", "score", "direction", "blocked"], held, state.getCurrentWatermarkMs() * 1000)
        out = []
        for us, score, side, blocked in due:
            good = (not blocked) and side != 0 and score >= on
            before, code = code, int(_advance(code, good, side, score < on, score < rearm))
            if code >= _LONG and before < _LONG:
                start, peak, count = us, int(score), 1
            elif code >= _LONG:
                peak, count = max(peak, int(score)), count + 1
            elif before in (_LONG, _SHORT):
                was = 1 if before == _LONG else -1
                why = "BLOCKER" if blocked else "DIRECTION_CHANGE" if side != was else "SCORE_BELOW_ON"
                out.append((key[0], start, was, peak, count, us, why))
        state.update((code, start, peak, count, json.dumps(wait)))
        if wait:
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), wait[0][0] // 1000) + 1)
        yield pd.DataFrame(out, columns=["symbol", "start_us", "direction", "peak_score", "states", "end_us", "end_reason"])

    schema = f"symbol {kind}, start_us bigint, direction int, peak_score bigint, states bigint, end_us bigint, end_reason string"
    return with_time(scored, delay=delay).groupBy("symbol").applyInPandasWithState(
        step, schema, "code int, start bigint, peak bigint, count bigint, held string", "append", GroupStateTimeout.EventTimeTimeout
    )


# -- decisions and repair --------------------------------------------------------------------------
def skip_late(decisions: DataFrame, now_us: str, limit: int) -> DataFrame:
    """A decision evaluated more than ``limit`` after its time is recorded as skipped, never caught up."""
    late = c(now_us) - c("us") > limit
    return decisions.withColumns({"status": F.when(late, "SKIPPED_LATE").otherwise("DECIDED"), "signal": F.when(~late, c("signal"))})


def _before(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """What the batch before this one wrote, or nothing."""
    where = f"{path}/batch={batch_id - 1}"
    return spark.read.parquet(where) if exists(spark, where) else None


def _new(rows: DataFrame, keys: list[str], sink: str, batch_id: int) -> DataFrame:
    """Rows whose keys no other batch has in the sink; only the stretch of time that the batch touches is read."""
    spark = rows.sparkSession
    if not exists(spark, sink):
        return rows
    span = rows.agg(F.min("us").alias("lo"), F.max("us").alias("hi")).first()  # two numbers
    if span.lo is None:
        return rows
    stored = spark.read.parquet(sink).filter((c("batch") != batch_id) & c("us").between(span.lo, span.hi))
    return rows.join(stored.select(*keys).distinct(), keys, "left_anti")


def stream_skip_late(decisions: DataFrame, keys: list[str], now_us: str, limit: int, sink: str, checkpoint: str) -> StreamingQuery:
    """``skip_late`` on a stream; a key that was processed before is a no-op, whether it repeats in a batch or later."""
    def record(batch: DataFrame, batch_id: int) -> None:
        fresh = _new(batch.dropDuplicates(keys), keys, sink, batch_id)
        skip_late(fresh, now_us, limit).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return run_batches(decisions, record, checkpoint)


def stream_decisions(
    features: DataFrame, profiles: DataFrame, bars: DataFrame, first, second, leaders: int, expected: int, sink: str, checkpoint: str, limit: int, patience: int
) -> StreamingQuery:
    """One decision per time, made when its cross-section is complete.

    ``features`` carries ``arrived_us``. A time waits, over batches, until ``expected`` symbols have a feature row and a
    confirmation bar; once the newest arrival is ``patience`` later it is recorded as SKIPPED_DATA_QUALITY, without a
    signal. Times already decided are left alone, so a replay is a no-op.
    """
    waiting = f"{sink}-waiting"

    def decide(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        held = _before(spark, waiting, batch_id)
        rows = batch if held is None else batch.unionByName(held)
        rows = _new(rows.dropDuplicates(["symbol", "us"]), ["us"], sink, batch_id).persist()
        now = rows.agg(F.max("arrived_us")).first()[0]  # one number
        confirmed = rows.join(bars.select("symbol", "us").distinct().withColumn("_bar", F.lit(1)), ["symbol", "us"], "left")
        times = confirmed.groupBy("us").agg(F.count(F.lit(1)).alias("symbols"), F.count("_bar").alias("_bars"), F.max("arrived_us").alias("arrived_us"))
        times = times.withColumn("complete", (c("symbols") >= expected) & (c("_bars") >= expected)).drop("_bars")
        due = times.filter(c("complete") | (F.lit(now) - c("us") > patience)).persist()
        whole = rows.join(due.filter("complete").select("us"), "us", "left_semi")
        ranked = G.rank_cross_section(whole.drop("arrived_us"), first, second)
        one = G.timestamp_decisions(G.entry_gates(ranked, profiles, bars, leaders))
        out = due.join(one, "us", "left").withColumns(
            {
                "latency_us": c("arrived_us") - c("us"),
                "signal": F.when(c("complete"), c("signal")),
                "rejection": F.when(~c("complete"), "SKIPPED_DATA_QUALITY").otherwise(c("rejection")),
            }
        )
        skip_late(out, "arrived_us", limit).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        rows.join(due.select("us"), "us", "left_anti").write.mode("overwrite").parquet(f"{waiting}/batch={batch_id}")
        rows.unpersist()
        due.unpersist()

    return run_batches(features, decide, checkpoint)


def repair_stream(bars: DataFrame, step: int, requests: str, checkpoint: str, page: int = 1000) -> StreamingQuery:
    """Missing grid times of each symbol since its last bar, in this batch or an earlier one, as pages to fetch again.

    The last grid time per symbol is the state, written per batch: a replayed batch starts from the same state.
    """
    state = f"{requests}-last"

    def find(batch: DataFrame, batch_id: int) -> None:
        seen = batch.select("symbol", cell_start("us", step).alias("us")).distinct().persist()
        spans = seen.groupBy("symbol").agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
        last = _before(batch.sparkSession, state, batch_id)
        if last is not None:
            spans = spans.join(last, "symbol", "full_outer").select("symbol", F.coalesce(c("last") + step, "lo").alias("lo"), F.greatest("hi", "last").alias("hi"))
        grid = spans.filter("lo <= hi").select("symbol", F.explode(F.sequence("lo", "hi", F.lit(step))).alias("us"))
        lost = grid.join(seen, ["symbol", "us"], "left_anti")
        fetch_pages(lost, step, page).write.mode("overwrite").parquet(f"{requests}/batch={batch_id}")
        spans.select("symbol", c("hi").alias("last")).write.mode("overwrite").parquet(f"{state}/batch={batch_id}")
        seen.unpersist()

    return run_batches(bars, find, checkpoint)


def apply_repair(requests: DataFrame, source: DataFrame, store: str, step: int) -> DataFrame:
    """Fetch the requested pages from ``source`` into ``store`` (keyed by symbol and us) and inspect every symbol again.

    Returns ``symbol, expected, present, coverage_pct`` between the first and last bar of the store.
    """
    wanted = source.join(requests.select("symbol", "start_us", "end_us").distinct(), "symbol").filter("us >= start_us AND us < end_us")
    append_unique(wanted.select(*source.columns), store, ["symbol", "us"], "us")
    stored = read_store(source.sparkSession, store).select("symbol", cell_start("us", step).alias("us")).distinct()
    found = stored.groupBy("symbol").agg(F.count(F.lit(1)).alias("present"), ((F.max("us") - F.min("us")) / step + 1).cast("long").alias("expected"))
    return found.select("symbol", "expected", "present", (c("present") * 100.0 / c("expected")).alias("coverage_pct"))
