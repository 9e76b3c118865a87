"""Stateful streams over several micro-batches: many rows per key, disorder, late rows, split and missing data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quoteloom.operators import signals as G
from quoteloom.streaming import jobs as J

SECOND = 1_000_000
START = 1_700_000_000 * SECOND


def stream_of(spark, path, frames, schema):
    """One file per micro-batch, each younger than the one before."""
    for pdf in frames:
        spark.createDataFrame(pdf, schema).coalesce(1).write.mode("append").parquet(path)
    return J.landing(spark, path, spark.createDataFrame([], schema).schema, files_per_trigger=1)


def disordered(rows: pd.DataFrame, batches: int, delay: int, seed: int) -> list[pd.DataFrame]:
    """Rows arrive up to ``delay`` after their time, so neighbours land in different batches and orders."""
    rng = np.random.default_rng(seed)
    rows = rows.assign(_at=rows["us"] + rng.integers(0, delay, len(rows)))
    rows = rows.sort_values("_at").drop(columns="_at")
    return [rows.iloc[part].sample(frac=1.0, random_state=seed) for part in np.array_split(np.arange(len(rows)), batches)]



@pytest.mark.parametrize("seed", [1, 2])
def test_cooldown_keeps_what_the_batch_operator_keeps(spark, tmp_path, seed):
    """26,000 rows of one key in five batches: more than one Arrow chunk each."""
    us = START + np.arange(26_000, dtype=np.int64) * SECOND
    rows = pd.DataFrame({"symbol": "A", "us": us, "scheme": "X"})
    rows = pd.concat([rows, rows.iloc[::7].assign(symbol="B")])
    schema = "symbol string, us bigint, scheme string"
    stream = stream_of(spark, f"{tmp_path}/in", disordered(rows, 5, 600 * SECOND, seed), schema)
    J.run_to_end(J.stream_cooldown(stream, 3 * SECOND, delay="20 minutes"), f"{tmp_path}/out", f"{tmp_path}/cp")
    mark = (int(us[-1]) // 1000 - 1_200_000) * 1000
    got = {(r.symbol, r.us) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.symbol, r.us) for r in G.cooldown(spark.createDataFrame(rows, schema), 3 * SECOND).collect() if r.us <= mark}
    assert got == want and len(want) > 8_000


def test_episodes_do_not_depend_on_arrival(spark, tmp_path):
    rng = np.random.default_rng(4)
    us = START + np.arange(12_000, dtype=np.int64) * SECOND
    walk = np.clip(80 + np.cumsum(rng.integers(-3, 4, len(us))) % 25, 60, 100)
    rows = pd.DataFrame({"symbol": "A", "us": us, "score": walk.astype(np.int64), "direction": np.where(us // (SECOND * 500) % 2, 1, -1), "blocked": rng.random(len(us)) < 0.02})
    schema = "symbol string, us bigint, score bigint, direction int, blocked boolean"
    found = []
    for name, frames in (("a", [rows]), ("b", disordered(rows, 4, 300 * SECOND, 9))):
        stream = stream_of(spark, f"{tmp_path}/{name}", frames, schema)
        J.run_to_end(J.stream_episodes(stream, 90, 85, delay="10 minutes"), f"{tmp_path}/out-{name}", f"{tmp_path}/cp-{name}")
        found.append(sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out-{name}").collect())))
    assert found[0] == found[1] and len(found[0]) > 10


def test_a_repeated_time_is_decided_once(spark, tmp_path):
    rows = pd.DataFrame({"us": [10, 20, 20, 30], "now": [11, 25, 99, 95], "signal": ["a", "b", "c", "d"]})
    stream = stream_of(spark, f"{tmp_path}/in", [rows.iloc[:2], rows.iloc[2:], rows.iloc[:2]], "us bigint, now bigint, signal string")
    J.stream_skip_late(stream, ["us"], "now", 60, f"{tmp_path}/out", f"{tmp_path}/cp")
    got = sorted((r.us, r.status, r.signal) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(10, "DECIDED", "a"), (20, "DECIDED", "b"), (30, "SKIPPED_LATE", None)]


def test_decisions_wait_for_a_complete_cross_section(spark, tmp_path):
    """The first time comes in two batches, the second never completes, the third lacks a confirmation bar."""
    names = ["return_1h", "return_4h", "return_24h", "volume_relative", "trend_efficiency", "expected_move_pct"]
    hour = 3600 * SECOND

    def rows(t, symbols, after=1):
        return pd.DataFrame({"symbol": symbols, "us": START + t * hour, **{n: [0.01 * s for s in symbols] for n in names}, "arrived_us": START + t * hour + after})

    schema = "symbol bigint, us bigint, " + ", ".join(f"{n} double" for n in names) + ", arrived_us bigint"
    frames = [rows(0, [1, 2]), pd.concat([rows(0, [3, 4, 5]), rows(1, [1, 2, 3, 4])]), rows(2, [1, 2, 3, 4, 5]), rows(9, [1])]
    stream = stream_of(spark, f"{tmp_path}/in", frames, schema)
    profiles = spark.createDataFrame([(s, True, 1.0) for s in range(1, 6)], "symbol bigint, liquidity_sufficient boolean, max_ratio double")
    bars = [(s, START + t * hour, 1.0, 1.0, 1.0, 2.0, 1.0, 1) for t in range(10) for s in range(1, 6) if (t, s) != (2, 3)]
    bars = spark.createDataFrame(bars, "symbol bigint, us bigint, open double, high double, low double, close double, volume double, trades bigint")
    J.stream_decisions(stream, profiles, bars, 1, 2, 3, 5, f"{tmp_path}/out", f"{tmp_path}/cp", 20 * hour, 3 * hour)
    got = {(r.us - START) // hour: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert sorted(got) == [0, 1, 2]
    assert got[0].complete and got[0].symbols == 5 and got[0].regime is not None
    for t in (1, 2):
        assert not got[t].complete and got[t].rejection == "SKIPPED_DATA_QUALITY" and got[t].signal is None


def test_gaps_between_batches_are_found_and_repaired(spark, tmp_path):
    minute = 60 * SECOND
    start = START // minute * minute
    times = {"A": [0, 1, 2, 5, 6, 9], "B": [3, 4, 8]}
    rows = pd.DataFrame([(s, start + t * minute) for s, ts in times.items() for t in ts], columns=["symbol", "us"])
    frames = [rows[rows.us < start + 3 * minute], rows[(rows.us >= start + 3 * minute) & (rows.us < start + 7 * minute)], rows[rows.us >= start + 7 * minute]]
    schema = "symbol string, us bigint"
    stream = stream_of(spark, f"{tmp_path}/in", frames, schema)
    J.repair_stream(stream, minute, f"{tmp_path}/pages", f"{tmp_path}/cp", 2)
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/store")
    source = spark.createDataFrame([(s, start + t * minute) for s in "AB" for t in range(12)], schema)
    pages = spark.read.parquet(f"{tmp_path}/pages")
    assert pages.filter(F.col("end_us") - F.col("start_us") > 2 * minute).count() == 0
    after = {r.symbol: (r.expected, r.present, r.coverage_pct) for r in J.apply_repair(pages, source, f"{tmp_path}/store", minute).collect()}
    assert after == {"A": (10, 10, 100.0), "B": (6, 6, 100.0)}
