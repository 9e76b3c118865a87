"""The commit log: whole batches or nothing, few opened files, writers that overtake each other."""

import pytest
from pyspark.sql import functions as F

from quoteloom.functions.timing import DAY
from quoteloom.sources import tables as S
from quoteloom.sources.commits import Store, append_new


class Broken(Exception):
    pass


def fail():
    raise Broken


def rows_of(spark, first, last, step=1):
    return spark.range(first, last, step).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))


def test_a_run_broken_before_its_commit_is_repeated_whole(spark, tmp_path):
    path = str(tmp_path / "store")
    append_new(rows_of(spark, 0, 50), path, ["k"])
    with pytest.raises(Broken):
        append_new(rows_of(spark, 30, 90), path, ["k"], before_commit=fail)
    assert S.read_store(spark, path).count() == 50  # the data files are there, no reader looks at them
    assert append_new(rows_of(spark, 30, 90), path, ["k"])["written"] == 40
    assert sorted(r.k for r in S.read_store(spark, path).collect()) == list(range(90))
    assert S.append_unique(rows_of(spark, 0, 90), path, ["k"], "v") | {"opened": 0} == {"written": 0, "duplicates": 90, "opened": 0}


def test_a_narrow_batch_opens_few_of_many_files(spark, tmp_path):
    path = str(tmp_path / "store")
    store = Store(spark, path)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        append_new(rows_of(spark, 0, 20_000, 2), path, ["k"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(store.files()) >= 190
    near = append_new(rows_of(spark, 5_000, 5_100), path, ["k"])
    assert near["written"] == 50 and near["opened"] < 10
    ends = rows_of(spark, 0, 1).unionByName(rows_of(spark, 19_999, 20_000))  # a range that covers all, two keys
    far = append_new(ends, path, ["k"])
    assert far["written"] == 1 and far["opened"] < 30
    assert S.read_store(spark, path).count() == 10_051 == S.read_store(spark, path).select("k").distinct().count()


def test_a_writer_that_is_overtaken_looks_again(spark, tmp_path):
    path = str(tmp_path / "store")
    append_new(rows_of(spark, 0, 10), path, ["k"])
    calls = []

    def overtake():
        if not calls:
            calls.append(1)
            append_new(rows_of(spark, 15, 25), path, ["k"])

    assert append_new(rows_of(spark, 5, 20), path, ["k"], before_commit=overtake)["written"] == 5
    assert sorted(r.k for r in S.read_store(spark, path).collect()) == list(range(25))


def test_an_unfinished_log_line_does_not_count(spark, tmp_path):
    path = str(tmp_path / "store")
    append_new(rows_of(spark, 0, 10), path, ["k"])
    (tmp_path / "store" / "_log" / f"{1:020d}.json").write_text('{"batch": "abc')
    assert S.read_store(spark, path).count() == 10
    append_new(rows_of(spark, 5, 15), path, ["k"])
    assert S.read_store(spark, path).count() == 15


def test_nulls_and_empty_batches(spark, tmp_path):
    path = str(tmp_path / "store")
    schema = "k bigint, t string, v int"
    assert S.append_unique(spark.createDataFrame([], schema), path, ["k", "t"], "v")["written"] == 0
    assert S.read_store(spark, path).count() == 0
    S.append_unique(spark.createDataFrame([(1, None, 1), (1, "a", 2), (1, "a", 1)], schema), path, ["k", "t"], "v")
    assert S.append_unique(spark.createDataFrame([(1, "a", 9), (2, "a", 9)], schema), path, ["k", "t"], "v")["written"] == 1
    assert sorted((r.k, r.t or "", r.v) for r in S.read_store(spark, path).collect()) == [(1, "", 1), (1, "a", 1), (2, "a", 9)]


def test_bars_are_replaced_by_partition(spark, tmp_path):
    path = str(tmp_path / "bars")
    schema = "frame string, symbol string, us bigint, close double"
    S.write_bars(spark.createDataFrame([("M1", "A", 0, 1.0), ("M1", "A", DAY, 2.0), ("M5", "A", 0, 3.0)], schema), path)
    S.write_bars(spark.createDataFrame([("M1", "A", 5, 9.0)], schema), path)  # the day of this frame anew
    S.write_bars(spark.createDataFrame([("M1", "A", DAY, 7.0), ("M1", "B", DAY, 8.0)], schema), path, replace=False)
    got = sorted((r.frame, r.symbol, r.us, r.close) for r in S.read_store(spark, path).collect())
    assert got == [("M1", "A", 5, 9.0), ("M1", "A", DAY, 7.0), ("M1", "B", DAY, 8.0), ("M5", "A", 0, 3.0)]


def test_chunks_are_complete_with_their_rows(spark, tmp_path):
    path = str(tmp_path / "days")
    landing = spark.range(30).select(F.lit("A").alias("symbol"), (F.col("id") * (DAY // 10)).alias("us"), F.col("id").alias("seq"))
    chunks = S.day_chunks(spark, 0, 4 * DAY)
    first = S.load_days(S.day_chunks(spark, 0, DAY), landing, path)
    assert [(r.status, r.accepted) for r in first.collect()] == [("LOADED", 10)]
    got = sorted((r.start_us // DAY, r.status, r.accepted) for r in S.load_days(chunks, landing, path).collect())
    assert got == [(0, "RESUMED", 10), (1, "LOADED", 10), (2, "LOADED", 10), (3, "LOADED", 0)]
    again = S.load_days(chunks, landing, path).collect()
    assert {r.status for r in again} == {"RESUMED"} and S.read_store(spark, path).count() == 30
