"""Scan and join helpers against brute force, with one symbol holding most rows and borders everywhere."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quoteloom.operators.scans import balanced_tile
from quoteloom.operators import features as X
from quoteloom.operators import joins as J
from quoteloom.operators import ranks as R
from quoteloom.operators import scans as S


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    n = 500
    symbol = np.where(rng.random(n) < 0.7, "A", np.where(rng.random(n) < 0.5, "B", "C"))
    us = np.sort(rng.integers(0, 4000, n))
    return pd.DataFrame({"symbol": symbol, "us": us, "seq": np.arange(n), "x": np.round(rng.normal(size=n), 3), "bid": np.round(100 + rng.normal(size=n).cumsum() / 10, 3)})


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows).repartition(5)


@pytest.mark.parametrize("width", [37, 500, 10_000])
def test_prefix_scan_does_not_depend_on_tiles(rows, df, width):
    spec = {"s": ("sum", F.col("x")), "m": ("max", F.col("x")), "n": ("count", F.lit(1)), "l": ("last", F.when(F.col("x") > 1, F.col("x")))}
    got = S.prefix_scan(S.with_tile(df, width=width), ["symbol"], ["us", "seq"], spec).toPandas().sort_values("seq")
    g = rows.groupby("symbol")["x"]
    assert np.allclose(got["s"], g.cumsum())
    assert np.allclose(got["m"], g.cummax())
    assert (got["n"].to_numpy() == g.cumcount().to_numpy() + 1).all()
    want = rows["x"].where(rows["x"] > 1).groupby(rows["symbol"]).ffill()
    assert np.allclose(got["l"].to_numpy(dtype=float), want.to_numpy(), equal_nan=True)


@pytest.mark.parametrize("exclude", [False, True])
@pytest.mark.parametrize("span", [11, 300])
def test_trailing_extreme(rows, df, span, exclude):
    got = S.trailing_extreme(df, ["symbol"], span, {"hi": ("max", "x"), "lo": ("min", "x")}, exclude_current=exclude).toPandas().set_index("seq")
    for r in rows.itertuples():
        w = rows[(rows.symbol == r.symbol) & (rows.us >= r.us - span) & ((rows.seq < r.seq) if exclude else (rows.seq <= r.seq))]
        hi = w.x.max() if len(w) else None
        assert (pd.isna(got.loc[r.seq, "hi"]) and hi is None) or got.loc[r.seq, "hi"] == hi
        if len(w):
            assert got.loc[r.seq, "lo"] == w.x.min()


@pytest.mark.parametrize("inclusive", [True, False])
def test_forward_extreme(rows, df, inclusive):
    span = 120
    got = S.forward_extreme(df, df, ["symbol"], span, {"hi": ("max", "x")}, inclusive_end=inclusive).toPandas().set_index("seq")
    for r in rows.itertuples():
        end = (rows.us <= r.us + span) if inclusive else (rows.us < r.us + span)
        w = rows[(rows.symbol == r.symbol) & (rows.us > r.us) & end]
        assert (pd.isna(got.loc[r.seq, "hi"]) and not len(w)) or got.loc[r.seq, "hi"] == w.x.max()


def test_trailing_sums(rows, df):
    got = S.trailing_sums(df, ["symbol"], {"a": (F.col("x"), 50), "b": (F.lit(1), 400)}, width=900).toPandas().set_index("seq")
    for r in rows.itertuples():
        past = rows[(rows.symbol == r.symbol) & (rows.seq <= r.seq)]
        assert abs(got.loc[r.seq, "a"] - past[past.us >= r.us - 50].x.sum()) < 1e-9
        assert got.loc[r.seq, "b"] == len(past[past.us >= r.us - 400])


def test_asof_both_ways(rows, df):
    right = df.filter("seq % 3 = 0")
    back = J.asof_backward(df, right, ["symbol"], {"r": "seq"}, right_order=["seq"], width=64).toPandas().set_index("seq")
    ahead = J.asof_forward(df, right, ["symbol"], {"r": "seq"}, 40, right_order=["seq"], width=64).toPandas().set_index("seq")
    base = rows[rows.seq % 3 == 0]
    for r in rows.itertuples():
        p = base[(base.symbol == r.symbol) & (base.us <= r.us)]
        f = base[(base.symbol == r.symbol) & (base.us >= r.us) & (base.us <= r.us + 40)]
        assert (pd.isna(back.loc[r.seq, "r"]) and p.empty) or back.loc[r.seq, "r"] == p.seq.iloc[-1]
        assert (pd.isna(ahead.loc[r.seq, "r"]) and f.empty) or ahead.loc[r.seq, "r"] == f.seq.iloc[0]


def test_ordered_index_with_a_hot_value(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": "A", "x": np.where(rng.random(900) < 0.5, 1.0, rng.normal(size=900).round(1)), "t": rng.permutation(900)})
    got = R.ordered_index(spark.createDataFrame(pdf), ["k"], "x", "t").toPandas().sort_values("rn")
    want = pdf.sort_values(["x", "t"])
    assert (got["t"].to_numpy() == want["t"].to_numpy()).all()
    assert (got["rn"].to_numpy() == np.arange(1, 901)).all()


def test_exact_quantiles(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"k": np.where(np.arange(400) % 4 == 0, "B", "A"), "x": rng.normal(size=400).round(2)})
    got = R.exact_quantiles(spark.createDataFrame(pdf), ["k"], "x", {"m": 0.5, "p": 0.95}).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        assert abs(got.loc[k, "m"] - np.quantile(g.x, 0.5)) < 1e-9
        assert abs(got.loc[k, "p"] - np.quantile(g.x, 0.95)) < 1e-9


def test_balanced_tiles_and_width(rows, df):
    tiled = S.balanced_tile(df, ["symbol"])
    got = S.prefix_scan(tiled, ["symbol"], ["us", "seq"], {"s": ("sum", F.col("x"))}).toPandas().sort_values("seq")
    assert np.allclose(got["s"], rows.groupby("symbol")["x"].cumsum())
    sizes = tiled.groupBy("symbol", "_tile").count().toPandas()
    assert sizes[sizes.symbol == "A"]["count"].max() < 0.3 * (rows.symbol == "A").sum()
    back = J.asof_backward(df, df.filter("seq % 3 = 0"), ["symbol"], {"r": "seq"}, right_order=["seq"], width=None).toPandas()
    fixed = J.asof_backward(df, df.filter("seq % 3 = 0"), ["symbol"], {"r": "seq"}, right_order=["seq"], width=64).toPandas()
    assert back.sort_values("seq")["r"].fillna(-1).tolist() == fixed.sort_values("seq")["r"].fillna(-1).tolist()
    assert S.suggest_width(df, rows=40, unit=100) <= 1000


@pytest.mark.parametrize(("block", "fan"), [(4, 16), (7, 1024), (512, 1024)])
def test_averages_count_the_whole_history(spark, rows, block, fan):
    """Also after the values fall by thirty orders of magnitude, where what went before still outweighs all that follows."""
    pdf = rows.assign(us=rows.seq * 10, x=np.where(rows.seq < 100, 1e30, 1.0 + rows.seq % 7), y=rows.bid)
    got = X.ema_columns(spark.createDataFrame(pdf).repartition(3), {"e9": ("x", 9), "e21": ("y", 21), "e1": ("y", 1), "e200": ("x", 200)}, tile=700, block=block, fan=fan)
    assert set(got.columns) == {*pdf.columns, "e9", "e21", "e1", "e200"}
    got = got.toPandas().sort_values("seq")
    for name, c, span in (("e9", "x", 9), ("e21", "y", 21), ("e1", "y", 1), ("e200", "x", 200)):
        want = pdf.groupby("symbol")[c].transform(lambda v, s=span: v.ewm(span=s, adjust=False).mean())
        assert np.allclose(got[name].to_numpy(), want.to_numpy(), rtol=1e-9, atol=0)


def test_cuts_meet_their_rows_without_a_shuffle_by_series(spark):
    """The optimizer must know how small the cuts are; else all rows of a series go to one task."""
    rows = spark.range(3_000_000).withColumn("k", F.col("id") % 2)
    plan = balanced_tile(rows, ["k"], "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_trailing_sums_of_windows_longer_than_their_tile(rows, df):
    """Windows of many tiles: what entered long ago comes as sums, so no row is copied into later tiles."""
    got = S.trailing_sums(df, ["symbol"], {"a": (F.col("x"), 2_500), "b": (F.lit(1), 700)}, width=100).toPandas().set_index("seq")
    for r in rows.itertuples():
        seen = rows[(rows.symbol == r.symbol) & ((rows.us < r.us) | ((rows.us == r.us) & (rows.seq <= r.seq)))]
        assert np.isclose(got.loc[r.seq, "a"], seen[seen.us >= r.us - 2_500].x.sum(), atol=1e-9)
        assert got.loc[r.seq, "b"] == (seen.us >= r.us - 700).sum()


@pytest.mark.parametrize("unique", [True, False])
def test_bins_send_no_rows_through_a_shuffle(spark, monkeypatch, unique):
    """Bins of a column with common values equal those by row number; rows are numbered only if the tie leaves some equal."""
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"k": np.arange(700) % 2, "x": rng.integers(0, 6, 700) * 1.0, "t": np.arange(700) if unique else rng.integers(0, 3, 700)})
    numbered, indexed = [], R.ordered_index
    monkeypatch.setattr(R, "ordered_index", lambda *a: numbered.append(1) or indexed(*a))
    got = R.floor_bins(R.equal_count_bins(spark.createDataFrame(pdf), ["k"], "x", "t", 4, "g"), ["k"], "x", "t", 10).toPandas()
    assert bool(numbered) is not unique
    for _, own in got.groupby("k"):
        assert own.groupby("g").size().tolist() == [88, 88, 87, 87] and own.groupby("bin").size().tolist() == [35] * 10
        if unique:
            own = own.sort_values(["x", "t"])
            assert own["bin"].tolist() == [i * 10 // 350 for i in range(350)] and own["g"].is_monotonic_increasing
