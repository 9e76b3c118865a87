"""Path indexes and questions against brute force."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quoteloom.operators import paths as P
from quoteloom.operators.sliding import Runs, SerialMoments
from quoteloom.operators.tape import Arrivals, Changes, Flow, LocalExtremes


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 700])
def test_range_extremes(n):
    rng = np.random.default_rng(n)
    v = rng.integers(0, 50, n).astype(float)
    a, b = rng.integers(0, n + 1, 400), rng.integers(0, n + 1, 400)
    got = P.RangeExtreme(v).over(a, b)
    assert got.tolist() == [max(v[x:y], default=-np.inf) for x, y in zip(a, b, strict=True)]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 700])
def test_first_reach(n):
    rng = np.random.default_rng(n)
    v = rng.normal(size=n)
    a, b = rng.integers(0, n + 1, 400), rng.integers(0, n + 1, 400)
    level = np.where(rng.random(400) < 0.1, np.nan, rng.normal(1, 1, 400))
    got = P.FirstReach(v).within(a, b, level)
    want = [next((i for i in range(x, y) if v[i] >= t), -1) for x, y, t in zip(a, b, level, strict=True)]
    assert got.tolist() == want


def test_looks_do_not_grow_with_density():
    """Ten times the rows over the same time: a few more levels, not ten times the looks."""
    rng = np.random.default_rng(2)
    looks = []
    for dense in (1, 10, 100):
        n = 2_000 * dense
        v = np.cumsum(rng.normal(size=n)) / np.sqrt(dense)
        start = rng.integers(0, n - 500 * dense, 500)
        tree = P.FirstReach(v)
        tree.within(start, start + 500 * dense, v[start] + 8)
        looks.append(tree.steps / 500)
    assert looks[1] - looks[0] < 12 and looks[2] - looks[1] < 12  # two or three looks a level


@pytest.fixture(scope="module")
def ticks():
    rng = np.random.default_rng(3)
    n = 600
    symbol = np.where(rng.random(n) < 0.7, "A", np.where(rng.random(n) < 0.5, "B", "C"))
    bid = np.round(100 + rng.normal(size=n).cumsum() / 10, 3)
    return pd.DataFrame({"symbol": symbol, "us": np.sort(rng.integers(0, 4000, n)), "seq": np.arange(n), "bid": bid, "ask": bid + 0.1 * (np.arange(n) % 4)})


@pytest.mark.parametrize("width", [None, 333, 1000, 50_000])
def test_questions_of_observations(spark, ticks, width):
    span, tolerance = 300, 9
    obs = spark.createDataFrame(ticks[ticks.seq % 2 == 0]).repartition(3)
    obs = obs.withColumns({"end": F.col("us") + span, "up": F.when(F.col("seq") % 10 > 0, F.col("bid") + 0.4), "note": F.lit("x"), "down": F.col("bid") - 0.3})
    questions = [
        P.Extreme("hi", "max", "bid", "end"),
        P.Extreme("lo", "min", "ask", "end", inclusive=False),
        P.Neighbour("end", {"next_us": "us", "next_bid": "bid"}, tolerance, times=("next_us",)),
        P.Neighbour("end", {"last_ask": "ask", "last_seq": "seq"}, tolerance, ahead=False, times=("last_seq",)),
        P.Touch("t", "bid", ">=", "up", "end", ("us", "seq", "ask")),
        P.Touch("s", "bid", "<=", "down", "next_us", ("seq",), otherwise="end"),
    ]
    got = P.along_path(obs, spark.createDataFrame(ticks).repartition(4), ["symbol"], questions, span + tolerance, width=width).toPandas().set_index("seq")
    assert len(got) == len(ticks[ticks.seq % 2 == 0]) and set(got["note"]) == {"x"}
    same = lambda x, y: (pd.isna(x) and y is None) or x == y
    for r in ticks[ticks.seq % 2 == 0].itertuples():
        mine = ticks[ticks.symbol == r.symbol]
        w = mine[(mine.us > r.us) & (mine.us <= r.us + span)]
        g = got.loc[r.seq]
        assert same(g.hi, w.bid.max() if len(w) else None)
        inside = w[w.us < r.us + span]
        assert same(g.lo, inside.ask.min() if len(inside) else None)
        after = mine[(mine.us >= r.us + span) & (mine.us <= r.us + span + tolerance)]
        assert same(g.next_us, after.us.iloc[0] if len(after) else None) and same(g.next_bid, after.bid.iloc[0] if len(after) else None)
        before = mine[(mine.us <= r.us + span) & (mine.us >= r.us + span - tolerance)]
        assert same(g.last_seq, before.seq.iloc[-1] if len(before) else None) and same(g.last_ask, before.ask.iloc[-1] if len(before) else None)
        hit = w[w.bid >= r.bid + 0.4] if r.seq % 10 > 0 else w.iloc[:0]
        assert same(g.t_seq, hit.seq.iloc[0] if len(hit) else None) and same(g.t_ask, hit.ask.iloc[0] if len(hit) else None)
        until = after.us.iloc[0] if len(after) else r.us + span
        fell = mine[(mine.us > r.us) & (mine.us <= until) & (mine.bid <= r.bid - 0.3)]
        assert same(g.s_seq, fell.seq.iloc[0] if len(fell) else None)


def test_a_path_goes_to_two_tiles_at_most_and_is_shuffled_once(spark, ticks):
    path = spark.createDataFrame(ticks)
    questions = [P.Extreme(f"hi{i}", "max", "bid", f"end{i}") for i in range(6)]
    obs = path.select("symbol", "us", *[(F.col("us") + 50 * (i + 1)).alias(f"end{i}") for i in range(6)])
    plan = P.along_path(obs, path, ["symbol"], questions, 300, width=300)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # the path and the observations


@pytest.mark.parametrize("n", [0, 1, 2, 40, 500])
def test_orders_of_ranges(n):
    rng = np.random.default_rng(n)
    v = np.where(rng.random(n) < 0.1, np.nan, rng.integers(0, 30, n))
    index = P.Orders(v)
    a = rng.integers(0, n + 1, 300)
    b = np.maximum(a, rng.integers(0, n + 1, 300))
    x = rng.integers(-2, 33, 300).astype(float)
    part = [np.sort(v[i:j][~np.isnan(v[i:j])]) for i, j in zip(a, b, strict=True)]
    assert index.count(a, b).tolist() == [len(p) for p in part]
    assert index.below(a, b, x).tolist() == [int((p < t).sum()) for p, t in zip(part, x, strict=True)]
    assert index.below(a, b, x, equal=True).tolist() == [int((p <= t).sum()) for p, t in zip(part, x, strict=True)]
    some = np.array([i for i, p in enumerate(part) if len(p)], np.int64)
    rank = np.array([rng.integers(len(part[i])) for i in some], np.int64)
    assert index.ranked(a[some], b[some], rank).tolist() == [part[i][k] for i, k in zip(some, rank, strict=True)]


@pytest.mark.parametrize("width", [700, 50_000])
def test_trailing_windows(spark, ticks, width):
    span = 250
    questions = [
        P.TrailingQuantile("q", "ask", 0.3, span, own=True),
        P.TrailingQuantile("m", "ask", 0.5, span, least=4),
        P.TrailingRank("r", "bid", "bid", span),
    ]
    path = spark.createDataFrame(ticks).repartition(4)
    got = P.along_path(path, path, ["symbol"], questions, width=width, back=span).toPandas().set_index("seq")
    for r in ticks.itertuples():
        mine = ticks[(ticks.symbol == r.symbol) & (ticks.us >= r.us - span)]
        own, past = mine[(mine.us < r.us) | ((mine.us == r.us) & (mine.seq <= r.seq))], mine[mine.us < r.us]
        g = got.loc[r.seq]
        assert g.q == pytest.approx(np.quantile(own.ask, 0.3))
        assert (len(past) < 4 and pd.isna(g.m)) or g.m == pytest.approx(np.quantile(past.ask, 0.5))
        assert (g.r_count, g.r_below, g.r_equal) == (len(past), (past.bid < r.bid).sum(), (past.bid == r.bid).sum())


def plain_runs(mids):
    signs = [x for x in np.sign(np.diff(mids)) if x]
    runs = [(k, len(list(g))) for k, g in itertools.groupby(signs)]
    if not runs:
        return [0.0] * 5
    shares = []
    for s in (1, -1):
        pairs = sum(a == s and b == s for a, b in itertools.pairwise(signs))
        shares.append(pairs / max(1, sum(x == s for x in signs[:-1])))
    lengths = [n for _, n in runs]
    return [np.mean(lengths), max(lengths), runs[-1][0] * runs[-1][1], *shares]


@pytest.mark.parametrize("span", [3, 40, 250])
def test_runs_of_windows(spark, ticks, span):
    rng = np.random.default_rng(8)
    pdf = ticks.assign(mid=rng.integers(0, 3, len(ticks)).astype(float))
    path = spark.createDataFrame(pdf).repartition(3)
    got = P.along_path(path, path, ["symbol"], [Runs("mid", span)], width=600, back=span).toPandas().set_index("seq")
    for r in pdf.itertuples():
        w = pdf[(pdf.symbol == r.symbol) & (pdf.us >= r.us - span) & ((pdf.us < r.us) | ((pdf.us == r.us) & (pdf.seq <= r.seq)))]
        assert got.loc[r.seq, ["run_mean", "run_max", "run_current", "up_up", "down_down"]].tolist() == pytest.approx(plain_runs(w.mid.to_numpy()))


@pytest.mark.parametrize(("span", "group"), [(3, 5), (29, 5), (30, 3), (250, 5), (250, 1)])
def test_serial_moments_of_windows(spark, ticks, span, group):
    pdf = ticks.drop_duplicates(["symbol", "us"]).assign(d=lambda x: np.round(np.sin(x.seq) * 10, 2))
    path = spark.createDataFrame(pdf).repartition(3)
    got = P.along_path(path, path, ["symbol"], [SerialMoments("d", span, group)], order=("us",), width=700, back=span).toPandas().set_index("seq")
    for r in pdf.itertuples():
        d = pdf[(pdf.symbol == r.symbol) & (pdf.us >= r.us - span) & (pdf.us <= r.us)].d.to_numpy()
        x, y = d[:-1], d[1:]
        groups = sum(d[i : i + group].sum() ** 2 for i in range(0, len(d), group))
        want = [len(d), d.sum(), (d * d).sum(), x.sum(), (x * x).sum(), y.sum(), (y * y).sum(), (x * y).sum(), groups]
        assert got.loc[r.seq, ["_n", "_s", "_ss", "_x", "_xx", "_y", "_yy", "_xy", "_gg"]].tolist() == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("span", [4, 60, 250])
def test_tape_of_windows(spark, ticks, span):
    rng = np.random.default_rng(12)
    pdf = ticks.assign(mid=rng.integers(0, 4, len(ticks)) / 4, spread=rng.integers(0, 2, len(ticks)) / 10)
    path = spark.createDataFrame(pdf).repartition(3)
    questions = [
        Flow("mid", (("a", span), ("b", 2 * span))), Changes("mid_rate", "mid", span), Changes("spread_rate", "spread", span), Arrivals("gap", "us", span, 10), LocalExtremes("mid", span, 10),
    ]
    got = P.along_path(path, path, ["symbol"], questions, width=600, back=2 * span).toPandas().set_index("seq")
    for r in pdf.itertuples():
        mine = pdf[(pdf.symbol == r.symbol) & ((pdf.us < r.us) | ((pdf.us == r.us) & (pdf.seq <= r.seq)))]
        g = got.loc[r.seq]
        for name, w in (("a", span), ("b", 2 * span)):
            change = np.diff(mine[mine.us >= r.us - w].mid.to_numpy())
            up, down = (change > 0).sum(), (change < 0).sum()
            assert (g[f"rate_{name}"], g[f"imbalance_{name}"]) == (len(change) + 1, (up - down) / max(up + down, 1))
        own = mine[mine.us >= r.us - span]
        gaps = np.diff(own.us.to_numpy()) / 10
        assert g.gap_mean == pytest.approx(gaps.mean() if len(gaps) else span / 10)
        assert g.gap_cv == pytest.approx(gaps.std() / gaps.mean() if len(gaps) and gaps.mean() > 0 else 0, abs=1e-6)
        for name, column in (("mid_rate", "mid"), ("spread_rate", "spread")):
            moved = np.diff(own[column].to_numpy()) != 0
            assert g[name] == pytest.approx(moved.mean() if len(moved) else 0)
        mids, us = own.mid.to_numpy(), own.us.to_numpy()
        want = [mids.max(), mids.min(), (r.us - us[mids.argmax()]) / 10, (r.us - us[mids.argmin()]) / 10]
        assert [g.local_high, g.local_low, g.since_high, g.since_low] == pytest.approx(want)


class Together(P.Ranged):
    """How many observations are answered in one call."""

    column = "bid"

    def answers(self):
        return {"together": "long"}

    def ask(self, path, now, known):
        return {"together": np.full(len(now), len(now))}


@pytest.mark.parametrize("keys", [["symbol"], ["symbol", "side"]])
def test_short_series_are_answered_together(spark, monkeypatch, keys):
    """Groups follow the rows, not the series, and no answer comes from another series."""
    rng = np.random.default_rng(8)
    n = 900
    rows = pd.DataFrame({"symbol": rng.integers(0, 60, n), "side": np.where(rng.random(n) < 0.5, "x", None), "us": rng.integers(-2000, 2000, n), "seq": np.arange(n), "bid": rng.integers(0, 40, n) / 4})
    rows["x"] = np.where(rng.random(n) < 0.9, rows["bid"], np.nan)
    path = spark.createDataFrame(rows[rows["symbol"] > 5]).withColumn("side", F.col("side").cast("string"))  # six series have no path
    obs = spark.createDataFrame(rows[["symbol", "side", "us", "seq", "bid"]]).sample(0.4, seed=1)
    obs = obs.withColumns({"level": F.col("bid") + 2, "due": F.when(F.col("seq") % 7 > 0, F.col("us") + 200), "end": F.col("us") + 290})
    questions = [
        P.Neighbour("due", {"next_us": "us", "next_bid": "bid"}, 80, times=("next_us",)),
        P.Neighbour("due", {"last_bid": "bid"}, 150, ahead=False),
        P.Extreme("high", "max", "x", "end"),
        P.Extreme("low", "min", "x", "next_us", inclusive=False),
        P.Touch("up", "bid", ">=", "level", "next_us", ("us", "bid"), otherwise="end"),
        P.TrailingRank("rank", "x", "bid", 250, own=True),
        P.TrailingQuantile("mid", "x", 0.4, 250),
    ]

    def rows_of(fewest):
        monkeypatch.setattr(P, "FEWEST", fewest)
        got = P.along_path(obs, path, keys, [*questions, Together()], 290, back=250, width=540)
        return got.toPandas().sort_values("seq").reset_index(drop=True)

    many, one = rows_of(P.FEWEST), rows_of(1 << 40)
    pd.testing.assert_frame_equal(one.drop(columns="together"), many.drop(columns="together"))
    assert many["together"].max() > 5 * one["together"].max()
