"""Queries that SQL cannot state, against brute force or their batch form on small inputs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from quoteloom.catalog import load
from quoteloom.catalog.evidence import oof
from quoteloom.catalog.ingest import END, START
from quoteloom.catalog.registry import QUERIES
from quoteloom.catalog.signals import cross, gated
from quoteloom.functions.timing import DAY, HOUR, SECOND
from quoteloom.operators import bars as B
from quoteloom.operators import evidence as V
from quoteloom.operators import models as M
from quoteloom.operators import signals as G
from quoteloom.plans.events import COOLDOWNS, FEATURE_GROUPS, EventSettings, event_rows, second_context
from quoteloom.sources.views import quotes

load()
T0 = 1_704_067_200 * SECOND


@pytest.fixture(scope="module")
def ticks():
    rng = np.random.default_rng(11)
    sec = np.sort(rng.choice(18_000, 4_500, replace=False))
    step = rng.normal(size=len(sec)) * np.where((sec // 900) % 5 == 0, 8, 1)
    mid = np.round(100 + np.cumsum(step) * 0.01, 4)
    rows = []
    for i, (s, m) in enumerate(zip(sec, mid, strict=True)):
        for k in range(1 + (i * 7 % 11 == 0) * 3):
            rows.append(("A", T0 + int(s) * SECOND + k * 1000, len(rows), m + k * 0.001 - 0.01, m + k * 0.001 + 0.01, 1.0))
    return pd.DataFrame(rows, columns=["symbol", "us", "seq", "bid", "ask", "volume"])


def brute_events(pdf: pd.DataFrame, scale: float):
    pdf = pdf.assign(mid=(pdf.bid + pdf.ask) / 2, sec=pdf.us // SECOND)
    g = pdf.groupby("sec")
    t, mid, cnt = g["us"].first().to_numpy(), g["mid"].first().to_numpy(), g.size().to_numpy()
    d = np.concatenate(([0.0], np.diff(mid) / scale))
    n = len(t)

    def left(i, s):
        return int(np.searchsorted(t, t[i] - s * SECOND, side="left"))

    def past(i, s, values):
        j = int(np.searchsorted(t, t[i] - s * SECOND, side="right")) - 1
        return values[j] if j >= 0 else np.nan

    rng300 = np.array([(mid[left(i, 300) : i + 1].max() - mid[left(i, 300) : i + 1].min()) / scale for i in range(n)])
    rate5 = np.array([cnt[left(i, 5) : i + 1].sum() - cnt[i] + 1 for i in range(n)], dtype=float)
    minute = t // (60 * SECOND)
    first = np.flatnonzero(np.concatenate(([True], np.diff(minute) > 0)))
    ref = {}
    for k, p in enumerate(first):
        prev = [q for q in first[:k] if t[q] >= t[p] - 14400 * SECOND]
        ok = len(prev) >= 20
        ref[minute[p]] = (np.quantile(rng300[prev], 0.2), np.median(rate5[prev])) if ok else (np.nan, np.nan)
    hits = {name: [] for name in COOLDOWNS}
    for i in range(n):
        rv = {w: np.sqrt((d[left(i, w) : i + 1] ** 2).sum()) for w in (60, 300, 900)}
        r60, r5 = (mid[i] - past(i, 60, mid)) / scale, (mid[i] - past(i, 5, mid)) / scale
        p20, med = ref[minute[i]]
        prior = mid[left(i, 900) : i]
        h900 = np.isfinite(past(i, 900, mid))
        if h900 and np.isfinite(r60) and abs(r60) >= 1.5 * rv[300]:
            hits["VOLATILITY_EVENT"].append(t[i])
        if h900 and len(prior) and (mid[i] > prior.max() + 0.25 * rv[900] * scale or mid[i] < prior.min() - 0.25 * rv[900] * scale):
            hits["BREAKOUT_EVENT"].append(t[i])
        if np.isfinite(past(i, 1800, mid)) and np.isfinite(med) and rate5[i] >= 2 * med and abs(r5) >= 0.5 * rv[60]:
            hits["ACCELERATION_EVENT"].append(t[i])
        before = past(i, 60, rng300)
        w60 = mid[left(i, 60) : i + 1]
        if np.isfinite(past(i, 14400, mid)) and np.isfinite(p20) and before <= p20 and (w60.max() - w60.min()) / scale >= 1.5 * before:
            hits["COMPRESSION_RELEASE_EVENT"].append(t[i])
    out = {(int(t[p]), "MINUTE_BASELINE") for p in first}
    for name, times in hits.items():
        last = -(10**30)
        for x in times:
            if x >= last + COOLDOWNS[name] * SECOND:
                out.add((int(x), name))
                last = x
    return out


def test_published_cooldowns():
    """The published pauses in seconds, as numbers: the brute force below takes them from the library."""
    from quoteloom.plans.events import COOLDOWNS

    assert COOLDOWNS == {"VOLATILITY_EVENT": 180, "BREAKOUT_EVENT": 300, "ACCELERATION_EVENT": 120, "COMPRESSION_RELEASE_EVENT": 600}


def test_event_detection(spark, ticks):
    s = EventSettings(scale=0.01)
    df = spark.createDataFrame(ticks).withColumns({"mid": (F.col("bid") + F.col("ask")) / 2, "spread": F.col("ask") - F.col("bid")})
    rows = event_rows(second_context(df, s), s).collect()
    got = {(r["us"], n) for r in rows for n in r["schemes"]}
    want = brute_events(ticks, 0.01)
    kinds = {n for _, n in want}
    assert {"VOLATILITY_EVENT", "BREAKOUT_EVENT", "ACCELERATION_EVENT"} <= kinds
    assert len(got ^ want) <= 0.002 * len(want), sorted(got ^ want)[:10]


def test_streamed_rollup_equals_batch(spark, sf):
    streamed = QUERIES["st4_stream_rollup"](spark, sf).toPandas().sort_values(["symbol", "us"]).reset_index(drop=True)
    batch = B.rollup_bars(B.bars_from_ticks(quotes(spark, sf), HOUR), 6 * HOUR).toPandas()
    both = streamed.merge(batch, on=["symbol", "us"], suffixes=("", "_b"))
    assert len(both) == len(streamed) >= len(batch) - 10
    assert (abs(both["close"] - both["close_b"]) < 1e-6).all()
    assert (both["ticks"] == both["ticks_b"]).all()


def test_streamed_decisions_equal_batch(spark, sf):
    got = QUERIES["st6_stream_decisions"](spark, sf).filter("regime IS NOT NULL AND status = 'DECIDED'").toPandas().set_index("us")
    want = G.timestamp_decisions(gated(spark, sf)).toPandas().set_index("us")
    assert len(got)
    for us, row in got.iterrows():
        assert row["regime"] == want.loc[us, "regime"] and (row["rejection"] == want.loc[us, "rejection"] or pd.isna(row["rejection"]))
    assert cross(spark, sf).count() > 0


def test_ridge_matches_closed_form(spark, sf):
    cols = ["pred", "pred_mfe", "past_return"]
    pdf = oof(spark, sf).toPandas()
    x = np.column_stack([np.ones(len(pdf)), pdf[cols].to_numpy(dtype=float)])
    y = pdf["market"].to_numpy(dtype=float)
    want = np.linalg.solve(x.T @ x + 2.0 * np.diag([0, 1, 1, 1]), x.T @ y)
    got = M.ridge(oof(spark, sf), cols, "market", 2.0)
    assert np.allclose([got["intercept"], *[got[c] for c in cols]], want, atol=1e-8)


def test_out_of_fold_rows_are_the_validation_rows(spark, sf):
    cuts = M.FOLD_CUTS["three"]
    rows = oof(spark, sf).drop("fold").withColumn("label", F.col("regime").cast("double"))
    out = M.oof_predictions(rows, ["user_id", "pred_mfe"], "label", START, END, cuts, 6 * HOUR, "logistic").toPandas()
    b = M.boundaries(START, END, cuts)
    assert out["event_id"].is_unique
    assert len(out) == rows.filter((F.col("us") >= b[0]) & (F.col("us") < b[3])).count()
    assert out["prediction"].between(0, 1).all()


def test_event_table_has_every_feature(spark, sf):
    out = QUERIES["g20_event_dataset"](spark, sf)
    assert len(FEATURE_GROUPS) == 88 and set(FEATURE_GROUPS) <= set(out.columns)
    rows = out.toPandas()
    assert len(rows) > 20 and not rows.duplicated(["symbol", "us"]).any()
    always = [n for n in FEATURE_GROUPS if n.split("_")[0] not in ("asian", "opening", "x") and "percentile" not in n and n not in ("atr_normalised", "range_expansion", "range_compression")]
    early = {f"return_{w}" for w in (5, 15, 30, 60)} | {"displacement_per_tick", "breakout_velocity"}
    assert rows[[n for n in always if n not in early]].notna().all().all()
    assert rows["day_position"].between(0, 1).all() and rows["uptick_ratio"].between(0, 1).all()


def test_dealing_keeps_values_and_breaks_order(spark, sf):
    base = oof(spark, sf).select("event_id", "side", "pred")
    dealt = M.dealt_again(base, ["side"], {"a": "pred"}, "event_id", 2).toPandas()
    plain = base.toPandas()
    assert len(dealt) == 2 * len(plain)
    for (side, _), part in dealt.merge(plain, on=["event_id", "side"]).groupby(["side", "repeat"]):
        assert sorted(part["dealt"]) == sorted(plain[plain.side == side]["pred"])
        assert (part["dealt"] != part["pred"]).mean() > 0.5


def test_sweeping_takes_columns_in_and_out():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(80, 5))
    x[:, 4] = 0.0
    y = x @ np.arange(5) + rng.normal(size=80)
    full = np.column_stack([np.ones(80), x, y])
    names = list("abcde")
    got = M.ridge_models(full.T @ full, names, 2.0, {"g": ["b", "d"], "h": ["a"]})
    for group, gone in (("", ""), ("g", "bd"), ("h", "a")):
        use = [i for i, n in enumerate(names) if n not in gone]
        d = np.column_stack([np.ones(80), x[:, use]])
        beta = np.linalg.solve(d.T @ d + 2.0 * np.diag([0.0, *[1.0] * len(use)]), d.T @ y)
        want = dict(zip(["intercept", *[names[i] for i in use]], beta, strict=True))
        assert got[group] == pytest.approx({n: want.get(n, 0.0) for n in ["intercept", *names]})


@pytest.mark.parametrize("model", ["ridge", "elastic_net", "multinomial", "boosted", "boosted_regressor"])
def test_models_learn_from_the_past(spark, model):
    """A label that follows one feature is predicted out of fold, with one feature constant and one partly missing."""
    rng = np.random.default_rng(3)
    n = 900
    x = rng.normal(size=n)
    label = np.where(x > 0.4, 2.0, np.where(x > -0.4, 1.0, 0.0)) if model == "multinomial" else ((x > 0) * 1.0 if model == "boosted" else 3 * x + 1)
    pdf = pd.DataFrame({"event_id": np.arange(n), "us": np.arange(n) * 1000, "x": x, "flat": 1.0, "part": np.where(np.arange(n) % 3, rng.normal(size=n), np.nan), "label": label})
    rows = spark.createDataFrame(pdf).withColumn("part", F.nanvl("part", F.lit(None)))
    settings = M.ModelSettings(rounds=5, rate=0.5)
    out = M.oof_predictions(rows, ["x", "flat", "part"], "label", 0, n * 1000, M.FOLD_CUTS["three"], 5000, model, settings, classes=3).toPandas()
    assert sorted(out["event_id"]) == list(range(630, 900)) and "z_x" not in out
    hit = (out["prediction"].round() == out["label"]).mean() if model in ("multinomial", "boosted") else np.corrcoef(out["prediction"], out["label"])[0, 1]
    assert hit > 0.85
    if model == "multinomial":
        assert np.allclose([sum(p) for p in out["probabilities"]], 1)


@pytest.mark.parametrize("model", ["boosted", "boosted_regressor"])
def test_boosted_rounds_read_equal_rows_once(spark, monkeypatch, model):
    """Copies of the same rows make the train table of the trees no longer, and the predictions are those of rows without a weight."""
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"us": np.arange(600) * 1000, "a": rng.integers(0, 12, 600), "b": rng.integers(0, 5, 600)})
    pdf["label"] = ((pdf["a"] + pdf["b"] + rng.integers(0, 4, 600)) > 9) * 1.0
    pdf = pd.concat([pdf] * 6, ignore_index=True)
    made, counted_rows = [], M.counted_rows

    def watched(train, columns, label):
        made.append((train.count(), counted_rows(train, columns, label)))
        return made[-1][1]

    monkeypatch.setattr(M, "counted_rows", watched)
    settings = M.ModelSettings(rounds=4, rate=0.5)
    args = (["a", "b"], "label", 0, 600_000, (0.7, 1.0), 0, model, settings)
    got = M.oof_predictions(spark.createDataFrame(pdf), *args).toPandas()
    (rows, table), = made
    assert rows == 6 * 420 and table.count() <= 12 * 5 * 2 and table.agg(F.sum("_weight")).first()[0] == rows
    monkeypatch.setattr(M, "counted_rows", lambda train, columns, label: train.withColumn("_weight", F.lit(1.0)))
    want = M.oof_predictions(spark.createDataFrame(pdf), *args).toPandas()
    by = ["us", "prediction"]
    assert np.allclose(got[by].sort_values(by), want[by].sort_values(by), atol=1e-9)


def test_robust_preparation_from_counts(spark):
    """Median, limits, mean and deviation of a column with copies and holes, as over the rows."""
    x = np.array([1.0, 1.0, 1.0, 5.0, np.nan, 9.0, 2.0, 2.0, np.nan, 400.0])
    rows = spark.createDataFrame(pd.DataFrame({"x": x})).withColumn("x", F.nanvl("x", F.lit(None)))
    got = M.RobustPrep.table(rows, ["x"], 0.1, 0.9).first()
    filled = np.where(np.isnan(x), np.nanmedian(x), x)
    low, high = np.quantile(filled, [0.1, 0.9])
    inside = np.clip(filled, low, high)
    assert [got[k] for k in ("median", "lower", "upper", "mean", "scale")] == pytest.approx([np.nanmedian(x), low, high, inside.mean(), inside.std()])


def test_one_hot_keeps_unknown_categories(spark):
    train = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (3.0, "a")], "x double, k string")
    fitted = M.prep_scale_onehot(["x"], ["k"]).fit(train)
    out = fitted.transform(spark.createDataFrame([(2.0, "zzz")], "x double, k string")).select(M.vector_to_array("features").alias("f")).first()["f"]
    assert abs(out[0]) < 1e-9 and len(out) >= 3


def test_redundancy_without_information_orders_no_rows(spark, monkeypatch):
    """Rank correlations alone need no bins; they are those found beside the mutual information."""
    rng = np.random.default_rng(6)
    x = rng.integers(0, 9, 300) * 1.0
    rows = spark.createDataFrame(pd.DataFrame({"a": x, "b": x + rng.integers(0, 5, 300), "c": rng.integers(0, 4, 300) * 1.0}))
    binned, floor_bins = [], V.R.floor_bins
    monkeypatch.setattr(V.R, "floor_bins", lambda *a: binned.append(1) or floor_bins(*a))
    got = V.redundancy_pairs(rows, ["a", "b", "c"], information=False).toPandas()
    assert not binned and "mutual_information" not in got
    want = rows.toPandas().rank().corr()
    assert got["spearman"].tolist() == pytest.approx([want.loc[r.feature_a, r.feature_b] for r in got.itertuples()])
    both = V.redundancy_pairs(rows, ["a", "b", "c"]).toPandas().sort_values("_i")
    assert len(binned) == 3 and both["spearman"].tolist() == pytest.approx(got["spearman"].tolist()) and both["mutual_information"].iloc[0] > 0.3


def test_matrix_effects(spark):
    rng = np.random.default_rng(4)
    n = 600
    x = rng.normal(size=n)
    pdf = pd.DataFrame({"id": np.arange(n), "fold": np.arange(n) % 4 + 1, "day": np.arange(n) % 20, "session": np.where(np.arange(n) % 2, "S", "T"), "a": x, "b": rng.normal(size=n), "y": x + rng.normal(size=n)})
    got = V.univariate_matrix(spark.createDataFrame(pdf), ["a", "b"], {"Y": "y"}, "id", {"a": "f", "b": "f"}).toPandas().set_index("feature")
    want = pdf[["a", "y"]].rank().corr().iloc[0, 1]
    assert abs(got.loc["a", "rho"] - want) < 1e-9
    assert got.loc["a", "p_value"] < 1e-10 < got.loc["b", "p_value"]
    assert got.loc["a", "same_sign_folds"] == 4
    assert got.loc["a", "status"] == "FEATURE_UNSTABLE"  # strong, but fewer rows than a candidate needs
    assert got.loc["a", "q"] <= 2 * got.loc["a", "p_value"] + 1e-15
    assert DAY == 86_400_000_000


@pytest.mark.parametrize("classes", [2, 3])
def test_logistic_after_an_observed_query(spark, sf, classes):
    """Once a query was observed the session cannot be sent to tasks, so a scored table must not hold the fitted model."""
    spark.range(9).observe(Observation("seen"), F.count(F.lit(1))).collect()
    rows = oof(spark, sf).drop("fold").withColumn("label", F.col("event_id") % classes).withColumn("label", F.col("label").cast("double"))
    z, model = ["pred", "pred_mfe"], "logistic" if classes == 2 else "multinomial"
    out = M.oof_predictions(rows, z, "label", START, END, M.FOLD_CUTS["three"], 1, model, classes=classes).toPandas()
    assert len(out)
    whole = rows.fillna(0.0, z)
    fitted = M.logistic(100, "label", classes=classes).fit(M.assembled(whole, z))
    mine = F.array(*M.class_probabilities(fitted, z))
    both = [fitted.predictProbability(r["features"]).toArray() - np.array(r["mine"]) for r in M.assembled(whole, z).withColumn("mine", mine).limit(50).collect()]
    assert np.abs(both).max() < 1e-12


def test_rounding_dust_decides_no_rank(spark):
    """Components that differ only in their last bits are ties; a score ends at 12 digits."""
    dust = [0.1 + 0.2, 0.3, 0.3, 0.1 + 0.2, 0.3, 0.3, 0.3]
    rows = [(i + 1, 0, v, v, v, 1.0, 1.0) for i, v in enumerate(dust)]
    frame = spark.createDataFrame(rows, "symbol int, us long, return_1h double, return_4h double, return_24h double, volume_relative double, trend_efficiency double")
    got = G.rank_cross_section(frame, 1, 2).toPandas().sort_values("symbol")
    assert got["rank"].tolist() == [7, 6, 5, 4, 3, 2, 1]
    assert got["score"].tolist() == [round(s, 12) for s in got["score"]] and got["score"].iloc[-1] == 1.0


def test_family_summary_ties_go_by_name(spark):
    rows = [("D", "f", "b", 0.3, "FEATURE_UNSTABLE"), ("D", "f", "c", -(0.1 + 0.2), "FEATURE_UNSTABLE"), ("D", "f", "a", 0.1, "FEATURE_NO_SIGNAL")]
    got = V.family_summary(spark.createDataFrame(rows, "target string, family string, feature string, rho double, status string")).first()
    assert got["top_features"] == "b,c,a" and (got["tests"], got["signals"]) == (3, 2)


def test_matrix_ranks_columns_once_and_keeps_its_plan_small(spark):
    """Pairs with and without holes against pandas, in all groups; the result reads written statistics, not twenty scans at once."""
    rng = np.random.default_rng(8)
    n = 400
    x = rng.integers(0, 30, n).astype(float)
    pdf = pd.DataFrame({"id": np.arange(n), "fold": np.arange(n) % 3, "day": np.arange(n) % 7, "session": "S", "a": x, "flat": 2.0, "part": np.where(np.arange(n) % 4, x + rng.normal(size=n) * 9, np.nan)})
    pdf["trend_regime"] = np.where(np.arange(n) % 5, "RANGE", "TREND")
    pdf["y"] = x + rng.normal(size=n) * 20
    rows = spark.createDataFrame(pdf).withColumn("part", F.nanvl("part", F.lit(None)))
    kept = pdf[pdf.fold > 0]
    got = V.matrix_effects(rows, ["a", "flat", "part"], {"Y": "y"}).toPandas().set_index(["feature", "kind", "scope"])
    assert len(got) == 3 * (1 + 2 + 2)
    groups = {("ALL", "ALL"): kept} | {("FOLD", str(k)): g for k, g in kept.groupby("fold")} | {("trend_regime", k): g for k, g in kept.groupby("trend_regime")}
    for (kind, scope), g in groups.items():
        for f in ("a", "part"):
            both = g[[f, "y"]].dropna()
            row = got.loc[(f, kind, scope)]
            assert row["n"] == len(both) and abs(row["rho"] - both.rank().corr().iloc[0, 1]) < 1e-12
        assert np.isnan(got.loc[("flat", kind, scope), "rho"])
    out = V.univariate_matrix(rows, ["a", "flat", "part"], {"Y": "y"}, "id", {"a": "f", "flat": "f", "part": "f"}, replications=20)
    assert len(out.toPandas()) == 3
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") < 60


def testnumbered_range_and_ranking_read_their_input_once(spark):
    """Row number and true range come from one scan as from two; the regime of a time does not compute the features again."""
    from quoteloom.operators import features as X
    from quoteloom.operators import signals as G
    from quoteloom.operators.scans import row_index, with_tile

    rows = [(s, t * 7, 10.0 + t % 5, 12.0 + (s * t) % 7, 9.0 - t % 3, None if t == 4 else 10.0 + (t * s) % 4) for s in range(4) for t in range(12)]
    bars = spark.createDataFrame(rows, "symbol long, us long, open double, high double, low double, close double")
    want = X.true_range(row_index(with_tile(bars, width=20), ["symbol"], ["us"]).drop("_tile").withColumnRenamed("rn", "n"), "r", tile=20)
    got = X.numbered_range(bars, ["symbol"], 20)
    assert sorted(got.select("symbol", "us", "rn", "_tr").collect()) == sorted(want.select("symbol", "us", "n", "r").collect())
    feats = spark.range(40).selectExpr("id % 8 AS symbol", "id div 8 AS us", "double(id % 11) - 4 AS return_4h", *[f"double(id % 7) AS {n}" for n in G.RANK_WEIGHTS if n not in ("return_4h", "vs_first", "vs_second", "vs_universe")])
    ranked = G.rank_cross_section(feats, 1, 2)
    assert ranked._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    regimes = {r["us"]: r["regime"] for r in G.market_regime(feats, 1, 2).collect()}
    assert {r["us"]: r["regime"] for r in ranked.collect()} == regimes


def test_fast_frame_numbers_its_bars_once(spark, monkeypatch):
    from quoteloom.operators import features as X
    from quoteloom.operators import scans as S
    from quoteloom.operators import signals as G

    calls = []
    for module in (S, X):
        real = module.prefix_scan
        monkeypatch.setattr(module, "prefix_scan", lambda *a, real=real, **k: calls.append(1) or real(*a, **k))
    bars = spark.createDataFrame([(1, t, 1.0 + t % 3, 4.0, 0.5, 2.0, 5.0) for t in range(30)], "symbol long, us long, open double, high double, low double, close double, volume double")
    rows = G._fast_frame(bars, 10).orderBy("us").collect()
    assert [r["rn"] for r in rows] == list(range(1, 31)) and len(calls) == 1


def test_quantiles_of_short_keys_need_no_tiles(spark, monkeypatch):
    from quoteloom.operators import ranks as R

    tiled, real = [], R.balanced_tile
    monkeypatch.setattr(R, "balanced_tile", lambda *a, **k: tiled.append(1) or real(*a, **k))
    rows = spark.range(900).selectExpr("id % 7 AS k", "double(id * 37 % 101) AS x").unionByName(spark.range(300).selectExpr("99L AS k", "double(id * id % 83) AS x"))
    want = {r["k"]: r["m"] for r in rows.groupBy("k").agg(F.median("x").alias("m")).collect()}
    got = {r["k"]: r["m"] for r in R.quantiles_of_many_keys(rows, ["k"], "x", {"m": 0.5}).collect()}
    assert got == want and not tiled
    monkeypatch.setattr(R, "SHORT", 200)
    both = {r["k"]: r["m"] for r in R.quantiles_of_many_keys(rows, ["k"], "x", {"m": 0.5}).collect()}
    assert both == want and tiled


def test_drift_sends_no_rows_to_the_tasks(spark):
    """The result reads written counts only, so that no small estimate of the rows makes a join broadcast them; figures as by hand."""
    rows = spark.range(600).selectExpr("concat('C', id % 2) AS comparison", "IF(id % 3 = 0, 'tgt', 'ref') AS role", "double(id * id % 37) + IF(id % 3 = 0, 4, 0) AS x")
    out = V.drift_numeric(rows, ["comparison"])
    assert "Range (" not in out._jdf.queryExecution().optimizedPlan().toString()
    pdf, got = rows.toPandas(), out.toPandas().set_index("comparison")
    assert len(got) == 2
    for k, g in pdf.groupby("comparison"):
        a, b = (np.sort(g.x[g.role == r].to_numpy()) for r in ("ref", "tgt"))
        edges = np.unique(np.quantile(a, np.arange(1, 10) / 10))
        p, q = (np.maximum(np.bincount(np.searchsorted(edges, v, "right"), minlength=len(edges) + 1) / len(v), 1e-6) for v in (a, b))
        grid = np.unique(g.x)
        gap = np.abs(np.searchsorted(a, grid, "right") / len(a) - np.searchsorted(b, grid, "right") / len(b))[:-1]
        want = {"ref_mean": a.mean(), "tgt_mean": b.mean(), "smd": (b.mean() - a.mean()) / np.sqrt((a.var() + b.var()) / 2), "psi": ((q - p) * np.log(q / p)).sum(), "wasserstein": (gap * np.diff(grid)).sum()}
        assert all(abs(got.loc[k, n] - v) < 1e-9 for n, v in want.items())


def test_equal_sums_of_ranks_are_equal_scores(spark):
    """Of 2,049 symbols every second sum of ranks lies halfway between two scores of 12 digits; equal sums still go by symbol."""
    rng = np.random.default_rng(5)
    n, own = 2049, ["return_1h", "return_4h", "return_24h", "volume_relative", "trend_efficiency"]
    pdf = pd.DataFrame({"symbol": np.arange(1, n + 1), "us": 0} | {f: rng.permutation(n) / 64 for f in own})
    place = {f: pdf[f].rank().astype(int) - 1 for f in own}
    points = 50 * place["return_4h"] + 25 * place["return_1h"] + 15 * place["return_24h"] + 5 * place["volume_relative"] + 5 * place["trend_efficiency"]
    assert points.duplicated().sum() > 20
    want = pdf.assign(points=points).sort_values(["points", "symbol"], ascending=[False, True])["symbol"].tolist()
    got = G.rank_cross_section(spark.createDataFrame(pdf), 1, 2).toPandas().sort_values("rank")
    assert got["symbol"].tolist() == want
    assert (got["score"] - np.sort(points)[::-1] / (100 * (n - 1))).abs().max() <= 1e-12


def test_the_mean_of_a_time_decides_no_tie(spark):
    """Returns that are equal at 12 digits are equal for their differences from the universe too, wherever the mean lies."""
    rows = [(i + 1, t, 1.0, r, 1.0, 1.0, 1.0) for t in range(10) for i, r in enumerate([0.3, 0.3 - 4e-13, 0.3 + 4e-13, 0.3 - 2e-13, 0.3 + 2e-13, 0.1 + 5e-13 * t])]
    frame = spark.createDataFrame(rows, "symbol int, us long, return_1h double, return_4h double, return_24h double, volume_relative double, trend_efficiency double")
    got = G.rank_cross_section(frame, 1, 2).toPandas().sort_values("symbol")
    assert got.groupby("us")["score"].agg(list).tolist() == [[0.1, 0.3, 0.5, 0.7, 0.9, 0.5]] * 10
