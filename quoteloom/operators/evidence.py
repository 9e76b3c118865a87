"""Statistical evidence on scored rows: slices, calibration, bootstrap, drift, gates, grids, verdicts.

Grids (cost levels, thresholds, accuracies) are arrays exploded next to each row and aggregated at once,
so a grid costs one shuffle of partial sums. Ranks and quantiles come from ``ranks``.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoteloom.functions.draws import hash_number, hash_uniform
from quoteloom.functions.timing import DAY, HOUR, cell
from quoteloom.operators import ranks as R
from quoteloom.operators.ledger import running_peaks
from quoteloom.operators.scans import balanced_tile, prefix_scan, previous
from quoteloom.session import durable, shared_path

c = F.col


def melt(df: DataFrame, keep, features, name: str = "feature", value: str = "x") -> DataFrame:
    """Wide features to (feature, x) rows."""
    cells = F.array(*[F.struct(F.lit(f).alias(name), c(f).cast("double").alias(value)) for f in features])
    return df.select(*keep, F.explode(cells).alias("_m")).select(*keep, "_m.*")


def melt_text(df: DataFrame, keep, features) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), c(f).cast("string").alias("value")) for f in features])
    return df.select(*keep, F.explode(cells).alias("_m")).select(*keep, "_m.*")


def scoped(df: DataFrame, fold: str = "fold", side: str = "side") -> DataFrame:
    """Each row in four scopes: fold and side, fold, side, all. For statistics that do not combine."""
    f, s = F.concat(F.lit("FOLD_"), c(fold).cast("string")), c(side)
    allv, both = F.lit("ALL"), F.lit("COMBINED")
    pairs = [(f, s), (f, both), (allv, s), (allv, both)]
    scopes = F.array(*[F.struct(a.alias("scope"), b.alias("scope_side")) for a, b in pairs])
    return df.withColumn("_s", F.explode(scopes)).select("*", "_s.scope", "_s.scope_side").drop("_s")


# -- slices and buckets ----------------------------------------------------------------------------
def slice_metrics(obs: DataFrame, dims, values, usable: str, keys: DataFrame | None = None, least: int = 100) -> DataFrame:
    """Counts and means of every dimension's slices plus the global one; ``keys(kind, key)`` completes the list."""
    kinds = [F.struct(F.lit("GLOBAL").alias("kind"), F.lit("ALL").alias("key"))]
    kinds += [F.struct(F.lit(d.upper()).alias("kind"), c(d).cast("string").alias("key")) for d in dims]
    rows = obs.withColumn("_k", F.explode(F.array(*kinds)))
    out = rows.groupBy("_k.kind", "_k.key").agg(
        F.count(F.lit(1)).alias("observations"),
        F.count_if(usable).alias("usable"),
        *[F.avg(F.when(c(usable), c(v))).alias(f"mean_{v}") for v in values],
    )
    if keys is not None:
        out = keys.join(out, ["kind", "key"], "left").fillna(0, ["observations", "usable"])
    return out.withColumn("sample_sufficient", c("usable") >= least)


def score_histogram(obs: DataFrame, score: str = "score") -> DataFrame:
    return obs.groupBy(score).agg(F.count(F.lit(1)).alias("n"))


# fixed values: score buckets
SCORE_BUCKETS = ((50, 59), (60, 69), (70, 79), (80, 89), (90, 94), (95, 100))


def bucket_label(score: Column, buckets=SCORE_BUCKETS) -> Column:
    out = F.lit(None).cast("string")
    for lo, hi in reversed(buckets):
        out = F.when(score.between(lo, hi), f"{lo}-{hi}").otherwise(out)
    return out


def score_buckets(obs: DataFrame, score: str, ret: str, mfe: str, mae: str, cost: str, buckets=SCORE_BUCKETS) -> DataFrame:
    """Win share, excursions, net return and cost per score bucket."""
    rows = obs.withColumn("bucket", bucket_label(c(score), buckets)).filter("bucket IS NOT NULL")
    return rows.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("observations"),
        (F.avg((c(ret) > 0).cast("double")) * 100).alias("win_pct"),
        F.avg(mfe).alias("average_mfe"),
        F.avg(mae).alias("average_mae"),
        F.avg(c(ret) - c(cost)).alias("average_net"),
        F.avg(cost).alias("average_cost"),
    )


def monotonic_check(buckets: DataFrame) -> DataFrame:
    """Whether win share, MFE and net rise and MAE falls over the (at most a handful of) buckets."""
    w = Window.partitionBy(F.lit(0)).orderBy("bucket")
    flags = {n: c(n) >= F.lag(n).over(w) for n in ("win_pct", "average_mfe", "average_net")}
    flags["average_mae"] = c("average_mae") <= F.lag("average_mae").over(w)
    rows = buckets.select(*[F.coalesce(f, F.lit(True)).alias(n) for n, f in flags.items()])
    out = rows.agg(F.count(F.lit(1)).alias("eligible"), *[F.bool_and(n).alias(f"{n}_ok") for n in flags])
    good = c("win_pct_ok") & c("average_mfe_ok") & c("average_net_ok") & c("average_mae_ok")
    verdict = F.when(c("eligible") < 2, "INSUFFICIENT_BUCKETS").when(good, "MONOTONIC_RELATIONSHIP_OBSERVED").otherwise("MONOTONIC_RELATIONSHIP_NOT_OBSERVED")
    return out.withColumn("conclusion", verdict)


# -- bootstrap -------------------------------------------------------------------------------------
def block_bootstrap(df: DataFrame, block: str, values, keys=(), replications: int = 2000, seed: int = 1) -> DataFrame:
    """Interval of each mean under resampling of whole blocks (days), with hash draws.

    Rows are reduced to one line of sums per block first; a replication draws as many blocks as exist.
    The number of blocks is bounded by the calendar, so block tables are small and broadcastable by size.
    """
    keys = list(keys)
    sums = df.groupBy(*keys, block).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(v).alias(f"_s_{v}") for v in values])
    w = Window.partitionBy(*keys).orderBy(block)
    total = Window.partitionBy(*keys)
    blocks = sums.withColumns({"_i": F.row_number().over(w) - 1, "_d": F.count(F.lit(1)).over(total)})
    return _resample(blocks, keys, values, replications, seed)


def _resample(blocks: DataFrame, keys, values, replications: int, seed: int) -> DataFrame:
    slots = blocks.select(*keys, c("_i").alias("_slot"), "_d", F.explode(F.sequence(F.lit(0), F.lit(replications - 1))).alias("_rep"))
    drawn = slots.withColumn("_i", (hash_number(seed, c("_rep"), c("_slot")) % c("_d")).cast("int")).drop("_d")
    hit = drawn.join(blocks.drop("_d"), [*keys, "_i"])
    reps = hit.groupBy(*keys, "_rep").agg(*[(F.sum(f"_s_{v}") / F.sum("_n")).alias(v) for v in values])
    low = [F.percentile(v, F.lit(q)).alias(f"{v}_{n}") for v in values for n, q in (("lower", 0.025), ("upper", 0.975))]
    ci = reps.groupBy(*keys).agg(*low)
    est = blocks.groupBy(*keys).agg(
        *[(F.sum(f"_s_{v}") / F.sum("_n")).alias(f"{v}_estimate") for v in values], F.count(F.lit(1)).alias("blocks")
    )
    return est.join(ci, keys) if keys else est.join(F.broadcast(ci))  # one row each without keys


# -- calibration and prediction metrics ------------------------------------------------------------
def calibration_width(pred: DataFrame, p: str = "p", y: str = "y", keys=()) -> DataFrame:
    """Ten equal-width probability bins; the last one is closed."""
    b = F.least(F.floor(F.round(c(p) * 10, 9)), F.lit(9)).cast("long")
    return pred.groupBy(*keys, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_probability"), F.avg(c(y).cast("double")).alias("observed_rate")
    )


def calibration_count(pred: DataFrame, p: str, y: str, tie: str, keys=(), bins: int = 10) -> DataFrame:
    """Equal-count bins; extra rows go to the first bins."""
    rows = R.equal_count_bins(pred, keys, p, tie, bins)
    return rows.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_predicted"), F.avg(c(y).cast("double")).alias("mean_actual")
    ).withColumn("difference", c("mean_actual") - c("mean_predicted"))


def binary_metrics(pred: DataFrame, p: str = "p", y: str = "y", keys=(), threshold: float = 0.5) -> DataFrame:
    """Accuracy, balanced accuracy, precision and recall of both classes, average precision, Brier, base rate."""
    keys = list(keys)
    yes, pos = c(p) >= threshold, c(y) == 1
    sums = pred.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(yes & pos).alias("_tp"),
        F.count_if(yes & ~pos).alias("_fp"),
        F.count_if(~yes & pos).alias("_fn"),
        F.count_if(~yes & ~pos).alias("_tn"),
        F.avg((c(p) - c(y)) * (c(p) - c(y))).alias("brier"),
        F.avg(c(y).cast("double")).alias("base_rate"),
    )
    tp, fp, fn, tn = (c(x) for x in ("_tp", "_fp", "_fn", "_tn"))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    out = sums.withColumns(
        {
            "accuracy": (tp + tn) / c("n"),
            "precision_positive": ratio(tp, tp + fp),
            "precision_negative": ratio(tn, tn + fn),
            "recall_positive": ratio(tp, tp + fn),
            "recall_negative": ratio(tn, tn + fp),
        }
    ).withColumn("balanced_accuracy", (c("recall_positive") + c("recall_negative")) / 2)
    # precision at every distinct score, weighted by the recall it adds
    counts = pred.groupBy(*keys, p).agg(F.count(F.lit(1)).alias("_w"), F.sum(c(y).cast("long")).alias("_y"))
    cum = R.cumulate(durable(counts), keys, p, {"_cn": c("_w"), "_cy": c("_y")}, descending=True)
    ap = cum.groupBy(*keys).agg((F.sum(c("_y") * c("_cy") / c("_cn")) / F.sum("_y")).alias("average_precision"))
    both = out.join(ap, keys) if keys else out.join(F.broadcast(ap))  # one row each without keys
    return both.drop("_tp", "_fp", "_fn", "_tn")


def multiclass_metrics(pred: DataFrame, probabilities: dict[str, str], outcome: str) -> DataFrame:
    """Accuracy, log loss, Brier, class shares and the error of the probability sum."""
    names = list(probabilities)
    best = F.greatest(*[c(p) for p in probabilities.values()])
    guess = F.coalesce(*[F.when(c(probabilities[n]) == best, n) for n in names])
    truth = F.coalesce(*[F.when(c(outcome) == n, c(probabilities[n])) for n in names])
    brier = sum(((c(p) - (c(outcome) == n).cast("double")) * (c(p) - (c(outcome) == n).cast("double")) for n, p in probabilities.items()), F.lit(0.0))
    total = sum((c(p) for p in probabilities.values()), F.lit(0.0))
    return pred.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((guess == c(outcome)).cast("double")).alias("accuracy"),
        F.avg(-F.ln(F.greatest(truth, F.lit(1e-15)))).alias("log_loss"),
        F.avg(brier).alias("brier"),
        F.max(F.abs(total - 1)).alias("sum_error"),
        *[F.avg((c(outcome) == n).cast("double")).alias(f"share_{n.lower()}") for n in names],
    )


def regression_metrics(pred: DataFrame, predicted: str, actual: str, keys=()) -> DataFrame:
    e = c(predicted) - c(actual)
    return pred.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("mean_error"),
        F.avg(predicted).alias("mean_predicted"), F.avg(actual).alias("mean_actual"),
    )


def economic_metrics(cand: DataFrame, pnl: str, order, week: str, session: str) -> DataFrame:
    """Expectancy, median, profit factor, win rate, drawdown, weeks and the largest session share."""
    rows = cand.withColumn("_tile", cell("us", DAY))
    run = running_peaks(rows, [], order, {"_cum": (c(pnl), F.lit(True))}, "_tile")
    dd = F.greatest(F.lit(0.0), c("_cum_peak")) - c("_cum")
    base = run.agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(c("side") == "LONG").alias("long_count"),
        F.avg(pnl).alias("expectancy"),
        F.avg((c(pnl) > 0).cast("double")).alias("win_rate"),
        F.try_divide(F.sum(F.when(c(pnl) > 0, c(pnl))), F.sum(F.when(c(pnl) < 0, -c(pnl)))).alias("profit_factor"),
        F.max(dd).alias("max_drawdown"),
    )
    weeks = cand.groupBy(week).agg(F.sum(pnl).alias("_p")).agg(
        F.count(F.lit(1)).alias("active_weeks"), F.avg((c("_p") > 0).cast("double")).alias("positive_week_fraction")
    )
    sess = cand.groupBy(session).agg(F.count(F.lit(1)).alias("_n")).agg((F.max("_n") / F.sum("_n")).alias("largest_session_share"))
    med = R.exact_quantiles(cand, [], pnl, {"median": 0.5})
    for one_row in (weeks, sess, med):
        base = base.join(F.broadcast(one_row))
    return base


def economic_intervals(cand: DataFrame, values, outcome: str, outcomes, block: str, replications: int = 2000, seed: int = 1) -> DataFrame:
    """Share of each outcome, and the mean of every value with its interval under resampling of whole blocks; one row."""
    shares = cand.agg(*[F.avg((c(outcome) == o).cast("double")).alias(f"share_{o.lower()}") for o in outcomes])
    return block_bootstrap(cand, block, values, (), replications, seed).join(F.broadcast(shares))  # one row each


def scope_means(pred: DataFrame, values) -> DataFrame:
    """Means by fold and side, fold, side and overall, as one cube."""
    cube = pred.cube("fold", "side").agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"mean_{v}") for v in values])
    return cube.withColumns({"fold": F.coalesce(c("fold").cast("string"), F.lit("ALL")), "side": F.coalesce("side", F.lit("COMBINED"))})


# fixed values: published quantiles
QUANTILES = {"q_min": 0.0, "q01": 0.01, "q05": 0.05, "q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9, "q95": 0.95, "q99": 0.99, "q_max": 1.0}


def quantile_distribution(pred: DataFrame, x: str, keys, thresholds) -> DataFrame:
    q = R.exact_quantiles(pred, keys, x, QUANTILES)
    above = pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c(x) > t).alias(f"above_{i}") for i, t in enumerate(thresholds)])
    return q.join(above, list(keys))


def _weighted_ranks(v: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Average ranks of the values ``v`` when each occurs ``m[r]`` times, for every resampling r."""
    _, code = np.unique(v, return_inverse=True)
    sizes = np.zeros((len(m), code.max() + 1))
    np.add.at(sizes.T, code, m.T)
    return (np.cumsum(sizes, axis=1) - (sizes - 1) / 2)[:, code]


def _resampled_correlations(x: np.ndarray, y: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spearman and Kendall tau-b of the rows drawn ``m[r]`` times; NaN where a drawn column is constant."""
    n = m.sum(axis=1)
    a, b = _weighted_ranks(x, m), _weighted_ranks(y, m)
    sa, sb = (m * a).sum(axis=1), (m * b).sum(axis=1)
    va, vb = n * (m * a * a).sum(axis=1) - sa * sa, n * (m * b * b).sum(axis=1) - sb * sb
    dx, dy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    fx, fy = ((m @ np.abs(dx)) * m).sum(axis=1), ((m @ np.abs(dy)) * m).sum(axis=1)
    usable = (n >= 3) & (fx > 0) & (fy > 0)
    with np.errstate(invalid="ignore", divide="ignore"):
        rho = (n * (m * a * b).sum(axis=1) - sa * sb) / (np.sqrt(va) * np.sqrt(vb))
        tau = ((m @ (dx * dy)) * m).sum(axis=1) / np.sqrt(fx * fy)
    return np.where(usable, rho, np.nan), np.where(usable, tau, np.nan)


def rank_correlations(pred: DataFrame, x: str, y: str, replications: int = 2000, seed: int = 7) -> DataFrame:
    """Spearman and Kendall tau-b of all rows per scope, and both of the UTC day means with intervals by drawing days anew.

    Days are bounded by the calendar: a scope's day means and their resamplings are small arrays of one task. The draws are those of
    ``block_bootstrap``: slot s of replication r takes day md5(seed:r:s) of the days in order.
    """
    by = ["scope", "scope_side"]
    slim = pred.select("fold", "side", "us", c(x).cast("double").alias("x"), c(y).cast("double").alias("y"))
    # equal pairs and days are added up before the scopes copy them
    counts = slim.filter("x IS NOT NULL AND y IS NOT NULL").groupBy("fold", "side", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    joint = durable(scoped(counts).groupBy(*by, "x", "y").agg(F.sum("n").alias("n")))
    rho = R.spearman_long(joint, by, weight=c("n"))
    tau = R.kendall_long(joint, by, weight=c("n")).select(*by, "tau")
    sums = slim.groupBy("fold", "side", cell("us", DAY).alias("day")).agg(*[f(v).alias(f"{n}{v}") for v in ("x", "y") for n, f in (("s", F.sum), ("n", F.count))])
    days = scoped(sums).groupBy(*by, "day").agg(*[F.try_divide(F.sum(f"s{v}"), F.sum(f"n{v}")).alias(v) for v in ("x", "y")])
    names = [f"day_{k}{e}" for k in ("rho", "tau") for e in ("", "_lower", "_upper")]

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["x", "y"]).sort_values("day")
        if not len(pdf):
            return pd.DataFrame(columns=[*by, "days", *names])
        out: dict = {k: pdf[k].iloc[:1].tolist() for k in by}
        v, w, d = pdf["x"].to_numpy(), pdf["y"].to_numpy(), len(pdf)
        drawn = [[int(hashlib.md5(f"{seed}:{r}:{s}".encode()).hexdigest()[:7], 16) % d for s in range(d)] for r in range(replications)]
        m = np.stack([np.bincount(r, minlength=d) for r in drawn]).astype(float) if drawn else np.zeros((0, d))
        for k, point, values in zip(("rho", "tau"), _resampled_correlations(v, w, np.ones((1, d))), _resampled_correlations(v, w, m), strict=True):
            values = values[~np.isnan(values)]
            low, high = np.quantile(values, [0.025, 0.975]) if len(values) else (np.nan, np.nan)
            out |= {f"day_{k}": [point[0]], f"day_{k}_lower": [low], f"day_{k}_upper": [high]}
        return pd.DataFrame(out | {"days": [d]})

    schema = "scope string, scope_side string, days long, " + ", ".join(f"{n} double" for n in names)
    means = days.groupBy(*by).applyInPandas(lambda pdf: summary(pdf)[[*by, "days", *names]], schema)
    means = means.select(*by, "days", *[F.nanvl(n, F.lit(None)).alias(n) for n in names])
    return rho.join(tau, by).join(means, by)


# fixed values: the published shares of best-ranked rows
TOP_FRACTIONS = [0.10, 0.05, 0.02, 0.01, 0.005, 0.0025, 0.001]


def ranking_curve(pred: DataFrame, score: str, pnl: str, fractions, tie: str) -> DataFrame:
    """Result of the top fractions by score in each scope against the unconditional mean."""
    slim = pred.select(*dict.fromkeys(["fold", "side", "us", score, pnl, tie]))  # what follows is written once, four rows a row
    rows = scoped(slim).withColumn("_neg", -c(score)).drop("fold", "side")
    ranked = R.ordered_index(rows, ["scope", "scope_side"], "_neg", tie)
    uncond = ranked.groupBy("scope", "scope_side").agg(F.avg(pnl).alias("unconditional"))
    picked = ranked.withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    picked = picked.filter(c("rn") <= F.greatest(F.lit(1), F.ceil(F.round(c("fraction") * c("rn_n"), 9))))
    out = picked.groupBy("scope", "scope_side", "fraction").agg(
        F.count(F.lit(1)).alias("n"), F.avg(pnl).alias("expectancy"), F.avg((c(pnl) > 0).cast("double")).alias("win_rate"),
        F.count_distinct(cell("us", DAY)).alias("active_days"),
    )
    return out.join(uncond, ["scope", "scope_side"]).withColumn("uplift", c("expectancy") - c("unconditional"))


# -- drift -----------------------------------------------------------------------------------------
def drift_numeric(long: DataFrame, keys) -> DataFrame:
    """Standardised mean difference, population stability on reference deciles, Wasserstein distance.

    ``long`` has the keys, ``role`` (ref or tgt) and ``x``. Its rows are only counted and summed: edges, bins and distribution
    functions come from the counts of distinct values. What has a row per key is written, so that the optimizer sees how small it is
    and sends that to the tasks, not the values.
    """
    keys = list(keys)
    ref = c("role") == "ref"
    stats = durable(long.groupBy(*keys).agg(
        F.avg(F.when(ref, c("x"))).alias("ref_mean"), F.avg(F.when(~ref, c("x"))).alias("tgt_mean"), F.var_pop(F.when(ref, c("x"))).alias("_vr"),
        F.var_pop(F.when(~ref, c("x"))).alias("_vt"), F.count_if(ref).alias("_nr"), F.count_if(~ref).alias("_nt"),
    ))
    counts = durable(long.groupBy(*keys, "x").agg(F.count_if(ref).alias("_r"), F.count_if(~ref).alias("_t")))
    edges = R.exact_quantiles(counts.filter("_r > 0"), keys, "x", {f"_e{i}": i / 10 for i in range(1, 10)}, c("_r"))
    edges = durable(edges.select(*keys, F.array_sort(F.array_distinct(F.array(*[f"_e{i}" for i in range(1, 10)]))).alias("_edges")))
    # a value equal to an edge belongs to the bin above it
    binned = counts.join(edges, keys).withColumn("_bin", F.size(F.filter("_edges", lambda e: e <= c("x"))))
    hist = binned.groupBy(*keys, "_bin").agg(F.sum("_r").alias("_r"), F.sum("_t").alias("_t"))
    grid = edges.select(*keys, F.explode(F.sequence(F.lit(0), F.size("_edges"))).alias("_bin"))
    full = grid.join(hist, [*keys, "_bin"], "left").fillna(0, ["_r", "_t"]).join(stats.select(*keys, "_nr", "_nt"), keys)
    a, b = F.greatest(c("_r") / c("_nr"), F.lit(1e-6)), F.greatest(c("_t") / c("_nt"), F.lit(1e-6))
    psi = full.groupBy(*keys).agg(F.sum((b - a) * F.ln(b / a)).alias("psi"))
    # distance between the two distribution functions, over the union of their values
    cum = durable(R.cumulate(counts, keys, "x", {"_cr": c("_r"), "_ct": c("_t")}))  # the cuts, the scan and its carry read it
    gaps = _next_value(cum, keys)
    gaps = gaps.join(stats.select(*keys, "_nr", "_nt"), keys)
    w1 = gaps.groupBy(*keys).agg(F.sum(F.abs(c("_cr") / c("_nr") - c("_ct") / c("_nt")) * (c("_next") - c("x"))).alias("wasserstein"))
    pooled = F.sqrt((c("_vr") + c("_vt")) / 2)
    out = stats.join(psi, keys).join(w1, keys)
    smd = F.when(pooled > 0, (c("tgt_mean") - c("ref_mean")) / pooled).otherwise(0.0)
    return out.withColumns({"smd": smd, "wasserstein_scaled": F.when(pooled > 0, c("wasserstein") / pooled).otherwise(0.0)}).drop("_vr", "_vt", "_nr", "_nt")


def _next_value(rows: DataFrame, keys) -> DataFrame:
    """Next larger value per key, through the same value tiles (the order is reversed)."""
    tiled = balanced_tile(rows.withColumn("_neg", -c("x")), keys, "_neg")
    return previous(tiled, keys, ["_neg"], {"_next": "x"}).drop("_tile", "_neg")


def drift_categorical(long: DataFrame, keys) -> DataFrame:
    """Stability index over the categories of both sides. ``long`` has the keys, ``role`` and ``value``."""
    keys = list(keys)
    ref = c("role") == "ref"
    freq = long.groupBy(*keys, "value").agg(F.count_if(ref).alias("_r"), F.count_if(~ref).alias("_t"))
    total = freq.groupBy(*keys).agg(F.sum("_r").alias("_nr"), F.sum("_t").alias("_nt"))
    rows = freq.join(total, keys)
    a, b = F.greatest(F.try_divide("_r", "_nr"), F.lit(1e-6)), F.greatest(F.try_divide("_t", "_nt"), F.lit(1e-6))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("categories"), F.sum((b - a) * F.ln(b / a)).alias("psi"))


def comparisons(df: DataFrame, folds: list[tuple[int, int]], fold: str = "fold", check: int | None = None) -> DataFrame:
    """Each row once per comparison it takes part in, as reference or target; ``check`` sets that fold against all before it."""
    parts = []
    sides = [(f"FOLD_{a}_VS_FOLD_{b}", c(fold) == a, c(fold) == b) for a, b in folds]
    if check is not None:
        sides.append(("DEVELOPMENT_VS_CHECK", c(fold) < check, c(fold) == check))
    for name, ref, tgt in sides:
        role = F.when(ref, "ref").when(tgt, "tgt")
        parts.append(F.when(role.isNotNull(), F.struct(F.lit(name).alias("comparison"), role.alias("role"))))
    return df.withColumn("_c", F.explode(F.array_compact(F.array(*parts)))).select("*", "_c.comparison", "_c.role").drop("_c")


def regime_shift(df: DataFrame, features, folds: list[tuple[int, int]], check: int | None = None) -> DataFrame:
    """Numeric drift of every feature between consecutive folds, and of development against the check fold."""
    rows = comparisons(df, folds, check=check)
    return drift_numeric(melt(rows, ["comparison", "role"], features), ["comparison", "feature"])


def categorical_shift(df: DataFrame, features, folds: list[tuple[int, int]], check: int | None = None) -> DataFrame:
    """The same for categories."""
    rows = comparisons(df, folds, check=check)
    return drift_categorical(melt_text(rows, ["comparison", "role"], features), ["comparison", "feature"])


def fold_means(df: DataFrame, features, fold: str = "fold") -> DataFrame:
    """Rows, mean and deviation of every feature per fold."""
    return melt(df, [fold], features).groupBy(fold, "feature").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("deviation"))


def candidate_anatomy(pred: DataFrame, candidate: Column, role: str, values) -> DataFrame:
    rows = pred.filter(candidate)
    return rows.groupBy(role).agg(F.count(F.lit(1)).alias("candidates"), *[F.avg(v).alias(f"mean_{v}") for v in values])


# -- feature evidence ------------------------------------------------------------------------------
def mutual_information(long: DataFrame, keys, tie: str, bins: int = 10, least: int = 50) -> DataFrame:
    """Discrete mutual information of x and y over rank bins ``floor(i * bins / n)``."""
    keys = list(keys)
    rows = long.filter(c("x").isNotNull() & c("y").isNotNull())
    rows = R.floor_bins(rows, keys, "x", tie, bins, "_bx")
    rows = R.floor_bins(rows, keys, "y", tie, bins, "_by")
    return _information(rows.groupBy(*keys, "_bx", "_by").agg(F.count(F.lit(1)).alias("_n")), keys, least)


def _information(cells: DataFrame, keys, least: int = 50) -> DataFrame:
    # at most bins * bins cells per key
    bx, by, al = (Window.partitionBy(*keys, *extra) for extra in (["_bx"], ["_by"], []))
    wide = cells.withColumns({"_nx": F.sum("_n").over(bx), "_ny": F.sum("_n").over(by), "_t": F.sum("_n").over(al)})
    p = c("_n") / c("_t")
    out = wide.groupBy(*keys).agg(F.sum(p * F.ln(c("_n") * c("_t") / (c("_nx") * c("_ny")))).alias("mi"), F.max("_t").alias("n"))
    return out.select(*keys, "n", F.when(c("n") >= least, c("mi")).alias("mutual_information"))


def bin_table(long: DataFrame, keys, tie: str, k: int = 5) -> DataFrame:
    """Equal-count groups of x with the mean of x and of y."""
    keys = list(keys)
    rows = R.equal_count_bins(long.filter(c("y").isNotNull()), keys, "x", tie, k, "group")
    return rows.groupBy(*keys, "group").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_feature"), F.avg("y").alias("mean_target"))


def monotonic_bins(long: DataFrame, keys, tie: str, k: int = 5) -> DataFrame:
    """Rank correlation of the group means of ``bin_table``, and the groups themselves as an array."""
    keys = list(keys)
    return _monotonic(bin_table(long, keys, tie, k), keys)


def _monotonic(means: DataFrame, keys) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("mean_target")  # k rows per key
    ranked = means.withColumn("_r", F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, "mean_target")) - 1) / 2)
    groups = F.array_sort(F.collect_list(F.struct("group", "n", "mean_feature", "mean_target")))  # k per key
    return ranked.groupBy(*keys).agg(F.corr("group", "_r").alias("bin_rho"), F.sum("n").alias("n"), groups.alias("bins"))


def within_block_spearman_ci(long: DataFrame, keys, block: str, replications: int = 500, seed: int = 1) -> DataFrame:
    """Mean of the per-block rank correlations with a bootstrap interval over the blocks."""
    return block_mean_ci(R.spearman_long(long, [*keys, block]), keys, block, replications, seed)


def block_mean_ci(rho: DataFrame, keys, block: str, replications: int = 500, seed: int = 1) -> DataFrame:
    """Mean of given rank correlations per block with a bootstrap interval over the blocks."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(block)
    blocks = rho.filter("n >= 3 AND rho IS NOT NULL").select(
        *keys, (F.row_number().over(w) - 1).alias("_i"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_d"), F.lit(1).alias("_n"), c("rho").alias("_s_rho")
    )
    return _resample(durable(blocks), keys, ["rho"], replications, seed)


def benjamini_hochberg(tests: DataFrame, p: str, order, q: str = "q", tile: int = 50_000) -> DataFrame:
    """False-discovery q-values; nulls stay null. Ranks and the running minimum from the largest p down go tile by tile."""
    good = R.global_index(tests.filter(c(p).isNotNull()), [c(p), *[c(o) if isinstance(o, str) else o for o in order]], "_r")
    total = tests.agg(F.count(p).alias("_m"))  # one row
    rows = good.crossJoin(F.broadcast(total)).withColumns({"_down": -c("_r"), "_tile": -F.floor(c("_r") / tile).cast("long")})
    value = F.least(c(p) * c("_m") / c("_r"), F.lit(1.0))
    found = prefix_scan(rows, [], ["_down"], {q: ("min", value)}).drop("_r", "_m", "_down", "_tile")
    return found.unionByName(tests.filter(c(p).isNull()).withColumn(q, F.lit(None).cast("double")))


def spearman_p_value(rho: str = "rho", n: str = "n") -> Column:
    """Two-sided p-value of a rank correlation from Student's t, by the incomplete beta function."""

    @F.pandas_udf("double")
    def p_value(r: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([_t_tail(a, b) for a, b in zip(r, size, strict=True)])

    return p_value(c(rho), c(n).cast("double"))


def _t_tail(r: float, n: float) -> float | None:
    if r is None or np.isnan(r) or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    dof = n - 2
    return float(_beta_tail(dof / 2, 0.5, 1 - r * r))


def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by integrating its density in u = 1 - sqrt(1 - t), which has no pole."""
    from math import exp, lgamma

    if x <= 0:
        return 0.0
    # t = 1 - s*s with s = sqrt(1 - t): the (1 - t)^(b - 1) pole at b = 1/2 cancels the Jacobian
    nodes, weights = np.polynomial.legendre.leggauss(200)
    lo, hi = np.sqrt(1 - x), 1.0
    s = (hi - lo) / 2 * nodes + (hi + lo) / 2
    density = 2 * np.exp((a - 1) * np.log(np.maximum(1 - s * s, 1e-300))) * s ** (2 * b - 1)
    const = exp(lgamma(a + b) - lgamma(a) - lgamma(b))
    return min(1.0, const * float((weights * density).sum()) * (hi - lo) / 2)


# fixed values of the published evidence: bootstrap draws, the fold that is frozen, regimes, and what a candidate must reach
MATRIX_DRAWS, FREEZE_FOLD = 500, 4
REGIMES = {"volatility_regime": ("LOW", "MEDIUM", "HIGH"), "trend_regime": ("RANGE", "TREND")}
CANDIDATE = {"rows": 5000, "effect": 0.03, "folds": 3, "fold_effect": 0.005, "bins": 0.70, "session": 0.60, "winsorized": 0.5, "q": 0.10, "unstable": 0.02}


MATRIX_KEYS = ["feature", "target", "horizon"]


@dataclass(frozen=True)
class MatrixRows:
    """The rows of a matrix, written once: features ``_x0, ...``, targets ``_y0, ...`` and what they are grouped by.

    ``xs`` and ``ys`` hold the columns without holes, whose pairs share their ranks and bins; ``long`` has a row per row and pair of
    the other pairs, as far as both values are present, or is None.
    """

    wide: DataFrame
    long: DataFrame | None
    xs: dict[str, str]
    ys: dict[str, tuple[str, str]]
    regimes: list[str]
    weeks: bool

    @classmethod
    def of(cls, events: DataFrame, features, targets: dict, extra=()) -> MatrixRows:
        named = {(n if isinstance(n, tuple) else (n, "")): t for n, t in targets.items()}
        regimes = [r for r in REGIMES if r in events.columns]
        kept = [*dict.fromkeys(["fold", *regimes, *[x for x in extra if x in events.columns]])]
        xs = {f"_x{i}": f for i, f in enumerate(features)}
        ys = {f"_y{i}": (n, str(h)) for i, (n, h) in enumerate(named)}
        values = [c(v).cast("double").alias(k) for k, v in [*xs.items(), *zip(ys, named.values(), strict=True)]]
        wide = durable(events.filter("fold > 0").select(*kept, *values, F.monotonically_increasing_id().alias("_id")))
        holes = wide.agg(*[F.count_if(c(k).isNull()).alias(k) for k in [*xs, *ys]]).first()  # a number per column
        rest = [(x, y) for x in xs for y in ys if holes[x] or holes[y]]
        long = None
        if rest:
            pairs = [F.struct(F.lit(xs[x]).alias("feature"), F.lit(ys[y][0]).alias("target"), F.lit(ys[y][1]).alias("horizon"), c(x).alias("x"), c(y).alias("y")) for x, y in rest]
            long = durable(wide.select(*kept, F.explode(F.array(*pairs)).alias("_p")).select(*kept, "_p.*").filter("x IS NOT NULL AND y IS NOT NULL"))
        return cls(wide, long, {k: v for k, v in xs.items() if not holes[k]}, {k: v for k, v in ys.items() if not holes[k]}, regimes, "week" in kept)

    def correlations(self, by=(), where: Column | None = None) -> DataFrame:
        """``n`` and ``rho`` of every pair per group ``by``."""
        by, (wide, long) = list(by), (t if t is None or where is None else t.filter(where) for t in (self.wide, self.long))
        parts = []
        if self.xs and self.ys:
            parts.append(grid_correlations(wide, self.xs, self.ys, by))
        if long is not None:
            parts.append(R.spearman_long(long, [*MATRIX_KEYS, *by]).select(*MATRIX_KEYS, *by, "n", "rho"))
        return durable(reduce(DataFrame.unionByName, parts))

    def regime_effects(self) -> DataFrame:
        parts = [self.correlations([r], c(r).cast("string").isin(*REGIMES[r])).select(*MATRIX_KEYS, F.lit(r).alias("kind"), c(r).cast("string").alias("regime"), "n", "rho") for r in self.regimes]
        return reduce(DataFrame.unionByName, parts)


def column_ranks(wide: DataFrame, columns: list[str], by=()) -> DataFrame:
    """``rank_of, _v, _r``: the average rank of every distinct value of each column per group ``by``, less the mean rank; one folder per column."""
    by = list(by)
    counted = R.value_counts(melt(wide, by, columns, "_c", "_v"), [*by, "_c"], "_v")
    totals = counted.groupBy(*by, "_c").agg(F.max("upto").alias("_total"))
    ranks = counted.join(totals, [*by, "_c"]).select(*by, c("_c").alias("rank_of"), "_v", (R.average_rank(counted) - (c("_total") + 1) / 2).alias("_r"))
    path = shared_path(wide.sparkSession)
    ranks.write.partitionBy("rank_of").parquet(path)  # one folder per column, so that the optimizer sees the size of each
    return wide.sparkSession.read.schema(ranks.schema).parquet(path)


def _with_ranks(rows: DataFrame, ranks: DataFrame, columns: list[str], by=()) -> DataFrame:
    for x in columns:
        own = ranks.filter(c("rank_of") == x).select(*by, c("_v").alias(x), c("_r").alias(f"_r{x}"))
        rows = rows.join(own, [*by, x]).drop(x)
    return rows


def ranked_columns(wide: DataFrame, columns: list[str], by=()) -> DataFrame:
    """The ranks ``_r<column>`` of every row; the columns have no holes."""
    return _with_ranks(wide.select(*by, *columns), column_ranks(wide, columns, by), columns, list(by))


def grid_correlations(wide: DataFrame, xs: dict[str, str], ys: dict[str, tuple[str, str]], by=(), chunk: int = 8) -> DataFrame:
    """Rank correlation of every column of ``xs`` with every one of ``ys`` per group ``by``; the columns have no holes.

    A column is ranked once per group, on its distinct values, whatever the number of pairs. The ranks go back to the rows by value, less their
    mean, and all pairs are sums of products that combine before their shuffle.
    """
    by = list(by)
    ranks = column_ranks(wide, [*xs, *ys], by)
    parts = []
    for start in range(0, len(xs), chunk):
        some = list(xs)[start : start + chunk]
        rows = _with_ranks(wide.select(*by, *some, *ys), ranks, [*some, *ys], by)
        each = F.explode(F.array(*[F.struct(F.lit(xs[x]).alias("feature"), c(f"_r{x}").alias("r")) for x in some])).alias("_f")
        r = c("_f.r")
        sums = rows.select(*by, *[f"_r{y}" for y in ys], each).groupBy(*by, c("_f.feature").alias("feature")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(r * r).alias("_xx"), *[F.sum(c(f"_r{y}") * c(f"_r{y}")).alias(f"_yy{y}") for y in ys], *[F.sum(r * c(f"_r{y}")).alias(f"_xy{y}") for y in ys]
        )
        pairs = [F.struct(F.lit(t).alias("target"), F.lit(h).alias("horizon"), c(f"_yy{y}").alias("yy"), c(f"_xy{y}").alias("xy")) for y, (t, h) in ys.items()]
        found = sums.select("feature", *by, "n", "_xx", F.explode(F.array(*pairs)).alias("_t")).filter("n > 0")
        rho = F.when((c("n") >= 3) & (c("_xx") > 0) & (c("_t.yy") > 0), c("_t.xy") / (F.sqrt("_xx") * F.sqrt("_t.yy")))
        parts.append(found.select("feature", "_t.target", "_t.horizon", *by, "n", rho.alias("rho")))
    return reduce(DataFrame.unionByName, parts)


def _grid_parts(m: MatrixRows, effect: DataFrame, tie: str) -> dict[str, DataFrame]:
    """Session share, winsorized effect, information and bins of the pairs without holes."""
    wide, columns, keys = m.wide, [*m.xs, *m.ys], MATRIX_KEYS
    qs = {"p01": 0.01, "p10": 0.10, "p90": 0.90, "p99": 0.99}
    at = {r["_c"]: r for r in R.exact_quantiles(melt(wide, [], columns, "_c", "_v"), ["_c"], "_v", qs).collect()}  # four numbers per column

    def limit(x: str, q: str) -> Column:
        return F.lit(at[x][q] if x in at else None).cast("double")

    ends = [F.struct(F.lit(f).alias("feature"), (c(x) >= limit(x, "p90")).cast("long").alias("hi"), (c(x) <= limit(x, "p10")).cast("long").alias("lo")) for x, f in m.xs.items()]
    counts = wide.select("session", F.explode(F.array(*ends)).alias("_e")).groupBy("_e.feature", "session").agg(F.sum("_e.hi").alias("_hi"), F.sum("_e.lo").alias("_lo"))
    sessions = effect.select(*keys, "rho").join(counts, "feature").withColumn("_n", F.when(F.coalesce("rho", F.lit(0.0)) >= 0, c("_hi")).otherwise(c("_lo")))
    share = sessions.groupBy(*keys).agg((F.max("_n") / F.sum("_n")).alias("largest_session_share"))
    clipped = wide.select(*[F.least(F.greatest(c(x), limit(x, "p01")), limit(x, "p99")).alias(x) for x in columns])
    wins = grid_correlations(clipped, m.xs, m.ys).select(*keys, c("rho").alias("winsorized"))
    # each column is put in order once; ten bins for the information, five groups for the means
    placed = R.ordered_index(melt(wide, [*dict.fromkeys(["_id", tie])], columns, "_c", "_v"), ["_c"], "_v", tie, "_rn")
    placed = placed.withColumns({"_b": F.least(F.floor((c("_rn") - 1) * 10 / c("_rn_n")), F.lit(9)).cast("int"), "_g": R.ntile_of(c("_rn"), c("_rn_n"), 5)})
    spread = {x: F.max(F.when(c("_c") == x, F.struct("_b", "_g", "_v"))).alias(x) for x in columns}
    boxes = durable(placed.groupBy("_id").agg(*spread.values()))
    names = [(x, y) for x in m.xs for y in m.ys]
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("pair"), c(x)["_b"].alias("bx"), c(y)["_b"].alias("by")) for i, (x, y) in enumerate(names)])).alias("_p")
    cells = boxes.select(cells).groupBy("_p.pair", c("_p.bx").alias("_bx"), c("_p.by").alias("_by")).agg(F.count(F.lit(1)).alias("_n"))
    known = F.array(*[F.struct(F.lit(m.xs[x]).alias("feature"), F.lit(m.ys[y][0]).alias("target"), F.lit(m.ys[y][1]).alias("horizon")) for x, y in names])
    cells = cells.withColumn("_k", F.get(known, c("pair"))).select("_k.*", "_bx", "_by", "_n")
    groups = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), c(x)["_g"].alias("group"), c(x)["_v"].alias("x")) for x, f in m.xs.items()])).alias("_f")
    means = boxes.select(groups, *m.ys).groupBy("_f.feature", "_f.group").agg(F.count(F.lit(1)).alias("n"), F.avg("_f.x").alias("mean_feature"), *[F.avg(c(y)["_v"]).alias(y) for y in m.ys])
    of = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.lit(h).alias("horizon"), c(y).alias("mean_target")) for y, (t, h) in m.ys.items()])).alias("_t")
    means = means.select("feature", "group", "n", "mean_feature", of).select("feature", "_t.*", "group", "n", "mean_feature")
    return {"share": share, "wins": wins, "info": _information(cells, keys), "mono": _monotonic(durable(means), keys)}


def _pair_parts(long: DataFrame, effect: DataFrame, tie: str) -> dict[str, DataFrame]:
    """The same of pairs with holes, each over its own rows."""
    keys = MATRIX_KEYS
    limits = R.exact_quantiles(long, keys, "x", {"_p01": 0.01, "_p10": 0.10, "_p90": 0.90, "_p99": 0.99})
    ylim = R.exact_quantiles(long, keys, "y", {"_y01": 0.01, "_y99": 0.99})
    ends = durable(limits.join(ylim, keys).join(effect.select(*keys, c("rho").alias("_rho")), keys))
    marked = long.join(ends, keys)
    extreme = marked.filter(F.when(F.coalesce("_rho", F.lit(0.0)) >= 0, c("x") >= c("_p90")).otherwise(c("x") <= c("_p10")))
    share = extreme.groupBy(*keys, "session").agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg((F.max("_n") / F.sum("_n")).alias("largest_session_share"))
    clipped = marked.select(*keys, F.least(F.greatest("x", "_p01"), c("_p99")).alias("x"), F.least(F.greatest("y", "_y01"), c("_y99")).alias("y"))
    wins = R.spearman_long(clipped, keys).select(*keys, c("rho").alias("winsorized"))
    return {"share": share, "wins": wins, "info": mutual_information(long, keys, tie), "mono": monotonic_bins(long, keys, tie)}


def matrix_effects(events: DataFrame, features, targets: dict) -> DataFrame:
    """``feature, target, horizon, kind, scope, n, rho``: the rank correlations of the matrix over all rows (kind ALL), by fold and by regime."""
    m = MatrixRows.of(events, features, targets)
    every = m.correlations().select(*MATRIX_KEYS, F.lit("ALL").alias("kind"), F.lit("ALL").alias("scope"), "n", "rho")
    parts = [every, m.correlations(["fold"]).select(*MATRIX_KEYS, F.lit("FOLD").alias("kind"), c("fold").cast("string").alias("scope"), "n", "rho")]
    if m.regimes:
        parts.append(m.regime_effects().withColumnRenamed("regime", "scope"))
    return reduce(DataFrame.unionByName, parts)


def univariate_matrix(
    events: DataFrame, features, targets: dict, tie: str, families: dict[str, str], replications: int = MATRIX_DRAWS, freeze: int = FREEZE_FOLD
) -> DataFrame:
    """Evidence of every feature against every target at every horizon: effect, p, q, information, bins, folds, regimes, day and week intervals, status.

    ``targets`` maps (target, horizon), or a target alone, to its column; the rows are those of folds above 0. Columns are ranked and binned once for all
    their pairs, pairs with missing values on their common rows; each statistic is written before the next, so that plans stay
    small. Needs fold, day, session; week and the columns of ``REGIMES`` are used where present.
    """
    keys = MATRIX_KEYS
    m = MatrixRows.of(events, features, targets, ["day", "session", "week", tie])
    effect = durable(m.correlations().withColumn("p_value", spearman_p_value()))
    folds = m.correlations(["fold"]).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("fold", "rho"))).alias("fold_effects"))
    found = [_grid_parts(m, effect, tie)] if m.xs and m.ys else []
    if m.long is not None:
        found.append(_pair_parts(m.long, effect, tie))
    columns = {"share": ["largest_session_share"], "wins": ["winsorized"], "info": ["mutual_information"], "mono": ["bin_rho", "bins"]}
    parts = [folds, *[durable(reduce(DataFrame.unionByName, [f[n].select(*keys, *names) for f in found])) for n, names in columns.items()]]
    parts.append(durable(block_mean_ci(m.correlations(["day"]), keys, "day", replications)))
    if m.weeks:
        weekly = block_mean_ci(m.correlations(["week"]), keys, "week", replications, seed=2)
        parts.append(durable(weekly.select(*keys, *[c(f"rho_{e}").alias(f"week_{e}") for e in ("estimate", "lower", "upper")])))
    if m.regimes:
        parts.append(m.regime_effects().groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("kind", "regime", "n", "rho"))).alias("regime_effects")))  # five per key
    rows = effect
    for part in parts:
        rows = rows.join(part, keys, "left")
    rows = durable(rows)
    rows = benjamini_hochberg(rows, "p_value", keys)
    sign = F.signum("rho")
    same = F.size(F.filter("fold_effects", lambda f: (F.abs(f["rho"]) >= CANDIDATE["fold_effect"]) & (F.signum(f["rho"]) == sign)))
    frozen = F.get(F.filter("fold_effects", lambda f: f["fold"] == freeze), F.lit(0))["rho"]
    day_ok = ((c("rho_lower") > 0) | (c("rho_upper") < 0)) & (F.signum("rho_estimate") == sign)
    checks = (
        c("n") >= CANDIDATE["rows"],
        F.abs("rho") >= CANDIDATE["effect"],
        same >= CANDIDATE["folds"],
        frozen.isNull() | (F.abs(frozen) < CANDIDATE["fold_effect"]) | (F.signum(frozen) == sign),
        (F.abs("bin_rho") >= CANDIDATE["bins"]) & (F.signum("bin_rho") == sign),
        c("largest_session_share") <= CANDIDATE["session"],
        (F.signum("winsorized") == sign) & (F.abs("winsorized") >= CANDIDATE["winsorized"] * F.abs("rho")),
        day_ok,
        c("q") <= CANDIDATE["q"],
    )
    strong = checks[0]
    for k in checks[1:]:
        strong = strong & F.coalesce(k, F.lit(False))
    backed = (same >= CANDIDATE["folds"]) | F.coalesce(c("q") <= CANDIDATE["q"], F.lit(False)) | F.coalesce(day_ok, F.lit(False))
    weak = (F.abs("rho") >= CANDIDATE["unstable"]) & backed
    status = F.when(strong, "FEATURE_RESEARCH_CANDIDATE").when(F.coalesce(weak, F.lit(False)), "FEATURE_UNSTABLE").otherwise("FEATURE_NO_SIGNAL")
    family = F.element_at(F.create_map(*[x for f, g in families.items() for x in (F.lit(f), F.lit(g))]), c("feature"))
    return rows.withColumns({"same_sign_folds": same, "freeze_effect": frozen, "status": status, "family": family})


def sampling_summary(events: DataFrame, horizons, schemes: str = "schemes") -> DataFrame:
    """Per scheme: counts, active days, and per horizon the share of tradable moves and mean outcomes."""
    rows = events.withColumn("scheme", F.explode(schemes))
    return rows.groupBy("scheme").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("day").alias("active_days"),
        *[F.avg((c(f"ratio_{h}") >= 1).cast("double")).alias(f"move_probability_{h}") for h in horizons],
        *[F.avg(f"ret_{h}").alias(f"mean_return_{h}") for h in horizons],
    )


# fixed values: multiples of the cost that a move is compared with
MOVE_THRESHOLDS = (1.5, 2.0, 3.0, 4.0)


def _moves(ratio: str, thresholds) -> list[Column]:
    return [F.avg((c(ratio) > t).cast("double")).alias(f"move_gt_{t:g}".replace(".", "_")) for t in thresholds]


def _by_horizon(rows: DataFrame, horizons, columns: dict[str, str]) -> DataFrame:
    """One row per event and horizon; ``columns`` maps a name to the prefix of its columns."""
    cells = F.array(*[F.struct(F.lit(str(h)).alias("horizon"), *[c(f"{p}_{h}").cast("double").alias(n) for n, p in columns.items()]) for h in horizons])
    return rows.withColumn("_h", F.explode(cells)).select("*", "_h.*").drop("_h")


def sampling_by_horizon(events: DataFrame, horizons, schemes: str = "schemes", thresholds=MOVE_THRESHOLDS) -> DataFrame:
    """Per scheme and horizon of folds above 0: events, active days and weeks, mean ratio and return, chances of moves over multiples of the cost."""
    rows = _by_horizon(events.filter("fold > 0").withColumn("scheme", F.explode(schemes)), horizons, {"ratio": "ratio", "signed": "ret"})
    return rows.groupBy("scheme", "horizon").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("day").alias("active_days"), F.count_distinct("week").alias("active_weeks"),
        F.avg("ratio").alias("mean_ratio"), F.avg("signed").alias("mean_return"), *_moves("ratio", thresholds),
    )


def sampling_sessions(events: DataFrame, schemes: str = "schemes", session: str = "session") -> DataFrame:
    """Events per scheme and session."""
    return events.filter("fold > 0").withColumn("scheme", F.explode(schemes)).groupBy("scheme", session).agg(F.count(F.lit(1)).alias("events"))


def label_summary(events: DataFrame, horizons, thresholds=MOVE_THRESHOLDS) -> DataFrame:
    """Per horizon, over all folds above 0 and by fold: mean and median ratio, mean return, chances of moves over multiples of the cost."""
    rows = _by_horizon(events.filter("fold > 0"), horizons, {"ratio": "ratio", "signed": "ret"})
    both = durable(rows.withColumn("scope", F.explode(F.array(F.lit("ALL"), F.concat(F.lit("FOLD_"), c("fold").cast("string"))))).select("horizon", "scope", "ratio", "signed"))
    means = both.groupBy("horizon", "scope").agg(F.count(F.lit(1)).alias("n"), F.avg("ratio").alias("mean_ratio"), F.avg("signed").alias("mean_return"), *_moves("ratio", thresholds))
    return means.join(R.exact_quantiles(both, ["horizon", "scope"], "ratio", {"median_ratio": 0.5}), ["horizon", "scope"])


def family_summary(matrix: DataFrame, top: int = 5) -> DataFrame:
    """Counts per target and family and the strongest features; effects are compared at 12 digits, so that rounding dust splits no ties."""
    w = Window.partitionBy("target", "family").orderBy(F.round(F.abs("rho"), 12).desc(), "feature")  # the feature list
    ranked = matrix.withColumn("_r", F.row_number().over(w))
    best = F.array_sort(F.collect_list(F.when(c("_r") <= top, F.struct("_r", "feature"))))
    return ranked.groupBy("target", "family").agg(
        F.count(F.lit(1)).alias("tests"), F.count_if(c("status") != "FEATURE_NO_SIGNAL").alias("signals"), F.max(F.abs("rho")).alias("largest_effect"),
        F.array_join(F.transform(best, lambda s: s["feature"]), ",").alias("top_features"),
    )


def early_day_hypothesis(events: DataFrame, feature: str, target: str, after: int = 8 * HOUR) -> DataFrame:
    """First value of a feature after an hour of the day against the day's mean target, as a rank correlation."""
    tod = c("us") % DAY
    days = events.groupBy(cell("us", DAY).alias("day")).agg(
        F.min_by(feature, F.when((tod >= after) & c(feature).isNotNull(), F.struct("us", "seq"))).alias("x"), F.avg(target).alias("y")
    )
    return R.spearman_long(days.withColumn("k", F.lit("ALL")), ["k"]).drop("k")


def redundancy_pairs(df: DataFrame, features: list[str], bins: int = 10, information: bool = True) -> DataFrame:
    """``feature_a, feature_b, spearman, mutual_information`` of every pair, in the order given; the last only with ``information``.

    Each feature is ranked on its distinct values and binned once; the ranks meet the rows by value, and the pairs then are one Gram
    pass over the rank vectors and one count of bin pairs, which combines before its shuffle. Pairs with a feature that
    has missing values are ranked on their common rows, one by one.
    """
    rows = durable(df.select(*[c(f).cast("double").alias(f) for f in features], F.monotonically_increasing_id().alias("_id")))
    good = {f: F.when(F.isnan(f) | (F.abs(f) == float("inf")), None).otherwise(c(f)) for f in features}
    rows = rows.withColumns(good)
    holes = rows.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c(f).isNull().cast("long")).alias(f) for f in features]).first()  # a number per feature
    whole = [f for f in features if not holes[f]] if holes["_n"] >= 3 else []
    pairs = list(combinations(features, 2))
    names = {f"{i}": p for i, p in enumerate(pairs)}
    rho: dict[tuple[str, str], float | None] = {}
    parts = []
    if len(whole) > 1:
        wide = ranked_columns(rows, whole).select(*[c(f"_r{f}").alias(f) for f in whole])
        matrix = Correlation.corr(wide.select(array_to_vector(F.array(*whole)).alias("v")), "v").first()[0].toArray()  # features squared
        for i, a in enumerate(whole):
            for j, b in enumerate(whole[:i]):
                rho[b, a] = float(matrix[i, j]) if np.isfinite(matrix[i, j]) else None
        if information:
            boxes = rows
            for f in whole:
                boxes = R.floor_bins(boxes, [], f, "_id", bins, f"_b_{f}")
            cells = F.array(*[F.struct(F.lit(k).alias("pair"), c(f"_b_{a}").alias("x"), c(f"_b_{b}").alias("y")) for k, (a, b) in names.items() if a in whole and b in whole])
            parts.append(boxes.select(F.explode(cells).alias("_p")).groupBy("_p.pair", "_p.x", "_p.y").agg(F.count(F.lit(1)).alias("_n")))
    rest = {k: p for k, p in names.items() if p not in rho}
    if rest:
        for r in R.spearman(rows, rest).collect():  # a number per pair
            rho[names[r["pair"]]] = r["rho"]
    if rest and information:
        items = F.array(*[F.struct(F.lit(k).alias("pair"), c(a).alias("x"), c(b).alias("y")) for k, (a, b) in rest.items()])
        both = rows.select("_id", F.explode(items).alias("_p")).select("_id", "_p.*").filter("x IS NOT NULL AND y IS NOT NULL")
        for axis in ("x", "y"):
            both = R.floor_bins(both, ["pair"], axis, "_id", bins, f"_b{axis}")
        parts.append(both.groupBy("pair", c("_bx").alias("x"), c("_by").alias("y")).agg(F.count(F.lit(1)).alias("_n")))
    shape = "pair string, _i int, feature_a string, feature_b string, spearman double"
    known = df.sparkSession.createDataFrame([(k, i, a, b, rho.get((a, b))) for i, (k, (a, b)) in enumerate(names.items())], shape)
    if not information:
        return known.drop("pair")
    cells = reduce(DataFrame.unionByName, parts)
    # at most bins * bins cells per pair
    bx, by, al = (Window.partitionBy("pair", *extra) for extra in (["x"], ["y"], []))
    sums = cells.withColumns({"_nx": F.sum("_n").over(bx), "_ny": F.sum("_n").over(by), "_t": F.sum("_n").over(al)})
    mi = sums.groupBy("pair").agg(F.sum(c("_n") / c("_t") * F.ln(c("_n") * c("_t") / (c("_nx") * c("_ny")))).alias("_mi"), F.max("_t").alias("_t"))
    enough = (c("_t") >= bins) & c("spearman").isNotNull()
    return known.join(mi, "pair", "left").select("_i", "feature_a", "feature_b", "spearman", F.when(enough, c("_mi")).alias("mutual_information"))


def redundancy_filter(df: DataFrame, features: list[str], threshold: float = 0.9) -> DataFrame:
    """Ordered greedy removal of features whose rank correlation with a kept one reaches the threshold.

    ``feature, priority, kept, representative, spearman``; the last two name the first kept feature that removed it. The
    greedy pass reads the small pair table (features squared) on the driver.
    """
    rho = {(r["feature_a"], r["feature_b"]): r["spearman"] for r in redundancy_pairs(df, features, information=False).collect()}
    kept: list[str] = []
    out = []
    for i, f in enumerate(features):
        near = next(((k, rho[k, f]) for k in kept if rho[k, f] is not None and abs(rho[k, f]) >= threshold), (None, None))
        if near[0] is None:
            kept.append(f)
        out.append((f, i, near[0] is None, *near))
    return df.sparkSession.createDataFrame(out, "feature string, priority int, kept boolean, representative string, spearman double")


# -- economics of predictions ----------------------------------------------------------------------
def ols(df: DataFrame, y: str, x: str, keys=()) -> DataFrame:
    return df.groupBy(*keys).agg(F.regr_intercept(y, x).alias("alpha"), F.regr_slope(y, x).alias("beta"), F.regr_r2(y, x).alias("r_squared"), F.count(F.lit(1)).alias("n"))


def direction_bins(oof: DataFrame, absolute: bool, tie: str) -> DataFrame:
    """Ten equal-count bins by signed or absolute prediction with accuracy, error and oracle results."""
    rows = oof.withColumn("_sort", F.abs("pred") if absolute else c("pred").cast("double"))
    rows = R.equal_count_bins(rows, [], "_sort", tie, 10)
    right = F.when(c("pred") >= 0, c("market") > 0).otherwise(c("market") < 0)
    side = F.when(c("pred") >= 0, c("long_base")).otherwise(c("short_base"))
    return rows.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.min("_sort").alias("sort_min"), F.max("_sort").alias("sort_max"), F.avg("pred").alias("mean_prediction"),
        F.avg("market").alias("mean_realized"), F.avg(right.cast("double")).alias("sign_accuracy"), F.avg(F.abs(c("pred") - c("market"))).alias("mae"),
        F.avg(F.greatest("long_exec", "short_exec")).alias("oracle_exec"), F.avg(F.greatest("long_base", "short_base")).alias("oracle_base"), F.avg(side).alias("predicted_side_base"),
    )


def _sided(long_side: Column, a: str, b: str) -> Column:
    return F.when(long_side, c(a)).otherwise(c(b))


def oracle_decomposition(oof: DataFrame) -> DataFrame:
    """Current or oracle regime times current or oracle side, in one pass."""
    now, best = c("pred") >= 0, c("long_base") >= c("short_base")
    systems = {
        "CURRENT_REGIME_CURRENT_DIRECTION": (c("prob") >= 0.5, now), "CURRENT_REGIME_ORACLE_DIRECTION": (c("prob") >= 0.5, best),
        "ORACLE_REGIME_CURRENT_DIRECTION": (c("regime") == 1, now), "ORACLE_REGIME_ORACLE_DIRECTION": (c("regime") == 1, best),
    }
    cells = F.array_compact(F.array(*[F.when(m, F.struct(F.lit(n).alias("system"), s.alias("long_side"))) for n, (m, s) in systems.items()]))
    rows = oof.withColumn("_s", F.explode(cells)).select("*", "_s.*")
    side = c("long_side")
    rows = rows.withColumns(
        {"_g": F.when(side, c("market")).otherwise(-c("market")), "_e": _sided(side, "long_exec", "short_exec"), "_b": _sided(side, "long_base", "short_base"), "_x": _sided(side, "long_stress", "short_stress")}
    )
    weekly = rows.groupBy("system", "week").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(x) for x in ("_g", "_e", "_b", "_x")],
        F.sum(F.when(c("_b") > 0, c("_b"))).alias("_w"), F.sum(F.when(c("_b") < 0, -c("_b"))).alias("_l"),
    )
    n = F.sum("n")
    return weekly.groupBy("system").agg(
        n.alias("n"), (F.sum("_g") / n).alias("gross"), (F.sum("_e") / n).alias("executable"), (F.sum("_b") / n).alias("base"), (F.sum("_x") / n).alias("stress"),
        F.try_divide(F.sum("_w"), F.sum("_l")).alias("profit_factor"), F.count(F.lit(1)).alias("active_weeks"), F.avg((c("_b") > 0).cast("double")).alias("positive_weeks"),
    )


def required_skill(oof: DataFrame, ident: str, seed: int = 7) -> DataFrame:
    """Expectancy at hypothetical accuracies of 50 to 100 % in four scopes; draws are nested across levels."""
    scopes = {"ALL_OOF": F.lit(True), "REGIME_050": c("prob") >= 0.5, "REGIME_060": c("prob") >= 0.6, "REGIME_070": c("prob") >= 0.7}
    rows = oof.withColumn("_u", hash_uniform(seed, c(ident))).withColumn("scope", F.explode(F.array_compact(F.array(*[F.when(m, n) for n, m in scopes.items()]))))
    rows = rows.withColumn("accuracy", F.explode(F.array(*[F.lit(a) for a in range(50, 101, 5)])))
    best = c("long_base") >= c("short_base")
    chosen = F.when(c("_u") < c("accuracy") / 100, best).otherwise(~best)
    return rows.groupBy("scope", "accuracy").agg(
        F.count(F.lit(1)).alias("n"), F.avg(_sided(chosen, "long_base", "short_base")).alias("base"), F.avg(_sided(chosen, "long_stress", "short_stress")).alias("stress")
    )


def cost_frontier(oof: DataFrame, slippage, commission) -> DataFrame:
    """Frozen predictions under a grid of slippage and commission levels."""
    grid = F.array(*[F.struct(F.lit(float(s)).alias("slippage"), F.lit(float(k)).alias("commission_side")) for s, k in product(slippage, commission)])
    rows = oof.filter(c("prob") >= 0.5).withColumn("_g", F.explode(grid)).select("*", "_g.*")
    fee = c("commission") * c("commission_side") / 2
    executable = _sided(c("pred") >= 0, "long_exec", "short_exec")
    keep = F.abs("pred") - c("spread") - 2 * c("slippage") - fee > 0
    pnl = F.when(keep, executable - 2 * c("slippage") - fee)
    return rows.groupBy("slippage", "commission_side").agg(
        F.count(pnl).alias("candidates"), F.avg(pnl).alias("expectancy"), F.try_divide(F.sum(F.when(pnl > 0, pnl)), F.sum(F.when(pnl < 0, -pnl))).alias("profit_factor")
    )


def break_even(oof: DataFrame, steps: int, top: float, over: str) -> DataFrame:
    """Largest level of one cost (the other fixed) at which the candidates still earn.

    A row is a candidate up to a level that depends only on its own prediction, so it is counted at that
    level and cumulated downwards over the levels: rows are not multiplied by the grid.
    """
    executable = _sided(c("pred") >= 0, "long_exec", "short_exec")
    if over == "commission":
        room, unit, fixed = F.abs("pred") - c("spread") - 2.0, c("commission") / 2, executable - 2.0
    else:
        room, unit, fixed = F.abs("pred") - c("spread") - c("commission"), F.lit(2.0), executable - c("commission")
    step = top / (steps - 1)
    # highest grid index with room - unit * level > 0
    last = F.ceil(F.round(room / unit / step, 9)) - 1
    rows = oof.filter(c("prob") >= 0.5).withColumns({"_last": F.least(last, F.lit(steps - 1)).cast("long"), "_f": fixed, "_u": unit})
    levels = rows.filter("_last >= 0").groupBy("_last").agg(F.count(F.lit(1)).alias("n"), F.sum("_f").alias("f"), F.sum("_u").alias("u"))
    down = Window.partitionBy(F.lit(0)).orderBy(c("i").desc())  # the grid levels
    grid = oof.sparkSession.range(steps).withColumnRenamed("id", "i").join(levels.withColumnRenamed("_last", "i"), "i", "left").fillna(0)
    cum = grid.withColumns({x: F.sum(x).over(down) for x in ("n", "f", "u")})
    earns = (c("n") > 0) & (c("f") - c("u") * c("i") * step > 1e-9)
    return cum.agg((F.max(F.when(earns, c("i"))) * step).alias("break_even"))


def edge_stages(oof: DataFrame, slippage: float = 1.0) -> DataFrame:
    """One population at each cost stage, from gross to stress."""
    now = c("pred") >= 0
    executable = _sided(now, "long_exec", "short_exec")
    stages = (
        ("1_GROSS", F.when(now, c("market")).otherwise(-c("market"))), ("2_EXECUTABLE", executable), ("3_SLIPPAGE", executable - 2 * slippage),
        ("4_BASE", _sided(now, "long_base", "short_base")), ("5_STRESS", _sided(now, "long_stress", "short_stress")),
    )
    rows = oof.select(F.explode(F.array(*[F.struct(F.lit(n).alias("stage"), v.cast("double").alias("v")) for n, v in stages])).alias("s"))
    return rows.groupBy("s.stage").agg(F.count(F.lit(1)).alias("n"), F.avg("s.v").alias("expectancy"))


def gate_grid(oof: DataFrame, costs: dict[str, str], ratios, scopes: dict[str, Column], keys=()) -> DataFrame:
    """Selected counts and expectancies over cost scenario, move-to-cost ratio and scope, and over ``keys`` such as the horizon."""
    cells = F.array(*[F.struct(F.lit(n).alias("scenario"), c(k).cast("double").alias("_cost"), F.lit(float(r)).alias("ratio")) for (n, k), r in product(costs.items(), ratios)])
    rows = oof.withColumn("scope", F.explode(F.array_compact(F.array(*[F.when(m, n) for n, m in scopes.items()]))))
    rows = rows.withColumn("_g", F.explode(cells)).select("*", "_g.*")
    side = c("dir_prob") >= 0.5
    gross = F.when(side, c("pred")).otherwise(-c("pred"))
    ok = (c("prob") >= 0.5) & (F.greatest(c("dir_prob"), 1 - c("dir_prob")) >= 0.55) & (gross > c("_cost")) & (F.try_divide("pred_mfe", "_cost") > c("ratio"))
    pnl = F.when(ok, _sided(side, "long_exec", "short_exec"))
    return rows.groupBy(*keys, "scope", "scenario", "ratio").agg(
        F.count(pnl).alias("candidates"), F.avg(pnl).alias("executable"), F.avg(pnl - c("_cost")).alias("net"), F.avg(F.when(pnl.isNotNull(), (pnl - c("_cost") > 0).cast("double"))).alias("profitable")
    )


def meta_gate(df: DataFrame, minimum: float = 0.6) -> DataFrame:
    """Side with the better positive expected net and enough probability, else skip.

    Needs p_long, p_short, target, stop, extra (cost beyond the spread).
    """
    ln = c("p_long") * c("target") - (1 - c("p_long")) * c("stop") - c("extra")
    sn = c("p_short") * c("target") - (1 - c("p_short")) * c("stop") - c("extra")
    lo, so = (c("p_long") >= minimum) & (ln > 0), (c("p_short") >= minimum) & (sn > 0)
    pick = F.when(lo & (~so | (ln >= sn)), "LONG").when(so, "SHORT").otherwise("SKIP")
    return df.withColumns({"expected_long": ln, "expected_short": sn, "selected_side": pick})


def opportunity_quality(df: DataFrame, setting: str = "setting") -> DataFrame:
    """Share of rows whose better side moves beyond multiples of cost, and its MFE over MAE."""
    best = F.greatest("mfe_long", "mfe_short")
    adverse = F.when(c("mfe_long") >= c("mfe_short"), c("mae_long")).otherwise(c("mae_short"))
    return df.groupBy(setting).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg((best > k * c("cost")).cast("double")).alias(f"p_gt_{i}") for i, k in enumerate((1.5, 2.0, 3.0))],
        F.avg(best / F.greatest(adverse, F.lit(1.0))).alias("quality"),
    )


def hypothesis_slices(df: DataFrame, hypotheses: dict[str, Column], values) -> DataFrame:
    """Outcome rates of named filters, a row counting for each one it meets."""
    rows = df.withColumn("hypothesis", F.explode(F.array_compact(F.array(*[F.when(k, n) for n, k in hypotheses.items()]))))
    return rows.groupBy("hypothesis").agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"mean_{v}") for v in values])


def config_grid_select(oof: DataFrame, regimes: list[str], directions: list[str], thresholds, buffers, least: int = 75) -> DataFrame:
    """Composite score of every configuration and the selected one; the first choice breaks ties in order."""
    cells = F.array(
        *[
            F.struct(F.lit(r).alias("regime_model"), F.lit(g).alias("direction_model"), F.lit(float(t)).alias("threshold"), F.lit(float(b)).alias("buffer"), c(r).alias("_p"), c(g).cast("double").alias("_d"))
            for r, g, t, b in product(regimes, directions, thresholds, buffers)
        ]
    )
    rows = oof.withColumn("_g", F.explode(cells)).select("*", "_g.*")
    long_side = c("_d") >= 0
    edge = F.abs("_d") - c("base_cost")
    passed = c("_p") >= c("threshold")
    cand = passed & (edge > c("buffer"))
    per = rows.groupBy("regime_model", "direction_model", "threshold", "buffer").agg(
        F.count_if(passed).alias("_pass"), F.count_if(passed & (c("regime") == 1)).alias("_tp"), F.count_if(c("regime") == 1).alias("_pos"), F.count(F.lit(1)).alias("_all"),
        F.count_if(cand).alias("candidates"), F.avg(F.when(cand, _sided(long_side, "long_base", "short_base"))).alias("expectancy"), F.avg(F.when(cand, c("movement"))).alias("movement"),
    )
    precision, recall = F.coalesce(F.try_divide("_tp", "_pass"), F.lit(0.0)), F.coalesce(F.try_divide("_tp", "_pos"), F.lit(0.0))
    base_rate = c("_pos") / c("_all")

    def clip(x: Column) -> Column:
        return F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0))

    lift = F.when(base_rate > 0, clip(F.try_divide(precision, base_rate) - 1)).otherwise(0.0)
    quality = clip(F.coalesce("movement", F.lit(0.0)) / 2 - 1)
    money = F.tanh(F.coalesce("expectancy", F.lit(0.0)) / 10)
    composite = 0.30 * lift + 0.20 * recall + 0.15 * F.least(c("candidates") / 150.0, F.lit(1.0)) + 0.20 * quality + 0.15 * money
    rows = per.withColumns({"precision": precision, "recall": recall, "composite": F.when(c("candidates") >= least, composite)})
    first_r, first_d = (c("regime_model") == regimes[0]).cast("int"), (c("direction_model") == directions[0]).cast("int")
    order = [F.round("composite", 12).desc_nulls_last(), c("candidates").desc(), first_r.desc(), first_d.desc(), "threshold", "buffer"]
    fallback = (c("regime_model") == regimes[0]) & (c("direction_model") == directions[0]) & (c("threshold") == float(thresholds[0])) & (c("buffer") == float(buffers[0]))
    alone = Window.partitionBy(F.lit(0))  # the configuration grid
    any_ok = F.count("composite").over(alone) > 0
    place = F.row_number().over(alone.orderBy(*order))
    return rows.withColumn("_place", place).withColumn("selected", F.when(any_ok, c("_place") == 1).otherwise(fallback)).drop("_pass", "_tp", "_pos", "_all", "_place")


def baseline_sides(oof: DataFrame, ident: str, seed: int = 11) -> DataFrame:
    """Random, unconditional and contrarian side rules on the same rows."""
    rules = {
        "RANDOM": hash_uniform(seed, c(ident)) < 0.5, "ALWAYS_LONG": F.lit(True), "CONTRARIAN_RETURN": c("past_return") < 0, "CONTRARIAN_RUN": c("past_run") < 0,
    }
    rows = oof.withColumn("_s", F.explode(F.array(*[F.struct(F.lit(n).alias("baseline"), m.alias("long_side")) for n, m in rules.items()]))).select("*", "_s.*")
    return rows.groupBy("baseline").agg(F.count(F.lit(1)).alias("n"), F.avg(_sided(c("long_side"), "long_base", "short_base")).alias("base"), F.avg(_sided(c("long_side"), "long_exec", "short_exec")).alias("executable"))


# -- episodes --------------------------------------------------------------------------------------
def episode_summary(episodes: DataFrame) -> DataFrame:
    dur = (c("end_us") - c("start_us")) / 1_000_000
    return episodes.agg(
        F.count(F.lit(1)).alias("episodes"), F.count_if(c("end_reason") == "RANGE_END").alias("open_at_end"), F.avg(dur).alias("mean_seconds"),
        F.percentile(dur, F.lit(0.5)).alias("median_seconds"), F.max(dur).alias("max_seconds"), F.avg("first_score").alias("mean_first_score"), F.avg("peak_score").alias("mean_peak_score"),
    )


def direction_diagnostics(df: DataFrame, original: str, inverse: str, moment: str) -> DataFrame:
    """Accuracy and expectancy of the signal's side and of the opposite side."""
    rows = df.select(moment, F.explode(F.array(*[F.struct(F.lit(n).alias("direction"), c(x).alias("r")) for n, x in (("ORIGINAL", original), ("INVERSE", inverse))])).alias("d"))
    rows = rows.filter("d.r IS NOT NULL")
    return rows.groupBy(moment, "d.direction").agg(F.count(F.lit(1)).alias("n"), F.avg((c("d.r") > 0).cast("double")).alias("accuracy"), F.avg("d.r").alias("expectancy"))


def group_diagnostics(df: DataFrame, categories, values, least: int = 30) -> DataFrame:
    """Means per value of every categorical column."""
    rows = melt_text(df, values, categories)
    out = rows.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"mean_{v}") for v in values])
    return out.withColumn("sample_sufficient", c("n") >= least)


def cost_feasibility(df: DataFrame, mfe: str, cost: str) -> DataFrame:
    """Average cost, favourable move over it, and the share of rows that move beyond it."""
    mean = df.agg(F.avg(cost).alias("average_cost"))  # one row
    rows = df.join(F.broadcast(mean))
    return rows.agg(
        F.first("average_cost").alias("average_cost"), F.avg(c(mfe)).alias("average_mfe"), F.avg((c(mfe) > c("average_cost")).cast("double")).alias("share_above_cost"),
    ).withColumn("mfe_to_cost", c("average_mfe") / c("average_cost"))


# -- comparisons and verdicts ----------------------------------------------------------------------
def compare_runs(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Original, new and difference of ``value`` per metric; metrics of one run only are kept."""
    x, y = a.withColumnRenamed("value", "original"), b.withColumnRenamed("value", "revised")
    return x.join(y, list(keys), "full").withColumn("delta", c("revised") - c("original"))


def frames_identical(a: DataFrame, b: DataFrame, keys, numeric, exact, tolerance: float) -> DataFrame:
    """Unmatched rows, largest difference per number and equality of labels, from one keyed full join."""
    keys = list(keys)
    x = a.select(*keys, *[c(n).alias(f"_a_{n}") for n in (*numeric, *exact)], F.lit(1).alias("_ia"))
    y = b.select(*keys, *[c(n).alias(f"_b_{n}") for n in (*numeric, *exact)], F.lit(1).alias("_ib"))
    both = x.join(y, keys, "full")
    out = both.agg(
        F.count_if(c("_ia").isNull() | c("_ib").isNull()).alias("unmatched"),
        *[F.max(F.abs(c(f"_a_{n}") - c(f"_b_{n}"))).alias(f"max_{n}") for n in numeric],
        *[F.bool_and(c(f"_a_{n}").eqNullSafe(c(f"_b_{n}"))).alias(f"same_{n}") for n in exact],
    )
    ok = c("unmatched") == 0
    for n in numeric:
        ok = ok & (F.coalesce(f"max_{n}", F.lit(0.0)) <= tolerance)
    for n in exact:
        ok = ok & c(f"same_{n}")
    return out.withColumn("identical", ok)


def verdict(metrics: DataFrame, checks: dict[str, Column], rules: list[tuple[str, Column]], otherwise: str) -> DataFrame:
    """Named boolean checks of a one-row report and the first matching conclusion."""
    out = metrics.withColumns({n: F.coalesce(k, F.lit(False)) for n, k in checks.items()})
    result = F.lit(otherwise)
    for name, when in reversed(rules):
        result = F.when(when, name).otherwise(result)
    return out.withColumn("conclusion", result)
