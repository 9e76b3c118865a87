"""Walk-forward model pipelines on Spark ML: folds, purging, preparation, fits, out-of-fold predictions.

Fitting, scoring and every statistic run on the cluster; the driver only loops over the few folds and
holds fitted parameters (vectors as long as the feature list).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteloom.functions.draws import hash_uniform
from quoteloom.functions.timing import DAY, cell
from quoteloom.operators import ranks as R
from quoteloom.operators.evidence import binary_metrics, calibration_count, melt
from quoteloom.session import durable

c = F.col

# fixed values: time fractions of the published fold schemes
FOLD_CUTS = {"three": (0.7, 0.8, 0.9, 1.0), "four": (0.6, 0.7, 0.8, 0.9, 1.0), "development": (0.3, 0.4, 0.5, 0.6, 1.0), "nested": (0.4, 0.6, 0.8, 1.0)}


# -- folds -----------------------------------------------------------------------------------------
def boundaries(start_us: int, end_us: int, cuts) -> list[int]:
    return [start_us + int((end_us - start_us) * f) for f in cuts]


def expanding_folds(df: DataFrame, start_us: int, end_us: int, cuts) -> DataFrame:
    """Validation fold of each row (1..), 0 before the first cut; fold k trains on all rows before it."""
    b = boundaries(start_us, end_us, cuts)
    fold = F.lit(0)
    for k in range(len(b) - 1):
        fold = F.when((c("us") >= b[k]) & (c("us") < b[k + 1]), k + 1).otherwise(fold)
    return df.withColumn("fold", fold)


def fold_rows(df: DataFrame, start_us: int, end_us: int, cuts, label_span: int = 0) -> DataFrame:
    """Every row once per fold it serves, as train, purged or validation.

    A train row is purged when its label ends after the validation starts.
    """
    b = boundaries(start_us, end_us, cuts)
    roles = []
    for k in range(len(b) - 1):
        role = (
            F.when((c("us") >= b[k]) & (c("us") < b[k + 1]), "validation")
            .when(c("us") < b[k], F.when(c("us") + label_span <= b[k], "train").otherwise("purged"))
        )
        roles.append(F.when(role.isNotNull(), F.struct(F.lit(k + 1).alias("fold"), role.alias("role"), F.lit(b[k]).alias("validation_us"))))
    return df.withColumn("_f", F.explode(F.array_compact(F.array(*roles)))).select("*", "_f.*").drop("_f")


def purge_audit(rows: DataFrame, label_span: int) -> DataFrame:
    """Counts per fold and the invariant that no kept label reaches into the validation."""
    kept = c("role") == "train"
    out = rows.groupBy("fold").agg(
        F.count_if(kept | (c("role") == "purged")).alias("original"),
        F.count_if(c("role") == "purged").alias("purged"),
        F.count_if(kept).alias("retained"),
        F.count_if(c("role") == "validation").alias("validation"),
        F.max(F.when(kept, c("us") + label_span)).alias("last_label_us"),
        F.max("validation_us").alias("validation_us"),
    )
    ok = c("last_label_us").isNull() | (c("last_label_us") <= c("validation_us"))
    return out.withColumn("invariant", ok)


def nested_folds(rows: DataFrame, start_us: int, label_span: int, cuts=FOLD_CUTS["nested"]) -> DataFrame:
    """Inner folds of the outer train span of each fold, purged; all outer folds in one pass."""
    span = c("validation_us") - start_us
    marks = [F.lit(start_us) + F.floor(span * f).cast("long") for f in cuts]
    roles = []
    for k in range(len(cuts) - 1):
        role = F.when((c("us") >= marks[k]) & (c("us") < marks[k + 1]), "validation").when(
            c("us") < marks[k], F.when(c("us") + label_span <= marks[k], "train").otherwise("purged")
        )
        roles.append(F.when(role.isNotNull(), F.struct(F.lit(k + 1).alias("inner_fold"), role.alias("inner_role"))))
    train = rows.filter("role = 'train'")
    return train.withColumn("_f", F.explode(F.array_compact(F.array(*roles)))).select("*", "_f.*").drop("_f")


# -- preparation -----------------------------------------------------------------------------------
def prep_scale_onehot(numeric: list[str], categorical: list[str]) -> Pipeline:
    """Standard scaling and one-hot coding, unknown categories kept apart; fit on train rows only."""
    index = [StringIndexer(inputCol=x, outputCol=f"{x}_i", handleInvalid="keep") for x in categorical]
    hot = [OneHotEncoder(inputCols=[f"{x}_i" for x in categorical], outputCols=[f"{x}_h" for x in categorical])] if categorical else []
    join = VectorAssembler(inputCols=numeric, outputCol="_num", handleInvalid="error")
    scale = StandardScaler(inputCol="_num", outputCol="_scaled", withMean=True, withStd=True)
    final = VectorAssembler(inputCols=["_scaled", *[f"{x}_h" for x in categorical]], outputCol="features")
    return Pipeline(stages=[*index, *hot, join, scale, final])


@dataclass
class RobustPrep:
    """Median imputation, clipping at two quantiles, scaling, near-constant removal, clipping at ten; parameters per fold."""

    parameters: dict[int, dict[str, tuple[float, float, float, float, float]]]

    @classmethod
    def table(cls, train: DataFrame, features: list[str], low: float = 0.005, high: float = 0.995, keys=()) -> DataFrame:
        """Parameters per key and feature, from exact quantiles; all keys in one job. Equal values are counted first, all else reads the counts."""
        by, n = [*keys, "feature"], c("_n")
        counts = durable(melt(train, keys, features).groupBy(*by, "x").agg(F.count(F.lit(1)).alias("_n")))
        med = R.exact_quantiles(counts, by, "x", {"median": 0.5}, n)
        filled = durable(counts.join(F.broadcast(med), by).withColumn("x", F.coalesce("x", "median")))  # one row per key and feature
        q = R.exact_quantiles(filled, by, "x", {"lower": low, "upper": high}, n)
        clipped = filled.join(F.broadcast(q), by).withColumn("x", F.least(F.greatest("x", "lower"), c("upper")))
        mean = clipped.groupBy(*by).agg((F.sum(n * c("x")) / F.sum(n)).alias("mean"))
        off = c("x") - c("mean")
        return clipped.join(F.broadcast(mean), by).groupBy(*by).agg(
            F.first("median").alias("median"), F.first("lower").alias("lower"), F.first("upper").alias("upper"), F.first("mean").alias("mean"), F.sqrt(F.sum(n * off * off) / F.sum(n)).alias("scale")
        )

    @classmethod
    def fit(cls, train: DataFrame, features: list[str], fold: str = "fold") -> RobustPrep:
        found: dict[int, dict] = {}
        for r in cls.table(train, features, keys=[fold]).collect():  # one row per fold and feature
            found.setdefault(r[fold], {})[r["feature"]] = (r["median"], r["lower"], r["upper"], r["mean"], r["scale"])
        return cls(found)

    def active(self, fold: int) -> list[str]:
        """Features that vary in the train rows of a fold."""
        return sorted(f for f, p in self.parameters.get(fold, {}).items() if p[4] is not None and p[4] >= 1e-8)

    def transform(self, df: DataFrame, features: list[str], fold: str = "fold") -> DataFrame:
        """Adds ``z_<feature>`` by the parameters of each row's fold; 0 where the feature does not vary there."""
        out = {}
        for f in features:
            x, z = c(f).cast("double"), F.lit(0.0)
            for k in sorted(self.parameters):
                if f in self.active(k):
                    med, lo, hi, mean, scale = self.parameters[k][f]
                    inside = F.least(F.greatest(F.coalesce(x, F.lit(med)), F.lit(lo)), F.lit(hi))
                    z = F.when(c(fold) == k, F.least(F.greatest((inside - mean) / scale, F.lit(-10.0)), F.lit(10.0))).otherwise(z)
            out[f"z_{f}"] = z
        return df.withColumns(out)


def assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="error").transform(df)


# -- estimators ------------------------------------------------------------------------------------
def logistic(n: int, label: str, strength: float = 1.0, classes: int = 2) -> LogisticRegression:
    """Ridge-penalised logistic model; the penalty is per row, hence the division by the row count."""
    return LogisticRegression(
        labelCol=label, regParam=1.0 / (strength * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=500, family="binomial" if classes == 2 else "multinomial"
    )


def class_probabilities(model: LogisticRegressionModel, columns: list[str]) -> list[Column]:
    """Probability of each class by the fitted coefficients.

    The model itself stays on the driver: it carries its training summary and so the session, which cannot be sent to tasks once a
    query of the session was observed.
    """
    weights, starts = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    margins = [sum((c(x) * float(b) for x, b in zip(columns, row, strict=True)), F.lit(float(a))) for row, a in zip(weights, starts, strict=True)]
    if len(margins) == 1:
        p = 1 / (1 + F.exp(-margins[0]))
        return [1 - p, p]
    top = F.greatest(*margins)
    shares = [F.exp(F.when(m == top, 0.0).otherwise(m - top)) for m in margins]  # the only class of a fold has an infinite margin
    total = sum(shares[1:], shares[0])
    return [s / total for s in shares]


def boosted(label: str, classifier: bool, rounds: int = 50, depth: int = 3, rate: float = 0.08):
    """Boosted trees on ``counted_rows``."""
    kind = GBTClassifier if classifier else GBTRegressor
    return kind(labelCol=label, weightCol="_weight", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=7)


def counted_rows(train: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Train rows that agree in all features and the label as one, with their number as ``_weight``: a tree's sums are the same, its rounds read each kind once."""
    return durable(train.groupBy(*columns, label).agg(F.count(F.lit(1)).cast("double").alias("_weight")))


def elastic_net(label: str, alpha: float, l1: float) -> LinearRegression:
    return LinearRegression(labelCol=label, regParam=alpha, elasticNetParam=l1, standardization=False)


def gram(df: DataFrame, columns: list[str], label: str, key: str | None = None) -> DataFrame:
    """Sums of products of all column pairs (with an intercept and the label) per value of ``key``, one partial table per task and value."""
    names = [*columns, label]
    p = len(names) + 1

    def partial(batches):
        totals: dict = {}
        for pdf in batches:
            for k, part in pdf.groupby("_key"):
                x = np.column_stack([np.ones(len(part)), part[names].to_numpy(dtype=float)])
                totals[k] = totals.get(k, 0) + x.T @ x
        i, j = np.indices((p, p))
        for k, total in totals.items():
            yield pd.DataFrame({"_key": k, "i": i.ravel().astype("int32"), "j": j.ravel().astype("int32"), "v": total.ravel()})

    rows = df.select((c(key) if key else F.lit(0)).cast("int").alias("_key"), *[c(x).cast("double").alias(x) for x in names]).dropna()
    return rows.mapInPandas(partial, "_key int, i int, j int, v double").groupBy("_key", "i", "j").agg(F.sum("v").alias("v"))


def gram_matrices(df: DataFrame, columns: list[str], label: str, key: str | None = None) -> dict[int, np.ndarray]:
    """The Gram table per key as matrices (intercept first, label last); keys x p squared numbers leave Spark."""
    size = len(columns) + 2
    out: dict[int, np.ndarray] = {}
    for r in gram(df, columns, label, key).collect():
        out.setdefault(r["_key"], np.zeros((size, size)))[r["i"], r["j"]] = r["v"]
    return out


def sweep(a: np.ndarray, k: int) -> np.ndarray:
    """The sweep operator on row and column ``k``: it takes a column into the regression, and out again when applied twice."""
    d = a[k, k]
    out = a - np.outer(a[:, k], a[k]) / d
    out[k], out[:, k] = a[k] / d, -a[:, k] / d
    out[k, k] = 1 / d
    return out


def ridge_models(g: np.ndarray, columns: list[str], alpha: float, without: dict[str, list[str]] | None = None) -> dict[str, dict[str, float]]:
    """Coefficients of the full ridge model ("") and of those without each group of columns, all from one Gram matrix.

    The intercept is not penalised. A column without variance and penalty stays out, with coefficient 0.
    """
    names = ["intercept", *columns]
    a = g + np.diag([0.0, *[alpha] * len(columns), 0.0])
    usable = {k for k in range(len(names)) if a[k, k] > 1e-12}
    swept: set[int] = set()
    for k in sorted(usable):
        if a[k, k] > 1e-9 * max(g[k, k], 1e-300):  # not a combination of the columns before it
            a, swept = sweep(a, k), swept | {k}

    def read(m: np.ndarray, inside: set[int]) -> dict[str, float]:
        return {n: float(m[k, -1]) if k in inside else 0.0 for k, n in enumerate(names)}

    out = {"": read(a, swept)}
    for group, gone in (without or {}).items():
        m, inside = a, swept
        for k in (names.index(x) for x in gone):
            if k in inside:
                m, inside = sweep(m, k), inside - {k}
        out[group] = read(m, inside)
    return out


def ridge(df: DataFrame, columns: list[str], label: str, alpha: float = 1.0) -> dict[str, float]:
    """Ridge coefficients from the Gram table."""
    return ridge_models(gram_matrices(df, columns, label)[0], columns, alpha)[""]


def linear_score(df: DataFrame, beta: dict[str, float], name: str = "prediction") -> DataFrame:
    total = F.lit(beta["intercept"])
    for f, b in beta.items():
        if f != "intercept":
            total = total + c(f).cast("double") * b
    return df.withColumn(name, total)


def coefficients(beta: dict[str, float], spark, top: int = 20) -> DataFrame:
    """Largest coefficients by absolute value, from a fitted parameter vector."""
    rows = [(f, float(b)) for f, b in beta.items() if f != "intercept"]
    return spark.createDataFrame(rows, "feature string, coefficient double").orderBy(F.abs("coefficient").desc(), "feature").limit(top)


# -- predictions -----------------------------------------------------------------------------------
def prepared_folds(df: DataFrame, features: list[str], start_us: int, end_us: int, cuts, label_span: int) -> tuple[DataFrame, RobustPrep]:
    """Purged train and validation rows of all folds with ``z_<feature>`` prepared on each fold's train rows, written once."""
    rows = durable(fold_rows(df, start_us, end_us, cuts, label_span).filter("role <> 'purged'"))
    prep = RobustPrep.fit(rows.filter("role = 'train'"), features)
    return durable(prep.transform(rows, features)), prep


def by_fold(betas: dict[int, dict[str, float]], columns: list[str], fold: str = "fold"):
    """Linear score of each row by the coefficients of its fold; columns that are 0 in a fold cost nothing there."""
    score = F.lit(None).cast("double")
    for k, beta in sorted(betas.items()):
        total = F.lit(beta.get("intercept", 0.0))
        for x in columns:
            if beta.get(x):
                total = total + c(x) * beta[x]
        score = F.when(c(fold) == k, total).otherwise(score)
    return score


@dataclass(frozen=True)
class ModelSettings:
    """Penalties and sizes; the defaults are the three-outcome study's, ``EVENT_STUDY`` has those of the event study."""

    strength: float = 1.0  # inverse penalty of the logistic models
    alpha: float = 1.0  # penalty of ridge
    net_alpha: float = 0.001  # and of the elastic net
    net_share: float = 0.5
    rounds: int = 50
    depth: int = 3
    rate: float = 0.08


# fixed values: the published parameters of the event study
EVENT_STUDY = ModelSettings(strength=0.1, alpha=10.0, rounds=75, rate=0.05)
MODELS = ("ridge", "elastic_net", "logistic", "multinomial", "boosted", "boosted_regressor")


def oof_predictions(
    df: DataFrame, features: list[str], label: str, start_us: int, end_us: int, cuts, label_span: int, model: str = "logistic", settings: ModelSettings = ModelSettings(), classes: int = 2
) -> DataFrame:
    """Fit per fold on purged train rows, keep only the out-of-fold rows with all their columns and ``prediction``.

    Folds are prepared in one job. Ridge takes all folds from one Gram table; of the other models each fold's predictions are
    written before the next is fitted, so no result holds a fitted model. Boosted trees see the unscaled features, as
    published, and equal train rows as one with a weight; ``multinomial`` adds ``probabilities``, and its prediction is the likeliest class.
    """
    if model not in MODELS:
        raise ValueError(f"model must be one of {MODELS}")
    rows, prep = prepared_folds(df, features, start_us, end_us, cuts, label_span)
    z = [f"z_{f}" for f in features]
    train, valid = rows.filter("role = 'train'"), rows.filter("role = 'validation'")
    if model == "ridge":
        matrices = gram_matrices(train, z, label, "fold")
        betas = {k: ridge_models(g, z, settings.alpha)[""] for k, g in matrices.items()}
        return valid.withColumn("prediction", by_fold(betas, z)).drop("role", "validation_us", *z)
    counts = {r["fold"]: r["n"] for r in train.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per fold
    parts = []
    for k in sorted(counts):
        used = prep.active(k)
        columns = used if model.startswith("boosted") else [f"z_{f}" for f in used]
        fill = {f: prep.parameters[k][f][0] for f in used}
        t, v = (x.filter(c("fold") == k).fillna(fill) for x in (train, valid))
        t, v = (assembled(x, columns) for x in (counted_rows(t, columns, label) if model.startswith("boosted") else t, v))
        estimator = {
            "logistic": lambda n=counts[k]: logistic(n, label, settings.strength),
            "multinomial": lambda n=counts[k]: logistic(n, label, settings.strength, max(classes, 3)),
            "elastic_net": lambda: elastic_net(label, settings.net_alpha, settings.net_share),
            "boosted": lambda: boosted(label, True, settings.rounds, settings.depth, settings.rate),
            "boosted_regressor": lambda: boosted(label, False, settings.rounds, settings.depth, settings.rate),
        }[model]()
        fitted = estimator.fit(t)
        if model == "logistic":
            scored = v.withColumn("prediction", class_probabilities(fitted, columns)[1])
        elif model == "multinomial":
            scored = v.withColumn("probabilities", F.array(*class_probabilities(fitted, columns)))
            likeliest = F.array_position("probabilities", F.array_max("probabilities")) - 1
            scored = scored.withColumn("prediction", likeliest.cast("double"))
        elif model == "boosted":
            scored = fitted.transform(v).withColumn("prediction", vector_to_array("probability")[1])
        else:
            scored = fitted.transform(v)
        parts.append(durable(scored.drop("features", "rawPrediction", "probability", "role", "validation_us", *z)))
    if not parts:
        empty = valid.drop("role", "validation_us", *z).withColumn("prediction", F.lit(None).cast("double"))
        return empty.withColumn("probabilities", F.array().cast("array<double>")) if model == "multinomial" else empty
    return reduce(DataFrame.unionByName, parts)


def expected_value(pred: DataFrame, train: DataFrame, probabilities: dict[str, str], outcome: str, pnl: str, keys=()) -> DataFrame:
    """Sum of outcome probabilities times the train payoff of that outcome; the overall mean where one is missing."""
    keys = list(keys)
    pay = train.groupBy(*keys).agg(
        *[F.coalesce(F.avg(F.when(c(outcome) == n, c(pnl))), F.avg(pnl)).alias(f"_pay_{n}") for n in probabilities]
    )
    both = pred.join(pay, keys) if keys else pred.join(F.broadcast(pay))  # one row without keys
    ev = sum((c(p) * c(f"_pay_{n}") for n, p in probabilities.items()), F.lit(0.0))
    return both.withColumn("expected_value", ev).drop(*[f"_pay_{n}" for n in probabilities])


def safety_buffer(pred: DataFrame, predicted: str, actual: str, keys=(), z: float = 1.645) -> DataFrame:
    """Margin against over-prediction from the daily mean residuals."""
    days = pred.groupBy(*keys, cell("us", DAY).alias("_day")).agg(F.avg(c(actual) - c(predicted)).alias("_r"))
    se = F.coalesce(F.stddev_samp("_r") / F.sqrt(F.count("_r")), F.lit(0.0))
    return days.groupBy(*keys).agg(
        F.count("_r").alias("days"), F.avg("_r").alias("mean_residual"), se.alias("standard_error"), F.greatest(F.lit(0.0), -F.avg("_r") + z * se).alias("buffer")
    )


def dealt_again(rows: DataFrame, keys, groups: dict[str, str], ident: str, repeats: int) -> DataFrame:
    """``keys, ident, group, repeat, dealt``: the column of each group dealt anew over the rows of a key, ``repeats`` times, by hash orders."""
    keys = list(keys)
    base = durable(R.ordered_index(rows.select(*keys, ident, *groups.values()), keys, ident, ident, "_rn").drop("_rn_n"))
    variants = [F.struct(F.lit(g).alias("group"), F.lit(k).alias("repeat"), hash_uniform(k + 1, c(ident)).alias("u"), c(x).alias("x")) for g, x in groups.items() for k in range(repeats)]
    deals = base.select(*keys, ident, F.explode(F.array(*variants)).alias("_v")).select(*keys, ident, "_v.*")
    dealt = R.ordered_index(deals, [*keys, "group", "repeat"], "u", ident, "_rn").select(*keys, "group", "repeat", "_rn", c("x").alias("dealt"))
    return base.select(*keys, ident, "_rn").join(dealt, [*keys, "_rn"]).drop("_rn")


def group_importance(rows: DataFrame, groups: dict[str, list[str]], label: str, ident: str, alpha: float = 1.0, repeats: int = 3) -> DataFrame:
    """Loss of rank correlation on held-out rows of ridge models: with a feature group dealt anew there, and fitted without the group.

    ``rows`` hold ``fold``, ``role`` (train or validation) and the prepared columns. All folds, groups and repeats share one Gram table
    (ablations are swept out of it), one dealing of partial scores and one ranking. The result averages folds and repeats.
    """
    columns = [x for g in groups.values() for x in g]
    train, valid = rows.filter("role = 'train'"), rows.filter("role = 'validation'")
    models = {k: ridge_models(g, columns, alpha, groups) for k, g in gram_matrices(train, columns, label, "fold").items()}
    full = {k: m[""] for k, m in models.items()}
    scores = {f"_without_{g}": by_fold({k: m[g] for k, m in models.items()}, columns) for g in groups}
    shares = {f"_of_{g}": by_fold({k: {x: m[x] for x in own} for k, m in full.items()}, own) for g, own in groups.items()}
    held = durable(valid.select("fold", c(ident).alias("_id"), c(label).cast("double").alias("y"), by_fold(full, columns).alias("_all"), *[e.alias(n) for n, e in {**scores, **shares}.items()]))
    fixed = [F.struct(F.lit("ALL").alias("feature_group"), F.lit("BASE").alias("kind"), F.lit(0).alias("repeat"), c("_all").alias("x"))]
    fixed += [F.struct(F.lit(g).alias("feature_group"), F.lit("ABLATED").alias("kind"), F.lit(0).alias("repeat"), c(f"_without_{g}").alias("x")) for g in groups]
    plain = held.select("fold", "y", F.explode(F.array(*fixed)).alias("_v")).select("fold", "y", "_v.*")
    dealt = dealt_again(held, ["fold"], {g: f"_of_{g}" for g in groups}, "_id", repeats).join(held, ["fold", "_id"])
    own = F.lit(0.0)
    for g in groups:
        own = F.when(c("group") == g, c(f"_of_{g}")).otherwise(own)
    moved = dealt.select("fold", "y", c("group").alias("feature_group"), F.lit("PERMUTED").alias("kind"), "repeat", (c("_all") - own + c("dealt")).alias("x"))
    # scores are compared to six decimals, so that float dust splits no ties
    compared = plain.unionByName(moved).withColumn("x", F.round("x", 6))
    ranked = R.spearman_long(compared, ["fold", "feature_group", "kind", "repeat"])
    per_fold = durable(ranked.select("fold", "feature_group", "kind", F.coalesce("rho", F.lit(0.0)).alias("rho")))
    base = per_fold.filter("kind = 'BASE'").select("fold", c("rho").alias("_base"))
    both = per_fold.filter("kind <> 'BASE'").join(base, "fold")
    return both.groupBy("feature_group", "kind").agg(F.avg("rho").alias("rho"), F.avg(c("_base") - c("rho")).alias("importance"))


def model_diagnostics(oof: DataFrame, p: str, y: str, pnl: str, tie: str, keys=("fold",)) -> DataFrame:
    """Average precision, Brier score, worst calibration gap and rank correlation with the payoff."""
    keys = list(keys)
    base = binary_metrics(oof, p, y, keys).select(*keys, "n", "average_precision", "brier", "base_rate")
    cal = calibration_count(oof, p, y, tie, keys).groupBy(*keys).agg(F.max(F.abs("difference")).alias("worst_gap"))
    long = oof.select(*keys, c(p).cast("double").alias("x"), c(pnl).cast("double").alias("y"))
    return base.join(cal, keys).join(R.spearman_long(long, keys).select(*keys, "rho"), keys)
