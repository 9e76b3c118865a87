"""Walk-forward pipelines on the scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quoteloom.catalog.evidence import BIN_SQL, OOF, oof, rho_sql
from quoteloom.catalog.ingest import END, START
from quoteloom.catalog.registry import PREDICTIONS, register, with_views
from quoteloom.functions.output import round_doubles
from quoteloom.functions.timing import DAY, HOUR
from quoteloom.operators import models as M
from quoteloom.sources.views import predictions


def ridge_ctes(name: str, src: str, columns: list[str], label: str, alpha: float, key: str) -> str:
    """CTEs that end in ``<name>`` with ``key, b0`` (intercept) ``, b1, ...``: the normal equations, solved one pivot after the other."""
    x = ["1", *columns]
    n = len(x)
    pairs = [(i, j) for i in range(n) for j in range(n)]
    cells = [f"sum(CAST({x[i]} AS DOUBLE) * {x[j]}) + {alpha if i == j and i else 0} AS a{i}_{j}" for i, j in pairs]
    cells += [f"sum(CAST({x[i]} AS DOUBLE) * {label}) AS a{i}_{n}" for i in range(n)]
    ctes = [f"{name}_s0 AS (SELECT {key}, {', '.join(cells)} FROM {src} GROUP BY {key})"]
    for k in range(n):
        step = [
            (f"a{k}_{j} / a{k}_{k}" if i == k else f"a{i}_{j} - a{i}_{k} * a{k}_{j} / a{k}_{k}") + f" AS a{i}_{j}" for i in range(n) for j in range(n + 1)
        ]
        ctes.append(f"{name}_s{k + 1} AS (SELECT {key}, {', '.join(step)} FROM {name}_s{k})")
    betas = ", ".join(f"a{i}_{n} AS b{i}" for i in range(n))
    return ",\n".join([*ctes, f"{name} AS (SELECT {key}, {betas} FROM {name}_s{n})"])


def ridge_score(columns: list[str], table: str) -> str:
    return f"{table}.b0 + " + " + ".join(f"{c} * {table}.b{i + 1}" for i, c in enumerate(columns))


CUTS = M.FOLD_CUTS["three"]
B = M.boundaries(START, END, CUTS)
SPAN = 6 * HOUR
FEATURES = ["user_id", "past_return", "past_run", "pred_mfe"]


def pv(*extra: str) -> str:
    return with_views(PREDICTIONS, *extra)


@register(
    "m1_expanding_folds",
    pv() + f"SELECT CASE WHEN us < {B[0]} THEN 0 WHEN us < {B[1]} THEN 1 WHEN us < {B[2]} THEN 2 WHEN us < {B[3]} THEN 3 ELSE 0 END AS fold, count(*) AS n, min(us) AS first_us FROM predictions GROUP BY 1",
)
def m1(spark, d):
    return M.expanding_folds(predictions(spark, d).drop("fold"), START, END, CUTS).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"))


@register(
    "m2_purge_audit",
    pv()
    + f""", b AS (SELECT unnest([1, 2, 3]) AS fold, unnest([{B[0]}, {B[1]}, {B[2]}]) AS lo, unnest([{B[1]}, {B[2]}, {B[3]}]) AS hi)
    SELECT b.fold, count(CASE WHEN us < lo THEN 1 END) AS original, count(CASE WHEN us < lo AND us + {SPAN} > lo THEN 1 END) AS purged, count(CASE WHEN us + {SPAN} <= lo THEN 1 END) AS retained, count(CASE WHEN us >= lo AND us < hi THEN 1 END) AS validation,
      max(CASE WHEN us + {SPAN} <= lo THEN us + {SPAN} END) AS last_label_us, any_value(lo) AS validation_us, true AS invariant FROM predictions, b GROUP BY b.fold""",
)
def m2(spark, d):
    return M.purge_audit(M.fold_rows(predictions(spark, d).drop("fold"), START, END, CUTS, SPAN), SPAN)


@register(
    "m3_nested_folds",
    pv()
    + f""", b AS (SELECT unnest([1, 2, 3]) AS ofold, unnest([{B[0]}, {B[1]}, {B[2]}]) AS vu), t AS (SELECT b.ofold, vu, us FROM predictions, b WHERE us + {SPAN} <= vu),
    k AS (SELECT ofold AS fold, us, inner_fold, {START} + CAST(floor((vu - {START}) * lo) AS BIGINT) AS a, {START} + CAST(floor((vu - {START}) * hi) AS BIGINT) AS z
      FROM t, (SELECT unnest([1, 2, 3]) AS inner_fold, unnest([CAST(0.4 AS DOUBLE), 0.6, 0.8]) AS lo, unnest([CAST(0.6 AS DOUBLE), 0.8, 1.0]) AS hi))
    SELECT fold, inner_fold, CASE WHEN us >= a THEN 'validation' WHEN us + {SPAN} <= a THEN 'train' ELSE 'purged' END AS inner_role, count(*) AS n FROM k WHERE us < z GROUP BY ALL""",
)
def m3(spark, d):
    rows = M.fold_rows(predictions(spark, d).drop("fold"), START, END, CUTS, SPAN)
    return M.nested_folds(rows, START, SPAN).groupBy("fold", "inner_fold", "inner_role").agg(F.count(F.lit(1)).alias("n"))


@register("m4_prep_scale_onehot")
def m4(spark, d):
    rows = oof(spark, d)
    model = M.prep_scale_onehot(["pred", "pred_mfe"], ["session", "side"]).fit(rows.filter("fold < 4"))
    out = model.transform(rows).select("session", "side", M.vector_to_array("features").alias("f"))
    return round_doubles(out.groupBy("session", "side").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("f")[0]).alias("mean_pred"), F.avg(F.size("f")).alias("width")))


@register(
    "m5_prep_robust",
    pv(OOF)
    + """, l AS (SELECT unnest([{'f': 'user_id', 'x': CAST(user_id AS DOUBLE)}, {'f': 'market', 'x': CASE WHEN user_id > 5 THEN market END}]) AS m FROM oof), a AS (SELECT m.f AS feature, m.x AS x FROM l), md AS (SELECT feature, median(x) AS median FROM a GROUP BY 1),
    b AS (SELECT feature, coalesce(x, median) AS x, median FROM a JOIN md USING (feature)), q AS (SELECT feature, quantile_cont(x, 0.005) AS lower, quantile_cont(x, 0.995) AS upper FROM b GROUP BY 1)
    SELECT feature, round(any_value(median), 6) AS median, round(any_value(lower), 6) AS lower, round(any_value(upper), 6) AS upper, round(avg(least(greatest(x, lower), upper)), 6) AS mean, round(stddev_pop(least(greatest(x, lower), upper)), 6) AS scale
    FROM b JOIN q USING (feature) GROUP BY feature""",
)
def m5(spark, d):
    rows = oof(spark, d).withColumn("market", F.when(F.col("user_id") > 5, F.col("market")))
    return round_doubles(M.RobustPrep.table(rows, ["user_id", "market"]))


def modelled(spark, d):
    """What the models read; the folds are written once per row and fold they serve."""
    return oof(spark, d).select("us", *FEATURES, "market", "value", F.col("regime").cast("double").alias("label"))


@register("m6_logistic_oof")
def m6(spark, d):
    out = M.oof_predictions(modelled(spark, d), FEATURES, "label", START, END, CUTS, SPAN, "logistic")
    return round_doubles(out.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("mean_probability"), F.avg("label").alias("base_rate")), 4)


@register("m7_boosted_oof")
def m7(spark, d):
    out = M.oof_predictions(modelled(spark, d), FEATURES, "market", START, END, CUTS, SPAN, "boosted_regressor")
    return round_doubles(out.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("mean_prediction"), F.avg("market").alias("mean_actual")), 4)


@register(
    "m8_ridge_simple",
    pv(OOF)
    + """, g AS (SELECT count(*) AS n, sum(pred_mfe) AS sx, sum(market) AS sy, sum(pred_mfe * pred_mfe) + 10 AS sxx, sum(pred_mfe * market) AS sxy FROM oof)
    SELECT 'pred_mfe' AS feature, round((n * sxy - sx * sy) / (n * sxx - sx * sx), 6) AS coefficient FROM g""",
)
def m8(spark, d):
    return round_doubles(M.coefficients(M.ridge(oof(spark, d), ["pred_mfe"], "market", 10.0), spark))


def folds_sql(features: list[str]) -> str:
    """CTE ``zed``: rows of the three folds with role and prepared features ``z1, ...``."""
    bounds = f"b AS (SELECT unnest([1, 2, 3]) AS k, unnest([{B[0]}, {B[1]}, {B[2]}]) AS lo, unnest([{B[1]}, {B[2]}, {B[3]}]) AS hi)"
    rows = f"""fr AS (SELECT oof.* EXCLUDE (fold), k AS fold, CASE WHEN us >= lo THEN 'validation' ELSE 'train' END AS role FROM oof, b
      WHERE us < hi AND (us >= lo OR us + {SPAN} <= lo))"""
    cuts = ", ".join(f"quantile_cont(CAST({f} AS DOUBLE), 0.005) AS l{i}, quantile_cont(CAST({f} AS DOUBLE), 0.995) AS u{i}" for i, f in enumerate(features, 1))
    inside = [f"least(greatest({f}, l{i}), u{i})" for i, f in enumerate(features, 1)]
    scale = ", ".join(f"avg({x}) AS m{i}, stddev_pop({x}) AS s{i}" for i, x in enumerate(inside, 1))
    z = ", ".join(f"CASE WHEN s{i} >= 1e-8 THEN least(greatest(({x} - m{i}) / s{i}, -10), 10) ELSE 0 END AS z{i}" for i, x in enumerate(inside, 1))
    return f"""{bounds}, {rows}, q AS (SELECT fold, {cuts} FROM fr WHERE role = 'train' GROUP BY fold),
    m AS (SELECT fold, {scale} FROM fr JOIN q USING (fold) WHERE role = 'train' GROUP BY fold), zed AS (SELECT fr.*, {z} FROM fr JOIN q USING (fold) JOIN m USING (fold)),
    tr AS (SELECT * FROM zed WHERE role = 'train')"""


Z = [f"z{i + 1}" for i in range(len(FEATURES))]


@register(
    "m8_ridge_oof",
    pv(OOF, folds_sql(FEATURES), ridge_ctes("beta", "tr", Z, "market", 1.0, "fold"))
    + f"""SELECT zed.fold, count(*) AS n, round(avg({ridge_score(Z, 'beta')}), 6) AS mean_prediction, round(avg(market), 6) AS mean_actual
    FROM zed JOIN beta USING (fold) WHERE role = 'validation' GROUP BY zed.fold""",
)
def m8o(spark, d):
    out = M.oof_predictions(modelled(spark, d), FEATURES, "market", START, END, CUTS, SPAN, "ridge")
    return round_doubles(out.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("mean_prediction"), F.avg("market").alias("mean_actual")))


@register(
    "m9_expected_value",
    pv(OOF)
    + """, t AS (SELECT *, CASE WHEN value > 66 THEN 'TARGET' WHEN value > 33 THEN 'STOP' ELSE 'NEITHER' END AS oc FROM oof),
    p AS (SELECT side, avg(CASE WHEN oc = 'TARGET' THEN long_base END) AS a, avg(CASE WHEN oc = 'STOP' THEN long_base END) AS b, avg(CASE WHEN oc = 'NEITHER' THEN long_base END) AS c FROM t WHERE fold < 3 GROUP BY side)
    SELECT event_id, round(prob * 0.5 * a + (1 - prob) * 0.5 * b + 0.5 * c, 6) AS expected_value FROM t JOIN p USING (side) WHERE fold >= 3""",
)
def m9(spark, d):
    v = F.col("value")
    rows = oof(spark, d).withColumns(
        {"oc": F.when(v > 66, "TARGET").when(v > 33, "STOP").otherwise("NEITHER"), "pt": F.col("prob") * 0.5, "ps": (1 - F.col("prob")) * 0.5, "pn": F.lit(0.5)}
    )
    out = M.expected_value(rows.filter("fold >= 3"), rows.filter("fold < 3"), {"TARGET": "pt", "STOP": "ps", "NEITHER": "pn"}, "oc", "long_base", ["side"])
    return round_doubles(out.select("event_id", "expected_value"))


@register(
    "m10_safety_buffer",
    pv(OOF)
    + f""", r AS (SELECT side, us // {DAY} AS dy, avg(market - pred) AS r FROM oof GROUP BY ALL), s AS (SELECT side, count(*) AS days, avg(r) AS m, stddev_samp(r) / sqrt(count(*)) AS se FROM r GROUP BY side)
    SELECT side, days, round(m, 6) AS mean_residual, round(se, 6) AS standard_error, round(greatest(0, -m + 1.645 * se), 6) AS buffer FROM s""",
)
def m10(spark, d):
    return round_doubles(M.safety_buffer(oof(spark, d), "pred", "market", ["side"]))


M11 = {"model": ["pred"], "context": ["pred_mfe", "past_return"]}
M11_X = [x for g in M11.values() for x in g]
M11_REST = {g: [x for x in M11_X if x not in own] for g, own in M11.items()}


def m11_own(group: str) -> str:
    return "CAST(0 AS DOUBLE) + " + " + ".join(f"{x} * f.b{M11_X.index(x) + 1}" for x in M11[group])


M11_SQL = pv(
    OOF,
    "mm AS (SELECT *, 1 AS k, pred + market * 0.2 AS target FROM oof)",
    "mt AS (SELECT * FROM mm WHERE fold < 3)",
    ridge_ctes("f", "mt", M11_X, "target", 1.0, "k"),
    *[ridge_ctes(f"w_{g}", "mt", rest, "target", 1.0, "k") for g, rest in M11_REST.items()],
    f"""held AS (SELECT mm.event_id, target AS y, {ridge_score(M11_X, 'f')} AS a, {", ".join(f"{m11_own(g)} AS o_{g}, {ridge_score(rest, f'w_{g}')} AS w_{g}" for g, rest in M11_REST.items())},
      row_number() OVER (ORDER BY mm.event_id) AS rn FROM mm JOIN f USING (k) {" ".join(f"JOIN w_{g} USING (k)" for g in M11)} WHERE fold >= 3)""",
    "dl AS ("
    + " UNION ALL ".join(
        f"""SELECT '{g}' AS g, {r} AS r, o_{g} AS x, row_number() OVER (ORDER BY CAST(('0x' || substring(md5('{r + 1}:' || CAST(event_id AS VARCHAR)), 1, 7)) AS BIGINT) / 268435456.0, event_id) AS rn FROM held"""
        for g in M11
        for r in range(3)
    )
    + ")",
    """va AS (SELECT 'ALL' AS feature_group, 'BASE' AS kind, 0 AS repeat, round(a, 6) AS x, y FROM held"""
    + "".join(f" UNION ALL SELECT '{g}', 'ABLATED', 0, round(w_{g}, 6), y FROM held" for g in M11)
    + "".join(f" UNION ALL SELECT g, 'PERMUTED', r, round(a - o_{g} + dl.x, 6), y FROM held JOIN dl USING (rn) WHERE g = '{g}'" for g in M11)
    + ")",
    f"rr AS ({rho_sql('va', 'feature_group, kind, repeat')})",
    "rc AS (SELECT feature_group, kind, repeat, coalesce(corr(rx, ry), 0) AS rho FROM rr GROUP BY ALL)",
)


@register(
    "m11_group_importance",
    M11_SQL
    + """SELECT feature_group, kind, round(avg(rho), 6) AS rho, round(avg((SELECT rho FROM rc WHERE kind = 'BASE') - rho), 6) AS importance
    FROM rc WHERE kind <> 'BASE' GROUP BY feature_group, kind""",
)
def m11(spark, d):
    rows = oof(spark, d).withColumn("target", F.col("pred") + F.col("market") * 0.2)
    cut = rows.withColumn("role", F.when(F.col("fold") < 3, "train").otherwise("validation")).withColumn("fold", F.lit(1))
    return round_doubles(M.group_importance(cut, M11, "target", "event_id"))


M13 = ["pred", "pred_mfe", "past_return", "past_run"]


@register(
    "m13_coefficients",
    pv(OOF, "ko AS (SELECT *, 1 AS k FROM oof)", ridge_ctes("f", "ko", M13, "market", 1.0, "k"))
    + f"SELECT unnest({M13}) AS feature, round(unnest([b1, b2, b3, b4]), 6) AS coefficient FROM f",
)
def m13(spark, d):
    return round_doubles(M.coefficients(M.ridge(oof(spark, d), M13, "market", 1.0), spark))


def quality(out, score):
    """How far the predictions of each fold are from what happened, on a coarse grid for models that fit by iteration."""
    return round_doubles(out.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score")), 3)


@register("m6_multinomial_oof")
def m6m(spark, d):
    """Three outcomes; the score is the probability given to what happened."""
    rows = modelled(spark, d).withColumn("label", F.when(F.col("value") > 66, 0.0).when(F.col("value") > 33, 1.0).otherwise(2.0))
    out = M.oof_predictions(rows, FEATURES, "label", START, END, CUTS, SPAN, "multinomial", M.EVENT_STUDY, classes=3)
    return quality(out, F.element_at("probabilities", F.col("label").cast("int") + 1))


@register("m7_boosted_classifier_oof")
def m7c(spark, d):
    out = M.oof_predictions(modelled(spark, d), FEATURES, "label", START, END, CUTS, SPAN, "boosted", M.EVENT_STUDY)
    return quality(out, F.when(F.col("label") == 1, F.col("prediction")).otherwise(1 - F.col("prediction")))


@register("m8_elastic_net_oof")
def m8n(spark, d):
    return quality(M.oof_predictions(modelled(spark, d), FEATURES, "market", START, END, CUTS, SPAN, "elastic_net"), F.col("prediction"))


@register(
    "m14_model_diagnostics",
    pv(BIN_SQL)
    + f""", nb AS (SELECT *, ntile(10) OVER (PARTITION BY fold ORDER BY p, event_id) AS b FROM predictions), cg AS (SELECT fold, max(g) AS worst_gap FROM (SELECT fold, b, abs(avg(y) - avg(p)) AS g FROM nb GROUP BY ALL) GROUP BY fold),
    rr AS ({rho_sql('predictions', 'fold', 'p', 'pnl')}), rf AS (SELECT fold, corr(rx, ry) AS rho FROM rr GROUP BY fold)
    SELECT fold, n, round(ap, 6) AS average_precision, round(brier, 6) AS brier, round(base_rate, 6) AS base_rate, round(worst_gap, 6) AS worst_gap, round(rho, 6) AS rho FROM cf JOIN ap USING (fold) JOIN cg USING (fold) JOIN rf USING (fold)""",
)
def m14(spark, d):
    return round_doubles(M.model_diagnostics(predictions(spark, d), "p", "y", "pnl", "event_id"))
