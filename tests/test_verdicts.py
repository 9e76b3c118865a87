"""The published rule sets on literal reports: one that passes, and each single failure."""

import pytest
from pyspark.sql import functions as F

from quoteloom.operators import verdicts as D

QUALIFIED = {
    "expectancy": 0.4, "profit_factor": 1.2, "trades": 150, "active_weeks": 8, "positive_week_share": 0.6, "asset_concentration": 0.6, "week_concentration": 0.6,
    "stress_expectancy": 0.1, "stress_profit_factor": 1.0, "crosscheck": True,
}
SURVIVES = {
    "net_return": 1.0, "profit_factor": 1.2, "trades": 100, "active_weeks": 8, "positive_week_share": 0.6, "stress_return": 0.1, "gross": 10.0, "spread_cost": 2.0, "slippage_cost": 1.0,
    "commission": 3.0, "crosscheck": True,
}
DRAWDOWN = {"gross": 1.0, "expectancy": 0.1, "profit_factor": 1.2, "max_drawdown_pct": 10.0, "positive_week_share": 0.6, "stress_expectancy": 0.0, "trades": 30, "active_weeks": 4}
EDGE = {"usable": 5000, "candidates": 200, "active_weeks": 8, "positive_weeks": 5, "net_expectancy": 0.1, "net_lower": 0.01, "desired_relationships": 3, "score_rho": 0.1}
FREEZE = {
    "candidates": 150, "active_weeks": 8, "base_expectancy": 0.5, "base_lower": 0.1, "stress_expectancy": 0.0, "profit_factor": 1.15, "positive_week_share": 0.6, "largest_session_share": 0.6,
    "return_baseline": 0.4, "run_baseline": 0.3, "pr_auc": 0.4, "base_rate": 0.3, "ridge_valid": True, "purge_ok": True, "selection_eligible": True,
}
DIRECTION = {
    "oracle_base": 1.0, "beta": 2.0, "positive_fold_betas": 3, "magnitude_rho": 0.03, "sign_accuracy": 0.51, "gross": 1.0, "executable": 0.5, "base": -0.1, "break_even_commission": 2.0,
    "break_even_slippage": 3.0,
}

CASES = [
    (D.qualification_verdict, QUALIFIED, {}, "BINANCE_STRATEGY_QUALIFIED_FOR_PAPER"),
    (D.qualification_verdict, QUALIFIED, {"trades": 149}, "BINANCE_STRATEGY_INSUFFICIENT_EVIDENCE"),
    (D.qualification_verdict, QUALIFIED, {"active_weeks": 7, "expectancy": -1.0}, "BINANCE_STRATEGY_INSUFFICIENT_EVIDENCE"),
    (D.qualification_verdict, QUALIFIED, {"profit_factor": None}, "BINANCE_STRATEGY_REJECTED"),
    (D.qualification_verdict, QUALIFIED, {"crosscheck": False}, "BINANCE_STRATEGY_REJECTED"),
    (D.cost_survival_verdict, SURVIVES, {}, "BINANCE_V2_INSUFFICIENT_EVIDENCE"),  # no historical quotes
    (D.cost_survival_verdict, SURVIVES, {"gross": 0.0, "trades": 3}, "BINANCE_V2_REJECTED"),
    (D.cost_survival_verdict, SURVIVES, {"stress_return": 0.0}, "BINANCE_V2_REJECTED"),
    (D.cost_survival_verdict, SURVIVES, {"stress_return": 0.0, "trades": 99}, "BINANCE_V2_INSUFFICIENT_EVIDENCE"),
    (D.drawdown_verdict, DRAWDOWN, {}, "BINANCE_V3_QUALIFIED_FOR_PAPER"),
    (D.drawdown_verdict, DRAWDOWN, {"gross": 0.0, "trades": 1}, "BINANCE_V3_REJECTED"),
    (D.drawdown_verdict, DRAWDOWN, {"trades": 29}, "BINANCE_V3_INSUFFICIENT_EVIDENCE"),
    (D.drawdown_verdict, DRAWDOWN, {"max_drawdown_pct": 10.5}, "BINANCE_V3_REJECTED"),
    (D.edge_verdict, EDGE, {}, "EDGE_CANDIDATE"),
    (D.edge_verdict, EDGE, {"candidates": 199}, "INSUFFICIENT_DATA"),
    (D.edge_verdict, EDGE, {"net_expectancy": None}, "EDGE_NOT_DETECTED"),
    (D.edge_verdict, EDGE, {"positive_weeks": 4}, "EDGE_WEAK"),
    (D.freeze_verdict, FREEZE, {}, "V4_FREEZE_READY"),
    *[(D.freeze_verdict, FREEZE, {k: v}, "V4_NOT_READY_TO_FREEZE") for k, v in {"return_baseline": None, "run_baseline": 0.5, "pr_auc": 0.3, "ridge_valid": False, "largest_session_share": 0.61}.items()],
    (D.direction_verdict, DIRECTION, {}, "D14_DIRECTION_CALIBRATION_WORTH_RESEARCH"),
    (D.direction_verdict, DIRECTION, {"oracle_base": 0.0}, "D14_REGIME_GATE_INSUFFICIENT"),
    (D.direction_verdict, DIRECTION, {"beta": 1.9}, "D14_COST_DOMINATED_SIGNAL"),
    (D.direction_verdict, DIRECTION, {"beta": 1.9, "break_even_commission": None}, "D14_DIRECTION_ECONOMICALLY_TOO_WEAK"),
]


def test_conclusions(spark):
    for rule in dict.fromkeys(x[0] for x in CASES):
        mine = [x for x in CASES if x[0] is rule]
        kinds = {n: {bool: "boolean", int: "long", float: "double"}[type(v)] for n, v in mine[0][1].items()}
        rows = [(i, *[float(v) if kinds[n] == "double" and v is not None else v for n, v in {**base, **change}.items()]) for i, (_, base, change, _) in enumerate(mine)]
        table = spark.createDataFrame(rows, "case long, " + ", ".join(f"{n} {k}" for n, k in kinds.items()))
        got = {r.case: r.conclusion for r in rule(table).collect()}
        assert got == {i: x[3] for i, x in enumerate(mine)}, rule.__name__


def test_diagnoses_of_costs(spark):
    table = spark.createDataFrame([{**SURVIVES, "case": i, **x} for i, x in enumerate([{}, {"commission": 5.5}, {"net_return": 0.0}, {"gross": -1.0}])])
    got = {r.case: (r.diagnosis, r.cost_share) for r in D.cost_survival_verdict(table, quotes_covered=True).collect()}
    assert [got[i][0] for i in range(4)] == ["EDGE_SURVIVES_COSTS", "TURNOVER_TOO_EXPENSIVE", "EDGE_DESTROYED_BY_COSTS", "NO_GROSS_EDGE"]
    assert got[0][1] == pytest.approx(0.6) and got[3][1] is None
    assert D.cost_survival_verdict(table.filter("case = 0"), quotes_covered=True).first()["conclusion"] == "BINANCE_V2_QUALIFIED_FOR_PAPER"


def test_feature_verdict(spark):
    def rows(per_target):
        return [(t, f"f{i}", f"g{i % g}", str(i % h), "FEATURE_RESEARCH_CANDIDATE") for t, (n, g, h) in per_target.items() for i in range(n)]

    both = {"REGIME_QUALITY": (3, 2, 2), "WITHIN_REGIME_DIRECTION": (4, 2, 2)}
    schema = "target string, feature string, family string, horizon string, status string"
    weak = spark.createDataFrame(rows({**both, "REGIME_QUALITY": (3, 1, 2)}), schema)
    assert D.feature_verdict(spark.createDataFrame(rows(both), schema)).first()["conclusion"] == "D12_FEATURES_WORTH_V4"
    assert D.feature_verdict(weak).first()["conclusion"] == "D12_UNSTABLE_FEATURE_SIGNAL"
    assert D.feature_verdict(weak.withColumn("status", F.lit("FEATURE_NO_SIGNAL"))).first()["conclusion"] == "D12_NO_USEFUL_FEATURE_SIGNAL"
