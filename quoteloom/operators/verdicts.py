"""Published rule sets that turn a report into a conclusion.

Each takes rows of metrics (one per report; any other columns pass through), adds the named checks as booleans and ``conclusion``. A check on
a missing metric fails. Rules stand in their published order: the first that holds decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteloom.operators.evidence import verdict

c = F.col

# fixed values: the names of checks and conclusions, the thresholds and the order of the rules below are the published ones


def _holds(*checks: str) -> Column:
    out = F.lit(True)
    for k in checks:
        out = out & c(k)
    return out


def edge_verdict(m: DataFrame, usable: int = 5000, candidates: int = 200, weeks: int = 8) -> DataFrame:
    """Needs usable, candidates, active_weeks, positive_weeks, net_expectancy, net_lower, desired_relationships, score_rho."""
    checks = {
        "sufficient": (c("usable") >= usable) & (c("candidates") >= candidates) & (c("active_weeks") >= weeks),
        "net_positive": c("net_expectancy") > 0,
        "net_lower_positive": c("net_lower") > 0,
        "stable": (c("active_weeks") >= weeks) & (F.try_divide("positive_weeks", "active_weeks") >= 0.60),
        "score_coherent": (c("desired_relationships") >= 3) & (c("score_rho") > 0),
    }
    rules = [
        ("INSUFFICIENT_DATA", ~c("sufficient")),
        ("EDGE_CANDIDATE", _holds("net_positive", "net_lower_positive", "stable", "score_coherent")),
        ("EDGE_NOT_DETECTED", ~c("net_positive")),
    ]
    return verdict(m, checks, rules, "EDGE_WEAK")


def feature_verdict(matrix: DataFrame) -> DataFrame:
    """One row from the evidence matrix: each target needs candidates among three features, two families and two horizons."""
    candidate = c("status") == "FEATURE_RESEARCH_CANDIDATE"
    per = matrix.groupBy("target").agg(
        *[F.count_distinct(F.when(candidate, c(x))).alias(x) for x in ("feature", "family", "horizon")],
        F.count_if(candidate).alias("_candidates"),
        F.count_if(c("status") == "FEATURE_UNSTABLE").alias("_unstable"),
    )
    passed = (c("feature") >= 3) & (c("family") >= 2) & (c("horizon") >= 2)
    problems = {"quality": "REGIME_QUALITY", "direction": "WITHIN_REGIME_DIRECTION"}
    one = per.agg(
        F.coalesce(F.sum("_candidates"), F.lit(0)).alias("candidate_rows"),
        F.coalesce(F.sum("_unstable"), F.lit(0)).alias("unstable_rows"),
        *[F.coalesce(F.bool_or((c("target") == t) & passed), F.lit(False)).alias(f"{n}_passes") for n, t in problems.items()],
    )
    rules = [("D12_FEATURES_WORTH_V4", _holds("quality_passes", "direction_passes")), ("D12_UNSTABLE_FEATURE_SIGNAL", (c("candidate_rows") > 0) | (c("unstable_rows") > 0))]
    return verdict(one, {}, rules, "D12_NO_USEFUL_FEATURE_SIGNAL")


def freeze_verdict(m: DataFrame) -> DataFrame:
    """Needs candidates, active_weeks, base_expectancy, base_lower, stress_expectancy, profit_factor, positive_week_share, largest_session_share,
    return_baseline, run_baseline, pr_auc, base_rate, ridge_valid, purge_ok, selection_eligible."""
    checks = {
        "minimum_candidates": c("candidates") >= 150,
        "minimum_active_weeks": c("active_weeks") >= 8,
        "positive_base_expectancy": c("base_expectancy") > 0,
        "positive_lower_95_ci_base": c("base_lower") > 0,
        "nonnegative_stress_expectancy": c("stress_expectancy") >= 0,
        "profit_factor_base_gte_1_15": c("profit_factor") >= 1.15,
        "positive_week_fraction_gte_0_60": c("positive_week_share") >= 0.60,
        "largest_session_share_lte_0_60": c("largest_session_share") <= 0.60,
        "direction_better_than_return5_contrarian": c("base_expectancy") > c("return_baseline"),
        "direction_better_than_run_length_contrarian": c("base_expectancy") > c("run_baseline"),
        "regime_pr_auc_better_than_base_rate": c("pr_auc") > c("base_rate"),
        "ridge_numeric_checks": c("ridge_valid"),
        "all_purge_invariants": c("purge_ok"),
        "final_nested_selection_eligible": c("selection_eligible"),
    }
    return verdict(m, checks, [("V4_FREEZE_READY", _holds(*checks))], "V4_NOT_READY_TO_FREEZE")


def direction_verdict(m: DataFrame) -> DataFrame:
    """Needs oracle_base, beta, positive_fold_betas, magnitude_rho, sign_accuracy, gross, executable, base, break_even_commission, break_even_slippage."""
    cheap = F.coalesce(c("break_even_commission") <= 2.0, F.lit(False)) | F.coalesce(c("break_even_slippage") <= 1.0, F.lit(False))
    checks = {
        "regime_gate_insufficient": c("oracle_base") <= 0,
        "direction_calibration_worth_research": (c("oracle_base") > 0) & (c("beta") >= 2.0) & (c("positive_fold_betas") >= 3) & (c("magnitude_rho") >= 0.03) & (c("sign_accuracy") > 0.50),
        "cost_dominated_signal": (c("gross") > 0) & (c("executable") > 0) & (c("base") <= 0) & cheap,
    }
    rules = [
        ("D14_REGIME_GATE_INSUFFICIENT", c("regime_gate_insufficient")),
        ("D14_DIRECTION_CALIBRATION_WORTH_RESEARCH", c("direction_calibration_worth_research")),
        ("D14_COST_DOMINATED_SIGNAL", c("cost_dominated_signal")),
    ]
    return verdict(m, checks, rules, "D14_DIRECTION_ECONOMICALLY_TOO_WEAK")


def qualification_verdict(m: DataFrame) -> DataFrame:
    """Needs expectancy, profit_factor, trades, active_weeks, positive_week_share, asset_concentration, week_concentration, stress_expectancy, stress_profit_factor, crosscheck."""
    checks = {
        "net_expectancy_positive": c("expectancy") > 0,
        "net_profit_factor_gte_1_20": c("profit_factor") >= 1.20,
        "minimum_150_trades": c("trades") >= 150,
        "minimum_8_active_weeks": c("active_weeks") >= 8,
        "positive_weeks_gte_60pct": c("positive_week_share") >= 0.60,
        "crypto_profit_concentration_lte_60pct": c("asset_concentration") <= 0.60,
        "week_profit_concentration_lte_60pct": c("week_concentration") <= 0.60,
        "stress_expectancy_positive": c("stress_expectancy") > 0,
        "stress_profit_factor_gte_1": c("stress_profit_factor") >= 1,
        "pnl_crosscheck": c("crosscheck"),
    }
    rules = [
        ("BINANCE_STRATEGY_INSUFFICIENT_EVIDENCE", ~_holds("minimum_150_trades", "minimum_8_active_weeks")),
        ("BINANCE_STRATEGY_QUALIFIED_FOR_PAPER", _holds(*checks)),
    ]
    return verdict(m, checks, rules, "BINANCE_STRATEGY_REJECTED")


def cost_survival_verdict(m: DataFrame, quotes_covered: bool = False) -> DataFrame:
    """Needs net_return, profit_factor, trades, active_weeks, positive_week_share, stress_return, gross, spread_cost, slippage_cost, commission, crosscheck.

    Adds ``diagnosis`` and the cost shares. Without historical quotes (``quotes_covered``) nothing qualifies.
    """
    total = c("spread_cost") + c("slippage_cost") + c("commission")
    diagnosis = (
        F.when(c("gross") <= 0, "NO_GROSS_EDGE").when(c("commission") > 0.50 * c("gross"), "TURNOVER_TOO_EXPENSIVE").when(c("net_return") <= 0, "EDGE_DESTROYED_BY_COSTS").otherwise("EDGE_SURVIVES_COSTS")
    )
    shares = {"commission_share": F.when(c("gross") > 0, c("commission") / c("gross")), "cost_share": F.when(c("gross") > 0, total / c("gross")), "diagnosis": diagnosis}
    checks = {
        "positive_net_return": c("net_return") > 0,
        "profit_factor_gte_1_20": c("profit_factor") >= 1.20,
        "minimum_100_trades": c("trades") >= 100,
        "minimum_8_active_weeks": c("active_weeks") >= 8,
        "positive_weeks_gte_60pct": c("positive_week_share") >= 0.60,
        "stress_positive": c("stress_return") > 0,
        "costs_below_gross_profit": c("gross") > total,
        "pnl_crosscheck": c("crosscheck"),
        "historical_bid_ask_coverage": F.lit(quotes_covered),
    }
    enough = _holds("minimum_100_trades", "minimum_8_active_weeks")
    others = _holds(*[k for k in checks if k != "historical_bid_ask_coverage"])
    rules = [
        ("BINANCE_V2_REJECTED", (c("diagnosis") == "NO_GROSS_EDGE") | (enough & ~others)),
        ("BINANCE_V2_INSUFFICIENT_EVIDENCE", ~enough),
        ("BINANCE_V2_QUALIFIED_FOR_PAPER", _holds(*checks)),
    ]
    return verdict(m.withColumns(shares), checks, rules, "BINANCE_V2_INSUFFICIENT_EVIDENCE")


def drawdown_verdict(m: DataFrame) -> DataFrame:
    """Needs gross, expectancy, profit_factor, max_drawdown_pct, positive_week_share, stress_expectancy, trades, active_weeks."""
    checks = {
        "gross_expectancy_positive": c("gross") > 0,
        "net_expectancy_positive": c("expectancy") > 0,
        "profit_factor_gte_1_20": c("profit_factor") >= 1.20,
        "drawdown_lte_10pct": c("max_drawdown_pct") <= 10,
        "positive_weeks_gte_60pct": c("positive_week_share") >= 0.60,
        "stress_expectancy_nonnegative": c("stress_expectancy") >= 0,
    }
    rules = [
        ("BINANCE_V3_REJECTED", ~c("gross_expectancy_positive")),
        ("BINANCE_V3_INSUFFICIENT_EVIDENCE", (c("trades") < 30) | (c("active_weeks") < 4)),
        ("BINANCE_V3_QUALIFIED_FOR_PAPER", _holds(*checks)),
    ]
    return verdict(m, checks, rules, "BINANCE_V3_REJECTED")
