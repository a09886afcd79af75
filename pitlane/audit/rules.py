"""Measurements behind findings. Each is a small plan or a scalar rule, so queries and reviewers share them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: code: (severity, title, what to do). Severities are fixed values.
CODES: dict[str, tuple[str, str, str]] = {
    "DATA_PRICE_INVARIANT": ("CRITICAL", "Prices that cannot be", "Correct the price source and run everything again."),
    "DATA_TEMPORAL_LEAK": ("CRITICAL", "Facts known before they happened", "Use the time a fact became public as its time of knowledge."),
    "DATA_ADJUSTMENT_UNKNOWN": ("HIGH", "Price adjustment is not declared", "Declare how splits and dividends are treated, and test it."),
    "DATA_SURVIVORSHIP_UNKNOWN": ("HIGH", "Membership through time is not assured", "Supply membership as it was known, with the stocks that failed."),
    "DATA_COVERAGE_UNEVEN": ("MEDIUM", "Some symbols have little history", "Look at the short histories or set a longer minimum."),
    "DATA_SYNTHETIC": ("INFO", "The data is made up", "Use it to learn the tool, not to conclude."),
    "STRATEGY_NONDETERMINISTIC": ("CRITICAL", "Two equal evaluations differ", "Fix seeds and take outside state away."),
    "CAUSALITY_PREFIX_CHANGED": ("CRITICAL", "The future changes past signals", "Take out whole-sample statistics and anything read from metadata."),
    "STRATEGY_STATEFUL_WARMUP": ("HIGH", "Signals depend on what was evaluated before", "Derive each score from its snapshot alone."),
    "CAUSALITY_UNTESTED": ("HIGH", "Too short to test causality", "Provide a longer history."),
    "FOLD_INSTABILITY": ("HIGH", "Most stretches of time lost", "Simplify the rule; test it on a fresh stretch."),
    "BOOTSTRAP_UNCERTAIN": ("MEDIUM", "Resampled paths often lose", "Collect more independent periods."),
    "COST_FRAGILE": ("HIGH", "Costs eat the result", "Trade less, or ask for a wider edge."),
    "BENCHMARK_MISSING": ("MEDIUM", "No benchmark to compare with", "Name a benchmark that has prices."),
    "REGIME_INSTABILITY": ("MEDIUM", "One market regime earns it all", "State the regime the rule needs and test that on fresh data."),
    "PERFORMANCE_SAMPLE_SMALL": ("MEDIUM", "Few periods", "Extend the dates or shorten the period."),
    "PERFORMANCE_EXTREME_SHARPE": ("HIGH", "A Sharpe ratio too good to believe", "Check timestamps, adjustments, stale prices and costs."),
    "SYMBOL_CONCENTRATION": ("MEDIUM", "Three stocks make most of it", "Repeat the test without them."),
    "BENCHMARK_UNDERPERFORMANCE": ("LOW", "The benchmark did better", "Say what the extra effort buys."),
    "TRACK_RECORD_SHORT": ("HIGH", "The record is too short for its Sharpe ratio", "Wait for more out-of-sample periods."),
    "MULTIPLE_TESTING": ("HIGH", "The best of many trials", "Record the whole search and deflate the result by it."),
    "MEAN_NOT_SIGNIFICANT": ("MEDIUM", "The mean could be chance", "Collect more independent periods."),
    "RETURN_CONCENTRATION": ("HIGH", "Three periods make most of it", "Repeat the test without them."),
    "TRIALS_LEDGER_MISSING": ("MEDIUM", "No record of trials", "Let the ledger record every run."),
    "TRIALS_LEDGER_TAMPERED": ("CRITICAL", "The record of trials was changed", "Restore the ledger; verdicts that rest on it are void."),
    "TRIALS_UNDERDECLARED": ("HIGH", "More variants were tried than declared", "Declare the recorded number of trials."),
    "TRIALS_OVERDECLARED": ("INFO", "Fewer variants are recorded than declared", "See that every run reaches the ledger."),
}


def price_breaks(prices: DataFrame) -> DataFrame:
    """n: rows whose high or low contradicts the other prices, with a price of 0 or less, or a negative volume."""
    bad = (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close", "high")) | (F.least("open", "high", "low", "close") <= 0) | (F.coalesce(F.col("volume"), F.lit(0.0)) < 0)
    return prices.agg(F.count(F.when(bad, 1)).alias("n"))


def leaks(features: DataFrame) -> DataFrame:
    return features.agg(F.count(F.when(F.col("available_at") < F.col("observed_at"), 1)).alias("n"))


def coverage(prices: DataFrame, clock: str = "timestamp") -> DataFrame:
    """least, middle and uneven: sessions of the symbols, and whether the least lies under half the median or 20."""
    c = prices.groupBy("symbol").agg(F.countDistinct(clock).alias("k"))
    return c.agg(F.min("k").alias("least"), F.median("k").alias("middle")).withColumn("uneven", F.coalesce(F.col("least") < F.greatest(F.lit(20), F.floor(F.col("middle") * 0.5)), F.lit(False)))


def fold_totals(returns: np.ndarray, folds: int) -> list[float]:
    return [float(np.prod(1 + part) - 1) for part in np.array_split(returns, folds) if len(part)]


def most_folds_lost(totals: list[float]) -> bool:
    return len(totals) >= 2 and sum(t > 0 for t in totals) < math.ceil(len(totals) / 2)


def regimes(strategy: np.ndarray, benchmark: np.ndarray) -> dict[str, float]:
    """Total return by regime: high_vol where the benchmark's deviation over four periods exceeds its median, else up or down."""
    vol = [float(np.std(benchmark[max(0, i - 3) : i + 1], ddof=1)) if i else math.nan for i in range(len(benchmark))]
    known = [v for v in vol if not math.isnan(v)]
    threshold = float(np.median(known)) if known else math.nan
    out: dict[str, float] = {}
    for s, b, v in zip(strategy, benchmark, vol):
        label = "high_vol" if v > threshold else "up" if b >= 0 else "down"
        out[label] = out.get(label, 1.0) * (1 + s)
    return {k: v - 1 for k, v in sorted(out.items())}


def top_share(values, n: int = 3) -> float:
    """Share of the n largest absolute values; 0 of nothing."""
    a = np.sort(np.abs(np.asarray(values, float)))[::-1]
    return float(a[:n].sum() / a.sum()) if a.sum() > 0 else 0.0


def breakeven_bps(gross: float, turnover: float) -> float | None:
    return gross / turnover * 1e4 if turnover > 0 else None
