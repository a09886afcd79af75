"""Walk-forward folds: train, embargo and test stretches of decisions, all folds from one set of periods."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitlane.errors import ConfigurationError, InsufficientDataError
from pitlane.functions import metrics
from pitlane.operators.backtest import Engine
from pitlane.operators.strategy import Strategy
from pitlane.sources.bundle import Bundle


@dataclass(frozen=True)
class WalkForwardConfig:
    train_periods: int = 52
    test_periods: int = 13
    embargo_periods: int = 1

    def __post_init__(self):
        if self.train_periods < 2 or self.test_periods < 2 or self.embargo_periods < 0:
            raise ConfigurationError("train and test need two decisions each, the embargo none or more")

    @property
    def needed(self) -> int:
        return self.train_periods + self.embargo_periods + self.test_periods


def segments(periods: DataFrame, decisions: int, config: WalkForwardConfig, bps: float) -> DataFrame:
    """fold, part (train or test), decision, exit, net of each period within each fold's stretches.

    periods: decision, n (from 1), exit, gross_return, turnover, gross_exposure. A stretch of N decisions has N - 1
    periods, and its first starts from an empty book, whose turnover is what it buys. Folds begin every
    test_periods decisions; a period meets its few folds by an explode, not a join.
    """
    c, last = config, (decisions - config.needed) // config.test_periods
    if last < 0:
        return periods.limit(0).select(F.lit(0).cast("int").alias("fold"), F.lit("").alias("part"), "decision", "exit", F.lit(0.0).alias("net"))
    first_fold = F.greatest(F.lit(0), F.floor((F.col("n") - c.needed - 1) / c.test_periods) + 1).cast("int")
    last_fold = F.least(F.lit(last), F.floor((F.col("n") - 1) / c.test_periods)).cast("int")
    rows = periods.where(first_fold <= last_fold).withColumn("fold", F.explode(F.sequence(first_fold, last_fold)))
    rows = rows.withColumn("at", F.col("n") - F.col("fold") * c.test_periods)  # 1 .. needed
    test0 = c.train_periods + c.embargo_periods
    part = F.when(F.col("at").between(1, c.train_periods - 1), "train").when(F.col("at").between(test0 + 1, test0 + c.test_periods - 1), "test")
    opening = (F.col("at") == 1) | (F.col("at") == test0 + 1)
    moved = F.when(opening, F.col("gross_exposure")).otherwise(F.col("turnover"))
    return rows.withColumn("part", part).where("part is not null").select("fold", "part", "decision", "exit", (F.col("gross_return") - moved * bps / 1e4).alias("net"))


def fold_table(rows: DataFrame) -> DataFrame:
    """fold, part, periods, total_return, sharpe (mean over sample deviation, else 0), max_drawdown, first and last exit."""
    order = Window.partitionBy("fold", "part").orderBy("exit").rowsBetween(Window.unboundedPreceding, 0)
    grown = rows.withColumn("e", F.product(1 + F.col("net")).over(order))
    grown = grown.withColumn("dd", F.col("e") / F.max("e").over(order) - 1)
    sharpe = F.coalesce(F.when(F.stddev_samp("net") > 0, F.avg("net") / F.stddev_samp("net")), F.lit(0.0))
    return grown.groupBy("fold", "part").agg(F.count("*").alias("periods"), (F.product(1 + F.col("net")) - 1).alias("total_return"), sharpe.alias("sharpe"), F.min("dd").alias("max_drawdown"), F.min("decision").alias("first"), F.max("decision").alias("last"))


def hint(positive: list[bool], degradation: float | None) -> str:
    """inconclusive without a ratio, fragile with a fold that lost, degraded under one half, else consistent."""
    if degradation is None:
        return "inconclusive"
    if not all(positive):
        return "fragile"
    return "degraded" if degradation < 0.5 else "consistent"


@dataclass(frozen=True)
class WalkForward:
    strategy_name: str
    config: WalkForwardConfig
    folds: tuple[dict, ...]
    pooled_metrics: dict
    mean_train_sharpe: float
    pooled_sharpe: float
    degradation: float | None
    warnings: tuple[str, ...]
    notes: tuple[str, ...]

    @property
    def verdict_hint(self) -> str:
        return hint([f["test_total_return"] > 0 for f in self.folds], self.degradation)

    def to_dict(self) -> dict:
        return {"strategy": self.strategy_name, "config": vars(self.config), "folds": list(self.folds), "pooled_metrics": self.pooled_metrics, "mean_train_sharpe": self.mean_train_sharpe, "pooled_sharpe": self.pooled_sharpe, "degradation": self.degradation, "verdict_hint": self.verdict_hint, "warnings": self.warnings, "notes": self.notes}


def walk_forward(bundle: Bundle, strategy: Strategy, engine: Engine, config: WalkForwardConfig | None = None) -> WalkForward:
    """Train and test returns of every fold from one backtest's signals; test returns pooled."""
    c = config or WalkForwardConfig()
    plan = engine.prepare(bundle, strategy)
    n = plan.schedule.count()
    if n < 2 * c.needed:
        raise InsufficientDataError(f"{2 * c.needed} decisions are needed, {n} found")
    numbered = plan.schedule.select("decision", F.row_number().over(Window.orderBy("decision")).alias("n"))
    rows = segments(plan.periods.join(F.broadcast(numbered), "decision"), n, c, engine.config.total_cost_bps).persist()
    by: dict[int, dict] = {}
    for r in fold_table(rows).collect():
        by.setdefault(r["fold"], {})[r["part"]] = r
    folds, notes = [], []
    for k in sorted(by):
        if len(by[k]) < 2:
            notes.append(f"fold {k} left out: too few executable periods")
            continue
        a, b = by[k]["train"], by[k]["test"]
        folds.append({"index": len(folds), "fold": k, "train_start": a["first"], "train_end": a["last"], "test_start": b["first"], "test_end": b["last"], "train_periods": a["periods"], "test_periods": b["periods"], "train_total_return": a["total_return"], "test_total_return": b["total_return"], "train_sharpe": a["sharpe"], "test_sharpe": b["sharpe"], "test_max_drawdown": b["max_drawdown"]})
    if len(folds) < 2:
        raise InsufficientDataError("fewer than two whole folds; a longer history is needed")
    pooled = rows.where((F.col("part") == "test") & F.col("fold").isin([f["fold"] for f in folds])).select("exit", F.col("net").alias("strategy_return"))
    pooled = pooled.withColumns({"benchmark_return": F.lit(None).cast("double"), "turnover": F.lit(None).cast("double"), "gross_exposure": F.lit(None).cast("double")})
    summary = metrics.summary(pooled, engine.config.periods_per_year, engine.config.annual_risk_free_rate).first().asDict()
    x = pooled.agg(F.avg("strategy_return").alias("m"), F.stddev_samp("strategy_return").alias("s")).first()
    pooled_sharpe = x["m"] / x["s"] if x["s"] else 0.0
    train = sum(f["train_sharpe"] for f in folds) / len(folds)
    ratio = pooled_sharpe / train if abs(train) > 1e-9 else None
    positive, warnings = sum(f["test_total_return"] > 0 for f in folds), ["Hypothetical research output, no advice to trade."]
    if ratio is not None and ratio < 0.5:
        warnings.append(f"Out of sample the Sharpe ratio keeps {ratio:.0%} of its in-sample value.")
    if positive < (len(folds) + 1) // 2:
        warnings.append(f"{positive} of {len(folds)} test folds gained.")
    return WalkForward(strategy.name, c, tuple(folds), summary, train, pooled_sharpe, ratio, tuple(warnings), tuple(notes))


__all__ = ["WalkForward", "WalkForwardConfig", "fold_table", "hint", "segments", "walk_forward"]
