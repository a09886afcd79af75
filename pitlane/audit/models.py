"""What reviewers read and return."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from enum import IntEnum
from functools import cached_property
from pathlib import Path
from typing import Any, Protocol

import numpy as np
from pyspark.sql import functions as F

from pitlane.errors import ConfigurationError
from pitlane.operators.backtest import Engine, Plan, Result
from pitlane.operators.strategy import Strategy
from pitlane.sources.bundle import Bundle


class Severity(IntEnum):
    INFO, LOW, MEDIUM, HIGH, CRITICAL = range(5)


#: What a finding of each severity takes off the score.
PENALTY = {Severity.CRITICAL: 35, Severity.HIGH: 15, Severity.MEDIUM: 7, Severity.LOW: 2, Severity.INFO: 0}


@dataclass(frozen=True)
class AuditConfig:
    bootstrap_simulations: int = 500
    bootstrap_block_size: int = 5
    permutation_simulations: int = 500
    causality_cutoffs: int = 3
    cost_multipliers: tuple[float, ...] = (0.0, 1.0, 2.0, 5.0)
    stability_folds: int = 4
    minimum_periods: int = 24
    confidence: float = 0.95
    n_trials: int = 1
    seed: int = 7

    def __post_init__(self):
        object.__setattr__(self, "cost_multipliers", tuple(float(m) for m in self.cost_multipliers))
        counts = ("bootstrap_simulations", "bootstrap_block_size", "permutation_simulations", "causality_cutoffs", "stability_folds", "minimum_periods", "n_trials")
        wrong = [c for c in counts if getattr(self, c) < 1]
        if wrong:
            raise ConfigurationError(f"must be positive: {', '.join(wrong)}")
        if not 0.5 < self.confidence < 1:
            raise ConfigurationError("confidence must lie between 0.5 and 1")
        if not self.cost_multipliers or min(self.cost_multipliers) < 0:
            raise ConfigurationError("cost multipliers must not be negative")


@dataclass(frozen=True)
class Finding:
    code: str
    severity: Severity
    reviewer: str
    title: str
    detail: str
    evidence: dict[str, Any] = field(default_factory=dict)

    def to_dict(self) -> dict:
        return asdict(self) | {"severity": self.severity.name}


@dataclass(frozen=True)
class Report:
    reviewer: str
    findings: tuple[Finding, ...]
    measured: dict[str, Any]


@dataclass(frozen=True)
class Context:
    bundle: Bundle
    strategy: Strategy
    engine: Engine
    result: Result
    config: AuditConfig
    plan: Plan | None = None
    ledger_path: Path | None = None

    @cached_property
    def periods(self) -> list[dict]:
        """One dict a period in order; the only table that reviewers bring to the driver."""
        columns = ("exit", "gross_return", "turnover", "strategy_return", "benchmark_return")
        return [r.asDict() for r in self.result.returns.select(*columns).orderBy("exit").collect()]

    @cached_property
    def returns(self) -> np.ndarray:
        return np.array([p["strategy_return"] for p in self.periods if p["strategy_return"] is not None], float)

    @cached_property
    def contributions(self) -> list[tuple[str, float]]:
        """(symbol, absolute sum of weight times return) of the top three, then ("", the sum over all symbols)."""
        by = self.result.holdings.groupBy("symbol").agg(F.abs(F.sum(F.col("weight") * F.col("period_return"))).alias("c"))
        top = [(r["symbol"], r["c"]) for r in by.orderBy(F.desc("c"), "symbol").limit(3).collect()]
        return [*top, ("", by.agg(F.coalesce(F.sum("c"), F.lit(0.0))).first()[0])]


class Reviewer(Protocol):
    name: str

    def review(self, context: Context) -> Report: ...


@dataclass(frozen=True)
class Experiment:
    """A diagnosis: what was measured, and what to try next."""

    rule: str
    severity: Severity
    diagnosis: str
    prescription: str
    measured: dict[str, Any]
    rank: int = 0


@dataclass(frozen=True)
class AuditReport:
    verdict: str
    score: int
    findings: tuple[Finding, ...]
    reports: tuple[Report, ...]
    experiments: tuple[Experiment, ...]
    strengths: tuple[str, ...]
    recommendations: tuple[str, ...]

    def to_dict(self) -> dict:
        return {
            "verdict": self.verdict,
            "score": self.score,
            "findings": [f.to_dict() for f in self.findings],
            "reports": [{"reviewer": r.reviewer, "findings": [f.code for f in r.findings], "measured": r.measured} for r in self.reports],
            "experiments": [asdict(e) | {"severity": e.severity.name} for e in self.experiments],
            "strengths": list(self.strengths),
            "recommendations": list(self.recommendations),
        }
