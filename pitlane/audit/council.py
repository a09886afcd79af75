"""The council: reviewers run side by side; findings become a score and a verdict."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pitlane.audit import diagnosis, reviewers
from pitlane.audit.models import PENALTY, AuditConfig, AuditReport, Context, Finding, Reviewer, Severity
from pitlane.operators.backtest import Engine, Plan, Result
from pitlane.operators.strategy import Strategy
from pitlane.sources.bundle import Bundle


def default_reviewers(ledger: Path | str | None = None) -> tuple[Reviewer, ...]:
    return (reviewers.DataIntegrity(), reviewers.Causality(), reviewers.Performance(), reviewers.Robustness(), reviewers.Statistics(), reviewers.Trials(ledger))


def score_of(findings) -> int:
    return max(0, 100 - sum(PENALTY[f.severity] for f in findings))


def verdict_of(findings, score: int) -> str:
    worst = max((f.severity for f in findings), default=Severity.INFO)
    if worst == Severity.CRITICAL or score < 40:
        return "FAIL"
    return "WARN" if worst >= Severity.HIGH or score < 75 else "PASS"


def ordered(findings) -> tuple[Finding, ...]:
    return tuple(sorted(findings, key=lambda f: (-f.severity, f.code, f.reviewer)))


class Council:
    def __init__(self, members: tuple[Reviewer, ...] = (), ledger: Path | str | None = None):
        self.members = tuple(members) or default_reviewers(ledger)

    def review(self, bundle: Bundle, strategy: Strategy, engine: Engine, result: Result, config: AuditConfig | None = None, plan: Plan | None = None) -> AuditReport:
        """Reviewers share a context that nobody writes to; each may start Spark jobs of its own."""
        context = Context(bundle, strategy, engine, result, config or AuditConfig(), plan)
        _ = context.periods, context.contributions  # once, not once for each reviewer
        with ThreadPoolExecutor(len(self.members)) as pool:
            reports = sorted(pool.map(lambda m: m.review(context), self.members), key=lambda r: r.reviewer)
        findings = ordered(f for r in reports for f in r.findings)
        score = score_of(findings)
        return AuditReport(verdict_of(findings, score), score, findings, tuple(reports), diagnosis.diagnose(context, findings), diagnosis.strengths(context, findings), diagnosis.recommendations(findings))
