"""Six reviewers. Each measures on the driver what is a few numbers, and leaves tables to Spark."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

import numpy as np

from pitlane.audit import causality, rules
from pitlane.audit.models import Context, Finding, Report, Severity
from pitlane.functions import statistics
from pitlane.operators.backtest import cost_curve
from pitlane.operators.ledger import Ledger


class _Notes:
    """Collects the findings of one reviewer."""

    def __init__(self, reviewer: str):
        self.reviewer, self.found, self.measured = reviewer, [], {}

    def add(self, code: str, detail: str, **evidence) -> None:
        severity, title, _ = rules.CODES[code]
        self.found.append(Finding(code, Severity[severity], self.reviewer, title, detail, evidence))

    def report(self) -> Report:
        return Report(self.reviewer, tuple(self.found), self.measured)


class DataIntegrity:
    name = "data-integrity"

    def review(self, context: Context) -> Report:
        b, n = context.bundle, _Notes(self.name)
        meta = {k: str(v).strip().lower() for k, v in b.metadata.items() if isinstance(v, str)}
        broken, leaked = rules.price_breaks(b.prices).first()["n"], rules.leaks(b.features).first()["n"]
        cover = rules.coverage(b.prices).first()
        members = b.universe.limit(1).count()
        n.measured = {"price_breaks": broken, "leaks": leaked, "least_sessions": cover["least"], "median_sessions": cover["middle"]}
        if broken:
            n.add("DATA_PRICE_INVARIANT", f"{broken} price rows contradict themselves.", rows=broken)
        if leaked:
            n.add("DATA_TEMPORAL_LEAK", f"{leaked} features were available before they were observed.", rows=leaked)
        if meta.get("price_adjustment", "unknown") in ("", "unknown"):
            n.add("DATA_ADJUSTMENT_UNKNOWN", "metadata.price_adjustment is missing or unknown.")
        if not members or meta.get("survivorship") not in ("point_in_time", "pit"):
            n.add("DATA_SURVIVORSHIP_UNKNOWN", "There is no universe table, or metadata.survivorship isn't point_in_time.", members=bool(members))
        if cover["uneven"]:
            n.add("DATA_COVERAGE_UNEVEN", f"The shortest history has {cover['least']} sessions, the median {cover['middle']:g}.", least=cover["least"], median=cover["middle"])
        if b.metadata.get("data_classification") == "synthetic":
            n.add("DATA_SYNTHETIC", "metadata.data_classification is synthetic.")
        return n.report()


class Causality:
    name = "causality"

    def review(self, context: Context) -> Report:
        n = _Notes(self.name)
        probe = causality.probe(context.bundle, context.strategy, context.config.causality_cutoffs)
        n.measured = vars(probe)
        if not probe.reproducible:
            n.add("STRATEGY_NONDETERMINISTIC", "Two clones scored one snapshot differently.")
        if not probe.prefix_stable:
            n.add("CAUSALITY_PREFIX_CHANGED", "Signals changed when only later data and metadata did.")
        if not probe.warm_stable:
            n.add("STRATEGY_STATEFUL_WARMUP", "A clone that had scored an earlier date gave other signals.")
        if not probe.cutoffs:
            n.add("CAUSALITY_UNTESTED", f"The strategy needs {context.strategy.minimum_history} sessions, which leaves no date to test.")
        return n.report()


class Performance:
    name = "performance"

    def review(self, context: Context) -> Report:
        c, n, rows = context.result.config, _Notes(self.name), context.periods
        gross, moved = sum(p["gross_return"] for p in rows), sum(p["turnover"] for p in rows)
        even = rules.breakeven_bps(gross, moved)
        *top, (_, whole) = context.contributions
        share = sum(x for _, x in top) / whole if whole > 0 else 0.0
        sharpe = context.result.metrics.get("sharpe")
        total, bench = context.result.metrics["total_return"], context.result.benchmark_metrics.get("total_return") or 0.0
        n.measured = {"periods": len(rows), "breakeven_bps": even, "top_three_symbols": share, "sharpe": sharpe}
        if len(rows) < context.config.minimum_periods:
            n.add("PERFORMANCE_SAMPLE_SMALL", f"{len(rows)} periods.", periods=len(rows))
        if sharpe is not None and abs(sharpe) > 3:
            n.add("PERFORMANCE_EXTREME_SHARPE", f"An annual Sharpe ratio of {sharpe:.2f}.", sharpe=sharpe)
        if even is not None and even <= 1.5 * c.total_cost_bps:
            n.add("COST_FRAGILE", f"Break-even at {even:.1f} bps, {c.total_cost_bps:g} bps assumed.", breakeven_bps=even, assumed_bps=c.total_cost_bps)
        if share > 0.60:
            n.add("SYMBOL_CONCENTRATION", f"Three symbols make {share:.1%} of absolute contributions.", share=share, symbols=[s for s, _ in top])
        if c.benchmark_symbol and total < bench:
            n.add("BENCHMARK_UNDERPERFORMANCE", f"{total:.1%} against {bench:.1%}.", total=total, benchmark=bench)
        return n.report()


class Robustness:
    name = "robustness"

    def review(self, context: Context) -> Report:
        c, n, x = context.config, _Notes(self.name), context.returns
        totals = rules.fold_totals(x, c.stability_folds)
        if rules.most_folds_lost(totals):
            n.add("FOLD_INSTABILITY", f"{sum(t > 0 for t in totals)} of {len(totals)} stretches gained.", totals=totals)
        boot = statistics.block_bootstrap(x, c.bootstrap_simulations, c.bootstrap_block_size, c.confidence, c.seed)
        positive = boot.probability_positive if boot else 0.0
        if positive < c.confidence:
            n.add("BOOTSTRAP_UNCERTAIN", f"{positive:.1%} of resampled paths gained.", **(vars(boot) if boot else {}))
        plan = context.plan or context.engine.prepare(context.bundle, context.strategy.clone())
        curve = cost_curve(plan, c.cost_multipliers)
        base, worst = curve.get(1.0, context.result.metrics["total_return"]), curve[max(curve)] if curve else 0.0
        if base > 0 and worst <= 0:
            n.add("COST_FRAGILE", f"Total return falls from {base:.1%} to {worst:.1%} at {max(curve):g} times the costs.", curve={f"{k:g}x": v for k, v in curve.items()})
        both = [(p["strategy_return"], p["benchmark_return"]) for p in context.periods if None not in (p["strategy_return"], p["benchmark_return"])]
        by = {}
        if not any(p["benchmark_return"] is not None for p in context.periods):
            n.add("BENCHMARK_MISSING", "No period has a benchmark return.")
        elif both:
            by = rules.regimes(*(np.array(v, float) for v in zip(*both)))
            if len(by) >= 2 and sum(v > 0 for v in by.values()) == 1:
                n.add("REGIME_INSTABILITY", "One regime gained, the others didn't.", regimes=by)
        n.measured = {"folds": totals, "bootstrap": vars(boot) if boot else None, "cost_curve": {f"{k:g}x": v for k, v in curve.items()}, "regimes": by}
        return n.report()


class Statistics:
    name = "statistics"

    def review(self, context: Context) -> Report:
        c, n, x = context.config, _Notes(self.name), context.returns
        needed = statistics.minimum_track_record(x, 0.0, c.confidence)
        deflated = statistics.deflated_sharpe(x, c.n_trials)
        mean, p = statistics.sign_flip(x, c.permutation_simulations, c.seed)
        share = rules.top_share(x)
        n.measured = {"probabilistic_sharpe": statistics.probabilistic_sharpe(x), "deflated_sharpe": deflated, "minimum_track_record": needed, "mean": mean, "p": p, "top_three_periods": share}
        if len(x) < c.minimum_periods or needed is not None and len(x) < needed:
            n.add("TRACK_RECORD_SHORT", f"{len(x)} periods, {'at least ' + format(needed, '.0f') if needed else c.minimum_periods} needed.", periods=len(x), needed=needed)
        if c.n_trials > 1 and deflated < c.confidence:
            n.add("MULTIPLE_TESTING", f"Probability {deflated:.1%} after {c.n_trials} trials.", deflated=deflated, trials=c.n_trials)
        if p > 1 - c.confidence:
            n.add("MEAN_NOT_SIGNIFICANT", f"p = {p:.3f} under random signs.", p=p)
        if share > 0.50:
            n.add("RETURN_CONCENTRATION", f"Three periods make {share:.1%} of absolute returns.", share=share)
        return n.report()


@dataclass(frozen=True)
class Trials:
    ledger_path: str | Path | None = None
    name: str = "trials"

    def review(self, context: Context) -> Report:
        n, declared = _Notes(self.name), context.config.n_trials
        ledger = Ledger(Path(self.ledger_path or context.ledger_path or "trials.jsonl"))
        if not ledger.path.exists() and not ledger.head.exists():
            n.add("TRIALS_LEDGER_MISSING", f"There is no {ledger.path.name}.")
            return n.report()
        good, why, bad = ledger.check()
        if not good:
            n.add("TRIALS_LEDGER_TAMPERED", why, entry=bad)
            n.measured = {"holds": False}
            return n.report()
        seen = ledger.summary()
        n.measured = {"holds": True, "runs": seen["runs"], "variants": seen["variants"], "declared": declared}
        if seen["variants"] > declared:
            n.add("TRIALS_UNDERDECLARED", f"{seen['variants']} variants recorded, {declared} declared.", variants=seen["variants"], declared=declared)
        elif seen["variants"] < declared and seen["runs"]:
            n.add("TRIALS_OVERDECLARED", f"{seen['variants']} variants recorded, {declared} declared.", variants=seen["variants"], declared=declared)
        return n.report()
