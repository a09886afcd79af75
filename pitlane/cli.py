"""Command line: init, validate, screen, backtest, walkforward, demo, serve, ledger, selfcheck."""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

from pitlane import config, report
from pitlane.audit.council import Council
from pitlane.audit.models import AuditConfig, AuditReport
from pitlane.audit.traps import self_check
from pitlane.errors import InsufficientDataError, PitlaneError
from pitlane.operators.backtest import BacktestConfig, Engine, Result, screen
from pitlane.operators.ledger import Ledger
from pitlane.operators.strategy import DemoComposite, Strategy
from pitlane.operators.walkforward import WalkForwardConfig, walk_forward
from pitlane.sources.bundle import Bundle
from pitlane.sources.files import FAIL
from pitlane.sources.synthetic import leaked_twin, synthetic_bundle

#: Settings for a quick answer: fewer simulations, dates and folds.
FAST = AuditConfig(bootstrap_simulations=100, permutation_simulations=100, causality_cutoffs=2, cost_multipliers=(0.0, 1.0, 2.0), stability_folds=2)


def spark_session() -> SparkSession:
    from pitlane.session import session, ship_code

    spark = SparkSession.getActiveSession() or session()
    ship_code(spark)
    return spark


def evaluate(bundle: Bundle, strategy: Strategy, engine: Engine, audit: AuditConfig, ledger: Path | None, record: str | None = "backtest", label: str = "") -> tuple[Result, AuditReport]:
    """Run, record and review."""
    plan = engine.prepare(bundle, strategy)
    result = engine.replay(plan)
    if ledger and record:
        m = result.manifest
        Ledger(ledger).append(record, label, run_id=result.run_id, strategy_name=result.strategy_name, strategy_fingerprint=result.strategy_fingerprint, config_fingerprint=m["config_fingerprint"], data_fingerprint=m["data_fingerprint"])
    return result, Council(ledger=ledger).review(bundle, strategy, engine, result, audit, plan)


def demo(spark: SparkSession, sessions: int = 260, catch: bool = False, audit: AuditConfig = FAST, ledger: Path | None = None) -> tuple[Result, AuditReport, dict]:
    """The demo composite on made-up data, or on its twin with leaked features; with seconds taken."""
    bundle = synthetic_bundle(spark, 7, sessions)
    bundle = leaked_twin(bundle) if catch else bundle
    engine, start = Engine(BacktestConfig(top_k=3, max_weight=0.4, benchmark_symbol="DEMO-BENCH")), time.perf_counter()
    result, found = evaluate(bundle, DemoComposite(), engine, audit, ledger, "demo")
    return result, found, {"seconds": round(time.perf_counter() - start, 3)}


def summary(result: Result, audit: AuditReport, most: int = 10) -> str:
    lines = [f"{result.strategy_name}: {audit.verdict} {audit.score}/100 (run {result.run_id})"]
    lines += [f"  {k.replace('_', ' ')}: {report.shown(k, v)}" for k, v in result.metrics.items() if k in ("periods", "total_return", "sharpe", "max_drawdown", "annual_turnover")]
    lines += [f"  {f.severity.name:<8} {f.code}: {f.detail}" for f in audit.findings[:most]]
    lines += [f"  {e.rank}. {e.prescription}" for e in audit.experiments[:5]]
    return "\n".join(lines)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pitlane", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, **arguments):
        s = sub.add_parser(name)
        for k, v in arguments.items():
            s.add_argument(k if v.pop("plain", False) else "--" + k.replace("_", "-"), **v)
        return s

    project = {"plain": True, "nargs": "?", "default": "pitlane.yml"}
    flag = {"action": "store_true"}
    add("init", folder={"plain": True}, force=dict(flag))
    add("validate", project=dict(project))
    add("screen", project=dict(project), as_of={}, top={"type": int}, out={})
    add("backtest", project=dict(project), json=dict(flag), no_ledger=dict(flag), label={"default": ""})
    add("walkforward", project=dict(project), train={"type": int, "default": 52}, test={"type": int, "default": 13}, embargo={"type": int, "default": 1}, out={})
    add("demo", sessions={"type": int, "default": 260}, show_catch=dict(flag), json=dict(flag), out={})
    add("serve")
    add("ledger", action={"plain": True, "choices": ("show", "verify", "note")}, text={"plain": True, "nargs": "?", "default": ""}, path={"default": "trials.jsonl"})
    add("selfcheck")
    return p


def run(a: argparse.Namespace, say=print) -> int:
    if a.command == "init":
        say("\n".join(map(str, config.scaffold(a.folder, a.force))))
        return 0
    if a.command == "ledger":
        ledger = Ledger(Path(a.path))
        if a.action == "note":
            say(ledger.append("note", a.text)["entry_hash"])
        elif a.action == "show":
            say(json.dumps(ledger.summary(), indent=2))
        else:
            good, why = ledger.verify()
            say(why)
            return 0 if good else 1
        return 0
    if a.command == "serve":
        from pitlane.rpc import serve

        return serve(sys.stdin, sys.stdout)
    spark = spark_session()
    if a.command == "selfcheck":
        return 1 if self_check(spark, say) else 0
    if a.command == "demo":
        result, audit, took = demo(spark, a.sessions, a.show_catch)
        say(json.dumps(report.plain({"metrics": result.metrics, "audit": audit.to_dict()} | took)) if a.json else summary(result, audit))
        if a.out:
            say(str(report.write_run(Path(a.out), result, audit)))
        return 0
    p = config.read(a.project)
    adapter, strategy = p.make_adapter(spark), p.make_strategy()
    health = adapter.health()
    if health.status == FAIL:
        raise InsufficientDataError("; ".join(health.messages))
    bundle = adapter.load(p.request)
    if a.command == "validate":
        say(json.dumps(report.plain({"health": health.status, "messages": health.messages, "strategy": strategy.name} | bundle.describe()), indent=2))
    elif a.command == "screen":
        found = screen(bundle, strategy, a.as_of, a.top or p.screen.top_n, p.screen.minimum_score)
        for r in found.rows.limit(20).collect():
            say(f"{r['rank']:>3} {r['symbol']:<12} {r['score']:.4f} {r['rationale']}")
        if a.out:
            report.write_screen(Path(a.out), found)
    elif a.command == "walkforward":
        found = walk_forward(bundle, strategy, Engine(p.backtest), WalkForwardConfig(a.train, a.test, a.embargo))
        say(f"{found.verdict_hint}: {len(found.folds)} folds, out-of-sample Sharpe ratio {found.pooled_sharpe:.3f} a period")
        report.write_json(Path(a.out) if a.out else p.output / "walkforward.json", found.to_dict())
    else:
        ledger = p.root / "trials.jsonl"
        result, audit = evaluate(bundle, strategy, Engine(p.backtest), p.audit, ledger, None if a.no_ledger else "backtest", a.label)
        folder = report.write_run(p.output, result, audit)
        say(json.dumps(report.plain({"run": result.run_id, "metrics": result.metrics, "audit": audit.to_dict()})) if a.json else summary(result, audit) + f"\n{folder}")
    return 0


def main(argv: list[str] | None = None) -> int:
    """0, or 1 for a ledger or self-check that doesn't hold, or 2 for an expected error."""
    try:
        return run(parser().parse_args(argv))
    except (PitlaneError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


__all__ = ["FAST", "demo", "evaluate", "main", "summary"]

if __name__ == "__main__":
    sys.exit(main())
