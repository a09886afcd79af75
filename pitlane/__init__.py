"""Point-in-time research on PySpark. Names are loaded when first asked for, so executors import only what they need."""

from __future__ import annotations

_HOMES = {
    "AuditConfig": "audit.models", "AuditReport": "audit.models", "Council": "audit.council", "BacktestConfig": "operators.backtest", "Engine": "operators.backtest", "screen": "operators.backtest",
    "Bundle": "sources.bundle", "Request": "sources.contracts", "Snapshot": "operators.strategy", "Strategy": "operators.strategy", "View": "operators.strategy", "walk_forward": "operators.walkforward",
}
__all__ = list(_HOMES)


def __getattr__(name: str):
    if name not in _HOMES:
        raise AttributeError(name)
    from importlib import import_module

    return getattr(import_module(f"pitlane.{_HOMES[name]}"), name)
