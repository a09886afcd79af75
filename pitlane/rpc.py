"""A tool server: JSON-RPC 2.0, one message a line, over standard input and output."""

from __future__ import annotations

import json
import os

from pitlane import config, report
from pitlane.audit.rules import CODES
from pitlane.errors import ConfigurationError, PitlaneError
from pitlane.operators.backtest import Engine, screen
from pitlane.sources.files import resolve_within

LINE_BYTES, PROTOCOL = 1 << 20, "2024-11-05"
ROOT_VARIABLE = "PITLANE_ROOT"
_TEXT = {"type": "string"}
TOOLS = {
    "run_demo_verdict": ("Backtest and review the demo strategy on made-up data.", {"sessions": {"type": "integer"}, "catch": {"type": "boolean"}}, []),
    "run_project_verdict": ("Backtest and review a project.", {"project": _TEXT}, ["project"]),
    "run_screen": ("Rank a project's symbols at one date.", {"project": _TEXT, "as_of": _TEXT, "top": {"type": "integer"}}, ["project"]),
    "explain_finding": ("What a finding's code means and what to do.", {"code": _TEXT}, ["code"]),
    "list_findings": ("All codes.", {}, []),
}


def _project(path: str) -> config.Project:
    """A project file below the folder that the environment names, if it names one."""
    return config.read(resolve_within(os.environ.get(ROOT_VARIABLE) or ".", path, not os.environ.get(ROOT_VARIABLE)))


def _verdict(result, audit) -> dict:
    told = audit.to_dict()
    return {"verdict": audit.verdict, "score": audit.score, "metrics": result.metrics, "findings": told["findings"][:10], "recommendations": told["recommendations"][:6], "experiments": told["experiments"][:3]}


def call(name: str, arguments: dict):
    from pitlane import cli

    if name not in TOOLS:
        raise ConfigurationError(f"unknown tool {name!r}")
    _, known, needed = TOOLS[name]
    wrong = sorted(set(arguments) - set(known)) + sorted(set(needed) - set(arguments))
    if wrong:
        raise ConfigurationError(f"unknown or missing: {', '.join(wrong)}")
    if name == "list_findings":
        return [{"code": c, "severity": s, "title": t} for c, (s, t, _) in sorted(CODES.items())]
    if name == "explain_finding":
        code = str(arguments["code"]).strip().upper()
        if code not in CODES:
            raise ConfigurationError(f"unknown code {code!r}")
        severity, title, todo = CODES[code]
        return {"code": code, "severity": severity, "title": title, "recommendation": todo}
    spark = cli.spark_session()
    if name == "run_demo_verdict":
        result, audit, took = cli.demo(spark, int(arguments.get("sessions", 260)), bool(arguments.get("catch", False)))
        return _verdict(result, audit) | took
    p = _project(arguments["project"])
    bundle, strategy = p.make_adapter(spark).load(p.request), p.make_strategy()
    if name == "run_screen":
        found = screen(bundle, strategy, arguments.get("as_of"), int(arguments.get("top") or p.screen.top_n), p.screen.minimum_score)
        return {"as_of": found.as_of, "rows": [r.asDict() for r in found.rows.limit(20).collect()]}
    return _verdict(*cli.evaluate(bundle, strategy, Engine(p.backtest), cli.FAST, p.root / "trials.jsonl", None))


def answer(line: str) -> dict | None:
    """The reply to one line; none to a notification."""
    error = lambda i, code, why: {"jsonrpc": "2.0", "id": i, "error": {"code": code, "message": why}}
    if len(line.encode()) > LINE_BYTES:
        return error(None, -32600, "the message is too long")
    try:
        m = json.loads(line)
    except ValueError:
        return error(None, -32700, "no JSON")
    if not isinstance(m, dict) or m.get("jsonrpc") != "2.0" or not isinstance(m.get("method"), str):
        return error(m.get("id") if isinstance(m, dict) else None, -32600, "no request")
    i, method, params = m.get("id"), m["method"], m.get("params") or {}
    if "id" not in m:
        return None
    good = lambda r: {"jsonrpc": "2.0", "id": i, "result": r}
    if method == "initialize":
        return good({"protocolVersion": PROTOCOL, "serverInfo": {"name": "pitlane", "version": "1"}, "capabilities": {"tools": {}}})
    if method == "ping":
        return good({})
    if method == "tools/list":
        return good({"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": need, "additionalProperties": False}} for n, (d, p, need) in TOOLS.items()]})
    if method != "tools/call":
        return error(i, -32601, f"unknown method {method}")
    if not isinstance(params, dict) or not isinstance(params.get("arguments") or {}, dict):
        return error(i, -32602, "params and arguments are objects")
    try:
        found, failed = json.dumps(report.plain(call(str(params.get("name")), params.get("arguments") or {}))), False
    except (PitlaneError, ValueError) as e:
        found, failed = str(e), True
    return good({"content": [{"type": "text", "text": found}], "isError": failed})


def serve(lines, out) -> int:
    for line in lines:
        if line.strip() and (reply := answer(line)) is not None:
            out.write(json.dumps(reply) + "\n")
            out.flush()
    return 0


__all__ = ["TOOLS", "answer", "call", "serve"]
