"""Files of a run: JSON, a self-contained HTML page, a badge, a card, and a manifest of their hashes."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable
from dataclasses import asdict
from datetime import date, datetime
from html import escape
from pathlib import Path

from pitlane.audit.models import AuditReport
from pitlane.operators.backtest import Result, Screen, digest

DASH = "–"
COLOURS = {"PASS": "#2e7d32", "WARN": "#b26a00", "FAIL": "#b3261e"}
_PERCENT = {"total_return", "annual_return", "annual_volatility", "max_drawdown", "win_rate", "best", "worst", "var_95", "cvar_95", "annual_alpha", "average_gross_exposure"}
_TIMES = {"average_turnover", "annual_turnover"}


def plain(value):
    """value in JSON's terms: times as ISO text, numbers that aren't finite as null, sets sorted."""
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if hasattr(value, "item") and not isinstance(value, (list, tuple, dict, str)):
        value = value.item()
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (set, frozenset)):
        return sorted(map(plain, value))
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value if value is None or isinstance(value, (bool, int, str)) else str(value)


def write_json(path: Path, value) -> Path:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(plain(value), indent=2, sort_keys=True, ensure_ascii=False) + "\n", encoding="utf-8")
    return path


def shown(name: str, value) -> str:
    """A metric for people: per cent, counts, times, or three decimals; a dash for none."""
    if value is None or isinstance(value, float) and not math.isfinite(value):
        return DASH
    if name == "periods":
        return f"{int(value)}"
    if name in _PERCENT:
        return f"{value:.2%}"
    return f"{value:.2f}×" if name in _TIMES else f"{value:.3f}"


def equity_svg(values: list[float | None], width: int = 720, height: int = 180) -> str:
    """A line through the values between their least and greatest; gaps take the value before them, or the first one."""
    known = [v for v in values if v is not None and math.isfinite(v)]
    if len(known) < 2:
        return f'<svg viewBox="0 0 {width} {height}" role="img" aria-label="no equity curve"></svg>'
    last, filled = known[0], []
    for v in values:
        last = v if v is not None and math.isfinite(v) else last
        filled.append(last)
    low, span = min(filled), (max(filled) - min(filled)) or 1.0
    points = " ".join(f"{i * width / (len(filled) - 1):.1f},{height - (v - low) / span * height:.1f}" for i, v in enumerate(filled))
    return f'<svg viewBox="0 0 {width} {height}" role="img" aria-label="equity"><polyline fill="none" stroke="#1f5f8b" stroke-width="2" points="{points}"/></svg>'


def html_page(result: Result, audit: AuditReport, equity: list[float | None]) -> str:
    row = lambda *cells: "<tr>" + "".join(f"<td>{escape(str(c))}</td>" for c in cells) + "</tr>"
    listed = lambda xs: "".join(f"<li>{escape(x)}</li>" for x in xs) or f"<li>{DASH}</li>"
    metrics = "".join(row(k.replace("_", " "), shown(k, v)) for k, v in result.metrics.items())
    findings = "".join(row(f.severity.name, f.code, f.title, f.detail) for f in audit.findings)
    tries = "".join(row(e.rank, e.rule, e.diagnosis, e.prescription) for e in audit.experiments)
    return f"""<!doctype html><html lang="en"><meta charset="utf-8"><title>{escape(result.strategy_name)}</title>
<style>body{{font:15px/1.5 system-ui,sans-serif;max-width:60rem;margin:2rem auto;padding:0 1rem}}table{{border-collapse:collapse;width:100%}}td{{border-bottom:1px solid #ddd;padding:.25rem .5rem;vertical-align:top}}.v{{color:{COLOURS[audit.verdict]}}}</style>
<h1>{escape(result.strategy_name)} <span class="v">{audit.verdict} {audit.score}/100</span></h1><p>Run {escape(result.run_id)}, {len(audit.reports)} reviewers. {escape(" ".join(result.warnings))}</p>
{equity_svg(equity)}<h2>Metrics</h2><table>{metrics}</table><h2>Findings</h2><table>{findings}</table><h2>Experiments</h2><table>{tries}</table>
<h2>Strengths</h2><ul>{listed(audit.strengths)}</ul><h2>Next</h2><ul>{listed(audit.recommendations)}</ul></html>
"""


def badge(audit: AuditReport) -> dict:
    """What badge services read."""
    return {"schemaVersion": 1, "label": "audit", "message": f"{audit.verdict} {audit.score}/100", "color": COLOURS[audit.verdict].lstrip("#")}


def badge_url(audit: AuditReport) -> str:
    return f"https://img.shields.io/badge/audit-{audit.verdict}%20{audit.score}%2F100-{badge(audit)['color']}"


def card_svg(audit: AuditReport, title: str) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="420" height="120"><rect width="420" height="120" rx="8" fill="#fff" stroke="{COLOURS[audit.verdict]}"/><text x="20" y="45" font-size="18">{escape(title)}</text><text x="20" y="90" font-size="30" fill="{COLOURS[audit.verdict]}">{audit.verdict} {audit.score}/100</text></svg>'


def file_hash(path: Path) -> str:
    return hashlib.sha256(path.read_bytes()).hexdigest()


def artifact_fingerprint(manifest: dict) -> str:
    return digest(plain(manifest))


def write_run(folder: Path, result: Result, audit: AuditReport, narrative: Callable[[str], str] | None = None) -> Path:
    """result.json, audit.json, report.html, badge.json, card.svg and manifest.json below folder/<run id>, and the tables as Parquet.

    Of the tables only the equity curve, one number a period, comes to the driver.
    """
    out = Path(folder) / result.run_id
    equity = [r[0] for r in result.returns.select("equity").orderBy("exit").collect()]
    files = [
        write_json(out / "result.json", {"strategy": result.strategy_name, "config": asdict(result.config), "metrics": result.metrics, "benchmark_metrics": result.benchmark_metrics, "manifest": result.manifest, "warnings": result.warnings}),
        write_json(out / "audit.json", audit.to_dict() | ({"narrative": narrated(audit, narrative)} if narrative else {})),
        write_json(out / "badge.json", badge(audit)),
    ]
    for name, text in (("report.html", html_page(result, audit, equity)), ("card.svg", card_svg(audit, result.strategy_name))):
        files.append(out / name)
        files[-1].write_text(text, encoding="utf-8")
    for name, table in (("returns", result.returns), ("holdings", result.holdings), ("signals", result.signals)):
        table.write.mode("overwrite").parquet(f"file://{out.resolve()}/{name}.parquet")
    write_json(out / "manifest.json", result.manifest | {"artifacts": {f.name: file_hash(f) for f in files}})
    return out


def write_screen(path: Path, screen: Screen) -> Path:
    """A screen's rows; there are at most top_n."""
    return write_json(path, {"strategy": screen.strategy_name, "as_of": screen.as_of, "strategy_fingerprint": screen.strategy_fingerprint, "data_fingerprint": screen.data_fingerprint, "rows": [r.asDict() for r in screen.rows.collect()]})


def narrated(audit: AuditReport, narrative: Callable[[str], str], most: int = 8000) -> str:
    """What a caller's function makes of the audit's JSON, which is all it gets; cut to `most` characters."""
    told = narrative(json.dumps(plain(audit.to_dict()), sort_keys=True))
    return str(told)[:most]
