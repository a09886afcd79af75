"""Project files: YAML version 1, read strictly and without object constructors."""

from __future__ import annotations

import inspect
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import SparkSession

from pitlane.audit.models import AuditConfig
from pitlane.errors import ConfigurationError, PitlaneError
from pitlane.operators.backtest import BacktestConfig
from pitlane.operators.strategy import Strategy, load
from pitlane.sources.contracts import KINDS, Request
from pitlane.sources.files import adapter_class, resolve_within


@dataclass(frozen=True)
class ScreenConfig:
    top_n: int = 20
    minimum_score: float | None = None

    def __post_init__(self):
        if self.top_n < 1:
            raise ConfigurationError("screen.top_n must be positive")


@dataclass(frozen=True)
class Project:
    root: Path
    adapter: str
    options: dict
    strategy: str
    request: Request = field(default_factory=Request)
    screen: ScreenConfig = field(default_factory=ScreenConfig)
    backtest: BacktestConfig = field(default_factory=BacktestConfig)
    audit: AuditConfig = field(default_factory=AuditConfig)
    output_dir: str = "runs"
    allow_outside_root: bool = False

    @property
    def output(self) -> Path:
        return resolve_within(self.root, self.output_dir, self.allow_outside_root)

    def make_adapter(self, spark: SparkSession):
        made = adapter_class(self.adapter)
        offered = {"spark": spark, "root": str(self.root), "allow_outside_root": self.allow_outside_root}
        wanted = inspect.signature(made).parameters
        try:
            return made(**{k: v for k, v in offered.items() if k in wanted} | self.options)
        except TypeError as e:
            raise ConfigurationError(f"data.options: {e}") from e

    def make_strategy(self) -> Strategy:
        return load(self.strategy, self.root, self.allow_outside_root)


def _mapping(value, where: str, allowed=None) -> dict:
    value = {} if value is None else value
    if not isinstance(value, dict) or not all(isinstance(k, str) for k in value):
        raise ConfigurationError(f"{where} must be a mapping")
    unknown = sorted(set(value) - set(allowed)) if allowed is not None else []
    if unknown:
        raise ConfigurationError(f"unknown in {where}: {', '.join(unknown)}")
    return dict(value)


def _section(cls, value, where: str):
    try:
        return cls(**_mapping(value, where, [f.name for f in fields(cls)]))
    except (TypeError, ValueError) as e:
        raise ConfigurationError(f"{where}: {e}") from e


ROOT_KEYS = ("version", "data", "strategy", "request", "screen", "backtest", "audit", "output_dir", "allow_outside_root")


def read(path: str | Path) -> Project:
    try:
        import yaml
    except ImportError as e:
        raise ConfigurationError("project files need a YAML reader") from e
    path = Path(path).expanduser().resolve()
    if not path.is_file():
        raise ConfigurationError(f"no project file {path}")
    try:
        raw = _mapping(yaml.safe_load(path.read_text(encoding="utf-8")), "the project file", ROOT_KEYS)
    except yaml.YAMLError as e:
        raise ConfigurationError(f"no YAML: {e}") from e
    if raw.get("version", 1) != 1:
        raise ConfigurationError("only version 1 is known")
    data = _mapping(raw.get("data"), "data", ("adapter", "options"))
    for where, value in (("data.adapter", data.get("adapter")), ("strategy", raw.get("strategy"))):
        if not isinstance(value, str) or not value.strip():
            raise ConfigurationError(f"{where} is required")
    outside = raw.get("allow_outside_root", False)
    if not isinstance(outside, bool):
        raise ConfigurationError("allow_outside_root is true or false")
    wanted = _mapping(raw.get("request"), "request", ("start", "end", "symbols", "kinds"))
    try:
        request = Request(wanted.get("start"), wanted.get("end"), tuple(wanted.get("symbols") or ()), tuple(wanted.get("kinds") or KINDS))
    except (TypeError, AttributeError) as e:
        raise ConfigurationError(f"request: {e}") from e
    project = Project(path.parent, data["adapter"].strip(), _mapping(data.get("options"), "data.options"), raw["strategy"].strip(), request, _section(ScreenConfig, raw.get("screen"), "screen"), _section(BacktestConfig, raw.get("backtest"), "backtest"), _section(AuditConfig, raw.get("audit"), "audit"), str(raw.get("output_dir", "runs")), outside)
    _ = project.output  # refuses a way out
    return project


#: What a new project holds, by file name.
TEMPLATE = {
    "pitlane.yml": """version: 1
data:
  adapter: files
  options:
    prices: data/prices.csv
    metadata:
      price_adjustment: unknown
      survivorship: unknown
strategy: strategy.py:MyStrategy
backtest:
  rebalance: weekly
  top_k: 5
  benchmark_symbol: null
""",
    "strategy.py": '''from pitlane.operators.strategy import Strategy


class MyStrategy(Strategy):
    """Momentum over half a year."""

    name = "my strategy"
    minimum_history = 127

    def scores(self, view):
        return view.trailing_momentum(126).withColumnRenamed("value", "score")
''',
    "data/README.md": "prices.csv: symbol, timestamp, open, high, low, close, volume, source\n",
    ".gitignore": "runs/\n",
}


def scaffold(folder: str | Path, force: bool = False) -> list[Path]:
    """Write TEMPLATE into a folder; files that are there stop it unless forced."""
    out = [Path(folder) / name for name in TEMPLATE]
    there = [str(p) for p in out if p.exists()]
    if there and not force:
        raise ConfigurationError(f"already there: {', '.join(there)}")
    for p, text in zip(out, TEMPLATE.values()):
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text, encoding="utf-8")
    return out


__all__ = ["PitlaneError", "Project", "ScreenConfig", "read", "scaffold"]
