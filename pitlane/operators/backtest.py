"""Backtests: prepare a plan once (cost-independent), replay it at any cost; screens use the same plan with one date."""

from __future__ import annotations

import hashlib
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlane.errors import ConfigurationError, InsufficientDataError
from pitlane.functions import metrics
from pitlane.operators import calendar, portfolio
from pitlane.operators import signals as signal_rules
from pitlane.operators.ledger import canonical_json
from pitlane.operators.strategy import Strategy
from pitlane.sources.bundle import Bundle, frame_fingerprint
from pitlane.sources.contracts import utc

PER_YEAR = {"daily": 252, "weekly": 52, "monthly": 12}
VERSION = "1"


def digest(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


@dataclass(frozen=True)
class BacktestConfig:
    start: str | datetime | None = None
    end: str | datetime | None = None
    rebalance: str = "weekly"
    top_k: int = 10
    minimum_score: float | None = None
    weighting: str = "equal"
    max_weight: float = 0.20
    commission_bps: float = 5.0
    slippage_bps: float = 10.0
    benchmark_symbol: str | None = None
    initial_capital: float = 100_000.0
    annual_risk_free_rate: float = 0.0
    seed: int = 7

    def __post_init__(self):
        wrong = [
            what
            for what, bad in (
                ("rebalance is daily, weekly or monthly", self.rebalance not in PER_YEAR),
                ("weighting is equal, rank or score", self.weighting not in ("equal", "rank", "score")),
                ("top_k must be positive", self.top_k <= 0),
                ("max_weight must be above 0 and at most 1", not 0 < self.max_weight <= 1),
                ("costs must not be negative", min(self.commission_bps, self.slippage_bps) < 0),
                ("initial_capital must be positive", self.initial_capital <= 0),
            )
            if bad
        ]
        if wrong:
            raise ConfigurationError("; ".join(wrong))
        if self.benchmark_symbol is not None:
            object.__setattr__(self, "benchmark_symbol", self.benchmark_symbol.strip().upper())
        utc(self.start), utc(self.end)

    @property
    def periods_per_year(self) -> int:
        return PER_YEAR[self.rebalance]

    @property
    def total_cost_bps(self) -> float:
        return self.commission_bps + self.slippage_bps

    def with_cost_multiplier(self, m: float) -> BacktestConfig:
        if m < 0:
            raise ConfigurationError("a cost multiplier must not be negative")
        return replace(self, commission_bps=self.commission_bps * m, slippage_bps=self.slippage_bps * m)

    def fingerprint(self) -> str:
        """Of what decides the trades; bounds, capital and the risk-free rate show in the returns."""
        return digest({k: v for k, v in asdict(self).items() if k not in ("start", "end", "initial_capital", "annual_risk_free_rate")})


@dataclass(frozen=True)
class Plan:
    """What doesn't depend on costs. turnover holds decision, turnover; periods has gross returns and benchmark returns."""

    config: BacktestConfig
    strategy_name: str
    strategy_fingerprint: str
    data_fingerprint: str
    schedule: DataFrame
    signals: DataFrame
    held: DataFrame
    periods: DataFrame
    dropped: int


@dataclass(frozen=True)
class Result:
    config: BacktestConfig
    strategy_name: str
    strategy_fingerprint: str
    returns: DataFrame
    holdings: DataFrame
    signals: DataFrame
    metrics: dict
    benchmark_metrics: dict
    manifest: dict
    warnings: tuple[str, ...] = ()

    @property
    def run_id(self) -> str:
        return self.manifest["run_id"]


@dataclass(frozen=True)
class Engine:
    config: BacktestConfig = field(default_factory=BacktestConfig)

    def schedule(self, bundle: Bundle) -> DataFrame:
        days = calendar.sessions(bundle.prices.withColumnRenamed("timestamp", "session"))
        start, end = utc(self.config.start), utc(self.config.end)
        return calendar.decisions(days, self.config.rebalance, start and start.isoformat(), end and end.isoformat())

    def prepare(self, bundle: Bundle, strategy: Strategy) -> Plan:
        if not bundle.prices.limit(1).count():
            raise InsufficientDataError("a backtest needs prices")
        c = self.config
        schedule = self.schedule(bundle).persist()
        if schedule.where("execution is not null").count() < 2:
            raise InsufficientDataError("fewer than two decisions can be executed")
        prices = bundle.prices.withColumnRenamed("timestamp", "session")
        decided = schedule.where("exit is not null").select("decision")
        signals = signal_rules.checked(strategy.signals(bundle, decided).persist())
        weighted = portfolio.weights(portfolio.top(signals.where("eligible"), c.top_k, c.minimum_score), c.weighting, c.max_weight)
        held = portfolio.holdings(weighted, schedule, prices).persist()
        rows = portfolio.periods(held, schedule, 0.0).drop("cost", "strategy_return")
        if c.benchmark_symbol:
            own = prices.where(F.col("symbol") == c.benchmark_symbol).select("session", "open")
            for day, name in (("execution", "b0"), ("exit", "b1")):
                rows = rows.join(own.withColumnsRenamed({"session": day, "open": name}), day, "left")
            rows = rows.withColumn("benchmark_return", F.when(F.col("b0") > 0, F.col("b1") / F.col("b0") - 1)).drop("b0", "b1")
        else:
            rows = rows.withColumn("benchmark_return", F.lit(None).cast("double"))
        dropped = weighted.join(schedule.where("exit is not null").select("decision"), "decision", "left_semi").count() - held.count()
        return Plan(c, strategy.name, strategy.fingerprint(), bundle.fingerprint(), schedule, signals, held, rows.persist(), dropped)

    def replay(self, plan: Plan, commission_bps: float | None = None, slippage_bps: float | None = None) -> Result:
        """The plan at costs: the engine's own, or those given with the plan's other settings."""
        config = self.config
        if commission_bps is not None or slippage_bps is not None:
            config = replace(plan.config, **{k: v for k, v in (("commission_bps", commission_bps), ("slippage_bps", slippage_bps)) if v is not None})
        cost = F.col("turnover") * config.total_cost_bps / 1e4
        rows = plan.periods.withColumn("cost", cost).withColumn("strategy_return", F.col("gross_return") - F.col("cost"))
        rows = portfolio.equity(rows, "strategy_return", config.initial_capital)
        rows = portfolio.equity(rows.withColumnsRenamed({"equity": "strategy_equity", "drawdown": "strategy_drawdown"}), "benchmark_return", config.initial_capital)
        rows = rows.withColumnsRenamed({"equity": "benchmark_equity", "drawdown": "benchmark_drawdown"}).withColumnsRenamed({"strategy_equity": "equity", "strategy_drawdown": "drawdown"}).persist()
        per, rf = config.periods_per_year, config.annual_risk_free_rate
        own = metrics.summary(rows.select("exit", "strategy_return", "benchmark_return", "turnover", "gross_exposure"), per, rf).first().asDict()
        bench = rows.where("benchmark_return is not null").select("exit", F.col("benchmark_return").alias("strategy_return"))
        bench = bench.withColumns({"benchmark_return": F.lit(None).cast("double"), "turnover": F.lit(0.0), "gross_exposure": F.lit(1.0)})
        bench_metrics = metrics.summary(bench, per, rf).first().asDict() if config.benchmark_symbol else {}
        periods = own["periods"]
        content = {"schema": VERSION, "data_fingerprint": plan.data_fingerprint, "strategy_fingerprint": plan.strategy_fingerprint, "config_fingerprint": config.fingerprint(), "periods": periods, "result_fingerprint": frame_fingerprint(rows.select("exit", *(F.round(c, 12).alias(c) for c in ("gross_return", "cost", "strategy_return", "benchmark_return"))))}
        warnings = ["Hypothetical research output, no advice to trade."]
        if plan.dropped:
            warnings.append(f"{plan.dropped} picks had no executable price and stayed cash.")
        return Result(config, plan.strategy_name, plan.strategy_fingerprint, rows, plan.held, plan.signals, own, bench_metrics, content | {"run_id": digest(content)[:16]}, tuple(warnings))

    def run(self, bundle: Bundle, strategy: Strategy) -> Result:
        return self.replay(self.prepare(bundle, strategy))


def cost_curve(plan: Plan, multipliers) -> dict[float, float]:
    """Total return by cost multiplier; turnover doesn't depend on costs, so all multipliers are one aggregate."""
    bps = plan.config.total_cost_bps
    grid = plan.periods.withColumn("m", F.explode(F.array(*(F.lit(float(m)) for m in multipliers))))
    rows = grid.groupBy("m").agg((F.product(1 + F.col("gross_return") - F.col("turnover") * F.col("m") * bps / 1e4) - 1).alias("total")).collect()
    return {r["m"]: r["total"] for r in sorted(rows, key=lambda r: r["m"])}


@dataclass(frozen=True)
class Screen:
    strategy_name: str
    strategy_fingerprint: str
    data_fingerprint: str
    as_of: datetime
    rows: DataFrame


def screen(bundle: Bundle, strategy: Strategy, as_of: datetime | str | None = None, top_n: int = 20, minimum_score: float | None = None) -> Screen:
    """rank, symbol, score, rationale of one date, by default the last session: the backtest's path with one decision."""
    when = utc(as_of) if as_of is not None else bundle.bounds()[1]
    if when is None:
        raise InsufficientDataError("a screen needs prices")
    one = bundle.prices.sparkSession.createDataFrame([(when,)], "decision timestamp")
    # a date between sessions sees what its last session saw
    known = bundle.as_of(one.first()[0])
    last = known.bounds()[1]
    if last is None:
        raise InsufficientDataError("no prices up to this date")
    spark = bundle.prices.sparkSession
    signals = signal_rules.checked(strategy.signals(known, spark.createDataFrame([(last,)], "decision timestamp")))
    best = portfolio.top(signals.where("eligible"), top_n, minimum_score)
    rows = best.select(F.col("position").alias("rank"), "symbol", "score", "rationale").orderBy("rank")
    return Screen(strategy.name, strategy.fingerprint(), bundle.fingerprint(), when, rows)
