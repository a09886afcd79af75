"""Contracts, adapters, strategies, engine, walk-forward, audit, ledger, project files, command line and tool server."""

import io
import json
import sqlite3
from datetime import UTC, datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import pitlane
from pitlane import cli, config, report, rpc
from pitlane.audit import causality, council, diagnosis, reviewers, rules, traps
from pitlane.audit.models import AuditConfig, Context, Finding, Severity
from pitlane.errors import ConfigurationError, DataContractError, InsufficientDataError, SecurityBoundaryError, StrategyContractError
from pitlane.functions import statistics
from pitlane.operators import asof, signals, strategy, walkforward
from pitlane.operators.backtest import BacktestConfig, Engine, cost_curve, screen
from pitlane.operators.ledger import Ledger
from pitlane.sources import files, provider, synthetic
from pitlane.sources.bundle import Bundle, frame_fingerprint
from pitlane.sources.contracts import CONTRACTS, Request, utc

DAYS = pd.bdate_range("2024-01-01", periods=6)


def tiny_prices() -> pd.DataFrame:
    out = []
    for offset, s in enumerate(("AAA", "BBB")):
        close = 100.0 + offset + np.arange(6)
        out.append(pd.DataFrame({"symbol": s, "timestamp": DAYS, "open": close - 0.5, "high": close + 1, "low": close - 1, "close": close, "volume": 1000.0 + np.arange(6), "source": "t"}))
    return pd.concat(out, ignore_index=True)


@pytest.fixture(scope="module")
def demo(spark):
    bundle = synthetic.synthetic_bundle(spark, 11, 130)
    engine = Engine(BacktestConfig(top_k=3, max_weight=0.4, benchmark_symbol=" demo-bench "))
    plan = engine.prepare(bundle, strategy.DemoComposite())
    return bundle, engine, plan, engine.replay(plan)


# -- contracts, bundles, adapters -----------------------------------------------------------


def test_contracts_name_every_broken_rule(spark):
    p = tiny_prices()
    good = Bundle.of(spark, prices=synthetic.table(spark, p.assign(symbol=[f" {s.lower()} " for s in p["symbol"]], extra=1)))
    assert {r.symbol for r in good.symbols().collect()} == {"AAA", "BBB"} and "extra" in good.prices.columns
    for change, rule in (({"open": "x"}, "bad_open (12)"), ({"symbol": " "}, "blank_symbol (12)"), ({"timestamp": "never"}, "bad_timestamp (12)"), ({"source": ""}, "blank_source (12)"), ({"symbol": "A"}, "duplicate_key (6)")):
        with pytest.raises(DataContractError, match=rule.replace("(", r"\(").replace(")", r"\)")):
            CONTRACTS["prices"].apply(synthetic.table(spark, p.assign(**change)))
    with pytest.raises(DataContractError, match="lacks columns: close, volume"):
        CONTRACTS["prices"].apply(synthetic.table(spark, p.drop(columns=["close", "volume"])))
    assert CONTRACTS["prices"].apply(spark.createDataFrame([], "a int")).columns == list(CONTRACTS["prices"].types)
    assert CONTRACTS["prices"].apply(synthetic.table(spark, p.assign(volume="none"))).where("volume is null").count() == 12
    events = spark.createDataFrame([("a", "2024-01-02", "2024-01-02", "n", x, "s") for x in (None, "", '{"k": 1}')], "symbol string, event_at string, available_at string, event_type string, payload string, source string")
    assert sorted(r.payload for r in CONTRACTS["events"].apply(events).collect()) == ['{"k": 1}', "{}", "{}"]
    with pytest.raises(DataContractError, match="payload_no_object"):
        CONTRACTS["events"].apply(events.withColumn("payload", F.lit("[]")))
    universe = spark.createDataFrame([("a", "2024-01-02", None, "2024-01-02", "s")], "symbol string, effective_from string, effective_to string, available_at string, source string")
    assert CONTRACTS["universe"].apply(universe).count() == 1
    for to, rule in (("2024-01-02", "empty_interval"), ("soon", "bad_effective_to")):
        with pytest.raises(DataContractError, match=rule):
            CONTRACTS["universe"].apply(universe.withColumn("effective_to", F.lit(to)))
    features = spark.createDataFrame([("a", "2024-01-02", "2024-01-03", " eps ", "high", "s")], "symbol string, observed_at string, available_at string, feature string, value string, source string")
    row = CONTRACTS["features"].apply(features).first()
    assert (row.feature, row.revision, row.value, row.value_num) == ("eps", 0, "high", None)


def test_requests():
    r = Request("2024-01-02", datetime(2024, 2, 1, tzinfo=UTC), (" aaa", "BBB", "AAA"), ("events", "prices"))
    assert r.symbols == ("AAA", "BBB") and r.kinds == ("prices", "events") and r.start == datetime(2024, 1, 2, tzinfo=UTC)
    assert utc("2024-01-01T05:00:00+05:00") == datetime(2024, 1, 1, tzinfo=UTC)
    for wrong in ({"start": "2024-02-01", "end": "2024-01-01"}, {"symbols": ("",)}, {"symbols": "AAA"}, {"kinds": ("bonds",)}, {"start": "soon"}):
        with pytest.raises(ConfigurationError):
            Request(**wrong)


def test_bundle_cuts_and_fingerprints(spark, demo):
    p = synthetic.table(spark, tiny_prices())
    b = Bundle.of(spark, {"a": 1}, prices=p)
    again = Bundle.of(spark, {"a": 1}, prices=p.orderBy(F.desc("close")).select(*reversed(p.columns)))
    assert b.fingerprint() == again.fingerprint() != Bundle.of(spark, {"a": 2}, prices=p).fingerprint()
    assert frame_fingerprint(p) != frame_fingerprint(p.withColumn("close", F.col("close") + 1e-9)) != frame_fingerprint(p.drop("close"))
    assert frame_fingerprint(p) != frame_fingerprint(p.union(p.limit(1)))
    cut = b.as_of("2024-01-03")
    assert cut.prices.count() == 6 and cut.describe()["symbols"] == 2
    assert b.select(Request(kinds=("events",))).prices.count() == 0
    assert b.with_prices(p.where("symbol = 'AAA'")).prices.count() == 6
    whole = demo[0]
    t = F.lit("2020-03-02").cast("timestamp")
    seen = whole.as_of("2020-03-02")
    assert seen.features.where((F.col("available_at") > t) | (F.col("observed_at") > t)).count() == 0 == seen.events.where(F.col("available_at") > t).count()
    assert synthetic.leaked_twin(whole).features.where("available_at < observed_at").count() == 3
    with pytest.raises(ConfigurationError):
        synthetic.tables(sessions=99)


def test_file_adapter(spark, tmp_path):
    made = synthetic.example_files(tmp_path / "data", sessions=90)
    made["prices"].with_name("p.parquet").parent.mkdir(exist_ok=True)
    a = files.FileAdapter(spark, "data/prices.csv", "data/features.csv", "data/events.csv", "data/universe.csv", {"data_classification": "mine"}, str(tmp_path))
    assert isinstance(a, files.Adapter) and a.health().status == files.PASS
    b = a.load(Request(symbols=("EX1", "index"), end="2021-02-01"))
    assert b.metadata == {"adapter": "files", "data_classification": "mine"}
    assert sorted(r[0] for r in b.prices.select("symbol").distinct().collect()) == ["EX1", "INDEX"]
    assert b.events.select(F.expr("variant_get(parse_json(payload), '$.sentiment', 'double')")).where("1 = 1").count() > 0  # doubled quotes were read
    b.prices.write.parquet(str(tmp_path / "p.parquet"))
    assert files.FileAdapter(spark, "p.parquet", root=str(tmp_path)).load().prices.count() == b.prices.count()
    gone = files.FileAdapter(spark, "none.csv", root=str(tmp_path)).health()
    assert gone.status == files.FAIL and "missing" in gone.messages[0]
    for path, error in (("../x.csv", SecurityBoundaryError), ("s3://x/y.csv", SecurityBoundaryError), ("", ConfigurationError)):
        with pytest.raises(error):
            files.FileAdapter(spark, path, root=str(tmp_path))
    with pytest.raises(ConfigurationError):
        files.scan(spark, "x.xlsx")
    assert files.adapter_class("files") is files.FileAdapter is files.adapter_class("pitlane.sources.files:FileAdapter")
    for unknown in ("nothing", "pitlane.sources.files:Nothing", "no.module:X"):
        with pytest.raises(ConfigurationError):
            files.adapter_class(unknown)


def test_sqlite_adapter(spark, tmp_path):
    path = tmp_path / "x.db"
    with sqlite3.connect(path) as c:
        tiny_prices().assign(timestamp=lambda d: d["timestamp"].astype(str)).to_sql("prices", c, index=False)
    a = files.SqliteAdapter(spark, str(path))
    assert a.health().status == files.PASS and a.load().prices.count() == 12
    with pytest.raises(ConfigurationError):
        files.SqliteReader(str(path))(spark, "prices; drop")


def test_provider(spark, tmp_path):
    days, calls, slept = pd.bdate_range("2024-01-01", periods=3), [], []

    def fetch(names, start, end):
        calls.append(names)
        if len(calls) == 1:
            raise OSError("busy")
        columns = pd.MultiIndex.from_product([names, ["Open", "High", "Low", "Close", "Volume"]])
        out = pd.DataFrame(5.0, index=[*days, days[-1]], columns=columns)
        out.iloc[0, 3] = None  # a session without a close
        out.iloc[2, 4] = None
        out.iloc[3, 3] = 7.0  # given again: the later row holds
        return out

    a = provider.ProviderAdapter(spark, fetch, ("AAA", "BBB"), str(tmp_path), sleep=slept.append)
    b = a.load()
    rows = {(r.symbol, str(r.timestamp)[:10]): (r.close, r.volume) for r in b.prices.collect()}
    assert slept == [0.5] and len(rows) == 5 and rows["AAA", "2024-01-03"] == (7.0, 5.0) and ("AAA", "2024-01-01") not in rows
    assert b.universe.where("effective_to is null").count() == 2
    n = len(calls)
    assert a.load(Request(symbols=("aaa", "BBB"))).prices.count() == 5 and len(calls) == n  # from the cache
    with pytest.raises(ConfigurationError):
        a.load(Request(symbols=("ZZZ",)))

    def broken(*_):
        raise OSError("down")

    with pytest.raises(InsufficientDataError):
        provider.ProviderAdapter(spark, broken, ("AAA",), sleep=lambda _: None).load()


# -- signals and strategies -----------------------------------------------------------------


def test_signals(spark):
    rows = spark.createDataFrame([("d", " bbb ", 1.0, None), ("d", "aaa", 2.0, None), ("d", "c", float("nan"), False)], "decision string, symbol string, score double, eligible boolean")
    got = signals.checked(rows).orderBy(F.desc_nulls_last("score"), "symbol").collect()
    assert [(r.symbol, r.score, r.eligible, r.rationale) for r in got] == [("AAA", 2.0, True, ""), ("BBB", 1.0, True, ""), ("C", None, False, "")]
    for bad in (rows.drop("score"), rows.withColumn("symbol", F.lit("x")), rows.withColumn("symbol", F.lit("")), rows.withColumn("eligible", F.lit(True))):
        with pytest.raises(StrategyContractError):
            signals.checked(bad)
    assert signals.frame_of({"a": 1}).iloc[0].to_dict() == {"symbol": "A", "score": 1, "eligible": True, "rationale": ""}
    assert signals.frame_of(pd.Series([1.0], index=["b"]))["symbol"].tolist() == ["B"]
    assert signals.frame_of(pd.DataFrame({"score": [1.0], "rationale": ["x" * 2000]}, index=["c"]))["rationale"].str.len().tolist() == [1000]
    for bad in (3, pd.DataFrame({"symbol": ["a"]})):
        with pytest.raises(StrategyContractError):
            signals.frame_of(bad)


class ThreeSessions(strategy.Strategy):
    name, minimum_history = "three", 4

    def scores(self, view):
        return view.trailing_momentum(3).withColumnRenamed("value", "score")


class ThreeSessionsInPython(strategy.Strategy):
    name, minimum_history = "three", 4

    def score(self, snapshot):
        assert snapshot.prices["timestamp"].max() <= snapshot.as_of
        return snapshot.trailing_momentum(3)


def test_both_kinds_of_strategy_agree(spark):
    b = Bundle.of(spark, prices=synthetic.table(spark, tiny_prices()))
    at = b.prices.select(F.col("timestamp").alias("decision")).distinct()
    one, two = (s.signals(b, at) for s in (ThreeSessions(), ThreeSessionsInPython()))
    assert one.exceptAll(two).count() == two.exceptAll(one).count() == 0 and one.count() == 6
    assert {r.symbol: r.score for r in one.where("decision = '2024-01-08'").collect()}["AAA"] == pytest.approx(105 / 102 - 1)
    with pytest.raises(ValueError):
        strategy.View(b, at).trailing_momentum(0)
    with pytest.raises(StrategyContractError):
        strategy.Strategy().raw(b, at)


class PricesAlone(strategy.Strategy):
    name = "prices alone"

    def score(self, snapshot):
        assert not vars(snapshot).keys() & {"features", "events", "universe"}  # weren't gathered for it
        return snapshot.trailing_momentum(3)


class FactsWhenLate(strategy.Strategy):
    """Looks at facts only on some dates, and hides what it misses."""

    name, lookback_sessions = "facts when late", 5

    def score(self, snapshot):
        prices = snapshot.prices.groupby("symbol").size()
        if not len(prices):
            return {"NONE": float(len(snapshot.features))}
        if snapshot.as_of < pd.Timestamp("2024-01-04"):
            return prices.astype(float)
        try:
            n = len(snapshot.features)
        except BaseException:  # noqa: B036 - a strategy may do so
            return {"AAA": -1.0}
        return {s: n * 100.0 + (len(snapshot.events) if n > 1 else 0) * 10 + len(snapshot.universe) for s in prices.index}


def test_facts_go_only_to_dates_that_ask(spark):
    day = lambda d: f"timestamp'2024-01-{d:02d}'"
    features = spark.sql(" union all ".join(f"select 'AAA' as symbol, {day(d)} as observed_at, {day(d)} as available_at, 'q' as feature, '1' as value, 1 as revision, 's' as source" for d in (1, 4, 5)))
    events = spark.sql(f"select 'AAA' as symbol, {day(2)} as event_at, {day(2)} as available_at, 'e' as event_type, '{{}}' as payload, 's' as source")
    b = Bundle.of(spark, prices=synthetic.table(spark, tiny_prices()), features=features, events=events)
    at = b.prices.select(F.col("timestamp").alias("decision")).distinct()
    alone = PricesAlone().signals(b, at)
    assert alone.count() == 6 and alone.exceptAll(ThreeSessions().signals(b, at)).count() == 0
    late = FactsWhenLate().raw(b, at.unionAll(spark.sql(f"select {day(6)} as decision"))).orderBy("decision", "symbol").collect()
    # a Saturday is no session, so no prices are known in its lookback, but facts are
    assert [(r.decision.day, r.symbol, r.score) for r in late] == [
        (1, "AAA", 1.0), (1, "BBB", 1.0), (2, "AAA", 2.0), (2, "BBB", 2.0), (3, "AAA", 3.0), (3, "BBB", 3.0),
        (4, "AAA", 210.0), (4, "BBB", 210.0), (5, "AAA", 310.0), (5, "BBB", 310.0), (6, "NONE", 3.0), (8, "AAA", 310.0), (8, "BBB", 310.0),
    ]
    assert b.kept
    b.release()
    assert not b.kept


def test_snapshot_methods(spark, demo):
    snap = strategy.snapshot_of(strategy.snapshots(demo[0], spark.sql("select timestamp'2020-05-01' as decision")).toPandas(), {})
    assert len(snap.price_history(["alpine", "BASALT"], 5)) == 10
    assert snap.feature_history("alpine", "quality_score")["observed_at"].is_monotonic_increasing
    assert set(snap.latest_features().columns) == {"quality_score"}
    assert len(snap.known_events("news_sentiment", ["CEDAR"])) <= len(snap.known_events(include_future=True)) == len(snap.events)
    assert snap.trailing_momentum(500).empty and len(snap.close_matrix().columns) == 7


def test_strategy_identity_and_loading(tmp_path):
    a, b = strategy.TwelveMonthMomentum(), strategy.TwelveMonthMomentum(100)
    assert a.fingerprint() == a.clone().fingerprint() != b.fingerprint() and b.parameters()["lookback"] == 100
    (tmp_path / "s.py").write_text("from pitlane.operators.strategy import HalfYearMomentum\nmade = HalfYearMomentum(5)\nclass Other: pass\n")
    assert strategy.load("s.py:made", tmp_path).lookback == 5
    assert isinstance(strategy.load("pitlane.operators.strategy:Multimodal"), strategy.Multimodal)
    for spec, error in (("s.py", ConfigurationError), ("s.py:none", ConfigurationError), ("../s.py:made", SecurityBoundaryError), ("s.py:Other", StrategyContractError)):
        with pytest.raises(error):
            strategy.load(spec, tmp_path)


def test_bundled_strategies_give_signals(spark, demo):
    b = demo[0]
    extra = b.features.withColumn("feature", F.lit("gross_margin")).unionByName(b.features.withColumn("feature", F.lit("return_on_equity")))
    b = pitlane.Bundle(b.prices, extra, b.events.unionByName(b.events.withColumn("event_type", F.lit("earnings_sentiment"))), b.universe, {})
    at = spark.sql("select timestamp'2020-06-26' as decision")
    for s in (strategy.TwelveMonthMomentum(60, "DEMO-BENCH"), strategy.QualityMomentum(20, 10), strategy.Multimodal(60), strategy.HalfYearMomentum(60)):
        rows = signals.checked(s.signals(b, at)).collect()
        assert {r.symbol for r in rows if r.eligible} >= set(synthetic.STOCKS), s.name
        assert not [r for r in rows if r.symbol == "DEMO-BENCH" and r.eligible]


# -- engine ---------------------------------------------------------------------------------


def test_config_checks():
    for wrong in ({"top_k": 0}, {"max_weight": 1.5}, {"commission_bps": -1}, {"initial_capital": 0}, {"rebalance": "yearly"}, {"weighting": "best"}, {"start": "soon"}):
        with pytest.raises(ConfigurationError):
            BacktestConfig(**wrong)
    c = BacktestConfig(benchmark_symbol=" spy ")
    assert (c.benchmark_symbol, c.periods_per_year, c.total_cost_bps, c.with_cost_multiplier(2).total_cost_bps) == ("SPY", 52, 15.0, 30.0)
    assert c.fingerprint() == BacktestConfig(benchmark_symbol="SPY", initial_capital=1.0).fingerprint() != BacktestConfig().fingerprint()
    with pytest.raises(ConfigurationError):
        c.with_cost_multiplier(-1)
    for wrong in ({"n_trials": 0}, {"confidence": 1.0}, {"cost_multipliers": (-1,)}):
        with pytest.raises(ConfigurationError):
            AuditConfig(**wrong)


def test_replays(demo):
    bundle, engine, plan, result = demo
    again = engine.replay(plan)
    assert again.run_id == result.run_id and again.metrics == result.metrics
    dear = engine.replay(plan, commission_bps=50.0)
    assert dear.metrics["total_return"] < result.metrics["total_return"] and dear.run_id != result.run_id
    curve = cost_curve(plan, (0, 1, 5))
    assert curve[1.0] == pytest.approx(result.metrics["total_return"]) and curve[0.0] > curve[1.0] > curve[5.0]
    rows = result.returns.orderBy("exit").toPandas()
    assert (rows["execution"] > rows["decision"]).all() and (rows["exit"] > rows["execution"]).all()
    assert rows["equity"].iloc[-1] == pytest.approx(100_000 * (1 + result.metrics["total_return"]))
    x = rows["strategy_return"].to_numpy()
    assert result.metrics["sharpe"] == pytest.approx(x.mean() * 52 / (x.std(ddof=1) * 52**0.5))
    equity = np.cumprod(1 + x)
    fall = (equity / np.maximum.accumulate(equity) - 1).min()
    assert result.metrics["max_drawdown"] == pytest.approx(fall) and result.metrics["calmar"] == pytest.approx(result.metrics["annual_return"] / abs(fall))
    assert result.metrics["annual_turnover"] == pytest.approx(rows["turnover"].mean() * 52)
    with pytest.raises(InsufficientDataError):
        engine.prepare(bundle.select(Request(kinds=("events",))), strategy.DemoComposite())
    with pytest.raises(InsufficientDataError):
        engine.prepare(bundle.select(Request(end="2020-01-06")), strategy.DemoComposite())


def test_screen_is_the_backtests_path(demo):
    bundle, _, plan, _ = demo
    when = plan.signals.agg(F.max("decision")).first()[0]
    rows = screen(bundle, strategy.DemoComposite(), when.isoformat(), 3).rows.collect()
    want = plan.signals.where((F.col("decision") == F.lit(when)) & F.col("eligible")).orderBy(F.desc("score"), "symbol").limit(3).collect()
    assert [(r["rank"], r.symbol, r.score) for r in rows] == [(i, w.symbol, w.score) for i, w in enumerate(want, 1)]
    with pytest.raises(InsufficientDataError):
        screen(bundle, strategy.DemoComposite(), "1999-01-01")


def test_walk_forward(demo):
    bundle, engine, plan, _ = demo
    found = walkforward.walk_forward(bundle, strategy.DemoComposite(), engine, walkforward.WalkForwardConfig(6, 4, 1))
    assert len(found.folds) == (plan.schedule.count() - 11) // 4 + 1
    for f in found.folds:
        assert f["train_end"] < f["test_start"] and f["test_periods"] <= 3 and f["train_periods"] == 5
    assert found.verdict_hint in ("fragile", "degraded", "consistent", "inconclusive") and json.dumps(report.plain(found.to_dict()))
    with pytest.raises(InsufficientDataError):
        walkforward.walk_forward(bundle, strategy.DemoComposite(), engine)
    with pytest.raises(ConfigurationError):
        walkforward.WalkForwardConfig(1, 1)
    assert [walkforward.hint([True], None), walkforward.hint([True, False], 1.0), walkforward.hint([True], 0.4), walkforward.hint([True], 0.6)] == ["inconclusive", "fragile", "degraded", "consistent"]


def test_perturbation_leaves_the_past(spark):
    p = synthetic.table(spark, tiny_prices())
    after = asof.perturbed(p, F.lit("2024-01-03").cast("timestamp"), "timestamp").orderBy("timestamp", "symbol").toPandas()
    future = after["timestamp"] > "2024-01-03"
    base = tiny_prices().sort_values(["timestamp", "symbol"], ignore_index=True)
    assert (after.loc[~future, "close"] == base.loc[~future, "close"]).all()
    assert np.allclose(after.loc[future, "open"], base.loc[future, "open"] * (1.5 + np.arange(6) / 6)) and (after.loc[future, "volume"] == 3 * base.loc[future, "volume"]).all()
    assert causality.corrupted_metadata({"a": True, "b": [2, "x"], "c": None}) == {"a": False, "b": [-14.0, "x-future-corrupted"], "c": None}
    assert causality.cutoffs(list(range(20)), 5, 3) == [5, 11, 17] and causality.cutoffs([1, 2, 3], 5, 3) == []


# -- statistics -----------------------------------------------------------------------------

SERIES = [0.012, -0.004, 0.02, 0.003, -0.011, 0.008, 0.001, 0.015, -0.006, 0.004]


def test_statistics_formulas():
    from math import e, sqrt
    from statistics import NormalDist

    x, n = pd.Series(SERIES), len(SERIES)
    s, skew, kurt, normal = x.mean() / x.std(), x.skew(), x.kurt() + 3, NormalDist()
    spread = 1 - skew * s + (kurt - 1) / 4 * s**2
    assert statistics.probabilistic_sharpe(SERIES, 0.1) == pytest.approx(normal.cdf((s - 0.1) * sqrt(n - 1) / sqrt(spread)))
    best = sqrt(spread) / sqrt(n - 1) * ((1 - 0.5772156649) * normal.inv_cdf(1 - 1 / 20) + 0.5772156649 * normal.inv_cdf(1 - 1 / (20 * e)))
    assert statistics.expected_max_sharpe(SERIES, 20) == pytest.approx(best) and statistics.expected_max_sharpe(SERIES, 1) == 0
    assert statistics.deflated_sharpe(SERIES, 20) == pytest.approx(normal.cdf((s - best) * sqrt(n - 1) / sqrt(spread)))
    assert statistics.minimum_track_record(SERIES) == pytest.approx(1 + spread * (normal.inv_cdf(0.95) / s) ** 2)
    mean, p = statistics.sign_flip(SERIES, 200, 3)
    draw, seen = np.random.default_rng(3), 0
    for _ in range(200):
        seen += abs((x.to_numpy() * draw.choice(np.array([-1.0, 1.0]), size=n)).mean()) >= abs(x.mean())
    assert (mean, p) == (pytest.approx(x.mean()), (seen + 1) / 201) and statistics.sign_flip([0.1]) == (0.0, 1.0)
    boot, draw, totals, falls, sharpes = statistics.block_bootstrap(SERIES, 50, 3, 0.9, 5), np.random.default_rng(5), [], [], []
    for _ in range(50):
        path = []
        while len(path) < n:
            k = int(draw.integers(0, n))
            path += [SERIES[(k + i) % n] for i in range(3)]
        path = np.array(path[:n])
        equity = np.cumprod(1 + path)
        totals.append(equity[-1] - 1)
        falls.append((equity / np.maximum.accumulate(equity) - 1).min())
        sharpes.append(path.mean() / path.std(ddof=1))
    assert boot.median == pytest.approx(np.median(totals)) and boot.lower == pytest.approx(np.quantile(totals, 0.05))
    assert boot.sharpe_lower == pytest.approx(np.quantile(sharpes, 0.05)) and boot.drawdown_lower == pytest.approx(np.quantile(falls, 0.05))


# -- audit ----------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(traps.TRAPS))
def test_traps_are_caught(spark, name):
    assert traps.TRAPS[name](spark)


def test_rules():
    assert rules.most_folds_lost([0.1, -0.1, -0.2]) and not rules.most_folds_lost([0.1, -0.1]) and not rules.most_folds_lost([-1.0])
    assert rules.fold_totals(np.array([0.1, 0.1, -0.5]), 2) == [pytest.approx(0.21), pytest.approx(-0.5)]
    assert rules.top_share([4, -3, 2, 1]) == pytest.approx(0.9) and rules.top_share([]) == 0
    assert rules.breakeven_bps(0.02, 4) == pytest.approx(50) and rules.breakeven_bps(1, 0) is None
    s, b = np.array([0.1, 0.1, -0.1, 0.2, 0.1, -0.3]), np.array([0.01, 0.02, -0.01, 0.01, 0.3, -0.3])
    vol = pd.Series(b).rolling(4, min_periods=2).std()
    label = np.where(vol > vol.median(), "high_vol", np.where(b >= 0, "up", "down"))
    want = {k: float(np.prod(1 + s[label == k]) - 1) for k in sorted(set(label))}
    assert rules.regimes(s, b) == {k: pytest.approx(v) for k, v in want.items()}


def finding(code: str, reviewer: str = "x") -> Finding:
    severity, title, _ = rules.CODES[code]
    return Finding(code, Severity[severity], reviewer, title, "")


def test_verdicts():
    assert len(rules.CODES) == 27
    some = [finding("DATA_SYNTHETIC"), finding("COST_FRAGILE", "b"), finding("COST_FRAGILE", "a"), finding("DATA_TEMPORAL_LEAK")]
    assert [(f.code, f.reviewer) for f in council.ordered(some)] == [("DATA_TEMPORAL_LEAK", "x"), ("COST_FRAGILE", "a"), ("COST_FRAGILE", "b"), ("DATA_SYNTHETIC", "x")]
    assert council.score_of(some) == 35 and council.score_of(some * 5) == 0
    assert [council.verdict_of(f, council.score_of(f)) for f in ([], some[:1], some[:2], some, [finding("RETURN_CONCENTRATION")] * 5, [finding("BOOTSTRAP_UNCERTAIN")] * 4)] == ["PASS", "PASS", "WARN", "FAIL", "FAIL", "WARN"]
    assert len(diagnosis.recommendations(tuple(finding(c) for c in rules.CODES))) == 8
    assert diagnosis.recommendations((finding("COST_FRAGILE"), finding("COST_FRAGILE", "y"))) == (rules.CODES["COST_FRAGILE"][2],)


class Fake:
    """A result with the given returns."""

    def __init__(self, spark, demo_result, strategy_returns, benchmark=None, **metrics):
        rows = [(i, x, 0.2, x, None if benchmark is None else benchmark[i]) for i, x in enumerate(strategy_returns)]
        self.returns = spark.createDataFrame(rows, "exit int, gross_return double, turnover double, strategy_return double, benchmark_return double")
        self.holdings, self.config = demo_result.holdings, demo_result.config
        self.metrics = {"total_return": float(np.prod(1 + np.array(strategy_returns)) - 1), "sharpe": 1.0, "annual_turnover": 4.0} | metrics
        self.benchmark_metrics = {} if benchmark is None else {"total_return": float(np.prod(1 + np.array(benchmark)) - 1)}


def test_reviewers_find_what_they_should(spark, demo):
    bundle, engine, plan, result = demo
    quick = {"bootstrap_simulations": 50, "permutation_simulations": 50}

    def codes(reviewer, fake, **settings):
        return traps.codes(reviewer.review(Context(bundle, strategy.DemoComposite(), engine, fake, AuditConfig(**quick | settings), plan)))

    few = Fake(spark, result, [0.05, -0.001, 0.0, 0.001, -0.002, 0.001, 0.0, 0.0], None, sharpe=4.0)
    assert {"PERFORMANCE_SAMPLE_SMALL", "PERFORMANCE_EXTREME_SHARPE"} <= codes(reviewers.Performance(), few)
    found = codes(reviewers.Statistics(), few, n_trials=50)
    assert {"TRACK_RECORD_SHORT", "MULTIPLE_TESTING", "MEAN_NOT_SIGNIFICANT", "RETURN_CONCENTRATION"} <= found
    losing = Fake(spark, result, [-0.01, 0.002] * 20)
    assert {"FOLD_INSTABILITY", "BOOTSTRAP_UNCERTAIN", "BENCHMARK_MISSING"} <= codes(reviewers.Robustness(), losing)
    bench = [0.01, -0.02] * 20
    one_sided = Fake(spark, result, [0.02 if b > 0 else -0.015 for b in bench], bench)
    assert "BENCHMARK_UNDERPERFORMANCE" in codes(reviewers.Performance(), Fake(spark, result, [-0.01] * 30, [0.01] * 30))
    steady = Fake(spark, result, [0.01, 0.012, 0.011, 0.009] * 10, [0.001] * 40)
    assert codes(reviewers.Statistics(), steady) == set() == codes(reviewers.Robustness(), steady) - {"COST_FRAGILE"}
    context = Context(bundle, strategy.DemoComposite(), engine, one_sided, AuditConfig(), plan)
    every = tuple(finding(c) for c in rules.CODES)
    tried = diagnosis.diagnose(context, every)
    assert [e.rank for e in tried] == list(range(1, len(tried) + 1)) and [e.severity for e in tried] == sorted((e.severity for e in tried), reverse=True)
    assert {"regime dependence", "concentration", "turnover", "short track"} <= {e.rule for e in tried} and diagnosis.diagnose(context, ()) == ()
    assert next(e for e in tried if e.rule == "turnover").measured["pace"] == "monthly"
    assert len(diagnosis.strengths(context, ())) >= 3


def test_council_and_run_files(spark, demo, tmp_path):
    bundle, engine, plan, result = demo
    ledger = tmp_path / "trials.jsonl"
    Ledger(ledger).append("backtest", run_id="r", strategy_name="s", strategy_fingerprint="f")
    audit = council.Council(ledger=ledger).review(bundle, strategy.DemoComposite(), engine, result, cli.FAST, plan)
    assert audit.verdict in ("PASS", "WARN", "FAIL") and len(audit.reports) == 6 and audit.score == council.score_of(audit.findings)
    assert "DATA_SYNTHETIC" in {f.code for f in audit.findings} and "CAUSALITY_PREFIX_CHANGED" not in {f.code for f in audit.findings}
    out = report.write_run(tmp_path / "runs", result, audit, lambda told: told * 100)
    names = json.loads((out / "manifest.json").read_text())["artifacts"]
    assert names == {n: report.file_hash(out / n) for n in ("result.json", "audit.json", "report.html", "badge.json", "card.svg")}
    assert len(json.loads((out / "audit.json").read_text())["narrative"]) == 8000
    assert spark.read.parquet(str(out / "returns.parquet")).count() == result.metrics["periods"]
    assert "<script" not in report.html_page(result, audit, [1.0, None, 2.0]) and audit.verdict in report.badge_url(audit)
    assert cli.summary(result, audit).count("\n") > 3 and report.artifact_fingerprint({"a": 1}) != report.artifact_fingerprint({"a": 2})
    path = report.write_screen(tmp_path / "s.json", screen(bundle, strategy.DemoComposite(), top_n=2))
    assert len(json.loads(path.read_text())["rows"]) == 2


def test_formats():
    assert [report.shown(*x) for x in (("total_return", 0.1234), ("periods", 12), ("annual_turnover", 3.456), ("sharpe", 1.23456), ("sharpe", None), ("sharpe", float("inf")))] == ["12.34%", "12", "3.46×", "1.235", "–", "–"]
    assert report.plain({"t": datetime(2024, 1, 1), "x": float("nan"), "n": np.float64(2), "s": {2, 1}}) == {"t": "2024-01-01T00:00:00", "x": None, "n": 2.0, "s": [1, 2]}
    svg = report.equity_svg([None, 1.0, None, 3.0], 300, 100)
    assert 'points="0.0,100.0 100.0,100.0 200.0,100.0 300.0,0.0"' in svg and "polyline" not in report.equity_svg([1.0])


# -- ledger, projects, command line, tool server --------------------------------------------


def test_ledger_as_a_table(spark, tmp_path):
    ledger = Ledger(tmp_path / "t.jsonl")
    for k in range(4):
        ledger.append("note", str(k))
    assert [(r.position, r["index"], r.chained) for r in asof_rows(spark, ledger)] == [(i, i, True) for i in range(4)]
    lines = ledger.path.read_text().splitlines()
    ledger.path.write_text("\n".join([lines[0], "broken", *lines[2:]]) + "\n")
    assert [r.chained for r in asof_rows(spark, ledger)] == [True, False, False]


def asof_rows(spark, ledger):
    from pitlane.operators.ledger import chained

    return chained(spark, str(ledger.path)).orderBy("position").collect()


def test_ledger_rules(tmp_path):
    ledger = Ledger(tmp_path / "t.jsonl")
    for f in ("a", "a", "b", "c", "b"):
        ledger.append("backtest", run_id="r", strategy_name=f.upper(), strategy_fingerprint=f)
    ledger.append("note", "x" * 300)
    ledger.append("backtest", run_id="r")
    assert ledger.summary() == {"runs": 6, "variants": 3, "names": {"a": "A", "b": "B", "c": "C"}}
    note = ledger.entries()[5]
    assert len(note["label"]) == 200 and note["run_id"] is None and ledger.check() == (True, "the chain holds", None)
    ledger.head.unlink()
    ledger.path.write_text(ledger.path.read_text() + "\n\n")
    assert ledger.verify()[0]  # neither the checkpoint nor blank lines are needed
    lines = ledger.path.read_text().split("\n")
    lines[2] = lines[2].replace('"B"', '"X"')
    ledger.path.write_text("\n".join(lines))
    assert ledger.check()[::2] == (False, 2)


def project(tmp_path, **changes):
    synthetic.example_files(tmp_path / "data", sessions=110)
    (tmp_path / "s.py").write_text("from pitlane.operators.strategy import QualityMomentum\nmade = QualityMomentum(20, 10)\nmade.minimum_history = 30\n")
    import yaml

    raw = {
        "version": 1, "data": {"adapter": "files", "options": {k: f"data/{k}.csv" for k in CONTRACTS} | {"metadata": {"survivorship": "pit"}}}, "strategy": "s.py:made",
        "backtest": {"rebalance": "weekly", "top_k": 2, "max_weight": 0.5, "benchmark_symbol": "INDEX"}, "audit": {"bootstrap_simulations": 50, "permutation_simulations": 50, "causality_cutoffs": 1},
    } | changes
    path = tmp_path / "pitlane.yml"
    path.write_text(yaml.safe_dump(raw))
    return path


def test_project_files(tmp_path):
    p = config.read(project(tmp_path))
    assert p.backtest.top_k == 2 and p.output == tmp_path / "runs" and p.make_strategy().window == 10
    for wrong in ({"extra": 1}, {"version": 2}, {"strategy": ""}, {"data": {}}, {"data": {"adapter": "files", "x": 1}}, {"backtest": {"top_k": 0}}, {"backtest": {"x": 1}}, {"audit": {"n_trials": 0}}, {"request": {"until": 1}}, {"request": {"symbols": 3}}, {"screen": {"top_n": 0}}, {"screen": [1]}, {"allow_outside_root": "yes"}, {"output_dir": "../x"}):
        with pytest.raises((ConfigurationError, SecurityBoundaryError)):
            config.read(project(tmp_path, **wrong))
    with pytest.raises(ConfigurationError):
        config.read(tmp_path / "none.yml")
    made = config.scaffold(tmp_path / "new")
    assert all(x.exists() for x in made) and config.read(tmp_path / "new" / "pitlane.yml").adapter == "files"
    with pytest.raises(ConfigurationError):
        config.scaffold(tmp_path / "new")
    assert config.scaffold(tmp_path / "new", True) == made


def test_command_line(spark, tmp_path, capsys):
    path = str(project(tmp_path))
    assert cli.main(["validate", path]) == 0 and '"status"' not in (said := capsys.readouterr().out) and '"PASS"' in said
    assert cli.main(["screen", path, "--top", "3", "--out", str(tmp_path / "s.json")]) == 0 and capsys.readouterr().out.count("\n") == 3
    assert cli.main(["backtest", path]) == 0 and "/100" in capsys.readouterr().out
    assert cli.main(["ledger", "verify", "--path", str(tmp_path / "trials.jsonl")]) == 0
    assert cli.main(["walkforward", path, "--train", "5", "--test", "3"]) == 0 and (tmp_path / "runs" / "walkforward.json").exists()
    assert cli.main(["screen", str(tmp_path / "none.yml")]) == 2 and "error" in capsys.readouterr().err
    (tmp_path / "trials.jsonl").write_text("{}\n")
    assert cli.main(["ledger", "verify", "--path", str(tmp_path / "trials.jsonl")]) == 1
    assert cli.main(["ledger", "note", "hello", "--path", str(tmp_path / "n.jsonl")]) == 0 and cli.main(["ledger", "show", "--path", str(tmp_path / "n.jsonl")]) == 0


def test_tool_server(spark, tmp_path, monkeypatch):
    ask = lambda method, i=1, **params: rpc.answer(json.dumps({"jsonrpc": "2.0", "id": i, "method": method, "params": params}))
    assert ask("initialize")["result"]["serverInfo"]["name"] == "pitlane" and ask("ping")["result"] == {}
    assert {t["name"] for t in ask("tools/list")["result"]["tools"]} == {"run_demo_verdict", "run_project_verdict", "run_screen", "explain_finding", "list_findings"}
    tool = lambda name, **a: ask("tools/call", name=name, arguments=a)["result"]
    assert len(json.loads(tool("list_findings")["content"][0]["text"])) == 27
    for code in rules.CODES:
        assert not tool("explain_finding", code=code.lower())["isError"]
    for bad in (tool("explain_finding", code="X"), tool("nothing"), tool("run_screen"), tool("list_findings", x=1)):
        assert bad["isError"]
    assert [rpc.answer(x)["error"]["code"] for x in ("{", "[]", '{"jsonrpc": "2.0", "id": 1, "method": "x"}', "x" * (2 << 20))] == [-32700, -32600, -32601, -32600]
    assert rpc.answer('{"jsonrpc": "2.0", "method": "note"}') is None
    monkeypatch.setenv(rpc.ROOT_VARIABLE, str(tmp_path))
    project(tmp_path)
    assert tool("run_screen", project="../x.yml")["isError"]
    assert len(json.loads(tool("run_screen", project="pitlane.yml", top=2)["content"][0]["text"])["rows"]) == 2
    out = io.StringIO()
    assert rpc.serve(io.StringIO('\n{"jsonrpc": "2.0", "id": 7, "method": "ping"}\n'), out) == 0 and json.loads(out.getvalue())["id"] == 7


def test_public_names():
    for name in pitlane.__all__:
        assert getattr(pitlane, name)
    with pytest.raises(AttributeError):
        pitlane.nothing  # noqa: B018
