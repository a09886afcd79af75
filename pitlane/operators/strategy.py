"""Strategies. The declarative kind says scores for all decision dates as one plan; the opaque kind scores one snapshot in Python."""

from __future__ import annotations

import copy
import hashlib
import importlib
import importlib.util
import inspect
import io
import sys
from collections.abc import Collection
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitlane.errors import ConfigurationError, StrategyContractError
from pitlane.functions import panel
from pitlane.operators import asof, calendar, signals
from pitlane.operators.ledger import canonical_json
from pitlane.sources.bundle import Bundle
from pitlane.sources.contracts import KINDS
from pitlane.sources.files import resolve_within


@dataclass(frozen=True)
class View:
    """A bundle seen at many decision dates (decision) at once. Every table it gives has decision and symbol and only what was knowable then."""

    bundle: Bundle
    decisions: DataFrame

    @property
    def prices(self) -> DataFrame:
        return self.bundle.prices.withColumnRenamed("timestamp", "session")

    def _at(self) -> DataFrame:
        return self.decisions.select(F.col("decision").alias("t"))

    def numbered(self) -> DataFrame:
        """prices with n, counted over sessions up to the last decision."""
        last = self.decisions.agg(F.max("decision").alias("__last"))
        known = self.prices.join(F.broadcast(last), F.col("session") <= F.col("__last")).drop("__last")
        return calendar.numbered(known, calendar.sessions(known))

    def at_decisions(self, rows: DataFrame) -> DataFrame:
        """rows (session, ...) of decision dates' own sessions."""
        return rows.join(F.broadcast(self.decisions.select("decision")), F.col("session") == F.col("decision"))

    def trailing_momentum(self, lookback: int) -> DataFrame:
        if lookback < 1:
            raise ValueError("lookback must be positive")
        rows = self.numbered().withColumn("value", panel.change(lookback)).where("value is not null")
        return self.at_decisions(rows).select("decision", "symbol", "value")

    def normalised_momentum(self, lookback: int = 63, window: int = 40) -> DataFrame:
        """Momentum over the deviation of the last `window` one-session returns; null where that is 0."""
        rows = panel.with_volatility(self.numbered(), window, 1.0).withColumn("momentum", panel.change(lookback))
        rows = rows.select("decision" if "decision" in rows.columns else "session", "symbol", F.try_divide("momentum", F.nullif(F.col("volatility"), F.lit(0.0))).alias("value")).where("value is not null")
        return self.at_decisions(rows).select("decision", "symbol", "value")

    def latest_feature(self, feature: str) -> DataFrame:
        known = self.bundle.features.where(F.col("feature") == feature).select("symbol", "feature", "observed_at", "available_at", "revision", F.col("value_num").alias("value"))
        return asof.latest_features(known, self._at()).select(F.col("t").alias("decision"), "symbol", "value")

    def mean_sentiment(self, event_type: str, days: int, key: str = "sentiment") -> DataFrame:
        """Mean of a payload's number over events of the last days; an event without it counts as 0."""
        known = asof.known_events(self.bundle.events, self._at(), days, event_type=event_type)
        value = F.coalesce(F.expr(f"try_variant_get(try_parse_json(payload), '$.{key}', 'double')"), F.lit(0.0))
        return known.groupBy(F.col("t").alias("decision"), "symbol").agg(F.avg(value).alias("value"))

    def latest_prices(self) -> DataFrame:
        return asof.latest_prices(self.prices, self._at()).withColumnRenamed("t", "decision")

    def members(self) -> DataFrame:
        return self.bundle.active(self._at()).withColumnRenamed("t", "decision")

    def history_counts(self) -> DataFrame:
        """decision, symbol, sessions: how many sessions a symbol has up to each decision."""
        order = Window.partitionBy("symbol").orderBy("session")
        runs = self.prices.select("symbol", "session", F.row_number().over(order).cast("double").alias("close"))
        return asof.latest_prices(runs, self._at()).select(F.col("t").alias("decision"), "symbol", F.col("close").cast("long").alias("sessions"))

    def restrict_to_members(self, rows: DataFrame) -> DataFrame:
        """rows of active members; all rows of a decision that has none."""
        m = self.members()
        some = m.select("decision").distinct().withColumn("__some", F.lit(True))
        flagged = rows.join(some, "decision", "left").join(m.withColumn("__in", F.lit(True)), ["decision", "symbol"], "left")
        return flagged.where(F.col("__some").isNull() | F.col("__in").isNotNull()).drop("__some", "__in")


class Missing(BaseException):
    """A snapshot's table was asked for that wasn't gathered. Not an Exception, so strategies' own handlers let it pass."""


_asked: set[str] = set()  # tables that were missed since the set was last cleared, in this process


@dataclass
class Snapshot:
    """All and only what was knowable at as_of, as pandas frames; for opaque strategies.

    On executors a table may not be gathered yet; the first look at it says so, and the date is scored anew with it.
    """

    as_of: pd.Timestamp
    prices: pd.DataFrame
    features: pd.DataFrame
    events: pd.DataFrame
    universe: pd.DataFrame
    metadata: dict

    def __getattr__(self, name: str):
        if name in _KEPT:
            _asked.add(name)
            raise Missing(name)
        raise AttributeError(name)

    def close_matrix(self) -> pd.DataFrame:
        return self.prices.pivot(index="timestamp", columns="symbol", values="close").sort_index()

    def price_history(self, symbols=None, sessions: int | None = None) -> pd.DataFrame:
        """Rows of some symbols in their last distinct sessions."""
        rows = self.prices if symbols is None else self.prices[self.prices["symbol"].isin([s.strip().upper() for s in symbols])]
        if sessions is not None:
            rows = rows[rows["timestamp"].isin(sorted(rows["timestamp"].unique())[-sessions:])]
        return rows.sort_values(["timestamp", "symbol"], ignore_index=True)

    def feature_history(self, symbol: str, feature: str) -> pd.DataFrame:
        rows = self.features[(self.features["symbol"] == symbol.strip().upper()) & (self.features["feature"] == feature)]
        return rows.sort_values(["observed_at", "available_at", "revision"], ignore_index=True)

    def latest_features(self) -> pd.DataFrame:
        """symbol x feature of the latest values (text)."""
        rows = self.features.sort_values(["observed_at", "available_at", "revision"]).groupby(["symbol", "feature"]).tail(1)
        return rows.pivot(index="symbol", columns="feature", values="value")

    def known_events(self, event_type: str | None = None, symbols=None, include_future: bool = False) -> pd.DataFrame:
        rows = self.events
        if event_type is not None:
            rows = rows[rows["event_type"] == event_type]
        if symbols is not None:
            rows = rows[rows["symbol"].isin([s.strip().upper() for s in symbols])]
        return rows if include_future else rows[rows["event_at"] <= self.as_of]

    def trailing_momentum(self, lookback: int) -> pd.Series:
        if lookback < 1:
            raise ValueError("lookback must be positive")
        m = self.close_matrix()
        return pd.Series(dtype=float) if len(m) <= lookback else (m.iloc[-1] / m.iloc[-1 - lookback] - 1).dropna()


def snapshots(bundle: Bundle, decisions: DataFrame, lookback_sessions: int | None = None, kinds: Collection[str] = KINDS) -> DataFrame:
    """decision, kind and the row's columns: everything a snapshot of each decision holds (or some kinds of it), for grouping by decision.

    History is repeated for every decision, which lookback_sessions bounds (it cuts prices, not facts).
    """
    t = F.broadcast(decisions.select(F.col("decision")))
    prices = bundle.prices
    if lookback_sessions:
        days = calendar.sessions(prices.withColumnRenamed("timestamp", "session"))
        numbered = prices.join(F.broadcast(days.withColumnRenamed("session", "timestamp")), "timestamp")
        asked = F.broadcast(decisions.join(days.withColumnRenamed("n", "__at"), F.col("session") == F.col("decision")).select("decision", "__at"))
        prices = numbered.join(asked, (F.col("n") <= F.col("__at")) & (F.col("n") > F.col("__at") - lookback_sessions)).drop("n", "__at")
    else:
        prices = prices.join(t, F.col("timestamp") <= F.col("decision"))
    parts = {
        "prices": prices,
        "features": bundle.features.join(t, (F.col("available_at") <= F.col("decision")) & (F.col("observed_at") <= F.col("decision"))),
        "events": bundle.events.join(t, F.col("available_at") <= F.col("decision")),
        "universe": bundle.universe.join(t, F.col("available_at") <= F.col("decision")),
    }
    out = None
    for kind in (k for k in parts if k in kinds):
        named = parts[kind].withColumn("kind", F.lit(kind))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out


_KEPT = {"prices": ["symbol", "timestamp", "open", "high", "low", "close", "volume", "source"], "features": ["symbol", "observed_at", "available_at", "feature", "value", "revision", "source"], "events": ["symbol", "event_at", "available_at", "event_type", "payload", "source"], "universe": ["symbol", "effective_from", "effective_to", "available_at", "source"]}


def snapshot_of(frame: pd.DataFrame, metadata: dict, kinds: Collection[str] = KINDS) -> Snapshot:
    """The snapshot of one decision's rows; kinds that weren't gathered are missing from it."""
    at = frame["decision"].iloc[0]
    made = Snapshot(pd.Timestamp(at), *(frame.loc[frame["kind"] == k, [c for c in v if c in frame.columns]].reset_index(drop=True) if k in kinds else None for k, v in _KEPT.items()), metadata)
    for k in _KEPT.keys() - set(kinds):
        delattr(made, k)
    return made


def attempt(strategy: Strategy, frame: pd.DataFrame, metadata: dict, kinds: Collection[str]) -> tuple[pd.DataFrame | None, list[str]]:
    """A clone's scores of one decision's rows of some kinds, and the tables it missed, whatever it made of missing them."""
    _asked.clear()
    out = None
    try:
        out = signals.frame_of(strategy.clone().score(snapshot_of(frame, metadata, kinds)))
    except Missing:
        pass
    except Exception:
        if not _asked:
            raise
    return out, sorted(_asked)


class Strategy:
    """Override scores() (declarative) or score() (opaque). Public attributes are parameters."""

    name = "strategy"
    minimum_history = 1
    lookback_sessions: int | None = None

    def scores(self, view: View) -> DataFrame:
        """decision, symbol, score (eligible, rationale) for all of the view's decisions."""
        raise NotImplementedError

    def score(self, snapshot: Snapshot):
        """Scores of one snapshot: a frame, series or mapping by symbol."""
        raise NotImplementedError

    @property
    def declarative(self) -> bool:
        return type(self).scores is not Strategy.scores

    def parameters(self) -> dict:
        return {k: v for k, v in sorted(vars(self).items()) if not k.startswith("_")}

    def clone(self) -> Strategy:
        return copy.deepcopy(self)

    def fingerprint(self) -> str:
        try:
            source = inspect.getsource(type(self))
        except (OSError, TypeError):
            source = type(self).__qualname__
        return hashlib.sha256(canonical_json({"source": source, "parameters": {k: repr(v) for k, v in self.parameters().items()}}).encode()).hexdigest()

    def raw(self, bundle: Bundle, decisions: DataFrame) -> DataFrame:
        if self.declarative:
            return self.scores(View(bundle, decisions))
        if type(self).score is Strategy.score:
            raise StrategyContractError(f"{self.name} has neither scores() nor score()")
        home = sys.modules.get(type(self).__module__)
        if home is not None and home.__name__.split(".")[0] != "pitlane" and home.__name__ != "__main__":
            register_pickle_by_value(home)  # executors needn't have the strategy's module
        # known facts are many times the prices, and repeated for every decision: they go only to the decisions that ask for them
        parts, todo, kinds = [], decisions, {"prices"}
        while True:
            out = self._asked(bundle, todo, kinds)
            parts.append(out.where("asked is null").select(*signals.COLUMNS))
            if kinds >= set(KINDS):
                break
            bundle.kept.append(out.persist())
            met = out.where("asked is not null")
            more = {r[0] for r in met.select(F.explode("asked")).distinct().collect()}
            todo = todo.join(met.where("size(asked) = 0").select("decision"), "decision", "left_anti")
            if not todo.limit(1).count():
                break
            # a decision without a row of these kinds may have facts
            unseen = todo.join(met.select("decision"), "decision", "left_anti").limit(1).count()
            kinds = set(KINDS) if unseen else kinds | more
        return reduce(DataFrame.unionByName, parts)

    def _asked(self, bundle: Bundle, decisions: DataFrame, kinds: Collection[str]) -> DataFrame:
        """Scores of snapshots that hold some kinds, and for each decision a row with asked: the tables it missed, and then no scores."""
        own, metadata, kinds = self, bundle.metadata, tuple(kinds)
        when = decisions.schema["decision"].dataType.simpleString()

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            out, asked = attempt(own, frame, metadata, kinds)
            mark = pd.DataFrame({"symbol": [None], "score": [None], "eligible": [None], "rationale": [None], "asked": [asked]}, dtype=object)
            rows = mark if asked or not len(out) else pd.concat([out.astype(object).assign(asked=None), mark], ignore_index=True)
            return rows.astype({"score": "float64"}).assign(decision=frame["decision"].iloc[0])[[*signals.COLUMNS, "asked"]]

        rows = snapshots(bundle, decisions, self.lookback_sessions, kinds)
        return rows.groupBy("decision").applyInPandas(run, f"decision {when}, symbol string, score double, eligible boolean, rationale string, asked array<string>")

    def signals(self, bundle: Bundle, decisions: DataFrame) -> DataFrame:
        """Normalised signals of all decisions, members and histories applied."""
        view = View(bundle, decisions)
        return signals.restrict(signals.normalise(self.raw(bundle, decisions)), view.members(), view.history_counts(), self.minimum_history)


def load(spec: str, root: str | Path = ".", allow_outside: bool = False) -> Strategy:
    """`file.py:Name` below root, or `module:Name`; a class is made an object."""
    place, _, name = spec.rpartition(":")
    if not place or not name:
        raise ConfigurationError(f"a strategy is named file.py:Name or module:Name, not {spec!r}")
    try:
        if place.endswith(".py"):
            path = resolve_within(root, place, allow_outside)
            found = importlib.util.spec_from_file_location(f"strategy_{path.stem}", path)
            module = importlib.util.module_from_spec(found)
            found.loader.exec_module(module)
        else:
            module = importlib.import_module(place)
        made = getattr(module, name)
    except (OSError, ImportError, AttributeError) as e:
        raise ConfigurationError(f"no strategy {spec!r}: {e}") from e
    made = made() if inspect.isclass(made) else made
    if not isinstance(made, Strategy):
        raise StrategyContractError(f"{spec!r} is no Strategy")
    return made


# -- bundled strategies ---------------------------------------------------------------------


def _ranked(rows: DataFrame, name: str) -> DataFrame:
    return rows.select("decision", "symbol", panel.pct_rank("value", ["decision"]).alias(name))


class DemoComposite(Strategy):
    """0.50 rank of momentum + 0.35 rank of quality + 0.15 rank of 45-day sentiment (none counts as 0 before ranking); the benchmark stays out."""

    name, minimum_history = "demo composite", 80

    def __init__(self, lookback: int = 63, benchmark: str = "DEMO-BENCH"):
        self.lookback, self.benchmark = lookback, benchmark

    def scores(self, view: View) -> DataFrame:
        names = view.latest_prices().select("decision", "symbol").where(F.col("symbol") != self.benchmark)
        rows = names.join(view.trailing_momentum(self.lookback).withColumnRenamed("value", "m"), ["decision", "symbol"], "left")
        rows = rows.join(view.latest_feature("quality_score").withColumnRenamed("value", "q"), ["decision", "symbol"], "left")
        rows = rows.join(view.mean_sentiment("news_sentiment", 45).withColumnRenamed("value", "s"), ["decision", "symbol"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
        ranked = rows.select("decision", "symbol", *(panel.pct_rank(c, ["decision"]).alias(c) for c in ("m", "q", "s")))
        score = 0.5 * F.col("m") + 0.35 * F.col("q") + 0.15 * F.col("s")
        return ranked.select("decision", "symbol", score.alias("score"), score.isNotNull().alias("eligible"))


class TwelveMonthMomentum(Strategy):
    """Momentum over 252 sessions; the benchmark stays out."""

    name, minimum_history = "twelve-month momentum", 253

    def __init__(self, lookback: int = 252, benchmark: str | None = None):
        self.lookback, self.benchmark = lookback, benchmark
        self.minimum_history = lookback + 1

    def scores(self, view: View) -> DataFrame:
        rows = view.trailing_momentum(self.lookback)
        return rows.where(F.col("symbol") != F.lit(self.benchmark or "")).select("decision", "symbol", F.col("value").alias("score"))


class QualityMomentum(Strategy):
    """0.40 rank of margin + 0.20 rank of 92-day sentiment (none counts as 0.5 after ranking) + 0.40 rank of momentum by its deviation; rows without margin or momentum drop out."""

    name, minimum_history = "quality momentum", 73

    def __init__(self, lookback: int = 63, window: int = 40):
        self.lookback, self.window = lookback, window

    def scores(self, view: View) -> DataFrame:
        rows = _ranked(view.latest_feature("gross_margin"), "q").join(_ranked(view.normalised_momentum(self.lookback, self.window), "m"), ["decision", "symbol"])
        rows = rows.join(_ranked(view.mean_sentiment("earnings_sentiment", 92), "s"), ["decision", "symbol"], "left")
        return rows.select("decision", "symbol", (0.4 * F.col("q") + 0.2 * F.coalesce("s", F.lit(0.5)) + 0.4 * F.col("m")).alias("score")).where("score is not null")


class Multimodal(Strategy):
    """Ranks of momentum (0.50), return on equity (0.35) and 30-day sentiment (0.15); weights of missing inputs are shared out."""

    name, minimum_history = "multimodal", 253

    def __init__(self, lookback: int = 252):
        self.lookback = lookback
        self.minimum_history = lookback + 1

    def scores(self, view: View) -> DataFrame:
        rows = view.trailing_momentum(self.lookback).withColumnRenamed("value", "m")
        for name, more in (("q", view.latest_feature("return_on_equity")), ("s", view.mean_sentiment("news_sentiment", 30))):
            rows = rows.join(more.withColumnRenamed("value", name), ["decision", "symbol"], "full_outer")
        ranked = rows.select("decision", "symbol", *(panel.pct_rank(c, ["decision"], True).alias(c) for c in ("m", "q", "s")))
        return ranked.select("decision", "symbol", panel.combined([("m", 0.5), ("q", 0.35), ("s", 0.15)]).alias("score")).where("score is not null")


class HalfYearMomentum(Strategy):
    """What a new project starts with: momentum over 126 sessions."""

    name, minimum_history = "half-year momentum", 127

    def __init__(self, lookback: int = 126):
        self.lookback = lookback

    def scores(self, view: View) -> DataFrame:
        return view.trailing_momentum(self.lookback).withColumnRenamed("value", "score")


def frozen(frame: pd.DataFrame) -> bytes:
    """A frame as bytes, for exact comparison."""
    out = io.BytesIO()
    frame.reset_index(drop=True).to_parquet(out)
    return out.getvalue()
