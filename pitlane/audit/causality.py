"""Does a strategy see the future, chance, or its own past? Signals are computed again on changed inputs and compared exactly."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlane.operators import asof, signals
from pitlane.operators.strategy import Snapshot, Strategy, View, snapshot_of, snapshots
from pitlane.sources.bundle import Bundle


def corrupted_metadata(value):
    """Every leaf of metadata changed: flags turned, numbers times -7, texts marked."""
    if isinstance(value, bool):
        return not value
    if isinstance(value, (int, float)):
        return value * -7.0
    if isinstance(value, str):
        return f"{value}-future-corrupted"
    if isinstance(value, dict):
        return {k: corrupted_metadata(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [corrupted_metadata(v) for v in value]
    return value


def perturbed(bundle: Bundle, cutoff) -> Bundle:
    """bundle with everything after the cutoff corrupted, and metadata, which no score may read; the universe stays."""
    t = F.lit(cutoff)
    later = F.col("available_at") > t
    value = F.when(later, F.when(F.col("value_num").isNotNull(), (F.col("value_num") * -7).cast("string")).otherwise("future-corrupted")).otherwise(F.col("value"))
    features = bundle.features.withColumn("value", value).withColumn("value_num", F.expr("try_cast(value as double)"))
    events = bundle.events.withColumn("payload", F.when(later, '{"future_corrupted": true}').otherwise(F.col("payload")))
    return replace(bundle, prices=asof.perturbed(bundle.prices, t, "timestamp"), features=features, events=events, metadata=corrupted_metadata(bundle.metadata))


def cutoffs(sessions: list, minimum: int, most: int) -> list[int]:
    """Positions in sessions, spread evenly from the first with enough history to the last but two."""
    n = len(sessions) - 2 - minimum
    return sorted({minimum + int(i) for i in np.linspace(0, n - 1, min(most, n), dtype=int)}) if n > 0 else []


@dataclass(frozen=True)
class Probe:
    cutoffs: int
    reproducible: bool
    prefix_stable: bool
    warm_stable: bool


def _frame(df: DataFrame) -> pd.DataFrame:
    return df.select("symbol", "score", "eligible", "rationale").orderBy("symbol").toPandas()


def _snapshot(bundle: Bundle, one: DataFrame, strategy: Strategy) -> Snapshot:
    return snapshot_of(snapshots(bundle, one, strategy.lookback_sessions).toPandas(), bundle.metadata)


def _screens(strategy: Strategy, bundle: Bundle, when, before=None) -> pd.DataFrame:
    """Signals at `when` of this very object, after it has scored `before`."""
    spark = bundle.prices.sparkSession
    one = lambda t: spark.createDataFrame([(t,)], "decision timestamp")
    known = bundle.as_of(when)
    if strategy.declarative:
        if before is not None:
            strategy.signals(bundle.as_of(before), one(before)).count()
        return _frame(strategy.signals(known, one(when)))
    # an opaque strategy is asked here, so that state it keeps is seen; its snapshot is one date's history, bounded by lookback_sessions
    if before is not None:
        strategy.score(_snapshot(bundle, one(before), strategy))
    scored = signals.frame_of(strategy.score(_snapshot(bundle, one(when), strategy)))
    rows = spark.createDataFrame(scored.assign(symbol=scored["symbol"].astype(object))[["symbol", "score", "eligible", "rationale"]], "symbol string, score double, eligible boolean, rationale string") if len(scored) else spark.createDataFrame([], "symbol string, score double, eligible boolean, rationale string")
    view = View(known, one(when))
    return _frame(signals.restrict(signals.normalise(rows.withColumn("decision", F.lit(when))), view.members(), view.history_counts(), strategy.minimum_history))


def same(a: pd.DataFrame, b: pd.DataFrame) -> bool:
    return a.equals(b)


def probe(bundle: Bundle, strategy: Strategy, most: int = 3) -> Probe:
    """Repeat, corrupt the future, and warm up on an earlier date, at a few dates."""
    days = [r[0] for r in bundle.prices.select("timestamp").distinct().orderBy("timestamp").collect()]
    at = cutoffs(days, strategy.minimum_history, most)
    steady = prefix = warm = True
    for k in at:
        when = days[k]
        first = _screens(strategy.clone(), bundle, when)
        steady &= same(first, _screens(strategy.clone(), bundle, when))
        prefix &= same(first, _screens(strategy.clone(), perturbed(bundle, when), when))
        warm &= same(first, _screens(strategy.clone(), bundle, when, days[max(0, k - 2)]))
    return Probe(len(at), steady, prefix, warm)
