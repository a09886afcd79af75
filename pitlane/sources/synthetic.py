"""Made-up research data with known properties, for demonstrations and tests."""

from __future__ import annotations

import json
from datetime import timedelta
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitlane.errors import ConfigurationError
from pitlane.sources.bundle import Bundle

BENCHMARK = "DEMO-BENCH"
STOCKS = ("ALPINE", "BASALT", "CEDAR", "DELTA", "EMBER", "FJORD")


def tables(seed: int = 7, sessions: int = 520) -> dict[str, pd.DataFrame]:
    """Six stocks and a benchmark on business days: quarterly quality scores that foretell drift a little, news with a sentiment, open-ended membership."""
    if sessions < 100:
        raise ConfigurationError("at least 100 sessions are needed")
    r, days = np.random.default_rng(seed), pd.bdate_range("2020-01-01", periods=sessions)
    market = r.normal(0.0003, 0.008, sessions)
    quality = r.uniform(20, 80, len(STOCKS))
    prices, features, events = [], [], []
    for i, s in enumerate((*STOCKS, BENCHMARK)):
        own = np.zeros(sessions) if s == BENCHMARK else r.normal(0.0, 0.012, sessions) + (quality[i] - 50) * 1e-5
        close = (60 + 15 * i) * np.exp(np.cumsum(market + own))
        open_ = close * np.exp(r.normal(0, 0.003, sessions))
        wide = np.abs(r.normal(0, 0.004, sessions))
        prices.append(pd.DataFrame({"symbol": s, "timestamp": days, "open": open_, "high": np.maximum(open_, close) * (1 + wide), "low": np.minimum(open_, close) * (1 - wide), "close": close, "volume": r.integers(100_000, 900_000, sessions).astype(float), "source": "synthetic"}))
        if s == BENCHMARK:
            continue
        for q, at in enumerate(days[::63]):
            features.append({"symbol": s, "observed_at": at, "available_at": at + timedelta(days=2), "feature": "quality_score", "value": str(round(quality[i] + r.normal(0, 4), 6)), "revision": 0, "source": "synthetic", "__q": q})
        for at in days[r.choice(sessions, sessions // 20, replace=False)]:
            events.append({"symbol": s, "event_at": at, "available_at": at + timedelta(hours=int(r.integers(1, 20))), "event_type": "news_sentiment", "payload": json.dumps({"sentiment": round(float(r.uniform(-1, 1)), 6)}), "source": "synthetic"})
    universe = [{"symbol": s, "effective_from": days[0], "effective_to": pd.NaT, "available_at": days[0], "source": "synthetic"} for s in STOCKS]
    return {"prices": pd.concat(prices, ignore_index=True), "features": pd.DataFrame(features).drop(columns="__q"), "events": pd.DataFrame(events), "universe": pd.DataFrame(universe)}


def table(spark: SparkSession, frame: pd.DataFrame) -> DataFrame:
    """A pandas frame as a table; its columns' types are taken from the frame, so whole columns may be missing."""
    return spark.createDataFrame(pa.Table.from_pandas(frame, preserve_index=False))


METADATA = {"adapter": "synthetic", "data_classification": "synthetic", "price_adjustment": "split_and_dividend_adjusted", "survivorship": "point_in_time"}


def synthetic_bundle(spark: SparkSession, seed: int = 7, sessions: int = 520) -> Bundle:
    made = tables(seed, sessions)
    made["universe"]["effective_to"] = made["universe"]["effective_to"].astype("datetime64[ns]")
    return Bundle.of(spark, METADATA, **{k: table(spark, v) for k, v in made.items()})


def leaked_twin(bundle: Bundle) -> Bundle:
    """bundle with the first features (3 to 8, a fortieth of them) known thirty days before they were observed."""
    from dataclasses import replace

    n = bundle.features.count()
    few = max(3, min(8, n // 40))
    order = Window.orderBy("available_at", "symbol", "feature", "revision", "observed_at")
    first: DataFrame = bundle.features.orderBy("available_at", "symbol", "feature", "revision", "observed_at").limit(few).select("symbol", "feature", "observed_at", "available_at", "revision", F.row_number().over(order).alias("__k"))
    keys = ["symbol", "feature", "observed_at", "available_at", "revision"]
    rows = bundle.features.join(F.broadcast(first), keys, "left")
    early = F.when(F.col("__k").isNotNull(), F.col("observed_at") - F.expr("interval 30 days")).otherwise(F.col("available_at"))
    return replace(bundle, features=rows.withColumn("available_at", early).drop("__k"))


def example_files(folder: str | Path, seed: int = 42, sessions: int = 780) -> dict[str, Path]:
    """CSV files of eight stocks and an index: quarterly filings observed 45 days before and known 35 days after a quarter's mark, monthly sentiment, membership."""
    r, folder = np.random.default_rng(seed), Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    days, names = pd.bdate_range("2021-01-04", periods=sessions), [f"EX{i}" for i in range(1, 9)]
    prices, filings, events = [], [], []
    for i, s in enumerate((*names, "INDEX")):
        close = 50 * np.exp(np.cumsum(r.normal(0.0002 + 0.00005 * (i % 4), 0.011, sessions)))
        open_ = close * (1 + r.normal(0, 0.002, sessions))
        prices.append(pd.DataFrame({"symbol": s, "timestamp": days, "open": open_, "high": np.maximum(open_, close) * 1.002, "low": np.minimum(open_, close) * 0.998, "close": close, "volume": 1e6, "source": "example"}))
        if s == "INDEX":
            continue
        for mark in days[::63]:
            filings.append({"symbol": s, "observed_at": mark - timedelta(days=45), "available_at": mark + timedelta(days=35), "feature": "gross_margin", "value": round(float(r.uniform(0.1, 0.6)), 4), "revision": 0, "source": "example"})
        for at in days[::21]:
            events.append({"symbol": s, "event_at": at, "available_at": at, "event_type": "earnings_sentiment", "payload": json.dumps({"sentiment": round(float(r.uniform(-1, 1)), 4)}), "source": "example"})
    universe = [{"symbol": s, "effective_from": days[0], "effective_to": None, "available_at": days[0], "source": "example"} for s in names]
    out = {}
    for kind, frame in (("prices", pd.concat(prices)), ("features", pd.DataFrame(filings)), ("events", pd.DataFrame(events)), ("universe", pd.DataFrame(universe))):
        out[kind] = folder / f"{kind}.csv"
        frame.to_csv(out[kind], index=False)
    return out
