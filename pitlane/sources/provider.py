"""Prices from a public provider: batched downloads with retries and a Parquet cache, and wide frames made long."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitlane.errors import ConfigurationError, InsufficientDataError
from pitlane.sources.bundle import Bundle
from pitlane.sources.contracts import Request
from pitlane.sources.files import FAIL, PASS, Health

BATCH, ATTEMPTS, PAUSE = 25, 3, 0.5


def flatten(wide: DataFrame, source: str) -> DataFrame:
    """Canonical prices of a wide table: timestamp, `<SYMBOL>|<Field>` columns, and optionally ingest_seq.

    Rows without all four prices go, of several for one session the last ingested stays, and no volume is 0.
    """
    names = sorted({c.split("|")[0] for c in wide.columns if "|" in c})
    at = {(c.split("|")[0], c.split("|")[1].strip().lower()): c for c in wide.columns if "|" in c}
    value = lambda s, f: F.expr(f"try_cast(`{at[s, f]}` as double)") if (s, f) in at else F.lit(None).cast("double")
    fields = ("open", "high", "low", "close", "volume")
    seq = F.col("ingest_seq") if "ingest_seq" in wide.columns else F.monotonically_increasing_id()
    rows = wide.withColumn("__seq", seq).select(F.expr("try_cast(timestamp as timestamp)").alias("timestamp"), "__seq", F.explode(F.array(*(F.struct(F.lit(s.strip().upper()).alias("symbol"), *(value(s, f).alias(f) for f in fields)) for s in names))).alias("x"))
    rows = rows.select("x.symbol", "timestamp", *(f"x.{f}" for f in fields), "__seq")
    for f in fields[:4]:
        rows = rows.where(F.col(f).isNotNull() & ~F.isnan(f))
    last = Window.partitionBy("symbol", "timestamp").orderBy(F.desc("__seq"))
    rows = rows.withColumn("__k", F.row_number().over(last)).where("__k = 1").drop("__k", "__seq")
    return rows.withColumns({"volume": F.coalesce(F.nanvl("volume", F.lit(0.0)), F.lit(0.0)), "source": F.lit(source)})


def synthesised_universe(prices: DataFrame, source: str) -> DataFrame:
    """Every symbol valid, and known, from its first session, without an end. Such a universe knows no delisted stock."""
    first = prices.groupBy("symbol").agg(F.min("timestamp").alias("effective_from"))
    return first.select("symbol", "effective_from", F.lit(None).cast("timestamp").alias("effective_to"), F.col("effective_from").alias("available_at"), F.lit(source).alias("source"))


@dataclass(frozen=True)
class ProviderAdapter:
    """fetch(symbols, start, end) gives a pandas frame with two column levels (symbol, field) and a time index."""

    spark: SparkSession
    fetch: Callable[[Sequence[str], object, object], pd.DataFrame]
    symbols: tuple[str, ...]
    cache: str | None = None
    ttl_seconds: float = 86_400.0
    metadata: dict = field(default_factory=dict)
    name: str = "provider"
    sleep: Callable[[float], None] = time.sleep

    def health(self) -> Health:
        return Health(PASS) if self.symbols else Health(FAIL, ("no symbols",))

    def _batch(self, names: Sequence[str], request: Request) -> pd.DataFrame:
        key = hashlib.sha256(repr((self.name, tuple(names), request.start, request.end)).encode()).hexdigest()[:24]
        held = Path(self.cache, f"{key}.parquet") if self.cache else None
        if held and held.exists() and time.time() - held.stat().st_mtime < self.ttl_seconds:
            return pd.read_parquet(held)
        for attempt in range(ATTEMPTS):
            try:
                got = self.fetch(names, request.start, request.end)
                break
            except Exception as e:  # noqa: BLE001 - a provider may raise anything
                if attempt + 1 == ATTEMPTS:
                    raise InsufficientDataError(f"the provider failed {ATTEMPTS} times: {e}") from e
                self.sleep(PAUSE * 2**attempt)
        flat = got.copy()
        flat.columns = [f"{s}|{f}" for s, f in got.columns]
        flat = flat.rename_axis("timestamp").reset_index()
        flat["ingest_seq"] = range(len(flat))
        if held:
            held.parent.mkdir(parents=True, exist_ok=True)
            flat.to_parquet(held)
        return flat

    def load(self, request: Request | None = None) -> Bundle:
        request = request or Request()
        wanted = [s for s in (request.symbols or self.symbols) if s in {x.upper() for x in self.symbols}]
        if not wanted:
            raise ConfigurationError("none of the symbols asked for is offered")
        frames = [self._batch(wanted[i : i + BATCH], request) for i in range(0, len(wanted), BATCH)]
        parts = [flatten(self.spark.createDataFrame(f), self.name) for f in frames if len(f)]
        if not parts:
            raise InsufficientDataError("the provider gave no rows")
        prices = parts[0]
        for p in parts[1:]:
            prices = prices.unionByName(p)
        meta = {"adapter": self.name, "data_classification": "public_provider", "survivorship": "current_constituents", **self.metadata}
        return Bundle.of(self.spark, meta, prices=prices, universe=synthesised_universe(prices, self.name)).select(request)
