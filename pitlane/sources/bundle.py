"""The four research tables with their metadata, and point-in-time cuts of them."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field, replace
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlane.operators import asof
from pitlane.operators.ledger import canonical_json
from pitlane.sources.contracts import CONTRACTS, KINDS, Request, utc


def frame_fingerprint(df: DataFrame) -> str:
    """Hash of a table's columns and rows; neither row nor column order matters.

    Each row is hashed and the hashes are summed as two halves, so the driver sees three numbers however
    large the table is.
    """
    names = sorted(df.columns)
    row = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(names))), {"ignoreNullFields": "false"}), 256)
    half = lambda at: F.sum(F.conv(F.substring("__row", at, 15), 16, 10).cast("decimal(38,0)"))
    a = df.select(row.alias("__row")).agg(F.count("*").alias("n"), half(1).alias("a"), half(16).alias("b"), half(31).alias("c")).first()
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    return hashlib.sha256(canonical_json({"columns": [[c, types[c]] for c in names], "rows": [str(x) for x in a]}).encode()).hexdigest()


@dataclass(frozen=True)
class Bundle:
    """Clean tables; metadata is a dict that is not governed by time."""

    prices: DataFrame
    features: DataFrame
    events: DataFrame
    universe: DataFrame
    metadata: dict = field(default_factory=dict)
    #: what plans over this bundle and its cuts keep until release()
    kept: list[DataFrame] = field(default_factory=list, compare=False, repr=False)

    @classmethod
    def of(cls, spark: SparkSession, metadata: dict | None = None, **tables: DataFrame) -> Bundle:
        """Validated tables, kept (in memory, else on disk) until release(); kinds left out are empty."""
        clean = {k: CONTRACTS[k].apply(tables[k]).persist() if tables.get(k) is not None else CONTRACTS[k].empty(spark) for k in KINDS}
        return cls(**clean, metadata=dict(metadata or {}))

    def release(self) -> None:
        for x in (*(self.table(k) for k in KINDS), *self.kept):
            x.unpersist()
        self.kept.clear()

    def table(self, kind: str) -> DataFrame:
        return getattr(self, kind)

    def select(self, request: Request) -> Bundle:
        return replace(self, **{k: request.select(k, self.table(k)) for k in KINDS})

    def with_prices(self, prices: DataFrame) -> Bundle:
        return replace(self, prices=CONTRACTS["prices"].apply(prices))

    def symbols(self) -> DataFrame:
        return reduce(DataFrame.union, (self.table(k).select("symbol") for k in KINDS)).distinct().orderBy("symbol")

    def bounds(self) -> tuple[datetime | None, datetime | None]:
        return tuple(self.prices.agg(F.min("timestamp"), F.max("timestamp")).first())

    def describe(self) -> dict:
        start, end = self.bounds()
        return {**{k: self.table(k).count() for k in KINDS}, "symbols": self.symbols().count(), "start": start, "end": end, "fingerprint": self.fingerprint()}

    def fingerprint(self) -> str:
        return hashlib.sha256(canonical_json({**{k: frame_fingerprint(self.table(k)) for k in KINDS}, "metadata": self.metadata}).encode()).hexdigest()

    def as_of(self, when: datetime | str) -> Bundle:
        """What was knowable at a time: prices up to it, features by both clocks, events by the clock of knowledge, members known by then."""
        t = F.lit(utc(when))
        return replace(
            self,
            prices=self.prices.where(F.col("timestamp") <= t),
            features=self.features.where((F.col("available_at") <= t) & (F.col("observed_at") <= t)),
            events=self.events.where(F.col("available_at") <= t),
            universe=self.universe.where(F.col("available_at") <= t),
        )

    def active(self, at: DataFrame) -> DataFrame:
        """t, symbol: members at each t; without a universe table those priced in the last session up to t."""
        if self.universe.limit(1).count():
            return asof.members(self.universe, at)
        return asof.members_without_universe(self.prices.withColumnRenamed("timestamp", "session"), at)
