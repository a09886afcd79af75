"""Contracts of the four research tables: required columns, coercions, rules and keys.

clean() is a lazy projection; violations() counts every broken rule of a table in one aggregate (and
one more for the key), so validation costs a pass or two whatever the number of rules. Columns beyond
the required ones pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import UTC, date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlane.errors import ConfigurationError, DataContractError

KINDS = ("prices", "features", "events", "universe")


def instant(c: str) -> Column:
    """A timestamp from text, dates or timestamps; without a zone it is UTC (the session's zone)."""
    return F.expr(f"try_cast(`{c}` as timestamp)")


def symbol(c: str = "symbol") -> Column:
    return F.upper(F.trim(F.col(c).cast("string")))


def _blank(c: str) -> str:
    return f"coalesce(trim({c}) = '', true)"


def _number(c: str) -> Column:
    return F.expr(f"try_cast(`{c}` as double)")


def no_object(payload: str) -> str:
    """Is text anything but a JSON object."""
    return f"not coalesce(schema_of_variant(try_parse_json({payload})) like 'OBJECT%', false)"


@dataclass(frozen=True)
class Contract:
    kind: str
    types: dict[str, str]
    clean: Callable[[DataFrame], DataFrame]
    rules: dict[str, str]
    key: tuple[str, ...] = ()
    order: tuple[str, ...] = ()

    def empty(self, spark: SparkSession) -> DataFrame:
        return self.clean(spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in self.types.items()))).drop("__bad_to")

    def missing(self, df: DataFrame) -> list[str]:
        optional = {"revision", "payload"}
        return sorted(set(self.types) - optional - set(df.columns))

    def violations(self, df: DataFrame) -> DataFrame:
        """rule, n: how many rows break each rule, all rules listed; duplicate_key counts rows beyond the first of a key."""
        rows = self.clean(df)
        counts = rows.agg(*(F.count(F.when(F.expr(c), 1)).alias(r) for r, c in self.rules.items()))
        listed = counts.select(F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("n")) for r in self.rules))).alias("x")).select("x.rule", "x.n")
        if self.key:
            twice = rows.groupBy(*self.key).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n"))
            listed = listed.unionByName(twice.select(F.lit("duplicate_key").alias("rule"), "n"))
        return listed

    def apply(self, df: DataFrame) -> DataFrame:
        """The cleaned table; DataContractError names missing columns, or every broken rule with its number of rows."""
        gone = self.missing(df)
        if gone:
            if not df.columns or df.limit(1).count() == 0:
                return self.empty(df.sparkSession)
            raise DataContractError(f"{self.kind} lacks columns: {', '.join(gone)}")
        broken = [f"{r.rule} ({r.n})" for r in self.violations(df).where("n > 0").orderBy("rule").collect()]
        if broken:
            raise DataContractError(f"{self.kind} breaks: {', '.join(broken)}")
        return self.clean(df).drop("__bad_to")

    def sorted(self, df: DataFrame) -> DataFrame:
        """Rows in canonical order; for output only."""
        return df.orderBy(*self.order)


def _clean_prices(df: DataFrame) -> DataFrame:
    return df.withColumns({"symbol": symbol(), "timestamp": instant("timestamp"), **{c: _number(c) for c in ("open", "high", "low", "close", "volume")}, "source": F.trim(F.col("source").cast("string"))})


def _clean_features(df: DataFrame) -> DataFrame:
    """value stays what it was, as text; value_num is its number where it has one."""
    revision = F.coalesce(F.expr("try_cast(revision as int)"), F.when(F.col("revision").isNull(), 0)) if "revision" in df.columns else F.lit(0)
    return df.withColumns({"symbol": symbol(), "feature": F.trim(F.col("feature").cast("string")), "observed_at": instant("observed_at"), "available_at": instant("available_at"), "value": F.col("value").cast("string"), "revision": revision, "source": F.trim(F.col("source").cast("string"))}).withColumn("value_num", _number("value"))


def _clean_events(df: DataFrame) -> DataFrame:
    payload = F.coalesce(F.when(F.trim(F.col("payload").cast("string")) != "", F.col("payload").cast("string")), F.lit("{}")) if "payload" in df.columns else F.lit("{}")
    return df.withColumns({"symbol": symbol(), "event_at": instant("event_at"), "available_at": instant("available_at"), "event_type": F.trim(F.col("event_type").cast("string")), "payload": payload, "source": F.trim(F.col("source").cast("string"))})


def _clean_universe(df: DataFrame) -> DataFrame:
    to = F.trim(F.col("effective_to").cast("string"))
    # text that is no time must not read as "open-ended"
    return df.withColumns({"__bad_to": F.coalesce(to != "", F.lit(False)) & instant("effective_to").isNull(), "symbol": symbol(), "effective_from": instant("effective_from"), "effective_to": instant("effective_to"), "available_at": instant("available_at"), "source": F.trim(F.col("source").cast("string"))})


def _null(c: str) -> str:
    return f"{c} is null"


def _no_price(c: str) -> str:
    return f"{c} is null or isnan({c})"


CONTRACTS = {
    "prices": Contract(
        "prices",
        {"symbol": "string", "timestamp": "timestamp", "open": "double", "high": "double", "low": "double", "close": "double", "volume": "double", "source": "string"},
        _clean_prices,
        {"blank_symbol": _blank("symbol"), "bad_timestamp": _null("timestamp"), **{f"bad_{c}": _no_price(c) for c in ("open", "high", "low", "close")}, "blank_source": _blank("source")},
        ("symbol", "timestamp"),
        ("timestamp", "symbol"),
    ),
    "features": Contract(
        "features",
        {"symbol": "string", "observed_at": "timestamp", "available_at": "timestamp", "feature": "string", "value": "string", "source": "string", "revision": "int"},
        _clean_features,
        {"blank_symbol": _blank("symbol"), "bad_observed_at": _null("observed_at"), "bad_available_at": _null("available_at"), "blank_feature": _blank("feature"), "bad_revision": _null("revision"), "blank_source": _blank("source")},
        ("symbol", "observed_at", "available_at", "feature", "revision"),
        ("available_at", "symbol", "feature", "revision"),
    ),
    "events": Contract(
        "events",
        {"symbol": "string", "event_at": "timestamp", "available_at": "timestamp", "event_type": "string", "payload": "string", "source": "string"},
        _clean_events,
        {"blank_symbol": _blank("symbol"), "bad_event_at": _null("event_at"), "bad_available_at": _null("available_at"), "blank_event_type": _blank("event_type"), "payload_no_object": no_object("payload"), "blank_source": _blank("source")},
        (),
        ("available_at", "symbol", "event_type"),
    ),
    "universe": Contract(
        "universe",
        {"symbol": "string", "effective_from": "timestamp", "effective_to": "timestamp", "available_at": "timestamp", "source": "string"},
        _clean_universe,
        {"blank_symbol": _blank("symbol"), "bad_effective_from": _null("effective_from"), "bad_available_at": _null("available_at"), "bad_effective_to": "__bad_to", "empty_interval": "coalesce(effective_to <= effective_from, false)", "blank_source": _blank("source")},
        (),
        ("symbol", "effective_from"),
    ),
}


def utc(value: str | date | datetime | None) -> datetime | None:
    """A point in time in UTC; without a zone it is taken as UTC."""
    if value is None:
        return None
    if isinstance(value, str):
        try:
            value = datetime.fromisoformat(value.strip())
        except ValueError as e:
            raise ConfigurationError(f"no time: {value!r}") from e
    if not isinstance(value, datetime):
        value = datetime(value.year, value.month, value.day)
    return value.replace(tzinfo=UTC) if value.tzinfo is None else value.astimezone(UTC)


@dataclass(frozen=True)
class Request:
    """What to read: bounds on economic time, symbols (in order, each once) and kinds of tables."""

    start: datetime | str | None = None
    end: datetime | str | None = None
    symbols: tuple[str, ...] = ()
    kinds: tuple[str, ...] = field(default=KINDS)

    def __post_init__(self):
        start, end = utc(self.start), utc(self.end)
        if start and end and start > end:
            raise ConfigurationError("start lies after end")
        if isinstance(self.symbols, str) or not isinstance(self.symbols, Iterable):
            raise ConfigurationError("symbols must be a list")
        names = tuple(dict.fromkeys(str(s).strip().upper() for s in self.symbols))
        if "" in names:
            raise ConfigurationError("a symbol is empty")
        unknown = sorted(set(self.kinds) - set(KINDS))
        if unknown:
            raise ConfigurationError(f"unknown kinds: {', '.join(unknown)}")
        for name, value in (("start", start), ("end", end), ("symbols", names), ("kinds", tuple(k for k in KINDS if k in self.kinds))):
            object.__setattr__(self, name, value)

    #: The clock that bounds apply to; membership has none.
    CLOCK = {"prices": "timestamp", "features": "observed_at", "events": "event_at"}  # noqa: RUF012

    def select(self, kind: str, df: DataFrame) -> DataFrame:
        """df's rows within the request: predicates that reach a Parquet scan when asked of a raw table."""
        if kind not in self.kinds:
            return df.limit(0)
        where = []
        if self.symbols:
            where.append(F.col("symbol").isin(*self.symbols))
        clock = self.CLOCK.get(kind)
        if clock and self.start:
            where.append(F.col(clock) >= F.lit(self.start))
        if clock and self.end:
            where.append(F.col(clock) <= F.lit(self.end))
        return df.where(reduce(lambda a, b: a & b, where)) if where else df
