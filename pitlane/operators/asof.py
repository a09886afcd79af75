"""What was knowable at a set of dates. `at` tables hold a column t.

A table of dates is broadcast if its counted rows stay under FEW; a longer one is joined as Spark sees
fit. Calendars made here hold one row a session: a century of days is under 40,000.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FEW = 200_000


def few(at: DataFrame) -> DataFrame:
    return F.broadcast(at) if at.limit(FEW + 1).count() <= FEW else at


def latest_prices(prices: DataFrame, at: DataFrame) -> DataFrame:
    """t, symbol and the last price row at or before each t, without a range join: rows and dates are merged and the last row carried forward."""
    symbols = prices.select("symbol").distinct()
    rows = prices.select("symbol", F.col("session").alias("k"), F.struct("session", "close").alias("row"), F.lit(None).cast("date").alias("t"))
    asked = symbols.join(few(at)).select("symbol", F.col("t").alias("k"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"), "t")
    order = Window.partitionBy("symbol").orderBy("k", F.col("t").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    merged = rows.unionByName(asked).withColumn("row", F.last("row", ignorenulls=True).over(order))
    return merged.where("t is not null and row is not null").select("t", "symbol", "row.session", "row.close")


def latest_features(features: DataFrame, at: DataFrame) -> DataFrame:
    """t, symbol, feature and the latest value by (observed_at, available_at, revision) among rows with both clocks at or before t.

    A row is visible from the later of its clocks; the running maximum over that order already is the
    answer at each of its rows, and dates take it from the last row before them.
    """
    key = F.greatest("observed_at", "available_at")
    rows = features.select("symbol", "feature", key.alias("k"), F.struct("observed_at", "available_at", "revision", "value").alias("row"), F.lit(None).cast("date").alias("t"))
    names = features.select("symbol", "feature").distinct()
    asked = names.join(few(at)).select("symbol", "feature", F.col("t").alias("k"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"), "t")
    order = Window.partitionBy("symbol", "feature").orderBy("k", F.col("t").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    merged = rows.unionByName(asked).withColumn("row", F.max("row").over(order))
    return merged.where("t is not null and row is not null").select("t", "symbol", "feature", "row.observed_at", "row.available_at", "row.revision", "row.value")


def known_events(events: DataFrame, at: DataFrame, days: int | None = None, include_future: bool = False, event_type: str | None = None) -> DataFrame:
    """Events available at t; by default those that have happened, and only the last `days` days (or one type) if given.

    With `days`, an event is dealt to the dates it can be seen on and meets `at` by equality, at most
    days + 1 rows for each event; without, every later date sees it and the output itself is that large.
    """
    cond = F.col("available_at") <= F.col("t")
    if event_type is not None:
        events = events.where(F.col("event_type") == event_type)
    if not include_future:
        cond = cond & (F.col("event_at") <= F.col("t"))
    if days is None:
        return events.join(few(at), cond)
    since = F.col("event_at") >= F.col("t") - F.expr(f"interval '{int(days)}' day")
    first = F.to_date("available_at") if include_future else F.to_date(F.greatest("available_at", "event_at"))
    last = F.date_add(F.to_date("event_at"), days)
    dealt = events.withColumn("__day", F.explode(F.when(first <= last, F.sequence(first, last))))
    return dealt.join(few(at.withColumn("__day", F.to_date("t"))), "__day").where(cond & since).drop("__day")


def members(universe: DataFrame, at: DataFrame) -> DataFrame:
    """t, symbol: membership intervals [from, to) known at t."""
    cond = (F.col("available_at") <= F.col("t")) & (F.col("effective_from") <= F.col("t")) & (F.col("effective_to").isNull() | (F.col("effective_to") > F.col("t")))
    return universe.join(few(at), cond).select("t", "symbol").distinct()


def members_without_universe(prices: DataFrame, at: DataFrame) -> DataFrame:
    """t, symbol: those priced in the last session at or before t."""
    days = prices.select("session").distinct()
    last = days.join(few(at), F.col("session") <= F.col("t")).groupBy("t").agg(F.max("session").alias("session"))
    return prices.join(F.broadcast(last), "session").select("t", "symbol").distinct()


def perturbed(prices: DataFrame, cutoff, clock: str = "session") -> DataFrame:
    """prices whose rows after a cutoff are corrupted: prices times 1.5 + i / n, i counting the n future rows by (time, symbol), and volume times 3.

    i is the number of rows of earlier sessions (sums over the calendar) plus the place within the session,
    so no task sees more than one session's rows.
    """
    future = prices.where(F.col(clock) > cutoff)
    order = Window.orderBy(clock).rowsBetween(Window.unboundedPreceding, -1)
    days = future.groupBy(clock).agg(F.count("*").alias("__in"))
    days = days.select(clock, F.coalesce(F.sum("__in").over(order), F.lit(0)).alias("__before"), F.sum("__in").over(Window.partitionBy()).alias("__n"))
    rows = prices.join(F.broadcast(days), clock, "left")
    place = F.row_number().over(Window.partitionBy(clock).orderBy("symbol")) - 1
    factor = 1.5 + (F.col("__before") + place) / F.col("__n")
    after = F.col("__n").isNotNull()
    changed = {c: F.when(after, F.col(c) * F.col("__factor")).otherwise(F.col(c)) for c in ("open", "high", "low", "close")}
    return rows.withColumn("__factor", factor).withColumns({**changed, "volume": F.when(after, F.col("volume") * 3).otherwise(F.col("volume"))}).select(*prices.columns)


def last_sessions(prices: DataFrame, sessions: int, symbols: tuple[str, ...] = (), clock: str = "session") -> DataFrame:
    """Rows of some symbols in the last distinct sessions that these symbols have."""
    rows = prices.where(F.col("symbol").isin(*symbols)) if symbols else prices
    days = rows.select(clock).distinct().orderBy(F.desc(clock)).limit(sessions)
    return rows.join(F.broadcast(days), clock, "left_semi")
