"""Sessions, decision schedules and executions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sessions(prices: DataFrame) -> DataFrame:
    """session, n: the distinct sessions numbered from 1. A calendar is a few thousand rows whatever the price table holds."""
    return prices.select("session").distinct().withColumn("n", F.row_number().over(Window.orderBy("session")))


def numbered(prices: DataFrame, calendar: DataFrame) -> DataFrame:
    """prices with n, the global session number that lookbacks count."""
    return prices.join(F.broadcast(calendar), "session")


def period_of(session, frequency: str):
    """Start of the period a session belongs to: daily, weekly (ending Friday) or monthly."""
    if frequency == "daily":
        return session
    if frequency == "weekly":
        return F.date_trunc("week", F.date_add(session, 2)).cast("date")
    if frequency == "monthly":
        return F.date_trunc("month", session).cast("date")
    raise ValueError(f"unknown frequency: {frequency}")


def decisions(calendar: DataFrame, frequency: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """decision, n, execution, exit: the last session of each period, the session after it, and the next decision's execution.

    Executions use all sessions, also those past `end`. The last decision has no exit.
    """
    following = calendar.withColumn("execution", F.lead("session").over(Window.orderBy("session")))
    bounded = following
    if start:
        bounded = bounded.where(F.col("session") >= F.lit(start).cast("date"))
    if end:
        bounded = bounded.where(F.col("session") <= F.lit(end).cast("date"))
    last = bounded.groupBy(period_of(F.col("session"), frequency).alias("period")).agg(F.max(F.struct("session", "n", "execution")).alias("d"))
    picked = last.select(F.col("d.session").alias("decision"), "d.n", "d.execution")
    return picked.withColumn("exit", F.lead("execution").over(Window.orderBy("decision")))
