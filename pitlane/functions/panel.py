"""Technical columns over prices numbered by global session (symbol, session, n, close).

Lookbacks count sessions of the whole calendar: frames are RANGE frames on the session number, so a
symbol that misses a session has no value rather than an older one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _frame(width: int):
    return Window.partitionBy("symbol").orderBy("n").rangeBetween(1 - width, 0)


def lagged(column: str, by: int) -> Column:
    """The column exactly `by` sessions earlier, else null."""
    return F.first(column).over(Window.partitionBy("symbol").orderBy("n").rangeBetween(-by, -by))


def change(by: int, column: str = "close") -> Column:
    return F.try_divide(F.col(column), lagged(column, by)) - 1


def full_window(value: Column, column: str, width: int) -> Column:
    """value where all `width` sessions of the frame have the column."""
    return F.when(F.count(column).over(_frame(width)) == width, value)


def sma(width: int) -> Column:
    return full_window(F.avg("close").over(_frame(width)), "close", width)


def with_volatility(px: DataFrame, width: int, annual: float = 52.0) -> DataFrame:
    ret = px.withColumn("ret", change(1))
    return ret.withColumn("volatility", full_window(F.stddev_samp("ret").over(_frame(width)), "ret", width) * annual**0.5)


def pct_rank(value: str, by: list[str], singleton_half: bool = False) -> Column:
    """Average-tie percentile rank among non-null values of the group; a group of one gives 1.0, or 0.5 if asked."""
    group, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last())
    ties = F.count(value).over(Window.partitionBy(*by, value))
    n = F.count(value).over(group)
    rank = (F.rank().over(order) + (ties - 1) / 2) / n
    if singleton_half:
        rank = F.when(n == 1, 0.5).otherwise(rank)
    return F.when(F.col(value).isNotNull(), rank)


def winsorized(df: DataFrame, value: str, by: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """value clipped to the group's linearly interpolated quantiles."""
    if not 0 <= low < high <= 1:
        raise ValueError("limits must satisfy 0 <= low < high <= 1")
    ends = df.groupBy(*by).agg(F.percentile(value, F.lit(low)).alias("lo"), F.percentile(value, F.lit(high)).alias("hi"))
    clipped = F.when(F.col(value).isNotNull(), F.least(F.greatest(F.col(value), F.col("lo")), F.col("hi")))
    return df.join(ends, by).withColumn(value, clipped).drop("lo", "hi")


def combined(parts: list[tuple[str, float]]) -> Column:
    """Weighted mean over the parts present; null where all are missing."""
    if any(w < 0 for _, w in parts):
        raise ValueError("weights must not be negative")
    top = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in parts), F.lit(0.0))
    weight = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    return F.try_divide(top, F.nullif(weight, F.lit(0.0)))
