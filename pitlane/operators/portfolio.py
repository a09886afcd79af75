"""Long-only, open-to-open portfolios: picks, weights, returns, drift, turnover and costs as tables by decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top(signals: DataFrame, count: int, minimum_score: float | None = None) -> DataFrame:
    """The best `count` eligible rows of each decision by (score desc, symbol), with position from 1."""
    if count < 1:
        raise ValueError("count must be positive")
    rows = signals.where("score is not null and not isnan(score)")
    if minimum_score is not None:
        rows = rows.where(F.col("score") >= minimum_score)
    order = Window.partitionBy("decision").orderBy(F.desc("score"), "symbol")
    return rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= count)


def weights(picks: DataFrame, scheme: str, max_weight: float = 1.0) -> DataFrame:
    """picks with weight: raw weights normalised, then capped; what the cap cuts off stays cash."""
    group = Window.partitionBy("decision")
    raw: Column
    if scheme == "equal":
        raw = F.lit(1.0)
    elif scheme == "rank":
        raw = (F.count("*").over(group) - F.col("position") + 1).cast("double")
    elif scheme == "score":
        raw = F.col("score") - F.min("score").over(group) + 1e-12
    else:
        raise ValueError(f"unknown weighting: {scheme}")
    rows = picks.withColumn("raw", raw)
    return rows.withColumn("weight", F.least(F.col("raw") / F.sum("raw").over(group), F.lit(max_weight))).drop("raw").where("weight > 0")


def holdings(weighted: DataFrame, schedule: DataFrame, prices: DataFrame) -> DataFrame:
    """Weighted picks with their open-to-open return; those without two positive opens stay cash and drop out."""
    opens = lambda day, name: prices.select("symbol", F.col("session").alias(day), F.col("open").alias(name))
    rows = weighted.join(F.broadcast(schedule.where("exit is not null").select("decision", "execution", "exit")), "decision")
    rows = rows.join(opens("execution", "entry_open"), ["symbol", "execution"]).join(opens("exit", "exit_open"), ["symbol", "exit"])
    return rows.where("entry_open > 0 and exit_open > 0").withColumn("period_return", F.col("exit_open") / F.col("entry_open") - 1)


def drifted(held: DataFrame) -> DataFrame:
    """decision, symbol, drifted: weights at the exit, cash included in the total."""
    group = Window.partitionBy("decision")
    value = F.col("weight") * (1 + F.col("period_return"))
    total = F.greatest(F.lit(0.0), 1 - F.sum("weight").over(group)) + F.sum(value).over(group)
    return held.select("decision", "symbol", F.when(total > 0, value / total).alias("drifted")).where("drifted > 0")


def turnover(held: DataFrame, schedule: DataFrame) -> DataFrame:
    """decision, turnover: half the absolute change of weights and cash against the previous drifted book.

    Both books are stacked with opposite signs and summed by (decision, symbol), which costs one
    shuffle where a full outer join costs two.
    """
    periods = schedule.where("exit is not null").select("decision", F.lag("decision").over(Window.orderBy("decision")).alias("before"))
    old = drifted(held).join(F.broadcast(periods.withColumnsRenamed({"decision": "now", "before": "decision"})), "decision").select(F.col("now").alias("decision"), "symbol", F.lit(0.0).alias("new"), F.col("drifted").alias("old"))
    new = held.select("decision", "symbol", F.col("weight").alias("new"), F.lit(0.0).alias("old"))
    by_symbol = new.unionByName(old).groupBy("decision", "symbol").agg(F.sum("new").alias("new"), F.sum("old").alias("old"))
    moved = by_symbol.groupBy("decision").agg(F.sum(F.abs(F.col("new") - F.col("old"))).alias("moved"), F.sum("new").alias("new"), F.sum("old").alias("old"))
    return moved.select("decision", (0.5 * (F.col("moved") + F.abs((1 - F.col("new")) - (1 - F.col("old"))))).alias("turnover"))


def periods(held: DataFrame, schedule: DataFrame, bps: float) -> DataFrame:
    """decision, execution, exit, gross_return, turnover, cost, strategy_return, holdings_count for each period; an empty one earns nothing."""
    if bps < 0:
        raise ValueError("costs must not be negative")
    gross = held.groupBy("decision").agg(F.sum(F.col("weight") * F.col("period_return")).alias("g"), F.count("*").alias("c"), F.sum("weight").alias("w"))
    rows = schedule.where("exit is not null").join(gross, "decision", "left").join(turnover(held, schedule), "decision", "left")
    rows = rows.select("decision", "execution", "exit", F.coalesce("g", F.lit(0.0)).alias("gross_return"), F.coalesce("turnover", F.lit(0.0)).alias("turnover"), F.coalesce("c", F.lit(0)).alias("holdings_count"), F.coalesce("w", F.lit(0.0)).alias("gross_exposure"))
    rows = rows.withColumn("cost", F.col("turnover") * bps / 1e4)
    return rows.withColumn("strategy_return", F.col("gross_return") - F.col("cost"))


def equity(rows: DataFrame, column: str = "strategy_return", capital: float = 1.0) -> DataFrame:
    """rows (exit, column) with equity and drawdown. One row a period, so one ordered task."""
    order = Window.orderBy("exit").rowsBetween(Window.unboundedPreceding, 0)
    grown = rows.withColumn("equity", capital * F.product(1 + F.coalesce(F.col(column), F.lit(0.0))).over(order))
    return grown.withColumn("drawdown", F.col("equity") / F.max("equity").over(order) - 1)
