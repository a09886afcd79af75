"""Signals: one row a decision and symbol with score, eligible and rationale."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlane.errors import StrategyContractError

RATIONALE = 1000
COLUMNS = ("decision", "symbol", "score", "eligible", "rationale")


def finite(c: str):
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))


def normalise(signals: DataFrame) -> DataFrame:
    """COLUMNS with defaults (eligible, no rationale), symbols in upper case, rationales of 1000 characters at most; NaN and infinite scores are null."""
    if "symbol" not in signals.columns or "score" not in signals.columns:
        raise StrategyContractError("signals need symbol and score")
    eligible = F.coalesce(F.col("eligible").cast("boolean"), F.lit(True)) if "eligible" in signals.columns else F.lit(True)
    why = F.substring(F.coalesce(F.col("rationale").cast("string"), F.lit("")), 1, RATIONALE) if "rationale" in signals.columns else F.lit("")
    rows = signals.withColumns({"symbol": F.upper(F.trim(F.col("symbol").cast("string"))), "score": F.expr("try_cast(score as double)"), "eligible": eligible, "rationale": why})
    return rows.withColumn("score", finite("score")).select(*COLUMNS)


def violations(signals: DataFrame) -> DataFrame:
    """rule, n of normalised signals: blank symbols, eligible rows without a finite score, and symbols given twice for a decision."""
    counts = signals.agg(F.count(F.when(F.coalesce(F.col("symbol") == "", F.lit(True)), 1)).alias("a"), F.count(F.when(F.col("eligible") & F.col("score").isNull(), 1)).alias("b"))
    listed = counts.select(F.explode(F.array(F.struct(F.lit("blank_symbol").alias("rule"), F.col("a").alias("n")), F.struct(F.lit("eligible_without_score").alias("rule"), F.col("b").alias("n")))).alias("x")).select("x.rule", "x.n")
    twice = signals.groupBy("decision", "symbol").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n"))
    return listed.unionByName(twice.select(F.lit("duplicate_symbol").alias("rule"), "n"))


def checked(signals: DataFrame) -> DataFrame:
    """Normalised signals; StrategyContractError names the broken rules."""
    rows = normalise(signals)
    broken = [f"{r.rule} ({r.n})" for r in violations(rows).where("n > 0").orderBy("rule").collect()]
    if broken:
        raise StrategyContractError(f"signals break: {', '.join(broken)}")
    return rows


def restrict(signals: DataFrame, members: DataFrame, counts: DataFrame, minimum_history: int) -> DataFrame:
    """Symbols that aren't members, then those with a short history, become ineligible; the second reason replaces the first.

    members: decision, symbol. counts: decision, symbol, sessions; symbols without any price have no row there and count as long enough.
    """
    rows = signals.join(members.select("decision", "symbol", F.lit(True).alias("__in")), ["decision", "symbol"], "left")
    rows = rows.join(counts.select("decision", "symbol", F.col("sessions").alias("__sessions")), ["decision", "symbol"], "left")
    short, outside = F.coalesce(F.col("__sessions") < minimum_history, F.lit(False)), F.col("__in").isNull()
    why = F.when(short, F.concat(F.lit("history of "), F.col("__sessions"), F.lit(f" sessions, {minimum_history} needed"))).when(outside, F.lit("not in the universe at this time")).otherwise(F.col("rationale"))
    return rows.select("decision", "symbol", "score", (F.col("eligible") & ~short & ~outside).alias("eligible"), why.alias("rationale"))


def frame_of(output) -> pd.DataFrame:
    """symbol, score, eligible and rationale of what a strategy's score() may return: a frame (symbols as a column or the index), a series or a mapping."""
    if isinstance(output, Mapping):
        output = pd.Series(output, dtype="float64")
    if isinstance(output, pd.Series):
        output = output.rename("score").rename_axis("symbol").reset_index()
    if not isinstance(output, pd.DataFrame):
        raise StrategyContractError(f"score() returned {type(output).__name__}")
    frame = output if "symbol" in output.columns else output.rename_axis("symbol").reset_index()
    if "score" not in frame.columns:
        raise StrategyContractError("score() returned no score")
    out = pd.DataFrame({"symbol": frame["symbol"].astype("string").str.strip().str.upper(), "score": pd.to_numeric(frame["score"], errors="coerce")})
    out["eligible"] = frame["eligible"].fillna(True).astype(bool) if "eligible" in frame.columns else True
    out["rationale"] = frame["rationale"].fillna("").astype(str).str[:RATIONALE] if "rationale" in frame.columns else ""
    return out
