"""Portfolio metrics as one aggregate over the periods table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitlane.operators.portfolio import equity


def finite(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def _core(per_year: float, risk_free: float) -> tuple[list[Column], list[Column]]:
    """Aggregates, and the metrics made of them."""
    rf = (1 + risk_free) ** (1 / per_year) - 1
    r = F.col("strategy_return")
    parts = [
        F.count(r).alias("periods"),
        (F.product(1 + r) - 1).alias("total_return"),
        F.coalesce(F.stddev_samp(r) * per_year**0.5, F.lit(0.0)).alias("annual_volatility"),
        F.avg(r - rf).alias("mean"),
        (F.coalesce(F.stddev_samp(F.when(r < rf, r - rf)), F.lit(0.0)) * per_year**0.5).alias("down"),
        F.avg((r > 0).cast("double")).alias("win_rate"),
        F.max(r).alias("best"),
        F.min(r).alias("worst"),
    ]
    annual = F.when(F.col("total_return") <= -1, -1.0).when(F.col("periods") > 0, F.pow(1 + F.col("total_return"), F.try_divide(F.lit(per_year), F.col("periods"))) - 1)
    ratio = lambda d: F.when(F.col(d) > 0, F.col("mean") * per_year / F.col(d))
    return parts, [F.col("periods"), F.col("total_return"), annual.alias("annual_return"), F.col("annual_volatility"), ratio("annual_volatility").alias("sharpe"), ratio("down").alias("sortino"), F.col("win_rate"), F.col("best"), F.col("worst")]


def core(rows: DataFrame, per_year: float, risk_free: float = 0.0) -> DataFrame:
    """periods, total_return, annual_return, annual_volatility, sharpe, sortino, win_rate, best, worst of strategy_return."""
    parts, out = _core(per_year, risk_free)
    return rows.where("strategy_return is not null").agg(*parts).select(*out)


def _with_var(rows: DataFrame) -> DataFrame:
    """rows with their 5 % quantile beside each; one row a period, so one task."""
    return rows.withColumn("__var", F.percentile("strategy_return", F.lit(0.05)).over(Window.partitionBy()))


def tail(rows: DataFrame) -> DataFrame:
    """var_95 (linear 5 % quantile) and cvar_95 (mean at or below it)."""
    return _with_var(rows).agg(*_tail())


def _tail() -> list[Column]:
    return [F.max("__var").alias("var_95"), F.avg(F.when(F.col("strategy_return") <= F.col("__var"), F.col("strategy_return"))).alias("cvar_95")]


def _moments() -> tuple[list[Column], list[Column]]:
    r, n = "strategy_return", F.col("__n")
    parts = [F.count(r).cast("double").alias("__n"), F.skewness(r).alias("__g1"), F.kurtosis(r).alias("__g2")]
    skew = F.when(n > 2, F.col("__g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("__g2") + 6))
    return parts, [finite(skew).alias("skew"), finite(kurt).alias("excess_kurtosis")]


def moments(rows: DataFrame) -> DataFrame:
    """Bias-corrected skew (over 2 rows) and excess kurtosis (over 3)."""
    parts, out = _moments()
    return rows.agg(*parts).select(*out)


def _against(per_year: float) -> tuple[list[Column], list[Column]]:
    s, b = F.col("strategy_return"), F.col("benchmark_return")
    both = s.isNotNull() & b.isNotNull()
    parts = [F.count(F.when(both, 1)).alias("__both"), F.covar_samp(s, b).alias("__cov"), F.var_samp(F.when(both, b)).alias("__bv"), F.corr(s, b).alias("__corr"), F.avg(F.when(both, s)).alias("__ms"), F.avg(F.when(both, b)).alias("__mb"), F.stddev_samp(s - b).alias("__sd")]
    ok = (F.col("__both") > 1) & (F.col("__bv") > 0)
    beta = F.when(ok, F.col("__cov") / F.col("__bv"))
    out = [
        beta.alias("beta"),
        ((F.col("__ms") - beta * F.col("__mb")) * per_year).alias("annual_alpha"),
        F.when(ok & (F.col("__sd") > 0), (F.col("__ms") - F.col("__mb")) / F.col("__sd") * per_year**0.5).alias("information_ratio"),
        F.when(ok, F.col("__corr")).alias("correlation"),
    ]
    return parts, out


def against_benchmark(rows: DataFrame, per_year: float) -> DataFrame:
    """beta, annual_alpha, information_ratio and correlation over periods where both returns exist."""
    parts, out = _against(per_year)
    return rows.agg(*parts).select(*out)


def _trading(per_year: float) -> tuple[list[Column], list[Column]]:
    parts = [F.avg("turnover").alias("average_turnover"), F.avg("gross_exposure").alias("average_gross_exposure")]
    return parts, [F.col("average_turnover"), (F.col("average_turnover") * per_year).alias("annual_turnover"), F.col("average_gross_exposure")]


def trading(rows: DataFrame, per_year: float) -> DataFrame:
    """average_turnover, annual_turnover and average_gross_exposure over periods with a return."""
    parts, out = _trading(per_year)
    return rows.where("strategy_return is not null").agg(*parts).select(*out)


def max_drawdown(rows: DataFrame, column: str = "strategy_return") -> DataFrame:
    """max_drawdown of rows (exit, column): the least of equity over its running maximum, less one. The peak starts after the first period."""
    return equity(rows.where(F.col(column).isNotNull()), column).agg(F.coalesce(F.min("drawdown"), F.lit(0.0)).alias("max_drawdown"))


def summary(rows: DataFrame, per_year: float, risk_free: float = 0.0) -> DataFrame:
    """All metrics of a periods table in one row, by one aggregate; without a period with a return only periods (0) and total_return (0) are set."""
    known = _with_var(equity(rows.where("strategy_return is not null").select("exit", "strategy_return", "benchmark_return", "turnover", "gross_exposure")))
    pairs = [_core(per_year, risk_free), _moments(), _trading(per_year), _against(per_year)]
    parts = [*(p for a, _ in pairs for p in a), *_tail(), F.coalesce(F.min("drawdown"), F.lit(0.0)).alias("max_drawdown")]
    out = known.agg(*parts).select(*(o for _, b in pairs for o in b), "var_95", "cvar_95", "max_drawdown")
    out = out.withColumn("calmar", F.when(F.col("max_drawdown") < 0, F.col("annual_return") / F.abs("max_drawdown")))
    some = F.col("periods") > 0
    names = [c for c in out.columns if c not in ("periods", "total_return")]
    return out.select("periods", F.when(some, F.col("total_return")).otherwise(0.0).alias("total_return"), *(F.when(some, finite(F.col(c).cast("double"))).alias(c) for c in names))
