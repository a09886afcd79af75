"""Exponential averages. They recur over each symbol's sessions, so a symbol's rows meet in one Arrow-fed group."""

from __future__ import annotations

from pyspark.sql import DataFrame


def _decay(values, alpha: float, least: int):
    """Weighted mean of all values so far with weights (1 - alpha) ** age, once there are `least`; ages count sessions, missing values included. A compiled filter of pandas."""
    import pandas as pd

    return pd.Series(values).ewm(alpha=alpha, adjust=False, ignore_na=False, min_periods=least).mean().to_numpy()


def _dense(pdf):
    """The symbol's closes at every session number from its first to its last."""
    import numpy as np

    n = np.arange(pdf["n"].iloc[0], pdf["n"].iloc[-1] + 1)
    close = np.full(len(n), np.nan)
    close[pdf["n"].to_numpy() - n[0]] = pdf["close"].to_numpy()
    return close, pdf["n"].to_numpy() - n[0]


def ema(px: DataFrame, span: int) -> DataFrame:
    """symbol, session, ema of prices (symbol, session, n, close)."""

    def group(pdf):
        pdf = pdf.sort_values("n", ignore_index=True)
        close, at = _dense(pdf)
        return pdf[["symbol", "session"]].assign(ema=_decay(close, 2 / (span + 1), span)[at])

    return px.select("symbol", "session", "n", "close").groupBy("symbol").applyInPandas(group, "symbol string, session date, ema double")


def rsi(px: DataFrame, period: int = 14) -> DataFrame:
    """symbol, session, rsi (Wilder); null while short of values and where there was no loss."""

    def group(pdf):
        import numpy as np

        pdf = pdf.sort_values("n", ignore_index=True)
        close, at = _dense(pdf)
        step = np.concatenate([[np.nan], np.diff(close)])
        up, down = (_decay(np.where(np.isnan(step), np.nan, np.maximum(s * step, 0)), 1 / period, period) for s in (1, -1))
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.where(down > 0, 100 - 100 / (1 + up / down), np.nan)
        return pdf[["symbol", "session"]].assign(rsi=value[at])

    return px.select("symbol", "session", "n", "close").groupBy("symbol").applyInPandas(group, "symbol string, session date, rsi double")
