"""Entity schemas and the checks operators make on entry."""

from __future__ import annotations

from pyspark.sql import DataFrame

CANDLES = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"
FUNDING = "symbol string, ts timestamp, funding double"
OHLC = ("open", "high", "low", "close")
OHLCV = (*OHLC, "volume")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df`` itself; raises ``KeyError`` if a column is missing."""
    if missing := [n for n in names if n not in df.columns]:
        raise KeyError(f"missing columns: {missing}")
    return df
