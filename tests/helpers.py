"""Builders of small candle tables."""

from __future__ import annotations

import datetime as dt

BASE = dt.datetime(2024, 1, 1)


def bars(spark, closes, wick=0.5, hours=4, symbol="X", opens=None, highs=None, lows=None):
    """Candles of the given closes, ``wick`` above and below."""
    rows = []
    for i, c in enumerate(closes):
        o = opens[i] if opens else c
        rows.append((symbol, BASE + dt.timedelta(hours=hours * i), float(o), float(highs[i] if highs else max(o, c) + wick), float(lows[i] if lows else min(o, c) - wick), float(c), 1.0))
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")


def at(i, hours=4):
    return BASE + dt.timedelta(hours=hours * i)


def column(df, name, order="ts"):
    return [r[name] for r in df.orderBy(order).collect()]
