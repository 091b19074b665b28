"""Candles from raw ticks, from other candles, and from a landing area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import OHLCV, require_columns


def bucket(ts: Column | str, seconds: int) -> Column:
    """The start of the ``seconds``-wide bar that ``ts`` lies in (UTC epoch)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / seconds) * seconds)


def from_ticks(ticks: DataFrame, seconds: int, price: str = "price", size: str | None = None, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Bars of ``seconds`` from ticks (``symbol, ts, price``).  ``order`` breaks
    ties for open and close; without ``size`` volume counts ticks.  One grouped
    aggregate, combined before its only shuffle; empty bars don't exist."""
    require_columns(ticks, "symbol", "ts", price)
    key = F.struct(*order)
    return ticks.groupBy("symbol", bucket("ts", seconds).alias("ts")).agg(
        F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, key).alias("close"),
        (F.count("*") if size is None else F.sum(size)).cast("double").alias("volume"),
    )


def resample(candles: DataFrame, seconds: int) -> DataFrame:
    """Coarser bars from candles: first open, highest high, lowest low, last
    close, summed volume; bars without a candle don't exist."""
    require_columns(candles, "symbol", "ts", *OHLCV)
    return candles.groupBy("symbol", bucket("ts", seconds).alias("ts")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")
    )


def cumulative(df: DataFrame, value: str, out: str, block: Column, order: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Running sum of ``value`` in two levels: inside blocks, and over block
    totals.  ``block`` must not decrease along ``order``; no task gets more than
    one block's rows or one row per block."""
    near = Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("__block", block)
    totals = rows.groupBy(*keys, "__block").agg(F.sum(value).alias("__total"))
    before = Window.partitionBy(*(keys or (F.lit(1),))).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    heads = totals.select(*keys, "__block", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))
    return rows.join(heads, [*keys, "__block"]).withColumn(out, F.col("__before") + F.sum(value).over(near)).drop("__block", "__before")


def integer_walk(events: DataFrame, symbol: str = "ALL") -> DataFrame:
    """Ticks of one walking price from events (``event_id, ts, value``).

    Values become whole cents, less their integer mean, and are summed along
    ``ts, event_id``: exact in any order of execution.
    """
    rows = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    rows = rows.withColumn("hour", F.floor(F.unix_seconds("ts") / 3600))
    # one row per hour gives the mean and what each hour starts from
    hours, past = Window.partitionBy(F.lit(1)), Window.partitionBy(F.lit(1)).orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    heads = rows.groupBy("hour").agg(F.sum("cents").alias("c"), F.count("*").alias("n")).withColumns({"all_c": F.sum("c").over(hours), "all_n": F.sum("n").over(hours)}).withColumn("mu", F.expr("all_c div all_n"))
    heads = heads.select("hour", "mu", F.coalesce(F.sum(F.col("c") - F.col("mu") * F.col("n")).over(past), F.lit(0)).alias("before"))
    inner = Window.partitionBy("hour").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    level = F.col("before") + F.sum(F.col("cents") - F.col("mu")).over(inner)
    return rows.join(heads, "hour").select(F.lit(symbol).alias("symbol"), "ts", "event_id", (F.lit(10000) + level / F.lit(100.0)).alias("price"))


def landed(raw: DataFrame, seconds: int, now: Column, arrival: str = "arrival") -> DataFrame:
    """Candles fit for use from a landing table with repeats: per symbol and
    time the first to arrive, bars that have not closed by ``now`` left out."""
    require_columns(raw, "symbol", "ts", *OHLCV, arrival)
    first = Window.partitionBy("symbol", "ts").orderBy(arrival)
    kept = raw.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    closed = kept.where(F.unix_seconds("ts") + seconds <= F.unix_seconds(now))
    return closed.select("symbol", F.col("ts").cast("timestamp").alias("ts"), *[F.col(c).cast("double").alias(c) for c in OHLCV])


def landed_rates(raw: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Funding rates fit for use from a landing table with repeats: per symbol
    and time the first to arrive, checked (``require_valid_funding``)."""
    from ..operators.quality import require_valid_funding

    require_columns(raw, "symbol", "ts", "funding", arrival)
    kept = raw.groupBy("symbol", F.col("ts").cast("timestamp").alias("ts")).agg(F.min_by("funding", arrival).cast("double").alias("funding"))
    return require_valid_funding(kept)
